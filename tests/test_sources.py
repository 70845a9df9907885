"""Readers and sinks on files that the tests write, and the ingest of a stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeframe.sources import files, recordings, records
from spikeframe.streaming import rates


def test_tracking(spark, tmp_path):
    (tmp_path / "a.csv").write_text("2020-02-01T10:00:05.50+00:00 1 2 3 4 9 \n2020-02-01T10:00:04.50+00:00 5 6 7 8 9 \n2020-02-01T10:01:05.50+00:00 1 1 1 1 1 \n")
    (tmp_path / "b.csv").write_text("time,other\n1,2\n")
    (tmp_path / "c.csv").write_text("20-02-01T10:00:05 1 2 3 4 9\n")
    rows = files.read_tracking(spark, f"{tmp_path}/a.csv").orderBy("row_no").collect()
    assert [(r.t, r.x_left, r.y_right, r.sync_led) for r in rows] == [(0.0, 1.0, 4.0, 9.0), (-1.0, 5.0, 8.0, 9.0), (60.0, 1.0, 1.0, 1.0)]
    assert [r.file.rsplit("/", 1)[1] for r in recordings.tracking_files(spark, str(tmp_path)).collect()] == ["a.csv"]


def test_session_metadata_and_quality(spark, tmp_path):
    (tmp_path / "parameters.txt").write_text("openfield\r\nroom/one\r\npixel_ratio=380*paired=u,v*cue_conditioned_goal=true*odd=1\r\n")
    r = files.read_sessions(spark, f"{tmp_path}/parameters.txt").first()
    assert (r.session_type, r.location, r.pixel_ratio, r.stop_threshold, r.paired, r.cue_conditioned_goal, r.unexpected_tag) == ("openfield", "room/one", 380, 4.9, ["u", "v"], True, True)
    (tmp_path / "q.json").write_text(json.dumps({"clusters": [{"label": 3, "metrics": {"isolation": 0.9, "peak_snr": 2.0}}, {"label": 4, "metrics": {"isolation": 0.1, "peak_snr": 1.0}}]}))
    quality = files.read_cluster_quality(spark, f"{tmp_path}/q.json").withColumn("session_id", F.lit("s"))
    cells = spark.createDataFrame([("s", 3), ("s", 9)], "session_id string, cluster_id long")
    assert {(x.cluster_id, x.isolation) for x in files.with_quality(cells, quality.drop("file"), ["session_id"]).collect()} == {(3, 0.9), (9, None)}


def continuous(path, data, n=1024):
    rows = np.zeros(len(data), records.RECORD)
    rows["timestamp"], rows["n"], rows["recording"], rows["data"] = np.arange(len(data)) * 1024 + 500, n, 2, data
    path.write_bytes(b"header.bitVolts = 0.5;\n".ljust(1024) + rows.tobytes())


def test_channel_files(spark, tmp_path):
    data = np.arange(3 * 1024).reshape(3, 1024) - 1000
    continuous(tmp_path / "100_CH7.continuous", data)
    df = recordings.read_continuous(spark, str(tmp_path))
    assert [(r.channel, r.block_no, r.timestamp, r.recording) for r in df.orderBy("block_no").collect()] == [(7, i, 500 + 1024 * i, 2) for i in range(3)]
    long = recordings.samples(df)
    assert [(r.t, r.value) for r in long.where("t in (0, 1023, 1024, 3071)").orderBy("t").collect()] == [(0, -500.0), (1023, 11.5), (1024, 12.0), (3071, 1035.5)]
    continuous(tmp_path / "100_CH8.continuous", data, 1000)
    with pytest.raises(Exception, match="another size"):
        recordings.read_continuous(spark, str(tmp_path)).count()


def test_matrices_and_clusters(spark, tmp_path):
    m = np.array([[3, 5, 3, 5], [40, 10, 20, 30], [1, 2, 1, 2]])
    for name, code, kind in (("a", -7, "<f8"), ("b", -5, "<i4"), ("c", -8, "<u4")):
        (tmp_path / f"{name}.mda").write_bytes(np.array([code, 8, 2, 3, 4], "<i4").tobytes() + m.astype(kind).tobytes(order="F"))
    spikes = recordings.sorted_spikes(recordings.read_matrices(spark, str(tmp_path)))
    got = recordings.cluster_frame(spikes, ["file"]).collect()
    assert len(got) == 6 and {(r.cluster_id, tuple(r.firing_times), r.primary_channel) for r in got} == {(1, (20, 40), 3), (2, (10, 30), 5)}


def test_files_are_read_by_ranges_of_records(spark, tmp_path):
    """Many ranges give the rows of one, a task holds one chunk at a time, and only the wanted channels' files are opened."""
    data = np.arange(40 * 1024).reshape(40, 1024) % 30000
    for c in (1, 2, 11):
        continuous(tmp_path / f"100_CH{c}.continuous", data + c)
    whole = recordings.read_continuous(spark, str(tmp_path))
    parts = recordings.read_continuous(spark, f"file:{tmp_path}", rangeBytes=3 * 2070)
    assert whole.rdd.getNumPartitions() == 3 and parts.rdd.getNumPartitions() == 3 * 14
    rows = lambda df: sorted((r.channel, r.block_no, r.timestamp, r.data[0], r.data[-1]) for r in df.collect())
    assert rows(whole) == rows(parts) and len(rows(parts)) == 120
    (tmp_path / "100_CH2.continuous").write_bytes(b"cut")
    one = recordings.read_continuous(spark, str(tmp_path), channels=[11])
    assert one.rdd.getNumPartitions() == 1 and [r.channel for r in one.select("channel").distinct().collect()] == [11]
    assert recordings.read_continuous(spark, str(tmp_path), channels=[]).count() == 0
    with pytest.raises(Exception, match="whole records"):
        recordings.read_continuous(spark, str(tmp_path)).count()


def test_matrices_of_several_dimensions_are_read_by_ranges(spark, tmp_path):
    m = np.arange(2 * 3 * 50, dtype="<i2").reshape(2, 3, 50, order="F")
    (tmp_path / "a.mda").write_bytes(np.array([-4, 2, 3, 2, 3, 50], "<i4").tobytes() + m.tobytes(order="F"))
    (tmp_path / "b.mda").write_bytes(np.array([-4, 2, -2], "<i4").tobytes() + np.array([2, 150], "<i8").tobytes() + m.tobytes(order="F"))
    df = recordings.read_matrices(spark, str(tmp_path), rangeBytes=64)
    assert df.rdd.getNumPartitions() == 20
    for name in ("a", "b"):
        got = [tuple(r["values"]) for r in df.where(F.col("file").endswith(f"{name}.mda")).orderBy("col").collect()]
        assert got == [tuple(map(float, c)) for c in m.reshape(2, 150, order="F").T]
    (tmp_path / "c.mda").write_bytes(np.array([-4, 2, 2, 2, 99], "<i4").tobytes())
    with pytest.raises(Exception, match="shorter"):
        recordings.read_matrices(spark, str(tmp_path)).count()


def test_a_file_of_three_gigabytes_is_read_by_many_tasks(spark, tmp_path):
    """A sparse file: its records exist as zeros, so a record of size 0 is refused, and the ranges lie beyond 2 GB."""
    columns = 50_000_000
    with open(tmp_path / "big.mda", "wb") as f:
        f.write(np.array([-7, 8, 2, 8, columns], "<i4").tobytes())
        f.truncate(20 + columns * 64)
        f.seek(20 + (columns - 1) * 64)
        f.write(np.arange(8, dtype="<f8").tobytes())
    reader = records.Reader({"path": str(tmp_path), "kind": "matrices"})
    ranges = reader.partitions()
    assert len(ranges) == 48 and ranges[-1].last == columns
    last = list(reader.read(records.Range(ranges[-1].file, columns - 3, columns, ranges[-1].layout)))
    assert last[0].column("values").to_pylist()[2] == [float(i) for i in range(8)] and last[0].column("col").to_pylist() == [columns - 3, columns - 2, columns - 1]


def test_events_keep_the_last_record(spark, tmp_path):
    rows = np.zeros(4, records.EVENT)
    rows["timestamp"], rows["channel"], rows["event"] = [5, 6, 7, 8], 3, [1, 0, 1, 0]
    (tmp_path / "all.events").write_bytes(b" " * 1024 + rows.tobytes())
    (tmp_path / "none.events").write_bytes(b" " * 1024)
    assert [(r.timestamp, r.channel, r.event) for r in recordings.read_events(spark, str(tmp_path)).orderBy("event_no").collect()] == [(5, 3, 1), (6, 3, 0), (7, 3, 1), (8, 3, 0)]


def test_live_channels(spark, tmp_path):
    (tmp_path / "dead.txt").write_text("2\n7\n\n")
    got = recordings.live_channels(spark, f"{tmp_path}/dead.txt", 8).orderBy("channel").collect()
    assert [(r.channel, r.tetrode) for r in got] == [(1, 1), (3, 1), (4, 1), (5, 2), (6, 2), (8, 2)]


def test_sessions_and_results(spark, tmp_path):
    a = spark.createDataFrame([("s1", 1, 0.5), ("s2", 1, None)], "session_id string, cluster_id int, hd_score double")
    files.write_results(str(tmp_path), spatial_firing=a, position=a.select("session_id", "cluster_id"))
    files.write_results(str(tmp_path), spatial_firing=a.where("session_id = 's1'").withColumn("hd_score", F.lit(0.7)))
    got = recordings.load_sessions(spark, f"{tmp_path}/spatial_firing", ["hd_score"], ["cluster_id", "hd_score", "absent"]).collect()
    assert [tuple(r) for r in got] == [("s1", 1, 0.7, None)]
    assert recordings.load_sessions(spark, f"{tmp_path}/spatial_firing", ["absent"], ["cluster_id"]).count() == 0
    assert spark.read.parquet(f"{tmp_path}/spatial_firing").count() == 2


def test_foreign_tracking(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 2.0, 0.0), ("a", 0.02, 1.0, 1.0, 1.0, 3.0), ("b", 0.0, 1.0, None, 1.0, 1.0)], "session_id string, post double, posx double, posy double, posx2 double, posy2 double")
    got = recordings.foreign_position(df, ["session_id"]).orderBy("pos_idx").collect()
    assert [(r.session_id, r.pos_idx, r.x, r.y, round(r.hd), round(r.sampling_rate)) for r in got] == [("a", 0, 1.0, 0.0, 0, 50), ("a", 1, 1.0, 2.0, 90, 50)]
    s = spark.createDataFrame([("a", 1.5)], "session_id string, t double")
    assert recordings.foreign_spikes(s, ["session_id"], "t", 1000.0).first().t_sample == 1500
    assert [r.idx for r in recordings.pulse_samples(s.union(s), ["session_id"], "t", 30.0).collect()] == [45]
    assert recordings.simulated_position(spark.createDataFrame([(350.0,)], "hd double")).first().hd == 170.0


def test_curation_output(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1/cluster_group.tsv").write_text("cluster_id\tgroup\n1\tgood\n2\tunsorted\n5\tgood\n")
    (tmp_path / "s1/cluster_info.tsv").write_text("cluster_id\tch\tfr\n1\t0\t3\n2\t6\t1\n7\t3\t1\n")
    both, lost = recordings.curated_clusters(spark, str(tmp_path))
    assert sorted((r.session, r.cluster_id, r.cluster_group, r.primary_channel, r.unsorted) for r in both.collect()) == [("s1", 1, "good", 1, False), ("s1", 2, "unsorted", 7, True)]
    assert sorted(r.cluster_id for r in lost.collect()) == [5, 7]


def test_pulse_series(spark):
    p = spark.createDataFrame([("a", 0, 2, 10.0), ("a", 1, 3, 20.0)], "session_id string, no int, pulses int, intensity double")
    pulses = spark.createDataFrame([("a", i) for i in range(1, 8)], "session_id string, pulse_id long")
    got = recordings.pulse_series(p, pulses, ["session_id"], "no").orderBy("pulse_id").collect()
    assert [(r.pulse_id, r.intensity) for r in got] == [(1, 10.0), (2, 10.0), (3, 20.0), (4, 20.0), (5, 20.0)]


def test_labelled_export(spark, tmp_path):
    s = spark.createDataFrame([("a", 1, 5.0, 5.0), ("a", 1, 25.0, 5.0), ("a", 1, 95.0, 5.0)], "session_id string, cluster_id int, x_px double, y_px double")
    bins = spark.createDataFrame([("a", 1, 0, 0, 0), ("a", 1, 1, 0, 0), ("a", 1, 1, 2, 0)], "session_id string, cluster_id int, field_id long, bin_x long, bin_y long")
    df = recordings.labelled_samples(s, bins, ["session_id", "cluster_id"], 10.0)
    assert sorted((r.x_px, r.field_id) for r in df.collect()) == [(5.0, 2), (25.0, 2), (95.0, 0)]
    recordings.export(df, f"{tmp_path}/out", ["session_id", "cluster_id"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 3


def test_ingest_keeps_files_of_both_batches_and_replays(spark, tmp_path):
    row = lambda name, rows: spark.createDataFrame(rows, "session_id string, v int").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    run = lambda check: rates.ingest(spark.readStream.schema("session_id string, v int").json(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/bad", F.col("v") > 0, f"{tmp_path}/{check}").awaitTermination()
    row("a", [("s", 1), ("s", -1)])
    run("c")
    row("b", [("s", 2), ("t", 3), ("t", None)])
    run("c")
    assert sorted((r.session_id, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("s", 1), ("s", 2), ("t", 3)]
    run("again")  # everything once more
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3 and spark.read.parquet(f"{tmp_path}/bad").count() == 2


def test_complete_sessions(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
    (tmp_path / "one/copied.txt").write_text("")
    assert [r.session_id for r in rates.complete_sessions(spark, str(tmp_path)).collect()] == ["one"]
