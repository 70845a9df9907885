import pytest
from pyspark.sql import functions as F

from spikeframe.functions import scalar
from spikeframe.operators import behaviour as B
from spikeframe.operators import joins as J
from spikeframe.operators import statistics as S
from spikeframe.streaming import rates


@pytest.mark.parametrize(("values", "out"), [([10, 0, 0, 0, 1], [11, 10, 0, 1, 11]), ([2, 7, 1, 8, 2, 8], [17, 10, 16, 11, 18, 12])])
def test_rolling_sum(spark, values, out):
    h = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, bin int, n int")
    assert [r.n for r in B.rolling_circular(h, ["k"], len(values), 3).orderBy("bin").collect()] == out


def test_heading(spark):
    df = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(zip([5, 5, 7, 6, 6], [5, 8, 8, 9, 2], strict=True))], "k int, i int, x double, y double")
    assert [round(r.heading) for r in B.heading(df, ["k"], ["i"]).orderBy("i").collect()] == [270, 270, 180, 315, 90]


def test_runs(spark):
    df = spark.createDataFrame([(1, i) for i in (4, 6, 7, 8, *range(30, 33), 50)], "k int, i int")
    assert sorted((r.start, r.end) for r in B.runs(df, ["k"], "i").collect()) == [(4, 4), (6, 8), (30, 32), (50, 50)]


def test_first_spike(spark):
    s = spark.createDataFrame([("a", t) for t in (40, 90, 91, 300)], "session_id string, t long")
    p = spark.createDataFrame([("a", 90), ("a", 85), ("a", 120), ("a", 300)], "session_id string, pulse long")
    got = {r.pulse: (r.spike, r.latency) for r in J.first_after(s, p, 5).collect()}
    assert got == {90: (91, 1), 85: (90, 5), 120: (None, None), 300: (None, None)}


def test_dead_channels(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([1, 2, 5, 4])], "i int, c int")
    assert [r.x for r in df.withColumn("x", scalar.live_channel(F.col("c"), [2, 6])).orderBy("i").collect()] == [1, 3, 7, 5]


def test_tags(spark):
    df = spark.createDataFrame([(0, "track_length=180*note*pixel_ratio=401"), (1, None)], "i int, tags string")
    rows = df.withColumns(scalar.tag_values("tags")).orderBy("i").collect()
    assert rows[0].pixel_ratio == 401 and rows[0].track_length == 180 and rows[0].unexpected_tag and rows[1].pixel_ratio == 440 and not rows[1].unexpected_tag


def test_empty_and_constant(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)] * 3, "k int, a double, b double")
    assert df.groupBy("k").agg(scalar.safe_corr("a", "b").alias("r")).first().r is None
    empty = df.where("false").withColumn("s", F.lit(0))
    assert S.kuiper(empty, ["k"], "s", "a").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    df = spark.sql("SELECT id % 3 AS k, timestamp_seconds(1700000000 + id * 37) AS ts FROM range(200)")
    df.write.parquet(f"{tmp_path}/in")
    stream = rates.windowed_counts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["k"], "10 minutes", "1 minute")
    stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, rates.windowed_counts(df, ["k"], "10 minutes").collect()))
