"""Plans and results whose cost may not depend on how rows lie in their files, or on the number of small groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeframe.operators import behaviour as B
from spikeframe.operators import firing_fields as P
from spikeframe.operators import joins as J
from spikeframe.operators import maps as M
from spikeframe.operators import sessions as T
from spikeframe.operators import shuffles as H
from spikeframe.operators import spectra as Z
from spikeframe.operators.groups import in_groups


def plan_lines(df):
    return [line.strip(" +-:") for line in df._jdf.queryExecution().executedPlan().toString().split("\n")]


def interleaved(spark, sessions=40, each=30):
    """Sessions whose samples alternate row by row."""
    return spark.range(sessions * each).select((F.col("id") % sessions).alias("session_id"), (F.col("id") % 3).alias("cluster_id"), (F.col("id") * 37 % 400).cast("double").alias("x_px"), (F.col("id") * 91 % 397).cast("double").alias("y_px"))


def test_partial_maps_come_from_sorted_groups(spark):
    p = interleaved(spark)
    lines = plan_lines(M.rate_map(p, p, ["session_id", "cluster_id"], ["session_id"], 40.0, 60.0, 1 / 30, 3))
    below = [lines[k + 1] for k, line in enumerate(lines) if "MapInPandas" in line]
    assert len(below) == 2 and all("Sort" in line for line in below)


def test_interleaved_sessions_give_their_own_maps(spark):
    p = interleaved(spark)
    found = {(r.session_id, r.bin_x, r.bin_y): r.rate for r in M.rate_map(p.withColumn("cluster_id", F.lit(0)), p, ["session_id", "cluster_id"], ["session_id"], 40.0, 60.0, 1 / 30, 3).collect()}
    seen = {(r.session_id, r.bin_x, r.bin_y): r.occupancy for r in M.occupancy(p, ["session_id"], 40.0, 60.0, 3).collect()}
    rows = p.where("session_id = 7").collect()
    for bx in range(12):
        for by in range(12):
            n = sum(math.hypot(r.x_px - (bx + 0.5) * 40, r.y_px - (by + 0.5) * 40) <= 60 for r in rows)
            assert seen.get((7, bx, by)) == (n if n >= 3 else None)
            if (7, bx, by) in found:
                assert found[7, bx, by] == pytest.approx(30.0 if n >= 3 else 0.0)
    assert {s for s, _, _ in found} == set(range(40)) and not np.isnan(list(found.values())).any()


def per_group(df):
    return [line for line in plan_lines(df) if "FlatMapGroupsInPandas" in line]


def test_small_groups_share_calls(spark):
    s = spark.range(600).select((F.col("id") % 20).alias("cell"), F.floor(F.col("id") / 20).alias("t"), (F.col("id") * 7 % 11).cast("double").alias("value"))
    for df in (Z.welch(s, ["cell"], "t", "value", 10.0, 10, 30), Z.epoch_bands(s, ["cell"], "t", "value", 10.0, 10, {"slow": (1, 2)}), Z.theta_index(s, ["cell"], "t", 20_000), B.smoothed(s, ["cell"], "t", "value", 1.0)):
        assert not per_group(df)
        assert {r.cell for r in df.collect()} == set(range(20))


def test_groups_over_batches_are_whole(spark):
    sizes = [1, 30, 3, 1, 1, 95, 7, 2]
    rows = spark.createDataFrame([(k, i) for k, n in enumerate(sizes) for i in range(n)], "k long, i long").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        found = in_groups(rows, ["k"], lambda pdf, starts: pdf.iloc[starts][["k"]].assign(n=np.diff(np.append(starts, len(pdf)))), "k long, n long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.k, r.n) for r in found) == list(enumerate(sizes))


def test_expected_ratios_equal_those_of_repeated_bins(spark):
    expected = spark.createDataFrame([(f, b, 1 + (f * b) % 5) for f in range(3) for b in range(8)], "f long, bin long, n long")
    observed = spark.createDataFrame([(f, h, b, 1 + (f + h + b) % 3) for f in range(4) for h in range(6) for b in range(9) if (f * 7 + h * 3 + b) % 4 == 0 and h != 2], "f long, shuffle_id int, bin long, n long")
    repeated = expected.withColumn("shuffle_id", F.explode(F.sequence(F.lit(0), F.lit(5))))
    key = lambda df: {(r.f, r.shuffle_id): round(r.ratio, 9) for r in df.collect()}
    found = H.expected_ratios(observed, expected, ["f"], 6)
    assert key(found) == key(H.expected_ratio(observed, repeated, ["f", "shuffle_id"]))


def test_draws_grow_after_their_join(spark):
    cells = spark.createDataFrame([(k, k % 2, 3) for k in range(8)], "cell long, session_id long, n long")
    samples = spark.range(40).select((F.col("id") % 2).alias("session_id"), F.col("id").alias("pos_idx"))
    for weight in (None, F.lit(1.0)):
        df = H.drawn_samples(cells, samples, 5, ["session_id"], ["session_id", "cell"], "n", "seed", weight)
        lines = plan_lines(df)
        grown = next(k for k, line in enumerate(lines) if "Generate explode" in line and "__n" in line)
        assert any("Exchange" in line for line in lines[grown : grown + 6]) and any("Join" in line for line in lines[grown : grown + 8])
        assert df.count() == 8 * 5 * 3


def test_sessions_sorted_several_times_stay_in_many_tasks(spark):
    p = spark.range(60).select((F.col("id") % 6).alias("session_id"), F.col("id").alias("pos_idx"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).cast("double").alias("v"))
    keys, order = ["session_id"], ["pos_idx"]
    for df in (B.interpolate(p, keys, order, "v", "pos_idx"), B.velocity(p, keys, order, "v", "pos_idx", 2, 1), T.interpolate_circular(p, keys, order, "v", "pos_idx")):
        shuffles = [line for line in plan_lines(df) if line.startswith("Exchange")]
        assert len(shuffles) == 1 and "REPARTITION_BY_NUM" in shuffles[0]


def hits(spark):
    """Spikes and positions with gaps, repeated samples, nulls, cells without samples and samples without cells."""
    rng = np.random.default_rng(11)
    rows = [(s, k, k / 3.0, None if k % 17 == 0 else float(rng.integers(-180, 181))) for s in range(4) for k in range(90) if s < 3 or k % 4]
    position = spark.createDataFrame([*rows, *rows[10:20], (7, 0, 0.0, 5.0)], "session_id long, pos_idx long, synced_time double, hd double")
    spikes = [(s, c, int(t)) for s in range(5) for c in range(3) for t in rng.integers(0, 1000, 25 + 10 * c)]
    return spark.createDataFrame([*spikes, (7, 0, 5)], "session_id long, cluster_id long, t long"), position


def test_shuffled_rates_equal_joined_copies(spark):
    from spikeframe.operators import bars as Q
    from spikeframe.operators import joins as J

    s, p = hits(spark)
    cell, copy = ["session_id", "cluster_id"], ["session_id", "cluster_id", "shuffle_id"]
    p = p.withColumn("bin", F.least(F.floor((F.col("hd") + 180) / 45), F.lit(7)))
    rates = H.shuffled_rates(s, p, 12, 1000, 100, ["session_id"], cell, "bin", 8, ephys_rate=30.0)
    lines = plan_lines(rates)
    assert not any("explode" in line for line in lines) and not any("pos_idx" in line and "Join" in line for line in lines)  # no row for a copy's spike
    moved = H.time_shifts(s, 12, 1000, 100, cell).withColumnRenamed("t", "t_sample")
    both = moved.unionByName(s.select(*cell, F.col("t").alias("t_sample"), F.lit(-1).alias("shuffle_id")))
    counts = J.spikes_to_positions(both, p, 30.0).groupBy(*copy, "bin").agg(F.count("*").alias("n"))
    time = p.groupBy("session_id", "bin").agg(F.count("*").alias("o"))
    long = Q.bar_rates(counts, both.select(*copy).distinct(), time, copy, ["session_id"], "bin")
    wanted = {(r.session_id, r.cluster_id, r.shuffle_id, r.bin): r.rate for r in long.collect()}
    found = {(r.session_id, r.cluster_id, r.shuffle_id, b): v for r in rates.collect() for b, v in enumerate(r.rates) if v is not None}
    assert found == wanted and len(found) > 1000 and any(found.values())

    own, other = long.where("shuffle_id < 0").drop("shuffle_id"), long.where("shuffle_id >= 0")
    pairs = ((Q.observed_p(own, other, cell, "bin", "rate"), cell, "shuffle_id < 0"), (Q.shuffled_p(other, cell, "bin", "rate"), copy, "shuffle_id >= 0"))
    tests = Q.bar_tests(rates, cell, level=0.4).cache()
    for by, keys, which in pairs:
        assert sorted(Q.significant(by, keys, "bin", 0.4).collect()) == sorted(tests.where(which).select(*keys, "n_bh", "n_holm").collect())
    outside = {(r.session_id, r.cluster_id): r.n for r in pairs[0][0].groupBy(*cell).agg(F.count_if("outside").alias("n")).collect()}
    assert outside == {(r.session_id, r.cluster_id): r.n_outside for r in Q.bar_tests(rates, cell, shuffles=False).collect()} and any(outside.values())
    sure, rest = (Q.significant(by, keys, "bin", 0.4) for by, keys, _ in pairs)
    assert sorted(Q.directional(sure, rest, cell).collect()) == sorted(Q.directional_tests(tests, cell).collect())


def test_sums_of_copies_equal_those_of_their_spikes(spark):
    s, _ = hits(spark)
    cell = ["session_id", "cluster_id"]
    more = spark.createDataFrame([(8, 0, None), (8, 1, None), (8, 1, 999), (8, 2, -1), (8, 2, 2500), (8, 2, 0), (None, 1, 3), (9, None, 4)], "session_id long, cluster_id long, t long")
    s = s.unionByName(more)
    df = H.shift_summaries(s, 40, 1000, 100, cell)
    assert not any("Join" in line or "explode" in line for line in plan_lines(df))
    old = H.time_shifts(s, 40, 1000, 100, cell).groupBy(*cell, "shuffle_id").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("t").alias("total"))
    assert df.dtypes == old.dtypes
    assert sorted(map(str, df.collect())) == sorted(map(str, old.collect())) and df.count() == 40 * 19


def test_shuffled_metrics_equal_joined_copies(spark):
    from spikeframe.operators import statistics as S

    s, p = hits(spark)
    cell, copy = ["session_id", "cluster_id"], ["session_id", "cluster_id", "shuffle_id"]
    p = p.withColumn("hd", F.when(F.col("pos_idx") != 3, F.when(F.col("pos_idx") == 5, F.col("hd") - 360).otherwise(F.col("hd"))))
    s = s.unionByName(spark.createDataFrame([(1, 8, 9), (1, 9, None), (1, None, 5), (2, 8, 100), (2, 8, 9_999)], "session_id long, cluster_id long, t long"))
    df = H.shuffled_metrics(s, p, 12, 1000, 100, cell, 30.0, own=True)
    lines = plan_lines(df)
    assert not any("explode" in line or "Join" in line for line in lines)  # no row for a copy's spike
    moved = H.time_shifts(s, 12, 1000, 100, cell).withColumnRenamed("t", "t_sample")
    both = moved.unionByName(s.where("cluster_id is not null").select(*cell, F.col("t").alias("t_sample"), F.lit(-1).alias("shuffle_id")))
    hit = J.spikes_to_positions(both, p, 30.0)
    hist = M.hd_histogram(hit, copy)
    old = M.hd_score(hist, copy).join(S.rayleigh(hist, copy), copy).join(hit.groupBy(*copy).agg(F.count("*").alias("n")), copy)
    key = lambda df: sorted((*r[:3], round(r.hd_score, 9), round(r.p, 9), r.n) for r in df.collect())
    assert key(df) == key(old) and len(key(df)) > 150
    assert key(H.shuffled_metrics(s, p, 12, 1000, 100, cell, 30.0)) == key(old.where("shuffle_id >= 0"))


def test_shuffled_stability_equals_joined_copies(spark):
    from spikeframe.operators import field_frames as E
    from spikeframe.operators import joins as J

    s, p = hits(spark)
    cell = ["session_id", "cluster_id"]
    p, length = T.halves(p, ["session_id"], "synced_time"), 900_000
    s = s.withColumn("t", F.col("t") * 900)
    moved = H.time_shifts(s, 6, length, 9000, cell).unionByName(s.withColumn("shuffle_id", F.lit(-1))).withColumnRenamed("t", "t_sample")
    keys = [*cell, "shuffle_id", "half"]
    old = E.half_correlation(E.direction_rates(J.spikes_to_positions(moved, p), p, keys, ["session_id", "half"], 8), keys[:-1])
    new = H.shuffled_stability(s, p, 6, length, 9000, ["session_id"], cell, 8)
    key = lambda df: {(r.session_id, r.cluster_id, r.shuffle_id): None if r.r is None else round(r.r, 9) for r in df.collect()}
    assert key(new) == key(old) and len(key(new)) > 50
    against = lambda df: sorted((r.session_id, r.cluster_id, *(None if v is None else round(v, 9) for v in r[2:])) for r in df.collect())
    assert against(E.against_own(new, cell)) == against(E.against_shuffles(old.where("shuffle_id < 0"), old.where("shuffle_id >= 0"), cell))


def histograms(spark):
    """Direction rates of fields by halves, with missing and null bins, constant fields, and a cell of one field."""
    rng = np.random.default_rng(3)
    rows = [(c, f, h, b, None if rng.random() < 0.05 else 2.0 if f == 4 else float(rng.integers(0, 4)) / 3 + (b % 4) * (f % 2)) for c in range(6) for f in range(1 if c == 5 else 7) for h in (1, 2) for b in range(8) if rng.random() < 0.9]
    return spark.createDataFrame(rows, "session_id long, field_id long, half int, bin long, ratio double")


def test_turns_of_pairs_equal_rotated_joins(spark):
    from spikeframe.operators import field_frames as E
    from spikeframe.operators import responses as R
    from spikeframe.operators import similarity as Y

    keys = ["session_id"]
    rates = histograms(spark).where("half = 1 and ratio is not null")
    bins = spark.createDataFrame([(c, f, f + k, f * k) for c in range(6) for f in range(7) for k in range(3)], "session_id long, field_id long, bin_x long, bin_y long")
    df = E.field_pairs(rates, bins, keys, "field_id", 8)
    assert not any(str(k) in line for line in plan_lines(df) for k in ("FlatMapGroups", "explode"))
    found = {(r.session_id, r.a, r.b): (None if r.r is None else round(r.r, 9), r.turn) for r in df.collect()}
    best = {(r.session_id, r.a, r.b): r.turn if r.r is not None else None for r in R.best_rotation(rates, keys, "field_id", "bin", 8, "ratio").collect()}
    wanted = {(r.session_id, r.a, r.b): (None if r.r is None else round(r.r, 9), best[r.session_id, r.a, r.b]) for r in Y.pairwise_correlation(rates, keys, "field_id", "bin", "ratio").collect()}
    assert found == wanted and len(found) == 5 * 21 and any(r is None for r, _ in found.values()) and any(t for _, t in found.values())


def test_pairs_of_halves_equal_joined_ones(spark):
    from spikeframe.functions.scalar import safe_corr
    from spikeframe.operators import field_frames as E

    keys, item, least = ["session_id"], ["session_id", "field_id"], 0.2
    rates = histograms(spark)
    own = E.half_correlation(rates, item).where(F.col("r") >= least)
    kept = rates.join(own.select(*item), item)
    side = lambda h, name: kept.where(F.col("half") == h).select("session_id", "bin", F.col("field_id").alias(name), F.col("ratio").alias(f"__{name}"))
    pairs = side(1, "a").join(side(2, "b"), ["session_id", "bin"]).where("a <> b").groupBy("session_id", "a", "b").agg(safe_corr("__a", "__b").alias("r"))
    rounded = lambda df, *c: sorted(tuple(r[x] for x in c) + (None if r.r is None else round(r.r, 9),) for r in df.collect())
    df = E.between_fields(rates, keys, least=least)
    assert sum("Exchange" in line for line in plan_lines(df)) == 1
    assert rounded(df, "session_id", "a", "b") == rounded(pairs, "session_id", "a", "b") and pairs.count() > 5
    both = own.select("session_id", F.lit(0).alias("sample"), "r").union(pairs.select("session_id", F.lit(1), "r").where("r is not null"))
    assert rounded(E.within_and_between(rates, keys, least=least), "session_id", "sample") == rounded(both, "session_id", "sample")


def test_snippets_meet_chunks(spark):
    from spikeframe.operators import waveforms as V

    rng = np.random.default_rng(8)
    there = {(s, c, t): None if t % 23 == 0 else float(rng.integers(1, 99)) for s in range(2) for c in (1, 2, 3, 6) for t in range(-80, 300) if c < 3 or rng.random() < 0.5}
    samples = spark.createDataFrame([(*k, v) for k, v in there.items()], "s long, channel int, t long, value double")
    spikes = [(s, i, 1 + i % 2, int(t)) for s in range(3) for i, t in enumerate([*rng.integers(-100, 330, 40), 54, 64, 44, 45, -64, 1000])]
    df = V.snippets(spark.createDataFrame(spikes, "s long, spike_idx long, tetrode int, t long"), samples, ["s"])
    grown = next(k for k, line in enumerate(plan_lines(df)) if "Join" in line)
    assert not any("pos" in line for line in plan_lines(df)[grown:]) and sum("Generate" in line for line in plan_lines(df)) == 2
    found = {(r.s, r.spike_idx, r.channel): r.waveform for r in df.collect()}
    assert len(found) == 4 * len(spikes)
    for s, i, tetrode, t in spikes:
        for c in range(4 * tetrode - 3, 4 * tetrode + 1):
            assert found[s, i, c] == [there.get((s, c, x)) or 0.0 for x in range(t - 10, t + 20)]


def test_inhibition_starts_from_written_cells(spark):
    from spikeframe.operators import responses as R

    keys = ["session_id", "cluster_id"]
    s = spark.range(4000).select((F.col("id") % 4).alias("session_id"), (F.col("id") % 3).alias("cluster_id"), (F.col("id") * 7919 % 2_000_000).alias("t"))
    p = spark.range(80).select((F.col("id") % 4).alias("session_id"), (F.col("id") * 25_000).alias("pulse"))
    df = R.inhibition(s, p, ["session_id"], keys, R.latency_test(s, p, ["session_id"], keys, 3000, 10), 600, 3000)
    lines = plan_lines(df)
    assert any("ExistingRDD" in line for line in lines) and sum("Join" in line for line in lines) <= 8
    assert df.count() == 12


def test_maps_are_joined_by_tiles(spark):
    p = interleaved(spark)
    joins = [line for line in plan_lines(M.rate_map(p, p, ["session_id", "cluster_id"], ["session_id"], 40.0, 60.0, 1 / 30, 3)) if "Join" in line]
    assert joins and all("tile_x" in line for line in joins)


def lit_places(spark, sessions=3, each=900, far=0):
    """Positions of some sessions, and spikes whose times name a position."""
    p = spark.range(sessions * each).select((F.col("id") % sessions).alias("session_id"), F.floor(F.col("id") / sessions).alias("pos_idx"))
    p = p.select("*", (F.col("pos_idx") / 30.0).alias("synced_time"), (F.col("pos_idx") * 37 % 400 + far).cast("double").alias("x_px"), (F.col("pos_idx") * 91 % 397 + F.col("session_id")).cast("double").alias("y_px"))
    near = "cos(x_px * 0.0605) + cos(x_px * 0.0302 + y_px * 0.0524) + cos(x_px * 0.0302 - y_px * 0.0524) > 0.5"
    return p, p.where(near).selectExpr("session_id", "pos_idx % 2 AS cluster_id", "pos_idx * 1000 AS t_sample")


@pytest.mark.parametrize("far", [0, 1000])
def test_tiled_maps_equal_maps_by_rows(spark, far):
    cell = ["session_id", "cluster_id"]
    p, s = lit_places(spark, far=far)
    key = lambda df, *more: {tuple(r[k] for k in (*cell, *more)): tuple(pytest.approx(v) for k, v in r.asDict().items() if k not in (*cell, *more)) for r in df.collect()}
    rows = M.rate_map(J.spikes_to_positions(s, p), p, cell, ["session_id"], 20.0, 30.0, 1 / 30, 3).cache()
    hit = J.spikes_to_positions(s, p)
    for tiles in (M.rate_tiles(hit, p, cell, ["session_id"], 20.0, 30.0, 1 / 30, 3), M.spike_rate_tiles(s, p, cell, ["session_id"], 20.0, 30.0, 1 / 30, 3)):
        tiles = tiles.cache()
        found = key(M.bins_of_tiles(tiles, cell, "rate"), "bin_x", "bin_y")
        assert len(found) > 2000 and found == key(rows, "bin_x", "bin_y")
        shifts = M.autocorrelogram(rows, cell)
        assert {k: n for k, (n, _) in key(M.map_autocorrelogram(tiles, cell), "dx", "dy").items()} == {k: n for k, (n, _) in key(shifts, "dx", "dy").items()}
        peaks = P.correlogram_peaks(shifts, cell)
        assert key(P.map_peaks(tiles, cell), "label") == key(peaks, "label")
        scores = key(P.grid_score(shifts, peaks, cell))
        assert scores and key(P.map_grid_score(tiles, cell)) == scores
        fields = key(P.firing_fields(rows, cell, least_bins=4), "field_id", "bin_x", "bin_y")
        assert key(P.map_fields(tiles, cell, least_bins=4).drop("rate"), "field_id", "bin_x", "bin_y") == fields


def test_groups_over_batches_give_whole_maps(spark):
    p = interleaved(spark)
    whole = {(r.session_id, r.bin_x, r.bin_y): r.occupancy for r in M.occupancy(p, ["session_id"], 40.0, 60.0, 3).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {(r.session_id, r.bin_x, r.bin_y): r.occupancy for r in M.occupancy(p, ["session_id"], 40.0, 60.0, 3).collect()} == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_scores_of_tiled_maps_equal_those_by_rows(spark):
    cell, session = ["session_id", "cluster_id"], ["session_id"]
    p, s = lit_places(spark)
    hit, seen = J.spikes_to_positions(s, p), M.occupancy_tiles(p, session, 20.0, 30.0, 30.0)
    tiles, rows, occupied = (df.cache() for df in (M.rate_tiles(hit, p, cell, session, 20.0, 30.0, 1 / 30, 3, base=seen), M.rate_map(hit, p, cell, session, 20.0, 30.0, 1 / 30, 3), M.occupancy(p, session, 20.0, 30.0, 3)))
    key = lambda df: {(r.session_id, r.cluster_id): tuple(pytest.approx(v) for v in r[2:]) for r in df.collect()}
    assert key(M.map_coherence(tiles, seen, cell, session, 3)) == key(M.coherence(rows, occupied, cell, session))
    assert key(M.map_uniform_information(tiles, seen, cell, session, 3)) == key(M.uniform_information(rows, occupied, cell, session))
    assert key(M.map_information(tiles, seen, cell, session, 3)) == key(M.spatial_information(rows, occupied, cell, session))
    assert len(key(M.map_coherence(tiles, seen, cell, session, 3))) == 6


@pytest.mark.parametrize("far", [0, 1000])
def test_maps_of_sessions_equal_tiled_ones(spark, far):
    from spikeframe.operators import borders as O

    cell, session = ["session_id", "cluster_id"], ["session_id"]
    p, s = lit_places(spark, far=far)
    hit = J.spikes_to_positions(s, p)
    key = lambda df, *more: {tuple(r[k] for k in (*cell, *more)): tuple(None if v is None else pytest.approx(v) for k, v in r.asDict().items() if k not in (*cell, *more)) for r in df.collect()}
    tiles = M.rate_tiles(hit, p, cell, session, 20.0, 30.0, 1 / 30, 3).cache()
    placed, timed = (M.SessionMaps(x, p, cell, session, 20.0, 30.0, 1 / 30, 3, rate) for x, rate in ((hit, None), (s, 30000.0)))
    peaks = P.map_peaks(tiles, cell)
    for maps in (placed, timed):
        df = P.map_peaks(maps, cell)
        assert not any("tile_x" in line or "MapInPandas" in line for line in plan_lines(df)) and key(df, "label") == key(peaks, "label")
        assert key(P.map_grid_score(maps, cell)) == key(P.map_grid_score(tiles, cell))
        assert key(P.map_fields(maps, cell, least_bins=4), "field_id", "bin_x", "bin_y") == key(P.map_fields(tiles, cell, least_bins=4), "field_id", "bin_x", "bin_y")
        assert key(M.map_autocorrelogram(maps, cell), "dx", "dy") == key(M.map_autocorrelogram(tiles, cell), "dx", "dy")
        shapes = key(O.grid_shape(peaks, cell))
        assert shapes and key(O.map_grid_shape(maps, cell)) == shapes


def test_scores_of_cells_come_from_one_pass(spark):
    cell, session = ["session_id", "cluster_id"], ["session_id"]
    p, s = lit_places(spark)
    hit = J.spikes_to_positions(s, p).select(*cell, "x_px", "y_px", F.when(F.col("x_px") % 3 > 0, F.col("y_px") * 0.9 - 180).alias("hd"))
    # a cell without places, one without positions, one without a session and one without angles
    more = spark.createDataFrame([(0, 7, None, None, 10.0), (0, 7, None, None, 180.0), (8, 0, 5.0, 5.0, -170.0), (None, 0, 5.0, 5.0, 30.0), (1, 8, 5.0, 5.0, None)], hit.schema)
    hit = hit.union(more)
    maps = M.SessionMaps(hit, p.union(p.limit(3).withColumn("session_id", F.lit(None).cast("long"))), cell, session, 20.0, 30.0, 1 / 30, 3)
    key = lambda df: {(r.session_id, r.cluster_id): tuple(None if r[c] is None else pytest.approx(r[c]) for c in ("hd_score", "grid_score")) for r in df.collect()}
    grid = P.map_grid_score(M.rate_tiles(hit, p, cell, session, 20.0, 30.0, 1 / 30, 3), cell)
    wanted = key(M.hd_score(M.hd_histogram(hit, cell), cell).join(grid, cell, "left"))
    df = P.cell_scores(maps, cell)
    assert len(wanted) == 9 and any(g is not None for _, g in wanted.values()) and key(df) == wanted


@pytest.mark.parametrize("name", ["c5_place_peaks", "c5_correlogram_peaks", "c7_place_grid_score", "c8_grid_shape", "c9_place_fields", "c9_firing_fields", "f14_place_cell_types"])
def test_positions_are_brought_together_once(spark, name):
    import __spark_entry__

    lines = plan_lines(__spark_entry__.queries()[name](spark, "/root/testdata/sf0.001"))
    assert sum("Exchange hashpartitioning" in line for line in lines) == 2 and sum("Window" in line for line in lines) == 1


@pytest.mark.parametrize("name", ["r3_shuffled_cutoffs", "r4_spatial_labels", "r9_directional_cells"])
def test_metrics_of_copies_come_from_one_meeting(spark, name):
    from spikeframe.plans import extended
    from spikeframe.plans.registry import QUERIES

    assert extended and not any("Join" in line for line in plan_lines(QUERIES[name](spark, "/root/testdata/sf0.001")))


def test_modes_of_many_cells_are_fitted_together(spark):
    from spikeframe.operators import field_frames as E

    rng = np.random.default_rng(4)
    rows = [(c, int(b), int(n)) for c in range(7) for b, n in enumerate(np.bincount(rng.integers(0, 360, 30 * c * c), minlength=360)) if n]
    counts = spark.createDataFrame([*rows, (9, 3, 0)], "cell long, bin int, n long")
    df = E.directional_modes(counts, ["cell"], "n", window=23)
    assert "FlatMapGroups" not in str(plan_lines(df))
    key = lambda df: sorted((r.cell, r.modes, r.mode, *(round(r[c], 6) for c in ("angle", "kappa", "share"))) for r in df.collect())
    assert key(df) == key(E.directional_modes(M.rolling_circular(counts, ["cell"], 360, 23), ["cell"], "n")) and {r[0] for r in key(df)} == set(range(1, 7))
    kappa = np.array([0.0, 1e-6, 0.3, 2.0, 17.0, 100.0])
    for found, wanted in zip(E._cubic(E._bessel(kappa, 1) / E._bessel(kappa, 0), *(E._concentrations()[k] for k in (3, 0, 4))), kappa, strict=True):
        assert abs(found - wanted) < 1e-9
    weights = np.stack([np.bincount([b for c, b, n in rows if c == k for _ in range(n)], minlength=360) for k in range(1, 7)]).astype(float)
    for k in (1, 3):
        together = E.von_mises_fits(weights, k)
        for i, w in enumerate(weights):
            assert all(np.allclose(a[i], b, rtol=1e-9, atol=1e-12) for a, b in zip(together, E.von_mises_fit(w, k), strict=True))


def test_draws_in_groups_equal_drawn_samples(spark):
    from spikeframe.operators import bars as Q

    s, p = hits(spark)
    s = s.withColumnRenamed("t", "t_sample")
    p = p.withColumns({"x_px": F.when(F.col("pos_idx") != 11, F.col("pos_idx") * 7 % 5), "y_px": F.col("pos_idx") * 3 % 4})
    cell, session, field = ["session_id", "cluster_id"], ["session_id"], ["session_id", "cluster_id", "field_id"]
    hit = J.spikes_to_positions(s, p, 30000.0 / 1000)
    few = s.withColumn("t_sample", F.col("t_sample") * 1000)
    counted = hit.groupBy(*cell).agg(F.count("*").alias("n"))
    key = lambda df, *c: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*c).collect())
    old = H.direction_histograms(H.drawn_samples(counted, p.select(*session, "pos_idx", "hd"), 6, session, cell, "n", "seed"), cell, "hd", 8)
    new = H.drawn_histograms(few, p, 6, session, cell, "seed", "hd", 8)
    assert new.dtypes == old.dtypes and key(new, *cell, "shuffle_id", "bin", "n") == key(old, *cell, "shuffle_id", "bin", "n") and new.count() > 300
    assert not any("Join" in line or "explode" in line for line in plan_lines(new))

    rule = 2, lambda x, y, n: np.where(n >= 3, x + y, -1)
    bins = {"bin_x": F.floor(F.col("x_px") / 2), "bin_y": F.floor(F.col("y_px") / 2)}
    fields = hit.withColumns(bins).groupBy(*cell, *bins).agg(F.count("*").alias("n")).where("n >= 3").withColumn("field_id", F.col("bin_x") + F.col("bin_y"))
    inside = hit.withColumns(bins).join(fields.drop("n"), [*cell, *bins]).groupBy(*field).agg(F.count("*").alias("n"))
    around = p.withColumns(bins).join(fields.drop("n"), [*session, *bins]).select(*field, "pos_idx", "hd")
    drawn = H.direction_histograms(H.drawn_samples(inside, around, 6, field, field, "n", "seed"), field, "hd", 8)
    assert key(H.drawn_histograms(few, p, 6, session, cell, "seed", "hd", 8, rule), *field, "shuffle_id", "bin", "n") == key(drawn, *field, "shuffle_id", "bin", "n") and drawn.count() > 300
    time = around.where("hd is not null").groupBy(*field, F.least(F.floor((F.col("hd") + 180) / 45), F.lit(7)).alias("bin")).agg(F.count("*").alias("o"))
    ratios = H.expected_ratios(drawn, time.withColumnRenamed("o", "n"), field, 6)
    assert key(H.drawn_ratios(few, p, 6, session, cell, "seed", "hd", 8, rule), *field, "shuffle_id", "ratio") == key(ratios, *field, "shuffle_id", "ratio")
    rates = Q.bar_rates(drawn, drawn.select(*field, "shuffle_id").distinct(), time, [*field, "shuffle_id"], field, "bin")
    names = [*field, "bin", "mean", "sd", "low", "high", "up", "down"]
    assert key(H.drawn_spread(few, p, 6, session, cell, "seed", "hd", 8, 1.0, rule), *names) == key(Q.bar_spread(rates, field, "bin"), *names)


def scores_by_rows(spikes, position, session, keys, bin_px, smooth, dt, least, sd, least_bins, rate):
    """The scores of keys by the operators of cells, one after the other, and joined."""
    from spikeframe.operators import borders as O
    from spikeframe.operators import similarity as Y
    from spikeframe.operators import statistics as S

    hit = J.spikes_to_positions(spikes, position, rate).localCheckpoint()
    hist = M.hd_histogram(hit, keys)
    rates = M.rate_map(hit, position, keys, session, bin_px, smooth, dt, least).localCheckpoint()
    seen = M.occupancy(position, session, bin_px, smooth, least).localCheckpoint()
    shifts = M.autocorrelogram(rates, keys)
    extent = seen.groupBy(*session).agg((F.max("bin_x") + 1).alias("nx"), (F.max("bin_y") + 1).alias("ny"))
    found = P.firing_fields(rates, keys, least_bins=least_bins).drop("max_rate").join(rates, [*keys, "bin_x", "bin_y"]).join(extent, session)
    out = spikes.select(*keys).distinct()
    for part in (
        M.hd_score(hist, keys),
        S.rayleigh(hist, keys).withColumnRenamed("p", "rayleigh_p"),
        M.spatial_information(rates, seen, keys, session).withColumnRenamed("information", "spatial_information"),
        P.grid_score(shifts, P.correlogram_peaks(shifts, keys), keys),
        O.border_score(found, keys),
        Y.smoothed_speed_score(spikes, position, session, keys, "pos_idx", "synced_time", "speed", sd, rate).drop("p"),
        Y.map_stability(hit, position, session, keys, bin_px, smooth, dt, least).select(*keys, F.col("r").alias("stability")),
    ):
        out = out.join(part, keys, "left")
    return out


def test_scores_of_copies_equal_those_by_rows(spark):
    rng = np.random.default_rng(6)
    session, cell, copy = ["session_id"], ["session_id", "cluster_id"], ["session_id", "cluster_id", "shuffle_id"]
    each, near = 700, lambda v, k: None if k % 41 == 0 else float(v)
    rows = []
    for s in range(3):
        for k in range(each if s < 2 else 3):
            x, y = rng.integers(0, 400, 2)
            rows.append((s, k, k / 30.0, near(x, k + s), float(y), near(rng.integers(-180, 181), k), None if k == 0 else near(rng.integers(0, 30), k + 5)))
    p = T.halves(spark.createDataFrame(rows, "session_id long, pos_idx long, synced_time double, x_px double, y_px double, hd double, speed double"), session, "synced_time").localCheckpoint()
    fire = lambda c, x, y: c == 0 and (x or 0) < 120 or c == 1 and math.cos((x or 0) * 0.06) + math.cos((x or 0) * 0.03 + y * 0.052) + math.cos((x or 0) * 0.03 - y * 0.052) > 1.2 or c == 2 and (x or 0) > 390
    spikes = [(r[0], c, r[1] * 1000) for r in rows for c in range(3) if fire(c, r[3], r[4])]
    s = spark.createDataFrame([*spikes, (0, 7, 699_500), (1, 7, None), (1, 8, 5_000), (2, 9, 1_000)], "session_id long, cluster_id long, t long")
    more = (20.0, 30.0, 1 / 30, 3, 2.0, 4)
    df = H.shuffled_scores(s, p, 3, 700_000, 20_000, session, cell, *more, own=True)
    assert not any("Join" in line or "explode" in line for line in plan_lines(df))  # no row for a copy's spike or map
    moved = H.time_shifts(s, 3, 700_000, 20_000, cell).unionByName(s.withColumn("shuffle_id", F.lit(-1))).withColumnRenamed("t", "t_sample")
    old = scores_by_rows(moved, p, session, copy, *more, 30000.0)
    key = lambda df, *names: sorted(str(tuple(round(v, 8) + 0.0 if isinstance(v, float) else v for v in r)) for r in df.select(*copy, *names).collect())
    assert key(df, *H.SCORES) == key(old, *H.SCORES) and df.count() == 4 * s.select(*cell).distinct().count()
    for c in H.SCORES:
        assert df.where(F.col(c).isNotNull()).count() > 3
    few = H.shuffled_scores(s, p, 3, 700_000, 20_000, session, cell, *more, only=("speed_score", "stability"))
    assert few.columns == [*copy, "speed_score", "stability"] and key(few, "speed_score", "stability") == key(old.where("shuffle_id >= 0"), "speed_score", "stability")
    mine = H.score_cutoffs(df, cell, own=True)
    wanted = H.score_cutoffs(old.where("shuffle_id >= 0"), cell).join(old.where("shuffle_id < 0"), cell)
    names = [*H.SCORES, *(f"{c}_cutoff" for c in H.SCORES)]
    rounded = lambda df: sorted(str(tuple(round(v, 7) + 0.0 if isinstance(v, float) else v for v in r)) for r in df.select(*cell, *names).collect())
    assert rounded(mine) == rounded(wanted)
