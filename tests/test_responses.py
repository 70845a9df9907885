"""Synchronisation, the latency test, inhibition, bar tests, smoothing, speed scores and coherence, against loops over the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeframe.operators import bars as Q
from spikeframe.operators import behaviour as B
from spikeframe.operators import maps as M
from spikeframe.operators import responses as R
from spikeframe.operators import joins as J
from spikeframe.operators import significance as G
from spikeframe.operators import similarity as Y
from spikeframe.operators import waveforms as V


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_the_lag_is_found_wherever_it_is(spark, block):
    rng = np.random.default_rng(1)
    a, b = [], []
    for k, lag in enumerate((-900, 0, 61, 2500)):
        on = np.sort(rng.choice(np.arange(1000, 9000), 40, replace=False))
        a += [(k, int(i)) for i in on]
        b += [(k, int(i + lag)) for i in on if rng.random() < 0.9] + [(k, int(i)) for i in rng.integers(0, 10000, 15)]
    got = R.correlation_lag(spark.createDataFrame(a, "k int, i long"), spark.createDataFrame(b, "k int, i long"), ["k"], "i", block).orderBy("k").collect()
    assert [r.lag for r in got] == [-900, 0, 61, 2500] and all(r.n >= 30 for r in got)


def test_streams_meet_within_a_frame(spark):
    rng = np.random.default_rng(2)
    rows_a, rows_b = [], []
    for k, late in enumerate((7.30, -3.52)):
        starts = np.cumsum(rng.uniform(20, 60, 12)) + 25
        on = lambda t: bool(((t >= starts) & (t < starts + 0.5)).any())  # noqa: B023, E731
        rows_a += [(k, i, i / 30, 5.0 if on(i / 30) else 0.1) for i in range(12000)]
        rows_b += [(k, i, i / 30, 100.0 + float(rng.random()) if on(i / 30 - late) else float(rng.random())) for i in range(12000)]
    schema = "k int, i long, t double, level double"
    out = R.synchronised(spark.createDataFrame(rows_a, schema), spark.createDataFrame(rows_b, schema), ["k"], "i", "t", "level")
    got = {r.k: r for r in out.groupBy("k").agg(F.max(F.abs(F.col("t") - F.col("synced_time"))).alias("low"), F.avg(F.col("t") - F.col("synced_time")).alias("shift"), F.min("synced_time").alias("first"), F.bool_and("ok").alias("ok")).collect()}
    assert all(got[k].ok and abs(got[k].shift - late) < 0.05 and got[k].first >= 0 for k, late in ((0, 7.30), (1, -3.52)))
    silent = R.synchronised(spark.createDataFrame(rows_a, schema).withColumn("level", F.lit(0.0)), spark.createDataFrame(rows_b, schema), ["k"], "i", "t", "level")
    assert silent.where("ok or synced_time is not null").count() == 0 and silent.count() == 24000


def salt(base, test, steps):
    """Distances by the plain definition; base and test: latencies of each window, None without a spike."""

    def hist(window):
        h = np.zeros(steps + 1)
        for x in window:
            h[0 if x is None else 1 + int(x * steps // 1)] += 1
        return h / h.sum()

    def kl(p, q):
        use = p * q > 0
        p, q = p[use] / p[use].sum(), q[use] / q[use].sum()
        return (p * np.log(p / q)).sum()

    d = lambda p, q: round(float(np.sqrt(max(0.0, kl(p, (p + q) / 2) + kl(q, (p + q) / 2)))), 9)
    h, t = [hist(w) for w in base], hist(test)
    null = [d(h[i], h[j]) for i in range(len(h)) for j in range(i + 1, len(h))]
    mine = float(np.median([d(x, t) for x in h]))
    return mine, mine - float(np.median(null)), float(np.mean(np.array(null) >= mine))


def test_latency_test_equals_the_definition(spark):
    rng = np.random.default_rng(3)
    size, windows, spikes, want = 200, 6, [], {}
    pulses = [2000 * (i + 1) for i in range(30)]
    for cell in range(3):
        latency = [[None] * len(pulses) for _ in range(windows + 1)]
        for j, p in enumerate(pulses):
            for w in range(windows + 1):
                for x in rng.integers(1, size, rng.poisson(0.8 + (cell == 1 and w == windows))).tolist():
                    x = 20 + x % 9 if cell == 1 and w == windows else x
                    spikes.append((0, cell, p + (w - windows) * size + x))
                    latency[w][j] = x / size if latency[w][j] is None else min(latency[w][j], x / size)
        want[cell] = salt(latency[:-1], latency[-1], 20)
    s = spark.createDataFrame(spikes, "session_id int, cluster_id int, t long")
    p = spark.createDataFrame([(0, x) for x in pulses], "session_id int, pulse long")
    got = {r.cluster_id: r for r in R.latency_test(s, p, ["session_id"], ["session_id", "cluster_id"], size, windows).collect()}
    for c, (distance, information, share) in want.items():
        assert abs(got[c].distance - distance) < 1e-8 and abs(got[c].information - information) < 1e-8 and abs(got[c].p - share) < 1e-9
    assert got[1].p < 0.07


def test_inhibition_equals_counts_by_pulse(spark):
    rng = np.random.default_rng(4)
    pulses = [10_000 * (i + 1) for i in range(40)]
    spikes, rate = [], {0: (0.02, 0.01), 1: (0.01, 0.02), 2: (0.02, 0.002)}
    for cell, (low, after) in rate.items():
        for p in pulses:
            for ms in range(-100, 100):
                chance = (after if ms >= 0 else low) * 5
                if cell == 2 and 3 <= ms < 8:  # an answer, and then silence
                    chance = 0.9
                if rng.random() < chance:
                    spikes.append((0, cell, p + ms * 30 + int(rng.integers(30))))
    s = spark.createDataFrame(spikes, "session_id int, cluster_id int, t long")
    p = spark.createDataFrame([(0, x) for x in pulses], "session_id int, pulse long")
    latency = spark.createDataFrame([(0, 0, 0.5), (0, 1, None), (0, 2, 0.001)], "session_id int, cluster_id int, p double")
    keys = ["session_id", "cluster_id"]
    around = R.around_pulses(s, p, ["session_id"], 3000)
    runs = {r.cluster_id: (r.start, r.end) for r in R.activation(around, keys, 100, 30).collect()}
    assert runs[2] == (3, 8)
    got = {r.cluster_id: r for r in R.inhibition(s, p, ["session_id"], keys, latency).collect()}
    for cell in rate:
        shift = 8 if cell == 2 else 0
        before = [sum(c == cell and -600 <= t - x < 0 for _, c, t in spikes) for x in pulses]
        after = [sum(c == cell and shift * 30 <= t - x < shift * 30 + 600 for _, c, t in spikes) for x in pulses]
        r = got[cell]
        assert (r.before, r.after, r.shift) == (sum(before), sum(after), shift)
        if sum(after) < sum(before):
            u = sum((x > y) + 0.5 * (x == y) for x in before for y in after)
            values, ties = np.unique(before + after, return_counts=True)
            n = len(pulses)
            z = max(0, abs(u - n * n / 2) - 0.5) / np.sqrt(n * n / 12 * (2 * n + 1 - (ties**3 - ties).sum() / (2 * n * (2 * n - 1))))
            assert r.u == u and abs(r.z - z) < 1e-9 and 0 <= r.p <= 1
        else:
            assert r.u is None and r.p is None
    assert got[2].p < 0.001


def test_bars_of_shuffles_are_ranked_among_the_others(spark):
    rng = np.random.default_rng(5)
    rows = [(0, s, b, int(rng.integers(0, 6)) / 2) for s in range(25) for b in range(4)]
    own = [(0, b, v) for b, v in enumerate((9.0, -1.0, 1.0, 1.5))]
    shuffled = spark.createDataFrame(rows, "c int, shuffle_id int, bar int, rate double")
    two = lambda v, o: min(1.0, 2 * min(f := (sum(x < v for x in o) + sum(x <= v for x in o)) / (2 * len(o)), 1 - f))
    got = {(r.shuffle_id, r.bar): r.p for r in Q.shuffled_p(shuffled, ["c"], "bar", "rate").collect()}
    for _, s, b, v in rows:
        assert abs(got[s, b] - two(v, [x for _, t, c, x in rows if c == b and t != s])) < 1e-12
    seen = {r.bar: (r.p, r.outside) for r in Q.observed_p(spark.createDataFrame(own, "c int, bar int, rate double"), shuffled, ["c"], "bar", "rate").collect()}
    assert all(abs(seen[b][0] - two(v, [x for _, _, c, x in rows if c == b])) < 1e-12 for _, b, v in own) and seen[0][1] and seen[1][1] and not seen[2][1]
    assert Q.shuffled_p(shuffled.where("shuffle_id = 0"), ["c"], "bar", "rate").where("p is not null").count() == 0


@pytest.mark.parametrize(("edges", "chunk", "n"), [("reflect", 7, 60), ("reflect", 1000, 5), ("zero", 9, 60), ("zero", 1000, 3)])
def test_smoothing_equals_a_loop(spark, edges, chunk, n):
    rng = np.random.default_rng(n)
    w = B.kernel_weights(1.7)
    reach = len(w) // 2
    v = [None if rng.random() < 0.2 else float(x) for x in rng.normal(0, 3, n)]
    want = []
    for i in range(n):
        top = bottom = 0.0
        for d in range(-reach, reach + 1):
            j = i + d
            if edges == "reflect":
                j %= 2 * n
                j = j if j < n else 2 * n - 1 - j
            value = v[j] if 0 <= j < n else 0.0
            if value is not None:
                top, bottom = top + w[d + reach] * value, bottom + w[d + reach]
        want.append(top / bottom if bottom else None)
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "k int, i long, v double").repartition(3)
    got = {r.i: r.smooth for r in B.smoothed(df, ["k"], "i", "v", 1.7, edges, chunk=chunk).collect()}
    assert len(got) == n and all(abs(got[i] - want[i]) < 1e-9 for i in range(n))


def test_speed_score_equals_the_correlation_of_both_smoothed_series(spark):
    rng = np.random.default_rng(6)
    n, w = 400, B.kernel_weights(2.5)
    speed = np.abs(np.cumsum(rng.normal(0, 1, n)))
    chance = 0.05 + 0.3 * speed / speed.max()
    t = [int((i + rng.random()) * 1000) for i in range(n) for _ in range(rng.poisson(chance[i]))]
    pos = spark.createDataFrame([(0, i, (i + 1) / 30, float(s)) for i, s in enumerate(speed)], "session_id int, pos_idx long, synced_time double, speed double")
    s = spark.createDataFrame([(0, 1, x) for x in t], "session_id int, cluster_id int, t_sample long")
    r = Y.smoothed_speed_score(s, pos, ["session_id"], ["session_id", "cluster_id"], "pos_idx", "synced_time", "speed", 2.5).first()
    hist = np.histogram(t, bins=n, range=(0, n * 1000))[0].astype(float)
    smooth = lambda x: np.convolve(np.pad(x, len(w) // 2, "symmetric"), w, "valid")
    assert abs(r.speed_score - np.corrcoef(smooth(speed), smooth(hist))[0, 1]) < 1e-9 and r.speed_score > 0.3 and r.p < 1e-6


def test_coherence_equals_a_loop(spark):
    rng = np.random.default_rng(7)
    occ, rate = rng.integers(1, 9, (6, 5)).astype(float), rng.random((6, 5))
    occ[2, 3] = np.nan
    bins = [(x, y) for x in range(6) for y in range(5)]
    mean = {}
    for x, y in bins:
        near = [(i, j) for i, j in bins if max(abs(i - x), abs(j - y)) == 1 and not np.isnan(occ[i, j])]
        mean[x, y] = sum(rate[b] * occ[b] for b in near) / sum(occ[b] for b in near)
    use = [b for b in bins if not np.isnan(occ[b])]
    want = np.corrcoef([rate[b] for b in use], [mean[b] for b in use])[0, 1]
    rates = spark.createDataFrame([(0, 1, x, y, float(rate[x, y])) for x, y in bins], "s int, c int, bin_x long, bin_y long, rate double")
    seen = spark.createDataFrame([(0, x, y, None if np.isnan(occ[x, y]) else int(occ[x, y])) for x, y in bins], "s int, bin_x long, bin_y long, occupancy long")
    r = M.coherence(rates, seen, ["s", "c"], ["s"]).first()
    assert abs(r.r - want) < 1e-9 and abs(r.z - np.arctanh(want) * np.sqrt(len(use) - 3)) < 1e-9


def test_planted_clusters_are_found_again_in_any_order(spark):
    rng = np.random.default_rng(8)
    shape = rng.normal(0, 1, (4, 20))
    rows, same = [], {}
    for day in (1, 2):
        names = rng.permutation(4).tolist()
        for unit, name in enumerate(names):
            same[day, unit] = name
            rows += [(7, day, name, i, (shape[unit] + rng.normal(0, 0.1, 20)).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "tet int, day int, c int, i int, w array<double>")
    pair = lambda a, b: {(r.cluster_a, r.cluster_b) for r in V.matched_clusters(df, spark.createDataFrame([(a, b)], "a int, b int"), ["tet"], "day", "c", "i", "w", 3).collect()}
    assert pair(1, 2) == {(same[1, u], same[2, u]) for u in range(4)} == {(b, a) for a, b in pair(2, 1)}


def test_shares_of_exposure_are_piecewise_linear(spark):
    pieces = spark.createDataFrame([(1, 0.0, 0.25, 0.0), (1, 0.25, 0.5, 3.0), (1, 0.5, 1.0, 0.5)], "k int, start double, stop double, weight double")
    values = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.25), (1, 2, 3.375), (1, 3, -0.5), (1, 4, 0.75), (1, 5, None), (2, 6, 0.3)], "k int, i int, x double")
    got = {r.i: r.share for r in G.exposure_share(values, pieces, ["k"], "x").collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.375, 3: 0.75, 4: 0.875, 5: None, 6: None}


def test_stitched_times_go_back_across_buckets(spark):
    stitches = spark.createDataFrame([("a", 0, 100), ("b", 100, 5000), ("c", 5000, 5001)], "recording string, lo long, hi long")
    spikes = spark.createDataFrame([(0,), (1,), (100,), (101,), (4999,), (5000,), (5001,), (6000,)], "t long")
    got = sorted((r.recording, r.t_local) for r in J.split_stitched(spikes, stitches, 64).collect())
    assert got == [("a", 1), ("a", 100), ("b", 1), ("b", 4899), ("b", 4900), ("c", 1)]
