"""Tracking, stops, light response, speed rates, field pairs and populations against loops over the rows, with nulls, ties and empty groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeframe.functions import distributions, scalar
from spikeframe.operators import bars as Q
from spikeframe.operators import behaviour as B
from spikeframe.operators import curation as K
from spikeframe.operators import field_frames as E
from spikeframe.operators import joins as J
from spikeframe.operators import responses as R
from spikeframe.operators import sessions as T
from spikeframe.operators import similarity as Y
from spikeframe.operators import statistics as S
from spikeframe.sources import recordings


def test_beads(spark):
    rows = [("a", 0, None, None, 1.0, 1.0), ("a", 1, 0.0, 0.0, 2.0, 0.0), ("a", 2, None, None, None, None), ("a", 3, 4.0, 0.0, 4.0, 6.0), ("a", 4, 1.0, 1.0, None, None), ("b", 0, None, None, None, None)]
    df = spark.createDataFrame(rows, "k string, idx long, x_left double, y_left double, x_right double, y_right double")
    got = [(r.k, r.idx, r.x, r.y, r.hd) for r in B.bead_tracking(df, ["k"], ["idx"]).orderBy("k", "idx").collect()]
    assert got == [("a", 0, None, None, None), ("a", 1, 1.0, 0.0, 0.0), ("a", 2, 2.5, 1.5, 45.0), ("a", 3, 4.0, 3.0, 90.0), ("a", 4, 4.0, 3.0, 90.0), ("b", 0, None, None, None)]


@pytest.mark.parametrize("gap", [0.37, 1.0, 6.9])
def test_sync_at_the_rate_of_frames(spark, gap):
    n, m = 400, 40
    e = spark.createDataFrame([("a", i, i * 1.0) for i in range(n)] + [("b", 0, 1.0)], "k string, i long, t double")
    v = spark.createDataFrame([("a", j * gap) for j in range(m)] + [("b", 1.0)], "k string, f double")
    ratio = (m - 1) * gap / (m - 1) / ((n - 1) / (n - 1))
    got = [(r.frame, r.i) for r in T.resampled_sync(e, v, ["k"], "i", "t", "f").orderBy("frame").collect()]
    assert got == [(k, int(k * ratio)) for k in range(int(n / ratio))]


def test_goals_and_stops(spark):
    df = spark.createDataFrame([(1, i, float(i), g) for i, g in enumerate([0, 1, 1, None, 1, 0])] + [(2, 0, 5.0, 0)], "trial int, i int, x double, g int")
    got = T.goal_offset(df, ["trial"], ["i"], "x", F.col("g") == 1).orderBy("trial", "i").collect()
    assert [(r.goal, r.offset, r.edge) for r in got] == [(2.5, -2.5, 0), (2.5, -1.5, 1), (2.5, -0.5, 0), (2.5, 0.5, 1), (2.5, 1.5, 1), (2.5, 2.5, 1), (0.0, 5.0, 0)]
    stops = spark.createDataFrame([("a", t) for t in (5, 9, 9, 14, 30, None)] + [("b", 3)], "k string, t int")
    kept = T.spaced_stops(stops, ["k"], "t", 5)
    assert sorted((r.k, r.t) for r in kept.collect()) == [("a", 5), ("a", 30), ("b", 3)]
    starts = spark.createDataFrame([("a", 5), ("a", 6), ("a", 31), ("c", 0)], "k string, t int")
    assert sorted((r.k, r.t, r.stop) for r in T.first_stops(starts, kept, ["k"], "t").collect()) == [("a", 5, 5), ("a", 6, 30)]
    assert T.first_stops(starts, stops.where("false"), ["k"], "t").count() == 0


def squared(points):
    """The plain loop over the positions of one session."""
    while points:
        ends = [(round(min(p[k] for p in points)), round(max(p[k] for p in points))) for k in (0, 1)]
        wide = [b - a for a, b in ends]
        if wide[0] == wide[1]:
            return points
        k = 0 if wide[0] > wide[1] else 1
        low, high = [p for p in points if p[k] < ends[k][0] + 1], [p for p in points if p[k] > ends[k][1] - 1]
        gone = low if (len(low) <= len(high) if k == 0 else len(high) > len(low)) else high
        points = [p for p in points if p not in gone]
    return points


def test_arena_is_squared_as_by_the_loop(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for k in range(12):
        size = rng.integers(1, 60)
        pts = [(float(x), float(y)) for x, y in zip(np.round(rng.normal(0, rng.integers(1, 9), size) * 4) / 4, np.round(rng.normal(5, rng.integers(1, 9), size) * 4) / 4, strict=True)]
        rows += [(k, *p) for p in pts]
        want += [(k, *p) for p in squared(pts)]
    df = spark.createDataFrame([*rows, (99, None, 1.0)], "k int, x double, y double")
    assert sorted(tuple(r) for r in K.square_arena(df, ["k"], "x", "y").select("k", "x", "y").collect()) == sorted(want)
    assert K.square_arena(df.where("false"), ["k"], "x", "y").count() == 0


def test_speed_and_light_rates(spark):
    rng = np.random.default_rng(4)
    speed = np.append(rng.gamma(2, 4, 3000), [0.0, 41.0])
    fired = rng.choice(speed, 500)
    samples = spark.createDataFrame([("s", float(v)) for v in speed] + [("s", None), ("s", float("nan")), ("flat", 2.0)], "k string, speed double")
    spikes = spark.createDataFrame([("s", 1, float(v)) for v in fired] + [("s", 2, None), ("flat", 1, 2.0)], "k string, c int, speed double")
    top = math.ceil(speed.max())
    o, n = (np.histogram(v, bins=top, range=(0, top))[0] for v in (speed, fired))
    got = {(r.c, r.bin): (r.n, r.rate) for r in Y.speed_rates(spikes, samples, ["k"], ["k", "c"], "speed").collect()}
    kept = [b for b in range(top) if o[b] > 0.005 * len(speed)]
    assert {b for c, b in got if c == 1} == {b for c, b in got if c == 2} == set(kept) and all(got[2, b][0] == 0 for b in kept)
    assert all(got[1, b] == pytest.approx((n[b], n[b] / o[b] * 30)) for b in kept)
    pulses = spark.createDataFrame([("s", 10_000 * i) for i in range(1, 6)], "k string, pulse long")
    t = spark.createDataFrame([("s", 1, 10_000 - 600), ("s", 1, 20_000), ("s", 1, 30_599), ("s", 1, 40_600), ("s", 2, 12_000)], "k string, c int, t long")
    rates = R.peristimulus_rates(R.around_pulses(t, pulses, ["k"], 3000), pulses, ["k"], ["k", "c"], 600).collect()
    assert len(rates) == 200 and {(r.c, r.bin): r.hz for r in rates if r.n} == pytest.approx({(1, b): 1 / (12 / 30000) / 5 for b in (0, 50, 99)})


def test_spread_of_modes_and_bars(spark):
    m = spark.createDataFrame([("a", 0, 170.0), ("a", 0, -170.0), ("a", 1, 180.0), ("b", 0, 1.0), ("b", 0, 9.0), ("c", 0, 0.0), ("c", 1, 180.0), ("d", 0, None)], "k string, f int, angle double")
    got = {r.k: (r["items"], r.sd) for r in S.modes_spread(m, ["k"], "f", "angle").collect()}
    length = (1 + 2 * math.cos(math.radians(10))) / 3
    assert got["a"] == (2, pytest.approx(math.degrees(math.sqrt(-2 * math.log(length))))) and got["b"] == (1, None) and got["d"] == (0, None) and got["c"][1] > 400
    v = np.random.default_rng(5).random(21)
    r = Q.bar_spread(spark.createDataFrame([("a", 3, float(x)) for x in v], "k string, bar int, rate double"), ["k"], "bar").first()
    low, high = np.percentile(v, [5, 95])
    assert tuple(r)[2:] == pytest.approx((v.mean(), v.std(), low, high, high - v.mean(), v.mean() - low))


def test_correlograms_of_a_tetrode(spark):
    rows = [("s", 1, 1, 0), ("s", 1, 1, 50), ("s", 1, 2, 60), ("s", 2, 3, 60), ("t", 1, 1, 60)]
    got = J.tetrode_correlograms(spark.createDataFrame(rows, "k string, tet int, c int, t long"), ["k"], "tet", "c", "t", 100, 20, 1000.0).collect()
    assert sorted((r.k, r.tet, r.a, r.b, r.lag_bin, r.n, round(r.rate, 6)) for r in got) == [("s", 1, 1, 1, -3, 1, 25.0), ("s", 1, 1, 1, 2, 1, 25.0), ("s", 1, 1, 2, 0, 1, 25.0), ("s", 1, 1, 2, 3, 1, 25.0), ("s", 1, 2, 1, -3, 1, 50.0), ("s", 1, 2, 1, -1, 1, 50.0)]


def test_pairs_of_fields(spark):
    rng = np.random.default_rng(6)
    hist = {f: rng.random(12) for f in range(6)}
    hist[5] = np.full(12, 0.5)
    spots = {f: [(int(x), int(y)) for x, y in rng.integers(0, 20, (5 + f, 2))] for f in hist}
    rates = spark.createDataFrame([("a", f, b, float(v)) for f, h in hist.items() for b, v in enumerate(h)], "k string, field_id int, bin int, ratio double")
    bins = spark.createDataFrame([("a", f, *s) for f, p in spots.items() for s in p], "k string, field_id int, bin_x int, bin_y int")
    pairs = E.field_pairs(rates, bins, ["k"], "field_id", 12)
    got = {(r.a, r.b): r for r in pairs.collect()}
    assert set(got) == {(a, b) for a in range(6) for b in range(a + 1, 6)} and got[0, 5].r is None and got[0, 5].turn is None
    mid = {f: [int(np.median(np.unique([s[k] for s in p]))) for k in (0, 1)] for f, p in spots.items()}
    x, y, turns = [], [], []
    for (a, b), r in got.items():
        assert r.distance == pytest.approx(math.dist(mid[a], mid[b]))
        if b < 5:
            c = [np.corrcoef(hist[a], np.roll(hist[b], k))[0, 1] for k in range(12)]
            assert r.turn == int(np.argmax(c)) and r.r == pytest.approx(c[0])
            x, y, turns = [*x, r.distance], [*y, r.r], [*turns, r.turn]
    t = E.pair_trends(pairs, ["k"], 12).first()
    a = np.radians(np.array(turns) * 30)
    rc, rs, cs = np.corrcoef(np.cos(a), x)[0, 1], np.corrcoef(np.sin(a), x)[0, 1], np.corrcoef(np.cos(a), np.sin(a))[0, 1]
    rho = math.sqrt((rc * rc + rs * rs - 2 * rc * rs * cs) / (1 - cs * cs))
    want = np.corrcoef(x, y)[0, 1]
    assert (t.n, t.r, t.rho, t.rho_p) == (10, pytest.approx(want), pytest.approx(rho), pytest.approx(math.exp(-10 * rho * rho / 2)))
    assert t.p == pytest.approx(distributions.student(want * math.sqrt(8 / (1 - want * want)), 8.0))


def test_populations(spark):
    f = spark.createDataFrame([(1, 0, 500, True, True), (1, 1, 500, True, False), (1, 2, 400, True, False), (1, 3, 900, None, False), (2, 0, 900, True, False), (3, 0, None, True, None)], "c int, f int, n_spikes int, accepted boolean, border boolean")
    types = K.cell_types(spark.createDataFrame([(1, 0.1, 0.4), (2, 0.5, 0.4), (3, None, 0.9)], "c int, hd_score double, grid_score double"))
    pick = lambda **more: sorted((r.c, r.f) for r in K.population_fields(f, types, ["c"], **more).collect())
    assert pick() == [(1, 0), (1, 1)] and pick(border=False) == [(1, 1)] and pick(wanted=("conjunctive",)) == [(2, 0)]


def test_names_and_curated_cells(spark):
    names = ["M5_2018-03-06_15-34-44_of", "M5_2018-03-06_15-34-44", "M5_2018-02-30_15-34-44_of", "M5_2018-03-06_15-34-44of", "x", None]
    got = spark.createDataFrame([(n,) for n in names], "name string").select(*(c.cast("string").alias(k) for k, c in scalar.session_parts("name").items())).collect()
    assert [tuple(r) for r in got] == [("M5", "2018-03-06", "2018-03-06 15:34:44")] * 2 + [(None, None, None)] * 4
    cells = spark.createDataFrame([("a", 1, [3])], "s string, c int, firing_times array<int>")
    hand = spark.createDataFrame([("x", [7], "b", 2), ("x", [8], "a", 9)], "more string, firing_times array<int>, s string, c int")
    assert sorted(tuple(r) for r in recordings.with_curated(cells, hand, ["s"]).collect()) == [("a", 1, [3]), ("b", 2, [7])]
