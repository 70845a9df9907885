"""Operators without SQL against signals and maps whose answer is known, or against brute force."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spikeframe.functions import scalar
from spikeframe.operators import borders as O
from spikeframe.operators import field_frames as E
from spikeframe.operators import maps as M
from spikeframe.operators import responses as R
from spikeframe.operators import shuffles as H
from spikeframe.operators import spectra as Z
from spikeframe.operators import trials as L
from spikeframe.operators import waveforms as V
from spikeframe.streaming import rates


def frame(spark, schema, **columns):
    return spark.createDataFrame(pd.DataFrame(columns), schema)


def test_kernel_map_equals_a_loop(spark):
    rng = np.random.default_rng(1)
    x, y, cell = rng.uniform(0, 100, 400), rng.uniform(0, 60, 400), rng.integers(0, 2, 400)
    position = frame(spark, "s int, x_px double, y_px double", s=np.zeros(400, int), x_px=x, y_px=y)
    spikes = frame(spark, "s int, c int, x_px double, y_px double", s=np.zeros(150, int), c=cell[:150], x_px=x[:150], y_px=y[:150])
    got = {(r.c, r.bin_x, r.bin_y): r.rate for r in M.rate_map(spikes, position, ["s", "c"], ["s"], 10.0, 20.0, 0.5, 3).collect()}
    k = lambda px, py, bx, by: np.exp(-((px - (bx + 0.5) * 10) ** 2 + (py - (by + 0.5) * 10) ** 2) / 800).sum()
    for c in (0, 1):
        for bx in range(10):
            for by in range(6):
                near = (np.hypot(x - (bx + 0.5) * 10, y - (by + 0.5) * 10) <= 20).sum()
                own = cell[:150] == c
                want = k(x[:150][own], y[:150][own], bx, by) / (k(x, y, bx, by) * 0.5) if near >= 3 else 0.0
                assert abs(got[c, bx, by] - want) < 1e-9


def test_autocorrelogram_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    rate = np.where(rng.random((7, 6)) < 0.8, 1e6 + rng.random((7, 6)), 0)
    rows = [(1, x, y, float(rate[x, y])) for x in range(7) for y in range(6)]
    got = {(r.dx, r.dy): (r.n, r.r) for r in M.autocorrelogram(spark.createDataFrame(rows, "k int, bin_x int, bin_y int, rate double"), ["k"], 5).collect()}
    for dx in range(-6, 7):
        for dy in range(-5, 6):
            pairs = [(rate[x, y], rate[x - dx, y - dy]) for x in range(7) for y in range(6) if 0 <= x - dx < 7 and 0 <= y - dy < 6 and rate[x, y] and rate[x - dx, y - dy]]
            assert got.get((dx, dy), (0, None))[0] == len(pairs)
            if len(pairs) > 5:
                assert abs(got[dx, dy][1] - np.corrcoef(np.array(pairs).T)[0, 1]) < 1e-4


def test_correlation_of_small_rates_and_large_offsets(spark):
    a = np.arange(20) * 1e-7
    df = frame(spark, "k int, a double, b double, c double", k=np.zeros(20, int), a=a, b=1e9 + a * 1e6, c=np.full(20, 0.1))
    r = df.groupBy("k").agg(scalar.safe_corr("a", "b").alias("r"), scalar.safe_corr("a", "c").alias("flat")).first()
    assert abs(r.r - 1) < 1e-6 and r.flat is None


def test_spectrum_of_a_sine(spark):
    t = np.arange(4000)
    df = frame(spark, "k int, t long, v double", k=np.zeros(4000, int), t=t, v=3 * np.sin(2 * np.pi * 8 * t / 200) + 5)
    w = Z.welch(df, ["k"], "t", "v", 200.0, 400, 4000, 50.0)
    top = w.orderBy(F.desc("power")).first()
    assert top.freq == 8.0 and abs(w.agg(F.sum("power") * 0.5).first()[0] - 4.5) < 0.01
    hz = {r.hz: r.power for r in Z.interpolated_spectrum(w, ["k"], 10).collect()}
    assert len(hz) == 11 and hz[8] == top.power
    bands = Z.epoch_bands(df, ["k"], "t", "v", 200.0, 400, {"theta": (4, 12), "gamma": (30, 60)}).collect()
    assert len(bands) == 10 and all(r.theta > 100 * r.gamma for r in bands)


def test_a_signal_shorter_than_a_segment_gives_nothing(spark):
    df = frame(spark, "k int, t long, v double", k=[1, 1], t=[0, 1], v=[1.0, 2.0])
    assert Z.welch(df, ["k"], "t", "v", 200.0, 400, 2).count() == 0
    assert Z.epoch_bands(df, ["k"], "t", "v", 200.0, 400).count() == 0


def theta_spikes(rng, modulated):
    ms = np.arange(60_000)
    p = 0.02 * (1 + (np.sin(2 * np.pi * 8 * ms / 1000) if modulated else 0))
    return ms[rng.random(60_000) < p]


def test_theta_scores_tell_modulated_cells(spark):
    rng = np.random.default_rng(3)
    a, b = theta_spikes(rng, True), theta_spikes(rng, False)
    s = frame(spark, "c int, ms long", c=np.repeat([0, 1], [len(a), len(b)]), ms=np.concatenate([a, b]))
    index = {r.c: r.theta_index for r in Z.theta_index(s, ["c"], "ms", 60_000).collect()}
    assert index[0] > index[1] + 0.2 and abs(index[1]) < 0.25
    lag = lambda v: [(int(d), int(n)) for d, n in zip(*np.unique((v[:, None] - v)[np.abs(v[:, None] - v) <= 500], return_counts=True), strict=True)]
    c = spark.createDataFrame([(k, d, n) for k, v in ((0, a), (1, b)) for d, n in lag(v)], "c int, lag long, n long")
    got = {r.c: (r.peak_freq, r.modulated) for r in Z.correlogram_theta(c, ["c"], "lag", "n", 500).collect()}
    assert abs(got[0][0] - 8) < 1.1 and got[0][1]


def test_theta_phase_follows_the_signal_over_chunks(spark):
    rate, n = 100.0, 3000
    t = np.arange(n)
    df = frame(spark, "k int, t long, v double", k=np.zeros(n, int), t=t, v=np.cos(2 * np.pi * 7 * t / rate))
    one = Z.theta_phase(df, ["k"], "t", "v", rate, chunk=30.0).orderBy("t").toPandas()
    many = Z.theta_phase(df, ["k"], "t", "v", rate, chunk=5.0).orderBy("t").toPandas()
    assert many.t.tolist() == t.tolist()
    apart = np.angle(np.exp(1j * (one.phase - many.phase)))[600:-600]
    step = np.diff(np.unwrap(many.phase.to_numpy()[600:-600]))
    assert np.abs(apart).max() < 0.01 and np.abs(step - 2 * np.pi * 7 / rate).max() < 0.02


def test_border_corner_and_cue_scores(spark):
    wall = [(0, 0, 0, y, 2.0, 10, 10) for y in range(10)]
    middle = [(1, 0, x, y, 1.0, 10, 10) for x in (4, 5) for y in (4, 5)]
    corner = [(2, 0, x, 0, 1.0, 10, 10) for x in range(2)] + [(2, 0, 0, 1, 1.0, 10, 10)]
    df = spark.createDataFrame(wall + middle + corner, "c int, field_id int, bin_x long, bin_y long, rate double, nx long, ny long")
    border = {r.c: r.border_score for r in O.border_score(df, ["c"]).collect()}
    assert abs(border[0] - (1 - 0.5 / 4.5) / (1 + 0.5 / 4.5)) < 1e-9 and border[1] == -1.0
    corners = {r.c: r.corner_score for r in O.corner_score(df, ["c"]).collect()}
    assert corners[2] > 0.5 > corners[0] > corners[1]
    cue = {r.c: r.cue_score for r in O.cue_score(df, ["c"], 0.4).collect()}
    assert cue[0] > 0 > cue[1]


def test_grid_shape(spark):
    turn = math.radians(10)
    peaks = [(1, 0, 0.0, 0.0, 0.0)] + [(1, i + 1, 10 * math.cos(turn + i * math.pi / 3), 6 * math.sin(turn + i * math.pi / 3), 0.0) for i in range(6)] + [(1, 7, 30.0, 0.0, 0.0)]
    df = spark.createDataFrame(peaks, "k int, label long, cx double, cy double, distance double").withColumn("distance", F.hypot("cx", "cy"))
    r = O.grid_shape(df, ["k"]).first()
    assert abs(r.ellipticity - 0.8) < 1e-6 and abs(r.orientation - math.degrees(math.atan2(6 * math.sin(turn), 10 * math.cos(turn)))) < 1e-9


def test_waveform_shape_and_snippets(spark):
    wave = [0.0, 1.0, 4.0, 10.0, 4.0, 1.0, -3.0, -1.0, 0.0]
    df = spark.createDataFrame([(1, i, -v) for i, v in enumerate(wave)], "c int, pos int, v double")
    r = V.shape(df, ["c"], "pos", "v").first()
    assert (r.peak_pos, r.trough_pos, r.peak_to_trough, r.half_width) == (3, 6, 3, 1)
    samples = spark.createDataFrame([("a", c, t, float(100 * c + t)) for c in (1, 2, 4) for t in range(40)], "s string, channel int, t long, value double")
    spikes = spark.createDataFrame([("a", 5, 0, 1, 20), ("a", 5, 1, 1, 35)], "s string, cluster_id int, spike_idx long, tetrode int, t long")
    got = {(x.spike_idx, x.channel): x.waveform for x in V.snippets(spikes, samples, ["s"]).collect()}
    assert len(got) == 8 and got[0, 1] == [110.0 + i for i in range(30)] and got[0, 3] == [0.0] * 30 and got[1, 2] == [225.0 + i for i in range(15)] + [0.0] * 15
    many = spark.createDataFrame([(1, i) for i in range(200)] + [(2, i) for i in range(20)], "cluster_id int, spike_idx long")
    some = V.chosen_spikes(many, ["cluster_id"], ["spike_idx"]).collect()
    assert sum(x.cluster_id == 2 for x in some) == 20 and len({x.spike_idx for x in some if x.cluster_id == 1 and 16 <= x.spike_idx < 184}) == 50 == len(some) - 20


def test_components_equal_an_eigenvalue_problem(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) + 3
    x[:, 4] = 7.0
    df = spark.createDataFrame([(1, i, row.tolist()) for i, row in enumerate(x)], "c int, i int, w array<double>")
    got = np.array([r.pc for r in V.principal_components(df, ["c"], "i", "w").orderBy("i").collect()])
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    _, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
    top = vectors[:, ::-1][:, :2]
    top = top * np.sign(top[np.abs(top).argmax(0), [0, 1]])
    assert np.allclose(got, z @ top, atol=1e-8)


def test_directional_modes(spark):
    rng = np.random.default_rng(5)
    two = np.concatenate([rng.vonmises(0.5, 8, 3000), rng.vonmises(-2.0, 8, 1500)])
    one = rng.vonmises(1.0, 4, 3000)
    rows = [(k, int(b), int(n)) for k, v in ((2, two), (1, one)) for b, n in zip(*np.unique(np.floor(np.degrees(v)) + 180, return_counts=True), strict=True)]
    got = E.directional_modes(spark.createDataFrame(rows, "k int, bin int, n int"), ["k"], "n").orderBy("k", "mode").collect()
    assert [r.modes for r in got] == [1, 2, 2]
    assert abs(got[0].angle - math.degrees(1)) < 2 and abs(got[1].angle - math.degrees(0.5)) < 2 and abs(got[2].angle - math.degrees(-2)) < 3 and abs(got[1].share - 2 / 3) < 0.03


def test_draws_are_spread_and_follow_weights(spark):
    cells = spark.createDataFrame([(1, 4000)], "c int, n long")
    samples = spark.createDataFrame([(1, i, float(i % 4)) for i in range(40)], "c int, i int, w double")
    uniform = H.drawn_samples(cells, samples, 2, ["c"], ["c"], "n", "seed").groupBy("shuffle_id", (F.col("i") % 4).alias("k")).count().collect()
    assert len(uniform) == 8 and all(abs(r["count"] - 1000) < 150 for r in uniform)
    heavy = H.drawn_samples(cells, samples, 2, ["c"], ["c"], "n", "seed", F.col("w")).groupBy((F.col("i") % 4).alias("k")).count().collect()
    got = {r.k: r["count"] for r in heavy}
    assert 0 not in got and sum(got.values()) == 8000 and all(abs(got[k] - 8000 * k / 6) < 250 for k in (1, 2, 3))


def test_shifts_differ_between_cells_and_copies(spark):
    s = spark.createDataFrame([(c, 0) for c in range(40)], "c int, t long")
    t = [r.t for r in H.time_shifts(s, 25, 5_000_000, 600_000, ["c"]).collect()]
    assert len(set(t)) > 990 and min(t) >= 600_000 and max(t) < 4_400_000
    again = sorted(r.t for r in H.time_shifts(s.repartition(7), 25, 5_000_000, 600_000, ["c"]).collect())
    assert again == sorted(t)


def test_expected_ratio(spark):
    row = lambda *n: spark.createDataFrame([(1, b, v) for b, v in enumerate(n) if v], "k int, bin int, n long")
    assert abs(H.expected_ratio(row(2, 6), row(1, 3), ["k"]).first().ratio) < 1e-12
    assert abs(H.expected_ratio(row(2, 2), row(1, 3), ["k"]).first().ratio - (math.log(0.50001 / 0.25001) + math.log(0.75001 / 0.50001)) / 2) < 1e-9


def test_latency_test_tells_an_answer_from_none(spark):
    rng = np.random.default_rng(6)
    pulses = np.arange(1, 101) * 100_000
    random = np.sort(rng.integers(0, 10_200_000, 12_000))
    answers = np.concatenate([random, pulses + 150 + rng.integers(0, 60, 100)])
    s = frame(spark, "session_id int, cluster_id int, t long", session_id=np.zeros(len(random) + len(answers), int), cluster_id=np.repeat([0, 1], [len(random), len(answers)]), t=np.concatenate([random, answers]))
    p = frame(spark, "session_id int, pulse long", session_id=np.zeros(100, int), pulse=pulses)
    got = {r.cluster_id: r.p for r in R.latency_test(s, p, ["session_id"], ["session_id", "cluster_id"], 3000, 20).collect()}
    assert got[1] < 0.01 < got[0]


def test_pulse_sessions(spark):
    on = spark.sql("SELECT 1 AS k, timestamp_seconds(v) AS ts FROM VALUES (10), (12), (13), (40), (44) AS t(v)")
    got = rates.pulse_sessions(on, ["k"], "10 seconds").orderBy("start").collect()
    assert [(r.start.second, r.end.second, r.n) for r in got] == [(10, 13, 3), (40, 44, 2)]


def test_shifted_arrays_maps_and_matrices(spark):
    df = spark.createDataFrame([([4, 5, 6, 7], [[1, 2], [3, 4]])], "a array<int>, m array<array<int>>")
    got = df.select(*(scalar.shifted(F.col("a"), n, 0).alias(f"s{i}") for i, n in enumerate((0, 1, -1, 3, -9)))).first()
    assert list(got) == [[4, 5, 6, 7], [0, 4, 5, 6], [5, 6, 7, 0], [0, 0, 0, 4], [0, 0, 0, 0]]
    assert [tuple(r.x) for r in df.select(F.explode(scalar.matrix_rows("m")).alias("x")).collect()] == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)]
    bins = spark.createDataFrame([(0, 0), (2, 1)], "bin_x int, bin_y int")
    assert {(r.bin_x, r.bin_y) for r in L.shifted_bins(bins, 1, 1, 4, 3).collect()} == {(3, 0)}
    times = spark.createDataFrame([("s", 1, [3, 1, 2])], "s string, cluster_id int, firing_times array<int>")
    rows = L.labelled_times(times, ["s"], "firing_times", "cluster_id")
    assert rows.count() == 3 and L.time_arrays(rows, ["s"]).first().firing_times == [1, 2, 3]
    r = spark.createDataFrame([(3.0, 4.0)], "x double, y double").select(scalar.to_polar("x", "y")[0].alias("rho"), scalar.to_polar("x", "y")[1].alias("phi"))
    back = r.select(scalar.to_cartesian("rho", "phi")[0].alias("x"), scalar.to_cartesian("rho", "phi")[1].alias("y")).first()
    assert r.first().rho == 5.0 and abs(back.x - 3) < 1e-12 and abs(back.y - 4) < 1e-12
