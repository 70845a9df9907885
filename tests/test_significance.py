"""Tests and probabilities against published tables, identities and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeframe.functions import distributions as D
from spikeframe.operators import significance as S


def test_tails():
    assert abs(D.student(2.228, 10) - 0.05) < 1e-4 and abs(D.student(12.706, 1) - 0.05) < 1e-4 and abs(D.student(1.96, 1e7) - 0.05) < 1e-4
    assert abs(D.fisher(4.96, 1, 10) - 0.05) < 2e-4 and abs(D.fisher(3.33, 5, 10) - 0.05) < 4e-4
    assert abs(D.gauss(1.959964) - 0.05) < 1e-6 and abs(D.kolmogorov(1.3581 / 10, 100) - 0.05) < 1e-3
    assert abs(D.student(1.3, 7) - D.fisher(1.69, 1, 7)) < 1e-12
    assert abs(D.beta_share(3, 2, 0.4) - sum(math.comb(4, k) * 0.4**k * 0.6 ** (4 - k) for k in (3, 4))) < 1e-12


@pytest.mark.parametrize("n", [5, 10, 11, 40, 60])
def test_kuiper_tail_equals_its_share_of_random_samples(n):
    u = np.sort(np.random.default_rng(1).random((40_000, n)), axis=1)
    i = np.arange(1, n + 1)
    v = (i / n - u).max(1) + (u - (i - 1) / n).max(1)
    for d in np.quantile(v, [0.02, 0.1, 0.5, 0.9, 0.99]):
        assert abs(D.kuiper_tail(d, n) - (v >= d).mean()) < 0.015, (n, d)
    assert D.kuiper_tail(0.0, n) == 1.0 and D.kuiper_tail(1.0, n) < 1e-3


def test_two_sample_tests(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(0, 1, 40), 1), np.round(rng.normal(0.8, 2, 30), 1)
    df = spark.createDataFrame([(1, 0, float(x)) for x in a] + [(1, 1, float(x)) for x in b] + [(2, 0, 5.0)], "k int, s int, v double")
    one = lambda f: {r.k: r for r in f(df, ["k"], "s", "v").collect()}
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    r = one(S.rank_sum)
    assert r[1].u == u and 0 < r[1].p < 1 and r[2].p is None
    ks = max(abs((a <= x).mean() - (b <= x).mean()) for x in np.concatenate([a, b]))
    assert abs(one(S.kolmogorov_two)[1].ks - ks) < 1e-12
    d = [(a <= x).mean() - (b <= x).mean() for x in np.concatenate([a, b])]
    assert abs(one(S.kuiper_two)[1].kuiper - (max(0, *d) + max(0, *(-x for x in d)))) < 1e-12
    t = one(S.t_test)[1]
    assert abs(t.t - (a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / 40 + b.var(ddof=1) / 30)) < 1e-12 and 29 < t.df < 68
    za, zb = np.abs(a - np.median(a)), np.abs(b - np.median(b))
    grand = np.concatenate([za, zb]).mean()
    want = 68 * (40 * (za.mean() - grand) ** 2 + 30 * (zb.mean() - grand) ** 2) / (((za - za.mean()) ** 2).sum() + ((zb - zb.mean()) ** 2).sum())
    got = one(S.levene)
    assert abs(got[1].levene - want) < 1e-9 and got[1].p < 0.05 and got[2].levene is None


def test_signed_rank(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], [1.5, 1.0, 5.0, 4.0, 9.0, 2.0, 3.0, 20.0]
    diff = sorted((abs(x - y), x > y) for x, y in zip(a, b, strict=True) if x != y)
    ranks = [np.mean([i + 1 for i, (w, _) in enumerate(diff) if w == v]) for v, _ in diff]
    up = sum(r for r, (_, s) in zip(ranks, diff, strict=True) if s)
    df = spark.createDataFrame([(1, x, y) for x, y in zip(a, b, strict=True)], "k int, a double, b double")
    assert S.signed_rank(df, ["k"], "a", "b").first().w == min(up, sum(ranks) - up)


def test_one_sample_tests(spark):
    u = np.sort(np.random.default_rng(3).random(50) ** 3)
    i = np.arange(1, 51)
    df = spark.createDataFrame([(1, float(x)) for x in u], "k int, v double")
    r = S.kuiper_one(df, ["k"], F.col("v")).first()
    assert abs(r.kuiper - ((i / 50 - u).max() + (u - (i - 1) / 50).max())) < 1e-12 and r.p < 0.01
    assert abs(S.watson_one(df, ["k"], F.col("v")).first().u2 - (((u - (2 * i - 1) / 100) ** 2).sum() + 1 / 600 - 50 * (u.mean() - 0.5) ** 2)) < 1e-12


def test_intervals_fold_to_what_a_fine_grid_counts(spark):
    rows = [(0.2, 0.7, 1.0), (0.9, 1.3, 2.0), (-0.5, 1.5, 1.0), (0.25, 3.0, 0.5), (0.4, 0.4, 9.0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, a double, b double, w double")
    pieces = S.folded(df, ["k"], "a", "b", "w")
    got = sorted((r.start, r.stop, r.weight) for r in pieces.collect())
    assert got[0][0] == 0 and got[-1][1] == 1 and all(x[1] == y[0] for x, y in zip(got[:-1], got[1:], strict=True))
    for x in np.arange(0.005, 1, 0.01):
        want = sum(w * sum(a <= x + m < b for m in range(-3, 5)) for a, b, w in rows)
        assert abs(next(w for lo, hi, w in got if lo <= x < hi) - want) < 1e-9, x
    hist = {r.bin: r.weight for r in S.interval_histogram(pieces, ["k"], 5).collect()}
    assert len(hist) == 5 and abs(sum(hist.values()) / 5 - sum((b - a) * w for a, b, w in rows)) < 1e-9
