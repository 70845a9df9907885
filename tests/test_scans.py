"""Operators that carry a state along a session, in chunks, against loops over the rows."""

import numpy as np
import pytest

from spikeframe.operators import responses as R
from spikeframe.operators import sessions as T


def fold(x):
    return (x + 180) % 360 - 180


def repaired(angle, t, most):
    out, last = list(angle), None
    for i, a in enumerate(angle):
        if a is None:
            continue
        if last is not None:
            change, time = fold(a - out[last]), t[i] - t[last]
            if time > 0 and abs(change) / time > most and abs(fold(change + 180)) < abs(change):
                out[i] = fold(a + 180)
        last = i
    return out


def accepted(x, y, t, most):
    out, last = [], None
    for i in range(len(x)):
        good = x[i] is not None and y[i] is not None and (last is None or np.hypot(x[i] - x[last], y[i] - y[last]) <= most * (t[i] - t[last]))
        out.append(good)
        last = i if good else last
    return out


@pytest.mark.parametrize("chunk", [1, 1000])
def test_turned_angles_equal_a_loop(spark, chunk):
    rng = np.random.default_rng(chunk)
    rows, want = [], {}
    for k in range(6):
        n = int(rng.integers(1, 150))
        steps = rng.integers(-12, 13, n) if k % 2 else rng.integers(-90, 91, n)
        angle = [float(fold(a + 180 * f)) for a, f in zip(np.cumsum(steps), rng.random(n) < 0.3, strict=True)]
        angle = [None if rng.random() < 0.15 else a for a in angle]
        t = np.cumsum(rng.integers(0, 3, n)).tolist()
        once = repaired(angle, t, 40.0)
        want.update({(k, i): a for i, a in enumerate(once)})
        rows += [(k, i, float(s), a) for i, (s, a) in enumerate(zip(t, angle, strict=True))]
    df = spark.createDataFrame(rows, "k int, i long, t double, hd double").repartition(3)
    got = {(r.k, r.i): r.hd for r in T.repaired_direction(df, ["k"], "i", "hd", "t", 40.0, chunk).collect()}
    assert got.keys() == want.keys()
    assert all((got[x] is None) == (want[x] is None) and (got[x] is None or abs(fold(got[x] - want[x])) < 1e-9) for x in want)
    assert T.repaired_direction(df.where("false"), ["k"], "i", "hd", "t", 40.0, chunk).count() == 0


@pytest.mark.parametrize("chunk", [12, 1000])
def test_accepted_samples_equal_a_loop(spark, chunk):
    rng = np.random.default_rng(20 + chunk)
    rows, want = [], {}
    for k in range(5):
        n = int(rng.integers(1, 90))
        place = np.cumsum(rng.normal(0, 1, (n, 2)), axis=0) + np.where(rng.random((n, 1)) < 0.2, rng.normal(0, 60, (n, 2)), 0)
        place[rng.integers(n) :] += 0 if k % 2 else 25  # a lasting jump, after which nothing is near for a while
        x = [None if rng.random() < 0.1 else float(v) for v in place[:, 0]]
        y, t = place[:, 1].tolist(), np.arange(n, dtype=float).tolist()
        want.update({(k, i): a for i, a in enumerate(accepted(x, y, t, 3.0))})
        rows += [(k, i, *r) for i, r in enumerate(zip(x, y, t, strict=True))]
    df = spark.createDataFrame(rows, "k int, i long, x double, y double, t double").repartition(3)
    got = {(r.k, r.i): r.accepted for r in R.sequential_jumps(df, ["k"], "i", "x", "y", "t", 3.0, chunk).collect()}
    assert got == want and 0 < sum(got.values()) < len(got)
    assert R.sequential_jumps(df.where("false"), ["k"], "i", "x", "y", "t", 3.0, chunk).count() == 0
