"""Tail probabilities of test statistics, for tables of one row per test. Null or impossible arguments give null."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _rowwise(f: Callable) -> Callable:
    """A column function from one of plain numbers; the tables are small."""

    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(c.to_pylist() for c in columns), strict=True):
            bad = any(x is None or not math.isfinite(x) for x in row)
            out.append(None if bad else f(*row))
        return pa.array(out, pa.float64())

    # arrow_udf reads the number of arguments from the annotations of a plain function
    if f.__code__.co_argcount == 1:
        one: Callable = lambda a: run(a)
    elif f.__code__.co_argcount == 2:
        one = lambda a, b: run(a, b)
    else:
        one = lambda a, b, c: run(a, b, c)
    names = one.__code__.co_varnames[: one.__code__.co_argcount]
    one.__annotations__ = {**{n: pa.Array for n in names}, "return": pa.Array}
    return F.arrow_udf(one, DoubleType())


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    value = 1.0
    for i in range(300, 0, -1):
        m = i // 2
        term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + term / value
    return front / value


def student(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_share(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def fisher(f: float, a: float, b: float) -> float:
    """Upper p of F with a and b degrees of freedom."""
    return beta_share(b / 2, a / 2, b / (b + a * f)) if a > 0 and b > 0 and f >= 0 else math.nan


def gauss(z: float) -> float:
    """Two-sided p of a normal score."""
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov(d: float, n: float) -> float:
    """Asymptotic p of a Kolmogorov-Smirnov distance for an effective number n."""
    z = d * math.sqrt(n)
    return 1.0 if z < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (m - 1) * math.exp(-2 * m * m * z * z) for m in range(1, 101))))


def kuiper_tail(d: float, n: float) -> float:
    """False-positive probability of a Kuiper statistic for an effective number n: exact for small and large statistics and for whole numbers up to 20, else asymptotic."""
    if not 0 <= d <= 2 or n <= 0:
        return math.nan
    if d <= 1 / n:
        return 1.0
    if d < 2 / n:
        return 1 - math.exp(math.lgamma(n + 1) + (n - 1) * math.log(d - 1 / n))
    if d < 3 / n:
        half = (n * d - 1) / 2
        root = math.sqrt(max(0.0, half * half - (n * d - 2) ** 2 / 2))
        low, high = half - root, half + root  # roots of x * x - (n d - 1) x + (n d - 2) ** 2 / 2
        if root > 1e-9:
            top = high ** (n - 1) * (1 - low) - low ** (n - 1) * (1 - high)
            return min(1.0, max(0.0, 1 - math.exp(math.lgamma(n) - (n - 2) * math.log(n)) * top / (high - low)))
    if n == int(n) and (n <= 20 or d > 0.5):  # the sum of larger n loses all digits for small d
        total = 0.0
        for t in range(int(n * (1 - d) + 1e-12) + 1):
            y, rest, a = d + t / n, max(0.0, 1 - d - t / n), 3 - 2 / n
            weight = y**3 * n - y * y * t * a + y * t * (t - 1) * a / n - t * (t - 1) * (t - 2) / (n * n)
            total += math.comb(int(n), t) * y ** (t - 3) * weight * rest ** (n - t - 1)
        return min(1.0, max(0.0, total))
    z2 = d * d * n
    first = sum(2 * (4 * m * m * z2 - 1) * math.exp(-2 * m * m * z2) for m in range(1, 60))
    second = sum(m * m * (4 * m * m * z2 - 3) * math.exp(-2 * m * m * z2) for m in range(1, 60))
    return min(1.0, max(0.0, first - 8 * d / 3 * second))


student_p, fisher_p, gauss_p, kolmogorov_p, kuiper_p = map(_rowwise, (student, fisher, gauss, kolmogorov, kuiper_tail))
