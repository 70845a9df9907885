"""Direction bars of cells against those of their shuffles: percentiles, corrected p values, numbers of significant bars, and the directional flag."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import in_groups
from .statistics import corrected_p


def bar_rates(counts: DataFrame, whose: DataFrame, time: DataFrame, keys, session_keys, bar: str) -> DataFrame:
    """(keys, bar, rate) for every row of whose and every bar of its session's time (session_keys, bar, o samples): spikes by samples, 0 where counts (keys, bar, n) has none."""
    grid = whose.select(*keys).join(time, list(session_keys))
    return grid.join(counts, [*keys, bar], "left").select(*keys, bar, (F.coalesce("n", F.lit(0)) / F.col("o")).alias("rate"))


def bar_spread(shuffled: DataFrame, keys, bar: str, value: str = "rate") -> DataFrame:
    """(keys, bar, mean, sd, low, high, up, down) over shuffles that all have every bar: 5th and 95th percentile, and their distances from the mean as error bars."""
    out = shuffled.groupBy(*keys, bar).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.percentile(value, F.array(F.lit(0.05), F.lit(0.95))).alias("__q"))
    low, high = F.col("__q")[0], F.col("__q")[1]
    return out.select(*keys, bar, "mean", "sd", low.alias("low"), high.alias("high"), (high - F.col("mean")).alias("up"), (F.col("mean") - low).alias("down"))


def two_tailed(below: Column, at_most: Column, n: Column) -> Column:
    """p of a score with so many of n others below it, and at most as high: twice the smaller tail of its percentile, 1 at most."""
    share = (below + at_most) / (2.0 * n)
    return F.least(F.lit(1.0), 2 * F.least(share, 1 - share))


def observed_p(observed: DataFrame, shuffled: DataFrame, keys, bar: str, value: str) -> DataFrame:
    """(keys, bar, p, outside): p of each bar among its shuffles, and whether it lies outside their 5th to 95th percentile."""
    own = observed.select(*keys, bar, F.col(value).alias("__v"))
    both = shuffled.join(own, [*keys, bar])
    n = both.groupBy(*keys, bar).agg(F.count_if(F.col(value) < F.col("__v")).alias("lt"), F.count_if(F.col(value) <= F.col("__v")).alias("le"), F.count("*").alias("n"), F.percentile(value, F.array(F.lit(0.05), F.lit(0.95))).alias("q"), F.first("__v").alias("__v"))
    return n.select(*keys, bar, two_tailed(F.col("lt"), F.col("le"), F.col("n")).alias("p"), ((F.col("__v") < F.col("q")[0]) | (F.col("__v") > F.col("q")[1])).alias("outside"))


def shuffled_p(shuffled: DataFrame, keys, bar: str, value: str) -> DataFrame:
    """(keys, shuffle_id, bar, p): p of each shuffle's bar among those of all other shuffles, by ranks of one sort of a cell's bar; null for a single shuffle."""
    w = Window.partitionBy(*keys, bar)
    below = F.rank().over(w.orderBy(value)) - 1
    others = F.count("*").over(w) - 1
    at_most = below + F.count("*").over(Window.partitionBy(*keys, bar, value)) - 1
    ranked = shuffled.withColumns({"__lt": below, "__le": at_most, "__n": others})
    return ranked.select(*keys, "shuffle_id", bar, F.when(F.col("__n") > 0, two_tailed(F.col("__lt"), F.col("__le"), F.col("__n"))).alias("p"))


def significant(p: DataFrame, keys, bar: str, level: float = 0.05) -> DataFrame:
    """(keys, n_bh, n_holm): bars whose p is below level after the corrections of Benjamini and Hochberg, and of Holm."""
    c = corrected_p(p.where(F.col("p").isNotNull()), list(keys), "p", [bar])
    return c.groupBy(*keys).agg(F.count_if(F.col("bh") < level).alias("n_bh"), F.count_if(F.col("holm") < level).alias("n_holm"))


def directional(own: DataFrame, others: DataFrame, keys, number: str = "n_bh", above: float = 95.0) -> DataFrame:
    """(keys, number, percentile, directional): where a cell's number of significant bars stands among its shuffles' numbers, ties counted half."""
    both = others.select(*keys, F.col(number).alias("__o")).join(own.select(*keys, number), list(keys))
    share = 50.0 * (F.count_if(F.col("__o") < F.col(number)) + F.count_if(F.col("__o") <= F.col(number))) / F.count("*")
    out = both.groupBy(*keys, number).agg(share.alias("percentile"))
    return out.withColumn("directional", F.col("percentile") > above)


def _percentile(ordered: np.ndarray, share: float) -> float:
    """Percentile between neighbours of sorted values, with the rounding of F.percentile."""
    at = (len(ordered) - 1) * share
    low, high = int(np.floor(at)), int(np.ceil(at))
    if ordered[low] == ordered[high]:
        return ordered[low]
    return (high - at) * ordered[low] + (at - low) * ordered[high]


def _adjusted(p: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of p, below level after Benjamini and Hochberg, and after Holm) of each row; nan is no p."""
    ordered = np.sort(p, axis=1)  # equal p share their corrections whatever their order
    known = ~np.isnan(ordered)
    m, rank = known.sum(1), np.arange(1, p.shape[1] + 1)
    bh = np.where(known, ordered * m[:, None] / rank, np.inf)
    bh = np.minimum.accumulate(bh[:, ::-1], axis=1)[:, ::-1]
    holm = np.maximum.accumulate(np.where(known, ordered * (m[:, None] - rank + 1), -np.inf), axis=1)
    return m, (known & (np.minimum(1.0, bh) < level)).sum(1), (known & (np.minimum(1.0, holm) < level)).sum(1)


def bar_tests(rates: DataFrame, keys, level: float = 0.05, shuffles: bool = True) -> DataFrame:
    """(keys, shuffle_id, n_bh, n_holm, n_outside) of rates (keys, shuffle_id, rates: an array of bars): observed_p of the cell's own bars (shuffle_id -1) and shuffled_p of its shuffles', and the numbers of bars that significant gives.

    n_outside: own bars outside the 5th to 95th percentile of the shuffles'; null for shuffles. Null bars have no p, and rows without any p go. A cell's shuffles are one group, many
    cells share a call; shuffles=False gives the cells' own rows alone.
    """
    keys = list(keys)

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        found = []
        for a, b in zip(starts, np.append(starts[1:], len(pdf)), strict=True):
            copy = pdf["shuffle_id"].to_numpy()[a:b]
            value = np.stack(pdf["rates"].to_numpy()[a:b]).astype(float)
            own = copy < 0
            rows = np.arange(b - a) if shuffles else np.flatnonzero(own)
            p, outside = np.full((len(rows), value.shape[1]), np.nan), np.zeros(len(rows), np.int64)
            mine = own[rows]
            for bar in range(value.shape[1]):
                others = np.sort(value[~own, bar])
                others = others[: np.count_nonzero(~np.isnan(others))]
                x = value[rows, bar]
                n = np.where(mine, len(others), len(others) - 1)
                lt, le = np.searchsorted(others, x, "left"), np.searchsorted(others, x, "right") - np.where(mine, 0, 1)
                good = ~np.isnan(x) & (n > 0)
                share = (lt + le) / (2.0 * np.where(good, n, 1))
                p[:, bar] = np.where(good, np.minimum(1.0, 2 * np.minimum(share, 1 - share)), np.nan)
                if len(others) and mine.any():
                    outside += mine & ((x < _percentile(others, 0.05)) | (x > _percentile(others, 0.95)))
            m, n_bh, n_holm = _adjusted(p, level)
            keep = m > 0
            found.append((a + rows[keep], n_bh[keep], n_holm[keep], np.where(mine, outside, -1)[keep]))
        at, n_bh, n_holm, outside = (np.concatenate(c) for c in zip(*found, strict=True))
        return pdf.iloc[at][[*keys, "shuffle_id"]].assign(n_bh=n_bh, n_holm=n_holm, n_outside=outside)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rates.select(*keys).schema)
    out = in_groups(rates.select(*keys, F.col("shuffle_id").cast("int").alias("shuffle_id"), "rates"), keys, run, f"{kinds}, shuffle_id int, n_bh long, n_holm long, n_outside long")
    return out.withColumn("n_outside", F.when(F.col("n_outside") >= 0, F.col("n_outside")))


def directional_tests(tests: DataFrame, keys, number: str = "n_bh", above: float = 95.0) -> DataFrame:
    """directional for the rows of bar_tests, own and shuffles in one table."""
    own = F.col("shuffle_id") < 0
    both = tests.groupBy(*keys).agg(F.max(F.when(own, F.col(number))).alias(number), F.collect_list(F.when(~own, F.col(number))).alias("__o")).where(F.col(number).isNotNull() & (F.size("__o") > 0))
    count = lambda f: F.size(F.filter("__o", f))
    share = 50.0 * (count(lambda o: o < F.col(number)) + count(lambda o: o <= F.col(number))) / F.size("__o")
    return both.select(*keys, number, share.alias("percentile")).withColumn("directional", F.col("percentile") > above)
