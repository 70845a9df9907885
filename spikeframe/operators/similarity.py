"""Correlations between cells, halves and behaviour. Tables are long; pairs meet by their bin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions
from ..functions.scalar import safe_corr
from . import maps
from .behaviour import kernel_weights, smoothed


def speed_score(spikes: DataFrame, speed: DataFrame, session_keys, cell_keys, row: str) -> DataFrame:
    """Pearson correlation of speed with the spikes per sample; samples without a speed are left out, those without spikes count 0.

    One row per sample and cell isn't made: what the empty samples add is known from the session's sums.
    """
    v = speed.where(F.col("speed").isNotNull())
    whole = v.groupBy(*session_keys).agg(F.count("*").alias("__n"), F.avg("speed").alias("__v"), F.var_pop("speed").alias("__vv"))
    fired = spikes.groupBy(*cell_keys, row).agg(F.count("*").alias("__c")).join(v.select(*session_keys, row, "speed"), [*session_keys, row]).join(whole.select(*session_keys, "__v"), session_keys)
    sums = fired.groupBy(*cell_keys).agg(F.sum("__c").alias("c"), F.sum(F.col("__c") * F.col("__c")).alias("cc"), F.sum(F.col("__c") * (F.col("speed") - F.col("__v"))).alias("cv"))
    sums = spikes.select(*cell_keys).distinct().join(sums, cell_keys, "left").join(whole, session_keys)
    n, c = F.col("__n").cast("double"), F.col("c").cast("double")
    var_c, var_v = F.col("cc") - c * c / n, n * F.col("__vv")
    varies = (var_c > 0) & (F.col("__vv") > 1e-20 * F.col("__v") * F.col("__v"))
    return sums.select(*cell_keys, F.when(varies, F.try_divide(F.col("cv"), F.sqrt(var_c * var_v))).alias("speed_score"))


def smoothed_speed_score(spikes: DataFrame, position: DataFrame, session_keys, cell_keys, index: str, t: str, speed: str, sd: float, ephys_rate: float = 30000.0) -> DataFrame:
    """(cell_keys, speed_score, p): Pearson correlation of the smoothed speed with the smoothed count of spikes, both by Gaussian kernels of sd samples with reflected edges.

    spikes: t_sample; position: index from 0 without gaps. A session's time is cut into as many equal bins as it has samples. The kernel is
    symmetric, so the products of both series are those of the raw counts and the speed smoothed twice: only bins with spikes are joined, and one cell's (and
    shuffle's) squares are summed in its own group. Samples without a speed are left out of the kernel's mean.
    """
    import numpy as np
    import pandas as pd

    w = kernel_weights(sd)
    reach = len(w) // 2
    once = smoothed(position.select(*session_keys, index, t, speed), session_keys, index, speed, sd, out="__a")
    twice = smoothed(once, session_keys, index, "__a", sd, out="__b")
    whole = once.groupBy(*session_keys).agg(F.count("*").alias("__n"), F.max(t).alias("__end"), F.avg("__a").alias("__mean"), F.var_pop("__a").alias("__var"))
    at = F.floor(F.col("t_sample") * F.col("__n") / (F.col("__end") * ephys_rate))
    hit = spikes.join(whole.select(*session_keys, "__n", "__end"), list(session_keys)).where(F.col("t_sample").between(0, F.col("__end") * ephys_rate))
    counts = hit.groupBy(*cell_keys, "__n", F.least(at, F.col("__n") - 1).alias(index)).agg(F.count("*").alias("__c"))
    counts = counts.join(twice.select(*session_keys, index, "__b"), [*session_keys, index]).withColumnRenamed(index, "__i")

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf["__c"].to_numpy(float)
        series = np.zeros(int(pdf["__n"].iloc[0]))
        series[pdf["__i"].to_numpy()] = c
        smooth = np.convolve(np.pad(series, reach, "symmetric"), w, "valid")
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in cell_keys}, "__s": [c.sum()], "__x": [(c * pdf["__b"].to_numpy(float)).sum()], "__q": [(smooth * smooth).sum()]})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.select(*cell_keys).schema)
    per = counts.select(*cell_keys, "__n", "__i", "__c", "__b").groupBy(*cell_keys).applyInPandas(sums, f"{kinds}, __s double, __x double, __q double").join(whole, list(session_keys))
    n, total = F.col("__n").cast("double"), F.col("__s")
    spread = F.col("__q") - total * total / n
    r = F.when((spread > 1e-12 * F.col("__q")) & (F.col("__var") > 1e-20 * F.col("__mean") * F.col("__mean")), (F.col("__x") - total * F.col("__mean")) / F.sqrt(spread * n * F.col("__var")))
    per = per.withColumn("speed_score", r).withColumn("__t", F.try_divide(F.col("speed_score") * F.sqrt(n - 2), F.sqrt(1 - F.col("speed_score") * F.col("speed_score"))))
    return per.select(*cell_keys, "speed_score", distributions.student_p("__t", n - 2).alias("p"))


def speed_rates(spikes: DataFrame, samples: DataFrame, session_keys, cell_keys, speed: str, share: float = 0.005, rate: float = 30.0) -> DataFrame:
    """(cell_keys, bin, n, rate in Hz) by bins of speed of width 1 that hold more than share of the session's samples; bins without spikes count 0.

    The highest bin holds its upper end too. Rows without a speed are left out.
    """
    known = F.col(speed).isNotNull() & ~F.isnan(F.col(speed).cast("double"))
    span = samples.where(known).groupBy(*session_keys).agg(F.floor(F.min(speed)).alias("__low"), F.ceil(F.max(speed)).alias("__top"), F.count("*").alias("__all")).where("__top > __low")
    at = F.least(F.floor(speed), F.col("__top") - 1).alias("bin")
    count = lambda df, keys, name: df.where(known).join(span, list(session_keys)).groupBy(*keys, "__all", at).agg(F.count("*").alias(name))
    seen = count(samples, session_keys, "__o").where(F.col("__o") > share * F.col("__all")).drop("__all")
    grid = spikes.select(*cell_keys).distinct().join(seen, list(session_keys)).join(count(spikes, cell_keys, "__n").drop("__all"), [*cell_keys, "bin"], "left")
    n = F.coalesce("__n", F.lit(0).cast("long"))
    return grid.select(*cell_keys, "bin", n.alias("n"), (n / F.col("__o") * rate).alias("rate"))


def map_stability(spikes: DataFrame, position: DataFrame, session_keys, cell_keys, bin_px: float, smooth: float, dt: float, least: int) -> DataFrame:
    """(cell_keys, r, excluded): correlation of a cell's kernel maps of both halves over bins with occupancy in both, and the percentage of bins that have it in one half only."""
    rates = maps.rate_map(spikes, position, [*cell_keys, "half"], [*session_keys, "half"], bin_px, smooth, dt, least)
    seen = maps.occupancy(position, [*session_keys, "half"], bin_px, smooth, least).where("occupancy is not null")
    bins = seen.groupBy(*session_keys, "bin_x", "bin_y").agg(F.count("*").alias("__halves"))
    share = bins.groupBy(*session_keys).agg((100.0 * F.count_if(F.col("__halves") < 2) / F.count("*")).alias("excluded"))
    side = lambda h: F.coalesce(F.max(F.when(F.col("half") == h, F.col("rate"))), F.lit(0.0))
    both = rates.groupBy(*cell_keys, "bin_x", "bin_y").agg(side(1).alias("a"), side(2).alias("b"))
    grid = spikes.select(*cell_keys).distinct().join(bins.where("__halves = 2").drop("__halves"), list(session_keys)).join(both, [*cell_keys, "bin_x", "bin_y"], "left").na.fill(0.0, ["a", "b"])
    r = grid.groupBy(*cell_keys).agg(safe_corr("a", "b").alias("r"))
    return r.join(share, list(session_keys)).select(*cell_keys, "r", "excluded")


def half_stability(spikes: DataFrame, position: DataFrame, session_keys, cell_keys, bins) -> DataFrame:
    """Correlation of a cell's maps (spikes per sample) of both halves over bins seen in both, and the percentage of bins seen in one only."""
    seen = position.groupBy(*session_keys, "half", *bins).agg(F.count("*").alias("__o"))
    fired = spikes.groupBy(*cell_keys, "half", *bins).agg(F.count("*").alias("__c"))
    grid = spikes.select(*cell_keys).distinct().join(seen, session_keys).join(fired, [*cell_keys, "half", *bins], "left")
    rate = F.coalesce("__c", F.lit(0)) / F.col("__o")
    both = grid.groupBy(*cell_keys, *bins).agg(F.max(F.when(F.col("half") == 1, rate)).alias("a"), F.max(F.when(F.col("half") == 2, rate)).alias("b"))
    missing = F.when(F.col("a").isNull() | F.col("b").isNull(), 100.0).otherwise(0.0)
    return both.groupBy(*cell_keys).agg(safe_corr("a", "b").alias("r"), F.avg(missing).alias("excluded"))


def circular_linear(df: DataFrame, keys, angle: str, x: str) -> DataFrame:
    """Circular-linear correlation of an angle in degrees, and p with two degrees of freedom."""
    df = df.withColumns({"__c": F.cos(F.radians(angle)), "__s": F.sin(F.radians(angle))})
    r = df.groupBy(*keys).agg(safe_corr("__c", x).alias("rc"), safe_corr("__s", x).alias("rs"), safe_corr("__c", "__s").alias("cs"), F.count("*").alias("n"))
    rc, rs, cs = F.col("rc"), F.col("rs"), F.col("cs")
    r = r.withColumn("rho", F.sqrt(F.try_divide(rc * rc + rs * rs - 2 * rc * rs * cs, 1 - cs * cs)))
    return r.select(*keys, "rho", F.exp(-F.col("n") * F.col("rho") * F.col("rho") / 2).alias("p"))


def pairwise_correlation(hist: DataFrame, keys, item: str, bin_col: str, value: str) -> DataFrame:
    """Pearson correlation of each pair of items (a < b) of a group over the bins that both have."""
    side = lambda n: hist.select(*keys, bin_col, F.col(item).alias(n), F.col(value).cast("double").alias(f"__{n}"))
    pairs = side("a").join(side("b"), [*keys, bin_col]).where("a < b")
    return pairs.groupBy(*keys, "a", "b").agg(safe_corr("__a", "__b").alias("r"))


def aligned_histogram(hist: DataFrame, cell_keys, keys, value="n") -> DataFrame:
    """Direction histograms summed over cells, each turned by its own rounded mean angle."""
    a = F.radians(F.col("bin") - 179.0)
    mean = F.degrees(F.atan2(F.sum(F.sin(a) * F.col(value)), F.sum(F.cos(a) * F.col(value))))
    shift = hist.groupBy(*cell_keys).agg(F.bround(mean).cast("long").alias("__shift"))
    turned = hist.join(shift, cell_keys).withColumn("bin", F.pmod(F.col("bin") - F.col("__shift"), F.lit(360)).cast("int"))
    return turned.groupBy(*keys, "bin").agg(F.sum(value).alias(value))
