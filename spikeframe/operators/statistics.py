"""Statistical tests and shuffles over long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .behaviour import onward


def circular_mean(df: DataFrame, keys, angle: str) -> DataFrame:
    """Mean angle in degrees and circular standard deviation in radians."""
    s, c = F.avg(F.sin(F.radians(angle))), F.avg(F.cos(F.radians(angle)))
    return df.groupBy(*keys).agg(F.degrees(F.atan2(s, c)).alias("mean_angle"), F.sqrt(-2 * F.log(F.hypot(s, c))).alias("circular_sd"))


def modes_spread(modes: DataFrame, keys, item: str, angle: str) -> DataFrame:
    """(keys, items, sd): circular standard deviation in degrees of all modes of a group, null unless two items or more have a mode. A mean vector below 1e-12 counts as 1e-12."""
    a, known = F.radians(angle), F.col(angle).isNotNull()
    length = F.least(F.lit(1.0), F.greatest(F.lit(1e-12), F.hypot(F.avg(F.sin(a)), F.avg(F.cos(a)))))
    out = modes.groupBy(*keys).agg(F.countDistinct(F.when(known, F.col(item))).alias("items"), F.degrees(F.sqrt(-2 * F.log(length))).alias("sd"))
    return out.withColumn("sd", F.when(F.col("items") > 1, F.col("sd")))


def rayleigh(hist: DataFrame, keys, value="n") -> DataFrame:
    """Rayleigh p (Zar's form) from a 360-bin histogram as weights."""
    a = F.radians(F.col("bin") - 179.0)
    agg = hist.groupBy(*keys).agg(F.sum(value).cast("double").alias("n"), F.hypot(F.sum(F.sin(a) * F.col(value)), F.sum(F.cos(a) * F.col(value))).alias("r"))
    return agg.withColumn("p", F.exp(F.sqrt(1 + 4 * F.col("n") + 4 * (F.col("n") * F.col("n") - F.col("r") * F.col("r"))) - (1 + 2 * F.col("n")))).select(*keys, "p")


def two_sample_steps(df: DataFrame, keys, sample: str, value: str) -> DataFrame:
    """Per distinct value: share of sample 0 and of sample 1 at or below it, and how many rows have it."""
    df = df.select(*keys, F.col(sample).alias("__s"), F.col(value).alias("__v"))
    counts = df.groupBy(*keys, "__v").agg(F.sum(F.when(F.col("__s") == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("__s") == 1, 1).otherwise(0)).alias("b"))
    w = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    counts = counts.withColumns({"n": F.sum("a").over(whole), "m": F.sum("b").over(whole), "ca": F.sum("a").over(w), "cb": F.sum("b").over(w)})
    return counts.withColumn("d", F.try_divide(F.col("ca").cast("double"), F.col("n").cast("double")) - F.try_divide(F.col("cb").cast("double"), F.col("m").cast("double")))


def kuiper(df: DataFrame, keys, sample, value) -> DataFrame:
    """Two-sample Kuiper statistic; null where a sample has no rows."""
    s = two_sample_steps(df, keys, sample, value)
    v = F.greatest(F.max("d"), F.lit(0.0)) + F.greatest(F.max(-F.col("d")), F.lit(0.0))
    return s.groupBy(*keys).agg(F.when(F.max("d").isNotNull(), v).alias("kuiper"))


def kolmogorov_smirnov(df: DataFrame, keys, sample, value) -> DataFrame:
    return two_sample_steps(df, keys, sample, value).groupBy(*keys).agg(F.max(F.abs("d")).alias("ks"))


def watson_u2(df: DataFrame, keys, sample, value) -> DataFrame:
    """Watson's two-sample U squared with ties, and whether it is above the 1 % bound 0.268."""
    s = two_sample_steps(df, keys, sample, value).withColumn("t", F.col("a") + F.col("b"))
    u = F.first("n") * F.first("m") / F.pow(F.first("n") + F.first("m"), F.lit(2)) * (F.sum(F.col("t") * F.col("d") * F.col("d")) - F.try_divide(F.pow(F.sum(F.col("t") * F.col("d")), F.lit(2)), F.sum("t").cast("double")))
    return s.groupBy(*keys).agg(u.alias("u2")).withColumn("significant", F.col("u2") > 0.268)


def mann_whitney(df: DataFrame, keys, sample, value) -> DataFrame:
    """U of sample 0 from average ranks."""
    df = df.select(*keys, F.col(sample).alias("__s"), F.col(value).alias("__v"))
    counts = df.groupBy(*keys, "__v").agg(F.sum(F.when(F.col("__s") == 0, 1).otherwise(0)).alias("a"), F.count("*").alias("t"))
    w = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("t").over(w), F.lit(0)) + (F.col("t") + 1) / 2
    r = counts.withColumn("rank", rank).groupBy(*keys).agg(F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum("a").alias("n"))
    return r.select(*keys, (F.col("r") - F.col("n") * (F.col("n") + 1) / 2).alias("u"))


def mad_outliers(df: DataFrame, keys, value: str, cut: float = 3.5) -> DataFrame:
    """Modified z-score 0.6745 * |x - median| / MAD, and whether it is above cut."""
    med = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("__med"))
    df = df.join(med, keys).withColumn("__d", F.abs(F.col(value) - F.col("__med")))
    mad = df.groupBy(*keys).agg(F.percentile("__d", F.lit(0.5)).alias("__mad"))
    return df.join(mad, keys).withColumn("z", F.try_divide(0.6745 * F.col("__d"), F.col("__mad"))).withColumn("outlier", F.coalesce(F.col("z") > cut, F.lit(False))).drop("__med", "__d", "__mad")


def time_shift_shuffle(spikes: DataFrame, n: int, length: int, guard: int, cell_keys) -> DataFrame:
    """n copies of each cell's spike times, each moved by its own offset in [guard, length - guard) and wrapped.

    Offsets come from the keys by portable arithmetic, so a retried task gives the same rows.
    """
    seed = F.lit(0).cast("long")
    for i, k in enumerate(cell_keys):
        seed = seed + F.col(k).cast("long") * (48271 + 7919 * i)
    df = spikes.withColumn("shuffle_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    offset = F.lit(guard) + F.pmod(seed + F.col("shuffle_id") * F.lit(16807 * 131).cast("long"), F.lit(length - 2 * guard))
    return df.withColumn("t", F.pmod(F.col("t") + offset, F.lit(length)))


def shuffle_cutoffs(metrics: DataFrame, keys, value: str, z: float) -> DataFrame:
    """Mean + z standard deviations (population) of the shuffles, and how many had a value."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    return metrics.groupBy(*keys).agg((F.avg(v) + z * F.stddev_pop(v)).alias("cutoff"), F.count(v).alias("n_shuffles"))


def percentile_of_score(observed: DataFrame, shuffles: DataFrame, keys, value: str) -> DataFrame:
    """Mean of the weak and strict percentile of the observed value among the shuffles."""
    both = observed.select(*keys, F.col(value).alias("__o")).join(shuffles.select(*keys, value), keys)
    return both.groupBy(*keys).agg((50.0 * (F.sum((F.col(value) < F.col("__o")).cast("int")) + F.sum((F.col(value) <= F.col("__o")).cast("int"))) / F.count("*")).alias("percentile"))


def corrected_p(df: DataFrame, keys, p: str, order: list[str]) -> DataFrame:
    """Benjamini-Hochberg and Holm adjusted p-values in each group."""
    up = Window.partitionBy(*keys).orderBy(p, *order)
    m = F.count("*").over(Window.partitionBy(*keys))
    df = df.withColumns({"__r": F.row_number().over(up), "__m": m})
    df = df.withColumns({"__bh": F.col(p) * F.col("__m") / F.col("__r"), "__h": F.col(p) * (F.col("__m") - F.col("__r") + 1)})
    bh = F.min("__bh").over(onward(keys, [p, *order]))
    holm = F.max("__h").over(up.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"bh": F.least(F.lit(1.0), bh), "holm": F.least(F.lit(1.0), holm)}).drop("__r", "__m", "__bh", "__h")
