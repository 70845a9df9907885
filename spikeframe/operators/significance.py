"""Whole two-sample and one-sample tests by group: statistic and p. One row per group; groups that a test can't judge have a null p."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from .statistics import two_sample_steps


def _double(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def kuiper_two(df: DataFrame, keys, sample: str, value: str) -> DataFrame:
    """(keys, kuiper, p) of samples 0 and 1, for the effective number n * m / (n + m)."""
    s = two_sample_steps(df, keys, sample, value)
    v = F.greatest(F.max("d"), F.lit(0.0)) + F.greatest(F.max(-F.col("d")), F.lit(0.0))
    out = s.groupBy(*keys).agg(F.when(F.max("d").isNotNull(), v).alias("kuiper"), _double(F.first("n")).alias("n"), _double(F.first("m")).alias("m"))
    return out.select(*keys, "kuiper", D.kuiper_p("kuiper", F.try_divide(F.col("n") * F.col("m"), F.col("n") + F.col("m"))).alias("p"))


def _ranked(df: DataFrame, keys, share: Column) -> DataFrame:
    w = Window.partitionBy(*keys)
    df = df.withColumn("__u", share).where("__u is not null")
    return df.withColumns({"__i": F.row_number().over(w.orderBy("__u")), "__n": F.count("*").over(w)})


def kuiper_one(df: DataFrame, keys, share: Column) -> DataFrame:
    """(keys, kuiper, p) of values against a distribution; share: its distribution function at the value, 0 to 1."""
    r = _ranked(df, keys, share)
    n, i = _double("__n"), _double("__i")
    out = r.groupBy(*keys).agg((F.max(i / n - F.col("__u")) + F.max(F.col("__u") - (i - 1) / n)).alias("kuiper"), _double(F.first("__n")).alias("n"))
    return out.select(*keys, "kuiper", D.kuiper_p("kuiper", "n").alias("p"))


def watson_one(df: DataFrame, keys, share: Column) -> DataFrame:
    """(keys, u2) of values against a distribution."""
    r = _ranked(df, keys, share)
    n, i = _double("__n"), _double("__i")
    apart = F.sum(F.pow(F.col("__u") - (2 * i - 1) / (2 * n), F.lit(2)))
    size = _double(F.first("__n"))
    return r.groupBy(*keys).agg((apart + 1 / (12 * size) - size * F.pow(F.avg("__u") - 0.5, F.lit(2))).alias("u2"))


def kolmogorov_two(df: DataFrame, keys, sample: str, value: str) -> DataFrame:
    """(keys, ks, p)."""
    out = two_sample_steps(df, keys, sample, value).groupBy(*keys).agg(F.max(F.abs("d")).alias("ks"), _double(F.first("n")).alias("n"), _double(F.first("m")).alias("m"))
    return out.select(*keys, "ks", D.kolmogorov_p("ks", F.try_divide(F.col("n") * F.col("m"), F.col("n") + F.col("m"))).alias("p"))


def rank_sum(df: DataFrame, keys, sample: str, value: str) -> DataFrame:
    """(keys, u, z, p): U of sample 0 with average ranks, and its normal score with the correction for ties."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(_double(F.count_if(F.col(sample) == 0)).alias("a"), _double(F.count_if(F.col(sample) == 1)).alias("b"))
    w = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("a") + F.col("b")
    rank = F.coalesce(F.sum(t).over(w), F.lit(0.0)) + (t + 1) / 2
    r = counts.withColumn("rank", rank).groupBy(*keys).agg(F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum("a").alias("n"), F.sum("b").alias("m"), F.sum(t * t * t - t).alias("ties"))
    n, m = F.col("n"), F.col("m")
    total = n + m
    u = F.col("r") - n * (n + 1) / 2
    spread = F.sqrt(n * m / 12 * (total + 1 - F.try_divide(F.col("ties"), total * (total - 1))))
    z = F.when((n > 0) & (m > 0), F.try_divide(u - n * m / 2, spread))
    return r.select(*keys, u.alias("u"), z.alias("z")).withColumn("p", D.gauss_p("z"))


def signed_rank(df: DataFrame, keys, a: str, b: str) -> DataFrame:
    """(keys, w, z, p) of paired values: the smaller sum of ranks of differences other than 0, and its normal score."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("__d", _double(a) - _double(b)).where("__d <> 0")
    counts = d.groupBy(*keys, F.abs("__d").alias("__v")).agg(_double(F.count_if(F.col("__d") > 0)).alias("up"), _double(F.count("*")).alias("t"))
    w = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("t")
    counts = counts.withColumn("rank", F.coalesce(F.sum("t").over(w), F.lit(0.0)) + (t + 1) / 2)
    r = counts.groupBy(*keys).agg(F.sum(F.col("up") * F.col("rank")).alias("up"), F.sum((t - F.col("up")) * F.col("rank")).alias("down"), F.sum("t").alias("n"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n")
    low = F.least("up", "down")
    z = F.try_divide(low - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48))
    return r.select(*keys, low.alias("w"), z.alias("z")).withColumn("p", D.gauss_p("z"))


def levene(df: DataFrame, keys, sample: str, value: str) -> DataFrame:
    """(keys, levene, p): equality of spreads of samples 0 and 1 around their medians."""
    rows = df.where(F.col(sample).isin(0, 1) & F.col(value).isNotNull()).select(*keys, F.col(sample).alias("__s"), _double(value).alias("__v"))
    median = rows.groupBy(*keys, "__s").agg(F.percentile("__v", F.lit(0.5)).alias("__m"))
    z = rows.join(median, [*keys, "__s"]).withColumn("z", F.abs(F.col("__v") - F.col("__m")))
    per = z.groupBy(*keys, "__s").agg(_double(F.count("*")).alias("n"), F.avg("z").alias("mean"), F.var_pop("z").alias("var"))
    whole = per.groupBy(*keys).agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.count("*").alias("groups"))
    both = per.join(whole, list(keys)).groupBy(*keys).agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2))).alias("between"), F.sum(F.col("n") * F.col("var")).alias("within"), F.first("total").alias("total"), F.first("groups").alias("groups"))
    f = F.when(F.col("groups") == 2, F.try_divide((F.col("total") - 2) * F.col("between"), F.col("within")))
    return both.select(*keys, f.alias("levene"), D.fisher_p(f, F.lit(1.0), F.col("total") - 2).alias("p"))


def t_test(df: DataFrame, keys, sample: str, value: str) -> DataFrame:
    """(keys, t, df, p): Welch's test of the means of samples 0 and 1."""
    side = lambda s, f: f(F.when(F.col(sample) == s, _double(value)))
    r = df.groupBy(*keys).agg(*(g.alias(f"{name}{s}") for s in (0, 1) for name, g in (("n", _double(side(s, F.count))), ("m", side(s, F.avg)), ("v", side(s, F.var_samp)))))
    a, b = F.try_divide("v0", "n0"), F.try_divide("v1", "n1")
    r = r.withColumns({"t": F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(a + b)), "df": F.try_divide((a + b) * (a + b), a * a / (F.col("n0") - 1) + b * b / (F.col("n1") - 1))})
    return r.select(*keys, "t", "df").withColumn("p", D.student_p("t", "df"))


def folded(intervals: DataFrame, keys, low: str, high: str, weight: str) -> DataFrame:
    """(keys, start, stop, weight): intervals modulo 1 on [0, 1), with multiplicity, as pieces of equal summed weight.

    A whole turn adds its weight everywhere, as a constant.
    """
    a, b, w = F.col(low), F.col(high), _double(weight)
    fa, fb = a - F.floor(a), b - F.floor(b)
    ends = F.array(F.struct(F.lit(0.0).alias("at"), (w * (F.ceil(b) - F.floor(a) - 1)).alias("w")), F.struct(fa.cast("double").alias("at"), w.alias("w")), F.struct(fb.cast("double").alias("at"), F.when(fb > 0, -w).otherwise(0.0).alias("w")))
    edges = intervals.select(*keys, F.explode(ends).alias("e")).groupBy(*keys, F.col("e.at").alias("start")).agg(F.sum("e.w").alias("w"))
    order = Window.partitionBy(*keys).orderBy("start")
    return edges.select(*keys, "start", F.coalesce(F.lead("start").over(order), F.lit(1.0)).alias("stop"), F.sum("w").over(order).alias("weight"))


def overlap(a: str, b: str, c: str, d: str) -> Column:
    """Length that the intervals a to b and c to d share."""
    return F.greatest(F.lit(0.0), F.least(b, d) - F.greatest(a, c))


def interval_histogram(pieces: DataFrame, keys, bins: int) -> DataFrame:
    """(keys, bin, weight): mean weight of pieces (keys, start, stop, weight) in each of bins equal parts of [0, 1)."""
    p = pieces.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") * bins), F.least(F.lit(bins - 1).cast("long"), F.floor(F.col("stop") * bins)))))
    p = p.withColumns({"__c": F.col("bin") / bins, "__d": (F.col("bin") + 1) / bins})
    return p.groupBy(*keys, "bin").agg(F.sum(overlap("start", "stop", "__c", "__d") * bins * F.col("weight")).alias("weight"))


def exposure_share(values: DataFrame, pieces: DataFrame, keys, value: str, out: str = "share") -> DataFrame:
    """values with the share of all exposure below value modulo 1: the piecewise-linear distribution function of pieces (keys, start, stop, weight) as folded gives them.

    One sort brings each value to the piece that holds it. Null where a key has no exposure, or the value is null.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    size = F.col("weight") * (F.col("stop") - F.col("start"))
    before = F.coalesce(F.sum(size).over(w.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    held = pieces.withColumns({"__below": before, "__all": F.sum(size).over(w)})
    row = F.struct(*(c for c in values.columns))
    kind = values.select(row.alias("r")).schema["r"].dataType
    piece = F.struct("start", "weight", "__below", "__all")
    x = _double(value) - F.floor(_double(value))
    both = held.select(*keys, F.col("start").cast("double").alias("__at"), F.lit(0).alias("__p"), piece.alias("__piece"), F.lit(None).cast(kind).alias("__row"))
    both = both.unionByName(values.select(*keys, x.alias("__at"), F.lit(1).alias("__p"), F.lit(None).cast(both.schema["__piece"].dataType).alias("__piece"), row.alias("__row")))
    at = F.last("__piece", ignorenulls=True).over(w.orderBy(F.asc_nulls_first("__at"), "__p").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("__in", at).where("__p = 1")
    share = F.try_divide(F.col("__in.__below") + F.col("__in.weight") * (F.col("__at") - F.col("__in.start")), F.col("__in.__all"))
    return both.select(*(F.col("__row")[c].alias(c) for c in values.columns), F.when(F.col("__at").isNotNull(), share).alias(out))
