"""Joins of spikes, positions and pulses. Range joins are equi-joins on time buckets, then the exact predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .behaviour import onward


def spikes_to_positions(spikes: DataFrame, position: DataFrame, ephys_rate: float = 30000.0) -> DataFrame:
    """Each spike with the position sample nearest by index; spikes at or after the last sample are dropped.

    The session's ratio of rates is ephys_rate times the mean time between positions. spikes: session_id,
    t_sample; position: session_id, pos_idx, synced_time and what is to be copied.
    """
    span = position.groupBy("session_id").agg(F.try_divide(F.max("synced_time") - F.min("synced_time"), (F.count("*") - 1).cast("double")).alias("dt"), F.max("synced_time").alias("t_max"))
    hit = spikes.join(span, "session_id").where(F.col("t_sample") / ephys_rate < F.col("t_max"))
    hit = hit.withColumn("pos_idx", F.bround(F.col("t_sample") / (F.col("dt") * ephys_rate)).cast("long")).drop("dt", "t_max")
    return hit.join(position, ["session_id", "pos_idx"])


def nearest(probes: DataFrame, values: DataFrame, keys, probe: str, value: str) -> DataFrame:
    """For each probe the nearest value in its group, the smaller on ties: one sort, no range join."""
    both = probes.select(*keys, F.col(probe).alias("__t"), F.lit(1).alias("__p"), F.lit(None).cast("double").alias("__v")).union(values.select(*keys, F.col(value).alias("__t"), F.lit(0).alias("__p"), F.col(value).cast("double").alias("__v")))
    w = Window.partitionBy(*keys).orderBy("__t", "__p").rowsBetween(Window.unboundedPreceding, 0)
    value_at = F.last("__v", ignorenulls=True)
    both = both.withColumns({"before": value_at.over(w), "after": value_at.over(onward(keys, ["__t", "__p"]))})
    closer = F.when(F.col("before").isNull() | (F.col("after") - F.col("__t") < F.col("__t") - F.col("before")), F.col("after")).otherwise(F.col("before"))
    return both.where("__p = 1").select(*keys, F.col("__t").alias(probe), closer.alias("nearest"))


def peristimulus(spikes: DataFrame, pulses: DataFrame, window: int) -> DataFrame:
    """Spikes strictly inside a window centred at each pulse, as offsets from its start."""
    half = window // 2
    lo, hi = F.col("pulse") - half, F.col("pulse") + half
    p = pulses.withColumn("bucket", F.explode(F.sequence(F.floor(lo / window), F.floor(hi / window))))
    s = spikes.withColumn("bucket", F.floor(F.col("t") / window))
    return s.join(p, ["session_id", "bucket"]).where((F.col("t") > lo) & (F.col("t") < hi)).withColumn("offset", F.col("t") - lo).drop("bucket")


def first_after(spikes: DataFrame, pulses: DataFrame, limit: int) -> DataFrame:
    """The first spike strictly after each pulse of its session and its latency, null beyond limit."""
    both = pulses.select("session_id", F.col("pulse").alias("t"), F.lit(1).alias("p")).union(spikes.select("session_id", "t", F.lit(0)))
    nxt = F.last(F.when(F.col("p") == 0, F.col("t")), ignorenulls=True).over(onward(["session_id"], ["t", "p"]))  # from the last spike on; at one time spikes stand before pulses
    out = both.withColumn("next", nxt).where("p = 1").select("session_id", F.col("t").alias("pulse"), "next")
    near = F.col("next") - F.col("pulse") <= limit
    return out.select("session_id", "pulse", F.when(near, F.col("next")).alias("spike"), F.when(near, F.col("next") - F.col("pulse")).alias("latency"))


def in_field_bins(samples: DataFrame, field_bins: DataFrame, bin_px: float, x="x_px", y="y_px", keys=("session_id",)) -> DataFrame:
    """Samples strictly inside the bins of a field, edges excluded. keys: a session's, or a cell's where samples are its spikes."""
    s = samples.withColumns({"bin_x": F.floor(F.col(x) / bin_px), "bin_y": F.floor(F.col(y) / bin_px)}).where((F.col(x) % bin_px != 0) & (F.col(y) % bin_px != 0))
    return s.join(field_bins, [*keys, "bin_x", "bin_y"])


def split_stitched(spikes: DataFrame, stitches: DataFrame, width: int = 1 << 22) -> DataFrame:
    """Times of stitched recordings back in their own recording; stitches: recording, lo, hi. They meet by buckets of width samples, the exact bounds decide."""
    parts = stitches.withColumn("__b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    hit = spikes.withColumn("__b", F.floor(F.col("t") / width)).join(parts, "__b")
    return hit.where((F.col("t") > F.col("lo")) & (F.col("t") <= F.col("hi"))).withColumn("t_local", F.col("t") - F.col("lo")).drop("__b")


def correlogram(a: DataFrame, b: DataFrame, keys, window: int, bin_size: int, items=()) -> DataFrame:
    """Counts of b around a by lag bin, within window either way; equal times of the two are left out. items: further columns of a or b to count by."""
    bb = b.withColumn("bucket", F.explode(F.array(*(F.floor(F.col("tb") / window) + d for d in (-1, 0, 1)))))
    hit = a.withColumn("bucket", F.floor(F.col("ta") / window)).join(bb, [*keys, "bucket"])
    lag = F.col("tb") - F.col("ta")
    return hit.where((F.abs(lag) <= window) & (lag != 0)).groupBy(*keys, *items, F.floor(lag / bin_size).alias("lag_bin")).agg(F.count("*").alias("n"))


def tetrode_correlograms(spikes: DataFrame, session_keys, tetrode: str, cluster: str, t: str, window: int, bin_size: int, rate: float = 30000.0) -> DataFrame:
    """(session_keys, tetrode, a, b, lag_bin, n, rate): cross- and auto-correlograms of all clusters of a tetrode, in Hz: counts by the spikes of a and the bin's seconds."""
    side = lambda name: spikes.select(*session_keys, tetrode, F.col(cluster).alias(name), F.col(t).alias(f"t{name}"))
    a, keys = side("a"), [*session_keys, tetrode]
    return correlogram_rates(correlogram(a, side("b"), keys, window, bin_size, ("a", "b")), a, [*keys, "a"], bin_size / rate)


def at_index(rows: DataFrame, values: DataFrame, keys, t: str, rate: float, row: str = "pos_idx") -> DataFrame:
    """rows with the columns of values (keys, row and more) at the sample of their time: time by rate, rounded half to even. Rows without a sample go."""
    return rows.withColumn(row, F.bround(F.col(t) * rate).cast("long")).join(values, [*keys, row])


def normalised(counts: DataFrame, keys, n: str = "n") -> DataFrame:
    """share: a correlogram's counts by the number of all pairs it counts."""
    whole = counts.groupBy(*keys).agg(F.sum(n).alias("__all"))
    return counts.join(whole, list(keys)).withColumn("share", F.col(n) / F.col("__all")).drop("__all")


def correlogram_rates(counts: DataFrame, reference: DataFrame, keys, seconds: float, n: str = "n") -> DataFrame:
    """rate: a correlogram's counts by the number of reference spikes (keys) and the bin's seconds, in Hz."""
    size = reference.groupBy(*keys).agg(F.count("*").alias("__r"))
    return counts.join(size, list(keys)).withColumn("rate", F.col(n) / (F.col("__r") * seconds)).drop("__r")
