"""Firing by trial and track bin, resampled directions, and interval sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trial_rates(spikes: DataFrame, samples: DataFrame, session_keys, cell_keys, dt: float) -> DataFrame:
    """Spikes, dwell and rate of each cell for every trial and bin that its session visited."""
    dwell = samples.groupBy(*session_keys, "trial", "bin").agg((F.count("*") * dt).alias("dwell"))
    fired = spikes.groupBy(*cell_keys, "trial", "bin").agg(F.count("*").alias("n"))
    grid = spikes.select(*cell_keys).distinct().join(dwell, session_keys)
    out = grid.join(fired, [*cell_keys, "trial", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("dwell")), F.lit(0.0)))


def track_maps(rates: DataFrame, keys) -> DataFrame:
    """Rate over all trials of a key, and the standard error of the rates by trial; null for one trial."""
    sem = F.try_divide(F.stddev_samp("rate"), F.sqrt(F.count("rate")))
    return rates.groupBy(*keys).agg(F.try_divide(F.sum("n").cast("double"), F.sum("dwell")).alias("rate"), sem.alias("sem"))


def resampled_directions(spikes: DataFrame, position: DataFrame, session_keys, cell_keys, n: int, bins: int) -> DataFrame:
    """Direction histograms of n shuffles in which each spike takes the direction of a sample drawn from its session.

    Draws come from the spike's index by portable arithmetic, so a retried task gives the same rows.
    """
    size = position.groupBy(*session_keys).agg(F.count("*").alias("__n"))
    draws = spikes.join(size, session_keys).withColumn("shuffle_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draw = F.pmod(F.col("spike_idx") * 48271 + F.col("shuffle_id").cast("long") * 2654435, F.lit(1000003)) * F.col("__n")
    draws = draws.withColumn("pos_idx", F.floor(draw / 1000003))
    hit = draws.select(*cell_keys, "shuffle_id", "pos_idx").join(position.select(*session_keys, "pos_idx", "hd"), [*session_keys, "pos_idx"])
    at = F.least(F.floor((F.col("hd") + 180) / (360 // bins)), F.lit(bins - 1))
    return hit.groupBy(*cell_keys, "shuffle_id", at.alias("bin")).agg(F.count("*").alias("n"))


def interval_sweep(df: DataFrame, keys, low: str, high: str) -> DataFrame:
    """How many intervals [low, high) hold each of their ends."""
    ends = df.select(*keys, F.explode(F.array(F.struct(F.col(low).alias("edge"), F.lit(1).alias("w")), F.struct(F.col(high).alias("edge"), F.lit(-1).alias("w")))).alias("e"))
    breaks = ends.groupBy(*keys, F.col("e.edge").alias("edge")).agg(F.sum("e.w").alias("w"))
    return breaks.withColumn("weight", F.sum("w").over(Window.partitionBy(*keys).orderBy("edge"))).drop("w")


def goal_aligned(rates: DataFrame, goals: DataFrame, keys, cell_keys, width: float) -> DataFrame:
    """(cell_keys, trial_type, bin, rate): mean rate by bins relative to each trial's goal. rates: cell_keys, trial, bin, rate; goals: keys, trial, trial_type, goal."""
    moved = rates.join(goals, [*keys, "trial"]).withColumn("bin", F.col("bin") - F.floor(F.col("goal") / width))
    return moved.groupBy(*cell_keys, "trial_type", "bin").agg(F.avg(F.when(F.abs("rate") < float("inf"), F.col("rate")).otherwise(0.0)).alias("rate"))


def by_goal(goals: DataFrame, keys) -> DataFrame:
    """place: a trial's number from 1 in falling order of its goal; the earlier of equal ones first."""
    return goals.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("goal"), "trial")))


def shifted_bins(bins: DataFrame, right: int, up: int, wide: int, high: int) -> DataFrame:
    """Bins of maps of wide columns (bin_x) and high rows (bin_y) moved to the right and up (rows count from the top); those outside go."""
    moved = bins.withColumns({"bin_x": F.col("bin_x") + right, "bin_y": F.col("bin_y") - up})
    return moved.where(F.col("bin_x").between(0, wide - 1) & F.col("bin_y").between(0, high - 1))


def labelled_times(cells: DataFrame, keys, times: str, label: str) -> DataFrame:
    """One row (keys, t, label) per firing time of cells with an array of them."""
    return cells.select(*keys, F.explode(times).alias("t"), F.col(label).alias("label"))


def time_arrays(rows: DataFrame, keys, times: str = "firing_times") -> DataFrame:
    """Rows (keys, t, label) back to one array of rising times per label."""
    return rows.groupBy(*keys, "label").agg(F.sort_array(F.collect_list("t")).alias(times))
