"""Filters that keep, tag or drop rows. A condition that is null counts as not met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the condition, and all others."""
    met = F.coalesce(condition, F.lit(False))
    return df.where(met), df.where(~met)


def paired(df: DataFrame, a: str, b: str, zeros: bool = True) -> DataFrame:
    """Rows in which both columns are finite numbers, and other than 0 unless zeros may stay."""
    for c in (a, b):
        x = F.col(c).cast("double")
        df = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        df = df if zeros else df.where(x != 0)
    return df


def pulse_epoch(df: DataFrame, pulses: DataFrame, keys, t: str, pulse: str, margin: int = 0) -> DataFrame:
    """during: from the session's first pulse on; near: from margin before it to margin after the last. Sessions without pulses: false."""
    bounds = pulses.groupBy(*keys).agg(F.min(pulse).alias("__lo"), F.max(pulse).alias("__hi"))
    df = df.join(bounds, keys, "left")
    during, near = F.col(t) >= F.col("__lo"), F.col(t).between(F.col("__lo") - margin, F.col("__hi") + margin)
    return df.withColumns({"during": F.coalesce(during, F.lit(False)), "near": F.coalesce(near, F.lit(False))}).drop("__lo", "__hi")


def outlier_snippets(snippets: DataFrame, keys, snippet: str, waveform: str, deviations: float = 3.0) -> DataFrame:
    """Snippets with a sample above the mean + deviations * sd (population) of that sample over the group's snippets."""
    samples = snippets.select(*keys, snippet, F.posexplode(waveform).alias("__pos", "__v")).withColumn("__v", F.col("__v").cast("double"))
    limits = samples.groupBy(*keys, "__pos").agg((F.avg("__v") + deviations * F.stddev_pop("__v")).alias("__most"))
    return samples.join(limits, [*keys, "__pos"]).where(F.col("__v") > F.col("__most")).select(*keys, snippet).distinct()


def quiet_snippets(snippets: DataFrame, waveform: str, most: float = 0.0025) -> DataFrame:
    """Snippets in which no sample exceeds most in size; empty waveforms stay, null ones go."""
    return snippets.where(F.forall(waveform, lambda v: F.abs(v) <= most))


def tag_listed(df: DataFrame, listed: DataFrame, parts: list[Column], name: str, tag: str) -> DataFrame:
    """tag: whether the id composed of parts is among the values of listed's column name."""
    marks = listed.select(F.col(name).alias("__id")).where("__id is not null").distinct().withColumn(tag, F.lit(True))
    return df.withColumn("__id", F.concat_ws("-", *parts)).join(marks, "__id", "left").withColumn(tag, F.coalesce(tag, F.lit(False))).drop("__id")


def zones(df: DataFrame, x: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """One row for each zone [low, high) that holds the position; rows in none go."""
    hit = [F.when((F.col(x) >= low) & (F.col(x) < high), F.lit(name)) for name, (low, high) in bounds.items()]
    return df.withColumn("zone", F.explode(F.array_compact(F.array(*hit))))


def population_fields(fields: DataFrame, types: DataFrame, cell_keys, accepted: str = "accepted", spikes: str = "n_spikes", least: int = 400, wanted=("grid",), border: bool | None = None) -> DataFrame:
    """Fields that enter a comparison of populations: accepted, of a cell whose type (types: cell_keys, cell_type) is wanted, with more than least spikes.

    border: only fields with that value of the column border. Nulls count as not met.
    """
    kept = fields.join(types.select(*cell_keys, "cell_type"), list(cell_keys)).where(F.col(accepted) & F.col("cell_type").isin(*wanted) & (F.col(spikes) > least))
    return kept if border is None else kept.where(F.col("border") == border)


def border_fields(bins: DataFrame, keys, extent: DataFrame, map_keys) -> DataFrame:
    """border: whether a field has a bin in the first or last row or column of its map (extent: nx and ny by map_keys)."""
    edge = (F.col("bin_x") == 0) | (F.col("bin_y") == 0) | (F.col("bin_x") == F.col("nx") - 1) | (F.col("bin_y") == F.col("ny") - 1)
    return bins.join(extent, map_keys).groupBy(*keys).agg(F.bool_or(edge).alias("border"))


def square_arena(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Drops the less populated 1-pixel edge of the longer axis until both extents, by rounded pixels, are equal; of equal edges the left or the upper one. Null positions go.

    The left edge is what lies below the lowest rounded pixel + 1, the right one what lies above the highest - 1. Where a position falls depends on its whole
    number and on its fraction being 0, below, at or above a half, so a session is the counts of such cells. A cell is visited once, when its edge goes.
    """
    import numpy as np
    import pandas as pd

    def cell(c: str) -> Column:
        low = F.floor(c)
        part = F.col(c) - low
        return low * 4 + F.when(part == 0, 0).when(part < 0.5, 1).when(part == 0.5, 2).otherwise(3)

    def nearest(at: int) -> int:
        low, part = divmod(int(at), 4)
        return low + (part == 3 or (part == 2 and low % 2 == 1))

    schema = df.select(*keys).schema
    names = [f.name for f in schema]
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"__x": cell(x), "__y": cell(y)})
    counts = known.groupBy(*keys, "__x", "__y").agg(F.count("*").alias("__n"))

    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        n, alive = pdf["__n"].to_numpy(np.int64), np.ones(len(pdf), bool)
        values, at = zip(*(np.unique(pdf[c], return_inverse=True) for c in ("__x", "__y")), strict=True)
        order = [np.argsort(a, kind="stable") for a in at]
        starts = [np.searchsorted(a[o], np.arange(len(v) + 1)) for a, o, v in zip(at, order, values, strict=True)]
        sums = [np.zeros(len(v), np.int64) for v in values]
        for k in (0, 1):
            np.add.at(sums[k], at[k], n)
        low, high = [0, 0], [len(v) - 1 for v in values]
        while True:
            for k in (0, 1):
                while low[k] <= high[k] and not sums[k][low[k]]:
                    low[k] += 1
                while low[k] <= high[k] and not sums[k][high[k]]:
                    high[k] -= 1
            if low[0] > high[0]:
                return pd.DataFrame({**{c: pdf[c].iloc[:0] for c in names}, **{c: pd.Series(dtype="int64") for c in ("x0", "x1", "y0", "y1")}})
            ends = [(nearest(values[k][low[k]]), nearest(values[k][high[k]])) for k in (0, 1)]
            wide = [b - a for a, b in ends]
            if wide[0] == wide[1]:
                break
            k = int(wide[1] > wide[0])
            first, last = np.searchsorted(values[k], 4 * (ends[k][0] + 1)), np.searchsorted(values[k], 4 * (ends[k][1] - 1), "right")
            at_low, at_high = sums[k][low[k] : first].sum(), sums[k][last : high[k] + 1].sum()
            gone = (low[k], first) if (at_low < at_high or (at_low == at_high and k == 0)) else (last, high[k] + 1)
            rows = order[k][starts[k][gone[0]] : starts[k][gone[1]]]
            rows = rows[alive[rows]]
            alive[rows] = False
            np.subtract.at(sums[1 - k], at[1 - k][rows], n[rows])
            sums[k][gone[0] : gone[1]] = 0
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in names), values[0][low[0]], values[0][high[0]], values[1][low[1]], values[1][high[1]]]], columns=[*names, "x0", "x1", "y0", "y1"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    limits = counts.groupBy(*keys).applyInPandas(bounds, f"{kinds}, x0 long, x1 long, y0 long, y1 long")
    kept = known.join(limits, list(keys)).where(F.col("__x").between(F.col("x0"), F.col("x1")) & F.col("__y").between(F.col("y0"), F.col("y1")))
    return kept.drop("__x", "__y", "x0", "x1", "y0", "y1")


def curated(clusters: DataFrame, isolation: float = 0.9, overlap: float = 0.05, snr: float = 1.0, manual: str | None = None) -> DataFrame:
    """is_good: a cluster above isolation and snr, below overlap of noise, and with spikes; a missing metric means noise.

    manual: a column that is true where a cluster was curated by hand; such clusters are good whatever their metrics.
    """
    good = (F.col("isolation") > isolation) & (F.col("noise_overlap") < overlap) & (F.col("peak_snr") > snr) & (F.col("mean_firing_rate") > 0)
    good = F.coalesce(good, F.lit(False))
    return clusters.withColumn("is_good", good | F.coalesce(F.col(manual), F.lit(False)) if manual else good)


def cell_types(cells: DataFrame, hd: str = "hd_score", grid: str = "grid_score", hd_least: float = 0.5, grid_least: float = 0.4) -> DataFrame:
    """cell_type: conjunctive, hd, grid or na by the two scores; a missing score is below its bound."""
    h, g = F.coalesce(F.col(hd) >= hd_least, F.lit(False)), F.coalesce(F.col(grid) >= grid_least, F.lit(False))
    return cells.withColumn("cell_type", F.when(h & g, "conjunctive").when(h, "hd").when(g, "grid").otherwise("na"))


def spatial_labels(scores: DataFrame, cutoffs: DataFrame, keys, border: float = 0.5, hd: float = 0.2) -> DataFrame:
    """Flags grid, border, hd, hd_rayleigh, spatial and speed of cells, and label G, B, NG, HD or NS by the first that holds.

    scores: grid_score, border_score, hd_score, rayleigh_p, spatial_information, speed_score; cutoffs: the shuffles' cutoffs under the
    same names with _cutoff, by keys. A missing score or cutoff means no.
    """
    return labelled(scores.join(cutoffs, list(keys), "left"), border, hd)


def labelled(df: DataFrame, border: float = 0.5, hd: float = 0.2) -> DataFrame:
    """spatial_labels of rows that have scores and cutoffs."""
    over = lambda c: F.coalesce(F.col(c) > F.col(f"{c}_cutoff"), F.lit(False))
    flags = {
        "grid": over("grid_score"),
        "border": over("border_score") & F.coalesce(F.col("border_score") > border, F.lit(False)),
        "hd": over("hd_score") & F.coalesce(F.col("hd_score") > hd, F.lit(False)),
        "hd_rayleigh": F.coalesce(F.col("rayleigh_p") < F.col("rayleigh_p_cutoff"), F.lit(False)),
        "spatial": over("spatial_information"),
        "speed": F.coalesce(F.abs("speed_score") > F.abs("speed_score_cutoff"), F.lit(False)),
    }
    df = df.withColumns(flags)
    return df.withColumn("label", F.when(F.col("grid"), "G").when(F.col("border"), "B").when(F.col("spatial"), "NG").when(F.col("hd"), "HD").otherwise("NS"))
