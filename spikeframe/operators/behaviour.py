"""Cleaning and sequence operators on tracking data. keys: grouping columns of a session; order: a unique order in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import in_groups


def over(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def onward(keys: list[str], order: list[str]):
    """From the row itself to the end, in falling order: last() over it is the next value, in one pass."""
    return Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions dealt to as many tasks as a shuffle may have, which adaptive execution doesn't merge: a task that sorts several times holds its rows once for each sort."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def speed(df: DataFrame, keys, order, x="x", y="y", t="t", out="speed") -> DataFrame:
    """Distance to the row before by the time between; null in a session's first row."""
    w = over(keys, order)
    dist = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return df.withColumn(out, F.try_divide(dist, F.col(t) - F.lag(t).over(w)))


def remove_jumps(df: DataFrame, limit: float, columns=("x", "y"), speed_col="speed") -> DataFrame:
    """Nulls columns where the speed is above limit; rows without a speed stay."""
    bad = F.coalesce(F.col(speed_col) > limit, F.lit(False))
    return df.withColumns({c: F.when(~bad, F.col(c)) for c in columns})


def remove_far_beads(df: DataFrame, limit: float = 40.0, left=("x_left", "y_left"), right=("x_right", "y_right")) -> DataFrame:
    """Nulls both beads where they are further apart than limit pixels."""
    near = F.hypot(F.col(left[0]) - F.col(right[0]), F.col(left[1]) - F.col(right[1])) <= limit
    return df.withColumns({c: F.when(near, F.col(c)) for c in (*left, *right)})


def running(df: DataFrame, keys, order, cut: float, x="x", y="y", t="t") -> DataFrame:
    """Running flag from the mean of the steps before and after a sample."""
    w = over(keys, order)
    back = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    ahead = F.hypot(F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y))
    return df.withColumn("step", (back + ahead) / 2).withColumn("running", F.coalesce(F.col("step") > cut, F.lit(False)))


def interpolate(df: DataFrame, keys, order, column: str | list[str], row="idx") -> DataFrame:
    """Linear by row number between known values; leading gaps stay null, trailing ones hold the last value. Several columns share one sort each way."""
    df, columns = dealt(df, keys), [column] if isinstance(column, str) else column
    before, after, found, filled = over(keys, order).rowsBetween(Window.unboundedPreceding, 0), onward(keys, order), {}, {}
    for k, c in enumerate(columns):
        known = F.last(F.when(F.col(c).isNotNull(), F.struct(F.col(row).alias("i"), F.col(c).alias("v"))), ignorenulls=True)
        found |= {f"__a{k}": known.over(before), f"__b{k}": known.over(after)}
        a, b = F.col(f"__a{k}"), F.col(f"__b{k}")
        line = a["v"] + (b["v"] - a["v"]) * F.try_divide(F.col(row) - a["i"], b["i"] - a["i"])
        filled[c] = F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.coalesce(line, F.when(b.isNull(), a["v"])))
    return df.withColumns(found).withColumns(filled).drop(*found)


def bead_tracking(df: DataFrame, keys, order, row="idx", left=("x_left", "y_left"), right=("x_right", "y_right")) -> DataFrame:
    """x and y, the middle of both beads, and hd, the direction from the left bead to the right one in degrees.

    Where a bead is missing all three are interpolated by row number, hd along the line and not the circle.
    """
    (xl, yl), (xr, yr) = left, right
    hd = F.degrees(F.atan2(F.col(yr) - F.col(yl), F.col(xr) - F.col(xl)))
    df = df.withColumns({"x": (F.col(xl) + F.col(xr)) / 2, "y": (F.col(yl) + F.col(yr)) / 2, "hd": hd})
    return interpolate(df, keys, order, ["x", "y", "hd"], row)


def heading(df: DataFrame, keys, order, x="x", y="y", out="heading", pad=True) -> DataFrame:
    """Direction of travel in degrees, 0 to 360; a session's first value repeats the second when padded."""
    w = over(keys, order)
    angle = F.degrees(F.atan2(F.col(y) - F.lag(y).over(w), F.col(x) - F.lag(x).over(w))) + 180
    df = df.withColumn(out, angle)
    return df.withColumn(out, F.coalesce(F.col(out), F.lead(out).over(w))) if pad else df


def to_origin(df: DataFrame, keys, pixel_ratio: float, x="x_px", y="y_px") -> DataFrame:
    """Pixel columns from 0, and x, y in cm."""
    w = Window.partitionBy(*keys)
    df = df.withColumns({x: F.col(x) - F.min(x).over(w), y: F.col(y) - F.min(y).over(w)})
    return df.withColumns({"x": F.col(x) / pixel_ratio * 100, "y": F.col(y) / pixel_ratio * 100})


def upsample(df: DataFrame, keys, order, columns: list[str], k: int) -> DataFrame:
    """k rows for each, linear towards the next row; the last row is held."""
    w = over(keys, order)
    df = df.withColumns({f"__{c}": F.coalesce(F.lead(c).over(w), F.col(c)) for c in columns})
    df = df.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return df.withColumns({c: F.col(c) + (F.col(f"__{c}") - F.col(c)) * F.col("sub") / k for c in columns}).drop(*(f"__{c}" for c in columns))


def edges(df: DataFrame, keys, order, signal: str, threshold: Column) -> DataFrame:
    """on, and edge: 1 where the signal rises over the threshold, -1 where it falls."""
    w = over(keys, order)
    df = df.withColumn("on", (F.col(signal) > threshold).cast("int"))
    return df.withColumn("edge", F.coalesce(F.col("on") - F.lag("on").over(w), F.lit(0)))


def led_threshold(df: DataFrame, keys, signal: str, deviations: float = 4.0) -> DataFrame:
    """threshold: the median of a group's signal + deviations * its standard deviation (population)."""
    level = df.groupBy(*keys).agg((F.percentile(signal, F.lit(0.5)) + deviations * F.stddev_pop(signal)).alias("threshold"))
    return df.join(level, list(keys))


def runs(df: DataFrame, keys, index: str) -> DataFrame:
    """Start and end of runs of consecutive integers."""
    w = over(keys, [index])
    island = F.col(index) - F.row_number().over(w)
    return df.withColumn("__g", island).groupBy(*keys, "__g").agg(F.min(index).alias("start"), F.max(index).alias("end")).drop("__g")


def trials(df: DataFrame, keys, order, x="x", drop=20.0, index: str | None = None, apart: float = 0.0) -> DataFrame:
    """Trial number from 1: a new trial starts where the position falls by more than drop.

    With index and apart, of starts closer than apart (in index) only the last of each close series counts.
    """
    w = over(keys, order)
    new = F.when(F.col(x) - F.lag(x).over(w) < -drop, 1).otherwise(0)
    df = df.withColumn("__n", new)
    if index:
        nxt = F.last(F.when(F.col("__n") == 1, F.col(index)), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn("__next", nxt).withColumn("__n", F.when(F.coalesce(F.col("__next") - F.col(index) < apart, F.lit(False)), 0).otherwise(F.col("__n"))).drop("__next")
    return df.withColumn("trial", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("__n")


def velocity(df: DataFrame, keys, order, x: str, index: str, lag: int, mask: int, drop: float = 20.0, scale: float = 5.0) -> DataFrame:
    """velocity: the change of x over lag rows, by scale. Rows within mask of a trial's start are interpolated from those beside them."""
    df, w = dealt(df, keys), over(keys, order)
    start = F.when(F.col(x) - F.lag(x).over(w) < -drop, F.col(index))
    df = df.withColumns({"velocity": F.col(x) - F.lag(x, lag).over(w), "__start": start})
    last = F.last("__start", ignorenulls=True)
    df = df.withColumns({"__before": last.over(w.rowsBetween(Window.unboundedPreceding, 0)), "__after": last.over(onward(keys, order))})
    near = F.coalesce(F.col(index) - F.col("__before") <= mask, F.lit(False)) | F.coalesce(F.col("__after") - F.col(index) <= mask, F.lit(False))
    df = df.withColumn("velocity", F.when(~near, F.col("velocity"))).drop("__start", "__before", "__after")
    return interpolate(df, keys, order, "velocity", index).withColumn("velocity", F.col("velocity") * scale)


def restart_floor(df: DataFrame, keys, order, value: str) -> DataFrame:
    """Values below the median of the running minimum are raised to it."""
    low = F.min(value).over(over(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("__low", low)
    med = df.groupBy(*keys).agg(F.percentile("__low", F.lit(0.5)).alias("__med"))
    return df.join(med, keys).withColumn(value, F.greatest(value, "__med")).drop("__low", "__med")


def running_mean(df: DataFrame, keys, order, value: str, n: int, out: str) -> DataFrame:
    """Mean of the last n rows; the first n - 1 rows keep the raw value."""
    w = over(keys, order)
    return df.withColumn(out, F.when(F.row_number().over(w) < n, F.col(value)).otherwise(F.avg(value).over(w.rowsBetween(-(n - 1), 0))))


def rolling_circular(hist: DataFrame, keys, bins: int, window: int, value="n") -> DataFrame:
    """Sum of the window of odd width centred at each bin, wrapping; missing bins count as 0."""
    half = window // 2
    spread = hist.withColumn("bin", F.explode(F.transform(F.sequence(F.lit(-half), F.lit(window - half - 1)), lambda d: F.pmod(F.col("bin") + d, F.lit(bins)))))
    return spread.groupBy(*keys, "bin").agg(F.sum(value).alias(value))


def gaussian_smooth(series: DataFrame, keys, index: str, value: str, sd: float) -> DataFrame:
    """Gaussian-weighted mean over +-4 sd of the rows that exist; nulls are left out."""
    reach = int(4 * sd)
    spread = series.where(F.col(value).isNotNull()).select(*keys, F.col(index).alias("__i"), value).withColumn(index, F.explode(F.sequence(F.col("__i") - reach, F.col("__i") + reach)))
    weight = F.exp(-F.pow(F.col(index) - F.col("__i"), F.lit(2)) / (2 * sd * sd))
    smooth = spread.groupBy(*keys, index).agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("smooth"))
    return series.join(smooth, [*keys, index], "left")


def kernel_weights(sd: float):
    """Gaussian weights over +-4 sd that sum to 1."""
    import numpy as np

    reach = int(4 * sd + 0.5)
    w = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sd * sd))
    return w / w.sum()


def smoothed(df: DataFrame, keys, index: str, value: str, sd: float, edges: str = "reflect", out: str = "smooth", chunk: int = 100_000) -> DataFrame:
    """Gaussian-weighted mean over +-4 sd of a series whose index goes from 0 without repeats; nulls and missing rows are left out.

    edges: 'reflect' continues the series by its mirror image at both ends, 'zero' by zeros. The series is cut into chunks of the index; rows near
    an end of a chunk, or of the series, are sent to the chunk beside it too, so a series of any length is many groups.
    """
    import numpy as np
    import pandas as pd

    w = kernel_weights(sd)
    reach = len(w) // 2
    size = df.groupBy(*keys).agg((F.max(index) + 1).cast("long").alias("__n"))
    rows = df.select(*keys, F.col(index).cast("long").alias("__i"), F.col(value).cast("double").alias("__v")).join(size, list(keys))
    i, n = F.col("__i"), F.col("__n")
    places = F.array(i)
    if edges == "reflect":
        turns = F.sequence(-F.ceil(F.lit(reach) / (2 * n)) - 1, F.ceil(F.lit(reach) / (2 * n)) + 1)
        images = F.concat(F.transform(turns, lambda k: i + 2 * n * k), F.transform(turns, lambda k: 2 * n * k - 1 - i))
        places = F.when((i >= reach) & (i < n - reach), places).otherwise(F.filter(images, lambda at: (at >= -reach) & (at < n + reach)))
    rows = rows.withColumn("__at", F.explode(places))
    last = F.floor((n - 1) / chunk)
    first_c, last_c = F.greatest(F.lit(0).cast("long"), F.floor((F.col("__at") - reach) / chunk)), F.least(last, F.floor((F.col("__at") + reach) / chunk))
    rows = rows.withColumn("__c", F.explode(F.when(first_c <= last_c, F.sequence(first_c, last_c)).otherwise(F.array().cast("array<bigint>"))))

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """Series lie one after the other, each with its reach on both sides, so one convolution smooths them all."""
        parts = []
        at, i, c, total = (pdf[name].to_numpy() for name in ("__at", "__i", "__c", "__n"))
        value = pdf["__v"].to_numpy(float)
        wide = np.minimum((c[starts] + 1) * chunk, total[starts]) - c[starts] * chunk + 2 * reach
        size, end = np.cumsum(wide), 0
        while end < len(starts):
            k = end
            end = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + 4_000_000, "right")))
            a, b = int(starts[k]), int(starts[end]) if end < len(starts) else len(pdf)
            own = starts[k:end]
            first = np.cumsum(wide[k:end]) - wide[k:end]
            group = np.repeat(np.arange(end - k), np.diff(np.append(own, b)))
            low = c[a:b] * chunk
            values = np.full(int(wide[k:end].sum()), np.nan)
            values[first[group] + at[a:b] - low + reach] = value[a:b]
            if edges == "zero":
                start, high = c[own] * chunk, np.minimum((c[own] + 1) * chunk, total[own])
                before, after = np.maximum(0, reach - start), np.maximum(0, high + reach - total[own])
                for d in range(reach):
                    values[(first + d)[d < before]] = 0.0
                    values[(first + wide[k:end] - 1 - d)[d < after]] = 0.0
            known = ~np.isnan(values)
            sums, share = np.convolve(np.where(known, values, 0.0), w, "same"), np.convolve(known.astype(float), w, "same")
            mine = (at[a:b] == i[a:b]) & (i[a:b] >= low) & (i[a:b] < np.minimum(low + chunk, total[a:b]))
            where = (first[group] + i[a:b] - low + reach)[mine]
            with np.errstate(invalid="ignore", divide="ignore"):
                result = np.where(share[where] > 1e-12, sums[where] / share[where], np.nan)
            parts.append(pdf[[*keys, "__i"]].iloc[a:b][mine].assign(**{out: result}))
        return pd.concat(parts, ignore_index=True)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    found = in_groups(rows, [*keys, "__c"], run, f"{kinds}, __i long, {out} double").withColumn(out, F.nanvl(out, F.lit(None).cast("double")))
    return df.join(found.withColumnRenamed("__i", index), [*keys, index], "left")
