"""Synchronisation of two streams, sequential jump removal, and the latency test of responses to pulses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def best_lag(a: DataFrame, b: DataFrame, keys, index: str, most: int) -> DataFrame:
    """Lag of b behind a (at most most samples either way) with the most coinciding on-samples, the smallest lag on ties.

    a and b hold the indices of samples that are on. They meet by buckets of most samples.
    """
    left = a.select(*keys, F.col(index).alias("__i")).withColumn("__b", F.floor(F.col("__i") / most))
    right = b.select(*keys, F.col(index).alias("__j")).withColumn("__b", F.explode(F.array(*(F.floor(F.col("__j") / most) + s for s in (-1, 0, 1)))))
    lag = (F.col("__j") - F.col("__i")).alias("lag")
    counts = left.join(right, [*keys, "__b"]).where(F.abs(F.col("__j") - F.col("__i")) <= most).groupBy(*keys, lag).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by("lag", F.struct(-F.col("n"), F.col("lag"))).alias("lag"), F.max("n").alias("n"))


def sequential_jumps(df: DataFrame, keys, order: str, x: str, y: str, t: str, most: float, chunk: int = 50_000) -> DataFrame:
    """accepted: false where the speed from the last accepted sample is above most, or a coordinate is missing.

    order: a numeric column, unique in a session. The last accepted sample passes from row to row, but samples soon agree whichever it was, so chunks of the order run
    by themselves: first as if the last sample before them had been accepted, then those again for which another one was, until all seams
    agree. Each round puts right the first seam that is wrong at least. A chunk is one group; nothing larger is.
    """
    import numpy as np
    import pandas as pd

    kept = cut(df.withColumn("__c", F.floor(F.col(order) / chunk)))
    numbers = kept.select(*keys, "__c", F.col(order).alias("__o"), *(F.col(c).cast("double").alias(n) for c, n in ((x, "__x"), (y, "__y"), (t, "__t"))))
    far = Window.partitionBy(*keys).orderBy("__c")
    place = "struct<__x:double,__y:double,__t:double>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__o")
        xs, ys, ts = (pdf[c].to_numpy(float) for c in ("__x", "__y", "__t"))
        entry = pdf["__entry"].iloc[0]
        last = (entry["__x"], entry["__y"], entry["__t"]) if entry else None
        ok = np.zeros(len(pdf), bool)
        for i in np.flatnonzero(~(np.isnan(xs) | np.isnan(ys) | np.isnan(ts))).tolist():
            if last is None or np.hypot(xs[i] - last[0], ys[i] - last[1]) <= most * (ts[i] - last[2]):
                ok[i], last = True, (float(xs[i]), float(ys[i]), float(ts[i]))
        out = pdf.drop(columns=["__x", "__y", "__t", "__entry"]).assign(accepted=ok)
        out["__exit"] = [dict(zip(("__x", "__y", "__t"), last, strict=True)) if last else None] * len(out)
        return out

    def ran(entries: DataFrame) -> DataFrame:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbers.select(*keys, "__c", "__o").schema)
        return cut(numbers.join(entries, [*keys, "__c"]).groupBy(*keys, "__c").applyInPandas(run, f"{kinds}, accepted boolean, __exit {place}"))

    whole = numbers.where("__x is not null and __y is not null and __t is not null")
    tails = numbers.select(*keys, "__c").distinct().join(whole.groupBy(*keys, "__c").agg(F.max_by(F.struct("__x", "__y", "__t"), "__o").alias("__tail")), [*keys, "__c"], "left")
    entries = cut(tails.withColumn("__entry", F.last("__tail", ignorenulls=True).over(far.rowsBetween(Window.unboundedPreceding, -1))).drop("__tail"))
    done = ran(entries)
    while True:
        exits = done.groupBy(*keys, "__c").agg(F.first("__exit").alias("__exit")).withColumn("__next", F.lag("__exit").over(far))
        wrong = cut(entries.join(exits, [*keys, "__c"]).where(~F.col("__entry").eqNullSafe(F.col("__next"))).select(*keys, "__c", F.col("__next").alias("__entry")))
        if wrong.isEmpty():
            break
        done = cut(done.join(wrong.select(*keys, "__c"), [*keys, "__c"], "left_anti").unionByName(ran(wrong)))
        entries = cut(entries.join(wrong.select(*keys, "__c"), [*keys, "__c"], "left_anti").unionByName(wrong))
    return kept.join(done.select(*keys, F.col("__o").alias(order), "accepted"), [*keys, order]).drop("__c")


def correlation_lag(a: DataFrame, b: DataFrame, keys, index: str, block: int = 1 << 16) -> DataFrame:
    """(keys, lag, n): how far b is behind a, over all lags, by the most coinciding on-samples n; the smallest lag on ties.

    a and b hold the indices of samples that are on. Both streams are cut into blocks, and each pair of blocks with samples gives its part of the
    cross-correlation by one product of spectra; parts are summed by lag. A pair of blocks is one group, whatever the streams' lengths.
    """
    import numpy as np
    import pandas as pd

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys, F.floor(F.col(index) / block).alias(f"__{name}")).agg(F.collect_list((F.col(index) % block).cast("int")).alias(f"__on_{name}"))

    def run(batches):
        for batch in batches:
            for _, row in batch.iterrows():
                x, y = np.zeros(block), np.zeros(block)
                np.add.at(x, np.asarray(row["__on_a"]), 1.0)
                np.add.at(y, np.asarray(row["__on_b"]), 1.0)
                n = np.rint(np.fft.irfft(np.conj(np.fft.rfft(x, 2 * block)) * np.fft.rfft(y, 2 * block), 2 * block)).astype(np.int64)
                at = np.flatnonzero(n)
                lag = np.where(at < block, at, at - 2 * block) + (int(row["__b"]) - int(row["__a"])) * block
                yield pd.DataFrame({**{k: [row[k]] * len(at) for k in keys}, "lag": lag, "n": n[at]})

    pairs = blocks(a, "a").join(blocks(b, "b"), list(keys))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in a.select(*keys).schema)
    counts = pairs.mapInPandas(run, f"{kinds}, lag long, n long").groupBy(*keys, "lag").agg(F.sum("n").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by("lag", F.struct(-F.col("n"), F.col("lag"))).alias("lag"), F.max("n").alias("n"))


def synchronised(pulses: DataFrame, tracking: DataFrame, keys, index: str, t: str, level: str, least: float = 2.0, deviations: float = 6.0, skip: float = 19.0, most: float = 2.5) -> DataFrame:
    """tracking with synced_time, its time in that of pulses, and (lag samples, coarse, fine seconds, ok); both have keys, index, t and level and one sampling rate.

    pulses are on at least or above, tracking above its median + deviations * its standard deviation. The lag of the highest cross-correlation gives
    the coarse shift. After skip seconds, the last samples before the first one that is on give the fine shift. A session is not ok, and its synced_time null,
    where fine isn't below most, a stream is on at once after skip, or nothing is on. Times below 0 go.
    """
    keys = list(keys)
    span = tracking.groupBy(*keys).agg(((F.max(t) - F.min(t)) / (F.count("*") - 1)).alias("__dt"), (F.percentile(level, F.lit(0.5)) + deviations * F.stddev_pop(level)).alias("__level"))
    seen = tracking.join(span, keys)
    on_b, on_a = seen.where(F.col(level) >= F.col("__level")), pulses.where(F.col(level) >= least)
    shift = span.join(correlation_lag(on_a, on_b, keys, index), keys, "left").select(*keys, "lag", "__level", (F.col("lag") * F.col("__dt")).alias("coarse"))
    # from the first pulse sample at skip or later, and from the tracking sample nearest to it
    start = pulses.where(F.col(t) >= skip).groupBy(*keys).agg(F.min(t).alias("__from"))

    def rise(df: DataFrame, time: Column, on: Column, name: str) -> DataFrame:
        """The time of the last sample before the first one that is on, from the sample nearest to __from."""
        df = df.join(start, keys).withColumns({"__time": time, "__on": on})
        near = df.groupBy(*keys).agg(F.min_by(index, F.struct(F.abs(F.col("__time") - F.col("__from")), F.col(index))).alias("__i0"))
        df = df.join(near, keys).where(F.col(index) >= F.col("__i0"))
        first = df.groupBy(*keys).agg(F.min(F.when(F.col("__on"), F.col(index))).alias("__i1"))
        return df.join(first, keys).where(F.col(index) == F.col("__i1") - 1).select(*keys, F.col("__time").alias(name))

    a = rise(pulses, F.col(t), F.col(level) >= least, "__ta")
    b = rise(tracking.join(shift, keys), F.col(t) - F.col("coarse"), F.col(level) >= F.col("__level"), "__tb")
    whole = shift.drop("__level").join(a, keys, "left").join(b, keys, "left").withColumn("fine", F.col("__ta") - F.col("__tb"))
    whole = whole.withColumn("ok", F.coalesce(F.abs("fine") < most, F.lit(False))).drop("__ta", "__tb")
    out = tracking.join(whole, keys).withColumn("synced_time", F.when(F.col("ok"), F.col(t) - F.col("coarse") + F.col("fine")))
    return out.where("synced_time is null or synced_time >= 0")


def latency_test(spikes: DataFrame, pulses: DataFrame, session_keys, cell_keys, bin_size: int, windows: int, steps: int = 20) -> DataFrame:
    """(cell_keys, distance, information, p): the latencies of first spikes in the window after a pulse against those in windows windows before it.

    spikes: t; pulses: pulse; both in samples. A window's histogram has steps bins, and one for pulses without a spike in it; spikes on a window's edges don't count. The distance of two
    windows is the root of twice the Jensen-Shannon divergence in which each side is compared with their mean over its own support, renormalised
    there. distance: the median to the windows before; p: the share of distances between these that are as large; information: distance less their median.
    """
    lo, hi = F.col("pulse") - windows * bin_size, F.col("pulse") + bin_size
    p = pulses.withColumn("__b", F.explode(F.sequence(F.floor(lo / bin_size), F.floor(hi / bin_size))))
    hit = spikes.withColumn("__b", F.floor(F.col("t") / bin_size)).join(p, [*session_keys, "__b"]).where((F.col("t") > lo) & (F.col("t") < hi) & ((F.col("t") - lo) % bin_size != 0))
    window = F.floor((F.col("t") - lo) / bin_size)
    first = hit.groupBy(*cell_keys, "pulse", window.alias("w")).agg(F.min((F.col("t") - lo) % bin_size).alias("at"))
    trials = pulses.groupBy(*session_keys).agg(F.count("*").alias("__n"))
    counts = first.groupBy(*cell_keys, "w", F.floor(F.col("at") * steps / bin_size).alias("step")).agg(F.count("*").alias("c"))
    # trials without a spike in a window
    some = counts.groupBy(*cell_keys, "w").agg(F.sum("c").alias("s"))
    cells = first.select(*cell_keys).distinct().withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(windows).cast("long"))))
    none = cells.join(trials, session_keys).join(some, [*cell_keys, "w"], "left").select(*cell_keys, "w", F.lit(-1).cast("long").alias("step"), (F.col("__n") - F.coalesce("s", F.lit(0))).alias("c"))
    hist = counts.union(none.where("c > 0")).join(trials, session_keys).select(*cell_keys, "w", "step", (F.col("c") / F.col("__n")).alias("p"))
    # the divergence from the bins that both windows have, and the mass that only one has
    a, b = hist.select(*cell_keys, F.col("w").alias("wa"), "step", F.col("p").alias("pa")), hist.select(*cell_keys, F.col("w").alias("wb"), "step", F.col("p").alias("pb"))
    both = a.join(b, [*cell_keys, "step"]).where("wa < wb")
    m = (F.col("pa") + F.col("pb")) / 2
    term = F.col("pa") * F.log(F.col("pa") / m) + F.col("pb") * F.log(F.col("pb") / m)
    alone = F.lit(2.0) - F.sum(F.col("pa") + F.col("pb"))
    # each side's mean is renormalised over that side's own bins, of which the other has the shared ones
    renormed = F.log((1 + F.sum("pb")) / 2) + F.log((1 + F.sum("pa")) / 2)
    shared = both.groupBy(*cell_keys, "wa", "wb").agg(F.greatest(F.lit(0.0), (F.sum(term) + alone * F.log(F.lit(2.0)) + renormed) / 2).alias("js"))
    pairs = cells.withColumnRenamed("w", "wa").join(cells.withColumnRenamed("w", "wb"), cell_keys).where("wa < wb").join(shared, [*cell_keys, "wa", "wb"], "left")
    pairs = pairs.withColumn("d", F.round(F.sqrt(2 * F.coalesce("js", F.lit(0.0))), 9))
    test = pairs.where(F.col("wb") == windows).groupBy(*cell_keys).agg(F.percentile("d", F.lit(0.5)).alias("distance"))
    null = pairs.where(F.col("wb") < windows).join(test, cell_keys)
    return null.groupBy(*cell_keys).agg(F.first("distance").alias("distance"), (F.first("distance") - F.percentile("d", F.lit(0.5))).alias("information"), F.avg((F.col("d") >= F.col("distance")).cast("double")).alias("p"))


def around_pulses(spikes: DataFrame, pulses: DataFrame, session_keys, reach: int) -> DataFrame:
    """Spikes with each pulse of their session less than reach before it or after it: offset from the pulse."""
    p = pulses.withColumn("__b", F.explode(F.sequence(F.floor((F.col("pulse") - reach) / reach), F.floor((F.col("pulse") + reach) / reach))))
    hit = spikes.withColumn("__b", F.floor(F.col("t") / reach)).join(p, [*session_keys, "__b"]).withColumn("offset", F.col("t") - F.col("pulse"))
    return hit.where((F.col("offset") >= -reach) & (F.col("offset") < reach)).drop("__b")


def peristimulus_rates(around: DataFrame, pulses: DataFrame, session_keys, cell_keys, half: int, bins: int = 100, rate: float = 30000.0) -> DataFrame:
    """(cell_keys, bin, n, hz): spikes of all pulses in equal bins from half samples before a pulse to half after it, and hz by the bin's seconds and the session's pulses.

    around: see around_pulses; each of its cells has all bins. A smaller half than the reach of around is the zoom on the pulse.
    """
    width = 2 * half / bins
    counts = around.where((F.col("offset") >= -half) & (F.col("offset") < half)).groupBy(*cell_keys, F.floor((F.col("offset") + half) / width).alias("bin")).agg(F.count("*").alias("n"))
    trials = pulses.groupBy(*session_keys).agg(F.count("*").alias("__k"))
    grid = around.select(*cell_keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    out = grid.join(counts, [*cell_keys, "bin"], "left").join(trials, list(session_keys)).na.fill(0, ["n"])
    return out.select(*cell_keys, "bin", "n", (F.col("n") / (width / rate) / F.col("__k")).alias("hz"))


def activation(around: DataFrame, cell_keys, side_ms: int, per_ms: int) -> DataFrame:
    """(cell_keys, start, end) in ms after the pulse: the first run of 1-ms bins with more spikes than the mean + 2 sd of the side_ms bins before it; single bins below don't end a run. Both 0 where no bin is above."""
    bins = around.select(*cell_keys).distinct().withColumn("ms", F.explode(F.sequence(F.lit(-side_ms), F.lit(side_ms - 1))))
    counts = around.groupBy(*cell_keys, F.floor(F.col("offset") / per_ms).cast("int").alias("ms")).agg(F.count("*").alias("n"))
    counts = bins.join(counts, [*cell_keys, "ms"], "left").na.fill(0, ["n"])
    base = counts.where("ms < 0").groupBy(*cell_keys).agg((F.avg("n") + 2 * F.stddev_pop("n")).alias("__most"))
    high = counts.where("ms >= 0").join(base, list(cell_keys)).where(F.col("n") > F.col("__most"))
    w = Window.partitionBy(*cell_keys).orderBy("ms")
    run = high.withColumn("__new", F.coalesce((F.col("ms") - F.lag("ms").over(w) > 2).cast("int"), F.lit(0))).withColumn("__run", F.sum("__new").over(w))
    found = run.where("__run = 0").groupBy(*cell_keys).agg(F.min("ms").alias("start"), (F.max("ms") + 1).alias("end"))
    return around.select(*cell_keys).distinct().join(found, list(cell_keys), "left").na.fill(0, ["start", "end"])


def inhibition(spikes: DataFrame, pulses: DataFrame, session_keys, cell_keys, latency: DataFrame | None = None, window_ms: int = 20, side_ms: int = 100, per_ms: int = 30, level: float = 0.01) -> DataFrame:
    """(cell_keys, before, after, shift, u, z, p): spikes of all pulses in window_ms before and after them, and the rank-sum test of the counts by pulse where there are fewer after.

    Cells whose latency test (cell_keys, p) is below level are counted from the end of their activation on. u: that of the counts before; p: two-sided by the normal score with corrections for
    ties and continuity. Cells without a spike around any pulse give no row.
    """
    from ..functions import distributions

    around = around_pulses(spikes, pulses, session_keys, side_ms * per_ms)
    end = activation(around, cell_keys, side_ms, per_ms).select(*cell_keys, "end")
    # rows of cells are written in between: else one task would hold the sorts and tables of all steps at once
    low = (cut(latency.select(*cell_keys, F.col("p").alias("__p"))) if latency is not None else end.select(*cell_keys, F.lit(None).cast("double").alias("__p"))).where(F.col("__p") < level)
    shift = cut(end.join(low, list(cell_keys), "left").select(*cell_keys, F.when(F.col("__p").isNotNull(), F.col("end")).otherwise(0).alias("shift")))
    size, at = window_ms * per_ms, F.col("offset") - F.col("shift") * per_ms
    hit = around.join(shift, list(cell_keys))
    per = hit.groupBy(*cell_keys, "pulse").agg(F.count_if((F.col("offset") >= -size) & (F.col("offset") < 0)).alias("before"), F.count_if((at >= 0) & (at < size)).alias("after"))
    trials = shift.select(*cell_keys).join(pulses.groupBy(*session_keys).agg(F.count("*").alias("__trials")), list(session_keys))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("before").alias("v")), F.struct(F.lit(1).alias("s"), F.col("after").alias("v"))))
    counts = per.select(*cell_keys, sides.alias("__x")).select(*cell_keys, "__x.*").where("v > 0").groupBy(*cell_keys, "v").agg(F.count_if(F.col("s") == 0).alias("a"), F.count_if(F.col("s") == 1).alias("b"))
    some = counts.groupBy(*cell_keys).agg(F.sum("a").alias("__a"), F.sum("b").alias("__b"))
    # pulses without a spike have the lowest rank; they are counted, not made
    none = trials.join(some, list(cell_keys), "left").select(*cell_keys, F.lit(0).cast("long").alias("v"), (F.col("__trials") - F.coalesce("__a", F.lit(0))).alias("a"), (F.col("__trials") - F.coalesce("__b", F.lit(0))).alias("b"))
    counts = counts.select(*cell_keys, F.col("v").cast("long").alias("v"), "a", "b").union(none)
    w = Window.partitionBy(*cell_keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    t = (F.col("a") + F.col("b")).cast("double")
    ranked = counts.withColumn("__rank", F.coalesce(F.sum(t).over(w), F.lit(0.0)) + (t + 1) / 2)
    r = ranked.groupBy(*cell_keys).agg(F.sum(F.col("a") * F.col("__rank")).alias("r"), F.sum("a").cast("double").alias("n"), F.sum(t * t * t - t).alias("ties"), F.sum(F.col("a") * F.col("v")).alias("before"), F.sum(F.col("b") * F.col("v")).alias("after"))
    n, total = F.col("n"), 2 * F.col("n")
    u = F.col("r") - n * (n + 1) / 2
    spread = F.sqrt(n * n / 12 * (total + 1 - F.try_divide(F.col("ties"), total * (total - 1))))
    z = F.try_divide(F.greatest(F.lit(0.0), F.abs(u - n * n / 2) - 0.5), spread)
    fewer = F.col("after") < F.col("before")
    r = r.withColumns({"u": F.when(fewer, u), "z": F.when(fewer, z)})
    return r.join(shift, list(cell_keys)).select(*cell_keys, "before", "after", "shift", "u", "z", distributions.gauss_p("z").alias("p"))


def best_rotation(hist: DataFrame, keys, item: str, bin_col: str, bins: int, value: str) -> DataFrame:
    """For each pair of items (a < b) the turn of b, in bins, with the highest correlation; the smallest turn on ties."""
    from ..functions.scalar import safe_corr

    a = hist.select(*keys, F.col(item).alias("a"), F.col(bin_col).alias("__bin"), F.col(value).cast("double").alias("__u"))
    b = hist.select(*keys, F.col(item).alias("b"), F.col(bin_col).alias("__raw"), F.col(value).cast("double").alias("__v"))
    b = b.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("__bin", F.pmod(F.col("__raw") + F.col("turn"), F.lit(bins)))
    r = a.join(b, [*keys, "__bin"]).where("a < b").groupBy(*keys, "a", "b", "turn").agg(F.round(safe_corr("__u", "__v"), 6).alias("r"))
    w = Window.partitionBy(*keys, "a", "b").orderBy(F.desc_nulls_last("r"), "turn")
    return r.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
