"""Sequence, set and trial operators over whole sessions. keys: grouping columns of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .behaviour import dealt, onward, over


def interpolate_circular(df: DataFrame, keys, order, column: str, row="idx") -> DataFrame:
    """Angles in degrees over gaps along the shortest arc, from -180 to 180; gaps at the ends hold the nearest value."""
    known = F.last(F.when(F.col(column).isNotNull(), F.struct(F.col(row).alias("i"), F.col(column).alias("v"))), ignorenulls=True)
    df = dealt(df, keys).withColumns({"__a": known.over(over(keys, order).rowsBetween(Window.unboundedPreceding, 0)), "__b": known.over(onward(keys, order))})
    arc = F.pmod(F.col("__b.v") - F.col("__a.v") + 180.0, F.lit(360.0)) - 180.0
    part = F.try_divide((F.col(row) - F.col("__a.i")).cast("double"), (F.col("__b.i") - F.col("__a.i")).cast("double"))
    line = F.pmod(F.col("__a.v") + arc * part + 180.0, F.lit(360.0)) - 180.0
    return df.withColumn(column, F.coalesce(F.col(column), line, F.col("__a.v"), F.col("__b.v"))).drop("__a", "__b")


def resample(df: DataFrame, keys, t: str, column: str, rate: float) -> DataFrame:
    """column on the regular grid [0, last time) of rate, linear between samples; null before the first one."""
    ends = df.groupBy(*keys).agg(F.max(t).alias("__end"))
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("__end") * rate)))
    grid = ends.withColumn("step", step).where(F.col("step") / rate < F.col("__end")).select(*keys, (F.col("step") / rate).alias("__t"), "step", F.lit(None).cast("double").alias("__v"))
    both = grid.union(df.select(*keys, F.col(t), F.lit(None).cast("long"), F.col(column).cast("double")))
    w = Window.partitionBy(*keys).orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    v = Window.partitionBy(*keys).orderBy(F.desc("__t")).rangeBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("__v").isNotNull(), F.struct(F.col("__t").alias("t"), F.col("__v").alias("v"))), ignorenulls=True)
    both = both.withColumns({"__a": at.over(w), "__b": at.over(v)}).where("step is not null")
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * F.coalesce(F.try_divide(F.col("__t") - F.col("__a.t"), F.col("__b.t") - F.col("__a.t")), F.lit(0.0))
    return both.select(*keys, "step", F.coalesce(line, F.when(F.col("__b").isNull(), F.col("__a.v"))).alias(column))


def modal(df: DataFrame, keys, value: str) -> DataFrame:
    """The most frequent value that isn't null, the smallest on ties."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(value))


def pulse_statistics(pulses: DataFrame, keys, start: str, end: str, rate: float, first: int = 2, last: int = 51) -> DataFrame:
    """(keys, width, gap in whole ms, frequency, window in ms): most frequent width and gap of pulses first to last of trains that have more than last - 1.

    frequency: 1000 / (width + gap), to one digit; window: 1000 / frequency where that is over 5 and even, else 200.
    """
    w = Window.partitionBy(*keys)
    df = pulses.withColumns({"__k": F.row_number().over(w.orderBy(start)), "__c": F.count("*").over(w), "__next": F.lead(start).over(w.orderBy(start))})
    df = df.where((F.col("__c") > last - 1) & F.col("__k").between(first, last))
    ms = lambda x: F.floor(x * 1000 / rate)
    df = df.withColumns({"width": ms(F.col(end) - F.col(start)), "gap": ms(F.col("__next") - F.col(end))})
    both = modal(df, keys, "width").join(modal(df, keys, "gap"), list(keys)).withColumn("frequency", F.round(F.try_divide(F.lit(1000.0), (F.col("width") + F.col("gap")).cast("double")), 1))
    even = (F.col("frequency") > 5) & (F.col("frequency") % 2 == 0)
    return both.withColumn("window", F.when(even, 1000 / F.col("frequency")).otherwise(200.0))


def stitched(recordings: DataFrame, keys, order: str, length: str) -> DataFrame:
    """offset: the summed length of a group's earlier recordings."""
    w = over(keys, [order]).rowsBetween(Window.unboundedPreceding, -1)
    return recordings.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))


def stitched_signals(signals: DataFrame, recordings: DataFrame, keys, recording: str, length: str, t: str = "t", out: str = "t_global") -> DataFrame:
    """Samples (recording, t and more) of a group's recordings on one time axis; recordings: keys, recording, length."""
    starts = stitched(recordings, keys, recording, length).select(*keys, recording, F.col("offset").alias("__off"))
    return signals.join(starts, recording).withColumn(out, F.col(t) + F.col("__off")).drop("__off")


def resampled_sync(ephys: DataFrame, tracking: DataFrame, keys, index: str, t: str, frame_t: str) -> DataFrame:
    """Rows of ephys at the rate of tracking: frame k from 0 has the row whose index is k * ratio without its fraction, ratio being the mean time between frames by that between rows.

    index: from 0 without gaps. A row finds the frames that it is for by itself, so only the two rates are joined; frames end with the rows.
    """
    gap = lambda c: F.try_divide(F.max(c) - F.min(c), (F.count("*") - 1).cast("double"))
    rows = ephys.groupBy(*keys).agg(gap(t).alias("__e"), F.count("*").alias("__n"))
    both = rows.join(tracking.groupBy(*keys).agg(gap(frame_t).alias("__v")), list(keys)).withColumn("__ratio", F.try_divide(F.col("__v"), F.col("__e"))).where("__ratio > 0")
    df = ephys.join(both.select(*keys, "__ratio", F.floor(F.col("__n") / F.col("__ratio")).alias("__frames")), list(keys))
    i, ratio = F.col(index), F.col("__ratio")
    near = F.sequence(F.floor(i / ratio) - 1, F.floor((i + 1) / ratio) + 1)
    mine = F.filter(near, lambda k: (k >= 0) & (k < F.col("__frames")) & (F.floor(k * ratio) == i))
    return df.withColumn("frame", F.explode(mine)).drop("__ratio", "__frames")


def halves(df: DataFrame, keys, t: str) -> DataFrame:
    """half: 1 before the middle of the session's time, else 2."""
    span = df.groupBy(*keys).agg(((F.max(t) + F.min(t)) / 2).alias("__mid"))
    return df.join(span, keys).withColumn("half", F.when(F.col(t) < F.col("__mid"), 1).otherwise(2)).drop("__mid")


def ends(df: DataFrame, keys, order: list[str], n: int, above: int) -> DataFrame:
    """position: 'first' or 'last' for the first and last n rows of groups of more than above rows; a row in both is given twice."""
    w = Window.partitionBy(*keys)
    df = df.withColumns({"__c": F.count("*").over(w), "__k": F.row_number().over(w.orderBy(*order))}).where(F.col("__c") > above)
    sides = F.array_compact(F.array(F.when(F.col("__k") <= n, F.lit("first")), F.when(F.col("__k") > F.col("__c") - n, F.lit("last"))))
    return df.withColumn("position", F.explode(sides)).drop("__c", "__k")


def remaining(cells: DataFrame, done: DataFrame, keys, n: int) -> DataFrame:
    """(keys, shuffle_id) from 0 to n - 1 that done doesn't have yet."""
    wanted = cells.select(*keys).distinct().withColumn("shuffle_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return wanted.join(done.select(*keys, "shuffle_id"), [*keys, "shuffle_id"], "left_anti")


def goal_location(df: DataFrame, keys, x: str, in_goal: Column) -> DataFrame:
    """Middle of the positions inside the goal per trial, 0 where there are none."""
    inside = F.when(in_goal, F.col(x))
    return df.groupBy(*keys).agg(F.coalesce((F.max(inside) + F.min(inside)) / 2, F.lit(0.0)).alias("goal"))


def goal_offset(df: DataFrame, keys, order, x: str, in_goal: Column) -> DataFrame:
    """goal: the middle of a trial's (keys) positions inside the goal, 0 where there are none; offset: x - goal; edge: 1 where a row enters or leaves the goal, else 0."""
    whole = Window.partitionBy(*keys)
    df = df.withColumn("__in", F.coalesce(in_goal, F.lit(False)))
    inside, now = F.when(F.col("__in"), F.col(x)), F.col("__in").cast("int")
    goal = F.coalesce((F.max(inside).over(whole) + F.min(inside).over(whole)) / 2, F.lit(0.0))
    edge = F.coalesce(F.abs(now - F.lag(now).over(over(keys, order))), F.lit(0))
    return df.withColumns({"goal": goal, "edge": edge}).withColumn("offset", F.col(x) - F.col("goal")).drop("__in")


def spaced_stops(stops: DataFrame, keys, at: str, least: float) -> DataFrame:
    """Stops without those at most least after the stop before them, whether that one stays or not; nulls go."""
    gap = F.col(at) - F.lag(at).over(over(keys, [at]))
    return stops.where(F.col(at).isNotNull()).withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") > least)).drop("__gap")


def first_stops(starts: DataFrame, stops: DataFrame, keys, at: str) -> DataFrame:
    """(keys, at, stop): for each start the first stop at or after it; starts without one go."""
    both = starts.select(*keys, F.col(at).alias("__t"), F.lit(0).alias("__p")).union(stops.select(*keys, at, F.lit(1)))
    following = F.last(F.when(F.col("__p") == 1, F.col("__t")), ignorenulls=True).over(onward(keys, ["__t", "__p"]))
    return both.withColumn("stop", following).where("__p = 0 and stop is not null").select(*keys, F.col("__t").alias(at), "stop")


def run_starts(df: DataFrame, keys, order, condition: Column) -> DataFrame:
    """Rows that meet the condition and whose predecessor doesn't."""
    met = F.coalesce(condition, F.lit(False))
    df = df.withColumn("__on", met).withColumn("__before", F.lag("__on", 1, False).over(over(keys, order)))
    return df.where("__on AND NOT __before").drop("__on", "__before")


def repaired_direction(df: DataFrame, keys, order: str, angle: str, t: str, most: float, chunk: int = 100_000) -> DataFrame:
    """Turns angles by 180 degrees where they change faster than most degrees a second from the angle before (nulls are passed over) and the turn makes the change smaller.

    order: a numeric column with at most some rows for each of its whole values. An angle is turned or not, so a row is a map from the state of the row before it
    to its own: fixed, the same, or the opposite. Maps are composed by a running count of opposites and the last fixed one, in chunks of
    the order first and then over the chunks, so no session is one group. A second pass would turn nothing: a row keeps the better of both
    angles, and the row before it stays as it is.
    """
    near, far = Window.partitionBy(*keys, "__c").orderBy(order), Window.partitionBy(*keys).orderBy("__c")
    df = df.withColumn("__c", F.floor(F.col(order) / chunk))
    some = df.where(F.col(angle).isNotNull()).select(*keys, "__c", order, F.struct(F.col(angle).cast("double").alias("a"), F.col(t).cast("double").alias("t")).alias("__now"))
    # the last angle of the chunks before
    tails = some.groupBy(*keys, "__c").agg(F.max_by("__now", order).alias("__tail"))
    tails = tails.withColumn("__tail", F.lag("__tail").over(far))
    some = some.withColumn("__old", F.lag("__now").over(near)).join(tails, [*keys, "__c"])
    old = F.coalesce("__old", "__tail")
    fold = lambda x: F.pmod(x + 180.0, F.lit(360.0)) - 180.0

    def turned(before: int) -> Column:
        change = fold(F.col("__now.a") - old["a"] - 180.0 * before)
        time = F.col("__now.t") - old["t"]
        return F.coalesce((time > 0) & (F.abs(change) / time > most) & (F.abs(fold(change + 180.0)) < F.abs(change)), F.lit(False)).cast("int")

    some = some.withColumns({"__0": turned(0), "__1": turned(1)})
    some = some.withColumns({"__flip": F.sum(F.when(F.col("__0") > F.col("__1"), 1).otherwise(0)).over(near), "__set": F.when(F.col("__0") == F.col("__1"), F.col("__0"))})
    fixed = F.last(F.when(F.col("__set").isNotNull(), F.struct(F.col("__set").alias("s"), F.col("__flip").alias("f"))), ignorenulls=True).over(near)
    some = some.withColumn("__fixed", fixed)
    # the map from the state before the chunk: fixed to value, or value added to it
    some = some.withColumns({"__is": F.col("__fixed").isNotNull(), "__value": F.when(F.col("__fixed").isNotNull(), (F.col("__fixed.s") + F.col("__flip") - F.col("__fixed.f")) % 2).otherwise(F.col("__flip") % 2)})
    whole = some.groupBy(*keys, "__c").agg(F.max_by(F.struct("__is", "__value"), order).alias("__m"))
    whole = whole.withColumn("__odd", F.sum(F.when(~F.col("__m.__is"), F.col("__m.__value")).otherwise(0)).over(far))
    start = F.last(F.when(F.col("__m.__is"), F.struct(F.col("__m.__value").alias("v"), F.col("__odd").alias("o"))), ignorenulls=True).over(far)
    after = F.coalesce((start["v"] + F.col("__odd") - start["o"]) % 2, F.col("__odd") % 2)
    whole = whole.withColumn("__after", after).select(*keys, "__c", F.coalesce(F.lag("__after").over(far), F.lit(0)).alias("__entry"))
    state = F.when(F.col("__is"), F.col("__value")).otherwise((F.col("__value") + F.col("__entry")) % 2)
    found = some.join(whole, [*keys, "__c"]).select(*keys, order, state.alias("__state"))
    turn = F.when(F.coalesce(F.col("__state"), F.lit(0)) == 1, fold(F.col(angle) + 180.0)).otherwise(F.col(angle))
    return df.join(found, [*keys, order], "left").withColumn(angle, turn).drop("__c", "__state")
