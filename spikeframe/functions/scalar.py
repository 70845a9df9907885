"""Column functions used by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null where a series is constant but for rounding."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    spread = [F.var_pop(c) > 1e-20 * F.pow(F.avg(c), F.lit(2)) for c in (a, b)]
    return F.when(spread[0] & spread[1], F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))))


def keyed_draw(n: Column, *keys: Column | str) -> Column:
    """A whole number in [0, n) that depends on the keys alone, from md5."""
    digest = F.md5(F.concat_ws("-", *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), n)


def tetrode(channel: str) -> Column:
    return F.floor((F.col(channel) - 1) / 4 + 1).cast("int")


def channel_in_tetrode(channel: str) -> Column:
    return ((F.col(channel) - 1) % 4 + 1).cast("int")


def live_channel(channel: Column, dead: list[int]) -> Column:
    """Channel number once dead channels, in this order, are put back."""
    for d in dead:
        channel = F.when(channel >= d, channel + 1).otherwise(channel)
    return channel


def to_polar(x: str, y: str) -> tuple[Column, Column]:
    """(rho, phi in radians)."""
    return F.hypot(x, y), F.atan2(y, x)


def to_cartesian(rho: str, phi: str) -> tuple[Column, Column]:
    return F.col(rho) * F.cos(phi), F.col(rho) * F.sin(phi)


def shifted(array: Column, n: int, fill) -> Column:
    """An array moved by n places to the right (to the left below 0) at the same length; freed places get fill."""
    gap = F.array_repeat(F.lit(fill), F.least(F.size(array), F.lit(abs(n))))
    rest = F.greatest(F.size(array) - abs(n), F.lit(0))
    return F.concat(gap, F.slice(array, 1, rest)) if n >= 0 else F.concat(F.slice(array, F.size(array) - rest + 1, rest), gap)


def matrix_rows(column: str) -> Column:
    """A nested array as rows: explode gives (row, col, value) structs."""
    return F.flatten(F.transform(column, lambda line, i: F.transform(line, lambda v, j: F.struct(i.alias("row"), j.alias("col"), v.alias("value")))))


def session_parts(name: str) -> dict[str, Column]:
    """animal, day and stamp of a session named animal_yyyy-MM-dd_HH-mm-ss_more; null where the name has another form or no such date."""
    form = r"^([^_]+)_(\d{4}-\d{2}-\d{2})_(\d{2}-\d{2}-\d{2})(_|$)"
    part = lambda k: F.regexp_extract(name, form, k)
    stamp = F.try_to_timestamp(F.concat(part(2), F.lit(" "), part(3)), F.lit("yyyy-MM-dd HH-mm-ss"))
    fits = F.regexp_like(name, F.lit(form)) & stamp.isNotNull()
    return {"animal": F.when(fits, part(1)), "day": F.when(fits, stamp.cast("date")), "stamp": F.when(fits, stamp)}


def tag_values(tags: str) -> dict[str, Column]:
    """Running parameters in a '*'-separated tag string, with their defaults."""
    m = F.str_to_map(F.coalesce(F.col(tags), F.lit("")), F.lit(r"\*"), F.lit("="))
    known = ("pixel_ratio", "stop_threshold", "track_length", "cue_conditioned_goal", "paired", "session_id")
    paired = F.try_element_at(m, F.lit("paired"))
    return {
        "pixel_ratio": F.coalesce(F.try_element_at(m, F.lit("pixel_ratio")).cast("int"), F.lit(440)),
        "stop_threshold": F.coalesce(F.try_element_at(m, F.lit("stop_threshold")).cast("double"), F.lit(4.9)),
        "track_length": F.coalesce(F.try_element_at(m, F.lit("track_length")).cast("int"), F.lit(200)),
        "cue_conditioned_goal": F.coalesce(F.try_element_at(m, F.lit("cue_conditioned_goal")).try_cast("boolean"), F.lit(False)),
        "paired": F.when(paired.isNotNull(), F.split(paired, ",")),
        "session_id": F.try_element_at(m, F.lit("session_id")),
        "unexpected_tag": F.size(F.array_except(F.filter(F.map_keys(m), lambda k: k != ""), F.array(*map(F.lit, known)))) > 0,
    }
