"""Firing fields and autocorrelogram peaks. One cell's map (at most some thousand bins) is one group; cells run in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .maps import SessionMaps, correlate_shifts, cropped, on_maps

#: Fixed value: what a bin of a field counts in later passes.
TAKEN = -10.0


def _joined(inside, start):
    """Bins of inside (a map) connected with start by their sides."""
    found = np.zeros_like(inside)
    found[start] = True
    size = 0
    while size < (size := int(found.sum())):
        wider = found.copy()
        wider[1:] |= found[:-1]
        wider[:-1] |= found[1:]
        wider[:, 1:] |= found[:, :-1]
        wider[:, :-1] |= found[:, 1:]
        found = wider & inside
    return found


def _components(inside):
    """For each bin of inside (a map) the lowest number of a bin connected with it, corners included; bins are numbered by row."""
    none = inside.size
    label = np.full(np.add(inside.shape, 2), none)
    core = label[1:-1, 1:-1]
    core[inside] = np.flatnonzero(inside)
    while True:
        rows = np.minimum(np.minimum(label[:-2], label[1:-1]), label[2:])
        least = np.minimum(np.minimum(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:])[inside]
        roots = np.append(np.where(inside, core, none).ravel(), none)
        roots[np.flatnonzero(inside)] = least
        least = roots[roots[least]]
        if (core[inside] == least).all():
            return least
        core[inside] = least


def _schema(df: DataFrame, keys, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", " + more


def fields_of(u, seen, x0: int, y0: int, share: float, least_bins: int, least_rate: float):
    """(field_id, bin_x, bin_y, max_rate, rate) of the fields of one map whose first bin is (x0, y0), see firing_fields."""
    left, total, out = seen.copy(), int(seen.sum()), []
    wide, high = (at.max() + 1 + low if total else 0 for at, low in zip(np.nonzero(seen), (x0, y0), strict=True))
    while left.any():
        rate = u[left]
        at = np.flatnonzero(left & (u == rate.max()))[-1]
        peak = np.unravel_index(at, u.shape)
        top = u[peak]
        if top < least_rate or top <= rate.mean() + np.append(rate, [TAKEN] * (total - len(rate))).std():
            break
        field = _joined(left & (u >= share * top), peak)
        x, y = np.nonzero(field)
        centre = tuple(v.max() - (v.max() - v.min()) // 2 for v in (x, y))
        if not field[centre] or len(x) <= least_bins or len(x) > total / 2 or x.max() - x.min() >= wide / 2 or y.max() - y.min() >= high / 2:
            break
        out.append((np.full(len(x), len(out)), x + x0, y + y0, np.full(len(x), top), u[x, y]))
        left &= ~field
    return tuple(np.concatenate(part) for part in zip(*out, strict=True)) if out else tuple(np.zeros(0, t) for t in (int, int, int, float, float))


def firing_fields(rates: DataFrame, keys, share: float = 0.35, least_bins: int = 45, least_rate: float = 0.1) -> DataFrame:
    """(keys, field_id, bin_x, bin_y, max_rate) of the fields of each map.

    A field is what joins the highest bin left over bins of share of its rate or more. The peak must reach
    least_rate and exceed the mean of the bins left + the sd of the map, in which bins of fields count TAKEN. The
    field must have more than least_bins bins, at most half of the map, extend over less than half of it either way
    and hold the middle bin of its extent; the search ends at the first field that fails.
    """

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        first, pdf = pdf.iloc[:1], pdf.dropna(subset=["rate"])
        x, y, rate = pdf["bin_x"].to_numpy(int), pdf["bin_y"].to_numpy(int), pdf["rate"].to_numpy(float)
        x0, y0 = (int(v.min()) if len(v) else 0 for v in (x, y))
        u = np.zeros((x.max() - x0 + 1, y.max() - y0 + 1) if len(x) else (1, 1))
        seen = np.zeros(u.shape, bool)
        u[x - x0, y - y0], seen[x - x0, y - y0] = rate, True
        found = pd.DataFrame(dict(zip(("field_id", "bin_x", "bin_y", "max_rate"), fields_of(u, seen, x0, y0, share, least_bins, least_rate), strict=False)))
        for k in reversed(keys):
            found.insert(0, k, [first[k].iloc[0]] * len(found))
        return found

    return rates.select(*keys, "bin_x", "bin_y", "rate").groupBy(*keys).applyInPandas(find, _schema(rates, keys, "field_id long, bin_x long, bin_y long, max_rate double"))


def map_fields(tiles: DataFrame | SessionMaps, keys, share: float = 0.35, least_bins: int = 45, least_rate: float = 0.1) -> DataFrame:
    """firing_fields of tiled maps or SessionMaps, with the rate of each bin."""
    return on_maps(tiles, keys, lambda x0, y0, u, seen: fields_of(u, seen, x0, y0, share, least_bins, least_rate), "field_id long, bin_x long, bin_y long, max_rate double, rate double")


def peaks_of(dx, dy):
    """(label, cx, cy, area, distance) of the components (8 neighbours) of shifts, by their lowest shift."""
    if not len(dx):
        return tuple(np.zeros(0, t) for t in (int, float, float, int, float))
    inside = np.zeros((dx.max() - dx.min() + 1, dy.max() - dy.min() + 1), bool)
    inside[dx - dx.min(), dy - dy.min()] = True
    _, label = np.unique(_components(inside), return_inverse=True)
    x, y = np.nonzero(inside)
    area = np.bincount(label)
    cx, cy = np.bincount(label, x + dx.min()) / area, np.bincount(label, y + dy.min()) / area
    return np.arange(len(area)), cx, cy, area, np.hypot(cx, cy)


PEAKS = "label long, cx double, cy double, area long, distance double"


def correlogram_peaks(correlogram: DataFrame, keys, above: float = 0.2) -> DataFrame:
    """(keys, label, cx, cy, area, distance): components (8 neighbours) of shifts whose correlation is over above."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(dict(zip(("label", "cx", "cy", "area", "distance"), peaks_of(pdf["dx"].to_numpy(int), pdf["dy"].to_numpy(int)), strict=True)))
        for k in reversed(keys):
            found.insert(0, k, pdf[k].iloc[0])
        return found

    high = correlogram.where(F.col("r") > above).select(*keys, "dx", "dy")
    return high.groupBy(*keys).applyInPandas(find, _schema(correlogram, keys, PEAKS))


def shifts_of(u, seen, least: int):
    """(dx, dy, r) of a map's autocorrelogram where it isn't null."""
    seen = seen & (u > 0)
    if not seen.any():
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    dx, dy, _, r = correlate_shifts(*cropped(u, seen), least)
    some = ~np.isnan(r)
    return dx[some], dy[some], r[some]


def map_peaks(tiles: DataFrame | SessionMaps, keys, above: float = 0.2, least: int = 20) -> DataFrame:
    """correlogram_peaks of the autocorrelograms of tiled maps or SessionMaps."""

    def find(x0, y0, u, seen):
        dx, dy, r = shifts_of(u, seen, least)
        return peaks_of(dx[r > above], dy[r > above])

    return on_maps(tiles, keys, find, PEAKS)


def _corr(u, v):
    """Pearson correlation, NaN where a series is constant but for rounding."""
    if not len(u):
        return np.nan
    du, dv = u - u.mean(), v - v.mean()
    a, b = (du**2).mean(), (dv**2).mean()
    return (du * dv).mean() / (np.sqrt(a) * np.sqrt(b)) if a > 1e-20 * u.mean() ** 2 and b > 1e-20 * v.mean() ** 2 else np.nan


def grid_score_of(u, seen, above: float, least: int):
    """The grid score of one map as an array, empty where map_grid_score has no row."""
    dx, dy, r = shifts_of(u, seen, least)
    _, _, _, _, distance = peaks_of(dx[r > above], dy[r > above])
    if len(distance) <= 7:
        return np.zeros(0)
    mean = np.sort(distance, kind="stable")[1:7].mean()
    far = np.hypot(dx.astype(float), dy.astype(float))
    ring = (far >= 0.25 * mean) & (far <= 1.25 * mean)
    dx, dy, high = dx[ring], dy[ring], (r[ring] > above).astype(float)
    side = int(np.ceil(1.25 * mean)) + 1
    at = np.full((2 * side + 1, 2 * side + 1), np.nan)
    at[dx + side, dy + side] = high
    found, met = {}, False
    for angle in (30, 60, 90, 120, 150):
        c, s = np.cos(np.radians(float(angle))), np.sin(np.radians(float(angle)))
        x, y = np.rint(dx * c - dy * s).astype(int) + side, np.rint(dx * s + dy * c).astype(int) + side
        inside = (x >= 0) & (y >= 0) & (x <= 2 * side) & (y <= 2 * side)
        v = np.where(inside, at[np.where(inside, x, 0), np.where(inside, y, 0)], np.nan)
        both = ~np.isnan(v)
        met, found[angle] = met or both.any(), _corr(high[both], v[both])
    if not met:
        return np.zeros(0)
    # as for columns, least and greatest leave nulls out
    low, high = np.array([found[60], found[120]]), np.array([found[30], found[90], found[150]])
    some = not (np.isnan(low).all() or np.isnan(high).all())
    return np.array([np.nanmin(low) - np.nanmax(high) if some else np.nan])


def map_grid_score(tiles: DataFrame | SessionMaps, keys, above: float = 0.2, least: int = 20) -> DataFrame:
    """grid_score of the autocorrelograms of tiled maps or SessionMaps: (keys, grid_score) of maps with a ring in which some shift meets a turned one."""
    out = on_maps(tiles, keys, lambda x0, y0, u, seen: (grid_score_of(u, seen, above, least),), "grid_score double")
    return out.withColumn("grid_score", F.nanvl("grid_score", F.lit(None).cast("double")))


def _direction_score(angle, window: int):
    """maps.hd_score of maps.hd_histogram of one cell's angles, as an array; empty without angles."""
    angle = angle[~np.isnan(angle)]
    if not len(angle):
        return np.zeros(0)
    n = np.bincount(np.minimum(np.floor(angle + 180), 359).astype(int) % 360, minlength=360)
    n = sum(np.roll(n, d) for d in range(-(window // 2), window - window // 2))
    a = np.radians(np.arange(360) - 179.0)
    return np.array([np.hypot((np.sin(a) * n).sum(), (np.cos(a) * n).sum()) / n.sum()])


def cell_scores(maps: SessionMaps, keys, angle: str = "hd", window: int = 23, above: float = 0.2, least: int = 20) -> DataFrame:
    """(keys, hd_score, grid_score) of cells with angles: maps.hd_score of the angles of their spikes and map_grid_score of their maps, null without one, from one pass over a session."""

    def scores(x0, y0, u, seen, angles):
        hd, grid = _direction_score(angles.astype(float), window), grid_score_of(u, seen, above, least)
        return hd, grid if len(grid) == len(hd) else np.full(len(hd), np.nan)

    out = maps.each(scores, "hd_score double, grid_score double", [angle])
    return out.withColumn("grid_score", F.nanvl("grid_score", F.lit(None).cast("double")))


def grid_spacing(peaks: DataFrame, keys, bin_cm: float = 2.5) -> DataFrame:
    """Median distance of the six peaks around the centre; null with seven peaks or fewer. Also the size of the central field."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    ranked = peaks.withColumns({"__k": F.row_number().over(w.orderBy("distance", "label")), "__n": F.count("*").over(w)})
    ring = F.when(F.col("__k").between(2, 7) & (F.col("__n") > 7), F.col("distance") * bin_cm)
    size = F.max(F.when((F.col("__k") == 1) & (F.col("__n") > 7), F.sqrt(F.col("area") * bin_cm) / F.pi()))
    return ranked.groupBy(*keys).agg(F.percentile(ring, F.lit(0.5)).alias("spacing"), size.alias("field_size"))


def grid_score(correlogram: DataFrame, peaks: DataFrame, keys, above: float = 0.2) -> DataFrame:
    """min(r60, r120) - max(r30, r90, r150) of the thresholded correlogram turned about its centre, inside the ring of the six peaks.

    The ring goes from 0.25 to 1.25 of the peaks' mean distance. Turned shifts go to the nearest bin.
    """
    from pyspark.sql import Window

    from ..functions.scalar import safe_corr

    w = Window.partitionBy(*keys)
    ranked = peaks.withColumns({"__k": F.row_number().over(w.orderBy("distance", "label")), "__n": F.count("*").over(w)})
    ring = ranked.where(F.col("__k").between(2, 7) & (F.col("__n") > 7)).groupBy(*keys).agg(F.avg("distance").alias("__d"))
    m = correlogram.where("r is not null").join(ring, keys).where(F.hypot(F.col("dx").cast("double"), F.col("dy").cast("double")).between(0.25 * F.col("__d"), 1.25 * F.col("__d")))
    m = m.select(*keys, "dx", "dy", (F.col("r") > above).cast("double").alias("u"))
    turned = m.withColumn("angle", F.explode(F.array(*(F.lit(a) for a in (30, 60, 90, 120, 150)))))
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    turned = turned.select(*keys, "angle", F.bround(F.col("dx") * c - F.col("dy") * s).cast("long").alias("dx"), F.bround(F.col("dx") * s + F.col("dy") * c).cast("long").alias("dy"), F.col("u").alias("v"))
    r = turned.join(m, [*keys, "dx", "dy"]).groupBy(*keys, "angle").agg(safe_corr("u", "v").alias("r"))
    at = lambda a: F.max(F.when(F.col("angle") == a, F.col("r")))
    return r.groupBy(*keys).agg((F.least(at(60), at(120)) - F.greatest(at(30), at(90), at(150))).alias("grid_score"))
