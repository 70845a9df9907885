"""Border, corner and cue scores of firing fields, and orientation and shape of grids. All but the ellipse fit are native aggregates over field bins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .firing_fields import peaks_of, shifts_of
from .maps import SessionMaps, on_maps


def _score(bins: DataFrame, keys, coverage: list[Column], distance: Column, farthest: Column) -> DataFrame:
    """(cM - dm) / (cM + dm): the best coverage of any field, and the mean over fields of the rate-weighted distance by its greatest value on the map.

    A distance is measured to the middle of a bin, so half a bin is added to it.
    """
    share = F.try_divide(distance + 0.5, farthest + 0.5)
    per = bins.groupBy(*keys, "field_id").agg(F.greatest(F.lit(0.0), *(F.coalesce(c, F.lit(0.0)) for c in coverage)).alias("__cm"), F.try_divide(F.sum(F.col("rate") * share), F.sum("rate")).alias("__dm"))
    both = per.groupBy(*keys).agg(F.max("__cm").alias("__cm"), F.avg("__dm").alias("__dm"))
    return both.select(*keys, F.try_divide(F.col("__cm") - F.col("__dm"), F.col("__cm") + F.col("__dm")).alias("score"))


def _share(condition: Column, of: Column) -> Column:
    return F.try_divide(F.count_if(condition).cast("double"), F.max(of).cast("double"))


def border_score(bins: DataFrame, keys) -> DataFrame:
    """Score of wall coverage by field bins (keys, field_id, bin_x, bin_y, rate, nx, ny); keys without fields give no row.

    The largest coverage of any wall by any field counts, and the distance to the nearest wall.
    """
    x, y, nx, ny = (F.col(c) for c in ("bin_x", "bin_y", "nx", "ny"))
    coverage = [_share(x == 0, ny), _share(x == nx - 1, ny), _share(y == 0, nx), _share(y == ny - 1, nx)]
    return _score(bins, keys, coverage, F.least(x, y, nx - 1 - x, ny - 1 - y), F.floor((F.least(nx, ny) - 1) / 2)).withColumnRenamed("score", "border_score")


def corner_score(bins: DataFrame, keys, part: float = 0.2) -> DataFrame:
    """As border_score, with the coverage of the two wall ends (part of each wall) at a corner and the distance to the nearest corner."""
    x, y, nx, ny = (F.col(c) for c in ("bin_x", "bin_y", "nx", "ny"))
    wide, high = F.ceil(part * nx), F.ceil(part * ny)
    coverage = []
    for u, v in ((x, y), (nx - 1 - x, y), (x, ny - 1 - y), (nx - 1 - x, ny - 1 - y)):
        coverage.append(_share(((v == 0) & (u < wide)) | ((u == 0) & (v < high)), wide + high - 1))
    near = F.hypot(F.least(x, nx - 1 - x).cast("double"), F.least(y, ny - 1 - y).cast("double"))
    far = F.hypot(F.floor((nx - 1) / 2).cast("double"), F.floor((ny - 1) / 2).cast("double"))
    return _score(bins, keys, coverage, near, far).withColumnRenamed("score", "corner_score")


def cue_score(bins: DataFrame, keys, cue_share: float) -> DataFrame:
    """As border_score, with a cue that takes cue_share of the wall x = 0, in its middle: coverage of that wall by cue bins, distance to the nearest of them."""
    x, y, nx, ny = (F.col(c) for c in ("bin_x", "bin_y", "nx", "ny"))
    low = F.greatest(F.lit(0).cast("long"), F.floor(F.floor(ny / 2) - ny * cue_share / 2))
    high = F.least(ny - 1, F.floor(F.ceil(ny / 2) + ny * cue_share / 2))
    along = lambda t: F.greatest(low - t, t - high, F.lit(0).cast("long")).cast("double")
    coverage = [_share((x == 0) & y.between(low, high), ny)]
    far = F.hypot((nx - 1).cast("double"), F.greatest(along(F.lit(0)), along(ny - 1)))
    return _score(bins, keys, coverage, F.hypot(x.cast("double"), along(y)), far).withColumnRenamed("score", "cue_score")


def ring(peaks: DataFrame, keys) -> DataFrame:
    """The six peaks around the centre of autocorrelograms with more than seven."""
    w = Window.partitionBy(*keys)
    ranked = peaks.withColumns({"__k": F.row_number().over(w.orderBy("distance", "label")), "__n": F.count("*").over(w)})
    return ranked.where(F.col("__k").between(2, 7) & (F.col("__n") > 7)).drop("__k", "__n")


def ellipticity(points: np.ndarray) -> float | None:
    """sqrt(1 - b * b / (a * a)) of the least-squares ellipse (halves a, b) through points; None where none fits."""
    x, y = points.T
    fit, _, rank, _ = np.linalg.lstsq(np.stack([x * x, x * y, y * y, x, y], 1), np.ones(len(x)), rcond=None)
    if rank < 5:
        return None
    low, high = np.linalg.eigvalsh([[fit[0], fit[1] / 2], [fit[1] / 2, fit[2]]])
    return float(np.sqrt(1 - low / high)) if low > 0 else None


def grid_shape(peaks: DataFrame, keys) -> DataFrame:
    """(keys, orientation, ellipticity): the smallest positive angle in degrees to a peak of the ring, and the shape of the ellipse through it."""
    around = ring(peaks, keys)
    angle = F.degrees(F.atan2("cy", "cx"))
    turned = around.groupBy(*keys).agg(F.min(F.when(angle > 0, angle)).alias("orientation"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"ellipticity": [ellipticity(pdf[["cx", "cy"]].to_numpy(float))]}, dtype=float)
        for k in reversed(list(keys)):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in peaks.select(*keys).schema)
    shape = around.select(*keys, "cx", "cy").groupBy(*keys).applyInPandas(fit, f"{kinds}, ellipticity double")
    return turned.join(shape, list(keys))


def map_grid_shape(tiles: DataFrame | SessionMaps, keys, above: float = 0.2, least: int = 20) -> DataFrame:
    """grid_shape of the autocorrelogram peaks of tiled maps or SessionMaps: both figures of a map in one call."""

    def shape(x0, y0, u, seen):
        dx, dy, r = shifts_of(u, seen, least)
        _, cx, cy, _, distance = peaks_of(dx[r > above], dy[r > above])
        if len(distance) <= 7:
            return np.zeros(0), np.zeros(0)
        around = np.argsort(distance, kind="stable")[1:7]
        angle = np.degrees(np.arctan2(cy[around], cx[around]))
        ellipse = ellipticity(np.stack([cx[around], cy[around]], 1))
        return np.array([angle[angle > 0].min(initial=np.inf)]), np.array([np.nan if ellipse is None else ellipse])

    out = on_maps(tiles, keys, shape, "orientation double, ellipticity double")
    null = F.lit(None).cast("double")
    return out.select(*keys, F.when(F.col("orientation") < 360, F.col("orientation")).alias("orientation"), F.nanvl("ellipticity", null).alias("ellipticity"))
