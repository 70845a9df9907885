"""Shuffles with keyed random draws, and the metrics of shuffled cells. Draws come from md5 of the keys, so a retried task gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import keyed_draw, safe_corr
from . import firing_fields, maps
from .behaviour import kernel_weights


def time_shifts(spikes: DataFrame, n: int, length: int | str, guard: int, cell_keys, seed: str = "shift") -> DataFrame:
    """n copies of each cell's spikes, t moved by the cell's and copy's own random offset in [guard, length - guard) and wrapped at length, a number or a column of spikes."""
    named = [length] if isinstance(length, str) else []
    length = F.col(length) if named else F.lit(length)
    offsets = spikes.select(*cell_keys, *named).distinct().withColumn("shuffle_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    offsets = offsets.withColumn("__offset", F.lit(guard) + keyed_draw(length - 2 * guard, F.lit(seed), *cell_keys, "shuffle_id"))
    return spikes.join(offsets.drop(*named), list(cell_keys)).withColumn("t", F.pmod(F.col("t") + F.col("__offset"), length)).drop("__offset")


def _draws(head: str, k, size: int):
    """keyed_draw(size, ..., k) for each k; head: the keys before it, as concat_ws gives them."""
    import hashlib

    import numpy as np

    return np.fromiter(((int.from_bytes(hashlib.md5(f"{head}-{i}".encode()).digest()[:8], "big") >> 4) % size for i in k), np.int64, len(k))


def shift_summaries(spikes: DataFrame, n: int, length: int, guard: int, cell_keys, seed: str = "shift") -> DataFrame:
    """(cell_keys, shuffle_id, n, first_t, last_t, total): number, least, greatest and sum of t of each copy of a cell that time_shifts gives; t and length are whole numbers.

    A cell's spikes are one row in order: what a copy wraps is the end of that row, so no copy's spike is made.
    """
    import numpy as np
    import pyarrow as pa

    cell_keys = list(cell_keys)
    trains = spikes.where(" and ".join(f"`{k}` is not null" for k in cell_keys)).groupBy(*cell_keys).agg(F.collect_list(F.pmod(F.col("t").cast("long"), F.lit(length))).alias("__t"), F.count("*").alias("n"))
    trains = trains.withColumn("__head", F.concat_ws("-", F.lit(seed), *(F.col(k).cast("string") for k in cell_keys)))

    def summed(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                cells = batch.slice(first, 64)
                times, heads, found = cells["__t"], cells["__head"].to_pylist(), []
                for i, head in enumerate(heads):
                    t, by = np.sort(times[i].values.to_numpy()), (guard + _draws(head, range(n), length - 2 * guard)) % length
                    many = len(t)
                    if not many:
                        found.append(np.ma.masked_all((3, n), np.int64))
                        continue
                    kept = np.searchsorted(t, length - by)  # the others are wrapped
                    low = np.where(kept < many, t[np.minimum(kept, many - 1)] - length, t[0]) + by
                    high = np.where(kept > 0, t[kept - 1], t[-1] - length) + by
                    found.append(np.ma.array([low, high, t.sum() + many * by - length * (many - kept)]))
                owner = pa.array(np.repeat(np.arange(len(heads)), n))
                values = np.ma.concatenate(found, axis=1)
                columns = [pa.array(v.data, pa.int64(), mask=np.ma.getmaskarray(v)) for v in values]
                own = [cells[k].take(owner) for k in cell_keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.tile(np.arange(n, dtype=np.int32), len(heads))), cells["n"].take(owner), *columns], [*cell_keys, "shuffle_id", "n", "first_t", "last_t", "total"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trains.select(*cell_keys).schema)
    return trains.mapInArrow(summed, f"{kinds}, shuffle_id int, n long, first_t long, last_t long, total long")


def _circular_sums(count, window: int = 23):
    """behaviour.rolling_circular of rows of whole numbers."""
    import numpy as np

    half = window // 2
    sums = np.cumsum(np.concatenate([np.zeros((len(count), 1), np.int64), count[:, -half:], count, count[:, :half]], axis=1), axis=1)
    return sums[:, window:] - sums[:, :-window]


def shuffled_metrics(spikes: DataFrame, position: DataFrame, n: int, length: int, guard: int, cell_keys, ephys_rate: float = 30000.0, own: bool = False) -> DataFrame:
    """(cell_keys, shuffle_id, hd_score, rayleigh p, n): the metrics of each time-shifted copy, and with own those of the cell's own spikes as shuffle_id -1. spikes: t in samples; the position side isn't shuffled.

    hd_score and p are those of maps.hd_histogram, made where a session's copies are counted; copies without a direction give no row.
    """
    import numpy as np

    cell_keys = list(cell_keys)
    angle = np.radians(np.arange(360) - 179.0)
    sine, cosine = np.sin(angle), np.cos(angle)

    def scored(count, fired, seen):
        smooth = _circular_sums(count).astype(float)
        some = smooth.any(axis=1)
        smooth = smooth[some]
        n, r = smooth.sum(1), np.hypot((smooth * sine).sum(1), (smooth * cosine).sum(1))
        p = np.exp(np.sqrt(1 + 4 * n + 4 * (n * n - r * r)) - (1 + 2 * n))
        return some, [r / n, p, fired[some, 0]]

    at = F.when(F.col("hd").isNotNull(), F.pmod(F.least(F.floor(F.col("hd") + 180), F.lit(359)), F.lit(360)))
    spikes = spikes.where(" and ".join(f"`{k}` is not null" for k in cell_keys))
    out = _copies(spikes, position.withColumn("__bar", at), n, length, guard, ["session_id"], cell_keys, "__bar", 360, None, 1, ephys_rate, "shift", scored, "hd_score double, p double, n long")
    return out if own else out.where("shuffle_id >= 0")


#: Scores of a cell and of its shuffles.
SCORES = ["hd_score", "rayleigh_p", "spatial_information", "grid_score", "border_score", "speed_score", "stability"]


def _border_score(field, x, y, rate, nx: int, ny: int) -> float:
    """borders.border_score of the bins of one map's fields."""
    import numpy as np

    if not len(field):
        return np.nan
    size = np.bincount(field)
    near = np.minimum(np.minimum(x, y), np.minimum(nx - 1 - x, ny - 1 - y))
    cover = max(np.bincount(field[wall], minlength=len(size)).max() / of for wall, of in ((x == 0, ny), (x == nx - 1, ny), (y == 0, nx), (y == ny - 1, nx)))
    share = (near + 0.5) / ((min(nx, ny) - 1) // 2 + 0.5)
    far = (np.bincount(field, rate * share) / np.bincount(field, rate)).mean()
    return (cover - far) / (cover + far) if cover + far else np.nan


def _speed_sums(at, speed, sd: float):
    """(speed smoothed twice at each sample from 0 on, nan without one, mean and variance of the speed smoothed once), as behaviour.smoothed with reflected edges gives them."""
    import numpy as np

    w = kernel_weights(sd)
    series = np.full(at[-1] + 1, np.nan)
    series[at] = speed

    def smooth(v):
        wide = np.pad(v, len(w) // 2, "symmetric")
        known = ~np.isnan(wide)
        sums, share = np.convolve(np.where(known, wide, 0.0), w, "valid"), np.convolve(known.astype(float), w, "valid")
        out = np.full(len(v), np.nan)
        out[at] = np.where(share > 1e-12, sums / np.where(share > 1e-12, share, 1.0), np.nan)[at]
        return out

    once = smooth(series)
    some = once[~np.isnan(once)]
    return smooth(once), some.mean() if len(some) else np.nan, some.var() if len(some) else np.nan


def _scorer(only, at, x, y, angle, half, speed, time, bin_px: float, smooth: float, dt: float, least: int, speed_sd: float, least_bins: int, ephys_rate: float):
    """score(t): the SCORES that only names, as a list, of spikes at t in a session of samples (nan: null; angle: the bin of a direction, below 0 for none)."""
    import numpy as np

    rows, known = len(at), ~np.isnan(time)
    end = time[known].max() if known.any() else np.nan
    step = (end - time[known].min()) / (rows - 1) if known.any() and rows > 1 else 0.0
    placed = ~np.isnan(x) & ~np.isnan(y)
    kernel = lambda of: maps._kernel_map(x[of], y[of], bin_px, smooth, smooth)
    base = kernel(placed) if placed.any() else None
    there = ~np.isnan(at)
    order = np.flatnonzero(there)[np.argsort(at[there], kind="stable")]
    index = at[order].astype(np.int64)
    mapped = base is not None and not {"spatial_information", "grid_score", "border_score", "stability"}.isdisjoint(only)
    if mapped:
        x0, y0, whole, n0 = base
        seen = n0 >= least
        reach = int(6 * smooth // bin_px) + 1
        bx, by = np.arange(x0, x0 + whole.shape[0]), np.arange(y0, y0 + whole.shape[1])
        nx, ny = (first + np.flatnonzero((n0 > 0).any(axis=k))[-1] + 1 if (n0 > 0).any() else 0 for first, k in ((x0, 1), (y0, 0)))
        dense = len(order) * (len(bx) + len(by)) <= 20_000_000

        def factors(v, bins):
            near = np.abs(np.floor(v / bin_px)[:, None] - bins) <= reach
            return np.where(near, np.exp(-((v[:, None] - (bins + 0.5) * bin_px) ** 2) / (2 * smooth * smooth)), 0.0)

        own_x, own_y, ok = x[order], y[order], placed[order]
        of_half = half[order]
        if dense:
            fx, fy = factors(np.where(ok, own_x, 0.0), bx), factors(np.where(ok, own_y, 0.0), by)

        def sums(hit):
            if not len(hit):
                return np.zeros(whole.shape)
            if dense:
                return fx[hit].T @ fy[hit]
            mine = maps._kernel_map(own_x[hit], own_y[hit], bin_px, smooth, None)
            return maps._beside(mine, x0, y0, whole.shape)[0]

        if "stability" in only:
            sides = [maps._beside(kernel(placed & (half == h)), x0, y0, whole.shape) if (placed & (half == h)).any() else (np.zeros(whole.shape), np.zeros(whole.shape, np.int64)) for h in (1, 2)]
            both = (sides[0][1] >= least) & (sides[1][1] >= least)
    sine, cosine = (f(np.radians(np.arange(360) - 179.0)) for f in (np.sin, np.cos))
    if "speed_score" in only and len(order):
        twice, mean, var = _speed_sums(index, speed[order], speed_sd)
        w = kernel_weights(speed_sd)

    def speeds(t):
        if not len(order) or not end > 0:
            return np.nan
        t = t[(t >= 0) & (t <= end * ephys_rate)]
        c = np.bincount(np.minimum(np.floor(t * rows / (end * ephys_rate)).astype(np.int64), rows - 1), minlength=rows)
        fired = np.flatnonzero(c)
        fired = fired[np.isin(fired, index)]
        if not len(fired):
            return np.nan
        series = np.zeros(rows)
        series[fired] = c[fired]
        smoothed = np.convolve(np.pad(series, len(w) // 2, "symmetric"), w, "valid")
        total, q = series.sum(), (smoothed * smoothed).sum()
        spread = q - total * total / rows
        if not (spread > 1e-12 * q and var > 1e-20 * mean * mean):
            return np.nan
        return ((series[fired] * twice[fired]).sum() - total * mean) / np.sqrt(spread * rows * var)

    def score(t):
        found = dict.fromkeys(only, np.nan)
        hit = np.zeros(0, np.int64)
        if step:
            near = np.rint(t[t / ephys_rate < end] / (step * ephys_rate)).astype(np.int64)
            low, high = np.searchsorted(index, near, "left"), np.searchsorted(index, near, "right")
            many = high - low
            hit = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        if "hd_score" in found or "rayleigh_p" in found:
            b = angle[order][hit]
            n = np.bincount(b[b >= 0], minlength=360)
            if n.any():
                n = _circular_sums(n[None, :])[0].astype(float)
                total, r = n.sum(), np.hypot((sine * n).sum(), (cosine * n).sum())
                for c, v in (("hd_score", r / total), ("rayleigh_p", np.exp(np.sqrt(1 + 4 * total + 4 * (total * total - r * r)) - (1 + 2 * total)))):
                    if c in found:
                        found[c] = v
        if "speed_score" in found:
            found["speed_score"] = speeds(t)
        if not mapped:
            return list(found.values())
        mine = hit[ok[hit]]
        if "stability" in found:
            one, two = (sums(mine[of_half[mine] == h]) for h in (1, 2))
            rest = mine[(of_half[mine] != 1) & (of_half[mine] != 2)]
            top = one + two + sums(rest) if len(rest) else one + two
            if len(hit):
                pair = [np.where(p[both] > 0, s[both] / np.where(p[both] > 0, p[both] * dt, 1.0), 0.0) for s, (p, _) in zip((one, two), sides, strict=True)]
                found["stability"] = firing_fields._corr(*pair)
        else:
            top = sums(mine)
        some = (top > 0) & (whole > 0)
        if not some.any():
            return list(found.values())
        u = np.where(some & seen, top / np.where(some, whole * dt, 1.0), 0.0)
        if "spatial_information" in found:
            on = some & seen
            p, rate = n0[on] / n0[seen].sum() if on.any() else np.zeros(0), u[on]
            mean_rate, up = (p * rate).sum(), rate > 0
            if mean_rate > 0:
                found["spatial_information"] = (p[up] * rate[up] * np.log2(rate[up] / mean_rate)).sum() / mean_rate
        if "grid_score" in found:
            grid = firing_fields.grid_score_of(u, some, 0.2, 20)
            found["grid_score"] = grid[0] if len(grid) else np.nan
        if "border_score" in found:
            field, fx_, fy_, _, rate = firing_fields.fields_of(u, some, x0, y0, 0.35, least_bins, 0.1)
            found["border_score"] = _border_score(field, fx_, fy_, rate, nx, ny)
        return list(found.values())

    return score


def shuffled_scores(spikes: DataFrame, position: DataFrame, n: int, length: int, guard: int, session_keys, cell_keys, bin_px: float, smooth: float, dt: float, least: int, speed_sd: float, least_bins: int = 45, ephys_rate: float = 30000.0, own: bool = False, only=None, per_sample: bool = False) -> DataFrame:
    """(cell_keys, shuffle_id, SCORES or those that only names) of n copies of each cell's spikes (time_shifts with t in samples), and with own of the cell's own spikes as shuffle_id -1.

    position: session_keys, pos_idx, synced_time, x_px, y_px, hd, half, speed; pos_idx from 0 without gaps. length: of the session, or with per_sample of each of its positions. A session's positions and its cells' spikes are one group,
    which must fit into a task: a copy's scores are made there one after the other, and neither copies nor their maps are rows of a shuffle. Kernel factors of the samples are made once for all copies. Scores that a map has no ground for are null.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    session_keys, cell_keys = list(session_keys), list(cell_keys)
    only = [c for c in SCORES if only is None or c in only]
    trains = spikes.where(" and ".join(f"`{k}` is not null" for k in cell_keys)).groupBy(*cell_keys).agg(F.collect_list(F.col("t").cast("long")).alias("__t"))
    trains = trains.withColumn("__head", F.concat_ws("-", F.lit("shift"), *(F.col(k).cast("string") for k in cell_keys)))
    turn = F.when(F.col("hd").isNotNull(), F.pmod(F.least(F.floor(F.col("hd") + 180), F.lit(359)), F.lit(360)))
    double = {"pos_idx": "__at", "x_px": "__x", "y_px": "__y", "half": "__h", "speed": "__v", "synced_time": "__s"}
    samples = position.where(" and ".join(f"`{k}` is not null" for k in session_keys))  # as spikes, so that both may come from one shuffle
    samples = samples.select(*session_keys, F.coalesce(turn.cast("long"), F.lit(-1)).alias("__b"), *(F.col(c).cast("double").alias(name) for c, name in double.items()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trains.select(*cell_keys).schema) + ", shuffle_id int, " + ", ".join(f"{c} double" for c in only)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def scored(cells: pa.Table, rows: pa.Table) -> pa.Table:
        if not cells.num_rows or (per_sample and not rows.num_rows):
            return arrow.empty_table()
        at, x, y, half, speed, time = (rows[c].to_numpy() for c in double.values())
        score = _scorer(only, at, x, y, rows["__b"].to_numpy(), half, speed, time, bin_px, smooth, dt, least, speed_sd, least_bins, ephys_rate)
        whole = length * rows.num_rows if per_sample else length
        times, found = cells["__t"].combine_chunks(), []
        for i, head in enumerate(cells["__head"].to_pylist()):
            t = times[i].values.to_numpy()
            if own:
                found.append(score(t))
            if n:
                found += [score((t + by) % whole) for by in guard + _draws(head, range(n), whole - 2 * guard)]
        copies = np.arange(-1 if own else 0, n, dtype=np.int32)
        owner = pa.array(np.repeat(np.arange(cells.num_rows), len(copies)))
        values = np.array(found, float).reshape(-1, len(only)).T
        return pa.Table.from_arrays([*(cells[k].combine_chunks().take(owner) for k in cell_keys), pa.array(np.tile(copies, cells.num_rows)), *(pa.array(v, mask=np.isnan(v)) for v in values)], [*cell_keys, "shuffle_id", *only])

    return trains.groupBy(*session_keys).cogroup(samples.groupBy(*session_keys)).applyInArrow(scored, schema)


def score_cutoffs(shuffled: DataFrame, cell_keys, z: float = 2.326, own: bool = False) -> DataFrame:
    """(cell_keys, each of SCORES that shuffled has with _cutoff): the mean of the shuffles' scores + z * their standard deviation (population); for p values, and for speed where its mean is below 0, minus. Null scores don't count.

    own: shuffled has the cells' own scores too (shuffle_id -1), which don't count and are given beside.
    """
    of = lambda c: F.when(F.col("shuffle_id") >= 0, F.col(c)) if own else F.col(c)
    up = lambda c: F.avg(of(c)) + z * F.stddev_pop(of(c))
    down = lambda c: F.avg(of(c)) - z * F.stddev_pop(of(c))
    rule = {"rayleigh_p": down, "speed_score": lambda c: F.when(F.avg(of(c)) < 0, down(c)).otherwise(up(c))}
    there = [c for c in SCORES if c in shuffled.columns]
    mine = [F.max(F.when(F.col("shuffle_id") < 0, F.col(c))).alias(c) for c in there] if own else []
    return shuffled.groupBy(*cell_keys).agg(*mine, *(rule.get(c, up)(c).alias(f"{c}_cutoff") for c in there))


def _copies(spikes: DataFrame, position: DataFrame, n: int, length: int, guard: int, session_keys, cell_keys, bar: str, bins: int, part: str | None, parts: int, ephys_rate: float, seed: str, finish, more: str) -> DataFrame:
    """(cell_keys, shuffle_id, more) of each cell's own spikes and of their copies as shuffled_rates counts them.

    finish(count, fired, seen) gives which rows stay, and their columns: count and fired have a row for each copy, count one column for each part and bar in turn, fired one for each part; seen are the session's samples of each part and bar.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    session_keys, cell_keys = list(session_keys), list(cell_keys)
    names = [c.split()[0] for c in more.split(", ")]
    offsets = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(guard) + keyed_draw(F.lit(length - 2 * guard), F.lit(seed), *cell_keys, k))
    trains = spikes.where(" and ".join(f"`{k}` is not null" for k in session_keys)).groupBy(*cell_keys).agg(F.collect_list(F.col("t").cast("long")).alias("__t")).withColumn("__moves", offsets)
    places = position.select(*session_keys, F.col("pos_idx").cast("long").alias("__at"), F.col("synced_time").cast("double").alias("__s"), (F.coalesce(F.col(part).cast("long"), F.lit(0)) if part else F.lit(1).cast("long")).alias("__p"), F.coalesce(F.col(bar).cast("long"), F.lit(-1)).alias("__b"))
    size = parts * bins
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trains.select(*cell_keys).schema) + f", shuffle_id int, {more}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def counted(cells: pa.Table, samples: pa.Table) -> pa.Table:
        if not samples.num_rows:
            return arrow.empty_table()
        time = samples["__s"].drop_null().to_numpy()
        step = (time.max() - time.min()) / (samples.num_rows - 1) if len(time) and samples.num_rows > 1 else 0.0
        samples = samples.filter(samples["__at"].is_valid())
        at, of, b = (samples[c].to_numpy() for c in ("__at", "__p", "__b"))
        order = np.argsort(at, kind="stable")
        at, of, b = at[order], of[order] - 1, b[order]
        code = np.where((b >= 0) & (of >= 0), of * bins + b, -1)
        seen = np.bincount(code[code >= 0], minlength=size)
        apart = not len(at) or at[-1] - at[0] + 1 == len(at) == len(np.unique(at))
        who, found = [], []
        moves, trains_ = (cells[c].combine_chunks() for c in ("__moves", "__t"))
        for i in range(cells.num_rows):
            t, by = trains_[i].values.to_numpy(), moves[i].values.to_numpy()
            many_copies = max(1, 1_000_000 // max(1, len(t), size))
            for first in range(-1, n, many_copies):
                last = min(n, first + many_copies)
                moved = (t + by[max(0, first) : last, None]) % length
                if first < 0:
                    moved = np.concatenate([t[None, :], moved])
                rows = np.broadcast_to(np.arange(last - first)[:, None], moved.shape)
                if step and len(at):
                    hit = moved / ephys_rate < time.max()
                    index, rows = np.rint(moved[hit] / (step * ephys_rate)).astype(np.int64), rows[hit]
                    if apart:
                        there = (index >= at[0]) & (index <= at[-1])
                        index, rows = index[there] - at[0], rows[there]
                    else:
                        low, high = np.searchsorted(at, index, "left"), np.searchsorted(at, index, "right")
                        many = high - low
                        rows = np.repeat(rows, many)
                        index = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
                else:
                    index, rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
                valid, known = of[index] >= 0, code[index] >= 0
                fired = np.bincount(rows[valid] * parts + of[index][valid], minlength=(last - first) * parts).reshape(-1, parts)
                count = np.bincount(rows[known] * size + code[index][known], minlength=(last - first) * size).reshape(-1, size)
                stay, columns = finish(count, fired, seen)
                found.append(columns)
                copy = np.arange(first, last)[stay]
                who.append((np.full(len(copy), i), copy))
        if not who:
            return arrow.empty_table()
        owner, copy = (np.concatenate([w[k] for w in who]) for k in (0, 1))
        values = [pa.concat_arrays(c) if isinstance(c[0], pa.Array) else pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
        own = [cells[k].combine_chunks().take(pa.array(owner, pa.int64())) for k in cell_keys]
        return pa.Table.from_arrays([*own, pa.array(copy, pa.int32()), *values], [*cell_keys, "shuffle_id", *names])

    return trains.groupBy(*session_keys).cogroup(places.groupBy(*session_keys)).applyInArrow(counted, schema)


def shuffled_rates(spikes: DataFrame, position: DataFrame, n: int, length: int, guard: int, session_keys, cell_keys, bar: str, bins: int, part: str | None = None, parts: int = 1, ephys_rate: float = 30000.0, seed: str = "shift") -> DataFrame:
    """(cell_keys, shuffle_id, n, rates) of each cell's own spikes (shuffle_id -1) and of n time-shifted copies of them (time_shifts with t in samples).

    position: session_keys, pos_idx, synced_time, bar (0 to bins - 1; null: none) and part (1 to parts). rates: spikes by samples for each part and bar in turn, null where the session has no
    samples; n: the spikes of each part that have a sample. Spikes meet samples as in joins.spikes_to_positions. A session's samples and its cells' spikes are one group,
    in which all copies are moved and counted: neither copies nor their samples are rows of a shuffle.
    """
    import numpy as np
    import pyarrow as pa

    def by_samples(count, fired, seen):
        lists = lambda values, k: pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1) * k, pa.int32()), values)
        none = np.broadcast_to(seen == 0, count.shape)
        rates = np.divide(count, seen, out=np.zeros(count.shape), where=~none)
        return np.ones(len(count), bool), [lists(pa.array(fired.ravel(), pa.int64()), parts), lists(pa.array(rates.ravel(), mask=none.ravel()), bins * parts)]

    return _copies(spikes, position, n, length, guard, session_keys, cell_keys, bar, bins, part, parts, ephys_rate, seed, by_samples, "n array<long>, rates array<double>")


def shuffled_stability(spikes: DataFrame, position: DataFrame, n: int, length: int, guard: int, session_keys, cell_keys, bins: int) -> DataFrame:
    """(cell_keys, shuffle_id, r): correlation of the halves' direction rates of each time-shifted copy, and of the cell's own spikes (shuffle_id -1). position: half, hd and what the join needs.

    Cells and copies without a spike in one of the halves give no row; directions without samples count 0.
    """
    at = F.when(F.col("hd").isNotNull(), F.least(F.floor((F.col("hd") + 180) / (360 / bins)), F.lit(bins - 1)))
    rates = shuffled_rates(spikes, position.withColumn("__bar", at), n, length, guard, session_keys, cell_keys, "__bar", bins, "half", 2)
    side = lambda first, name: F.transform(F.slice("rates", first, bins), lambda v: F.coalesce(v, F.lit(0.0))).alias(name)
    both = rates.where((F.col("n")[0] > 0) & (F.col("n")[1] > 0)).select(*cell_keys, "shuffle_id", F.arrays_zip(side(1, "a"), side(bins + 1, "b")).alias("__z"))
    both = both.select(*cell_keys, "shuffle_id", F.explode("__z").alias("__z")).select(*cell_keys, "shuffle_id", F.col("__z.a").alias("__a"), F.col("__z.b").alias("__b"))
    return both.groupBy(*cell_keys, "shuffle_id").agg(safe_corr("__a", "__b").alias("r"))


def drawn_samples(cells: DataFrame, samples: DataFrame, n: int, group_keys, cell_keys, spikes: str, seed: str, weight: Column | None = None) -> DataFrame:
    """Rows of samples drawn with replacement for each cell and shuffle: as many as the cell's column spikes says, n shuffles.

    samples belong to a cell's group_keys (those of a session, or of a field). Draws are uniform, or in proportion to weight (0 or more; null counts as 0): the
    running sum of weights gives each sample an interval, and a draw meets the interval that holds it in one sort.
    """
    w = Window.partitionBy(*group_keys)
    order = [c for c in samples.columns if c not in group_keys]
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def draws(size: DataFrame) -> DataFrame:
        """One row per draw; cells meet their size before they grow, and are dealt to all tasks."""
        few = cells.select(*cell_keys, F.col(spikes).alias("__n")).where("__n > 0").join(size, list(group_keys)).repartition(parts)
        few = few.withColumn("shuffle_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return few.withColumn("__d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n").cast("long"))))

    key = (F.lit(seed), *cell_keys, "shuffle_id", "__d")
    if weight is None:
        numbered = samples.withColumn("__row", F.row_number().over(w.orderBy(*order)) - 1)
        size = samples.groupBy(*group_keys).agg(F.count("*").alias("__size"))
        at = draws(size).withColumn("__row", keyed_draw(F.col("__size"), *key).cast("int"))
        return at.select(*cell_keys, "shuffle_id", *(k for k in group_keys if k not in cell_keys), "__row").join(numbered, [*group_keys, "__row"]).drop("__row")
    heavy = samples.withColumn("__w", F.coalesce(weight, F.lit(0.0))).where("__w > 0")
    heavy = heavy.withColumn("__to", F.sum("__w").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    whole = heavy.groupBy(*group_keys).agg(F.max("__to").alias("__all"))
    at = draws(whole).withColumn("__to", keyed_draw(F.lit(1 << 40), *key) / float(1 << 40) * F.col("__all"))
    row = F.struct(*order)
    kind = heavy.select(row.alias("r")).schema["r"].dataType
    both = at.select(*group_keys, "__to", F.struct(*cell_keys, "shuffle_id").alias("__c"), F.lit(None).cast(kind).alias("__r"), F.lit(1).alias("__p"))
    both = both.unionByName(heavy.select(*group_keys, "__to", F.lit(None).cast(both.schema["__c"].dataType).alias("__c"), row.alias("__r"), F.lit(0).alias("__p")))
    # in falling order the last sample met is the first whose interval ends beyond the draw
    back = w.orderBy(F.desc("__to"), "__p").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("__r", F.last("__r", ignorenulls=True).over(back)).where("__p = 1 and __r is not null")
    kept = [F.col("__c")[k].alias(k) for k in [*cell_keys, "shuffle_id"]] + [F.col(k) for k in group_keys if k not in cell_keys]
    return hit.select(*kept, *(F.col("__r")[c].alias(c) for c in order if c not in cell_keys))


def _drawn(spikes: DataFrame, position: DataFrame, n: int, session_keys, cell_keys, seed: str, angle: str, bins: int, finish, more: str, field: tuple | None = None, ephys_rate: float = 30000.0) -> DataFrame:
    """(cell_keys, more) of histograms of an angle from -180 to 180 in samples drawn with replacement, n times as many as a cell has spikes with a sample: those of drawn_samples and direction_histograms.

    spikes: cell_keys, t_sample; position: session_keys, pos_idx, synced_time, angle. Samples are those of the session, or with field = (bin size of x_px and y_px, rule) those of each of the cell's fields, which
    then get field_id: rule(bin_x, bin_y, spikes) gives the field of each bin with spikes, below 0 for none. finish(count, seen) gives columns: count has a row for each draw and a column for each bin, seen are the samples of the bins.
    A session's samples and its cells' spikes are one group, in which all draws are made and counted.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    session_keys, cell_keys = list(session_keys), list(cell_keys)
    names = [*(["field_id"] if field else []), *(c.split()[0] for c in more.split(", "))]
    trains = spikes.where(" and ".join(f"`{k}` is not null" for k in (cell_keys if field else session_keys))).groupBy(*cell_keys).agg(F.collect_list(F.col("t_sample").cast("long")).alias("__t"))
    trains = trains.withColumn("__head", F.concat_ws("-", F.lit(seed), *(F.col(k).cast("string") for k in cell_keys)))
    turn = F.when(F.col(angle).isNotNull(), F.least(F.floor((F.col(angle) + 180) / (360 / bins)), F.lit(bins - 1)))
    places = [F.floor(F.col(c) / field[0]).cast("long").alias(name) for c, name in (("x_px", "__x"), ("y_px", "__y"))] if field else []
    samples = position.select(*session_keys, F.col("pos_idx").cast("long").alias("__at"), F.col("synced_time").cast("double").alias("__s"), F.col(angle).cast("double").alias("__a"), F.coalesce(turn.cast("long"), F.lit(-1)).alias("__b"), *places)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trains.select(*cell_keys).schema) + (", field_id long, " if field else ", ") + more
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def counted(cells: pa.Table, rows: pa.Table) -> pa.Table:
        time = rows["__s"].drop_null().to_numpy()
        if len(time) < 1 or rows.num_rows < 2 or time.max() == time.min():
            return arrow.empty_table()
        step, end = (time.max() - time.min()) / (rows.num_rows - 1), time.max()
        known = [rows[c].is_valid().to_numpy() for c in ("__at", "__a")]
        at, a = rows["__at"].fill_null(0).to_numpy(), rows["__a"].fill_null(0.0).to_numpy()
        order = np.lexsort((a, known[1], at, known[0]))  # nulls first, as in an ORDER BY
        bin_ = rows["__b"].to_numpy()[order]
        first = np.count_nonzero(~known[0])
        at = at[order][first:]
        if field:
            placed = (rows["__x"].is_valid().to_numpy() & rows["__y"].is_valid().to_numpy())[order]
            x, y = (rows[c].fill_null(0).to_numpy()[order] for c in ("__x", "__y"))
            x0, y0 = (v[placed].min() if placed.any() else 0 for v in (x, y))
            wide = int(y[placed].max() - y0 + 1) if placed.any() else 1
            spot = np.where(placed, (x - x0) * wide + (y - y0), -1)
        owner, found = [], []
        times, heads = cells["__t"].combine_chunks(), cells["__head"].to_pylist()
        for i, head in enumerate(heads):
            t = times[i].values.to_numpy()
            index = np.rint(t[t / ephys_rate < end] / (step * ephys_rate)).astype(np.int64)
            here, last = np.searchsorted(at, index, "left"), np.searchsorted(at, index, "right")
            if not field:
                parts = [(None, int((last - here).sum()), bin_)]
            else:
                many = last - here
                hit = first + np.repeat(here, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                spots, fired = np.unique(spot[hit][spot[hit] >= 0], return_counts=True)
                ids = np.asarray(field[1](spots // wide + x0, spots % wide + y0, fired))
                which = np.full(spot.max() + 2, -1)  # the last place is that of samples without a bin
                which[spots] = np.where(ids >= 0, np.unique(ids, return_inverse=True)[1], -1)
                of = which[spot]
                parts = [(f, int(fired[ids == f].sum()), bin_[of == k]) for k, f in enumerate(np.unique(ids)) if f >= 0]
            for f, size, b in parts:
                if not size or not len(b):
                    continue
                count = np.zeros((n, bins), np.int64)
                own = head if f is None else f"{head}-{f}"
                for k in range(n):
                    drawn = b[_draws(f"{own}-{k}", range(1, size + 1), len(b))]
                    count[k] = np.bincount(drawn[drawn >= 0], minlength=bins)
                columns = [np.asarray(c) for c in finish(count, np.bincount(b[b >= 0], minlength=bins))]
                owner.append(np.full(len(columns[0]), i))
                found.append(columns if f is None else [np.full(len(columns[0]), f), *columns])
        if not owner:
            return arrow.empty_table()
        owner = pa.array(np.concatenate(owner), pa.int64())
        values = [pa.array(np.concatenate(c)).cast(arrow.field(name).type) for name, c in zip(names, zip(*found, strict=True), strict=True)]
        return pa.Table.from_arrays([*(cells[k].combine_chunks().take(owner) for k in cell_keys), *values], [*cell_keys, *names])

    return trains.groupBy(*session_keys).cogroup(samples.groupBy(*session_keys)).applyInArrow(counted, schema)


def drawn_histograms(spikes: DataFrame, position: DataFrame, n: int, session_keys, cell_keys, seed: str, angle: str, bins: int, field: tuple | None = None) -> DataFrame:
    """(cell_keys, field_id with field, shuffle_id, bin, n) of n draws, see _drawn; bins without a draw give no row."""
    import numpy as np

    def rows(count, seen):
        copy, at = np.nonzero(count)
        return copy, at, count[copy, at]

    return _drawn(spikes, position, n, session_keys, cell_keys, seed, angle, bins, rows, "shuffle_id int, bin long, n long", field)


def drawn_ratios(spikes: DataFrame, position: DataFrame, n: int, session_keys, cell_keys, seed: str, angle: str, bins: int, field: tuple | None = None) -> DataFrame:
    """(cell_keys, field_id with field, shuffle_id, ratio): expected_ratios of n draws with the samples they are drawn from, see _drawn."""
    import numpy as np

    def ratios(count, seen):
        some = seen > 0
        share = count[:, some] / np.maximum(count.sum(1), 1)[:, None] + 1e-5
        return (np.arange(n), np.abs(np.log(share / (seen[some] / seen.sum() + 1e-5))).mean(1)) if some.any() else (np.zeros(0, int), np.zeros(0))

    return _drawn(spikes, position, n, session_keys, cell_keys, seed, angle, bins, ratios, "shuffle_id int, ratio double", field)


def drawn_spread(spikes: DataFrame, position: DataFrame, n: int, session_keys, cell_keys, seed: str, angle: str, bins: int, rate: float, field: tuple | None = None) -> DataFrame:
    """(cell_keys, field_id with field, bin, mean, sd, low, high, up, down): bars.bar_spread of the rates of n draws, drawn by the samples of a bin times rate, see _drawn."""
    import numpy as np

    from .bars import _percentile

    def spread(count, seen):
        at = np.flatnonzero(seen)
        v = np.sort(count[count.any(axis=1)][:, at] / seen[at] * rate, axis=0)
        if not len(v) or not len(at):
            return [np.zeros(0, int), *[np.zeros(0)] * 6]
        mean = v.mean(0)
        low, high = (np.array([_percentile(c, share) for c in v.T]) for share in (0.05, 0.95))
        return at, mean, v.std(0), low, high, high - mean, mean - low

    return _drawn(spikes, position, n, session_keys, cell_keys, seed, angle, bins, spread, "bin long, mean double, sd double, low double, high double, up double, down double", field)


def direction_histograms(drawn: DataFrame, keys, angle: str, bins: int) -> DataFrame:
    """(keys, shuffle_id, bin, n) of an angle from -180 to 180; rows without one are left out."""
    at = F.least(F.floor((F.col(angle) + 180) / (360 / bins)), F.lit(bins - 1))
    return drawn.where(F.col(angle).isNotNull()).groupBy(*keys, "shuffle_id", at.alias("bin")).agg(F.count("*").alias("n"))


def shuffled_stops(stops: DataFrame, keys, trials: int, n: int, low: float, high: float, width: float) -> DataFrame:
    """(keys, shuffle_id, bin, stops): share of trials with a stop in each bin when trials (with replacement) are drawn and their stops put anywhere on the track.

    stops: keys, trial, n_stops of every trial. Bins without a stop give no row.
    """
    w = Window.partitionBy(*keys)
    numbered = stops.withColumns({"__row": F.row_number().over(w.orderBy("trial")) - 1, "__size": F.count("*").over(w)})
    size = numbered.groupBy(*keys).agg(F.max("__size").alias("__size"))
    drawn = size.withColumn("shuffle_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    drawn = drawn.withColumn("__row", keyed_draw(F.col("__size"), F.lit("trial"), *keys, "shuffle_id", "__k").cast("int")).drop("__size")
    hit = drawn.join(numbered.select(*keys, "__row", "n_stops"), [*keys, "__row"]).where("n_stops > 0").withColumn("__s", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_stops").cast("long"))))
    bins = int((high - low) // width)
    hit = hit.withColumn("bin", keyed_draw(F.lit(bins), F.lit("stop"), *keys, "shuffle_id", "__k", "__s"))
    once = hit.select(*keys, "shuffle_id", "__k", "bin").distinct()
    return once.groupBy(*keys, "shuffle_id", "bin").agg((F.count("*") / trials).alias("stops"))


def expected_ratio(observed: DataFrame, expected: DataFrame, keys) -> DataFrame:
    """(keys, ratio): mean size of the log of observed by expected direction shares, both with 1e-5 added; bins missing on a side count as 0."""
    share = lambda df, name: df.join(df.groupBy(*keys).agg(F.sum("n").alias("__t")), list(keys)).select(*keys, "bin", F.try_divide(F.col("n").cast("double"), F.col("__t").cast("double")).alias(name))
    both = share(observed, "__o").join(share(expected, "__e"), [*keys, "bin"], "full_outer")
    add = lambda c: F.coalesce(c, F.lit(0.0)) + 1e-5
    return both.groupBy(*keys).agg(F.avg(F.abs(F.log(add("__o") / add("__e")))).alias("ratio"))


def expected_ratios(observed: DataFrame, expected: DataFrame, keys, n: int) -> DataFrame:
    """(keys, shuffle_id, ratio): expected_ratio of each of n shuffles of observed (keys, shuffle_id, bin, n) with the shares of expected (keys, bin, n), which hold for them all.

    The expected bins aren't repeated for each shuffle: what they add without draws is summed once for keys, and each drawn bin changes its own term.
    """
    keys = list(keys)
    own = [*keys, "shuffle_id"]
    size = lambda o, e: F.abs(F.log((o + 1e-5) / (e + 1e-5)))
    share = lambda df, by, name: df.join(df.groupBy(*by).agg(F.sum("n").alias("__t")), by).select(*by, "bin", F.try_divide(F.col("n").cast("double"), F.col("__t").cast("double")).alias(name))
    known = share(expected, keys, "__e")
    none = known.groupBy(*keys).agg(F.sum(size(F.lit(0.0), F.col("__e"))).alias("__s"), F.count("*").alias("__c")).withColumn("shuffle_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    whole = observed.groupBy(*own).agg(F.sum("n").alias("__t"))
    drawn = observed.join(known, [*keys, "bin"], "left").join(whole, own)
    o, e = F.try_divide(F.col("n").cast("double"), F.col("__t").cast("double")), F.coalesce("__e", F.lit(0.0))
    drawn = drawn.groupBy(*own).agg(F.sum(size(o, e) - F.when(F.col("__e").isNotNull(), size(F.lit(0.0), e)).otherwise(0.0)).alias("__d"), F.count_if(F.col("__e").isNull()).alias("__m"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return none.join(drawn, own, "full_outer").select(*own, ((zero("__s") + zero("__d")) / (zero("__c") + zero("__m"))).alias("ratio"))


def by_day(values: DataFrame, keys, day: str, value: str) -> DataFrame:
    """values with day_no from 1, first_day, and change: the value by that of the first day, for every day that a key has."""
    w = Window.partitionBy(*keys).orderBy(day)
    return values.withColumns({"day_no": F.row_number().over(w), "first_day": F.first(day).over(w), "change": F.try_divide(F.col(value).cast("double"), F.first(value).over(w).cast("double"))})
