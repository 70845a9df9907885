"""Firing fields as rows: their frame, their stability over halves of a session, and their directional modes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions
from ..functions.scalar import safe_corr
from .groups import group_of, in_groups
from .similarity import circular_linear


def field_frame(field_bins: DataFrame, spikes_in: DataFrame, samples_in: DataFrame, keys) -> DataFrame:
    """One row per field: bins, extent, peak rate, spikes, samples, mean place, and mean direction of spikes and samples.

    field_bins: keys, bin_x, bin_y, rate; spikes_in and samples_in: keys, x_px, y_px, hd of what lies in the field. Counts are 0 without any.
    """
    size = field_bins.groupBy(*keys).agg(F.count("*").alias("n_bins"), (F.max("bin_x") - F.min("bin_x") + 1).alias("width"), (F.max("bin_y") - F.min("bin_y") + 1).alias("height"), F.max("rate").alias("max_rate"))
    angle = lambda: F.degrees(F.atan2(F.avg(F.sin(F.radians("hd"))), F.avg(F.cos(F.radians("hd")))))
    fired = spikes_in.groupBy(*keys).agg(F.count("*").alias("n_spikes"), F.avg("x_px").alias("mean_x"), F.avg("y_px").alias("mean_y"), angle().alias("spike_angle"))
    seen = samples_in.groupBy(*keys).agg(F.count("*").alias("n_samples"), angle().alias("sample_angle"))
    out = size.join(fired, list(keys), "left").join(seen, list(keys), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_spikes", "n_samples")})


def direction_rates(spikes: DataFrame, samples: DataFrame, keys, sample_keys, bins: int, angle: str = "hd") -> DataFrame:
    """(keys, bin, ratio): spikes by samples in each direction bin, 0 where the samples have none. sample_keys: those of keys that samples have."""
    at = F.least(F.floor((F.col(angle) + 180) / (360 / bins)), F.lit(bins - 1))
    count = lambda df, k, name: df.where(F.col(angle).isNotNull()).groupBy(*k, at.alias("bin")).agg(F.count("*").alias(name))
    fired, seen = count(spikes, keys, "__n"), count(samples, sample_keys, "__o")
    grid = spikes.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    both = grid.join(fired, [*keys, "bin"], "left").join(seen, [*sample_keys, "bin"], "left")
    return both.select(*keys, "bin", F.coalesce(F.try_divide(F.coalesce("__n", F.lit(0)).cast("double"), F.col("__o").cast("double")), F.lit(0.0)).alias("ratio"))


def half_correlation(rates: DataFrame, keys) -> DataFrame:
    """(keys, r): correlation of direction rates (keys, half, bin, ratio) of halves 1 and 2; null where one is constant or missing."""
    side = lambda h, name: rates.where(F.col("half") == h).select(*keys, "bin", F.col("ratio").alias(name))
    return side(1, "__a").join(side(2, "__b"), [*keys, "bin"]).groupBy(*keys).agg(safe_corr("__a", "__b").alias("r"))


def _matrix(pdf: pd.DataFrame, row: np.ndarray, column: np.ndarray, value: str, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(different rows in order, their values by column; nan where there is none)."""
    names, at = np.unique(row, return_inverse=True)
    out = np.full((len(names), bins), np.nan)
    out[at, column] = pdf[value].to_numpy(float)
    return names, out


def _correlated(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values that both have, safe_corr) of each row of u with that of v; nan is no value."""
    both = ~np.isnan(u) & ~np.isnan(v)
    n = both.sum(1)
    some = np.maximum(n, 1)
    a, b = np.where(both, u, 0.0), np.where(both, v, 0.0)
    ma, mb = a.sum(1) / some, b.sum(1) / some
    a, b = np.where(both, a - ma[:, None], 0.0), np.where(both, b - mb[:, None], 0.0)
    va, vb, ab = (a * a).sum(1) / some, (b * b).sum(1) / some, (a * b).sum(1) / some
    varies = (n > 0) & (va > 1e-20 * ma**2) & (vb > 1e-20 * mb**2)
    return n, np.divide(ab, np.sqrt(va) * np.sqrt(vb), out=np.full(len(n), np.nan), where=varies)


#: Pairs of a cell that are correlated at once.
PAIRS = 20_000


def _pairs(rates: DataFrame, keys, item: str, columns: list[str], value: str, run, more: str) -> DataFrame:
    """Rows of run(rows of a cell) as (keys, more), many cells in a call: a cell's histograms are one group."""
    keys = list(keys)

    def whole(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        found, at = [], []
        for a, b in zip(starts, np.append(starts[1:], len(pdf)), strict=True):
            for part in run(pdf.iloc[a:b]):
                found.append(part)
                at.append(np.full(len(part), a))
        if not found:
            return pdf.iloc[:0][keys].assign(**{c.split()[0]: pd.Series([], dtype=object) for c in more.split(", ")})
        return pd.concat([pdf.iloc[np.concatenate(at)][keys].reset_index(drop=True), pd.concat(found, ignore_index=True)], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rates.select(*keys).schema)
    df = rates.select(*keys, item, *columns, F.col(value).cast("double").alias(value)).dropna(subset=[*keys, item, *columns, value])
    return in_groups(df, keys, whole, f"{kinds}, {more}")


def between_fields(rates: DataFrame, keys, item: str = "field_id", least: float = 0.4) -> DataFrame:
    """(keys, a, b, r): correlation of half 1 of field a with half 2 of field b (a and b differ) of one cell, for fields whose own halves correlate by least or more."""
    pairs = half_pairs(rates, keys, item, least)
    return pairs.where("a <> b").select(*keys, "a", "b", F.nanvl("r", F.lit(None).cast("double")).alias("r"))


def half_pairs(rates: DataFrame, keys, item: str = "field_id", least: float = 0.4) -> DataFrame:
    """(keys, a, b, r): between_fields, and with a = b the correlations of the fields' own halves where they reach least. r is nan where a half is constant. A cell's fields are one group."""

    def run(pdf: pd.DataFrame):
        _, column = np.unique(pdf["bin"].to_numpy(), return_inverse=True)
        half, field = pdf["half"].to_numpy(), pdf[item].to_numpy()
        bins = int(column.max()) + 1
        (names, u), (others, v) = (_matrix(pdf[half == h], field[half == h], column[half == h], "ratio", bins) for h in (1, 2))
        names, i, j = np.intersect1d(names, others, return_indices=True)
        u, v = u[i], v[j]
        own = _correlated(u, v)[1]
        good = own >= least  # false for nan
        names, u, v, own = names[good], u[good], v[good], own[good]
        for first in range(0, len(names) ** 2, PAIRS):
            a, b = np.divmod(np.arange(first, min(len(names) ** 2, first + PAIRS)), len(names))
            n, r = _correlated(u[a], v[b])
            r = np.where(a == b, own[a], r)
            yield pd.DataFrame({"a": names[a], "b": names[b], "r": r})[n > 0]

    kind = rates.schema[item].dataType.simpleString()
    return _pairs(rates.where("half in (1, 2)"), keys, item, ["half", "bin"], "ratio", run, f"a {kind}, b {kind}, r double")


def within_and_between(rates: DataFrame, keys, item: str = "field_id", least: float = 0.4) -> DataFrame:
    """(keys, sample, r): correlations of both halves of the fields that reach least (sample 0), and of halves of different such fields of a cell (sample 1), for two-sample tests."""
    return half_pairs(rates, keys, item, least).where(~F.isnan("r")).select(*keys, F.when(F.col("a") == F.col("b"), 0).otherwise(1).alias("sample"), "r")


def field_pairs(rates: DataFrame, field_bins: DataFrame, keys, item: str, bins: int, value: str = "ratio") -> DataFrame:
    """(keys, a, b, r, distance, turn): each two fields of a cell (a < b) with the correlation of their direction rates, the distance of their middles in bins of the map, and the
    turn of b in direction bins with the highest correlation.

    A field's middle is the median of its distinct columns and that of its rows, without their fractions. turn is null where no turn has a correlation.
    """
    middle = lambda c: F.floor((F.element_at(c, ((F.size(c) + 1) / 2).cast("int")) + F.element_at(c, (F.size(c) / 2).cast("int") + 1)) / 2)
    spots = field_bins.groupBy(*keys, item).agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in ("bin_x", "bin_y")))
    spots = spots.select(*keys, item, middle("bin_x").alias("x"), middle("bin_y").alias("y"))
    side = lambda n: spots.select(*keys, F.col(item).alias(n), F.col("x").alias(f"__x{n}"), F.col("y").alias(f"__y{n}"))
    apart = F.hypot((F.col("__xa") - F.col("__xb")).cast("double"), (F.col("__ya") - F.col("__yb")).cast("double"))
    far = side("a").join(side("b"), list(keys)).where("a < b").select(*keys, "a", "b", apart.alias("distance"))
    same = [*keys, "a", "b"]
    turned = paired_turns(rates, keys, item, "bin", bins, value)
    r = F.transform("turns", lambda v: F.round(v, 6))
    best = F.array_max(r)
    return turned.where("n > 0").select(*same, F.col("turns")[0].alias("r"), F.when(best.isNotNull(), F.array_position(r, best).cast("int") - 1).alias("turn")).join(far, same).select(*same, "r", "distance", "turn")


def paired_turns(hist: DataFrame, keys, item: str, bin_col: str, bins: int, value: str) -> DataFrame:
    """(keys, a, b, n, turns): for each two items of a group (a < b) the correlations of a with b turned by 0 to bins - 1 bins, over bins that both have (n: without a turn); null where one is constant. A group's items come together, many groups in a call."""

    def run(pdf: pd.DataFrame):
        names, m = _matrix(pdf, pdf[item].to_numpy(), pdf[bin_col].to_numpy().astype(int) % bins, value, bins)
        i, j = np.triu_indices(len(names), 1)
        for first in range(0, len(i), PAIRS):
            a, b = i[first : first + PAIRS], j[first : first + PAIRS]
            u, v = m[a], m[b]
            found = [_correlated(u, np.roll(v, k, axis=1)) for k in range(bins)]
            ever = np.any([n > 0 for n, _ in found], axis=0)
            turns = np.stack([r for _, r in found], axis=1)[ever]
            yield pd.DataFrame({"a": names[a][ever], "b": names[b][ever], "n": found[0][0][ever], "turns": list(turns)})

    kind = hist.schema[item].dataType.simpleString()
    out = _pairs(hist, keys, item, [bin_col], value, run, f"a {kind}, b {kind}, n long, turns array<double>")
    return out.withColumn("turns", F.transform("turns", lambda v: F.nanvl(v, F.lit(None).cast("double"))))


def pair_trends(pairs: DataFrame, keys, bins: int) -> DataFrame:
    """(keys, n, r, p, rho, rho_p) over pairs of fields with a correlation: that of distance with similarity, and the circular-linear one of the best turn with distance."""
    known = pairs.where(F.col("r").isNotNull() & F.col("turn").isNotNull()).withColumn("angle", F.col("turn") * (360.0 / bins))
    line = known.groupBy(*keys).agg(F.count("*").alias("n"), safe_corr("distance", "r").alias("r"))
    t = F.try_divide(F.col("r") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0)).cast("double")), F.sqrt(1 - F.col("r") * F.col("r")))
    line = line.withColumn("__t", t).withColumn("p", distributions.student_p("__t", F.col("n").cast("double") - 2)).drop("__t")
    turn = circular_linear(known, keys, "angle", "distance").select(*keys, "rho", F.col("p").alias("rho_p"))
    return line.join(turn, list(keys))


def against_shuffles(observed: DataFrame, shuffled: DataFrame, keys, value: str = "r") -> DataFrame:
    """(keys, observed, mean, sd, percentile): where the observed value lies among those of shuffles that have one."""
    both = observed.select(*keys, F.col(value).alias("observed")).join(shuffled.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v")), list(keys))
    below = F.count_if(F.col("__v") < F.col("observed")) + F.count_if(F.col("__v") <= F.col("observed"))
    return both.groupBy(*keys, "observed").agg(F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("sd"), (50.0 * below / F.count("*")).alias("percentile"))


def against_own(values: DataFrame, keys, value: str = "r") -> DataFrame:
    """against_shuffles of one table (keys, shuffle_id, value) in which the observed values have shuffle_id -1."""
    own, w = F.col("shuffle_id") < 0, Window.partitionBy(*keys)
    both = values.withColumns({"observed": F.max(F.when(own, F.col(value))).over(w), "__own": F.count_if(own).over(w)}).where((F.col("__own") > 0) & ~own & F.col(value).isNotNull())
    below = F.count_if(F.col(value) < F.col("observed")) + F.count_if(F.col(value) <= F.col("observed"))
    return both.groupBy(*keys, "observed").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), (50.0 * below / F.count("*")).alias("percentile"))


def rate_correlation(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """(keys, r, n): correlation of two maps (keys, bin_x, bin_y, rate) over bins above zero in both."""
    a, b = (df.where("rate > 0").select(*keys, "bin_x", "bin_y", F.col("rate").alias(n)) for df, n in ((left, "__a"), (right, "__b")))
    return a.join(b, [*keys, "bin_x", "bin_y"]).groupBy(*keys).agg(safe_corr("__a", "__b").alias("r"), F.count("*").alias("n"))


def _bessel(kappa: np.ndarray, order: int) -> np.ndarray:
    """exp(-kappa) * I_order(kappa), by its integral."""
    t = (np.arange(256) + 0.5) * np.pi / 256
    return (np.exp(np.asarray(kappa)[..., None] * (np.cos(t) - 1)) * np.cos(order * t)).mean(-1)


@lru_cache(maxsize=1)
def _concentrations(step: float = 0.005, most: float = 101.0):
    """(kappa, exp(-kappa) * I0(kappa), its slope, I1(kappa) / I0(kappa), the slope of kappa over that length) at even steps of kappa, fine enough for cubic pieces."""
    kappa = np.arange(0, most + step, step)
    zero, one = (np.concatenate([_bessel(part, order) for part in np.array_split(kappa, 64)]) for order in (0, 1))
    length = one / zero
    slope = 1 / np.append(0.5, 1 - length[1:] / kappa[1:] - length[1:] ** 2)
    return kappa, zero, one - zero, length, slope


def _cubic(x, at, value, slope):
    """Cubic pieces through values and slopes at rising places."""
    k = np.clip(np.searchsorted(at, x, "right") - 1, 0, len(at) - 2)
    wide = at[k + 1] - at[k]
    u = (x - at[k]) / wide
    v = 1 - u
    return v * v * ((1 + 2 * u) * value[k] + u * wide * slope[k]) + u * u * ((1 + 2 * v) * value[k + 1] - v * wide * slope[k + 1])


def von_mises_fits(weights: np.ndarray, k: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood, means, concentrations, shares) of k von Mises components for each row of weights of equal bins of the circle, by EM from spread starts; a row that is done leaves the others' steps."""
    n = weights.shape[1]
    kappas, zero, zero_slope, length, length_slope = _concentrations()
    angle = (np.arange(n) + 0.5) * 2 * np.pi / n - np.pi
    waves = np.stack([np.ones(n), np.cos(angle), np.sin(angle)])
    left, w = np.arange(len(weights)), weights
    mean = angle[weights.argmax(1)][:, None] + 2 * np.pi * np.arange(k) / k
    kappa, share, before = np.full(mean.shape, 2.0), np.full(mean.shape, 1 / k), np.full(len(w), -np.inf)
    found = np.empty(len(w)), *(np.empty(mean.shape) for _ in range(3))
    for _ in range(rounds):
        height = np.log(share / (2 * np.pi * _cubic(kappa, kappas, zero, zero_slope))) - kappa
        density = np.exp(np.stack([height, kappa * np.cos(mean), kappa * np.sin(mean)], axis=-1) @ waves)
        mixed = np.maximum(density.sum(1), 1e-300)
        value = (w * np.log(mixed)).sum(1)
        done = value - before < 1e-9 * np.maximum(1.0, np.abs(value))
        if done.any():
            for room, of in zip(found, (before, mean, kappa, share), strict=True):
                room[left[done]] = of[done]
            left, w, value, mixed, density = (a[~done] for a in (left, w, value, mixed, density))
            if not len(left):
                break
        before = value
        density *= (w / mixed)[:, None, :]
        mass, c, s = np.moveaxis(density @ waves.T, -1, 0)
        mass = np.maximum(mass, 1e-12)
        mean, share = np.arctan2(s, c), mass / w.sum(1)[:, None]
        kappa = _cubic(np.clip(np.hypot(c, s) / mass, 0, 0.995), length, kappas, length_slope)
    for room, of in zip(found, (before, mean, kappa, share), strict=True):
        if len(left):
            room[left] = of
    return found


def von_mises_fit(weight: np.ndarray, k: int, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """von_mises_fits of one row of weights."""
    value, *more = (a[0] for a in von_mises_fits(np.asarray(weight, float)[None, :], k, rounds))
    return float(value), *more


def directional_modes(hist: DataFrame, keys, value: str, bins: int = 360, most: int = 5, window: int | None = None) -> DataFrame:
    """(keys, modes, mode, angle in degrees, kappa, share): the mixture of 1 to most von Mises components with the lowest BIC for each histogram.

    The histogram of one field (bins rows) is a group, many share a call and are fitted together; nothing is resampled, so the same histogram gives the same modes. window: odd width of a
    circular sum that is taken of the histogram first, as in maps.hd_histogram. Empty histograms give no row.
    """
    keys = list(keys)

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        weights = np.zeros((len(starts), bins))
        np.add.at(weights, (group_of(starts, len(pdf)), pdf["bin"].to_numpy(int) % bins), pdf["__v"].to_numpy(float))
        if window is not None:
            weights = sum(np.roll(weights, d, axis=1) for d in range(-(window // 2), window - window // 2))
        some = np.flatnonzero(weights.sum(1) > 0)
        owner, columns = [], []
        for first in range(0, len(some), 32):
            rows = some[first : first + 32]
            w = weights[rows]
            fits = [von_mises_fits(w, k) for k in range(1, most + 1)]
            bic = [(3 * k - 1) * np.log(w.sum(1)) - 2 * fit[0] for k, fit in enumerate(fits, 1)]
            for i, row in enumerate(rows):
                best = 0
                for k in range(1, most):
                    if bic[k][i] < bic[best][i] - 1e-9:
                        best = k
                _, mean, kappa, share = (a[i] for a in fits[best])
                order = np.argsort(-share, kind="stable")
                owner.append(np.full(best + 1, starts[row]))
                columns.append((np.full(best + 1, best + 1), np.arange(best + 1), np.degrees(mean[order]), kappa[order], share[order]))
        at = np.concatenate(owner) if owner else np.zeros(0, int)
        names = ("modes", "mode", "angle", "kappa", "share")
        values = [np.concatenate(c) for c in zip(*columns, strict=True)] if columns else [np.zeros(0)] * 5
        return pdf[keys].iloc[at].reset_index(drop=True).assign(**dict(zip(names, values, strict=True)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hist.select(*keys).schema)
    return in_groups(hist.select(*keys, "bin", F.col(value).alias("__v")), keys, run, f"{kinds}, modes long, mode long, angle double, kappa double, share double")
