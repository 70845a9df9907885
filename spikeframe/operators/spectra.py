"""Spectra of spike trains and channels, theta scores and theta phase.

Long signals are cut into segments; a segment (some ten thousand samples) is one group, so the length of a signal
doesn't matter and segments run in parallel, many of them in one call. Means over segments and bands are native aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import group_of, in_groups, slices

#: Samples of all segments that are transformed at once.
CELLS = 2_000_000


def _kinds(df: DataFrame, keys) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def _with_keys(out: pd.DataFrame, pdf: pd.DataFrame, keys) -> pd.DataFrame:
    for k in reversed(list(keys)):
        out.insert(0, k, pdf[k].iloc[0])
    return out


def power(values: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, power density) of one segment, or of each row of segments: mean removed, periodic Hann window, one-sided."""
    n = values.shape[-1]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    p = np.abs(np.fft.rfft((values - values.mean(axis=-1, keepdims=True)) * window)) ** 2 / (rate * (window**2).sum())
    p[..., 1 : (n + 1) // 2] *= 2
    return np.arange(p.shape[-1]) * rate / n, p


def _summed(rows: pd.DataFrame, starts: np.ndarray, keys, freq: np.ndarray, p: np.ndarray) -> pd.DataFrame:
    """(keys, freq, p): spectra p of the segments that begin at starts, summed over those of equal keys."""
    heads = rows[list(keys)].iloc[starts].reset_index(drop=True)
    own = np.flatnonzero(np.diff(heads.groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy(), prepend=-1))
    p = np.add.reduceat(p, own, axis=0)
    return heads.iloc[np.repeat(own, len(freq))].reset_index(drop=True).assign(freq=np.tile(freq, len(own)), p=p.ravel())


def in_segments(df: DataFrame, keys, index: str, length: int, size: int, margin: int = 0) -> DataFrame:
    """Rows with segment, once for every segment that holds them or has them in its margin.

    Segments of length samples start every length // 2 samples; only whole ones of a signal of size samples exist.
    """
    step, last = length // 2, (size - length) // (length // 2)
    low = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(index) - margin - length + 1) / step))
    high = F.least(F.lit(last).cast("long"), F.floor((F.col(index) + margin) / step))
    return df.withColumns({"__low": low, "__high": high}).where("__low <= __high").withColumn("segment", F.explode(F.sequence("__low", "__high"))).drop("__low", "__high")


def welch(df: DataFrame, keys, index: str, value: str, rate: float, length: int, size: int, most: float | None = None) -> DataFrame:
    """(keys, freq, power) up to most Hz: mean power density over half-overlapping segments. Missing samples count as 0, so a sparse signal stays sparse.

    A signal shorter than a segment gives no rows.
    """
    step = length // 2

    def run(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out, at, value = [], (rows["__i"] - rows["segment"] * step).to_numpy(), rows["__v"].to_numpy(float)
        for a, b, first in slices(starts, len(rows), CELLS, length):
            v = np.zeros((len(first), length))
            v[group_of(first, b - a), at[a:b]] = value[a:b]
            freq, p = power(v, rate)
            keep = slice(None) if most is None else freq <= most
            out.append(_summed(rows, first + a, keys, freq[keep], p[:, keep]))
        return pd.concat(out, ignore_index=True)

    parts = in_segments(df.select(*keys, F.col(index).cast("long").alias("__i"), F.col(value).cast("double").alias("__v")), keys, "__i", length, size)
    each = in_groups(parts, [*keys, "segment"], run, f"{_kinds(df, keys)}, freq double, p double")
    return each.groupBy(*keys, "freq").agg((F.sum("p") / ((size - length) // step + 1)).alias("power"))


def theta_index(spikes: DataFrame, keys, ms: str, size: int, length: int = 10_000, sd: float = 5.0) -> DataFrame:
    """(keys, theta_index) from spike times in whole ms of a recording of size ms; null without power.

    Counts of 1 ms are smoothed (Gaussian of sd ms, then a running mean of two, in Hz); the spectrum times the
    frequency gives (theta - base) / (theta + base), theta at 6 to 10 Hz and base at 3 to 5 and 11 to 13 Hz.
    """
    step, reach = length // 2, int(4 * sd)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sd * sd))
    kernel /= kernel.sum()

    wide, spread = length + 4 * reach + 2, np.arange(2 * reach + 1)

    def run(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out, at, n = [], (rows["__i"] - rows["segment"] * step).to_numpy() + reach + 1, rows["n"].to_numpy(float)
        for a, b, first in slices(starts, len(rows), CELLS, wide):
            where = (group_of(first, b - a) * wide + at[a:b])[:, None] + spread  # each count gives its kernel, so empty stretches cost nothing
            smooth = np.bincount(where.ravel(), (n[a:b, None] * kernel).ravel(), len(first) * wide).reshape(len(first), wide)
            smooth = (smooth[:, 1:] + smooth[:, :-1])[:, 2 * reach : 2 * reach + length] / 2 * 500
            freq, p = power(smooth, 1000.0)
            keep = freq <= 15
            out.append(_summed(rows, first + a, keys, freq[keep], p[:, keep]))
        return pd.concat(out, ignore_index=True)

    counts = spikes.groupBy(*keys, F.col(ms).cast("long").alias("__i")).agg(F.count("*").alias("n"))
    each = in_groups(in_segments(counts, keys, "__i", length, size, reach + 1), [*keys, "segment"], run, f"{_kinds(spikes, keys)}, freq double, p double")
    spectrum = each.groupBy(*keys, "freq").agg((F.sum("p") * F.col("freq")).alias("p"))
    band = lambda *ends: F.avg(F.when(sum((F.col("freq").between(a, b).cast("int") for a, b in ends), F.lit(0)) > 0, F.col("p")))
    bands = spectrum.groupBy(*keys).agg(band((6, 10)).alias("theta"), band((3, 5), (11, 13)).alias("base"))
    return bands.select(*keys, F.try_divide(F.col("theta") - F.col("base"), F.col("theta") + F.col("base")).alias("theta_index"))


def correlogram_theta(correlogram: DataFrame, keys, lag: str, n: str, reach: int) -> DataFrame:
    """(keys, peak_freq, modulated) of auto-correlograms by ms lag within reach ms.

    The highest power at 4 to 11 Hz is the peak; a cell is modulated when the mean power within 1 Hz of it is more than five times
    the mean at 0 to 125 Hz. A correlogram (2 * reach + 1 rows at most) is one group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros(2 * reach + 1)
        v[pdf["__l"].to_numpy() + reach] = pdf["__n"].to_numpy(float)
        v[reach] = 0.0
        freq, p = power(v, 1000.0)
        keep = (freq > 0) & (freq <= 125)
        return _with_keys(pd.DataFrame({"freq": freq[keep], "p": p[keep]}), pdf, keys)

    rows = correlogram.where(F.abs(lag) <= reach).select(*keys, F.col(lag).cast("long").alias("__l"), F.col(n).alias("__n"))
    spectrum = rows.groupBy(*keys).applyInPandas(run, f"{_kinds(correlogram, keys)}, freq double, p double")
    theta = spectrum.where(F.col("freq").between(4, 11))
    peak = theta.groupBy(*keys).agg(F.max_by("freq", F.struct("p", -F.col("freq"))).alias("peak_freq"))
    both = spectrum.join(peak, list(keys)).groupBy(*keys, "peak_freq").agg(F.avg(F.when(F.abs(F.col("freq") - F.col("peak_freq")) <= 1, F.col("p"))).alias("near"), F.avg("p").alias("all"))
    return both.select(*keys, "peak_freq", (F.col("near") > 5 * F.col("all")).alias("modulated"))


def interpolated_spectrum(spectrum: DataFrame, keys, most: int = 20) -> DataFrame:
    """power at whole frequencies from 0 to most, linear between the two next ones."""
    own = Window.partitionBy(*keys)
    df = spectrum.withColumn("__w", F.min(F.when(F.col("freq") > 0, F.col("freq"))).over(own))  # frequencies are multiples of the lowest
    df = df.withColumn("__k", F.round(F.col("freq") / F.col("__w")).cast("long"))
    after = own.orderBy("__k")
    df = df.withColumn("__next", F.when(F.lead("__k").over(after) == F.col("__k") + 1, F.lead("power").over(after)))
    df = df.withColumn("hz", F.explode(F.filter(F.sequence(F.lit(0), F.lit(most)), lambda hz: F.floor(hz / F.col("__w") + 1e-9) == F.col("__k"))))
    part = F.col("hz") / F.col("__w") - F.col("__k")
    return df.select(*keys, "hz", (F.col("power") + (F.coalesce("__next", "power") - F.col("power")) * F.greatest(part, F.lit(0.0))).alias("power"))


#: Bands in Hz.
BANDS = {"theta": (4, 12), "low_gamma": (30, 60), "mid_gamma": (60, 120), "high_gamma": (120, 180)}


def epoch_bands(df: DataFrame, keys, index: str, value: str, rate: float, length: int, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """(keys, epoch, mean power of each band) for every whole epoch of length samples; null where a band has no frequency."""

    def run(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out, at, value = [], (rows["__i"] % length).to_numpy(), rows["__v"].to_numpy(float)
        for a, b, first in slices(starts, len(rows), CELLS, length):
            v = np.zeros((len(first), length))
            v[group_of(first, b - a), at[a:b]] = value[a:b]
            whole = np.diff(np.append(first, b - a)) == length
            freq, p = power(v[whole], rate)
            head = rows[[*keys, "__e"]].iloc[(first + a)[whole]].rename(columns={"__e": "epoch"}).reset_index(drop=True)
            inside = {band: (freq >= lo) & (freq <= hi) for band, (lo, hi) in bands.items()}
            out.append(head.assign(**{band: p[:, at_].mean(axis=1) if at_.any() else np.nan for band, at_ in inside.items()}))
        return pd.concat(out, ignore_index=True)

    rows = df.select(*keys, F.col(index).cast("long").alias("__i"), F.col(value).cast("double").alias("__v"))
    rows = rows.withColumn("__e", F.floor(F.col("__i") / length))
    names = ", ".join(f"{b} double" for b in bands)
    found = in_groups(rows, [*keys, "__e"], run, f"{_kinds(df, keys)}, epoch long, {names}")
    return found.withColumns({b: F.nanvl(b, F.lit(None).cast("double")) for b in bands})


def band_filter(n: int, rate: float, low: float, high: float) -> np.ndarray:
    """Response of a second-order Butterworth band-pass (bilinear transform) at the frequencies of rfft of n samples."""
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    lo, hi = warp(low), warp(high)
    s = 1j * warp(np.minimum(np.fft.rfftfreq(n, 1 / rate), rate / 2 * (1 - 1e-9)))
    with np.errstate(divide="ignore", invalid="ignore"):
        q = (s * s + lo * hi) / (s * (hi - lo))
        return np.where(s == 0, 0, 1 / (q * q + np.sqrt(2) * q + 1))


def theta_phase(df: DataFrame, keys, index: str, value: str, rate: float, low: float = 5.0, high: float = 9.0, chunk: float = 60.0, margin: float = 4.0) -> DataFrame:
    """(keys, index, phase in radians) of every sample: band-pass, then the angle of the analytic signal.

    Chunks of chunk seconds are filtered with margin seconds of their neighbours on both sides, in which the filter's
    response has died down. Missing samples count as 0.
    """
    long, edge = int(chunk * rate), int(margin * rate)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(pdf["__c"].iloc[0]) * long - edge
        at = pdf["__i"].to_numpy() - start
        v = np.zeros(long + 2 * edge)
        v[at] = pdf["__v"].to_numpy(float)
        n = len(v)
        spectrum = np.fft.rfft(v - v[at].mean()) * band_filter(n, rate, low, high)
        full = np.zeros(n, complex)
        full[: len(spectrum)] = spectrum
        full[1 : (n + 1) // 2] *= 2
        phase = np.angle(np.fft.ifft(full))
        mine = at[(at >= edge) & (at < edge + long)]
        return _with_keys(pd.DataFrame({index: mine + start, "phase": phase[mine]}), pdf, keys)

    rows = df.select(*keys, F.col(index).cast("long").alias("__i"), F.col(value).cast("double").alias("__v"))
    rows = rows.withColumn("__c", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("__i") - edge) / long)), F.floor((F.col("__i") + edge) / long))))
    return rows.groupBy(*keys, "__c").applyInPandas(run, f"{_kinds(df, keys)}, `{index}` long, phase double")
