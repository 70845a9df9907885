"""Periodic runs of words by internal pattern matching.

A run of period q and length 4 * q or more holds an aligned dyadic block of 2^k words, with q between 3/4 and 3/2 of the block's
length, and its copy q words on. So each aligned block asks where it occurs again in the window at those distances: its
occurrences are a range of the suffix array, and a wavelet tree over the suffix array counts the range's positions in a window and finds the
next ones (range successor). Few of them are candidates themselves; many of them are progressions, whose difference is the block's own period, and
then the candidates are the distances that match the first or the last words of the two stretches of that period around the block
and its copy. A candidate period is extended to both sides as far as words agree, by the dyadic names of the words at both places.

The texts of a step (about STEP_BYTES) have one suffix array, made by doubling: only suffixes that share their prefix
with another one of their text are sorted again, so names differ between texts and copies of a text cost no more than the text.
Everything is array code over all blocks of a level. A text longer than a step is a step of its own and takes some 30 bytes for each of its
words, and 4 more for each doubling at which some of its blocks still repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .storage import small_batches

#: A run has at least LEAST words and POWER periods (the choice of blocks rests on these two).
LEAST, POWER = 6, 4
#: Occurrences in a window up to which all are candidates.
SINGLE = 3
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int32)
_BELOW = np.array([(0xFF00 >> i) & 0xFF for i in range(8)], np.uint8)
_SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class WaveletTree:
    """Counts and order statistics of values[lo:hi] for many ranges at once; a level keeps its bits, eight to a byte, and the ones before each byte."""

    def __init__(self, values: np.ndarray):
        self.size, self.levels = len(values), max(1, int(values.max(initial=0)).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        row = values
        for level in reversed(range(self.levels)):
            bit = (row >> level & 1).astype(bool)
            packed = np.append(np.packbits(bit), np.uint8(0))
            ones = np.zeros(len(packed), np.int32)
            np.cumsum(_ONES[packed[:-1]], out=ones[1:])
            self.bits.append(packed)
            self.before.append(ones)
            row = np.concatenate([row[~bit], row[bit]])
            self.zeros.append(self.size - int(bit.sum()))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits of a level before each position."""
        byte = at >> 3
        return self.before[level][byte] + _ONES[self.bits[level][byte] & _BELOW[at & 7]]

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of values[lo:hi] are less than bound."""
        count = np.where(bound >> self.levels > 0, hi - lo, 0)
        for level in range(self.levels):
            one_lo, one_hi = self._ones(level, lo), self._ones(level, hi)
            bit = (bound >> (self.levels - 1 - level) & 1).astype(bool)
            count = count + np.where(bit & (bound >> self.levels == 0), (hi - lo) - (one_hi - one_lo), 0)
            lo, hi = np.where(bit, self.zeros[level] + one_lo, lo - one_lo), np.where(bit, self.zeros[level] + one_hi, hi - one_hi)
        return count

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest (from 0) of values[lo:hi]."""
        value = np.zeros(len(lo), np.int64)
        for level in range(self.levels):
            one_lo, one_hi = self._ones(level, lo), self._ones(level, hi)
            zeros = (hi - lo) - (one_hi - one_lo)
            bit = n >= zeros
            value = value * 2 + bit
            n = np.where(bit, n - zeros, n)
            lo, hi = np.where(bit, self.zeros[level] + one_lo, lo - one_lo), np.where(bit, self.zeros[level] + one_hi, hi - one_hi)
        return value


class Suffixes:
    """Suffixes of some texts, given as one row of words.

    names[k][i] == names[k][j] says that the same 2^k words of one text stand at i and j. order holds all positions; those of one name stand
    together, from place names[k][i] on, and size[k] is their number (1 at once where a block would leave its text).
    """

    def __init__(self, words: np.ndarray, first: np.ndarray):
        n = len(words)
        self.n, self.first = n, first
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.end = first[1:][text]
        _, word = np.unique(words, return_inverse=True)
        key = text * (n + 1) + word
        self.order = np.argsort(key, kind="stable")
        same = np.append(False, key[self.order][1:] == key[self.order][:-1]) if n else np.zeros(0, bool)
        name = np.empty(n, np.int32)
        name[self.order] = np.maximum.accumulate(np.where(same, 0, np.arange(n))) if n else 0
        count = np.bincount(name, minlength=n) if n else np.zeros(0, int)
        self.names, self.live = [name], [np.flatnonzero(count[name] > 1)]
        while len(self.live[-1]) and 2 << len(self.names) <= 2 * n:
            self._double()

    def _double(self) -> None:
        """Sorts the suffixes that still share their name by the name half a block on; one that ends before has a name of its own."""
        half, name, live = 1 << (len(self.names) - 1), self.names[-1], self.live[-1]
        after = live + half
        inside = after < self.end[live]
        second = np.where(inside, name[np.minimum(after, self.n - 1)].astype(np.int64) + 1, 0)
        order = np.argsort(name[live].astype(np.int64) * (self.n + 1) + second, kind="stable")
        at, new = live[order], name.copy()
        low, second, inside = name[at], second[order], inside[order]
        opens = np.append(True, (low[1:] != low[:-1]) | (second[1:] != second[:-1])) | ~inside
        group = np.append(True, low[1:] != low[:-1])
        place = np.arange(len(at))
        place = low + place - np.maximum.accumulate(np.where(group, place, 0))
        self.order[place] = at
        begin = np.flatnonzero(opens)
        size = np.diff(np.append(begin, len(at)))
        new[at] = np.repeat(place[begin], size)
        self.names.append(new)
        self.live.append(np.sort(at[np.repeat(size, size) > 1]))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and j on agree (both in one text)."""
        i, j = i.copy(), j.copy()
        start, top = j.copy(), len(self.names) - 1
        moving = np.arange(len(j))
        while len(moving):  # the longest blocks may agree more than once
            moving = moving[self._step(top, i[moving], j[moving])]
            i[moving] += 1 << top
            j[moving] += 1 << top
        for k in range(top - 1, -1, -1):
            yes = self._step(k, i, j)
            i[yes] += 1 << k
            j[yes] += 1 << k
        return j - start

    def _step(self, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = np.maximum(i, j) < self.n
        name = self.names[k]
        return ok & (name[np.minimum(i, self.n - 1)] == name[np.minimum(j, self.n - 1)]) & (i != j)

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and j (i < j, both in one text) agree."""
        i, j = i.copy(), j.copy()
        start, top = j.copy(), len(self.names) - 1
        moving = np.arange(len(j))
        while len(moving):
            moving = moving[self._back(top, i[moving], j[moving])]
            i[moving] -= 1 << top
            j[moving] -= 1 << top
        for k in range(top - 1, -1, -1):
            yes = self._back(k, i, j)
            i[yes] -= 1 << k
            j[yes] -= 1 << k
        return start - j

    def _back(self, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        i, j = i - (1 << k), j - (1 << k)
        name = self.names[k]
        return (i >= 0) & (name[np.maximum(i, 0)] == name[np.maximum(j, 0)])


def _candidates(suffixes: Suffixes, tree: WaveletTree, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(block's place, candidate period) of the aligned blocks of 2^k words."""
    size, none = 1 << k, np.zeros(0, np.int64)
    live = suffixes.live[k]
    text_first = suffixes.first[np.searchsorted(suffixes.first, live, side="right") - 1]
    block = live[(live - text_first) % size == 0]
    if not len(block):
        return none, none
    near, far = (1, 3) if k == 1 else (3 * size // 4, 3 * size // 2)
    name = suffixes.names[k]
    lo = name[block].astype(np.int64)
    hi = lo + np.bincount(name[live], minlength=suffixes.n)[lo]
    # windows of half a block at most: what occurs there three times or more is one progression
    middle = min(far, near + max(1, size // 2))
    spans = [(near, middle), (middle, far)] if middle < far else [(near, far)]
    place, period = [none], [none]
    begin = tree.below(lo, hi, block + spans[0][0])
    for _, b in spans:
        end = tree.below(lo, hi, block + b)
        count = end - begin
        for n in range(1, SINGLE + 1):
            some = np.flatnonzero((count >= n) & (count <= SINGLE))
            if not len(some):
                continue
            place.append(block[some])
            period.append(tree.nth(lo[some], hi[some], begin[some] + n - 1) - block[some])
        many = np.flatnonzero(count > SINGLE)
        if len(many):
            at, low, high = block[many], lo[many], hi[many]
            one, last = tree.nth(low, high, begin[many]), tree.nth(low, high, end[many] - 1)
            step = (last - one) // (count[many] - 1)
            # the stretches of that period around the block and around its copies
            left, right = at - suffixes.behind(at, at + step), at + step + suffixes.ahead(at, at + step)
            copy_left, copy_right = one - suffixes.behind(one, one + step), one + step + suffixes.ahead(one, one + step)
            for d in (copy_left - left, copy_right - right):
                good = (d >= one - at) & (d <= last - at) & ((d - (one - at)) % step == 0)
                place.append(at[good])
                period.append(d[good])
        begin = end
    return np.concatenate(place), np.concatenate(period)


def find_runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, sorted, of texts words[first[i]:first[i + 1]]; places are those in words."""
    suffixes = Suffixes(words, first)
    tree, found = None, [np.zeros((0, 3), np.int64)]
    for k in range(1, len(suffixes.names)):
        if not len(suffixes.live[k]):
            break
        tree = tree or WaveletTree(suffixes.order)
        place, period = _candidates(suffixes, tree, k)
        if not len(place):
            continue
        start = place - suffixes.behind(place, place + period)
        end = place + period + suffixes.ahead(place, place + period)
        good = end - start >= np.maximum(LEAST, POWER * period)
        found.append(np.unique(np.stack([start, end, period], 1)[good], axis=0))
    rows = np.unique(np.concatenate(found), axis=0)
    # the least period of each stretch
    least = np.append(True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) if len(rows) else np.zeros(0, bool)
    rows = rows[least]
    return rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]


def planted(n: np.ndarray, seed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which word stands at each place once texts of n words whose seed is a multiple of ten have a periodic tail."""
    at = np.arange(int(n.sum()))
    for i in np.flatnonzero((seed >= 0) & (seed % 10 == 0) & (n > 0)):
        size, g = int(n[i]), int(seed[i]) // 10
        a, p = g % size, 1 + (size - g % size) // (3 + g % 8)
        at[first[i] + a : first[i] + size] = first[i] + a + np.arange(size - a) % p
    return at


def _joined(words: tv.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, places) of the words at, each followed by one space; places: where each begins, with the end."""
    size = words.end[at] - words.start[at]
    place = np.cumsum(np.append(0, size + 1))
    out = np.full(int(place[-1]), 32, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(place[:-1], size) + inner] = words.buf[np.repeat(words.start[at], size) + inner]
    return out, place


def _best(rows: np.ndarray) -> tuple[int, int, int]:
    """(start, length, period) of the greatest length by period; equal ones by start, then period."""
    length = rows[:, 1] - rows[:, 0]
    ratio = length / rows[:, 2]
    near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-12))
    return min(((int(rows[i, 0]), int(length[i]), int(rows[i, 2])) for i in near), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def _described(buf: np.ndarray, offsets: np.ndarray, seed: np.ndarray) -> list[dict]:
    """A row for each text of a step."""
    words = tv.split_words(buf, offsets, ~tv.WHITESPACE, tv.SAME)
    n = np.diff(words.first)
    at = planted(n, seed, words.first)
    runs = find_runs(words.hash[at], words.first)
    edge = np.zeros(len(at) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    kept = np.cumsum(edge[:-1]) == 0
    out, place = _joined(words, at[kept])
    place = place[tv.running(kept)[words.first]]
    own = np.searchsorted(runs[:, 0], words.first)
    rows = []
    for i, (a, b) in enumerate(zip(own[:-1].tolist(), own[1:].tolist(), strict=True)):
        mine = runs[a:b] - [words.first[i], words.first[i], 0]
        best = _best(mine) if b > a else (None, None, None)
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in mine.tolist())
        text = out[place[i] : max(place[i], place[i + 1] - 1)].tobytes()
        rows.append({"n_runs": b - a, "start": best[0], "length": best[1], "period": best[2], "exponent_milli": best[1] * 1000 // best[2] if b > a else None, "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(text).hexdigest()})
    return rows


_TYPE = pa.struct([*((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), *((c, pa.string()) for c in ("runs_sha256", "collapsed_sha256"))])


def _digests() -> Callable:
    @F.arrow_udf(_SCHEMA)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, seeds in tv.released(batches):
            seed = seeds.fill_null(-1).to_numpy(zero_copy_only=False)
            rows: list[dict] = []
            for row, last, buf, offsets in tv.text_steps(texts):
                rows += _described(buf, offsets, seed[row:last])
            yield pa.array(rows, _TYPE)

    return run


def run_digests(docs: DataFrame, seed: Column | None = None, text_col: str = "text") -> DataFrame:
    """docs with the columns of _SCHEMA, in place of those of these names: the runs of each text's words, the strongest one, and digests of all runs and of the text without what a run repeats.

    seed: where it is a multiple of ten, the text's tail is made periodic before (planted); null plants nothing. Null, empty and blank texts have no run
    and the digests of empty strings. Rows may repeat; equal exponents: the first start, then the least period; an empty table gives no
    rows; other columns stay, whatever their names.
    """
    small_batches(docs.sparkSession)
    made = [c.split()[0] for c in _SCHEMA.split(", ")]
    names = [c for c in docs.columns if c.lower() not in (*made, "__runs")]
    found = _digests()(F.col(f"`{text_col}`").cast("string"), (F.lit(None) if seed is None else seed).cast("long"))
    rows = docs.select(*(F.col(f"`{c}`") for c in names), found.alias("__runs"))
    return rows.select(*(F.col(f"`{c}`") for c in names), *(F.col(f"__runs.{c}").alias(c) for c in made))


def collapse_runs(docs: DataFrame, text_col: str = "text", out_col: str = "text") -> DataFrame:
    """docs with texts whose runs keep their first period only, words joined by one space; texts without a run stay as they are."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in tv.released(batches):
            out: list = []
            for row, last, buf, offsets in tv.text_steps(texts):
                words = tv.split_words(buf, offsets, ~tv.WHITESPACE, tv.SAME)
                edge = np.zeros(len(words.hash) + 1, np.int64)
                for s, e, q in find_runs(words.hash, words.first).tolist():
                    edge[s + q] += 1
                    edge[e] -= 1
                kept = np.cumsum(edge[:-1]) == 0
                flat, place = _joined(words, np.flatnonzero(kept))
                place = place[tv.running(kept)[words.first]]
                whole = np.diff(tv.running(~kept)[words.first]) == 0
                for i in range(last - row):
                    out.append(texts[row + i].as_py() if whole[i] else flat[place[i] : max(place[i], place[i + 1] - 1)].tobytes().decode("utf-8", "replace"))
            yield pa.array(out, pa.string())

    names = [c for c in docs.columns if c.lower() != out_col.lower()]
    return docs.select(*(F.col(f"`{c}`") for c in names), run(F.col(f"`{text_col}`").cast("string")).alias(out_col))
