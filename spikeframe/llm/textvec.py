"""Vectorised word hashing over Arrow text batches, shared by the operators of this subpackage.

A batch of texts is one byte buffer; words are maximal runs of bytes that a 256-entry table calls
word bytes. A word's 64-bit hash takes its bytes eight at a time, all words of a batch at once, and mixes after each
eight, so no Python code runs per word and words of any structure are apart but for chance. Null texts count as
empty ones. Memory is a few MB a step; a text longer than a step takes about four bytes for each of its bytes and some
50 for each of its words.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP_BYTES = 1 << 18

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters, digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_lo:_hi] = True

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] = SAME[0x61:0x7B]

#: Bytes of a span that are hashed eight at a time; a longer one is hashed by itself.
LANE, LONG_SPAN = 8, 256
#: Bits of a lane that so many bytes fill.
_FILLED = np.array([(1 << 8 * n) - 1 for n in range(LANE + 1)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of some consecutive texts: byte positions in buf, hashes, and the text each lies in."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    #: First word of each text, with the number of words at the end.
    first: np.ndarray
    table: np.ndarray

    def prefix_hashes(self, lengths: tuple[int, ...]) -> list[np.ndarray]:
        """For each length, hashes of the first so many bytes of each word (of the whole word where it is shorter)."""
        return _hashes(self.buf, self.start, [np.minimum(self.start + n, self.end) for n in lengths], self.table)


def _hashes(buf: np.ndarray, start: np.ndarray, ends: list[np.ndarray], table: np.ndarray, checks: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Hashes of the spans from start to each of ends, after each byte was replaced by its entry in table.

    Where checks is a list, a second hash of each span, made with other factors and another chain, is added to it.
    """
    text = np.zeros(len(buf) + LANE, np.uint8)
    np.take(table, buf, out=text[: len(buf)])
    lanes = np.ndarray(len(buf) + 1, "<u8", text, strides=(1,))
    out = []
    for end in ends:
        size = end - start
        h = mix(size.astype(np.uint64) * np.uint64(_BASE) + np.uint64(1))
        second = np.zeros(len(h), np.uint64)
        live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
        at = 0
        while len(live):
            rest = size[live] - at
            lane = lanes[start[live] + at] & _FILLED[np.minimum(rest, LANE)]
            h[live] = mix((h[live] ^ lane) * np.uint64(_BASE))
            if checks is not None:
                second[live] = (second[live] ^ (second[live] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + lane * np.uint64(0x165667B19E3779F9)
            live, at = live[rest > LANE], at + LANE
        for i in np.flatnonzero(size > LONG_SPAN):
            digest = hashlib.blake2b(text[start[i] : end[i]].tobytes(), digest_size=16).digest()
            h[i], second[i] = np.frombuffer(digest, np.uint64)
        out.append(h)
        if checks is not None:
            checks.append(mix(second))
    return out


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each span buf[start[i]:end[i]], upper and lower case apart."""
    checks: list[np.ndarray] = []
    return _hashes(buf, start, [end], SAME, checks)[0], checks[0]


def running(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each position, and in all."""
    out = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 31 else np.int64)
    np.cumsum(flags, dtype=out.dtype, out=out[1:])
    return out


def split_words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray, table: np.ndarray = LOWER) -> Words:
    """Words of the texts buf[offsets[i]:offsets[i + 1]]; inside: bool[256], true for word bytes."""
    n = len(buf)
    mask = np.zeros(n + 2, bool)
    mask[1:-1] = inside[buf]
    bound = np.zeros(n + 1, bool)
    bound[offsets] = True
    left, right = mask[:-1], mask[1:]
    start = np.flatnonzero(right & (~left | bound))
    end = np.flatnonzero(left & (~right | bound))
    doc = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(start, offsets, side="left")
    return Words(buf, offsets, start, end, _hashes(buf, start, [end], table)[0], doc, first, table)


def text_steps(column: pa.Array | pa.ChunkedArray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows of at most limit bytes, or of one row."""
    if isinstance(column, pa.ChunkedArray):
        at = 0
        for chunk in column.chunks:
            for row, last, buf, offsets in text_steps(chunk, limit):
                yield at + row, at + last, buf, offsets
            at += len(chunk)
        return
    if not len(column):
        return
    column = column.cast(pa.large_string())
    column = pc.fill_null(column, "") if column.null_count else column
    _, raw_offsets, data = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        last = min(max(last, row + 1), len(column))
        yield row, last, whole[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def released(batches: Iterator) -> Iterator:
    """The batches of a task, after which unused memory of the worker, which lives on, goes back to the system."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every system's C library has it
            ctypes.CDLL(None).malloc_trim(0)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every k-word shingle; a text of 1 to k - 1 words has one, the whole of it."""
    h, doc, count = words.hash, words.doc, np.diff(words.first)
    n = max(0, len(h) - k + 1)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc * np.uint64(_BASE) + h[j : j + n]
    whole = doc[:n] == doc[k - 1 :][:n]
    out, owner = acc[whole], doc[:n][whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            value = int(count[d])
            for x in h[words.first[d] : words.first[d + 1]]:
                value = (value * _INVERSE + int(x)) & _MASK
            extra[i] = value
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return mix(out), owner
