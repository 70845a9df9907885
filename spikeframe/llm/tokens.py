"""Exact token counts and ids with public tokenizers, fast through pieces that repeat.

A text is split at spaces that follow a non-space character: no pre-token of the tokenizers
used here spans such a place, so the pieces ("units") can be encoded one by one, however long the text.
Units repeat across texts; each worker keeps the results of the units it has met in sorted arrays (some
24 bytes each, at most CACHE_UNITS) by a 64-bit hash, finds those of a whole batch of texts at once, and sends new ones to the
library in batches balanced by bytes. A second hash is compared on each hit; where it differs, the text goes to the library. Texts that could hold a special token, or are split otherwise than the
rule allows, go to the library whole or at other safe places.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .storage import small_batches

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units that a worker remembers, recent ones that are merged at once, pieces of units, and bytes of new ones in one library call.
CACHE_UNITS, RECENT, CACHE_PIECES, BATCH_BYTES = 1_500_000, 50_000, 150_000, 1 << 18
#: Bytes of text that are looked up at once.
LOOKUP_BYTES = 1 << 20
_FIRST = np.uint64(0x5851F42D4C957F2D)
_SAFE_SPLIT = regex.compile(r"(?<=\S) ")


def byte_batches(texts: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive texts in lists of about limit bytes each."""
    batch, size = [], 0
    for text in texts:
        batch.append(text)
        size += len(text.encode("utf-8", "surrogatepass"))
        if size >= limit:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


class UnitCache:
    """Sizes, ids and second hashes by hash, in a sorted array of old entries and a short one of recent ones."""

    _NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.parts = [self._NONE] * 2
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(size, place of the ids, whether known) of each key; a size of -1 where the second hash isn't that of the entry."""
        size, place, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for hashes, sizes, places, seconds in self.parts:
            if len(hashes):
                at = np.searchsorted(hashes, keys)
                at[at == len(hashes)] = 0
                hit = hashes[at] == keys
                size[hit], place[hit] = np.where(seconds[at[hit]] == checks[hit], sizes[at[hit]], -1), places[at[hit]]
                known |= hit
        return size, place, known

    def full(self, more: int) -> bool:
        return sum(len(p[0]) for p in self.parts) + more > CACHE_UNITS

    def add(self, keys: np.ndarray, checks: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The places of the ids of new keys in rising order; ids: of all, one after the other (none where only sizes are wanted)."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        places = self.used + np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        self.used += len(ids)
        self.parts[1] = self._merged(self.parts[1], (keys, sizes.astype(np.int32), places, checks))
        if len(self.parts[1][0]) > RECENT:
            self.parts = [self._merged(*self.parts), self._NONE]
        return places

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        at = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, at, y) for x, y in zip(a, b, strict=True))


class UnitEncoder:
    """Token ids or counts of whole texts by one tokenizer file."""

    def __init__(self, path: str, lengths_only: bool):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.specials = [t["content"].encode() for t in spec["added_tokens"]]
        self.lengths_only = lengths_only
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        self.lower = spec["normalizer"] is not None
        split = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
        # the pattern of the byte-level pre-tokenizer is part of the library
        self.pattern = regex.compile(split or r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.bare = Tokenizer.from_file(path)
        self.bare.no_truncation()
        self.bare.no_padding()
        if self.lower:
            self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.units, self.odd = UnitCache(), {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _prepared(self, unit: str) -> str:
        import unicodedata

        return unicodedata.normalize("NFC", unit).lower() if self.lower else unit

    def _learned(self, units: list[str], spaced: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids one after the other) of units; spaced: whether a space goes before. A size of -1: not to be encoded alone."""
        parts: list = []
        for unit, space in zip(units, spaced, strict=True):
            if self.lower:
                # lower case of these depends on what stands around them
                parts.append(unit if "Σ" in unit or "İ" in unit else self.pattern.findall(self._prepared(unit)))
            elif not unit or unit[-1].isspace():
                parts.append(None)
            else:
                parts.append(self.pattern.findall(" " + unit if space else unit))
        known = self.pieces
        if len(known) > CACHE_PIECES:
            known.clear()
        for batch in byte_batches({p for x in parts if isinstance(x, list) for p in x if p not in known}):
            known.update(zip(batch, (tuple(e.ids) for e in self.bare.encode_batch_fast(batch, add_special_tokens=False)), strict=True))
        sizes, ids = [], []
        for x in parts:
            if x is None:
                sizes.append(-1)
                continue
            before = len(ids)
            if isinstance(x, str):
                ids += self.whole.encode(x, add_special_tokens=False).ids
            else:
                for p in x:
                    ids += known[p]
            sizes.append(len(ids) - before)
        return np.array(sizes, np.int64), np.array([] if self.lengths_only else ids, np.uint32)

    def _exact(self, text: str) -> int:
        """Count of a text that the units don't cover: it is split at spaces after other characters, and the parts go to the library."""
        parts = [(u, i > 0) for i, u in enumerate(_SAFE_SPLIT.split(text))]
        fresh = sorted({p for p in parts if p not in self.odd})
        if len(self.odd) > 50_000:
            self.odd, fresh = {}, sorted(set(parts))
        at = 0
        for batch in byte_batches(" " + u if space else u for u, space in fresh):
            for e in self.whole.encode_batch_fast(batch, add_special_tokens=False):
                self.odd[fresh[at]] = len(e.ids)
                at += 1
        return sum(self.odd[p] for p in parts)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, all ids one after the other) of the texts buf[offsets[i]:offsets[i + 1]] in UTF-8; no ids where lengths are enough."""
        texts = len(offsets) - 1
        spaces = np.flatnonzero(buf == 32)
        start, end = np.sort(np.concatenate([offsets[:-1], spaces + 1])), np.sort(np.concatenate([spaces, offsets[1:]]))
        per = np.diff(np.searchsorted(spaces, offsets)) + 1
        first = np.cumsum(per) - per
        keys, checks = tv.span_hashes(buf, start, end)
        checks = checks.astype(np.uint32)
        if not self.lower:
            keys[first] ^= _FIRST  # no space before
        keys, one, number = np.unique(keys, return_index=True, return_inverse=True)
        size, place, known = self.units.find(keys, checks[one])
        odd = checks != checks[one][number]  # units of the batch that share a hash only
        if not known.all():
            if self.units.full(int((~known).sum())):  # all units of the batch come again, so that their ids stand in the emptied cache
                self.units.clear()
                known[:] = False
            fresh, one = checks[one[~known]], one[~known]
            begins = np.isin(one, first)
            sizes, ids = self._learned([buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[one], end[one], strict=True)], (~begins).tolist())
            size[~known], place[~known] = sizes, self.units.add(keys[~known], fresh, sizes, ids)
        size, place = size[number], place[number]
        size[odd] = -1
        empty = offsets[1:] == offsets[:-1]
        size[first[empty]] = 0
        unsafe = np.add.reduceat(size < 0, first) > 0 if texts else np.zeros(0, bool)
        raw = buf.tobytes() if self.specials else b""
        for special in self.specials:
            at = raw.find(special)
            while at >= 0:
                unsafe[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(special, at + 1)
        size[np.repeat(unsafe, per)] = 0
        counts = np.add.reduceat(size, first) if texts else np.zeros(0, np.int64)
        alone: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(unsafe):
            text = buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
            if self.lengths_only and not any(s in text.encode() for s in self.specials):
                counts[i] = self._exact(text)
            else:
                found = self.whole.encode(text, add_special_tokens=False).ids
                counts[i], alone[int(i)] = len(found), np.array(found, np.uint32)
        if self.lengths_only:
            return counts, np.zeros(0, np.uint32)
        ends = np.cumsum(size)
        ids = self.units.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(place - (ends - size), size)]
        if alone:
            parts = np.split(ids, np.cumsum(np.add.reduceat(size, first))[:-1])
            ids = np.concatenate([alone.get(i, part) for i, part in enumerate(parts)])
        return counts, ids


_encoders: dict = {}


def encoder(path: str, lengths_only: bool) -> UnitEncoder:
    """One per worker and file."""
    if (path, lengths_only) not in _encoders:
        _encoders[path, lengths_only] = UnitEncoder(path, lengths_only)
    return _encoders[path, lengths_only]


def _counts(path: str) -> Callable:
    def run(batches):
        enc = encoder(path, True)
        for batch in tv.released(batches):
            for row, last, buf, offsets in tv.text_steps(batch.column(2), LOOKUP_BYTES):
                counts, _ = enc.encode(buf, offsets)
                yield pa.RecordBatch.from_arrays([*(c.slice(row, last - row) for c in batch.columns[:2]), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; a null text counts as an empty one, ids are passed on and may be null or repeat.

    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(_counts(tokenizer_path), schema).withColumn("over_limit", F.col("n_tokens") > limit)
