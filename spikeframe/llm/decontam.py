"""Benchmark decontamination: a BM25 index of test items, queried with every training passage by block-max WAND.

Passages are overlapping word windows that cover every document. Scores are divided by the item's score
against itself, so one threshold serves all items. Each term has its postings (items in rising order, with their
contributions), cut at blocks of BLOCK items, and the greatest contribution of each block. Items that share their
most common word are neighbours.

Passages of a group run together. A passage's terms stand in rising order of their greatest contribution; up to the
pivot, the first at which their sum reaches the threshold, they can't bring any item there alone, so only
the blocks in the postings of the pivot and the terms after it are candidates. Of these the blocks whose greatest
contributions, summed over all terms of the passage, don't reach the threshold are skipped, and the
postings of the others are scored. No item at or above the threshold is missed. A retrieved item
counts as a leak when the document holds enough of the word 3-grams of its question and of its answer (the
item's last sentence; the last half of an item of one sentence). An item of fewer words than that is met
by its whole run of words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .storage import Scratch, cut

K1, B, BLOCK = 1.2, 0.75, 16
#: Passages that run together, and contributions that are looked up at once.
GROUP, LOOKUPS = 4096, 1 << 20
THRESHOLD, OVERLAP, GRAM = 0.4, 0.6, 3
#: Tables by term and block, or by passage and block, have at most so many entries; above, keys are sorted or searched.
TABLE = 1 << 22
#: An index shard holds at most so many items and characters; a larger benchmark takes several passes.
SHARD_ITEMS, SHARD_CHARS = 20_000, 32 << 20
MIN_WINDOW = 64


def _one(text: str) -> tv.Words:
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return tv.split_words(raw, np.array([0, len(raw)]), tv.ALNUM)


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    if not 0 < n <= len(h):
        return np.zeros(0, np.uint64)
    acc = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j]
    return np.unique(tv.mix(acc))


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, position) of all positions of the ranges that begin at start and have size."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + start[owner]


@dataclass
class Index:
    """Terms with their greatest contribution to any item (one more entry stands for all other words), and postings by term and block.

    key: term * blocks + block of each part of a posting list, in rising order; peak: its greatest
    contribution; start: where it begins in item and gain, with the end. part: the first part of each term, with the end.
    """

    items: list[int]
    terms: np.ndarray
    most: np.ndarray
    blocks: int
    key: np.ndarray
    peak: np.ndarray
    start: np.ndarray
    part: np.ndarray
    item: np.ndarray
    gain: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    gram: list[int]
    window: int
    spot: np.ndarray | None = None

    def __post_init__(self):
        """spot: the part of each term and block, -1 for none; not made for large indexes."""
        if len(self.most) * self.blocks <= TABLE:
            self.spot = np.full(len(self.most) * self.blocks, -1, np.int32)
            self.spot[self.key] = np.arange(len(self.key))

    @staticmethod
    def build(rows: list[tuple[int, str]], whole: tuple[int, float, int, dict[int, int]] | None = None) -> Index:
        """whole: the number of items, mean and greatest length, and items by term, of a benchmark of which rows are a shard."""
        words = [_one(text).hash for _, text in rows]
        everything, number, total = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        cuts = np.cumsum([0, *map(len, words)])
        common = [max(((int(total[t]), int(t)) for t in number[a:b]), default=(0, 0))[1] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        order = sorted(range(len(rows)), key=lambda i: (common[i], rows[i][0]))
        rows, words = [rows[i] for i in order], [words[i] for i in order]
        length = np.array([len(w) for w in words], float)
        mean = max(1.0, length.mean()) if len(rows) else 1.0
        pairs = [np.unique(w, return_counts=True) for w in words]
        term = np.searchsorted(everything, np.concatenate([*(p[0] for p in pairs), np.zeros(0, np.uint64)]))
        tf = np.concatenate([*(p[1] for p in pairs), np.zeros(0)]).astype(float)
        item = np.repeat(np.arange(len(rows)), [len(p[0]) for p in pairs])
        df, items, longest = np.bincount(term, minlength=len(everything)), len(rows), int(length.max()) if len(rows) else 0
        if whole:
            items, mean, longest = whole[0], max(1.0, whole[1]), whole[2]
            df = np.array([whole[3][t] for t in everything.view(np.int64).tolist()], float)
        idf = np.log1p((items - df + 0.5) / (df + 0.5))
        gain = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / mean))
        own = np.bincount(item, gain, len(rows))
        gain = gain / np.where(own > 0, own, 1.0)[item]
        most = np.zeros(len(everything) + 1)
        np.maximum.at(most, term, gain)
        blocks = max(1, -(-len(rows) // BLOCK))
        order = np.lexsort((item, term))
        term, item, gain = term[order], item[order], gain[order]
        key, start = np.unique(term * blocks + item // BLOCK, return_index=True)
        peak = np.maximum.reduceat(gain, start) if len(start) else np.zeros(0)
        part = np.searchsorted(key, np.arange(len(everything) + 2) * blocks)
        question, answer, gram = [], [], []
        for (_, text), w in zip(rows, words, strict=True):
            ends = [m.end() for m in re.finditer(r"[.!?]\s+", (text or "").rstrip())]
            sizes = [len(_one((text or "")[:c]).hash) for c in ends]
            sizes = [n for n in sizes if 2 * GRAM <= n <= len(w) - 2 * GRAM]
            before = sizes[-1] if sizes else len(w) // 2
            gram.append(min(GRAM, len(w)))
            if len(w) < 2 * GRAM:  # too short to part: both are the whole
                before, w = len(w), np.concatenate([w, w])
            question.append(_grams(w[:before], gram[-1]))
            answer.append(_grams(w[before:], gram[-1]))
        window = max(MIN_WINDOW, longest)
        return Index([i for i, _ in rows], everything, most, blocks, key, peak, np.append(start, len(item)), part, item, gain, question, answer, gram, window)

    def _parts(self, term: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which pair, part of the posting list) of those pairs of term and block that have one."""
        wanted = term * self.blocks + block
        if self.spot is not None:
            at = self.spot[wanted]
            there = np.flatnonzero(at >= 0)
            return there, at[there]
        at = np.searchsorted(self.key, wanted)
        at[at == len(self.key)] = 0
        there = np.flatnonzero(self.key[at] == wanted)
        return there, at[there]

    def wand(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) at or above threshold of passages given by their distinct terms, in rising order of passages."""
        enough = threshold - 1e-9
        order = np.lexsort((self.most[term], passage))
        passage, term = passage[order], term[order]
        name, first = np.unique(passage, return_index=True)
        size = np.diff(np.append(first, len(passage)))
        owner = np.repeat(np.arange(len(name)), size)
        total = np.cumsum(self.most[term])
        reach = total - np.repeat(total[first] - self.most[term[first]], size) if len(name) else total
        after = reach >= enough  # the pivot and the terms after it
        before = np.bincount(owner[~after], self.most[term[~after]], len(name))
        low = self.part[term[after]]
        pair, part = _spread(low, self.part[term[after] + 1] - low)
        place = owner[after][pair] * self.blocks + self.key[part] % self.blocks
        if len(name) * self.blocks <= TABLE:
            bound = np.bincount(place, self.peak[part], len(name) * self.blocks)
            spot = np.flatnonzero(bound > 0)
            bound = bound[spot] + before[spot // self.blocks]
        else:
            spot, number = np.unique(place, return_inverse=True)
            bound = np.bincount(number, self.peak[part], len(spot)) + before[spot // self.blocks]
        spot = spot[bound >= enough]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = 0
        while step < len(spot):
            last = max(step + 1, int(np.searchsorted(np.cumsum(size[spot[step:] // self.blocks]), LOOKUPS)) + step)
            here = spot[step:last]
            step = last
            pair, at = _spread(first[here // self.blocks], size[here // self.blocks])
            there, part = self._parts(term[at], here[pair] % self.blocks)
            live = np.bincount(pair[there], self.peak[part], len(here)) >= enough
            keep = live[pair[there]]
            there, part = there[keep], part[keep]
            hit, posting = _spread(self.start[part], self.start[part + 1] - self.start[part])
            place = pair[there[hit]] * (len(self.items) + 1) + self.item[posting]
            place, number = np.unique(place, return_inverse=True)
            score = np.bincount(number, self.gain[posting], len(place))
            good = score >= threshold
            found.append((name[here[place[good] // (len(self.items) + 1)] // self.blocks], place[good] % (len(self.items) + 1), score[good]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def leaks(self, words: tv.Words, texts: int, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap) of all verified leaks in a batch."""
        if not len(words.hash) or not len(self.terms):
            return []
        at = np.searchsorted(self.terms, words.hash)
        at[at == len(self.terms)] = 0
        at[self.terms[at] != words.hash] = len(self.terms)
        total = np.concatenate([[0.0], np.cumsum(self.most[at])])
        step = self.window // 2
        count = np.diff(words.first)
        passages = np.maximum(1, -(-(count - self.window) // step) + 1) * (count > 0)
        owner = np.repeat(np.arange(texts), passages)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(passages) - passages, passages)
        a = words.first[owner] + number * step
        b = np.minimum(a + self.window, words.first[owner + 1])
        best: dict[tuple[int, int], float] = {}
        live = np.flatnonzero(total[b] - total[a] >= threshold - 1e-9)
        for at_once in range(0, len(live), GROUP):
            p = live[at_once : at_once + GROUP]
            which, inside = _spread(a[p], b[p] - a[p])
            term, passage = at[inside], p[which]
            known = term < len(self.terms)
            query = np.unique(passage[known] * len(self.most) + term[known])
            for q, item, score in zip(*self.wand(query // len(self.most), query % len(self.most), threshold), strict=True):
                key = (int(owner[q]), int(item))
                best[key] = max(best.get(key, 0.0), float(score))
        grams: dict[tuple[int, int], np.ndarray] = {}
        out = []
        for (text, item), score in sorted(best.items()):
            n = self.gram[item]
            if (text, n) not in grams:
                grams[text, n] = _grams(words.hash[words.first[text] : words.first[text + 1]], n)
            share = lambda part: float(np.isin(part, grams[text, n]).mean()) if len(part) else 1.0  # noqa: B023, E731
            q, r = share(self.question[item]), share(self.answer[item])
            if q >= overlap and r >= overlap:
                out.append((text, self.items[item], score, q, r))
        return out


def _shards(benchmark: DataFrame, id_col: str, text_col: str):
    """(index of bounded size, whether others follow) over all items; null ids and empty texts are left out."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and length(trim(t)) > 0")
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_ITEMS), -(-chars // SHARD_CHARS))
    if shards == 1:
        yield Index.build(sorted((r.i, r.t) for r in rows.collect())), False
        return
    # statistics of the whole benchmark; a shard gets those of its own terms
    at = F.pmod(F.xxhash64("i"), F.lit(shards))
    terms = cut(rows.withColumn("shard", at).select("shard", "t").mapInArrow(_terms, "shard long, term long, words long"))
    total, longest = terms.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("words"), F.lit(0))).first()
    df = cut(terms.groupBy("term").agg(F.count("*").alias("df")))
    for s in range(shards):
        found = df.join(terms.where(F.col("shard") == s).select("term").distinct(), "term").collect()
        part = rows.where(at == s).collect()
        yield Index.build(sorted((r.i, r.t) for r in part), (n, total / n, longest, {r.term: r.df for r in found})), s < shards - 1


def _terms(batches):
    for batch in batches:
        for shard, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = _one(text).hash
            terms = np.unique(h)
            if len(terms):
                words = np.zeros(len(terms), np.int64)
                words[0] = len(h)  # an item's length is in its first row
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), shard, np.int64)), pa.array(terms.view(np.int64)), pa.array(words)], ["shard", "term", "words"])


def _find(shared, threshold: float, overlap: float) -> Callable:
    def run(batches):
        index = shared.value
        for batch in tv.released(batches):
            for row, last, buf, offsets in tv.text_steps(batch.column(1)):
                found = index.leaks(tv.split_words(buf, offsets, tv.ALNUM), last - row, threshold, overlap)
                cols = list(zip(*found, strict=True)) if found else [[]] * 5
                ids = batch.column(0).take(pa.array([row + t for t in cols[0]], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def _clean(shared, threshold: float, overlap: float) -> Callable:
    """A column function: whether a text leaks no item. Only the texts go to Python."""

    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in tv.released(batches):
            keep = np.ones(len(texts), bool)
            for row, last, buf, offsets in tv.text_steps(texts):
                for leak in shared.value.leaks(tv.split_words(buf, offsets, tv.ALNUM), last - row, threshold, overlap):
                    keep[row + leak[0]] = False
            yield pa.array(keep)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every leak.

    Null or empty texts, and items without an id or without words, leak nothing; an empty benchmark or table gives no
    rows; repeated rows give a row each. doc_id is passed on as it is, item ids are cast to long. Other columns are
    ignored, whatever their names. A benchmark of several shards takes a pass over docs for each, one after the other.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id long, score double, question_overlap double, answer_overlap double"
    out, scratch = None, Scratch(docs.sparkSession)
    for index, more in _shards(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        part = rows.mapInArrow(_find(shared, threshold, overlap), schema)
        if more:
            part = scratch.keep(part)
            shared.destroy()
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns whatever their names, that leak no test item; null and empty texts stay."""
    scratch = Scratch(docs.sparkSession)
    for index, more in _shards(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.where(_clean(shared, threshold, overlap)(F.col(text_col).cast("string")))
        if more:
            docs = scratch.keep(docs)
            shared.destroy()
    return docs
