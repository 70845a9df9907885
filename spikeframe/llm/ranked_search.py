"""Ranked lexical search of many items at once by multi-query common-subexpression evaluation.

Items are sets of terms and an item's score is the sum of its terms' weights in a document. Pairs of symbols
that several items share are mined, the most frequent first: each becomes a new symbol that stands for both in all of these items,
so larger shared sets grow from smaller ones. The symbols are the nodes of a DAG that items share. Over a block of
documents each node has one accumulator (a row of partial scores); it is filled once, after those below it, and an item
is the sum of the few symbols that are left in it.

Two passes over the documents: the statistics of the items' terms, summed by term; then the blocks, where a task keeps each item's
best rows so far and sends those alone. The best of all tasks come from two windows, by item and part of the ids and by item, both cut
before their shuffle, so tasks in any number meet in no single group. Items go out in shards of SHARD_ITEMS, each of which takes a pass.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .storage import Scratch, cut

#: Items and characters of their texts in a shard, accumulator cells of a block, rows that a task holds before it drops all but the best, parts of an item's candidates.
SHARD_ITEMS, SHARD_CHARS, CELLS, HELD, PARTS = 2000, 8 << 20, 1 << 21, 1 << 18, 64
_SCHEMA = "number long, doc_id long, score long"


def shared_sets(items: list[list[int]], symbols: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(pairs, items): pair i is the new symbol symbols + i, and items hold what is left after all pairs that two items or more share are replaced."""
    left = [set(x) for x in items]
    holders: dict[int, set[int]] = {}
    for i, x in enumerate(left):
        for s in x:
            holders.setdefault(s, set()).add(i)
    count: Counter = Counter()
    for x in left:
        row = sorted(x)
        count.update((a, b) for at, a in enumerate(row) for b in row[at + 1 :])
    heap = [(-n, p) for p, n in count.items() if n > 1]
    heapq.heapify(heap)
    pairs: list[tuple[int, int]] = []
    while heap:
        n, (a, b) = heapq.heappop(heap)
        if count[a, b] != -n:
            if count[a, b] > 1:
                heapq.heappush(heap, (-count[a, b], (a, b)))
            continue
        both = holders[a] & holders[b]
        new = symbols + len(pairs)
        pairs.append((a, b))
        fresh: Counter = Counter()
        for i in both:
            left[i] -= {a, b}
            for s in left[i]:
                count[min(a, s), max(a, s)] -= 1
                count[min(b, s), max(b, s)] -= 1
                fresh[s, new] += 1
            left[i].add(new)
        holders[a] -= both
        holders[b] -= both
        holders[new] = both
        del count[a, b]
        count.update(fresh)
        for p, n in fresh.items():
            if n > 1:
                heapq.heappush(heap, (-n, p))
    return pairs, [sorted(x) for x in left]


@dataclass
class Plan:
    """Terms of a shard by rising hash with their weights, levels of new nodes (their number, and both nodes below), and each item's symbols."""

    terms: np.ndarray
    weight: np.ndarray
    docs: int
    words: int
    nodes: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    symbol: np.ndarray
    first: np.ndarray
    top: int

    @staticmethod
    def build(items: list[np.ndarray], docs: int, words: int, df: dict[int, int], top: int) -> Plan:
        terms = np.unique(np.concatenate([*items, np.zeros(0, np.uint64)]))
        found = [df.get(t, 0) for t in terms.view(np.int64).tolist()]
        weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for n in found], np.int64)
        pairs, left = shared_sets([np.searchsorted(terms, x).tolist() for x in items], len(terms))
        depth = [0] * len(terms)
        for a, b in pairs:
            depth.append(max(depth[a], depth[b]) + 1)
        rows = np.array(pairs, np.int64).reshape(-1, 2)
        at = np.array(depth[len(terms) :], np.int64)
        levels = [(np.flatnonzero(at == d) + len(terms), rows[at == d, 0], rows[at == d, 1]) for d in range(1, int(at.max(initial=0)) + 1)]
        first = np.cumsum([0, *map(len, left)])[:-1]
        return Plan(terms, weight, docs, words, len(terms) + len(pairs), levels, np.array([s for x in left for s in x], np.int64), first, top)

    def scores(self, words: tv.Words, a: int, b: int) -> np.ndarray:
        """Scores by item of the texts a to b of a step."""
        lo, hi = words.first[a], words.first[b]
        h, doc = words.hash[lo:hi], words.doc[lo:hi] - a
        at = np.searchsorted(self.terms, h)
        at[at == len(self.terms)] = 0
        hit = self.terms[at] == h
        key, tf = np.unique(doc[hit] * len(self.terms) + at[hit], return_counts=True)
        owner, term = key // len(self.terms), key % len(self.terms)
        n = np.diff(words.first[a : b + 1]).astype(np.int64)
        m = 100 - 50 + (50 * n * self.docs) // self.words
        sums = np.zeros((self.nodes, b - a), np.int64)
        sums[term, owner] = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
        for node, left, right in self.levels:
            sums[node] = sums[left] + sums[right]
        return np.add.reduceat(sums[self.symbol], self.first, axis=0)


class Best:
    """The best rows of each item so far: equal scores by rising id, rows without an id last."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, without: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        self.parts.append((item, without[doc], ids[doc], scores[item, doc]))
        self.size += len(item)
        if self.size > HELD:
            self.rows()

    def rows(self) -> tuple[np.ndarray, ...]:
        item, without, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, without, -score, item))
        item, score = item[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.top
        last = keep & (rank == self.top - 1)
        self.least[item[last]] = score[last]
        self.parts = [(item[keep], without[order][keep], ids[order][keep], score[keep])]
        self.size = int(keep.sum())
        return self.parts[0]


def _search(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        best = Best(len(plan.first), plan.top)
        step = max(1, CELLS // max(1, plan.nodes + len(plan.symbol)))
        for batch in tv.released(batches):
            ids = batch.column(0)
            without = np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for row, last, buf, offsets in tv.text_steps(batch.column(1)):
                words = tv.split_words(buf, offsets, tv.ALNUM)
                for a in range(0, last - row, step):
                    b = min(a + step, last - row)
                    best.add(plan.scores(words, a, b), ids[row + a : row + b], without[row + a : row + b])
        if best.parts:
            item, without, ids, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=without), pa.array(score)], ["number", "doc_id", "score"])

    return run


def _statistics(shared) -> Callable:
    """(term, n) of a task: documents that hold each wanted term; under 0 the number of documents, under 1 that of their terms in two parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        df, docs, words = np.zeros(len(terms), np.int64), 0, 0
        for batch in tv.released(batches):
            for _, last, buf, offsets in tv.text_steps(batch.column(0)):
                found = tv.split_words(buf, offsets, tv.ALNUM)
                docs += int((np.diff(found.first) > 0).sum())
                words += len(found.hash)
                if len(terms):
                    at = np.searchsorted(terms, found.hash)
                    at[at == len(terms)] = 0
                    hit = terms[at] == found.hash
                    df += np.bincount(np.unique(found.doc[hit] * len(terms) + at[hit]) % len(terms), minlength=len(terms))
        some = np.flatnonzero(df)
        kind = np.append(np.full(len(some), "t"), ["d", "w"])
        yield pa.RecordBatch.from_arrays([pa.array(kind.tolist(), pa.string()), pa.array(np.append(terms[some].view(np.int64), [0, 0])), pa.array(np.append(df[some], [docs, words]))], ["kind", "term", "n"])

    return run


def _terms(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return np.unique(tv.split_words(raw, np.array([0, len(raw)]), tv.ALNUM).hash)


def _shards(items: DataFrame) -> Iterator[tuple[list[tuple], bool]]:
    """(rows of (id, terms), whether others follow): shards of bounded size by a hash of the id; the rows of one id are one item."""
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_ITEMS), -(-chars // SHARD_CHARS))
    kept = items if shards == 1 else cut(items)
    for s in range(shards):
        part: dict = {}
        for r in kept.where(F.pmod(F.xxhash64("i"), F.lit(shards)) == s).toLocalIterator():
            part[r.i] = np.union1d(part.get(r.i, np.zeros(0, np.uint64)), _terms(r.t))
        rows = sorted(((i, t) for i, t in part.items() if len(t)), key=lambda x: (x[0] is None, x[0] or 0))
        yield rows, s < shards - 1


def search(docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's top documents with a score above 0, from rank 1; equal scores by rising doc_id.

    Rows of items with one id are one item (null is an id), and items without terms find nothing. Documents that are null or without terms aren't
    counted and found by nothing; repeated rows are documents of their own; a null doc_id comes last among equal scores. Ids are cast to
    long. Other columns are ignored, whatever their names; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    wanted = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for shard, more in _shards(wanted):
        terms = spark.sparkContext.broadcast(np.unique(np.concatenate([*(t for _, t in shard), np.zeros(0, np.uint64)])))
        counts = rows.select("text").mapInArrow(_statistics(terms), "kind string, term long, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")).collect()
        total = {r.kind: r.n for r in counts if r.kind != "t"}
        if not shard or not total.get("w"):
            continue
        plan = Plan.build([t for _, t in shard], total["d"], total["w"], {r.term: r.n for r in counts if r.kind == "t"}, top)
        found = rows.mapInArrow(_search(spark.sparkContext.broadcast(plan)), _SCHEMA)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        part = Window.partitionBy("number", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order)
        whole = Window.partitionBy("number").orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)
        ids = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(shard)], "number long, item_id long")  # at most SHARD_ITEMS rows
        found = found.join(F.broadcast(ids), "number").select("item_id", "rank", "doc_id", "score")
        out = out.union(scratch.keep(found) if more else found)
    return out
