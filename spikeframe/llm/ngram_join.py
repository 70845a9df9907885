"""N-gram Jaccard self-join of documents by a blocked sparse product of the document by n-gram incidence.

The product A * A^T is taken over the few blocks that can matter: with all n-grams in one global
order, two sets of Jaccard similarity t or more share one of the first n - ceil(t * n) + 1 of either
(the size-derived prefix bound), so documents meet in the columns of their prefix n-grams. N-grams that
many documents hold come last in that order, so their long columns drop out of nearly every prefix. Equal
sets meet by a 128-bit fingerprint before anything else.

A block is a column, or a tile of it where the column is long, with the whole rows of its documents. In
it one row at a time (the pivot) is multiplied with the others: overlap counts accumulate over ranges of
n-grams, and a pair is discarded as soon as its count and what is left of the shorter row can't reach
the overlap that the two sizes ask for. A parity sketch, whose Hamming distance never exceeds the size of the
symmetric difference, discards most pairs before. The counts decide; rows already linked, directly or through
others, aren't multiplied again.

First each document goes to one column, the longest of its own: copies meet there. Then, in columns that
still hold several components, all rows outside the largest one are pivots, and those that size
or sketch don't rule out are multiplied with the column's rows. So every pair of different components that
could link is looked at and no component is split. Columns and blocks give rows of one per
document or link at most, never all pairs of a group; the work is quadratic only in texts of one
column that neither link nor differ in size or sketch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .storage import BROADCAST_ROWS, Scratch, bounded, cut

#: Fewest bits of a sketch; one has a power of two of at least so many as its set has n-grams.
SKETCH_BITS = 512
#: A column of more rows is cut into tiles of about this many.
TILE = 2048
#: Ranges of n-grams over which a product accumulates.
RANGES = 4
#: Rows of a task that multiplies blocks.
BLOCK_ROWS = 4096
#: N-grams that LOCAL documents of a run of texts and HEAVY in all hold are ordered last; the order may be
#: any, so the list has a bound (the most frequent stay).
LOCAL, HEAVY, HEAVY_MAX = 2, 6, 1_000_000
#: N-grams that are counted at once.
RUN = 1 << 20

_BASE = "doc_id long, n long, f1 long, f2 long, sketch binary, keys array<long>"


def _unique_sets(column, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for row, last, buf, offsets in tv.text_steps(column):
        h, owner = tv.shingles(tv.split_words(buf, offsets, ~tv.WHITESPACE), k)
        cuts = np.searchsorted(owner, np.arange(last - row + 1))
        yield row, [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _frequent(k: int) -> Callable:
    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts >= LOCAL
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["key", "found"])

    def run(batches):
        sets, size = [], 0
        for batch in tv.released(batches):
            for _, part in _unique_sets(batch.column(0), k):
                sets += part
                size += sum(map(len, part))
                if size >= RUN:
                    yield counted(sets)
                    sets, size = [], 0
        if sets:
            yield counted(sets)

    return run


def _sketches(sets: list[np.ndarray]) -> list[bytes]:
    """The parity sketch of each set: a bit for each value of an n-gram's low bits, set where an odd number of n-grams has it."""
    size = np.array([max(SKETCH_BITS, 1 << max(0, len(s) - 1).bit_length()) for s in sets], np.int64)
    start = np.cumsum(size) - size
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    count = [len(s) for s in sets]
    at = np.repeat(start, count) + (flat & np.repeat(size - 1, count).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(size.sum())) & 1).astype(bool))
    return [packed[a // 8 : (a + n) // 8].tobytes() for a, n in zip(start, size, strict=True)]


def _heavy(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent n-grams in rising order, and how many documents hold each: at most HEAVY_MAX, by a least count."""
    often = cut(texts.mapInArrow(_frequent(k), "key long, found long").groupBy("key").agg(F.sum("found").alias("found")).where(F.col("found") >= HEAVY))
    by_count = often.groupBy(F.least("found", F.lit(100_000)).alias("found")).agg(F.count("*").alias("n")).collect()
    least, total = 100_001, 0
    for r in sorted(by_count, reverse=True):
        if total + r.n > HEAVY_MAX:
            break
        least, total = r.found, total + r.n
    top = often.where(F.col("found") >= least).toArrow()
    values = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(values)
    return values[order], top.column("found").to_numpy()[order].astype(np.int32)


def _incidence(k: int, num: int, den: int, heavy) -> Callable:
    """Size, fingerprint, sketch and prefix of each row's set."""

    def run(batches):
        values, count = heavy.value
        for batch in tv.released(batches):
            for row, sets in _unique_sets(batch.column(1), k):
                n = np.array([len(s) for s in sets], np.int64)
                take = np.where(n > 0, n - (num * n + den - 1) // den + 1, 0)
                keys, f1, f2 = [], [], []
                for s, length in zip(sets, take, strict=True):
                    at = np.searchsorted(values, s)
                    at[at == len(values)] = 0
                    common = values[at] == s if len(values) else np.zeros(len(s), bool)
                    order = s[~common]
                    if len(order) < length:
                        order = np.concatenate([order, s[common][np.argsort(count[at[common]], kind="stable")]])
                    keys.append(order[:length])
                    f1.append(np.bitwise_xor.reduce(s) if len(s) else np.uint64(0))
                    f2.append(np.add.reduce(s * s + (s >> np.uint64(7))) if len(s) else np.uint64(0))
                flat = np.concatenate([*keys, np.zeros(0, np.uint64)])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), pa.array(flat.view(np.int64)))
                sketch = pa.array(_sketches(sets), pa.binary())
                prints = [pa.array(np.array(f, np.uint64).view(np.int64)) for f in (f1, f2)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array(n), *prints, sketch, lists], ["doc_id", "n", "f1", "f2", "sketch", "keys"])

    return run


def _groups(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The table in order of key and tile, and where each block begins, with the end."""
    table = table.sort_by([("key", "ascending"), ("tile", "ascending"), ("doc_id", "ascending")])
    key, tile = table.column("key").to_numpy(), table.column("tile").to_numpy()
    return table, np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]), [True]])) if len(key) else np.zeros(0, int)


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches of fewer words: those of the same sets by fewer low bits."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


class _Rows:
    """Rows of blocks: sizes, sketches, labels, and which are rows or pivots of the product."""

    def __init__(self, table: pa.Table, n: np.ndarray, sketches: list[bytes], num: int, den: int):
        self.n, self.num, self.den = n, num, den
        self.label, self.row, self.col = (table.column(c).to_numpy() for c in ("label", "is_row", "is_col"))
        self.label = self.label.copy()
        # sketches of one length make a matrix; where: a row's place in it
        self.words = np.array([len(s) // 8 for s in sketches], np.int64)
        self.where, self.matrix = np.zeros(len(sketches), np.int64), {}
        for words in np.unique(self.words):
            mine = np.flatnonzero(self.words == words)
            self.where[mine] = np.arange(len(mine))
            self.matrix[int(words)] = np.frombuffer(b"".join(sketches[i] for i in mine), np.uint64).reshape(len(mine), words)

    def _apart(self, hits: np.ndarray, c: int) -> np.ndarray:
        """Hamming distances of the sketches of hits to that of c, at the shorter length of each pair."""
        out, own = np.zeros(len(hits), np.int64), int(self.words[c])
        pivot = self.matrix[own][self.where[c]][None]
        for words in np.unique(self.words[hits]):
            mine, short = self.words[hits] == words, min(own, int(words))
            both = _folded(self.matrix[int(words)][self.where[hits[mine]]], short) ^ _folded(pivot, short)
            out[mine] = np.bitwise_count(both).sum(1, dtype=np.int64)
        return out

    def partners(self, c: int, lo: int, hi: int) -> np.ndarray:
        """Rows of the block lo to hi that pivot c could link and isn't linked with yet, by size and sketch."""
        size = self.n[lo:hi]
        ok = self.row[lo:hi] & (self.label[lo:hi] != self.label[c]) & (self.den * np.minimum(size, self.n[c]) >= self.num * np.maximum(size, self.n[c]))
        hits = lo + np.flatnonzero(ok)
        return hits[(self.den + self.num) * self._apart(hits, c) <= (self.den - self.num) * (self.n[hits] + self.n[c])] if len(hits) else hits


def _candidates(num: int, den: int) -> Callable:
    """Of blocks of (key, tile, doc_id, n, sketch, label, is_row, is_col), the rows and pivots that size and sketch don't rule out."""

    def run(table: pa.Table) -> pa.Table:
        table, edge = _groups(table)
        n = table.column("n").to_numpy()
        rows = _Rows(table, n, table.column("sketch").to_pylist(), num, den)
        is_row, is_col = np.zeros(len(n), bool), np.zeros(len(n), bool)
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            for c in lo + np.flatnonzero(rows.col[lo:hi]):
                hits = rows.partners(c, lo, hi)
                is_row[hits] = True
                is_col[c] |= len(hits) > 0
        out = table.select(["key", "tile", "doc_id", "label"]).append_column("is_row", pa.array(is_row)).append_column("is_col", pa.array(is_col))
        return out.filter(pa.array(is_row | is_col))

    return run


def _multiply(k: int, num: int, den: int) -> Callable:
    """Links (a, b) of blocks of (key, tile, doc_id, label, is_row, is_col, text) that connect rows not connected before."""

    def run(table: pa.Table) -> pa.Table:
        table, edge = _groups(table)
        sets = [s for _, part in _unique_sets(table.column("text"), k) for s in part]
        doc, n = table.column("doc_id").to_numpy(), np.array([len(s) for s in sets], np.int64)
        rows = _Rows(table, n, _sketches(sets), num, den)
        limits = np.arange(1, RANGES, dtype=np.uint64) * np.uint64((1 << 64) // RANGES)
        cuts = np.array([[0, *np.searchsorted(s, limits), len(s)] for s in sets], np.int64).reshape(-1, RANGES + 1)
        found_a, found_b = [], []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            for c in lo + np.flatnonzero(rows.col[lo:hi]):
                hits = rows.partners(c, lo, hi)
                if not len(hits):
                    continue
                need = -(-num * (n[hits] + n[c]) // (den + num))
                overlap = np.zeros(len(hits), np.int64)
                for j in range(RANGES):
                    mine = sets[c][cuts[c, j] : cuts[c, j + 1]]
                    parts = [sets[h][cuts[h, j] : cuts[h, j + 1]] for h in hits]
                    size = np.array([len(x) for x in parts], np.int64)
                    if len(mine) and size.any():
                        flat = np.concatenate(parts)
                        at = np.searchsorted(mine, flat)
                        at[at == len(mine)] = 0
                        total = np.concatenate([[0], np.cumsum(mine[at] == flat)])
                        ends = np.cumsum(size)
                        overlap += total[ends] - total[ends - size]
                    left = np.minimum(n[hits] - cuts[hits, j + 1], n[c] - cuts[c, j + 1])
                    alive = overlap + left >= need
                    hits, need, overlap = hits[alive], need[alive], overlap[alive]
                    if not len(hits):
                        break
                if len(hits):
                    new = np.unique(rows.label[hits], return_index=True)[1]
                    found_a.append(np.full(len(new), doc[c]))
                    found_b.append(doc[hits[new]])
                    here = rows.label[lo:hi]
                    here[np.isin(here, rows.label[hits])] = rows.label[c]
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (found_a, found_b))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return run


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable over edges (a, b), by alternating large and small stars."""
    edges = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        edges = scratch.keep(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = state
    raise RuntimeError("components did not settle")


def similar_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs, with sets of k-word shingles linked at Jaccard num / den.

    Words are runs of bytes other than white space, A-Z lower-cased. Null or empty texts have an
    empty set, link to nothing and are their own component. Rows of one id count as one node; rows
    with a null id are returned with a null component and link nothing. Ids are cast to long (text that isn't a
    number raises an error). Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scratch = Scratch(spark)
    heavy = spark.sparkContext.broadcast(_heavy(rows.select("text"), k))
    base = cut(rows.mapInArrow(_incidence(k, num, den, heavy), _BASE))
    named = base.where("n > 0 and doc_id is not null")
    reps = named.groupBy("n", "f1", "f2").agg(F.min(F.struct("doc_id", "keys")).alias("r")).select("n", "r.*")
    cells = scratch.keep(reps.select("doc_id", "n", F.explode("keys").alias("key")))
    columns = cells.groupBy("key").agg(F.count("*").alias("m"), F.min("doc_id").alias("centre"), F.bit_xor(F.xxhash64("doc_id")).alias("members")).where("m > 1")
    # columns of the same members hold the same pairs: one of them stays
    columns = scratch.keep(columns.groupBy("m", "centre", "members").agg(F.min("key").alias("key")).drop("members"))
    posting = scratch.keep(cells.join(bounded(columns), "key"))
    # sets of different texts under one id are one node
    equal = scratch.keep(named.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a <> z").drop("z"))
    links = named.select("n", "f1", "f2", F.col("doc_id").alias("b")).join(bounded(equal), ["n", "f1", "f2"]).where("a <> b").select("a", "b")
    sketches = base.where("n > 0").select("doc_id", "n", "sketch")

    def linked(blocks: DataFrame) -> DataFrame:
        """The product of those rows of blocks (key, tile, doc_id, n, sketch, label, is_row, is_col) that size and sketch leave."""
        near = _in_blocks(blocks, _candidates(num, den), "key long, tile long, doc_id long, label long, is_row boolean, is_col boolean")
        # ids of several texts have a row for each
        near = near.groupBy("key", "tile", "doc_id", "label").agg(F.bool_or("is_row").alias("is_row"), F.bool_or("is_col").alias("is_col"))
        return scratch.keep(_linked(rows, scratch.keep(near), k, num, den))

    if not posting.isEmpty():
        first = linked(_own_columns(posting).join(sketches, "doc_id"))
        links = links.union(first)
        labelled = _labelled(posting, components(first, scratch), scratch, num, den)
        if not labelled.isEmpty():
            links = links.union(linked(_tiles(labelled.join(sketches, "doc_id"))))
    known = cut(components(links, scratch))
    scratch.clear()
    return (
        base.select("doc_id", F.col("n").alias("n_shingles"))
        .join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    )


def _own_columns(posting: DataFrame) -> DataFrame:
    """Blocks in which each document stands once, in the longest column of its own; a column's centre stands in all of its tiles."""
    own = posting.groupBy("doc_id").agg(F.max(F.struct("m", "key", "centre")).alias("x")).select("doc_id", "x.key", "x.centre")
    tiles = own.groupBy("key", "centre").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    members = own.drop("centre").join(tiles, "key").select("key", F.pmod(F.xxhash64("doc_id"), "tiles").alias("tile"), "doc_id")
    centres = tiles.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), F.col("centre").alias("doc_id"))
    yes = F.lit(True)
    return members.union(centres).distinct().withColumns({"label": F.col("doc_id"), "is_row": yes, "is_col": yes})


def _labelled(posting: DataFrame, known: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """Rows of the columns that hold several components, with their labels, the column's main label and how many rows lie outside it.

    Rows whose size is too far from the next smaller and the next larger one of the column are left out: they can't link there.
    """
    labelled = scratch.keep(posting.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")))
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("x"), F.count("*").alias("labels")).where("labels > 1")
    several = labelled.join(main.select("key", F.col("x.label").alias("main"), F.col("x.c").alias("c")), "key")
    by_size = Window.partitionBy("key").orderBy("n", "doc_id")
    several = several.withColumns({"before": F.lag("n").over(by_size), "after": F.lead("n").over(by_size)})
    near = several.where((den * F.col("before") >= num * F.col("n")) | (den * F.col("n") >= num * F.col("after")))
    return scratch.keep(near.select("key", "doc_id", "label", "m", "main", (F.col("m") - F.col("c")).alias("outside")))


def _tiles(labelled: DataFrame) -> DataFrame:
    """Blocks of all rows of a column by the rows outside its main component; row by column tiles of at most about TILE each."""
    labelled = labelled.withColumns({"rows": F.ceil(F.col("m") / TILE), "cols": F.ceil(F.col("outside") / TILE), "pivot": F.col("label") != F.col("main")})
    mine: Callable[[str, int], Column] = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n))
    one = labelled.where("rows = 1 and cols = 1").withColumns({"tile": F.lit(0).cast("long"), "is_row": F.lit(True), "is_col": F.col("pivot")})
    many = labelled.where("rows > 1 or cols > 1")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    as_row = many.withColumn("c", upto("cols")).withColumns({"tile": mine("rows", 1) * F.col("cols") + F.col("c"), "is_row": F.lit(True), "is_col": F.lit(False)})
    as_col = many.where("pivot").withColumn("r", upto("rows")).withColumns({"tile": F.col("r") * F.col("cols") + mine("cols", 2), "is_row": F.lit(False), "is_col": F.lit(True)})
    wanted = ["key", "tile", "doc_id", "n", "sketch", "label", "is_row", "is_col"]
    return one.select(wanted).union(as_row.select(wanted)).union(as_col.select(wanted))


def _in_blocks(blocks: DataFrame, run: Callable, schema: str, parts: int | None = None) -> DataFrame:
    """run over the blocks, which are dealt to tasks by their key and tile."""
    parts = max(parts or 0, 4 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return blocks.groupBy(F.pmod(F.xxhash64("key", "tile"), F.lit(parts)).alias("part")).applyInArrow(run, schema)


def _linked(rows: DataFrame, blocks: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that the products of blocks (key, tile, doc_id, label, is_row, is_col) find."""
    size = blocks.count()
    near = F.broadcast(blocks) if size <= BROADCAST_ROWS else blocks
    whole = rows.join(near, "doc_id").select("key", "tile", "doc_id", "label", "is_row", "is_col", "text")
    return _in_blocks(whole, _multiply(k, num, den), "a long, b long", size // BLOCK_ROWS)
