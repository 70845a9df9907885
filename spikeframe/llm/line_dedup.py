"""Line dedup by a log-template tree of fixed depth.

A line is routed by its number of tokens and its leading LEAD tokens to a leaf; tokens with a digit are
variable fields. In a leaf, lines equal but for variable fields share a template. Longer lines are generalised
as well: those of which SIMILAR of all positions agree share a template in which the others are
variable (lines of fewer than LONG tokens aren't generalised: with the leading tokens alike, sentences that differ in one word would be
templates). Such lines agree in the whole of one of some segments of their positions after the leading ones (there is one segment more than
positions may differ), so lines meet by leaf and segment. In a segment some lines are leaders; each line is compared with all of them, those that are
like none go on with new leaders, and so on until every line is a leader or like one. Joined lines are one template.

A template that recurs across documents is dropped from all of them. Recurrence is counted in
unrelated documents: distinct near-copy classes of the texts that hold the template, so copies of a document,
which repeat all of its lines, don't make its lines templates, and neither copies nor repeats in one document
hide a template. The classes come from one-permutation min-hashes of 5-word shingles: texts meet in
bands of them, with leaders as above, and are linked when NEAR of all hashes agree (an estimate of a Jaccard similarity of 0.8 or more).

Only hashes leave the text scan: 16 bytes a line, and 4 bytes per token of longer lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import ngram_join
from . import textvec as tv
from .storage import Scratch, bounded, cut, free_name

LEAD, SIMILAR, LONG = 3, 0.8, 8
#: Fewest tokens of a line that can be dropped, how many of them must be fixed, and fewest unrelated documents that share its template.
MIN_TOKENS, MIN_FIXED, MIN_DOCUMENTS = 4, 3, 4
SHINGLE = 5
#: Min-hashes of a text, bands of them, and the share of equal hashes that links two texts (an estimate
#: of 0.8 has a standard deviation of 0.035).
BINS, BANDS, NEAR = 128, 16, 0.72
#: Leaders of a group in the first round, and at most in a later one (each has eight times as many as the one before).
LEADERS, MOST_LEADERS = 1, 512
_C = np.uint64(0xC2B2AE3D27D4EB4F)
_VARIABLE = np.uint64(0x5851F42D4C957F2D)
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, text_key, text), the lines that can be dropped; shape: codes of a longer line's tokens, 0 for variable ones."""
    for batch in tv.released(batches):
        for row, _, buf, offsets in tv.text_steps(batch.column(2)):
            words = tv.split_words(buf, offsets, ~tv.WHITESPACE)
            if not len(words.hash):
                continue
            digits = tv.running(_DIGIT[buf])
            variable = digits[words.end] > digits[words.start]
            h = np.where(variable, _VARIABLE, words.hash)
            breaks = tv.running(buf == 10)
            line = breaks[words.start] - breaks[words.offsets[words.doc]]
            first = np.flatnonzero(np.concatenate([[True], (words.doc[1:] != words.doc[:-1]) | (line[1:] != line[:-1])]))
            n = np.diff(np.append(first, len(h)))
            pos = (np.arange(len(h)) - np.repeat(first, n)).astype(np.uint64)
            placed = tv.mix(h + (pos + np.uint64(1)) * _C)
            form = tv.mix(np.add.reduceat(placed, first) + n.astype(np.uint64))
            leaf = tv.mix(np.add.reduceat(np.where(pos < LEAD, placed, np.uint64(0)), first) + n.astype(np.uint64) * _C)
            use = (n >= MIN_TOKENS) & (n - np.add.reduceat(variable.astype(np.int64), first) >= MIN_FIXED)
            kept = np.repeat(use & (n >= LONG), n)
            data = np.where(variable, 0, np.maximum(h >> np.uint64(32), np.uint64(1))).astype(np.uint32)[kept]
            ends = np.concatenate([[0], np.cumsum(np.where(n >= LONG, 4 * n, 0)[use])]).astype(np.int32)
            shape = pa.Array.from_buffers(pa.binary(), int(use.sum()), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            at = pa.array(row + words.doc[first][use])
            signed = lambda x: pa.array(x[use].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(line[first][use].astype(np.int32)), signed(leaf), signed(form), shape], ["doc_id", "text_key", "line", "leaf", "form", "shape"])


def _flat(shapes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all shapes of an array, and how many each has."""
    raw = shapes.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint32), np.array([len(x) // 4 for x in raw], np.int64)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of forms (leaf, form, shape), a row (form, segment) for each segment of the positions after LEAD: one more than positions that may differ."""
    for batch in batches:
        if not batch.num_rows:
            continue
        flat, n = _flat(batch.column(2))
        parts = n - np.ceil(SIMILAR * n - 1e-9).astype(np.int64) + 1
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        part = np.maximum(0, pos - LEAD) * np.repeat(parts, n) // np.repeat(n - LEAD, n)
        owner = np.repeat(np.arange(len(n)), n)
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])]))
        code = np.add.reduceat(tv.mix(flat.astype(np.uint64) + (pos.astype(np.uint64) + np.uint64(1)) * _C), first)
        leaf = batch.column(0).to_numpy().view(np.uint64)[owner[first]]
        yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(owner[first])), pa.array(tv.mix(code + leaf + part[first].astype(np.uint64)).view(np.int64))], ["form", "segment"])


@F.arrow_udf(BooleanType())
def _alike(left: pa.Array, right: pa.Array) -> pa.Array:
    """Whether shapes of equal length agree in SIMILAR of all positions (variable ones agree with all), and half of them in fixed tokens."""
    (a, n), (b, _) = _flat(left), _flat(right)
    starts = np.cumsum(n) - n
    fixed, any_ = np.add.reduceat((a == b) & (a > 0), starts, dtype=np.int64), np.add.reduceat((a == b) | (a == 0) | (b == 0), starts, dtype=np.int64)
    return pa.array((any_ >= SIMILAR * n - 1e-9) & (2 * fixed >= n))


def led(members: DataFrame, alike: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """Links (a, b) among members (node, group): every node is linked, or was a leader or compared with all leaders in each of its groups.

    alike takes pairs (a, b) and returns those that are alike. A round takes the first nodes of each group as leaders; nodes that are like no leader of
    any group stay for the next one, with eight times as many leaders, so most groups end after one or two rounds and many unlike nodes cost
    few rounds. The first nodes are found before the shuffle, so a group of any size is dealt out.
    """
    links, many, left = None, LEADERS, members
    while True:
        order = Window.partitionBy("group").orderBy("node")
        first = left.withColumn("at", F.row_number().over(order)).where(F.col("at") <= many + 1)
        first = first.withColumn("more", F.max("at").over(Window.partitionBy("group"))).where((F.col("more") > 1) & (F.col("at") <= many))
        leaders = scratch.keep(first.select("group", F.col("node").alias("b")))
        met = scratch.keep(left.join(bounded(leaders), "group").where(F.col("node") > F.col("b")).select("group", F.col("node").alias("a"), "b"))
        found = scratch.keep(alike(met.select("a", "b").distinct()))
        links = found if links is None else links.union(found)
        rest = met.select("group", F.col("a").alias("node")).distinct().join(leaders.withColumnRenamed("b", "node"), ["group", "node"], "left_anti")
        left = scratch.keep(rest.join(found.select(F.col("a").alias("node")).distinct(), "node", "left_anti"))
        if left.isEmpty():
            return links
        many = min(8 * many, MOST_LEADERS)


def generalised(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(form, template) of the forms of lines (leaf, form, shape) that share a template with another form of their leaf."""
    leaves = lines.where("length(shape) > 0").groupBy("leaf").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a <> b").select("leaf")
    forms = lines.where("length(shape) > 0").join(bounded(scratch.keep(leaves)), "leaf").groupBy("leaf", "form").agg(F.first("shape").alias("shape"))
    forms = scratch.keep(forms)
    segments = scratch.keep(forms.mapInArrow(_segments, "form long, segment long").select(F.col("form").alias("node"), F.col("segment").alias("group")))
    left, right = forms.select(F.col("form").alias("a"), "shape"), forms.select(F.col("form").alias("b"), F.col("shape").alias("other"))
    links = led(segments, lambda pairs: pairs.join(left, "a").join(right, "b").where(_alike("shape", "other")).select("a", "b"), scratch)
    return scratch.keep(ngram_join.components(links, scratch).select(F.col("node").alias("form"), F.col("label").alias("template")))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (text_key, text), BINS min-hashes of a byte each, and a hash of each of BANDS bands of them. An empty bin takes the next full one."""
    for batch in tv.released(batches):
        for row, last, buf, offsets in tv.text_steps(batch.column(1)):
            h, owner = tv.shingles(tv.split_words(buf, offsets, ~tv.WHITESPACE), SHINGLE)
            texts = last - row
            least = np.sort((owner.astype(np.uint64) * np.uint64(BINS) + (h & np.uint64(BINS - 1))) << np.uint64(40) | h >> np.uint64(24))
            cell = (least >> np.uint64(40)).astype(np.int64)
            one = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))[: len(cell)]
            table, full = np.zeros(texts * BINS, np.uint64), np.zeros(texts * BINS, bool)
            table[cell[one]], full[cell[one]] = least[one] & np.uint64((1 << 40) - 1), True
            # the next full bin of the same text, in a circle
            table, full = (np.concatenate([x.reshape(texts, BINS)] * 2, 1) for x in (table, full))
            place = np.where(full, np.arange(2 * BINS), 2 * BINS - 1)
            place = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :BINS]
            some = full.any(1)
            value = tv.mix(np.take_along_axis(table, place, 1) + (place % BINS).astype(np.uint64) * _C)[some]
            bands = value.reshape(-1, BINS // BANDS, BANDS).sum(1, dtype=np.uint64)  # a band's bins lie apart
            bands = tv.mix(bands + np.arange(BANDS, dtype=np.uint64) * _C)
            sketch = (value & np.uint64(255)).astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + np.flatnonzero(some))), pa.array([x.tobytes() for x in sketch], pa.binary()), lists], ["text_key", "sketch", "bands"])


@F.arrow_udf(BooleanType())
def _near(left: pa.Array, right: pa.Array) -> pa.Array:
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, BINS) for x in (left, right))
    return pa.array((a == b).mean(1) >= NEAR)


def copy_classes(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(text_key, copies_of) of those texts (text_key, text) that have near copies among them: the least key of each one's class."""
    one = texts.mapInArrow(_signatures, "text_key long, sketch binary, bands array<long>").groupBy("text_key").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    signed = scratch.keep(one)
    bands = scratch.keep(signed.select(F.col("text_key").alias("node"), F.explode("bands").alias("group")))
    left, right = signed.select(F.col("text_key").alias("a"), "sketch"), signed.select(F.col("text_key").alias("b"), F.col("sketch").alias("other"))
    links = led(bands, lambda pairs: pairs.join(left, "a").join(right, "b").where(_near("sketch", "other")).select("a", "b"), scratch)
    return ngram_join.components(links, scratch).select(F.col("node").alias("text_key"), F.col("label").alias("copies_of"))


def template_lines(docs: DataFrame, scratch: Scratch, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, text_key, dropped array of line numbers from 0) of the rows (doc_id, text_key, text) with recurring lines."""
    lines = scratch.keep(docs.mapInArrow(_scan, "doc_id long, text_key long, line int, leaf long, form long, shape binary"))
    names = generalised(lines, scratch)
    named = lines.select("doc_id", "text_key", "line", "form").join(bounded(names), "form", "left").withColumn("template", F.coalesce("template", "form")).drop("form")
    often = scratch.keep(named.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents).select("template"))
    found = scratch.keep(named.join(bounded(often), "template"))
    held = found.select("template", "text_key").distinct()
    several = scratch.keep(held.groupBy("template").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_documents).select("template"))
    held = scratch.keep(held.join(bounded(several), "template"))
    keys = scratch.keep(held.select("text_key").distinct())
    classes = scratch.keep(copy_classes(docs.select("text_key", "text").join(bounded(keys), "text_key"), scratch))
    unrelated = held.join(bounded(classes), "text_key", "left").select("template", F.coalesce("copies_of", "text_key").alias("copies_of")).distinct()
    dropped = scratch.keep(unrelated.groupBy("template").agg(F.count("*").alias("documents")).where(F.col("documents") >= min_documents).select("template"))
    return found.join(bounded(dropped), "template").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line")).alias("dropped"))


def dedup_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text", out_col: str = "dropped") -> DataFrame:
    """All rows and columns of docs, with recurring lines taken out of the text, and out_col, their line numbers from 0.

    Rows without such lines keep their text (null and empty ones too) and have a null out_col. Lines of fewer than
    MIN_TOKENS tokens or MIN_FIXED fixed ones stay. Ids may be null or repeat, and are cast to long (text that isn't a
    number raises an error); repeated rows stay, each cleaned alike. Other columns may have any
    names; where docs has a column named out_col, underscores are added to the new one's name. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    found = cut(template_lines(rows.select("doc_id", "text_key", "text"), scratch, min_documents)).withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    scratch.clear()
    out = rows.join(bounded(found), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("dropped", i)), "\n")
    kept = lambda c: F.when(F.col("dropped").isNull(), F.col("row")[c]).otherwise(rest) if c == text_col else F.col("row")[c]
    return out.select(*(kept(c).alias(c) for c in docs.columns), F.col("dropped").alias(free_name(docs.columns, out_col)))
