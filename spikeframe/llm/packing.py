"""Sequence packing by Karmarkar-Karp multiway differencing.

Every document is cut at multiples of the window; whole windows are sequences by themselves. What
remains of each document is dealt by a hash into blocks of about BLOCK rows. In a block,
differencing joins the two partial partitions of the largest imbalance, the large parts of one with
the small parts of the other, until one partition is left: near-equal windows. If a window is above
capacity the window count rises and the block is partitioned again.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .storage import cut, small_batches
from .tokens import LOOKUP_BYTES, encoder

#: Remainders in a block, the sequence numbers that a block owns, and the longest part of a document.
BLOCK, SEQUENCES = 1500, 1 << 24
#: A remainder is cut into equal parts of at most this share of a window; smaller parts level better.
PART = 4


def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Indices of sizes in k groups of near-equal sums (Karmarkar-Karp, any k of 1 or more)."""
    # a group is a node: an index of sizes, or one that joins two nodes; a partition: sums of its non-empty groups in falling order, and their nodes
    below: list[tuple[int, int]] = []
    # heap entries: negative imbalance, tie, the partition
    heap: list = [(-int(s), i, np.array([s], np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    if not heap:
        return [[] for _ in range(k)]
    tie = len(heap)
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        over = max(0, len(a) + len(b) - k)
        sums = np.concatenate([a, b[: len(b) - over]])
        nodes = np.concatenate([an, bn[: len(b) - over]])
        if over:  # the smallest of a meet the smallest of b in reverse, all others stay alone
            sums[len(a) - over : len(a)] += b[len(b) - over :][::-1]
            pairs = list(zip(an[len(a) - over :].tolist(), bn[len(b) - over :][::-1].tolist(), strict=True))
            nodes[len(a) - over : len(a)] = np.arange(over) + len(sizes) + len(below)
            below += pairs
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        low = int(sums[-1]) if len(sums) == k else 0
        heapq.heappush(heap, (low - int(sums[0]), tie, sums, nodes))
        tie += 1
    groups: list[list[int]] = []
    for node in heap[0][3].tolist():
        members, open_ = [], [node]
        while open_:
            at = open_.pop()
            if at < len(sizes):
                members.append(at)
            else:
                open_ += below[at - len(sizes)]
        groups.append(members)
    return [*groups, *([] for _ in range(k - len(groups)))]


def windows(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Groups of at most capacity; starts at the fewest windows that could hold all and adds some while one overflows."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        groups = differencing(sizes, k)
        most = max((int(sizes[g].sum()) for g in groups), default=0)
        if most <= capacity:
            return [g for g in groups if g]
        k += max(1, int(k * (most - capacity) / capacity / 2))


def _pieces(path: str, end_id: int, capacity: int) -> Callable:
    def run(batches):
        enc, before = encoder(path, False), 0
        for batch in tv.released(batches):
            for row, _, buf, offsets in tv.text_steps(batch.column(1), LOOKUP_BYTES):
                counts, ids = enc.encode(buf, offsets)
                source, start, length, crc, total = [], [], [], [], []
                ends = np.cumsum(counts)
                for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
                    raw = np.append(ids[a:b], np.uint32(end_id)).astype("<u4").tobytes()
                    n = b - a + 1
                    whole = n // capacity * capacity
                    parts = -(-(n - whole) * PART // capacity)
                    cuts = [*range(0, whole + 1, capacity), *(whole + (n - whole) * (j + 1) // parts for j in range(parts))]
                    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                        source.append(row + i)
                        start.append(lo)
                        length.append(hi - lo)
                        crc.append(zlib.crc32(raw[4 * lo : 4 * hi]))
                        total.append(n)
                numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                salt = pa.array(np.array(source, np.int64) + before)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *numbers, salt], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])
            before += batch.num_rows

    return run


def _pack(capacity: int) -> Callable:
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([(c, "ascending") for c in ("doc_id", "start", "length", "ids_crc32")])
        size = block.column("length").to_numpy()
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        full = np.flatnonzero(size == capacity)
        sequence[full] = np.arange(len(full))
        rest = np.flatnonzero(size < capacity)
        for number, group in enumerate(windows(size[rest], capacity), len(full)):
            at = rest[sorted(group)]
            sequence[at] = number
            offset[at] = np.cumsum(size[at]) - size[at]
        sequence += block.column("block")[0].as_py() * SEQUENCES
        return block.drop_columns(["block"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most capacity tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null texts are empty and have
    the end token only. Repeated rows are packed once each; null ids are allowed; neither lands in one block, since
    blocks are dealt by id and by the row's place in its input file. Ids are cast to long. Other columns are ignored; an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = max(1, -(-docs.count() // BLOCK))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = rows.mapInArrow(_pieces(tokenizer_path, end_id, capacity), f"{schema}, salt long")  # salt: the row's number in its task
    # pieces are written once: a task that runs again may meet its rows in another order, and then numbers them otherwise
    pieces = cut(pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "salt", F.when(F.col("length") == capacity, F.col("start"))), F.lit(blocks))).drop("salt"))
    return pieces.groupBy("block").applyInArrow(_pack(capacity), f"{schema}, sequence_id long, offset long")
