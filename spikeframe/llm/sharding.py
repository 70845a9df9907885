"""Shards along a Hilbert curve over metadata dimensions. DataFrame functions only.

Language, source and size are quantised to BITS bits each (names by their rank, so no two names share
a cell unless there are more names than cells, and then only neighbours do); rows are sorted by the curve index (then
by text, then by id) and cut into runs of equal row counts, so each shard covers a compact piece of
the metadata space and file statistics prune on every dimension. Equal texts take the metadata of
their group's smallest values and so stand together in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import bounded, cut

BITS = 5


def hilbert_index(df: DataFrame, dims: list[str], bits: int, out: str) -> DataFrame:
    """Adds the Hilbert curve index of integer columns dims (each below 2 ** bits), by Skilling's transform.

    Every step is a projection of its own, so no expression is copied into the next.
    """
    x = [f"__h{i}" for i in range(len(dims))]
    df = df.withColumns({a: F.col(d).cast("long") for a, d in zip(x, dims, strict=True)})
    bit = lambda c, q: F.col(c).bitwiseAND(F.lit(q)) != 0
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i, a in enumerate(x):
            swap = F.col(x[0]).bitwiseXOR(F.col(a)).bitwiseAND(F.lit(low))
            step = {x[0]: F.when(bit(a, q), F.col(x[0]).bitwiseXOR(F.lit(low))).otherwise(F.col(x[0]).bitwiseXOR(swap))}
            if i:
                step[a] = F.when(bit(a, q), F.col(a)).otherwise(F.col(a).bitwiseXOR(swap))
            df = df.withColumns(step)
        q >>= 1
    for a, before in zip(x[1:], x[:-1], strict=True):
        df = df.withColumn(a, F.col(a).bitwiseXOR(F.col(before)))
    turn: Column = F.lit(0).cast("long")
    q = 1 << (bits - 1)
    while q > 1:
        turn = turn.bitwiseXOR(F.when(bit(x[-1], q), F.lit(q - 1)).otherwise(F.lit(0)))
        q >>= 1
    df = df.withColumn("__turn", turn)
    index: Column = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for i, a in enumerate(x):
            place = level * len(x) + len(x) - 1 - i
            value = F.shiftright(F.col(a).bitwiseXOR(F.col("__turn")), level).bitwiseAND(F.lit(1))
            index = index + F.shiftleft(value, place)
    return df.withColumn(out, index).drop("__turn", *x)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds the global row number from 0 along order, without a task that holds all rows."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    ranged = ranged.withColumn("__m", F.monotonically_increasing_id())
    ranged = ranged.withColumn("__part", F.shiftright("__m", 33))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("c"))  # one row per partition
    before = F.coalesce(F.sum("c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__before"))
    return ranged.join(F.broadcast(starts), "__part").withColumn(out, F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__part", "__before")


def name_places(rows: DataFrame, name: str, cells: int, out: str) -> DataFrame:
    """Adds the cell, from 0 to cells - 1, of each name by its rank among the distinct names."""
    ranked = cut(numbered(rows.select(name).distinct(), [name], "__rank"))
    n = max(1, ranked.count())
    cell = F.expr(f"(__rank * {cells}) div {n}") if n > cells else F.col("__rank")
    return rows.join(bounded(ranked.select(name, cell.cast("int").alias(out))), name)


def hilbert_shards(docs: DataFrame, shards: int = 8, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot of every row; row counts of shards are at most one apart.

    Null texts count as empty, null languages and sources as empty strings; rows may repeat; ids are passed on and may be
    null. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"), name(lang_col).alias("lang"), name(source_col).alias("source")))
    group = ["size", "text_crc32", "key"]
    several = rows.groupBy(*group).agg(F.count("*").alias("n"), F.min("lang").alias("glang"), F.min("source").alias("gsource")).where("n > 1")
    rows = rows.join(bounded(cut(several)), group, "left").withColumns({"lang": F.coalesce("glang", "lang"), "source": F.coalesce("gsource", "source")})
    top = (1 << bits) - 1
    rows = name_places(name_places(rows, "lang", top + 1, "d0"), "source", top + 1, "d1").withColumn("d2", F.least(F.lit(top), F.floor(F.log2("size") * 2)))
    rows = hilbert_index(rows, ["d0", "d1", "d2"], bits, "curve").select("doc_id", "size", "text_crc32", "key", "curve")
    ranked = numbered(rows, ["curve", "text_crc32", "key", "doc_id"], "rank")
    total = docs.count()
    exact = F.expr(f"(rank * {shards}) div {max(1, total)}")
    ranked = ranked.withColumn("shard", exact.cast("int"))
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("rank") - first).alias("slot"))
