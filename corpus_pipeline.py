"""A training corpus in five stages; each takes what the one before kept and all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeframe.llm import decontam, line_dedup, ngram_join, packing, toxicity
from spikeframe.llm.queries import END_ID, WINDOW, id_hash, table, tokenizer
from spikeframe.llm.storage import Scratch, bounded, cut, free_name

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. Null and empty texts stay; ids may be null or repeat; other columns are passed on."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), id_hash(3) != 1))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; n_chars, where docs has it, follows the text.

    All rows stay, those of null and empty texts unchanged; ids may be null or repeat; other columns are passed on.
    """
    dropped = free_name(docs.columns, "dropped")
    out = line_dedup.dedup_lines(docs, out_col=dropped)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with 5-word shingles of Jaccard 0.8 or more, one row of the smallest id stays.

    A node is a text, named by its hash, so repeated rows, null ids and several texts under one id are each
    judged by their texts. Rows whose text has no words are in no component and all stay; null ids come last.
    Other columns are passed on, whatever their names. Only ids and hashes are sorted and joined, unless rows repeat whole.
    """
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    rows = rows.withColumn("row_key", F.xxhash64(F.to_json("row")))
    found = ngram_join.similar_components(rows.select(F.col("text_key").alias("doc_id"), "text"), k=5, num=80, den=100)
    groups = found.where("n_shingles > 0").select(F.col("doc_id").alias("text_key"), F.col("component_id").alias("component")).distinct()
    each = cut(rows.groupBy("text_key", "doc_id", "row_key").agg(F.count("*").alias("n")).join(groups, "text_key"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "row_key", "n")
    best = cut(each.groupBy("component").agg(F.min(order).alias("best")).select("best.text_key", "best.row_key", "best.n"))
    key = ["text_key", "row_key"]
    kept = rows.join(bounded(each.select(key).join(best, key, "left_anti")), key, "left_anti")
    again = best.where("n > 1").select(key)
    once = kept.join(bounded(again), key, "left_semi").dropDuplicates(key)
    return kept.join(bounded(again), key, "left_anti").select("row.*").union(once.select("row.*"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts stay; ids may be null or repeat; other columns are passed on."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of WINDOW tokens.

    Null and empty texts have the end token only; repeated rows are packed once each; ids may be null; other columns go.
    """
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), WINDOW, END_ID)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_jaccard_join", drop_near_duplicates), ("decontamination", drop_leaks), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again by the next, and cleared when that one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before:
            before.clear()
        before = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
