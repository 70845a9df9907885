"""Registered queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, language_id, line_dedup, ngram_join, oracles, packing, periodic_runs, quality_classifier, quality_rules, ranked_search, sharding, tokens, toxicity, url_filter

TOKEN_LIMIT, WINDOW, END_ID = 512, 2048, 1
#: The listed URL rules (verdict, host, path).
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_hash(n: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_filter(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), id_hash(4) != 2)
    return out.select("doc_id", (id_hash(4) == 2).alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), WINDOW, END_ID)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "question_overlap", "answer_overlap")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), TOKEN_LIMIT)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"), F.array_join("dropped", ",").alias("dropped_lines"), "text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.train(docs, table(spark, sf_dir, "labels"), id_hash(3) != 1)
    return toxicity.score_toxicity(docs, scorer).select("doc_id", (id_hash(3) == 1).alias("held_out"), "score", "predicted")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.hilbert_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, labels)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.run_digests(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")))
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=50)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.predict_language(table(spark, sf_dir, "documents"), id_hash(4) != 2)
    return out.select("doc_id", (id_hash(4) == 2).alias("held_out"), "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_quality_classifier, op3_packing, op4_ngram_jaccard_join, op5_decontamination, op6_token_counts, op7_line_dedup, op8_toxicity, op9_sharding, op10_url_filters, op11_periodic_runs, op12_ranked_search, op13_language_id, pipeline)}
ORACLES = oracles.oracles(URL_RULES)
