"""Quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame functions only.

Each document gets measures (native expressions over the whole text). Per language and source a KLL
sketch of each measure gives its upper fence: median + SPREAD * (median - 10 % quantile), at least
the measure's slack above the median, so that even a group of which nearly half is junk keeps a
fence for its clean half. Both quantiles are a mean of the group's own and its language's, with weights n and PRIOR_ROWS, and the
language's in the same way one of its own and everything's (from merged sketches): small groups lean on the coarser
ones, and at every size the group's own rows count. The fences are then joined to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut

SPREAD, PRIOR_ROWS, SKETCH_K = 8.0, 50.0, 2048
#: Measures and the least distance of the fence from the median.
MEASURES = {"symbol_share": 0.25, "upper_share": 0.08, "bang_share": 0.2, "repeat_share": 0.35}
SPACE = r"[\x20\x09-\x0D]+"


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the MEASURES of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), text.alias("t"))
    df = df.withColumns(
        {
            "w": F.filter(F.split("t", SPACE), lambda x: x != ""),
            "lines": F.filter(F.split("t", "\n"), lambda x: _without(x, " \t\n\x0b\x0c\r") != ""),
            "word_chars": F.length(_without(F.col("t"), " \t\n\x0b\x0c\r")).cast("long"),
            "n_symbols": (F.length("t") - F.length(_without(F.col("t"), "#*$%&|<>"))).cast("long"),
            "bangs": (F.length("t") - F.length(_without(F.col("t"), "!"))).cast("long"),
            "uppers": (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).cast("long"),
        }
    ).drop("t")
    df = df.withColumns({"n_words": F.size("w").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")}).drop("lines")
    window = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    df = df.withColumn("h", F.when(F.size("w") >= 3, window)).drop("w")
    df = df.withColumn("p", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("h")
    twin = lambda e, i: F.get("p", i - 1)["x"].eqNullSafe(e["x"]) | F.get("p", i + 1)["x"].eqNullSafe(e["x"])
    df = df.withColumn("s", F.sort_array(F.transform(F.filter("p", twin), lambda e: e["i"]))).drop("p")
    covered = F.aggregate(F.transform("s", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("s", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("s")
    share = lambda c, of: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(of).cast("double")), F.lit(0.0))
    return df.withColumns({"symbol_share": share("n_symbols", "n_words"), "upper_share": share("uppers", "word_chars"), "bang_share": share("bangs", "n_words"), "repeat_share": share("n_repeat_words", "n_words")}).drop("bangs", "uppers")


def sketches(measured: DataFrame, keys: tuple[str, ...] = ("lang", "source"), k: int = SKETCH_K) -> DataFrame:
    """One row per group: its number of rows and a KLL sketch of each measure. Such tables of several days can be merged."""
    return measured.groupBy(*keys).agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(m, k).alias(m) for m in MEASURES))


def merged(table: DataFrame, keys: tuple[str, ...], k: int = SKETCH_K) -> DataFrame:
    return table.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(m, k).alias(m) for m in MEASURES))


def fences(table: DataFrame, prior_rows: float = PRIOR_ROWS, spread: float = SPREAD) -> DataFrame:
    """lang, source and the upper fence of each measure, from a table of sketches by lang and source. No rows: no rows."""
    quantiles = {f"{m}_{q}": F.kll_sketch_get_quantile_double(m, F.lit(q / 100)) for m in MEASURES for q in (10, 50)}
    named = lambda df, tag: df.select(*(F.col(c) for c in ("lang", "source") if c in df.columns), F.col("n").alias(f"{tag}_n"), *(c.alias(f"{tag}_{k}") for k, c in quantiles.items()))
    overall = named(merged(table, ()).where("n > 0"), "all").first()  # one row of numbers
    if overall is None:
        return table.select("lang", "source", *(F.lit(0.0).alias(f"{m}_fence") for m in MEASURES))
    df = named(table, "own").join(F.broadcast(named(merged(table, ("lang",)), "lang")), "lang")  # a row per language
    lean = lambda tag, k, coarser: (F.col(f"{tag}_n") * F.col(f"{tag}_{k}") + prior_rows * coarser) / (F.col(f"{tag}_n") + prior_rows)
    df = df.withColumns({f"lang_{k}": lean("lang", k, F.lit(overall[f"all_{k}"])) for k in quantiles})
    df = df.withColumns({f"own_{k}": lean("own", k, F.col(f"lang_{k}")) for k in quantiles})
    fence = lambda m, slack: F.col(f"own_{m}_50") + F.greatest(F.lit(slack), spread * (F.col(f"own_{m}_50") - F.col(f"own_{m}_10")))
    return df.select("lang", "source", *(fence(m, slack).alias(f"{m}_fence") for m, slack in MEASURES.items()))


def quality_filter(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, **columns: str) -> DataFrame:
    """Every row's measures, base_failed and kept.

    Null or empty texts have no words and fail the base rules; null languages and sources count as empty strings;
    ids are passed on and may be null; rows may repeat; other columns are ignored, whatever their names; an empty table
    gives no rows. kept: no base rule fails and no measure is above its group's fence.
    """
    measured = cut(measures(docs, **columns))
    limits = cut(fences(sketches(measured.where(F.col("n_words") >= min_words))))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    above = F.lit(False)
    for m in MEASURES:
        above = above | F.coalesce(F.col(m) > F.col(f"{m}_fence"), F.lit(False))
    out = measured.join(limits, ["lang", "source"], "left").withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & ~above)
