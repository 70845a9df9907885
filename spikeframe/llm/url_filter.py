"""URL filters: association rules mined by FP-growth from labelled URLs. DataFrame functions only.

A URL becomes a set of tokens (host labels, path segments, query keys). FP-growth over the labelled
URLs that no listed rule decides finds token combinations; those that imply "block" with enough support (a share and a number
of rows) and confidence (the lower end of its interval), and that no shorter such combination covers, become rules. An inverted index from token to rules
matches them: a rule fires when all its tokens are met.

What can't be a part of a longer rule is left out before mining, so that repeated URLs of many tokens don't bring all their
subsets: tokens that are rules by themselves, tokens of too few bad rows, and tokens of every row. Tokens that stand in the very same
rows are one item, and any of them meets it.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bounded, cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fewest labelled rows that a rule rests on, and the width of the interval of its confidence.
LEAST_ROWS, Z = 20, 1.64


def host(url: str = "url") -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of rules (verdict, host, path) that fits columns host and path; null where none does."""
    name, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        name, verdict = name.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(what))
    return name, verdict


def tokens(url: str = "url") -> Column:
    """Distinct tokens of a URL whose columns host and path exist; numbers count as one token."""
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x))
    segment = lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "#"))
    segments = F.transform(F.split("path", "/"), segment)
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    every = F.array_distinct(F.concat(labels, segments, keys))
    return F.filter(every, lambda x: F.length(x) > 2)


def _good(bad: Column, n: Column, min_confidence: float) -> Column:
    """Whether min_confidence is reached by the share of bad rows and by the lower end of its Wilson interval."""
    share = bad / n
    lower = (share + Z * Z / (2 * n) - Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    return (share >= min_confidence) & (lower >= min_confidence)


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(rule, any_of, confidence, support) from rows (tokens, bad boolean); rule: sorted tokens that imply bad; any_of: for each of them the tokens that stand in the same rows.

    A rule has least_rows bad rows or more (and a share of min_support), and min_confidence is reached by the lower end of Wilson's interval of
    its confidence. Empty input or none good enough: no rows. Repeated rows count as often as they occur.
    """
    rows = labelled.where(F.col("bad").isNotNull() & (F.size("tokens") > 0)).select(F.sort_array(F.array_distinct("tokens")).alias("tokens"), "bad")
    sets = cut(rows.groupBy("tokens", "bad").agg(F.count("*").alias("n")))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    need = max(least_rows, math.ceil(min_support * total), 1)
    # two 64-bit signatures of the rows that hold a token
    each = sets.select(F.explode("tokens").alias("token"), "bad", "n", F.xxhash64("tokens", "bad").alias("a"), F.xxhash64(F.lit(1), "tokens", "bad").alias("b"))
    held = each.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("k"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    held = cut(held.where(F.col("k") >= need).withColumn("alone", _good(F.col("k"), F.col("n"), min_confidence)))
    found = held.where("alone").select(F.array("token").alias("rule"), F.array(F.array("token")).alias("any_of"), "k", "n")
    items = held.where(~F.col("alone") & (F.col("n") < total)).groupBy("a", "b", "n").agg(F.array_sort(F.collect_set("token")).alias("same")).select("same", F.col("same")[0].alias("item"))
    items = cut(items)
    names = items.select("item", F.explode("same").alias("token"))
    # each set of tokens by its items; few tokens are left, so hot ones aren't shuffled
    reduced = cut(sets.select(F.xxhash64("tokens", "bad").alias("row"), "bad", "n", F.explode("tokens").alias("token")).join(bounded(names), "token").groupBy("row", "bad", "n").agg(F.array_sort(F.collect_set("item")).alias("items")).where(F.size("items") > 1))
    bad = reduced.where("bad")
    rows = bad.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if rows >= need:
        fitted = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / rows)).fit(bad.select("items", F.explode(F.sequence(F.lit(1), "n"))).select("items"))
        several = cut(fitted.freqItemsets.where(F.size("items") > 1).select(F.array_sort("items").alias("rule"), F.col("freq").alias("k")))
        parts = several.select("rule", F.size("rule").alias("needs"), F.explode("rule").alias("item"))
        met = reduced.where("not bad").select("row", "n", F.explode("items").alias("item")).join(bounded(parts), "item").groupBy("row", "n", "rule", "needs").agg(F.count("*").alias("met"))
        fine = met.where("met = needs").groupBy("rule").agg(F.sum("n").alias("fine"))
        several = several.join(fine, "rule", "left").withColumn("n", F.col("k") + F.coalesce("fine", F.lit(0))).where(_good(F.col("k"), F.col("n"), min_confidence))
        several = cut(several.select("rule", "k", "n"))
        # a rule goes when a part of it is a rule: its parts meet the rules by equality
        masks = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("rule")) - 2).cast("long"))
        part = F.transform(masks, lambda m: F.filter("rule", lambda x, i: F.floor(m / F.pow(F.lit(2), i)) % 2 == 1))
        covered = several.where(F.size("rule") > 2).select(F.col("rule").alias("whole"), F.explode(part).alias("rule")).join(several.select("rule"), "rule").select(F.col("whole").alias("rule")).distinct()
        several = several.join(covered, "rule", "left_anti")
        any_of = several.select("rule", "k", "n", F.posexplode("rule").alias("at", "item")).join(items, "item").groupBy("rule", "k", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "same"))), lambda x: x["same"]).alias("any_of"))
        found = found.unionByName(any_of)
    return found.select("rule", "any_of", (F.col("k") / F.col("n")).alias("confidence"), (F.col("k") / total).alias("support"))


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct url values of urls (url, tokens) that some rule matches: one token or more of each part."""
    index = rules.select("rule", F.size("rule").alias("needs"), F.posexplode("any_of").alias("part", "tokens")).select("rule", "needs", "part", F.explode("tokens").alias("token"))
    # rules are few, so hot tokens aren't shuffled
    met = urls.select("url", F.explode("tokens").alias("token")).join(bounded(cut(index)), "token").groupBy("url", "rule", "needs").agg(F.countDistinct("part").alias("met"))
    return met.where("met = needs").select("url").distinct()


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", min_support: float = 0.002, min_confidence: float = 0.8) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    A listed rule decides where one fits; rules mined from labels (id_col, bad) of the other URLs decide the rest; without
    labels the rest is allowed. Null or malformed URLs have empty host and path, no tokens, and are allowed
    unless a listed rule fits. Ids are passed on and may be null; rows may repeat. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    df = df.withColumns({"host": host(), "path": path()})
    rule, verdict = listed(rules)
    df = df.withColumns({"rule": rule, "listed": verdict})
    if labels is None:
        return df.select("page_id", "host", "path", "rule", F.coalesce("listed", F.lit("allow")).alias("verdict"))
    marks = labels.select(F.col(id_col).alias("page_id"), "bad").where("page_id is not null").groupBy("page_id").agg(F.bool_or("bad").alias("bad"))
    mined = mine_rules(df.where("listed is null").join(marks, "page_id").withColumn("tokens", tokens()), min_support, min_confidence)
    urls = df.where("listed is null and host <> ''").select("url", "host", "path").distinct().withColumn("tokens", tokens())
    blocked = fired(urls, mined).withColumn("hit", F.lit(True))
    out = df.join(bounded(cut(blocked)), "url", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
