"""URL filters on repeated URLs of many tokens, against all subsets by brute force, on hard rows and on empty tables."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeframe.llm import queries, url_filter

CLASHES = ("host", "path", "rule", "verdict", "listed", "tokens", "hit", "bad", "item", "n", "k")


def verdicts(out):
    return {r.page_id: r.verdict for r in out.collect()}


def labelled(spark, rows):
    """rows: (tokens, bad)."""
    return spark.createDataFrame([(sorted(t), b) for t, b in rows], "tokens array<string>, bad boolean")


def brute_rules(rows, need, confidence):
    good = {}
    names = sorted({x for t, _ in rows for x in t})
    for size in range(1, len(names) + 1):
        for s in itertools.combinations(names, size):
            hit = [b for t, b in rows if set(s) <= t]
            k, n = sum(hit), len(hit)
            if k >= need:
                p, z = k / n, url_filter.Z
                low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
                if p >= confidence and low >= confidence:
                    good[frozenset(s)] = k / n
    return {s: c for s, c in good.items() if not any(o < s for o in good)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mined_rules_equal_all_subsets(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(400):
        t = {x for x in "abcdef" if rng.random() < 0.45} | {"always"}
        t |= {"b2"} if "b" in t else set()  # in the same rows as b
        rows.append((t, bool(({"a", "c"} <= t or {"d", "e", "f"} <= t) ^ (rng.random() < 0.01))))
    found = url_filter.mine_rules(labelled(spark, rows), 0.002, 0.8).collect()
    got = {frozenset(c): r.confidence for r in found for c in itertools.product(*r.any_of)}
    want = brute_rules(rows, 20, 0.8)
    assert got.keys() == want.keys() and len(want) > 1 and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_copies_of_long_urls_are_mined_in_seconds(spark):
    segments = "/".join(f"s{chr(97 + i)}x" for i in range(27))
    spam, fine = f"http://a.spam.zz/{segments}", f"http://b.fine.zz/{segments.replace('x', 'y')}"
    rows = [(i, spam) for i in range(40)] + [(i, fine) for i in range(100, 140)] + [(i, f"http://u{i}.yy/p/{chr(97 + i % 26)}") for i in range(200, 400)] + [(900, spam), (901, fine), (902, "http://c.spam.zz/other"), (903, "http://new.yy/x")]
    noisy = [(i, f"http://n.noise.zz/{segments.replace('x', 'z')}") for i in range(500, 560)]
    pages = spark.createDataFrame(rows + noisy, "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 40 or 500 <= i < 530) for i, _ in rows + noisy if i < 900], "page_id long, bad boolean")
    began = time.time()
    got = verdicts(url_filter.judge_urls(pages, [], labels))
    assert time.time() - began < 60
    assert got[900] == "block" == got[902] and got[901] == "allow" == got[903]
    assert all(got[i] == "block" for i in range(40)) and all(v == "allow" for i, v in got.items() if 100 <= i < 600)


def test_hard_urls_and_empty_tables(spark):
    long = "http://example.com/en/7" + "/x" * 30000
    rows = [(1, None), (2, ""), (3, "no scheme/com"), (4, "HTTP://WWW.EXAMPLE.COM/en/7?q=1"), (4, "http://a.com/en/x"), (None, "http://b.net/de/1"), (5, "://x.org/es/"), (5, "://x.org/es/"), (6, "http://com/en/"), (7, long), (8, "http://notcom/en/"), (9, "http://sub.example.net/de/8#f"), (10, "http://ü.org/es/?a&b=://com/en/")]
    table = spark.createDataFrame([(*r, *["v"] * len(CLASHES)) for r in rows], "page_id long, url string, " + ", ".join(f"{c} string" for c in CLASHES))
    marks = spark.createDataFrame([(1, True), (None, True), (4, None), (5, False)], "page_id long, bad boolean")
    for labels in (marks, marks.where("false"), None):
        out = url_filter.judge_urls(table, queries.URL_RULES, labels)
        assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
        got = sorted((str(r.page_id), r.host, r.path[:12], str(r.rule), r.verdict) for r in out.collect())
        assert got == sorted([
            ("1", "", "", "None", "allow"), ("2", "", "", "None", "allow"), ("3", "", "", "None", "allow"), ("4", "www.example.com", "/en/7", "example.com/en/7", "allow"), ("4", "a.com", "/en/x", "com/en/", "block"),
            ("None", "b.net", "/de/1", "net/de/", "allow"), ("5", "x.org", "/es/", "org/es/", "block"), ("5", "x.org", "/es/", "org/es/", "block"), ("6", "com", "/en/", "com/en/", "block"), ("7", "example.com", "/en/7/x/x/x/", "example.com/en/7", "allow"),
            ("8", "notcom", "/en/", "None", "allow"), ("9", "sub.example.net", "/de/8", "example.net/de/8", "block"), ("10", "ü.org", "/es/", "org/es/", "block"),
        ])
        assert url_filter.judge_urls(table.where("false"), queries.URL_RULES, labels).count() == 0


def test_ties_and_repeated_rows_count_as_often_as_they_occur(spark):
    rows = [({"p:a"}, True)] * 20 + [({"p:b"}, True)] * 19 + [({"p:c", "p:d"}, True)] * 20 + [({"p:e"}, True)] * 20 + [({"p:e"}, False)] * 20 + [({"p:z"}, False)] * 20
    found = {tuple(r.rule) for r in url_filter.mine_rules(labelled(spark, rows)).collect()}
    assert found == {("p:a",), ("p:c",), ("p:d",)}
    assert url_filter.mine_rules(labelled(spark, rows).where("false")).count() == 0
    assert url_filter.mine_rules(labelled(spark, rows).withColumn("bad", F.lit(None).cast("boolean"))).count() == 0
