"""Periodic runs, ranked search and language identification: brute force, hard rows and empty tables; word hashes that can't be made to collide by repetition."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spikeframe.llm import language_id, line_dedup, ngram_join, packing, periodic_runs, queries, ranked_search, textvec, tokens
from spikeframe.llm.storage import Scratch

CLASHES = ("number", "rank", "score", "lang_pred", "n_runs", "start", "place", "kind", "term", "i", "t")


def brute_runs(x):
    """(start, period, end) of all runs, by comparing all words q apart for every q."""
    out = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q), q)
            i += 1
    return sorted((s, q, e) for (s, e), q in out.items())


def brute_row(doc_id, text):
    words = [w for w in re.split(r"[ \t-\r]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, q, e in runs for i in range(s + q, e)}
    best = min(((-Fraction(e - s, q), s, q, e) for s, q, e in runs), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[1], best[3] - best[1], best[2], 1000 * (best[3] - best[1]) // best[2]) if best else (None,) * 4
    return (len(runs), *top, digest("".join(f"{s},{e - s},{q}\n" for s, q, e in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def stretches(rng):
    """Rows of small numbers full of powers, powers of powers, Fibonacci words and broken periods."""
    n = int(rng.integers(0, 160))
    kind = rng.integers(5)
    if kind == 0:
        return rng.integers(0, int(rng.integers(1, 4)) + 1, n).tolist()
    if kind == 1:
        x = np.tile(rng.integers(0, 3, max(1, n // int(rng.integers(2, 10)))), 9)[: max(1, n)]
        x[rng.integers(len(x))] = 9 if rng.integers(2) else x[0]
        return x.tolist()
    if kind == 2:
        a, b = [0], [1, 0]
        while len(b) <= n:
            a, b = b, b + a
        return b[:n]
    if kind == 3:
        return ([*[0] * int(rng.integers(1, 30)), 1, *[0] * int(rng.integers(0, 12))] * 6)[: n + 40]
    u = rng.integers(0, 2, int(rng.integers(1, 4))).tolist() * int(rng.integers(2, 12))
    return rng.integers(0, 3, 5).tolist() + (u + rng.integers(0, 3, int(rng.integers(1, 6))).tolist()) * 5


def test_runs_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(400):
        texts = [stretches(rng) for _ in range(int(rng.integers(1, 4)))]
        first = np.cumsum([0, *map(len, texts)])
        got = periodic_runs.find_runs(np.array(sum(texts, []), np.uint64), first)
        assert [(s, q, e) for s, e, q in got.tolist()] == [(s + f, q, e + f) for f, t in zip(first, texts, strict=False) for s, q, e in brute_runs(t)]


def test_a_wavelet_tree_counts_and_finds():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 8, 9, 100, 1000):
        values = rng.permutation(n)
        tree = periodic_runs.WaveletTree(values)
        lo = rng.integers(0, n, 50)
        hi = np.minimum(n, lo + rng.integers(1, n + 1, 50))
        bound, nth = rng.integers(0, 2 * n + 2, 50), rng.integers(0, hi - lo)
        assert tree.below(lo, hi, bound).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(lo, hi, bound, strict=True)]
        assert tree.nth(lo, hi, nth).tolist() == [int(np.sort(values[a:b])[k]) for a, b, k in zip(lo, hi, nth, strict=True)]


def test_run_digests_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in stretches(rng)) for _ in range(60)] + [None, "", " \n\t ", "a a a a a", "b\n\nb b\tb b b", "é é é é é é é", "x" * 5000 + " y" * 50]
    rows = list(enumerate(texts)) + [(None, "a a a a a a"), (3, "same id"), (3, "same id")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_runs int, `Start` string")
    out = periodic_runs.run_digests(docs, F.crc32(F.col("doc_id").cast("string")))
    got = [tuple(r) for r in out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    assert sorted(map(str, got)) == sorted(str((i, *brute_row(i, t))) for i, t in rows)
    assert any(r[1] for r in got) and periodic_runs.run_digests(docs.where("false")).count() == 0


def test_collapsed_texts_keep_one_period(spark):
    docs = spark.createDataFrame([(1, "so no no no no no no it is"), (2, "nothing  here\nrepeats"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in periodic_runs.collapse_runs(docs).collect()}
    assert got == {1: "so no it is", 2: "nothing  here\nrepeats", 3: None}


def brute_search(docs, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    rows = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(w for _, c in rows for w in c)
    merged = {}
    for i, t in items:
        merged.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in merged.items():
        found = []
        for i, c in rows:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in wanted if c[w])
            found += [(-score, i is None, i, score)] if score > 0 else []
        out += [(item, rank, i, score) for rank, (_, _, i, score) in enumerate(sorted(found, key=lambda r: (r[0], r[1], r[2] or 0))[:top], 1)]
    return out


def search_case(rng):
    words = [chr(97 + i) * (1 + i % 3) for i in range(26)] + ["É", "ß9", "x_y"]
    text = lambda n: " ".join(rng.choice(words, n).tolist()).title()
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(150)] + [(7, text(9)), (None, text(30)), (None, text(30)), (200, None), (201, ""), (202, "!? ..")] + [(300 + i, "Same words in all") for i in range(70)]
    shared = text(8)
    items = [(i, f"{shared if i % 2 else ''} {text(int(rng.integers(1, 12)))}") for i in range(30)] + [(40, None), (41, ""), (42, "?"), (None, "same words"), (5, "zz other rows of an item"), (43, "nowhere found")]
    return docs, items


@pytest.mark.parametrize(("held", "cells", "shard"), [(1 << 18, 1 << 21, 2000), (60, 500, 7)])
def test_search_equals_brute_force(spark, monkeypatch, held, cells, shard):
    for name, value in (("HELD", held), ("CELLS", cells), ("SHARD_ITEMS", shard)):
        monkeypatch.setattr(ranked_search, name, value)
    docs, items = search_case(np.random.default_rng(4))
    table = spark.createDataFrame([(i, t, *["v"] * len(CLASHES)) for i, t in docs], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)).repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in ranked_search.search(table, bench, 20).collect()]
    assert sorted(got, key=str) == sorted(brute_search(docs, items, 20), key=str)
    assert ranked_search.search(table.where("false"), bench).count() == 0 == ranked_search.search(table, bench.where("false")).count()


def test_shared_sets_rebuild_their_items():
    rng = np.random.default_rng(5)
    items = [sorted(set(rng.integers(0, 40, int(rng.integers(0, 25))).tolist()) | ({1, 2, 3, 4} if i % 2 else set())) for i in range(60)]
    pairs, left = ranked_search.shared_sets(items, 40)
    whole = [{i} for i in range(40)]
    for a, b in pairs:
        assert not whole[a] & whole[b]
        whole.append(whole[a] | whole[b])
    for item, symbols in zip(items, left, strict=True):
        assert sorted(x for s in symbols for x in whole[s]) == item
    assert len(pairs) + sum(map(len, left)) < 0.8 * sum(map(len, items))
    again = Counter((a, b) for x in left for k, a in enumerate(x) for b in x[k + 1 :])
    assert max(again.values(), default=0) < 2


def brute_grams(text):
    pads = [f" {w} " for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
    return Counter(g for p in pads for n in (1, 2, 3) for i in range(len(p) - n + 1) if (g := p[i : i + n]) != " ")


@pytest.mark.parametrize("shard", [500, 1])
def test_languages_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(language_id, "SHARD", shard)
    rng = np.random.default_rng(6)
    voices = {"aa": "abcab", "bb": "bcdÉ", "cc": "xyzab"}
    rows = [(i, None if i % 11 == 0 else " ".join("".join(rng.choice(list(voices[v]), int(rng.integers(1, 6)))) for _ in range(int(rng.integers(0, 15)))), v if i % 5 else None) for i, v in enumerate(rng.choice(list(voices), 90).tolist())]
    rows += [(500, "123 !?", "aa"), (501, "", "bb"), (502, "日本", None), (3, "Ab, ab", "aa"), (3, "Ab, ab", "aa"), (None, "xyz", None)]
    docs = spark.createDataFrame([(*r, "v", "v") for r in rows], "doc_id long, text string, lang string, lang_pred string, `Score` string")
    k = 12
    counts = {}
    for i, t, v in rows:
        if v and i is not None and i % 2:
            counts.setdefault(v, Counter()).update(brute_grams(t))
    profile = {v: {g: at for at, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k])} for v, c in counts.items()}
    want = []
    for i, t, _ in rows:
        own = [g for g, _ in sorted(brute_grams(t).items(), key=lambda x: (-x[1], x[0]))[:k]]
        off = sorted((sum(abs(at - p[g]) if g in p else k for at, g in enumerate(own)), v) for v, p in profile.items())
        want.append((i, off[0][1], off[1][0] / (off[0][0] + off[1][0]) if off[0][0] + off[1][0] else 0.5) if own else (i, "und", 0.0))
    got = [tuple(r) for r in language_id.predict_language(docs, F.col("doc_id") % 2 == 1, k).select("doc_id", "lang_pred", "score").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert language_id.predict_language(docs.where("false"), F.lit(True)).count() == 0
    assert {r.lang_pred for r in language_id.predict_language(docs, F.lit(False)).collect()} == {"und"}


def test_held_out_languages(spark):
    out = queries.op13_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id")
    right, rows = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert rows > 200 and right >= 0.99 * rows


def morse(n, a, b):
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_of_one_structure_are_told_apart():
    """Thue-Morse words and their complements, for which polynomial hashes modulo a power of two are equal."""
    from tokenizers import Tokenizer

    texts = [f"x th{w}ing" for n in (64, 128, 1024, 4096) for letters in (("i", "t"), ("s", "o")) for w in morse(n, *letters)]
    for step in textvec.text_steps(pa.array(texts)):
        words = textvec.split_words(*step[2:], textvec.ALNUM)
        assert len(np.unique(words.hash)) == len(texts) + 1
        for name, lengths in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
            path = queries.tokenizer(name)
            want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
            counts, ids = tokens.UnitEncoder(path, lengths).encode(*step[2:])
            assert counts.tolist() == list(map(len, want))
            assert lengths or ids.tolist() == sum(want, [])


def test_units_of_one_hash_are_not_taken_for_each_other(monkeypatch):
    from tokenizers import Tokenizer

    real = textvec.span_hashes
    monkeypatch.setattr(textvec, "span_hashes", lambda *a: (real(*a)[0] % np.uint64(5), real(*a)[1]))
    path = queries.tokenizer("word_bpe_49k.json")
    encoder, whole = tokens.UnitEncoder(path, False), Tokenizer.from_file(path)
    for texts in (["one two three four", "five six one", "", "two"], ["seven two eight", "one"]):
        for step in textvec.text_steps(pa.array(texts)):
            counts, ids = encoder.encode(*step[2:])
            want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
            assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def dropped(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id: r.dropped or [] for r in line_dedup.dedup_lines(docs).collect()}


def word(rng):
    return "".join(map(chr, rng.integers(97, 123, 7)))


def test_templates_with_the_same_leading_words_are_all_found(spark):
    rng = np.random.default_rng(7)
    shapes = ["server reports that user opened {} session from {} today", "server reports that user deleted {} files under {} yesterday", "server reports that user printed {} pages with {} tonight"]
    texts = ["\n".join([*(s.format(word(rng), word(rng)) for s in shapes), " ".join(word(rng) for _ in range(9))]) for _ in range(12)]
    got = dropped(spark, texts)
    assert all(got[i] == [0, 1, 2] for i in range(12))


def test_recall_of_planted_templates_beside_one_another(spark):
    """Twenty templates of one length and one beginning in one crowd of unlike lines that begin alike."""
    rng = np.random.default_rng(8)
    plans = []
    for _ in range(20):
        body = [word(rng) for _ in range(11)]
        fields = rng.choice(np.arange(1, 11), 2, replace=False)
        plans.append((body, fields))
    texts, planted = [], []
    for i in range(48):
        lines, mine = [], set()
        for p in rng.choice(20, 6, replace=False):
            body = [word(rng) if j in plans[p][1] else w for j, w in enumerate(plans[p][0])]
            mine.add(len(lines))
            lines.append(" ".join(["we", "found", "that", *body]))
            lines.append(" ".join(["we", "found", "that", *(word(rng) for _ in range(11))]))
        planted.append(mine)
        texts.append("\n".join(lines))
    got = dropped(spark, texts)
    assert sum(len(planted[i] & set(got[i])) for i in got) >= 0.97 * sum(map(len, planted))
    assert not any(set(got[i]) - planted[i] for i in got)


def test_near_copies_are_one_class(spark):
    rng = np.random.default_rng(9)
    texts, group = [], []
    for g in range(40):
        base = [word(rng) for _ in range(150)]
        for c in range(6):
            copy = list(base)
            for j in rng.choice(150, 3 if c else 0, replace=False):  # some 15 of 146 shingles change: Jaccard about 0.8 with the base
                copy[j] = word(rng)
            texts.append(" ".join(copy))
            group.append(g)
    order = rng.permutation(len(texts))
    texts, group = [texts[i] for i in order], [group[i] for i in order]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "text_key long, text string")
    found = {r.text_key: r.copies_of for r in line_dedup.copy_classes(table, Scratch(spark)).collect()}
    assert all(group[found[i]] == group[i] for i in found)
    sets = [{tuple(t.split()[j : j + 5]) for j in range(146)} for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if group[a] == group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 150 and sum(found.get(a, a) == found.get(b, b) for a, b in pairs) >= 0.9 * len(pairs)


def test_leaders_reach_every_node_of_a_crowded_group(spark):
    """In one group of 300 nodes of 60 kinds all nodes of a kind are joined."""
    nodes = spark.range(300).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("group"))
    scratch = Scratch(spark)
    links = line_dedup.led(nodes, lambda pairs: pairs.where("a % 60 = b % 60"), scratch)
    labels = {r.node: r.label for r in ngram_join.components(links, scratch).collect()}
    assert labels == {i: i % 60 for i in range(60, 300)}  # the least one has no row


def test_packing_finds_each_id_once_however_rows_are_dealt(spark):
    rng = np.random.default_rng(10)
    docs = spark.createDataFrame([(i, " ".join(word(rng) for _ in range(int(rng.integers(0, 900))))) for i in range(200)], "doc_id long, text string")
    path = queries.tokenizer("word_bpe_49k.json")
    runs = []
    for parts in (3, 7):
        p = packing.pack(docs.repartition(parts, F.rand(parts)), path).toPandas().sort_values(["doc_id", "start"])
        assert (p.groupby("doc_id").length.sum() == p.groupby("doc_id").doc_tokens.first()).all() and len(p.doc_id.unique()) == 200
        assert (p.groupby("doc_id").start.apply(lambda s: s.iloc[0]) == 0).all() and p.groupby("sequence_id").length.sum().max() <= 2048
        assert p.length.sum() / 2048 / p.sequence_id.nunique() > 0.97
        runs.append(p[["doc_id", "start", "length", "ids_crc32"]].reset_index(drop=True))
    assert runs[0].equals(runs[1])


def test_differencing_keeps_every_part():
    rng = np.random.default_rng(11)
    for k in (1, 2, 5, 40):
        sizes = rng.integers(1, 500, int(rng.integers(0, 90)))
        groups = packing.differencing(sizes, k)
        assert len(groups) == k and sorted(sum(groups, [])) == list(range(len(sizes)))
        sums = [int(sizes[g].sum()) for g in groups]
        assert k > 5 or len(sizes) < 40 or max(sums) - min(sums) <= 20
