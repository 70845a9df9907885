import itertools
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeframe.llm import decontam, line_dedup, ngram_join, packing, quality_classifier, quality_rules, sharding, tokens, toxicity, url_filter
from spikeframe.llm.queries import URL_RULES, tokenizer

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (5, "Two words"), (None, "a b c d e"), (6, "x " * 30000), (7, "a  b <|endoftext|> Ünïcödé\n'S  ")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", None, 0, 1) for i, t in ODD], "doc_id long, text string, lang string, source string, size int, rank int")


def test_token_counts_equal_the_library(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = sorted((r.n_tokens, r.n_bytes) for r in tokens.count_tokens(odd, tokenizer("byte_bpe_50k.json"), 512).collect())
    assert got == sorted((len(t.encode(x or "", add_special_tokens=False).ids), len((x or "").encode())) for _, x in ODD)


def test_packing_holds_each_id_once(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    p = packing.pack(odd.where("doc_id <> 5"), tokenizer("word_bpe_49k.json")).toPandas()
    for i, x in ODD:
        if i and i != 5:
            ids, at = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], np.uint32), 0
            for r in p[p.doc_id == i].sort_values("start").itertuples():
                assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all()


def test_differencing_is_a_near_equal_partition():
    sizes = np.random.default_rng(1).integers(1, 500, 300)
    groups = packing.differencing(sizes, 40)
    assert sorted(i for g in groups for i in g) == list(range(300)) and len(groups) == 40
    sums = [sizes[g].sum() for g in groups]
    assert max(sums) - min(sums) <= 20
    assert all(sizes[g].sum() <= 700 for g in packing.windows(sizes, 700))


def test_ngram_components_equal_brute_force(spark):
    rng, rows = np.random.default_rng(3), []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, 60)]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.integers(0, 4)):
                words[rng.integers(60)] = f"v{rng.integers(99)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "a b"), (903, "A B")], "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(58)} for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(docs, 3, 90, 100).collect()}
    assert got == label | {900: 900, 901: 901, 902: 902, 903: 902}


def test_the_pipeline_keeps_one_row_of_each_near_copy_group(spark):
    import corpus_pipeline

    words = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(1, words(1)), (1, words(1)), (1, words(1) + " end"), (2, words(2)), (2, words(1)), (None, words(3)), (None, words(3)), (None, words(2)), (7, words(3)), (8, words(4)), (8, words(4)), (9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    texts = [t for i, t in got if i == 1]
    assert len(got) == 6 and len(texts) == 1 and texts[0].startswith(words(1))
    assert {x for x in got if x[0] != 1} == {(2, words(2)), (7, words(3)), (8, words(4)), (9, None), (10, "")}


def test_wand_equals_brute_force():
    """BM25 of every item from its words alone, for all queries at once."""
    rng = np.random.default_rng(5)
    items = {i: [f"t{x}" for x in rng.zipf(1.4, 25) % 60] for i in range(120)}
    index = decontam.Index.build([(i, " ".join(w)) for i, w in items.items()])
    number = {w: int(np.searchsorted(index.terms, decontam._one(w).hash[0])) for ws in items.values() for w in ws}
    df = {w: sum(w in ws for ws in items.values()) for w in number}

    def gain(w, ws):
        tf, idf = ws.count(w), np.log1p((120 - df[w] + 0.5) / (df[w] + 0.5))
        return idf * tf * (decontam.K1 + 1) / (tf + decontam.K1)

    queries = [sorted(set(rng.choice(sorted(number), 12))) for _ in range(60)]
    want = {}
    for q, terms in enumerate(queries):
        for i, ws in items.items():
            score = sum(gain(w, ws) for w in terms if w in ws) / sum(gain(w, ws) for w in set(ws))
            if score >= 0.3:
                want[q, i] = score
    passage = np.repeat(np.arange(60), [len(q) for q in queries])
    got = index.wand(passage, np.array([number[w] for q in queries for w in q]), 0.3)
    found = {(int(q), index.items[i]): s for q, i, s in zip(*got, strict=True)}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    assert not len(index.wand(passage[:0], passage[:0], 0.3)[0])


def test_leaks(spark, odd):
    item = "What is the seventh moon of the far planet called by them? It is called the small grey one by all."
    bench = spark.createDataFrame([(1, item), (2, None), (3, "hm")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "filler " * 90 + item + " more" * 50), (2, "filler words only"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()] == [(1, 1)]
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, bench).collect()) == [2, 3]
    assert decontam.find_leaks(odd, bench).count() == 0


def test_scores_do_not_depend_on_the_number_of_shards(spark, monkeypatch):
    words = lambda i: " ".join(f"common{j % 3} w{i % 5}x{j} v{i}x{j}" for j in range(10 + i))
    items = spark.createDataFrame([(i, words(i)) for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(words(i).split()[2:])) for i in range(12)], "doc_id long, text string")
    find = lambda: sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in decontam.find_leaks(docs, items).collect())
    one = find()
    monkeypatch.setattr(decontam, "SHARD_ITEMS", 4)
    assert len(one) >= 12 and find() == one


def test_recurring_lines_go_and_copies_stay(spark):
    line = "Copyright holder {} of this very page keeps all of the rights"
    words = lambda i: " ".join(f"u{i}x{j}" for j in range(12))
    rows = [(i, words(i) + "\n" + line.format(2000 + i) + "\nend " + words(i + 50)) for i in range(8)]
    copy = "\n".join(f"alpha beta gamma delta row {w}" for w in ("a", "b", "c"))
    rows += [(100 + i, copy) for i in range(9)] + [(200, None), (201, "")]
    got = {r.doc_id: (r.dropped, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i][0] == [1] and "Copyright" not in got[i][1] for i in range(8))
    assert all(got[100 + i] == (None, copy) for i in range(9)) and got[200][1] is None and got[201][1] == ""


def test_copies_repeats_and_passages_hide_no_template(spark):
    line = "All rights to this very page stay with its holder"
    words = lambda i, n=12: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(n))
    rows = [(i, f"{words(i)}\n{line}\n{words(i + 300)}") for i in range(8)]
    rows += [(1000 + i, rows[0][1] + f" x{i}") for i in range(100)]  # a hot group of near copies
    rows += [(2000 + i, f"{words(100 + i)}\n" + "Here is a note that comes back often\n" * (100 if i == 0 else 1)) for i in range(5)]
    passage = "\n".join(words(200 + i) for i in range(4))  # most of each of four unrelated documents
    rows += [(3000 + i, f"{words(210 + i, 24)}\n{passage}\n{words(220 + i, 24)}") for i in range(4)]
    rows += [(4000 + i, f"{words(230, 24)} {words(231, 24)}\n{words(232, 24)} {words(233, 24)}\nlast y{i}") for i in range(6)]
    got = {r.doc_id: r.dropped for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(1 in (got[i] or []) for i, text in rows if line in text)
    assert all((got[2000 + i] or [])[:1] == [1] for i in range(5)) and len(got[2000]) == 100
    assert all(got[3000 + i] == [1, 2, 3, 4] for i in range(4))
    assert all(got[4000 + i] is None for i in range(6))


def test_a_name_near_the_front_is_variable_in_a_large_leaf_too(spark):
    name = lambda i: "".join(chr(97 + i // 26**j % 26) for j in range(4))
    docs = spark.createDataFrame([(i, f"This notice of {name(i)} was filed with the clerks of our court") for i in range(5000)], "doc_id long, text string")
    assert line_dedup.dedup_lines(docs).where("dropped = array(0)").count() == 5000


def test_toxicity_learns_and_restores(spark):
    rng = np.random.default_rng(2)
    plain = lambda: [f"wo{'abcdefgh'[x]}{'klmnop'[y]}" for x, y in zip(rng.integers(0, 8, 30), rng.integers(0, 6, 30), strict=True)]
    rows, marks = [], []
    for i in range(200):
        words = plain()
        if i % 4 == 0:
            for _ in range(3):
                words[rng.integers(30)] = "grumble"
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(i % 4 == 0)))
    rows += [(500, " ".join([*plain(), "gr(mble", "grumbl3"])), (501, " ".join(plain())), (502, None), (503, " ".join([*plain(), "g.r.u.m.b.l.e"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, scorer).collect()}
    assert got[0] == 1 and got[1] == 0 and got[500] == 1 and got[501] == 0 and got[502] == 0 and got[503] == 1


def test_each_disguise_passes_the_gate_and_enters_the_lattice():
    forms = ["s. t. u. p. i. d", "g r u m", "s.h.1.t", "$tupid", "!diot", "@sshole", "clas$", "stup1d", "stuuupid", "ÄÄÄrger", "é. t. é", "7ool"]
    for form in forms:
        raw = [x.encode() for x in ("plain words here.", form, f"so {form} it is", "a word of I and more")]
        offsets = np.cumsum([0, *map(len, raw)])
        odd, spaced = toxicity.marks(np.frombuffer(b"".join(raw), np.uint8), offsets)
        got = [bool(odd[a:b].any() or x) for a, b, x in zip(offsets[:-1], offsets[1:], spaced, strict=True)]
        assert got == [False, True, True, False], form
        assert toxicity._SPACED.search(form.lower()) or toxicity._ODD.search(form.lower()), form
    counts = np.zeros(toxicity._SYMBOLS**3)
    s = toxicity._SYM[np.frombuffer(b" stupid class idiot" * 99, np.uint8)]
    np.add.at(counts, (s[:-2] * toxicity._SYMBOLS + s[1:-1]) * toxicity._SYMBOLS + s[2:], 1)
    model = toxicity.CharModel(counts)
    assert [model.tokens(x) for x in ("a $tupid one", "the clas$ is", "an !diot")] == ["stupid", "class", "idiot"] and model.spans("s. t. u. p. i. d") == "stupid"


def test_an_unbroken_run_is_read_in_seconds():
    model = toxicity.CharModel(np.ones(toxicity._SYMBOLS**3))
    scorer = toxicity.Scorer(model, np.array([5], np.uint64), np.array([0.9]))
    rng, began = np.random.default_rng(2), time.time()
    for letters in ("a", "ab1!", "!", "abcdefghij0123456789+/"):
        raw = "".join(rng.choice(list(letters), 100_000)).encode()
        assert len(scorer.scores(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))) == 1
    assert time.time() - began < 40


def test_viterbi_finds_the_likeliest_of_all_readings():
    rng = np.random.default_rng(6)
    model = toxicity.CharModel(rng.integers(0, 50, toxicity._SYMBOLS**3).astype(float))
    end = toxicity._SYMBOLS - 1

    def price(span, picks):
        total, a, b = 0.0, end, end
        for cost, text in picks:
            total += cost
            for byte in text.encode():
                s = int(toxicity._SYM[byte])
                total, a, b = total + float(model.cost[a, b, s]), b, s
        return total + float(model.cost[a, b, end])

    for span in ("st1p", "a55e", "gooo", "b4$$", "1|l0", "noon"):
        options = []
        for i, c in enumerate(span):
            here = [(0.0 if c.isalpha() else 1.5, c), *((0.7, x) for x in toxicity.SWAPS.get(c, ""))]
            if i and c == span[i - 1]:
                here.append((0.4 if (i > 1 and c == span[i - 2]) or span[i + 1 : i + 2] == c else 2.0, ""))
            options.append(here)
        best = min(itertools.product(*options), key=lambda picks: price(span, picks))
        assert model.decode(span) == "".join(x for _, x in best), span


def test_quality(spark, odd):
    good = "These are quite plain words about many different things of the day"
    rows = [(i, f"{good} {i}" if i % 3 else "BUY!! %%% NOW!! ***" * 5) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in quality_classifier.score_quality(docs, marks).collect()}
    assert all(got[i] == int(i % 3 > 0) for i in range(90))
    assert quality_classifier.score_quality(odd, marks.where("false"), steps=2).count() == len(ODD)


def test_base_rules(odd):
    rows = {r.doc_id: r for r in quality_rules.quality_filter(odd).collect()}
    assert rows[6].n_words == 30000 and rows[6].n_repeat_words == 30000 and rows[6].base_failed and not rows[6].kept
    assert rows[1].n_words == 0 and rows[1].base_failed and rows[7].n_symbols == 4 and rows[7].word_chars == 24


def test_shards(spark, odd):
    p = sharding.hilbert_shards(odd, 4).toPandas()
    sizes = p.groupby("shard").slot.agg(["size", "max", "nunique"])
    assert len(p) == len(ODD) and sizes["size"].max() - sizes["size"].min() <= 1 and (sizes["max"] == sizes["size"] - 1).all()
    grid = sharding.hilbert_index(spark.range(64).selectExpr("id % 8 AS a", "id div 8 AS b"), ["a", "b"], 3, "h").toPandas().sort_values("h")
    steps = grid[["a", "b"]].diff().abs().sum(axis=1).iloc[1:]
    assert grid.h.tolist() == list(range(64)) and (steps == 1).all()


def test_urls(spark):
    urls = [None, "no scheme", "http://Example.COM/en/7x?q=1", "https://a.com/en/1", "http://x.net/de/8", "http://b.example.net/de/81#f", "ftp://org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge_urls(pages, URL_RULES).collect()}
    assert got[0] == got[1] == ("", None, "allow") and got[2] == ("example.com", "example.com/en/7", "allow")
    assert got[3][1:] == ("com/en/", "block") and got[4][1:] == ("net/de/", "allow") and got[5][1:] == ("example.net/de/8", "block") and got[6][1:] == ("org/es/", "block")
    bad = [(i, f"http://spam{i % 3}.zz/offer/{i}") for i in range(40)] + [(100 + i, f"http://fine{i % 5}.zz/news/{i}") for i in range(60)]
    df = spark.createDataFrame(bad, "page_id long, url string")
    marks = df.select("page_id", (F.col("page_id") < 100).alias("bad")).where("page_id % 2 = 0")
    out = url_filter.judge_urls(df, [], marks, min_support=0.05).toPandas()
    assert (out.verdict == np.where(out.page_id < 100, "block", "allow")).all()
