"""Queries against their SQL, operators against brute force on small input, and the cases that every operator must stand."""

from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spikeframe.llm import decontam, line_dedup, ngram_join, packing, quality_classifier, quality_rules, queries, sharding, tokens, toxicity, url_filter
from spikeframe.llm.storage import Scratch

SF = "/root/testdata/sf0.01"
#: Names that operators use inside or return, as further columns of their input.
CLASHES = ("row", "text_key", "row_key", "dropped", "n", "key", "score", "predicted", "label", "shard", "size", "template", "component", "block", "salt", "rank")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    plain = lambda names, found: sorted((tuple(r[names.index(c)] for c in order) for r in found), key=str)
    assert plain(df.columns, df.collect()) == plain(want.columns, want.fetchall())


def copies(rng, groups, size, words, changes):
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 5000, words)]
        for _ in range(size):
            line = list(base)
            for _ in range(rng.integers(0, changes)):
                line[rng.integers(words)] = f"v{rng.integers(9999)}"
            yield " ".join(line)


def brute_components(texts, k, num, den):
    sets = [{tuple(t.split()[j : j + k]) for j in range(max(1, len(t.split()) - k + 1))} if t.split() else set() for t in texts]
    label = list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize(("k", "num", "changes", "tile"), [(3, 90, 9, 2048), (3, 90, 9, 16), (5, 80, 14, 16)])
def test_join_equals_brute_force_in_one_tile_and_in_many(spark, monkeypatch, k, num, changes, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rng = np.random.default_rng(11)
    texts = [*copies(rng, 3, 60, 120, changes), *copies(rng, 2, 30, 700, 5 * changes), *copies(rng, 10, 2, 40, 3), "", "a b", "A  b", "same three words", "same three words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(docs, k, num, 100).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components([t.lower() for t in texts], k, num, 100)


def test_a_hot_shared_line_links_nothing(spark):
    rng = np.random.default_rng(4)
    line = "this very common line stands in each of the many documents here"
    texts = [f"{line} " + " ".join(f"w{x}" for x in rng.integers(0, 9**6, 30)) for _ in range(300)] + [line] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(docs, 3, 90, 100).collect()}
    assert all(got[i] == (i if i < 300 else 300) for i in got)


def prose(rng, n):
    return "\n".join(" ".join(f"w{x}" for x in map(str, map(chr, rng.integers(97, 123, 8) + 0))) + " " + " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(9)) for _ in range(n))


def dropped(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.dropped or [], r.text) for r in line_dedup.dedup_lines(docs).collect()}


def test_a_shared_line_goes_however_often_one_document_repeats_it(spark):
    rng = np.random.default_rng(1)
    line = "all rights to this page are kept by its owner"
    texts = [f"{prose(rng, 4)}\n{line}\n{prose(rng, 3)}" for _ in range(40)] + ["\n".join([line] * 1000)]
    got = dropped(spark, texts)
    assert all(got[i][0] == [4] for i in range(40)) and got[40][0] == list(range(1000))


def test_copies_keep_their_lines_and_hide_no_template(spark):
    rng = np.random.default_rng(2)
    line, own = "please subscribe to our letter for more news like this", prose(rng, 8)
    near = [own.replace(own.split()[i * 5 + 3], "changed", 1) for i in range(12)]
    texts = [own] * 30 + near + [f"{prose(rng, 6)}\n{line}" for _ in range(6)] + [f"{own}\n{line}"] * 500
    got = dropped(spark, texts)
    assert all(got[i][0] == [] for i in range(42)) and all(got[i][0] == [6] for i in range(42, 48)) and all(got[i][0] == [8] for i in range(48, 548))


def test_log_lines_are_templates(spark):
    rng = np.random.default_rng(3)
    user = lambda: "".join(map(chr, rng.integers(97, 123, 7)))
    log = lambda: f"2024-01-{rng.integers(10, 28)} 10:{rng.integers(10, 59)}:01 INFO session {rng.integers(999)} opened for user {user()} from port {rng.integers(9999)} by gate"
    texts = ["\n".join([prose(rng, 2), *(log() for _ in range(3)), f"12 {rng.integers(99)} 7 {rng.integers(99)} 3"]) for _ in range(8)]
    got = dropped(spark, texts)
    assert all(got[i][0] == [2, 3, 4] for i in range(8))


def test_line_templates_equal_brute_force(spark):
    """Without near copies and generalising, a line goes when four documents hold its form."""
    rng = np.random.default_rng(5)
    pool = [" ".join("".join(map(chr, rng.integers(97, 123, 5))) for _ in range(int(n))) for n in rng.integers(2, 8, 60)]
    texts = ["\n".join([*(pool[i] for i in rng.integers(0, 60, 3)), prose(rng, 12)]) for _ in range(80)]
    got = dropped(spark, texts)
    held = {line: sum(line in t.split("\n") for t in texts) for line in pool}
    for i, t in enumerate(texts):
        assert got[i][0] == [j for j, line in enumerate(t.split("\n")) if len(line.split()) >= 4 and held.get(line, 0) >= 4], i


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(map(chr, rng.integers(97, 105, 3)))
    items = [(i, " ".join(word() for _ in range(int(rng.integers(12, 40)))) + ". " + " ".join(word() for _ in range(8)) + ".") for i in range(50)] + [(90, "two words"), (91, None), (92, "")]
    docs = [(i, " ".join(word() for _ in range(60)) + " " + (items[i % 50][1] if i % 3 else " ".join(items[i % 50][1].split()[:9])) + " " + " ".join(word() for _ in range(50))) for i in range(60)] + [(99, "so two words it is"), (100, None), (101, "")]
    bench, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in decontam.find_leaks(table, bench).collect()}
    index = decontam.Index.build(sorted((i, t) for i, t in items if t))
    tokens_of = lambda t: [w.strip(".").lower() for w in t.split()]
    texts = {i: tokens_of(t) for i, t in items if t}
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    df = {w: sum(w in t for t in texts.values()) for t in texts.values() for w in t}

    def gain(w, t):
        tf = t.count(w)
        return np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))

    grams = lambda t, k: {tuple(t[j : j + k]) for j in range(len(t) - k + 1)}
    want = {}
    for d, text in docs:
        t = tokens_of(text or "")
        step = index.window // 2
        for at in range(0, max(1, len(t) - index.window + step), step):
            here = set(t[at : at + index.window])
            for i, item in texts.items():
                score = sum(gain(w, item) for w in set(item) & here) / sum(gain(w, item) for w in set(item))
                if score >= decontam.THRESHOLD:
                    want[d, i] = max(score, want.get((d, i), 0))
    for d, i in list(want):
        item, t, k = texts[i], tokens_of(dict(docs)[d]), min(3, len(texts[i]))
        half = len(item) - 8 if len(item) >= 6 else len(item)
        q, r = (grams(part, k) for part in ((item[:half], item[half:]) if len(item) >= 6 else (item, item)))
        both = grams(t, k)
        if len(q & both) < 0.6 * len(q) or len(r & both) < 0.6 * len(r):
            del want[d, i]
    assert got.keys() == want.keys() and (99, 90) in got and len(got) >= 40
    assert all(abs(got[x][0] - want[x]) < 1e-9 for x in want)


def test_risk_and_gradient_of_the_classifier():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, quality_classifier.FEATURES)).astype(np.float32)
    positive = rng.integers(0, 2, 50).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array([50]), pa.array([positive.tobytes()]), pa.array([x.tobytes()])], ["n", "positive", "x"])
    width = quality_classifier.FEATURES
    sums = lambda w: next(quality_classifier._sums(w)([batch])).column(0).to_numpy()
    loss = lambda s: s[4 * width + 2 : 4 * width + 5]
    w = rng.normal(size=width) / 10
    s, z = sums(w), x.astype(float) @ w
    assert np.allclose(loss(s), [(positive * np.log1p(np.exp(-z))).sum(), (positive * np.log1p(np.exp(z))).sum(), np.log1p(np.exp(z)).sum()])
    for j in (0, 7, width - 1):
        e = np.zeros(width)
        e[j] = 1e-5
        slope = (loss(sums(w + e)) - loss(sums(w - e))) / 2e-5
        assert np.allclose(slope, [s[j], s[width + j], s[2 * width + j]], rtol=1e-4, atol=1e-6)


def test_the_prior_comes_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(9)
    for share in (0.2, 0.5, 0.85):
        at = lambda mean, n: np.clip(rng.normal(mean, 90, n), 0, 999).astype(int)
        positive, negative = at(750, int(20000 * share)), at(250, int(20000 * (1 - share)))
        n = np.bincount(np.concatenate([positive, negative]), minlength=1000)
        assert abs(quality_classifier.best_bin(n, np.bincount(at(750, 3000), minlength=1000)) - share) < 0.05
    assert quality_classifier.best_bin(np.zeros(1000), np.zeros(1000)) == 0.5


def test_base_columns_equal_brute_force(spark):
    rng = np.random.default_rng(10)
    texts = [" ".join(rng.choice(["a", "b#", "cc", "d$", "e\n", "f\n\n", "\t", "ü|"], int(rng.integers(0, 90)))) for _ in range(120)] + [None, "", "\n\n", "x x x x x"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.quality_filter(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = [w for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w]
        windows = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        repeat = len({j + k for j, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})
        lines = [x for x in t.split("\n") if x.strip()]
        base = len(words) < 50 or 100 * repeat > 50 * len(words)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].base_failed) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, base), i
        assert not (base and got[i].kept)


def test_mined_rules_are_counted_and_keep_clean_held_out_urls(spark):
    rng = np.random.default_rng(12)
    rows = [(i, f"http://{'spam' if i % 4 == 0 else 'fine'}{rng.integers(5)}.zz/{'offer' if i % 4 == 0 else 'news'}/{i}/{'x' if i % 7 else 'y'}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    marks = pages.select("page_id", (F.col("page_id") % 4 == 0).alias("bad")).where("page_id % 2 = 0")
    df = pages.withColumns({"host": url_filter.host(), "path": url_filter.path()}).withColumn("tokens", url_filter.tokens()).join(marks, "page_id")
    rules = url_filter.mine_rules(df).collect()
    table = [(set(r.tokens), r.bad) for r in df.collect()]
    assert rules
    for r in rules:
        hit = [bad for t, bad in table if set(r.rule) <= t]
        assert sum(hit) >= url_filter.LEAST_ROWS and abs(sum(hit) / len(hit) - r.confidence) < 1e-9
    out = url_filter.judge_urls(pages, [], marks).where("page_id % 2 = 1").groupBy("verdict").count().collect()
    assert {r.verdict for r in out} == {"allow"}
    noise = marks.withColumn("bad", F.xxhash64("page_id") % 2 == 0)
    assert url_filter.judge_urls(pages, [], noise).where("verdict = 'block'").count() == 0


def operators(spark):
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "what is the name of the small grey moon of the far planet? it is called the little one by all of them"), (None, "x y z"), (3, None)], "item_id long, text string")
    path = queries.tokenizer("word_bpe_49k.json")
    return {
        "op1": lambda d: quality_rules.quality_filter(d),
        "op2": lambda d: quality_classifier.score_quality(d, labels, steps=2),
        "op3": lambda d: packing.pack(d, path),
        "op4": lambda d: ngram_join.similar_components(d, 3, 90, 100),
        "op5": lambda d: decontam.find_leaks(d, bench),
        "op6": lambda d: tokens.count_tokens(d, queries.tokenizer("byte_bpe_50k.json"), 512),
        "op7": lambda d: line_dedup.dedup_lines(d),
        "op8": lambda d: toxicity.score_toxicity(d, toxicity.train(d, labels)),
        "op9": lambda d: sharding.hilbert_shards(d),
        "toxicity": lambda d: toxicity.drop_toxic(d, toxicity.train(d, labels)),
        "line_dedup": lambda d: corpus_pipeline.drop_lines(spark, d, SF),
        "ngram_jaccard_join": lambda d: corpus_pipeline.drop_near_duplicates(spark, d, SF),
        "decontamination": lambda d: decontam.decontaminate(d, bench),
    }


ROWS_OUT = {"op1": 16, "op2": 16, "op4": 16, "op6": 16, "op7": 16, "op8": 16, "op9": 16, "toxicity": 16, "line_dedup": 16, "ngram_jaccard_join": 12, "decontamination": 15, "op5": 1}


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and further columns with clashing names."""
    long = " ".join(f"w{i * 7919 % 30011}" for i in range(60000))
    moon = "Filler words. What is the name of the small grey moon of the far planet? It is called the little one by all of them. More filler"
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (5, "Two words"), (6, "two words"), (None, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, long), (8, long + " end"), (9, moon), (10, "<|endoftext|> Ünïcödé\n'S  "), (11, "x" * 50000), (11, "other text under the same id")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 2 else "web", None, *(["v"] * len(CLASHES))) for k, (i, t) in enumerate(texts)], schema).cache()


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "toxicity", "line_dedup", "ngram_jaccard_join", "decontamination"])
def test_hard_rows_and_empty_tables(spark, hard, name):
    run = operators(spark)[name]
    out = run(hard)
    found = out.toPandas()
    if name in ROWS_OUT:
        assert len(found) == ROWS_OUT[name]
    if name not in ("op1", "op2", "op3", "op4", "op5", "op6", "op8", "op9"):
        assert set(hard.columns) <= set(out.columns)
    assert run(hard.where("false")).count() == 0


def test_the_pipeline_on_hard_rows_and_empty_tables(spark, hard, tmp_path):
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "what is the name of the small grey moon of the far planet? it is called the little one by all of them")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs, kept in ((hard, 11), (hard.where("false"), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = Scratch(spark).keep(stage(spark, docs, str(tmp_path)))
            assert docs.columns == hard.columns, name
        assert docs.count() == kept
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
        assert pieces.empty or pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_repeated_rows_and_ties_are_packed_and_sharded_whole(spark):
    docs = spark.createDataFrame([(None if i % 3 else 7, "the same words again and again") for i in range(1500)], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'web' AS source")
    p = packing.pack(docs, queries.tokenizer("word_bpe_49k.json")).toPandas()
    assert len(p) == 1500 and p.groupby("sequence_id").length.sum().max() <= 2048 and p.sequence_id.nunique() <= 1.2 * p.length.sum() / 2048 + 3
    s = sharding.hilbert_shards(docs, 8).toPandas().groupby("shard").slot.agg(["size", "max", "nunique"])
    assert s["size"].max() - s["size"].min() <= 1 and (s["max"] == s["size"] - 1).all() and (s["nunique"] == s["size"]).all()


def test_names_have_cells_of_their_own_and_more_names_than_cells_keep_their_order(spark):
    few = sharding.name_places(spark.createDataFrame([(f"n{i % 20}",) for i in range(500)], "name string"), "name", 32, "cell").distinct().toPandas()
    assert len(few) == 20 and few.cell.nunique() == 20 and few.cell.max() == 19
    many = sharding.name_places(spark.createDataFrame([(f"n{i:04d}",) for i in range(1000)], "name string"), "name", 32, "cell").toPandas().sort_values("name")
    assert many.cell.is_monotonic_increasing and many.cell.value_counts().between(31, 32).all() and many.cell.nunique() == 32


def test_decontamination_tables_equal_sorted_keys(monkeypatch):
    from spikeframe.llm import textvec as tv

    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(300)]
    items = [(i, " ".join(rng.choice(words, 20)) + ". " + " ".join(rng.choice(words, 8))) for i in range(90)]
    texts = [" ".join(rng.choice(words, 60)) + " " + items[k % 90][1] + " " + " ".join(rng.choice(words, 30 * (k % 5))) for k in range(120)]
    raw = "".join(texts).encode()
    split = tv.split_words(np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)]), tv.ALNUM)
    dense = decontam.Index.build(items)
    found = dense.leaks(split, len(texts), 0.3, 0.5)
    monkeypatch.setattr(decontam, "TABLE", 0)
    sparse = decontam.Index.build(items)
    assert dense.spot is not None and sparse.spot is None
    assert found == sparse.leaks(split, len(texts), 0.3, 0.5) and len(found) >= 120
