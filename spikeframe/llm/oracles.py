"""DuckDB SQL that gives the rows of the queries op1, op4, op9, op10, op12 and op13 of this subpackage.

Words, hashes, sketches (exact below 2048 rows), curve indexes and rules are made again from the tables.
"""

from __future__ import annotations

from . import language_id as L
from . import quality_rules as Q
from . import sharding as S
from . import url_filter as U

TEXT = "coalesce(text, '')"
_LOWER = f"translate({TEXT}, '{U._UPPER}', '{U._LOWER}')"
_SPACE = r"[\x20\x09-\x0D]"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_SPACE}+'), lambda x: x <> '')"


OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {words(_LOWER)} AS w FROM documents),
 s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
   ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM w),
 named AS (SELECT doc_id, len(g) AS n, min(doc_id) OVER (PARTITION BY CASE WHEN len(g) = 0 THEN CAST(doc_id AS VARCHAR) ELSE md5(array_to_string(g, chr(10))) END) AS rep FROM s),
 cell AS MATERIALIZED (SELECT s.doc_id, named.n, unnest(g) AS g FROM s JOIN named USING (doc_id) WHERE rep = doc_id),
 link AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM cell a JOIN cell b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 90 * (min(a.n) + min(b.n) - count(*))),
 reach AS (SELECT DISTINCT rep AS a, rep AS b FROM named UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
 least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT named.doc_id, CAST(named.n AS BIGINT) AS n_shingles, component_id FROM named JOIN least ON named.rep = least.a"""


def _op1() -> str:
    measures = list(Q.MEASURES)
    at = lambda m, q: f"list_sort(list({m}))[CAST(ceil(round({q / 100} * count(*), 6)) AS BIGINT)]"
    take = lambda tag: ", ".join(f"{at(m, q)} AS {tag}_{m}_{q}" for m in measures for q in (10, 50))
    lean = lambda tag, coarser: ", ".join(f"({tag}_n * {tag}_{m}_{q} + {Q.PRIOR_ROWS} * {coarser}_{m}_{q}) / ({tag}_n + {Q.PRIOR_ROWS}) AS {tag[0]}{coarser[0]}_{m}_{q}" for m in measures for q in (10, 50))
    fence = " OR ".join(f"{m} > ol_{m}_50 + greatest({slack}, {Q.SPREAD} * (ol_{m}_50 - ol_{m}_10))" for m, slack in Q.MEASURES.items())
    inner = lean("own", "la")
    return rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {TEXT} AS t, {words(TEXT)} AS w FROM documents),
 win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) u(i)),
 rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
 cov AS (SELECT doc_id, count(DISTINCT i + k) AS c FROM rep, range(3) r(k) GROUP BY 1),
 b AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
   length(t) - length(replace(t, '!', '')) AS bangs, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS uppers, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '') AS lines, coalesce(c, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
 m AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_symbols / n_words, 0.0::DOUBLE) AS symbol_share, coalesce(uppers / word_chars, 0.0::DOUBLE) AS upper_share, coalesce(bangs / n_words, 0.0::DOUBLE) AS bang_share, coalesce(n_repeat_words / n_words, 0.0::DOUBLE) AS repeat_share,
   n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
 q AS (SELECT * FROM m WHERE n_words >= 50),
 o AS (SELECT lang, source, count(*) AS own_n, {take("own")} FROM q GROUP BY 1, 2), l AS (SELECT lang, count(*) AS lang_n, {take("lang")} FROM q GROUP BY 1), a AS (SELECT {take("all")} FROM q),
 la AS (SELECT lang, {lean("lang", "all")} FROM l, a),
 f AS (SELECT lang, source, {inner} FROM o JOIN la USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({fence}, false) AS kept FROM m LEFT JOIN f USING (lang, source)"""


_CRC = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: CAST(('0x' || h) AS BIGINT)), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295)"


def _op9(shards: int = 8) -> str:
    """Skilling's transform again, a common table expression for every step."""
    bits, top, steps, last = S.BITS, (1 << S.BITS) - 1, [], "h0"
    names = ["d0", "d1", "d2"]

    def step(**changed: str) -> None:
        nonlocal last
        new = f"h{len(steps) + 1}"
        steps.append(f"{new} AS (SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in changed.items())}) FROM {last})")
        last = new

    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in names:
            swap = f"(xor(d0, {d}) & {low})"
            change = {"d0": f"CASE WHEN {d} & {q} <> 0 THEN xor(d0, {low}) ELSE xor(d0, {swap}) END"}
            if d != "d0":
                change[d] = f"CASE WHEN {d} & {q} <> 0 THEN {d} ELSE xor({d}, {swap}) END"
            step(**change)
        q >>= 1
    step(d1="xor(d1, d0)")
    step(d2="xor(d2, d1)")
    turn, q = "0", 1 << (bits - 1)
    while q > 1:
        turn = f"xor({turn}, CASE WHEN d2 & {q} <> 0 THEN {q - 1} ELSE 0 END)"
        q >>= 1
    index = " + ".join(f"(((xor({d}, turn) >> {level}) & 1) << {level * 3 + 2 - i})" for level in range(bits) for i, d in enumerate(names))
    return f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
 r AS (SELECT doc_id, {TEXT} AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
 k AS (SELECT doc_id, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, CASE WHEN t = '' THEN 0 ELSE {_CRC.format("t")} END AS text_crc32, CAST(('0x' || substr(md5(t), 1, 15)) AS BIGINT) AS key, lang, source FROM r, crc),
 g AS (SELECT doc_id, size, text_crc32, key, min(lang) OVER p AS lang, min(source) OVER p AS source FROM k WINDOW p AS (PARTITION BY size, text_crc32, key)),
 c AS (SELECT count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources FROM g),
 o AS (SELECT *, dense_rank() OVER (ORDER BY lang) - 1 AS lang_rank, dense_rank() OVER (ORDER BY source) - 1 AS source_rank FROM g),
 h0 AS (SELECT o.*, CASE WHEN langs > {top + 1} THEN lang_rank * {top + 1} // langs ELSE lang_rank END AS d0, CASE WHEN sources > {top + 1} THEN source_rank * {top + 1} // sources ELSE source_rank END AS d1, least({top}, CAST(floor(log2(size) * 2) AS BIGINT)) AS d2 FROM o, c),
 {", ".join(steps)},
 z AS (SELECT *, {turn} AS turn FROM {last}),
 n AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY {index}, text_crc32, key, doc_id) - 1 AS rank, count(*) OVER () AS total FROM z)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(rank * {shards} // total AS INTEGER) AS shard, rank - ((rank * {shards} // total) * total + {shards - 1}) // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM n"""


def _op10(rules: list[tuple[str, str, str]], min_support: float = 0.002, min_confidence: float = 0.8) -> str:
    cases = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in cases)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in cases)
    z = U.Z
    lower = f"(s + {z * z} / (2 * n) - {z} * sqrt(s * (1 - s) / n + {z * z} / (4 * n * n))) / (1 + {z * z} / n)"
    return rf"""
WITH p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{U._UPPER}', '{U._LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
 j AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS listed FROM p),
 t AS (SELECT *, list_filter(list_distinct(list_concat(list_transform(string_split(host, '.'), lambda x: 'h:' || x), list_transform(string_split(path, '/'), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g')), list_transform(string_split(regexp_extract(coalesce(url, ''), '\?([^#]*)', 1), '&'), lambda x: 'q:' || string_split(x, '=')[1]))), lambda x: length(x) > 2) AS tokens FROM j),
 l AS (SELECT doc_id AS page_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
 known AS (SELECT list_sort(tokens) AS tokens, bad FROM t JOIN l USING (page_id) WHERE listed IS NULL AND bad IS NOT NULL AND len(tokens) > 0),
 part AS (SELECT list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS rule, bad FROM known, range(1, 4096) r(m) WHERE m < (1 << len(tokens))),
 hit AS (SELECT rule, count(*) FILTER (bad) AS k, count(*) AS n, count(*) FILTER (bad) / count(*) AS s FROM part GROUP BY 1),
 good AS (SELECT rule FROM hit, (SELECT count(*) AS total FROM known) c WHERE k >= {U.LEAST_ROWS} AND k >= ceil({min_support} * total) AND s >= {min_confidence} AND {lower} >= {min_confidence}),
 mined AS (SELECT rule FROM good g WHERE NOT EXISTS (SELECT 1 FROM good x WHERE len(x.rule) < len(g.rule) AND list_has_all(g.rule, x.rule))),
 fired AS (SELECT DISTINCT url FROM t, mined WHERE listed IS NULL AND host <> '' AND list_has_all(tokens, mined.rule))
SELECT page_id, host, path, rule, coalesce(listed, CASE WHEN fired.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN fired ON j.url = fired.url"""


def _op12(top: int = 50) -> str:
    terms = f"regexp_extract_all(translate(text, '{U._UPPER}', '{U._LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH sized AS (SELECT doc_id, row_number() OVER () AS row, {terms} AS ts FROM documents WHERE len({terms}) > 0),
 total AS (SELECT count(*) AS nn, CAST(sum(len(ts)) AS BIGINT) AS ll FROM sized),
 held AS (SELECT row, t, count(*) AS tf FROM (SELECT row, unnest(ts) AS t FROM sized) GROUP BY ALL),
 items AS (SELECT DISTINCT item_id, unnest({terms}) AS t FROM benchmark),
 weight AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, total WHERE t IN (SELECT t FROM items) GROUP BY t, nn),
 part AS (SELECT row, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(ts) * nn) // ll))) AS c FROM held JOIN weight USING (t) JOIN sized USING (row), total),
 found AS (SELECT item_id, row, CAST(sum(c) AS BIGINT) AS score FROM part JOIN items USING (t) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM found JOIN sized USING (row) WHERE score > 0 QUALIFY rank <= {top}"""


OP13 = rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
 d AS (SELECT doc_id, row_number() OVER () AS row, lang, text, {_CRC.format("CAST(doc_id AS VARCHAR)")} % 4 = 2 AS held_out FROM documents, crc),
 w AS (SELECT row, ' ' || w || ' ' AS w, count(*) AS c FROM (SELECT row, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}]+')) AS w FROM d) GROUP BY ALL),
 g AS (SELECT row, substr(w, i, n) AS g, sum(c) AS c FROM w, range(1, 4) a(n), unnest(range(1, length(w) - n + 2)) b(i) WHERE substr(w, i, n) <> ' ' GROUP BY ALL),
 learned AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(c) DESC, g) - 1 AS place FROM g JOIN d USING (row) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g QUALIFY place < {L.PROFILE}),
 k AS (SELECT max(place) + 1 AS k FROM learned),
 own AS (SELECT row, g, row_number() OVER (PARTITION BY row ORDER BY c DESC, g) - 1 AS place FROM g),
 off AS (SELECT row, langs.lang, CAST(sum(coalesce(abs(own.place - learned.place), k)) AS DOUBLE) AS off, CAST(count(*) * any_value(k) AS DOUBLE) AS most
   FROM own JOIN k ON own.place < k CROSS JOIN (SELECT DISTINCT lang FROM learned) langs LEFT JOIN learned ON learned.lang = langs.lang AND learned.g = own.g GROUP BY 1, 2),
 best AS (SELECT row, lang, off, coalesce(lead(off) OVER (PARTITION BY row ORDER BY off, lang), most) AS after FROM off QUALIFY row_number() OVER (PARTITION BY row ORDER BY off, lang) = 1)
SELECT doc_id, held_out, coalesce(CASE WHEN regexp_matches(text, '\p{{L}}') THEN best.lang END, '{L.UNKNOWN}') AS lang_pred,
  CASE WHEN best.lang IS NULL OR NOT regexp_matches(text, '\p{{L}}') THEN 0.0::DOUBLE WHEN off + after > 0 THEN after / (off + after) ELSE 0.5::DOUBLE END AS score FROM d LEFT JOIN best USING (row)"""


def oracles(rules: list[tuple[str, str, str]]) -> dict[str, str]:
    return {"op1_quality_rules": _op1(), "op4_ngram_jaccard_join": OP4, "op9_sharding": _op9(), "op10_url_filters": _op10(rules), "op12_ranked_search": _op12(), "op13_language_id": OP13}
