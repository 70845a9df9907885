"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over all documents. Spans that look disguised (letters swapped
for digits or signs, letters spaced out, letters repeated) become a lattice of readings, and Viterbi
decoding picks the likeliest text under channel costs and the character model. Scores use the restored text
beside the original.

The scorer is a table of word and word-prefix features, learned from a bounded sample of labelled
rows (MAX_TOXIC and MAX_CLEAN rows by hash order). A feature's evidence is the number of different
previous words it was seen after, so copies of one document count once. Features whose likelihood ratio
beats what chance gives among all features, and whose precision reaches a bound, are kept; a feature's weight is
the lower end of the interval of its precision, a word counts by its best feature, and a document's
score is the noisy-or of these distinct features. The bound is the lowest of BOUNDS that rejects at most
MAX_FALSE of the clean rows in a two-fold cross-validation over the rows that may be learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .storage import cut

MAX_TOXIC, MAX_CLEAN, MAX_FEATURES = 3000, 6000, 50_000
PREFIXES = (4, 5, 6)
CHANCE, Z = 4.0, 1.64
#: Bounds on a feature's precision to choose from, and the share of clean rows that may be rejected in cross-validation.
BOUNDS, MAX_FALSE = (0.7, 0.8, 0.9, 0.95), 0.02
#: Score of a document without features; predicted when a score is at least CUT.
FLOOR, CUT = 0.02, 0.7

# Common letter swaps.
SWAPS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}

_SYMBOLS = 43
_SYM = np.full(256, _SYMBOLS - 1, np.int32)
for _c in range(26):
    _SYM[0x61 + _c] = _SYM[0x41 + _c] = _c
for _c in range(0x80, 0x100):
    _SYM[_c] = 26 + (_c & 15)
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_SWAP = np.zeros(256, bool)
_SWAP[[ord(c) for c in SWAPS]] = True
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in " .-_*"]] = True

_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*]{1,2}){2,}[^\W_](?![^\W_])")
#: What makes a token look disguised: swaps between letters, before two or after two, or three equal letters.
_ODD = re.compile(r"[^\W\d_][013457899@$!|+]+[^\W\d_]|(?<![^\W_])(?<![013457899@$!|+])[013457899@$!|+]+[^\W\d_]{2}|[^\W\d_]{2}[013457899@$!|+]+(?![^\W_])|([^\W\d_])\1\1")
#: Characters that the decoder takes at once: a longer token is decoded in parts of this length.
SPAN = 256


def _count_trigrams(batches):
    counts = np.zeros(_SYMBOLS**3, np.int64)
    for batch in tv.released(batches):
        for _, _, buf, _ in tv.text_steps(batch.column(0)):
            s = _SYM[buf]
            if len(s) > 2:
                counts += np.bincount((s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:], minlength=len(counts))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["gram", "n"])


class CharModel:
    """Costs (negative log probabilities) of a symbol after two others."""

    def __init__(self, counts: np.ndarray):
        self.cost = -np.log((counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS) + 0.05) / (counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS).sum(2, keepdims=True) + 0.05 * _SYMBOLS)).astype(np.float32)
        self.known: dict[str, str] = {}

    @staticmethod
    def fit(texts: DataFrame) -> CharModel:
        """Counted over all rows of texts; at most 43 ** 3 counts reach the driver."""
        counts = np.zeros(_SYMBOLS**3)
        for gram, n in texts.mapInArrow(_count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
            counts[gram] = n
        return CharModel(counts)

    def decode(self, span: str) -> str:
        """The likeliest reading of a disguised span, by Viterbi over its character lattice."""
        if span in self.known:
            return self.known[span]
        spaced = bool(_SPACED.fullmatch(span.strip()))
        end = _SYMBOLS - 1
        states = {(end, end): (0.0, None, "")}  # last two symbols: cost, link to the characters before, character
        for i, c in enumerate(span):
            swaps = [(x, 0.7) for x in SWAPS.get(c, "")]
            readings = [(c, 0.0 if c.isalpha() else 1.5), *swaps]
            drop = None
            if spaced and not c.isalnum() and c not in "@$!|+":
                drop = 0.1
            elif i and c == span[i - 1] and (c.isalpha() or swaps):
                drop = 0.4 if i > 1 and c == span[i - 2] or i + 1 < len(span) and span[i + 1] == c else 2.0
            after: dict = {}
            for (a, b), (cost, link, char) in states.items():
                for x, price in readings:
                    price += cost
                    p, q = a, b
                    for byte in x.encode("utf-8", "replace"):
                        s = int(_SYM[byte])
                        price += float(self.cost[p, q, s])
                        p, q = q, s
                    if (p, q) not in after or price < after[p, q][0]:
                        after[p, q] = (price, (link, char), x)
                if drop is not None and ((a, b) not in after or cost + drop < after[a, b][0]):
                    after[a, b] = (cost + drop, (link, char), "")
            states = after
        _, link, char = min(states.items(), key=lambda s: s[1][0] + float(self.cost[s[0][0], s[0][1], end]))[1]
        out = [char]
        while link is not None:
            link, char = link
            out.append(char)
        text = "".join(reversed(out))
        if len(span) <= 64:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[span] = text
        return text

    def _parts(self, span: str) -> str:
        return "".join(self.decode(span[i : i + SPAN]) for i in range(0, len(span), SPAN))

    def spans(self, text: str) -> str:
        """Readings of the spaced-out spans of a text, apart by spaces."""
        return " ".join(self._parts(m.group(0)) for m in _SPACED.finditer(text.lower()))

    def tokens(self, text: str) -> str:
        """Readings of those tokens of a text that look disguised, apart by spaces."""
        return " ".join(self._parts(t.strip(".,;:?*&%#\"'()[]")) for t in text.lower().split() if _ODD.search(t))


def marks(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bool per byte, bool per text): bytes in all that _ODD finds, and some more; texts with all that _SPACED finds, and some more."""
    n = len(offsets) - 1
    if len(buf) < 3:
        return np.ones(len(buf), bool), np.ones(n, bool)
    letter, swap, gap = _LETTER[buf], _SWAP[buf], _GAP[buf]
    odd = np.zeros(len(buf), bool)
    odd[:-1] = (swap[:-1] & letter[1:]) | (letter[:-1] & swap[1:])  # a swap beside a letter
    low = buf | 0x20
    odd[2:] |= letter[2:] & (buf[:-2] >= 0x80)  # letters of several bytes may be three alike
    odd[2:] |= letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    # three characters, each alone, one or two gaps apart; bytes above ASCII count as either kind
    char = np.flatnonzero((buf & 0xC0) != 0x80)
    digit, g = (buf >= 0x30) & (buf <= 0x39), gap[char]
    plain = ((letter & (buf < 0x80)) | digit)[char]
    before, after = np.ones(len(char), bool), np.ones(len(char), bool)
    before[1:], after[:-1] = ~plain[:-1], ~plain[1:]
    starts = np.searchsorted(char, offsets)
    before[starts[starts < len(char)]] = True
    after[starts[starts > 0] - 1] = True
    alone = (letter | digit)[char] & before & after
    at = lambda x, k: np.concatenate([np.zeros(min(k, len(x)), bool), x[: max(0, len(x) - k)]])
    left = at(g, 1) & (at(alone, 2) | (at(g, 2) & at(alone, 3)))
    right = (at(g[::-1], 1) & (at(alone[::-1], 2) | (at(g[::-1], 2) & at(alone[::-1], 3))))[::-1]
    total = tv.running(alone & left & right)[np.searchsorted(char, offsets)]
    return odd, total[1:] > total[:-1]


def _contexts(batches):
    for batch in batches:
        for row, _, buf, offsets in tv.text_steps(batch.column(1)):
            words = tv.split_words(buf, offsets, tv.ALNUM)
            if not len(words.hash):
                continue
            before = np.concatenate([[np.uint64(0)], words.hash[:-1]])
            before[words.first[:-1][np.diff(words.first) > 0]] = 0
            toxic = batch.column(0).to_numpy(zero_copy_only=False)[row + words.doc].astype(np.uint64)
            context = tv.mix(words.hash * np.uint64(3) + before * np.uint64(5) + toxic)
            _, one = np.unique(context, return_index=True)
            cols = [words.hash, *words.prefix_hashes(PREFIXES), context]
            yield pa.RecordBatch.from_arrays([pa.array(toxic[one].astype(np.int64)), *(pa.array(c[one].view(np.int64)) for c in cols)], ["toxic", "f0", "f1", "f2", "f3", "context"])


def count_features(sample: DataFrame) -> DataFrame:
    """(feature, bad, good, rate) from rows (toxic, text): evidence in both classes, and the share of all evidence that is toxic."""
    seen = sample.select("toxic", "text").mapInArrow(_contexts, "toxic long, f0 long, f1 long, f2 long, f3 long, context long").distinct()
    words = cut(seen.groupBy("toxic", "f0", "f1", "f2", "f3").agg(F.count("*").alias("n")))
    each = words.select("toxic", "n", F.explode(F.array_distinct(F.array("f0", "f1", "f2", "f3"))).alias("feature"))
    part = lambda x: F.sum(F.when(F.col("toxic") == x, F.col("n")).otherwise(0))
    return cut(each.groupBy("feature").agg(part(1).alias("bad"), part(0).alias("good"))).withColumn("rate", F.lit(_rate(words)))


def _rate(words: DataFrame) -> float:
    totals = {r.toxic: r.n for r in words.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    return totals.get(1, 0) / max(1, sum(totals.values()))


def pick_features(table: DataFrame, bounds: tuple[float, ...]) -> dict[float, tuple[np.ndarray, np.ndarray]]:
    """For each bound on precision, (sorted feature hashes, precisions); none without rows of both classes."""
    features = table.count()
    n, rate = F.col("bad") + F.col("good"), F.col("rate")
    part = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("bad"), rate) + part(F.col("good"), 1 - rate))
    share = F.col("bad") / n
    # lower end of Wilson's interval
    precision = (share + Z * Z / (2 * n) - Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    kept = table.where("rate > 0 and rate < 1").where((share >= min(bounds)) & (ratio >= 2 * math.log(max(1, features)) + CHANCE))
    kept = kept.select("feature", "bad", share.alias("share"), precision.alias("p")).orderBy(F.desc("bad"), "feature").limit(MAX_FEATURES).collect()
    out = {}
    for bound in bounds:
        rows = sorted((np.int64(r.feature).view(np.uint64), r.p) for r in kept if r.share >= bound)
        out[bound] = (np.array([h for h, _ in rows], np.uint64), np.array([p for _, p in rows], float))
    return out


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(toxic, fold, text) of at most MAX_TOXIC and MAX_CLEAN labelled rows for which learn (over doc_id) holds."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(learn)
    pick = lambda x, n: marks.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = cut(pick(1, MAX_TOXIC).union(pick(0, MAX_CLEAN)))  # bounded by the limits
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    return rows.select("toxic", F.pmod(F.xxhash64("text"), F.lit(2)).alias("fold"), "text")  # copies share a fold


class Scorer:
    """Scores of texts by features (sorted hashes) with their precisions, over readings by the character model."""

    def __init__(self, model: CharModel, hashes: np.ndarray, precisions: np.ndarray):
        self.model, self.hashes, self.loss = model, hashes, np.log(np.maximum(1e-6, 1 - precisions))
        self.known: dict[int, tuple[int, ...]] = {}

    def _hits(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = tv.split_words(buf, offsets, tv.ALNUM)
        if not len(words.hash) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        best, loss = np.full(len(words.hash), -1), np.zeros(len(words.hash))
        for h in (words.hash, *words.prefix_hashes(PREFIXES)):
            at = np.searchsorted(self.hashes, h)
            at[at == len(self.hashes)] = 0
            better = (self.hashes[at] == h) & (self.loss[at] < loss)
            best[better], loss[better] = at[better], self.loss[at[better]]
        hit = best >= 0
        return words.doc[hit], best[hit]

    def _read(self, texts: list[str]) -> list[tuple[int, ...]]:
        """Features of each of some readings."""
        raw = [x.encode("utf-8", "replace") for x in texts]
        owner, found = self._hits(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        ends = np.searchsorted(owner, np.arange(len(texts) + 1))
        found = found.tolist()
        return [tuple(found[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _tokens(self, buf: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of the readings of tokens with a mark; each different token is read once."""
        words = tv.split_words(buf, offsets, ~tv.WHITESPACE)
        total = tv.running(odd)
        at = np.flatnonzero(total[words.end] > total[words.start])
        name, first, number = np.unique(words.hash[at], return_index=True, return_inverse=True)
        if len(self.known) > 100_000:
            self.known.clear()
        fresh = [i for i, h in enumerate(name.tolist()) if h not in self.known]
        if fresh:
            one = [(int(words.start[j]), int(words.end[j])) for j in at[first[fresh]]]
            readings = self._read([self.model.tokens(buf[a:b].tobytes().decode("utf-8", "replace")) for a, b in one])
            self.known.update(zip(name[fresh].tolist(), readings, strict=True))
        found = [self.known[h] for h in name.tolist()]
        size = np.array([len(x) for x in found], np.int64)[number]
        some = np.flatnonzero(size)
        if not len(some):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.repeat(words.doc[at[some]], size[some]), np.array([f for i in some for f in found[number[i]]], np.int64)

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, size = len(offsets) - 1, max(1, len(self.hashes))
        if not len(self.hashes) or not len(buf):
            return np.full(n, FLOOR)
        odd, spaced = marks(buf, offsets)
        found = [self._hits(buf, offsets), self._tokens(buf, offsets, odd)]
        spaced = np.flatnonzero(spaced)
        if len(spaced):
            readings = self._read([self.model.spans(buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")) for i in spaced])
            found.append((np.repeat(spaced, [len(x) for x in readings]), np.array([f for x in readings for f in x], np.int64)))
        pairs = np.unique(np.concatenate([d for d, _ in found]) * size + np.concatenate([f for _, f in found]))
        return 1 - (1 - FLOOR) * np.exp(np.bincount(pairs // size, self.loss[pairs % size], n)[:n]) if len(pairs) else np.full(n, FLOOR)

    def column(self, texts: pa.Array) -> pa.Array:
        parts = [self.scores(buf, offsets) for _, _, buf, offsets in tv.text_steps(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))


def _judged(shared) -> Callable:
    """How many rows of each class and bound are rejected by the features of the other fold."""

    def run(batches):
        out = Counter()
        for batch in batches:
            toxic, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for other, bound, scorer in shared.value:
                mine = fold != other
                rejected = scorer.column(batch.column(2).filter(pa.array(mine))).to_numpy() >= CUT
                for x in (0, 1):
                    here = toxic[mine] == x
                    out[bound, x] += np.array([rejected[here].sum(), here.sum()])
        keys = sorted(out)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.float64()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([int(out[k][i]) for k in keys], pa.int64()) for i in (0, 1))], ["bound", "toxic", "rejected", "n"])

    return run


def choose_bound(sample: DataFrame, model: CharModel, bounds: tuple[float, ...] = BOUNDS, max_false: float = MAX_FALSE) -> float:
    """The lowest bound that rejects at most max_false of the clean rows of the other fold; the highest if none does."""
    scorers = []
    for fold in (0, 1):
        found = pick_features(count_features(sample.where(F.col("fold") == fold)), bounds)
        scorers += [(fold, b, Scorer(model, *found[b])) for b in bounds]
    shared = sample.sparkSession.sparkContext.broadcast(scorers)
    judged = sample.mapInArrow(_judged(shared), "bound double, toxic long, rejected long, n long").groupBy("bound", "toxic").agg(F.sum("rejected").alias("rejected"), F.sum("n").alias("n")).collect()
    false = {r.bound: r.rejected / max(1, r.n) for r in judged if r.toxic == 0}
    return min((b for b in bounds if false.get(b, 0.0) <= max_false), default=max(bounds))


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, text_col: str = "text", id_col: str = "doc_id") -> Scorer:
    """Character model of all docs, and features from labels (doc_id, toxic); learn: a condition over doc_id.

    Rows or labels with null ids, labels or texts teach nothing; without labels of both classes there are no features.
    """
    learn = F.lit(True) if learn is None else learn
    model = CharModel.fit(docs.select(F.col(text_col).cast("string")))
    sample = cut(training_sample(docs, labels, learn, id_col, text_col))  # bounded by MAX_TOXIC and MAX_CLEAN
    bound = choose_bound(sample, model)
    return Scorer(model, *pick_features(count_features(sample), (bound,))[bound])


def score(shared) -> Callable:
    """A column function: the scores of a text column by a broadcast scorer. Only the texts go to Python."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in tv.released(batches):
            yield shared.value.column(texts)

    return run


def score_toxicity(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row; null and empty texts score FLOOR. Ids are passed on as they are and may be null or repeat; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    out = docs.select(F.col(id_col).alias("doc_id"), score(shared)(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def drop_toxic(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns whatever their names, that score below CUT; null and empty texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    return docs.where(score(shared)(F.col(text_col).cast("string")) < CUT)
