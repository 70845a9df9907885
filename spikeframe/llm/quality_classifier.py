"""Quality classifier by positive-unlabelled learning.

Minimises the non-negative unbiased risk  pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))  of a linear model under
logistic loss. Positives are trusted rows, unlabelled are all documents, pi is the class prior. Both
expectations run over all rows: each step is one Spark job that sums gradients over blocks of features.

The prior is estimated from positives and unlabelled rows alone (best bin estimation): a first model learns from half of the
positives; above any score, the share of all rows by the share of the other positives is an upper bound of the prior, and
the score whose bound, with the error that the counts allow, is the least gives it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .storage import cut

STEPS, RATE, BLOCK_ROWS = 40, 0.25, 4096
CUT = 0.7
#: Bins of scores for the prior, the prior of the first model, and the chance that the bound of the estimate fails.
BINS, FIRST_PRIOR, FAIL = 1000, 0.5, 0.1
_SIGNS = "#*$%&|<>!"
_CLASSES = np.zeros((256, len(_SIGNS) + 4), bool)
for _i, _c in enumerate(_SIGNS):
    _CLASSES[ord(_c), _i] = True
_CLASSES[0x41:0x5B, len(_SIGNS)] = True
_CLASSES[0x30:0x3A, len(_SIGNS) + 1] = True
_CLASSES[10, len(_SIGNS) + 2] = True
_CLASSES[[ord(c) for c in ".,;:?"], len(_SIGNS) + 3] = True
_SCALES = (1.0, 8.0, 40.0)
#: Byte classes per word, equal neighbours, repeated 2-word sequences, word length, log words.
_RAW = _CLASSES.shape[1] + 4
FEATURES = _RAW * len(_SCALES) + 1


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES numbers per text, the last one constant; an empty text has zeros before it."""
    texts = len(offsets) - 1
    words = tv.split_words(buf, offsets, ~tv.WHITESPACE)
    count = np.diff(words.first).astype(float)
    per = np.maximum(count, 1)
    raw = np.zeros((texts, _RAW))
    for c in range(_CLASSES.shape[1]):
        total = np.concatenate([[0], np.cumsum(_CLASSES[:, c][buf])])
        raw[:, c] = (total[offsets[1:]] - total[offsets[:-1]]) / per
    same = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    raw[:, -4] = np.bincount(words.doc[1:][same], minlength=texts)[:texts] / per if len(same) else 0
    grams, owner = tv.shingles(words, 2)
    if len(grams):
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        twice = (grams[1:] == grams[:-1]) & (owner[1:] == owner[:-1])
        raw[:, -3] = np.bincount(owner[1:][twice], minlength=texts)[:texts] / per
    raw[:, -2] = np.bincount(words.doc, words.end - words.start, texts)[:texts] / per / 20 if len(words.doc) else 0
    raw[:, -1] = np.log1p(count) / 10
    return np.concatenate([*(np.tanh(raw * s) for s in _SCALES), np.ones((texts, 1))], 1).astype(np.float32)


def _extract(batches):
    for batch in tv.released(batches):
        for row, last, buf, offsets in tv.text_steps(batch.column(1)):
            x = features(buf, offsets)
            sizes = np.arange(last - row + 1, dtype=np.int32) * x.shape[1] * 4
            blob = pa.Array.from_buffers(pa.binary(), last - row, [None, pa.py_buffer(sizes), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, last - row), blob], ["doc_id", "x"])


def _block(batches):
    """Rows (x, positive) in blocks: how often each row is a trusted positive, and the features."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            positive = part.column(1).to_numpy(zero_copy_only=False).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64()), pa.array([positive.tobytes()], pa.binary()), pa.array([b"".join(part.column(0).to_pylist())], pa.binary())], ["n", "positive", "x"])


def _sums(weights: np.ndarray) -> Callable:
    def run(batches):
        total = np.zeros(4 * FEATURES + 6)
        for batch in batches:
            for p, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                p, x = np.frombuffer(p, np.float32).astype(float), np.frombuffer(x, np.float32).reshape(-1, FEATURES).astype(float)
                z = x @ weights
                up = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                loss_up, loss_down = np.logaddexp(0, -z), np.logaddexp(0, z)
                total += np.concatenate([(p * (up - 1)) @ x, (p * up) @ x, up @ x, (x * x).sum(0), [p.sum(), len(p), (p * loss_up).sum(), (p * loss_down).sum(), loss_down.sum(), 0]])
        yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(np.arange(len(total)))], ["v", "i"])

    return run


def fit(table: DataFrame, prior: float, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """Weights from rows (x, positive), by Adam on the whole non-negative risk."""
    blocks = cut(table.select("x", "positive").mapInArrow(_block, "n long, positive binary, x binary"))
    w, m, v = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES)
    for t in range(1, steps + 1):
        s = np.zeros(4 * FEATURES + 6)
        for r in blocks.mapInArrow(_sums(w), "v double, i long").groupBy("i").agg(F.sum("v").alias("v")).collect():
            s[r.i] = r.v
        gp_up, gp_down, gu_down = s[:FEATURES], s[FEATURES : 2 * FEATURES], s[2 * FEATURES : 3 * FEATURES]
        positives, rows, _, lp_down, lu_down = s[4 * FEATURES : 4 * FEATURES + 5]
        if not rows or not positives:
            return w
        negative = lu_down / rows - prior * lp_down / positives
        g_negative = gu_down / rows - prior * gp_down / positives
        g = prior * gp_up / positives + g_negative if negative >= 0 else -g_negative
        g = g + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _histogram(weights: np.ndarray) -> Callable:
    """How many rows (x, held) and held positives have their score in each bin."""

    def run(batches):
        rows, held = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            z = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).reshape(-1, FEATURES) @ weights
            at = np.minimum((BINS / (1 + np.exp(-np.clip(z, -30, 30)))).astype(int), BINS - 1)
            rows += np.bincount(at, minlength=BINS)
            held += np.bincount(at, batch.column(1).to_numpy(zero_copy_only=False), BINS).astype(np.int64)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(rows[some]), pa.array(held[some])], ["bin", "n", "held"])

    return run


def best_bin(n: np.ndarray, held: np.ndarray) -> float:
    """The class prior from counts of all rows and of held positives by rising score; 0.5 without any of either."""
    if not n.sum() or not held.sum():
        return 0.5
    share, own = (np.cumsum(c[::-1]) / c.sum() for c in (n, held))
    error = np.sqrt(np.log(4 / FAIL) / 2 / n.sum()) + np.sqrt(np.log(4 / FAIL) / 2 / held.sum())
    safe = np.maximum(own, 1e-12)
    best = np.argmin(np.where(own > 0, (share + error) / safe, np.inf))
    return float(np.clip(share[best] / safe[best], 0.01, 0.99))


def estimate_prior(table: DataFrame, steps: int = STEPS) -> float:
    """The share of positives among all rows (x, positive, fold 0 or 1), from trusted positives and unlabelled rows alone."""
    weights = fit(table.select("x", F.when(F.col("fold") == 0, F.col("positive")).otherwise(0).alias("positive")), FIRST_PRIOR, steps)
    held = table.select("x", F.when(F.col("fold") == 1, F.col("positive")).otherwise(0).cast("long").alias("held"))
    counts = held.mapInArrow(_histogram(weights), "bin long, n long, held long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("held").alias("held")).collect()
    n, own = np.zeros(BINS), np.zeros(BINS)
    for r in counts:  # BINS rows at most
        n[r.bin], own[r.bin] = r.n, r.held
    return best_bin(n, own)


def _scores(weights: np.ndarray) -> Callable:
    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None, steps: int = STEPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row of docs, from labels (doc_id, quality); learn: a condition over doc_id.

    Only labels of quality 1 are learned from, as trusted positives; all rows are the unlabelled ones. Empty and null
    texts have zero features and a score like any other; without positives all scores are 0.5. Ids are cast to long, and
    may be null (such rows are scored, not learned from as positives) or repeat. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    extracted = cut(rows.mapInArrow(_extract, "doc_id long, x binary"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    marks = marks if learn is None else marks.where(learn)
    trusted = marks.where("quality = 1").select("doc_id").distinct().withColumn("positive", F.lit(1))
    table = cut(extracted.join(trusted, "doc_id", "left").select("x", F.coalesce("positive", F.lit(0)).alias("positive"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("fold")))
    prior = estimate_prior(table, steps)
    weights = fit(table.select("x", "positive"), prior, steps)
    return extracted.mapInArrow(_scores(weights), "doc_id long, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))
