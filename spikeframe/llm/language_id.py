"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams (one to three letters of a word with a blank on
either side), learned from all labelled rows. A text's own list is compared with each profile by the out-of-place
distance: how many places each of its n-grams stands from its place in the profile, and the length of the profile where it
isn't there. The nearest language wins.

An n-gram of three code points is a number of 63 bits, so n-grams are never hashed. Learning sends one row for each language and
n-gram that a run of texts holds; a profile's places come from a window whose input is cut to the profile's length before
it is shuffled, so a language of any size is no hot group. Profiles are broadcast in shards of SHARD languages, and a text takes the best of all shards.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .storage import cut, small_batches

#: N-grams of a profile and of a text's list, languages whose profiles go out in one broadcast, and n-grams that are counted at once.
PROFILE, SHARD, RUN = 1000, 500, 1 << 20
UNKNOWN = "und"
BLANK, BITS = 32, 21


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower case, whether it is a part of words (letters and marks), whether it is a letter."""
    lower, kind = np.arange(0x110000, dtype=np.int64), np.zeros(0x110000, np.int8)
    for c in range(0x110000):
        group = unicodedata.category(chr(c))[0]
        if group in "LM":
            kind[c] = 2 if group == "L" else 1
            small = chr(c).lower()
            lower[c] = ord(small) if len(small) == 1 else c
    return lower, kind > 0, kind == 2


def _grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(n-grams of each text, whether it has a letter) of the texts buf[offsets[i]:offsets[i + 1]] in UTF-8."""
    lower, inside, letter = _characters()
    first = np.append(tv.running((buf & 0xC0) != 0x80)[offsets[:-1]], 0)
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    first[-1] = len(points)
    texts = len(offsets) - 1
    owner = np.repeat(np.arange(texts), np.diff(first))
    has_letter = np.bincount(owner[letter[points]], minlength=texts) > 0
    # one blank stands for what lies between words and before and after a text
    mask = inside[points]
    new = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
    opens = mask & (new | ~np.append(False, mask[:-1]))
    spot = np.flatnonzero(mask)
    extra = opens[spot]
    at = np.arange(len(spot)) + np.cumsum(extra)
    line = np.full(len(spot) + int(extra.sum()) + 1, BLANK, np.int64)
    line[at] = lower[points[spot]]
    place = np.full(len(line), -1, np.int64)
    place[at] = owner[spot]
    two = (line[:-1] << (2 * BITS)) | (line[1:] << BITS)
    three = two[:-1] | line[2:]
    begins = np.searchsorted(owner[spot], np.arange(texts + 1))
    begins = np.where(begins < len(spot), at[np.minimum(begins, max(0, len(spot) - 1))] - 1 if len(spot) else 0, len(line) - 1)
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        inner = line[a + 1 : b + 1]
        if a == b:
            out.append(np.zeros(0, np.int64))
            continue
        letters = inner[:-1] != BLANK if b > a + 1 else np.zeros(0, bool)
        out.append(np.concatenate([inner[:-1][letters] << (2 * BITS), two[a:b], three[a : b - 1][letters[: b - 1 - a]]]))
    return out, has_letter


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of runs of texts."""

    def summed(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    held: dict[str, list[np.ndarray]] = {}
    size = 0
    for batch in tv.released(batches):
        langs = batch.column(0).to_pylist()
        for row, last, buf, offsets in tv.text_steps(batch.column(1)):
            for lang, grams in zip(langs[row:last], _grams(buf, offsets)[0], strict=True):
                held.setdefault(lang, []).append(grams)
                size += len(grams)
            if size >= RUN:
                yield from summed(held)
                held, size = {}, 0
    yield from summed(held)


def learn_profiles(docs: DataFrame, profile: int = PROFILE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, place): the most frequent n-grams of each language, from place 0; equal counts by code points.

    Rows without a language, a text or letters teach nothing; repeated rows count each time. Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("__row", F.row_number().over(order)).where(F.col("__row") <= profile).select("lang", "gram", (F.col("__row") - 1).alias("place"))


def _nearest(shared) -> Callable:
    """A column function: (nearest language, its distance, the next distance) of a text among a shard of languages; null without letters."""

    @F.arrow_udf("best double, lang string, next double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs, vocabulary, places, profile = shared.value
        for texts in tv.released(batches):
            found: list = []
            for _, _, buf, offsets in tv.text_steps(texts):
                for grams, has_letter in zip(*_grams(buf, offsets), strict=True):
                    if not has_letter:
                        found.append(None)
                        continue
                    gram, n = np.unique(grams, return_counts=True)
                    top = gram[np.argsort(-n, kind="stable")[:profile]]
                    at = np.searchsorted(vocabulary, top)
                    at[at == len(vocabulary)] = 0
                    known = vocabulary[at] == top
                    place = places[:, at[known]]
                    off = np.where(place < profile, np.abs(place - np.flatnonzero(known)), profile).sum(axis=1) + profile * int((~known).sum())
                    best = int(np.argmin(off))
                    rest = np.delete(off, best)
                    found.append({"best": float(off[best]), "lang": langs[best], "next": float(rest.min() if len(rest) else profile * len(top))})
            yield pa.array(found, pa.struct([("best", pa.float64()), ("lang", pa.string()), ("next", pa.float64())]))

    return run


def _shards(profiles: DataFrame) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, int]]:
    """(languages in order, all n-grams of their profiles in order, places by language and n-gram, length of a profile)."""
    langs = profiles.select("lang").distinct().orderBy("lang")
    width = profiles.agg(F.max("place")).first()[0]
    last = None
    while True:
        names = [r.lang for r in (langs if last is None else langs.where(F.col("lang") > last)).limit(SHARD).collect()]
        if not names:
            return
        last = names[-1]
        rows = profiles.where((F.col("lang") >= names[0]) & (F.col("lang") <= last)).toArrow()
        vocabulary = np.unique(rows.column("gram").to_numpy())
        number = {lang: i for i, lang in enumerate(names)}
        places = np.full((len(names), len(vocabulary)), width + 1, np.int64)
        places[[number[x] for x in rows.column("lang").to_pylist()], np.searchsorted(vocabulary, rows.column("gram").to_numpy())] = rows.column("place").to_numpy()
        yield names, vocabulary, places, width + 1


def identify(docs: DataFrame, profiles: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, in place of columns of these names.

    Texts that are null or have no letter, and all where nothing was learned, are UNKNOWN with score 0. Languages at equal distance: the first in
    alphabetical order. score: next distance / (best + next distance), 0.5 where two languages are equally near, 1 for the very
    profile. Rows may repeat; an empty table gives no rows; other columns stay, whatever their names.
    """
    small_batches(docs.sparkSession)
    kept = cut(profiles)
    text = F.col(f"`{text_col}`").cast("string")
    found = [_nearest(docs.sparkSession.sparkContext.broadcast(shard))(text) for shard in _shards(kept)]
    nothing = F.lit(None).cast("struct<best:double,lang:string,next:double>")
    # the nearest of the shards; the next is the least of its own next and the other shards' best
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "__near")]
    near = docs.select(*(F.col(f"`{c}`") for c in names), F.array(*(found or [nothing])).alias("__near"))
    best = F.array_min("__near")
    others = F.filter("__near", lambda s: s["lang"] != best["lang"])
    after = F.array_min(F.concat(F.array(best["next"]), F.transform(others, lambda s: s["best"])))
    score = F.when(best["best"] + after > 0, after / (best["best"] + after)).otherwise(F.lit(0.5))
    return near.select(*(F.col(f"`{c}`") for c in names), F.coalesce(best["lang"], F.lit(UNKNOWN)).alias("lang_pred"), F.when(best.isNull(), 0.0).otherwise(score).alias("score"))


def predict_language(docs: DataFrame, learn: Column, profile: int = PROFILE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """identify, with profiles learned from the rows where learn is true."""
    return identify(docs, learn_profiles(docs.where(learn), profile, text_col, lang_col), text_col)
