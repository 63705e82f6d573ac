"""Language identification by rank-order n-gram profiles and the out-of-place distance.

Texts become lower-cased letters; everything between runs of letters is one blank, and so are both ends. n-grams are 1
to 3 characters of that, blanks alone excepted. Characters are whole code points, 21 bits each, so no two letters of
any script are merged. A language's profile is its ``most`` most frequent
n-grams over all training documents, a document's the same of its whole text, ties to the smaller code. The
out-of-place distance sums, over the document's profile, how far each n-gram's rank is from its rank in the language's
profile (``most`` if it isn't there); the nearest language wins, ties to the one that sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import shared_dir
from .toxicity import held_out

MOST = 300
BLANK = 0x110000  # above all code points, so that an n-gram's length shows in its code
_TABLE: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _TABLE[0]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _letters(text: str) -> np.ndarray:
    """Code points of the letters, BLANK for one blank between runs of them and at both ends."""
    c = _points(text).astype(np.int64)
    c = np.where(_is_letter()[c], c, BLANK)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != BLANK) | (c[:-1] != BLANK)
    c = c[keep]
    c = c[int(len(c) > 0 and c[0] == BLANK) :]
    c = c[: len(c) - int(len(c) > 0 and c[-1] == BLANK)]
    return np.concatenate(([BLANK], c, [BLANK])) if len(c) else c


def _grams(c: np.ndarray) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of code points but blanks."""
    if not len(c):
        return c
    two = (c[:-1] << 21) | c[1:]
    return np.concatenate((c[c != BLANK], two, (two[:-1] << 21) | c[2:]))


def profile(text: str, most: int = MOST) -> np.ndarray:
    """The most frequent n-grams of a text."""
    grams = np.sort(_grams(_letters(text)))
    if not len(grams):
        return grams
    start = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    times = np.diff(np.append(start, len(grams)))
    order = np.argsort(-times, kind="stable")[:most]
    return grams[start[order]]


def out_of_place(grams: np.ndarray, known: np.ndarray, ranks: np.ndarray, most: int = MOST) -> np.ndarray:
    """Distances to all languages; ranks: languages by the sorted n-grams ``known`` and a last column for all others, ``most`` where an n-gram has no rank."""
    own = np.arange(len(grams))
    place = np.searchsorted(known, grams)
    place[np.append(known, -1)[place] != grams] = len(known)
    at = ranks[:, place]
    return np.where(at < most, np.abs(at - own), most).sum(1)


def _count_grams(batches):
    held: dict[str, list] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            grams, times = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(times.astype(np.int64))], names=["lang", "gram", "times"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            grams = _grams(_letters(text))
            held.setdefault(lang, []).append(grams)
            size += len(grams)
            if size >= 1 << 22:
                yield from flush()
                size = 0
    yield from flush()


def _predict(shared):
    def run(batches):
        known, langs, ranks = shared.value
        for batch in batches:
            found, score = [], []
            for text in batch.column(2).to_pylist():
                grams = profile(text or "")
                if not len(grams) or not langs:
                    found.append("und")
                    score.append(0.0)
                    continue
                d = out_of_place(grams, known, ranks)
                best = int(np.argmin(d))
                found.append(langs[best])
                score.append(1.0 - float(d[best]) / (MOST * len(grams)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def language_profiles(spark: SparkSession, docs: DataFrame, folds: int = 4, fold: int = 2):
    """(n-grams, languages, ranks) from all documents with text and language whose fold is not held out."""
    shared_dir(spark)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where("lang is not null and text is not null").where(~held_out(folds, fold)).select("lang", "text")
    grams = known.mapInArrow(_count_grams, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("times"), "gram")) - 1
    rows = grams.withColumn("rank", rank).where(F.col("rank") < MOST).collect()  # MOST rows a language
    langs = sorted({r.lang for r in rows})
    ranked = np.array(sorted({r.gram for r in rows}), np.int64)
    ranks = np.full((len(langs), len(ranked) + 1), MOST, np.int16)
    for r in rows:
        ranks[langs.index(r.lang), np.searchsorted(ranked, r.gram)] = r["rank"]
    return ranked, langs, ranks


def identify_language(spark: SparkSession, docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per row of ``docs``.

    score: 1 - distance / the largest possible, from 0 to 1. Texts that are null or have no letter are ``und`` with
    score 0, and so are all if no document teaches a language. Null ids count as held out. Repeated rows each count.
    Other columns are not read.
    """
    shared = spark.sparkContext.broadcast(language_profiles(spark, docs, folds, fold))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", held_out(folds, fold).alias("held_out"), "text")
    return rows.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")
