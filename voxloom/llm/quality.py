"""Quality scores from a weak-label model.

Heuristic labellers vote 1 (good), -1 (bad) or 0 (abstain) on a whole text; they overlap, and none is trusted. Most
know one symptom of bad texts and abstain without it, since texts are bad in ways that exclude each other.
Expectation-maximisation over the counts of all vote patterns estimates each one's accuracy, and the posteriors of a
bounded sample train a logistic scorer over hashed word shapes. No label, id, language or source is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _U, distinct, mix, shared_dir, word_hashes, written
from .toxicity import batches_of, label_model

SAMPLE_ROWS = 8000
SLOTS = 1 << 14
LABELLERS = ("symbols", "capitals", "bars", "repeats", "doubled", "stops", "prose")

#: Bytes to classes of shape: a small letter or part of a longer character, A capital, 0 digit, the rest themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


_LETTER, _SYMBOL, _STOP = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (bytes([*range(65, 91), *range(97, 123), *range(128, 256)]), b"#$%&*@^~<>=_+{}[]\\", b".!?"))


def measures(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of figures of all texts for each measure."""
    texts = len(bounds) - 1
    words, first = word_hashes(data, bounds)
    n_words = np.diff(first)

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(mask), bounds)).astype(float)

    size = np.maximum(1, np.diff(bounds)).astype(float)
    letters = count(_LETTER[data])
    symbols = count(_SYMBOL[data])
    capitals = count((data >= 65) & (data <= 90))
    bars = count(data == 124)
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[first[:-1][n_words > 0]] = False
    kinds = np.array([len(distinct(words[u:v])) if v > u else 0 for u, v in zip(first[:-1].tolist(), first[1:].tolist())], float)
    stops = count(_STOP[data])
    per = np.maximum(1, n_words).astype(float)
    return np.stack([symbols / size, capitals / np.maximum(1, letters), bars / per, kinds / per, np.diff(np.searchsorted(np.flatnonzero(same), first)) / per, stops / per, n_words.astype(float)]).reshape(7, texts)


def shapes(data: np.ndarray, bounds: np.ndarray):
    """(shape slots of words, their texts): equal classes in a row count once."""
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[bounds[(bounds > 0) & (bounds < len(shape))]] = True
    at = np.searchsorted(np.flatnonzero(keep), bounds)
    shape = shape[keep]
    shape[shape == 65] = 1
    hashes, start = word_hashes(shape, at)
    return (mix(hashes) & _U(SLOTS - 1)).astype(np.int64), np.repeat(np.arange(len(bounds) - 1), np.diff(start))


def votes(m: np.ndarray) -> np.ndarray:
    symbols, capitals, bars, kinds, doubled, stops, n = m
    out = np.zeros((m.shape[1], len(LABELLERS)), np.int8)

    few = 0.35 - 0.02 * np.log2(np.maximum(1, n / 64))
    symptoms = (symbols > 0.05, capitals > 0.4, bars > 0.1, (n >= 20) & (kinds < few), doubled > 0.1, (n >= 20) & ((stops < 0.01) | (stops > 0.6)))
    for j, bad in enumerate(symptoms):
        out[:, j] = np.where(bad, -1, 0)
    out[:, 6] = (symbols < 0.01) & (capitals < 0.15) & (bars == 0) & (stops >= 0.02) & (stops <= 0.5) & (doubled < 0.03) & ((kinds > few) | (n < 20))
    out[n == 0] = -1
    return out


def _features(m: np.ndarray, slots: np.ndarray, owner: np.ndarray):
    """Sparse rows: hashed shapes by their share of the words, and the doubled and distinct words in eighths."""
    texts = m.shape[1]
    pairs, times = np.unique(owner * SLOTS + slots, return_counts=True)
    row, col = pairs // SLOTS, pairs % SLOTS
    val = times / np.maximum(1, m[6])[row]
    bins = [(SLOTS + 16 * k + np.minimum(15, np.floor(np.sqrt(np.clip(x, 0, 1)) * 16)).astype(np.int64)) for k, x in enumerate((m[3], m[4], m[0], m[1], m[2]))]
    every = np.arange(texts)
    return np.concatenate([row, *[every] * len(bins)]), np.concatenate([col, *bins]), np.concatenate([val, *[np.ones(texts)] * len(bins)])


WIDTH = SLOTS + 16 * 5


def fit(rows, cols, vals, target, rounds: int = 300, l2: float = 1e-4) -> np.ndarray:
    w, g2 = np.zeros(WIDTH + 1), np.full(WIDTH + 1, 1e-8)
    n = max(1, len(target))
    for _ in range(rounds):
        z = np.bincount(rows, vals * w[cols], minlength=len(target)) + w[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g = np.append(np.bincount(cols, vals * d[rows], minlength=WIDTH) + l2 * w[:-1], d.sum())
        g2 += g * g
        w -= 0.2 * g / np.sqrt(g2)
    return w


def score(data: np.ndarray, bounds: np.ndarray, w: np.ndarray) -> np.ndarray:
    """0 to 1; 0 of texts without words."""
    m = measures(data, bounds)
    rows, cols, vals = _features(m, *shapes(data, bounds))
    return (m[6] > 0) / (1 + np.exp(-np.clip(np.bincount(rows, vals * w[cols], minlength=m.shape[1]) + w[-1], -30, 30)))


def _count(batches):
    seen: dict[bytes, int] = {}
    for batch in batches:
        for data, bounds in batches_of(batch.column(0)):
            rows, times = np.unique(votes(measures(data, bounds)), axis=0, return_counts=True)
            for r, t in zip(rows, times):
                seen[r.tobytes()] = seen.get(r.tobytes(), 0) + int(t)
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "times"])


def quality_model(spark: SparkSession, docs: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """(weights, report) of a scorer; the sample is at most ``sample_rows`` rows with the smallest hashes of doc_id."""
    shared_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = docs.select("text").mapInArrow(_count, "pattern binary, times long").groupBy("pattern").agg(F.sum("times").alias("times")).collect()  # 3 ** labellers rows at most
    patterns = np.array([np.frombuffer(bytes(r[0]), np.int8) for r in counted], np.int8).reshape(-1, len(LABELLERS))
    times = np.array([r[1] for r in counted], float)
    bad, accuracy, correlation = label_model(-patterns, times, 0.15, silence=False)
    good = {p.tobytes(): 1 - float(x) for p, x in zip(patterns, bad)}
    chance = min(1.0, 1.5 * sample_rows / max(1.0, times.sum()))
    ids = docs.select("doc_id").where("doc_id is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(chance * (1 << 20)) + 1).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = written(spark, docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")), "sample")

    def fit_task(batches):
        rows, cols, vals, target, at = [], [], [], [], 0
        for batch in batches:
            for data, bounds in batches_of(batch.column(0)):
                m = measures(data, bounds)
                r, c, v = _features(m, *shapes(data, bounds))
                rows.append(r + at)
                cols.append(c)
                vals.append(v)
                target += [good.get(x.tobytes(), 0.5) for x in votes(m)]
                at += m.shape[1]
        if target:
            w = fit(np.concatenate(rows), np.concatenate(cols), np.concatenate(vals), np.array(target))
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["weights"])

    fitted = sample.coalesce(1).select("text").mapInArrow(fit_task, "weights binary").collect()
    weights = np.frombuffer(bytes(fitted[0][0]), np.float64) if fitted else np.zeros(WIDTH + 1)
    return weights, {"labellers": LABELLERS, "accuracy": accuracy, "correlation": correlation}


def score_quality(spark: SparkSession, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, keep): one row per row of ``docs``; score from 0 to 1, higher is better, keep: score >= threshold.

    Null and empty texts, and texts without words, score 0 and are not kept. Null and repeated ids stay as they are.
    Other columns are not read.
    """
    weights, _ = quality_model(spark, docs)
    shared = spark.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            out = [score(data, bounds, shared.value) for data, bounds in batches_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.empty(0))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("keep", F.col("score") >= threshold)
