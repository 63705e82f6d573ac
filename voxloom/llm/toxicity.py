"""Toxicity by weak supervision: voters, a generative label model, a hashed linear classifier.

1. *Voters.* A fixed lexicon and shout pattern, and lexicons of words and word beginnings that mostly toxic rows
   of a bounded sample of labelled rows have. Each votes 1 (toxic), -1 (clean) or 0 (abstains) on a whole text.
2. *Label model.* The votes of all training documents, labelled or not, are counted by vote pattern (an aggregation
   of at most 3 ** voters rows). Expectation-maximisation estimates each voter's distribution of votes by class; the
   correlations that remain between voters given the class weight down voters that repeat each other.
3. *Classifier.* A logistic model over hashed words and word beginnings is fitted to the posteriors of the sample.
   Features are counted and chosen by aggregations over the sample; the one task that fits holds for each row only the
   chosen ones, so long texts are never together in one place.

No score reads doc_id, lang, source or a label. Rows with crc32(doc_id as text) mod ``folds`` = ``held_out`` teach
nothing: they are neither in the sample nor in the counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE_LOWER, _U, _powers, drop, mix, shared_dir, slices, written

#: At most so many labelled rows are fitted on.
SAMPLE_ROWS = 8000
SLOTS = 1 << 18
BEGINNINGS = (5, 6, 7, 8)
INSULTS = (
    "idiot idiots moron morons stupid dumb fool loser losers scum trash garbage filth worthless pathetic disgusting "
    "clown ugly hate vermin imbecile coward liar parasite jerk creep freak"
).split()
VOTERS = ("insults", "shouts", "words", *(f"begins{k}" for k in BEGINNINGS))

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FIXED = {w.encode() for w in INSULTS}


def features(data: np.ndarray, bounds: np.ndarray):
    """(slots by kind, text of each word, words in each text): kind 0 whole words, then beginnings (-1: shorter word)."""
    n = len(data)
    inside = _LETTER[data]
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = bounds[(bounds > 0) & (bounds < n)]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    powers, inverses = _powers(max(n, 1))
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE_LOWER[data] * powers[:n], out=sums[1:])
    out = [(mix((sums[e] - sums[s]) * inverses[s] + (e - s).astype(_U)) & _U(SLOTS - 1)).astype(np.int32)]
    for k in BEGINNINGS:
        long = e - s >= k
        h = (mix((sums[np.minimum(s + k, n)] - sums[s]) * inverses[s] + _U(1000 + k)) & _U(SLOTS - 1)).astype(np.int32)
        out.append(np.where(long, h, -1))
    first = np.searchsorted(s, bounds)
    return out, np.repeat(np.arange(len(bounds) - 1), np.diff(first)), np.diff(first)


_INSULT_SLOTS = np.unique(np.concatenate([features(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0] for w in sorted(_FIXED)]))


def batches_of(column, at_once: int = 1 << 19):
    """(data, bounds) of consecutive texts of an Arrow string array; nulls count as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    for a, b in slices(np.diff(offsets), at_once):
        yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


WIDTH = (1 + len(BEGINNINGS)) * SLOTS
#: Targets are summed as whole numbers of this many to one, so that sums are equal whatever their order.
UNIT = 1 << 20


def bags(data: np.ndarray, bounds: np.ndarray):
    """(text, feature, times): how often each text has each feature; features count on over the kinds."""
    kinds, owner, _ = features(data, bounds)
    out = []
    for k, slots in enumerate(kinds):
        ok = slots >= 0
        pairs, times = np.unique(owner[ok].astype(np.int64) * SLOTS + slots[ok], return_counts=True)
        out.append((pairs // SLOTS, pairs % SLOTS + k * SLOTS, times))
    return tuple(np.concatenate(x) for x in zip(*out))


def _tally(target_of):
    """From (toxic, text): in how many texts of the task each feature is, and the sum of their targets; feature WIDTH is in all."""

    def run(batches):
        has, mass = np.zeros(WIDTH + 1, np.int64), np.zeros(WIDTH + 1, np.int64)
        for batch in batches:
            at, toxic = 0, batch.column(0).to_numpy()
            for data, bounds in batches_of(batch.column(1)):
                n = len(bounds) - 1
                target = np.round(target_of(toxic[at : at + n], data, bounds) * UNIT).astype(np.int64)
                at += n
                row, col, _ = bags(data, bounds)
                has += np.bincount(col, minlength=WIDTH + 1)
                mass += np.round(np.bincount(col, target[row], minlength=WIDTH + 1)).astype(np.int64)
                has[-1] += n
                mass[-1] += target.sum()
        used = np.flatnonzero(has)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(has[used]), pa.array(mass[used])], names=["feature", "has", "mass"])

    return run


def _tallied(sample: DataFrame, target_of) -> DataFrame:
    """(feature, has, mass) over the whole sample."""
    parts = sample.select("toxic", "text").mapInArrow(_tally(target_of), "feature int, has long, mass long")
    return parts.groupBy("feature").agg(F.sum("has").alias("has"), F.sum("mass").alias("mass"))


def learned(sample: DataFrame, least: int = 6, share: float = 0.85) -> list[np.ndarray]:
    """For each kind of feature the slots that at least ``least`` toxic texts have, and ``share`` of all that have them."""
    counts = _tallied(sample, lambda toxic, data, bounds: toxic.astype(float))
    chosen = counts.where((F.col("feature") < WIDTH) & (F.col("mass") >= least * UNIT) & (F.col("mass") >= share * UNIT * F.col("has")))
    cols = np.array(sorted(r.feature for r in chosen.select("feature").collect()), np.int64)  # WIDTH rows at most
    return [(cols[cols // SLOTS == k] % SLOTS).astype(np.int32) for k in range(1 + len(BEGINNINGS))]


def hits(kinds: list[np.ndarray], owner: np.ndarray, texts: int, lexicons: list[np.ndarray]) -> list[np.ndarray]:
    """For each lexicon the distinct members of it that each text has."""
    out = []
    for slots, lexicon in zip(kinds, lexicons):
        table = np.zeros(SLOTS + 1, bool)
        table[lexicon] = True
        found = table[slots]
        pairs = np.unique(owner[found].astype(np.int64) * SLOTS + slots[found])
        out.append(np.bincount(pairs // SLOTS, minlength=texts))
    return out


#: Hits of a lexicon are told apart up to so many.
MOST_HITS = 20


def enough(sample: DataFrame, lexicons: list[np.ndarray], precision: float = 0.85, least: int = 4) -> np.ndarray:
    """For each learned lexicon the fewest members by which a text is toxic in ``precision`` of the sample's cases."""

    def run(batches):
        seen = np.zeros((len(lexicons), MOST_HITS + 1, 2), np.int64)
        for batch in batches:
            at, toxic = 0, batch.column(0).to_numpy()
            for data, bounds in batches_of(batch.column(1)):
                kinds, owner, _ = features(data, bounds)
                n = len(bounds) - 1
                for k, h in enumerate(hits(kinds, owner, n, lexicons)):
                    np.add.at(seen[k], (np.minimum(h, MOST_HITS), toxic[at : at + n]), 1)
                at += n
        k, h, c = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (k, h, c, seen[k, h, c])], names=["k", "hits", "toxic", "n"])

    found = sample.select("toxic", "text").mapInArrow(run, "k long, hits long, toxic long, n long").groupBy("k", "hits", "toxic").agg(F.sum("n").alias("n")).collect()  # a few hundred rows
    counts = np.zeros((len(lexicons), MOST_HITS + 1, 2))
    for r in found:
        counts[r.k, r.hits, r.toxic] = r.n
    beyond = counts[:, ::-1].cumsum(1)[:, ::-1]
    ok = (beyond.sum(2) >= least) & (beyond[:, :, 1] >= precision * beyond.sum(2))
    ok[:, 0] = False
    return np.where(ok.any(1), ok.argmax(1), 99).astype(np.int32)


def votes(data: np.ndarray, bounds: np.ndarray, lexicons: list[np.ndarray], needed: np.ndarray) -> np.ndarray:
    """An array of -1, 0, 1: texts by VOTERS. A lexicon's vote is 1 from ``needed`` members on, -1 without any."""
    kinds, owner, _ = features(data, bounds)
    texts = len(bounds) - 1
    out = np.zeros((texts, len(VOTERS)), np.int8)
    insults = np.bincount(owner[np.isin(kinds[0], _INSULT_SLOTS)], minlength=texts)
    out[:, 0] = np.where(insults >= 2, 1, np.where(insults == 0, -1, 0))
    upper = np.cumsum(np.append(0, (data >= 65) & (data <= 90)))
    bangs = np.cumsum(np.append(0, data == 33))
    a, b = bounds[:-1], bounds[1:]
    out[:, 1] = (bangs[b] - bangs[a] > 3) & ((upper[b] - upper[a]) * 3 > b - a)
    for j, (h, need) in enumerate(zip(hits(kinds, owner, texts, lexicons), needed), 2):
        out[:, j] = np.where(h >= need, 1, np.where(h == 0, -1, 0))
    return out


def label_model(patterns: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 60, silence: bool = True):
    """Posterior of class 1 for each vote pattern, with the voters' accuracies and correlations.

    patterns: distinct rows of votes; counts: how often each occurs; prior: the first guess of class 1's share;
    silence: whether an abstention tells the classes apart. False is for voters that each know one symptom only, which
    exclude each other; then no voter is weighed down for its correlations either.
    """
    patterns = patterns.astype(np.int64)
    m = patterns.shape[1]
    total = max(1.0, float(counts.sum()))
    score = (patterns == 1).sum(1) - 0.5 * (patterns == -1).sum(1)
    post = np.where(score > 0, 0.9, 0.05)
    weight, pi = np.ones(m), prior
    correlation = np.eye(m)
    for _ in range(rounds):
        w1, w0 = counts * post, counts * (1 - post)
        theta = np.empty((2, m, 3))
        for v in (-1, 0, 1):
            hit = patterns == v
            theta[1, :, v + 1] = (w1 @ hit + 0.1) / (w1.sum() + 0.3)
            theta[0, :, v + 1] = (w0 @ hit + 0.1) / (w0.sum() + 0.3)
        pi = min(0.5, max(1e-4, w1.sum() / total))
        # what correlation is left given the class
        residual = np.zeros((m, m))
        for w, c in ((w1, 1), (w0, 0)):
            mean = theta[c, :, 2] - theta[c, :, 0]
            r = patterns - mean
            residual += (r * w[:, None]).T @ r
        scale = np.sqrt(np.maximum(np.diag(residual), 1e-9))
        correlation = residual / np.outer(scale, scale)
        weight = weight if not silence else 1 / np.maximum(1.0, np.abs(np.where(np.eye(m, dtype=bool), 1.0, correlation)).sum(1))
        tells = np.ones(patterns.shape) if silence else patterns != 0
        logit = np.log(pi / (1 - pi)) + sum(weight[j] * tells[:, j] * (np.log(theta[1, j, patterns[:, j] + 1]) - np.log(theta[0, j, patterns[:, j] + 1])) for j in range(m))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max(initial=0) < 1e-7:
            post = new
            break
        post = new
    accuracy = np.where(theta[1, :, 2] + theta[0, :, 0] > 0, (pi * theta[1, :, 2] + (1 - pi) * theta[0, :, 0]) / np.maximum(1e-12, pi * (theta[1, :, 2] + theta[1, :, 0]) + (1 - pi) * (theta[0, :, 2] + theta[0, :, 0])), 0)
    return post, accuracy, correlation


def telling(counts: DataFrame, least: int = 3) -> list[int]:
    """The features whose odds between the classes stand out by 3 standard errors; ``counts`` as of ``_tallied``."""
    total = counts.where(F.col("feature") == WIDTH).first()
    if total is None:
        return []
    one, every = total.mass / UNIT, total.has
    a = F.col("mass") / UNIT + 0.5
    b = F.col("has") - F.col("mass") / UNIT + 0.5
    odds = F.abs(F.log(a) - F.log(F.lit(one + 1.0)) - F.log(b) + F.log(F.lit(every - one + 1.0)))
    chosen = counts.where((F.col("feature") < WIDTH) & (F.col("has") >= least) & (odds > 3 * F.sqrt(1 / a + 1 / b)) & (odds > 1))
    return sorted(r.feature for r in chosen.select("feature").collect())  # WIDTH rows at most


def _bagged(target_of, chosen: np.ndarray):
    """From (toxic, text): each text's target and its chosen features (places in ``chosen``) with ``log(1 + times)``."""

    def run(batches):
        for batch in batches:
            at, toxic = 0, batch.column(0).to_numpy()
            for data, bounds in batches_of(batch.column(1)):
                n = len(bounds) - 1
                target = target_of(toxic[at : at + n], data, bounds)
                at += n
                row, col, times = bags(data, bounds)
                place = np.minimum(np.searchsorted(chosen, col), max(0, len(chosen) - 1))
                keep = chosen[place] == col if len(chosen) else np.zeros(len(col), bool)
                row, place, value = row[keep], place[keep], np.log1p(times[keep]).astype(np.float32)
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(n + 1))
                place, value = place[order].astype(np.int32), value[order]
                yield pa.RecordBatch.from_arrays([pa.array(target.astype(float)), *(pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for x in (place, value))], names=["target", "places", "bag"])

    return run


def _fit_task(features: int):
    def run(batches):
        target, col, val = [], [], []
        for batch in batches:
            target.append(batch.column(0).to_numpy())
            col += [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
            val += [np.frombuffer(x, np.float32) for x in batch.column(2).to_pylist()]
        if target:
            row = np.repeat(np.arange(len(col)), [len(x) for x in col])
            w = fit(row, np.concatenate(col), np.concatenate(val), np.concatenate(target), features)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["weights"])

    return run


def fit(row, col, val, target: np.ndarray, features: int, rounds: int = 400, l2: float = 1e-4) -> np.ndarray:
    """Weights of the features and, last, a bias: logistic loss against soft targets, full-batch Adagrad."""
    n = max(1, len(target))
    w, bias, g2, b2 = np.zeros(features), -2.0, np.full(features, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, val * w[col], minlength=len(target)) + bias
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g = np.bincount(col, val * d[row], minlength=features) + l2 * w
        g2 += g * g
        b2 += d.sum() ** 2
        w -= 0.3 * g / np.sqrt(g2)
        bias -= 0.3 * d.sum() / np.sqrt(b2)
    return np.append(w, bias)


def linear(data: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    kinds, owner, _ = features(data, bounds)
    texts = len(bounds) - 1
    total = np.full(texts, float(weights[-1]))
    for k, slots in enumerate(kinds):
        own = np.append(weights[k * SLOTS : (k + 1) * SLOTS], np.float32(0))
        hit = np.flatnonzero(own[slots])
        pairs, times = np.unique(owner[hit].astype(np.int64) * SLOTS + slots[hit], return_counts=True)
        total += np.bincount(pairs // SLOTS, np.log1p(times) * own[pairs % SLOTS], minlength=texts)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def held_out(folds: int, fold: int):
    """Whether crc32 of doc_id as text falls on the fold kept out of training; a null doc_id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def _votes_task(lexicons):
    def run(batches):
        seen: dict[bytes, int] = {}
        for batch in batches:
            for data, bounds in batches_of(batch.column(0)):
                rows, times = np.unique(votes(data, bounds, *lexicons.value), axis=0, return_counts=True)
                for r, t in zip(rows, times):
                    seen[r.tobytes()] = seen.get(r.tobytes(), 0) + int(t)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "times"])

    return run


def _score_task(weights):
    def run(batches):
        for batch in batches:
            scores = [linear(data, bounds, weights.value) for data, bounds in batches_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(scores) if scores else np.empty(0))], names=["doc_id", "held_out", "score"])

    return run


def toxicity_model(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, sample_rows: int = SAMPLE_ROWS):
    """(weights, report): the fitted classifier and the voters' accuracies and correlations.

    With no labelled rows of both classes only the fixed voters speak.
    """
    shared_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(folds, fold))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = written(spark, docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")), "sample")

    lexicons = learned(sample)
    needed = enough(sample, lexicons)
    shared = spark.sparkContext.broadcast((lexicons, needed))
    counted = docs.where(~held_out(folds, fold)).select("text").mapInArrow(_votes_task(shared), "pattern binary, times long").groupBy("pattern").agg(F.sum("times").alias("times")).collect()  # 3 ** voters rows at most
    patterns = np.array([np.frombuffer(bytes(r[0]), np.int8) for r in counted], np.int8).reshape(-1, len(VOTERS))
    post, accuracy, correlation = label_model(patterns, np.array([r[1] for r in counted], float), 0.1)
    known_post = {p.tobytes(): float(x) for p, x in zip(patterns, post)}

    def posterior(_, data, bounds):
        return np.array([known_post.get(r.tobytes(), 0.0) for r in votes(data, bounds, *shared.value)])

    tally = written(spark, _tallied(sample, posterior), "tally")
    chosen = np.array(telling(tally), np.int64)
    bagged = sample.select("toxic", "text").mapInArrow(_bagged(posterior, chosen), "target double, places binary, bag binary")
    fitted = bagged.repartition(1).mapInArrow(_fit_task(len(chosen)), "weights binary").collect()  # SAMPLE_ROWS rows, chosen features only
    weights = np.zeros(WIDTH + 1, np.float32)
    weights[-1] = -3
    if fitted:
        w = np.frombuffer(bytes(fitted[0][0]), np.float64)
        weights[chosen], weights[-1] = w[:-1], w[-1]
    drop(spark, sample, tally)
    return weights, {"voters": VOTERS, "accuracy": accuracy, "correlation": correlation, "patterns": len(patterns)}


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, fold: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``.

    Null or empty texts get the score of a text without words. Labels with null ids or classes, and repeated ones
    (the larger class holds), are harmless; other columns of both tables are not read.
    """
    weights, _ = toxicity_model(spark, docs, labels, folds, fold)
    shared = spark.sparkContext.broadcast(weights)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", held_out(folds, fold).alias("held_out"), "text")
    scored = rows.mapInArrow(_score_task(shared), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, fold: int = 1) -> DataFrame:
    """The rows of ``docs`` whose text scores under ``threshold``, all columns as they were."""
    weights, _ = toxicity_model(spark, docs, labels, folds, fold)
    shared = spark.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            scores = [linear(data, bounds, shared.value) for data, bounds in batches_of(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate(scores) < threshold)) if scores else batch

    return docs.mapInArrow(run, docs.schema)
