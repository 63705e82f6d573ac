"""Spelling variants of the corpus vocabulary, by search schemes over a bidirectional FM-index.

The vocabulary's words, each between delimiters, are indexed twice: an FM-index of the words and one of the reversed
words, so that a pattern grows to either side. A word of L code points is cut at L // 2. One scheme matches the
delimiter and the first half exactly and goes on to the right, the other matches the second half and the delimiter and
goes on to the left; each allows one inserted, deleted or replaced code point on the way across the other half and ends
at the other delimiter. A pattern is an interval of suffix ranks, narrowed one code point at a time.

Sorted by code points, all words that begin with a half are neighbours. So the vocabulary is cut into ranges of about
BLOCK words, sorted forward for one scheme and reversed for the other, each range is an index, and a word is looked for
in the ranges that its half's words lie in: no word meets the whole vocabulary. A range is one group, with the words
asked for cut into parts of about ASKED.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits, shared_dir, written
from .url_filter import LOWER, UPPER

BLOCK, ASKED = 20_000, 60_000
#: Of intervals up to so many rows, the code points that can follow are read off; of larger ones all are tried.
FEW = 24


# --- the index of one range ---------------------------------------------------------------------


class Index:
    """FM-index of the reversals of sorted, distinct ``words``: a pattern grows to the right of what it matches.

    Suffixes are compared up to their delimiter, equal ones by the word's number; as the words are sorted, a delimiter's
    rank is the number of the word behind it, and a step across a delimiter is a step like any other.
    """

    def __init__(self, words: list[str]):
        self.n = len(words)
        points = _points("\0".join(["", *words, ""]))
        size = len(points)
        self.alphabet = np.unique(points)
        if self.alphabet[0] != 0:
            raise ValueError("a word holds a NUL")
        text = np.searchsorted(self.alphabet, points)
        delimiters = np.flatnonzero(text == 0)
        rank = text + self.n
        rank[delimiters] = np.arange(self.n + 1)
        step = 1
        while True:  # by twice as many code points at each turn; delimiters differ, so no longer than the longest word
            behind = np.zeros(size, np.int64)
            behind[:-step] = rank[step:] + 1
            behind[rank <= self.n] = 0
            key = rank * (size + self.n + len(self.alphabet) + 2) + behind
            order = np.argsort(key, kind="stable")
            new = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
            done = new[-1] == size - 1
            rank = np.empty(size, np.int64)
            rank[order] = new
            if done:
                break
            step *= 2
        # delimiters keep the lowest ranks, so they are told from the others all the while
        self.before = np.where(order > 0, text[order - 1], len(self.alphabet))
        self.size = size
        self.keys = np.sort(self.before * size + np.arange(size))[:-1]  # the text's first suffix has nothing before it

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rank of the first suffix that begins with ``symbol`` and what suffixes from ``row`` on begin with."""
        return np.searchsorted(self.keys, symbol * self.size + row) + (symbol > 0)

    def following(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which interval, code point): all that can follow, delimiters apart."""
        count = high - low
        few = np.flatnonzero(count <= FEW)
        own = np.repeat(few, count[few])
        rows = np.arange(len(own)) - np.repeat(np.cumsum(count[few]) - count[few], count[few]) + low[own]
        symbols = len(self.alphabet) + 1
        read = np.unique(own * symbols + self.before[rows])
        read = read[(read % symbols > 0) & (read % symbols < symbols - 1)]
        many = np.flatnonzero(count > FEW)
        tried = (many[:, None] * symbols + np.arange(1, symbols - 1)).ravel()
        both = np.concatenate((read, tried))
        return both // symbols, both % symbols


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def near_words(index: Index, asked: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number in ``asked``, number of the indexed word): pairs one edit apart, the edit behind the first ``exact`` code points."""
    lengths = np.array([len(w) for w in asked], np.int64)
    start = np.cumsum(lengths) - lengths
    points = np.append(_points("".join(asked)), 0)
    codes = np.minimum(np.searchsorted(index.alphabet, points), len(index.alphabet) - 1)
    codes = np.where(index.alphabet[codes] == points, codes, -1)
    own = np.arange(len(asked))
    low, high = np.zeros(len(asked), np.int64), np.full(len(asked), index.n + 1)  # what a delimiter matches
    none = np.empty(0, np.int64)
    e_own, e_at, e_low, e_high = none, none, none, none  # with the edit made: word, code points matched, interval
    found_word, found = [], []
    at = 0
    while len(own) or len(e_own):
        # words that are still exact after ``at`` code points: make the edit here
        here = np.flatnonzero(exact[own] <= at)
        if len(here):
            q, lo, hi = own[here], low[here], high[here]
            ended = lengths[q] == at
            wanted = np.where(ended, -2, codes[start[q] + np.where(ended, 0, at)])
            which, symbol = index.following(lo, hi)
            to_lo, to_hi = index.step(symbol, lo[which]), index.step(symbol, hi[which])
            ok = (to_hi > to_lo) & (symbol != wanted[which])  # an inserted copy of the next code point is one inserted behind it
            which, to_lo, to_hi = which[ok], to_lo[ok], to_hi[ok]
            put = ~ended[which]
            last = lengths[q] == at + 1
            after = codes[start[q] + np.where(ended | last, 0, at + 1)]
            cut = np.flatnonzero(~ended & (last | (after != wanted) | (wanted < 0)))  # of equal ones the last is deleted
            e_own = np.concatenate((e_own, q[which], q[which[put]], q[cut]))
            e_at = np.concatenate((e_at, np.full(len(which), at), np.full(put.sum() + len(cut), at + 1)))
            e_low = np.concatenate((e_low, to_lo, to_lo[put], lo[cut]))
            e_high = np.concatenate((e_high, to_hi, to_hi[put], hi[cut]))
        on = np.flatnonzero(lengths[own] > at)
        own, low, high = own[on], low[on], high[on]
        symbol = codes[start[own] + at]
        ok = np.flatnonzero(symbol > 0)
        own, low, high, symbol = own[ok], low[ok], high[ok], symbol[ok]
        low, high = index.step(symbol, low), index.step(symbol, high)
        ok = np.flatnonzero(high > low)
        own, low, high = own[ok], low[ok], high[ok]
        at += 1
        # all that made their edit: one code point on, or the closing delimiter
        ended = e_at == lengths[e_own]
        symbol = np.where(ended, 0, codes[start[e_own] + np.where(ended, 0, e_at)])
        ok = np.flatnonzero(symbol >= 0)
        e_own, e_at, symbol, ended = e_own[ok], e_at[ok] + 1, symbol[ok], ended[ok]
        e_low, e_high = index.step(symbol, e_low[ok]), index.step(symbol, e_high[ok])
        ok = e_high > e_low
        hit, on = np.flatnonzero(ok & ended), np.flatnonzero(ok & ~ended)
        found_word.append(e_own[hit])
        found.append(e_low[hit])
        e_own, e_at, e_low, e_high = e_own[on], e_at[on], e_low[on], e_high[on]
    return np.concatenate((none, *found_word)), np.concatenate((none, *found))


# --- the vocabulary -----------------------------------------------------------------------------


def vocabulary(docs: DataFrame, least: int = 3, shortest: int = 5, slip: int | None = None, run: str = "[A-Za-zÀ-ÿ]+") -> DataFrame:
    """(word, n): the distinct runs of all whole texts, A-Z lower-cased, of at least ``shortest`` code points and ``least`` occurrences.

    ``slip``: a run of a document loses one code point if ``slip`` divides h = crc32 of ``<doc_id>:<run>``, that at
    h % length. A null doc_id counts as the empty text.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(f"({run})"), F.lit(1))).alias("run"))
    small = F.lower("run")
    word: Column = F.when(small == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER))
    runs = runs.select("doc", word.alias("word"))
    if slip:
        h = F.crc32(F.concat("doc", F.lit(":"), "word").cast("binary"))
        runs = runs.withColumn("h", h)
        place = (F.col("h") % F.length("word")).cast("int")
        without = F.concat(F.substring(F.col("word"), F.lit(1), place), F.substring(F.col("word"), place + 2, F.length("word")))
        runs = runs.select(F.when(F.col("h") % slip == 0, without).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word", "n")


# --- the search over ranges ---------------------------------------------------------------------


def _ask(side: int, starts: list[str], parts: int):
    """Rows for the ranges that a word's half, or its reversal, lies in."""

    def run(batches):
        for batch in batches:
            block, part, words = [], [], []
            for key in batch.column(0).to_pylist():
                half = key[: len(key) // 2] if side == 0 else key[: len(key) - len(key) // 2]
                first = max(0, bisect_right(starts, half) - 1)
                last = max(first + 1, bisect_left(starts, half + "\U0010ffff"))
                block += range(first, last)
                part += [hash_of(key) % parts] * (last - first)
                words += [key] * (last - first)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(part, pa.int32()), pa.array([True] * len(words)), pa.array(words, pa.string()), pa.nulls(len(words), pa.int64())], names=["block", "part", "asks", "key", "n"])

    return run


def hash_of(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def _search(side: int):
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy()
        keys = group["key"].to_pylist()
        times = group["n"].to_pylist()
        asked = [k for k, a in zip(keys, asks) if a]
        # the index holds reversals of what is asked: an index of reversals matches to the right
        held = sorted((k[::-1], n) for k, n, a in zip(keys, times, asks) if not a)
        if not asked or not held:
            return schema.empty_table()
        index = Index([w for w, _ in held])
        exact = np.array([len(k) // 2 if side == 0 else len(k) - len(k) // 2 for k in asked], np.int64)
        q, c = near_words(index, asked, exact)
        pairs = np.unique(q * index.n + c)
        q, c = (pairs // index.n).tolist(), (pairs % index.n).tolist()
        turn = (lambda w: w) if side == 0 else (lambda w: w[::-1])
        return pa.table({"word": pa.array([turn(asked[i]) for i in q], pa.string()), "near": pa.array([turn(held[j][0][::-1]) for j in c], pa.string()), "near_n": pa.array([held[j][1] for j in c], pa.int64())}, schema=schema)

    return run


def near_pairs(spark: SparkSession, words: DataFrame) -> DataFrame:
    """(word, near, near_n): both ways, all pairs of ``words`` (word, n; distinct) that one edit tells apart; a pair may come twice."""
    total = words.count()
    blocks = max(1, -(-total // BLOCK))
    out = None
    for side in (0, 1):
        key = F.col("word") if side == 0 else F.reverse("word")
        ranged = written(spark, words.select(key.alias("key"), "n").repartitionByRange(blocks, "key").select(F.spark_partition_id().alias("at"), "key", "n"), "ranges")
        starts = sorted((r.first, r.at) for r in ranged.groupBy("at").agg(F.min("key").alias("first")).collect())  # one row a range
        number = {at: k for k, (_, at) in enumerate(starts)}
        at = F.split(F.lit(",".join(str(number.get(k, 0)) for k in range(max(number, default=0) + 1))), ",").cast("array<int>")
        schema = "block int, part int, asks boolean, key string, n long"
        asked = written(spark, ranged.select("key").mapInArrow(_ask(side, [s for s, _ in starts], 1 << 20), schema), "asked")
        # of a range that many ask in, the words asked for are cut into parts, each with the range's index
        parts = fits(asked.groupBy("block").agg(F.count("*").alias("asking")).select("block", F.ceil(F.col("asking") / ASKED).cast("int").alias("parts")))
        asked = asked.join(parts, "block").withColumn("part", F.col("part") % F.col("parts")).select("block", "part", "asks", "key", "n")
        held = ranged.select(F.get(at, F.col("at")).alias("block"), "key", "n").join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), "key", "n")
        found = held.union(asked).groupBy("block", "part").applyInArrow(_search(side), "word string, near string, near_n long")
        out = found if out is None else out.union(found)
    return out


def spelling_variants(spark: SparkSession, docs: DataFrame, least: int = 3, shortest: int = 5, slip: int | None = None, factor: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root): one row for each word of the vocabulary of all whole texts.

    near: words that exactly one inserted, deleted or replaced code point tells apart. form: the near word of largest n
    (ties: smallest in code-point order), if that is at least ``factor`` * n, else null. root: from the word along forms
    to the last; the word itself if it has no form. Null and empty texts have no words; repeated rows each count; a
    document's id matters only with ``slip`` (see ``vocabulary``), where null is the empty text. No words: no rows.
    Other columns are not read. A word may have any length.
    """
    shared_dir(spark)
    words = written(spark, vocabulary(docs, least, shortest, slip), "vocabulary")
    near = near_pairs(spark, words)
    best = near.groupBy("word").agg(F.size(F.collect_set("near")).cast("long").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    enough = -F.col("best.less") >= factor * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    rows = written(spark, rows, "forms")
    # pointer jumping: n at least doubles along forms, so chains are short
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        roots = written(spark, roots, "roots")
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(on, "root", "left_semi").isEmpty():
            break
        roots = roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
