"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

A text becomes tokens: what stands between characters other than letters, digits and sentence ends, without trailing
sentence ends; digits and a letter behind them are parted ("5km"). A token's canonical form is a typed placeholder where
it is a number, a unit or a name (a capital letter before a small one, wherever it stands), else its lower-cased self. A
run of names, or of numbers, is one placeholder, so "New York" may stand for "Paris" and "1,234" for "950". Windows of
``window`` canonical tokens of each item are hashed and joined by equality with all windows of all documents, so a
question whose numbers, names or units were exchanged still meets its template. Windows with under ``least_plain``
tokens that are no placeholders identify nothing and are left out. An item shorter than ``window`` is one window of its
whole length. An item without any such window ("What is 12 + 7?") is looked for word by word instead: windows of its
lower-cased tokens as they are; under ``least_plain`` tokens it identifies nothing.

Slot consistency: matches of one item in one document at one offset are an occurrence of its template. Its slots
pair the item's values with the document's; if a value stands for two others more often than ``slack`` slots, the
template met by chance and the occurrence does not count. A document leaks an item if the windows of consistent
occurrences are at least ``coverage`` of the item's, or ``enough`` windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits, shared_dir, written

UNITS = "mm cm m km kg g mg lb lbs oz ft inch inches mile miles meter meters metre metres liter liters litre litres ml second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur".split()


def _barrier(df: DataFrame, keep: list[str], value: Column, name: str) -> DataFrame:
    """``value`` computed once a row, whatever reads it above: a generator is not inlined into lambdas."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def tokens(texts: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, raw): the tokens, with their sentence ends."""
    raw = F.filter(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}.!?]+|(?<=[0-9])(?=\p{L})"), lambda t: F.rtrim(t, F.lit(".!?")) != "")
    return _barrier(texts, keep, raw, "raw")


def _lower(t: Column) -> Column:
    return F.lower(F.rtrim(t, F.lit(".!?")))


def _code(t: Column) -> Column:
    """1 number, 2 unit, 3 name, else a hash of the lower-cased token."""
    core = F.rtrim(t, F.lit(".!?"))
    low = F.lower(core)
    return (
        F.when((core < ":") & (F.translate(core, "0123456789.", "") == ""), F.lit(1))
        .when(low.isin(UNITS), F.lit(2))
        .when((core != low) & (F.substring(core, 1, 1) != F.substring(low, 1, 1)) & (F.substring(core, 2, 1) == F.substring(low, 2, 1)) & (F.length(core) > 1), F.lit(3))
        .otherwise(F.xxhash64(low))
        .cast("long")
    )


def _begins(c: Column, i: Column) -> Column:
    """Whether the code ``c`` at place ``i`` of ``each`` does not go on a run of numbers or names."""
    return ~(c.isin(1, 3) & F.coalesce(F.get("each", i - 1) == c, F.lit(False)))


def canonical(texts: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, codes) of texts."""
    each = _barrier(tokens(texts, keep), keep, F.transform("raw", _code), "each")
    return _barrier(each, keep, F.filter("each", _begins), "codes")


def verbatim(texts: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, codes): hashes of the lower-cased tokens, without placeholders."""
    return _barrier(tokens(texts, keep), keep, F.transform("raw", lambda t: F.xxhash64(_lower(t))), "codes")


def valued(texts: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, codes, values): as ``canonical``, with what each code stands for."""
    both = tokens(texts, keep).select(*keep, F.transform("raw", _lower).alias("low"), F.transform("raw", _code).alias("each"))
    at = F.when(F.size("each") > 0, F.filter(F.sequence(F.lit(0), F.size("each") - 1), lambda i: _begins(F.get("each", i), i))).otherwise(F.array().cast("array<int>"))
    both = _barrier(both, [*keep, "low", "each"], at, "at")
    value = F.transform("at", lambda i, k: F.array_join(F.slice("low", i + 1, F.coalesce(F.get("at", k + 1), F.size("low")) - i), " "))
    return both.select(*keep, F.transform("at", lambda i: F.get("each", i)).alias("codes"), value.alias("values"))


def _windows(df: DataFrame, keep: list[str], length: int, pos: str) -> DataFrame:
    """(keep, pos, h): each window of ``length`` codes from position ``pos`` (0 first)."""
    hashes = F.when(F.size("codes") >= length, F.transform(F.sequence(F.lit(1), F.size("codes") - length + 1), lambda i: F.xxhash64(F.slice("codes", i, length))))
    return df.select(*keep, F.posexplode(hashes).alias(pos, "h"))


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, at, length, h, codes): windows of ``window`` codes, of shorter items their whole length."""
    lengths = {window} | {r[0] for r in items.where(F.size("codes") < window).select(F.size("codes").alias("n")).distinct().collect()}  # under window values
    own = None
    for length in sorted(lengths):
        some = items.where(F.size("codes") >= window if length == window else F.size("codes") == length)
        part = _windows(some, ["item_id", "codes"], length, "at").withColumn("length", F.lit(length))
        own = part if own is None else own.union(part)
    return own


def _matches(coded: DataFrame, own: DataFrame) -> DataFrame:
    """(doc_id, item_id, pos, at, length): where windows ``own`` of items stand in documents."""
    found = None
    for length in sorted(r[0] for r in own.select("length").distinct().collect()):  # under window values
        mine = fits(own.where(F.col("length") == length).select("h", "item_id", "at", "length"))
        part = _windows(coded, ["doc_id"], length, "pos").join(mine, "h").select("doc_id", "item_id", "pos", "at", "length")
        found = part if found is None else found.union(part)
    return found.distinct()


def benchmark_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 8, least_plain: int = 3, coverage: float = 0.5, enough: int = 12, slack: int = 1) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, coverage, verbatim): one row per document and item that it leaks.

    verbatim: all slots have the item's own values. Documents with a null doc_id, null or empty texts or no tokens,
    and items with a null id or under ``least_plain`` tokens, give no rows. Repeated rows of a doc_id or item_id count
    as one. Other columns are not read.
    """
    shared_dir(spark)
    schema = "doc_id long, item_id long, windows long, item_windows long, coverage double, verbatim boolean"
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    texts = texts.groupBy("item_id").agg(F.min("text").alias("text"))
    items = written(spark, valued(texts, ["item_id"]).where(F.size("codes") > 0), "items")
    plain = F.size(F.filter(F.slice("codes", F.col("at") + 1, F.col("length")), lambda c: ~c.between(1, 3)))
    own = written(spark, _item_windows(items, window).where(plain >= least_plain).select("item_id", "at", "length", "h"), "item-windows")
    rest = verbatim(texts.join(own.select("item_id").distinct(), "item_id", "left_anti"), ["item_id"]).where(F.size("codes") >= least_plain)
    rest = written(spark, _item_windows(rest, window).select("item_id", "at", "length", "h"), "item-words")
    good = None
    if not own.isEmpty():
        good = _consistent(spark, docs, items, own, slack)
    if not rest.isEmpty():
        words = _matches(verbatim(docs, ["doc_id"]), rest).select("doc_id", "item_id", "at", F.lit(True).alias("same"))
        good = words if good is None else good.union(words)
    if good is None:
        return spark.createDataFrame([], schema)
    total = own.union(rest).groupBy("item_id").agg(F.count("*").alias("item_windows"))
    leaks = good.groupBy("doc_id", "item_id").agg(F.countDistinct("at").alias("windows"), F.min("same").alias("verbatim")).join(fits(total), "item_id")
    leaks = leaks.withColumn("coverage", F.col("windows") / F.col("item_windows")).where((F.col("coverage") >= coverage) | (F.col("windows") >= enough))
    return leaks.select("doc_id", "item_id", "windows", "item_windows", "coverage", "verbatim")


def _consistent(spark: SparkSession, docs: DataFrame, items: DataFrame, own: DataFrame, slack: int) -> DataFrame:
    """(doc_id, item_id, at, same): the items' windows in occurrences whose slots are consistent."""
    found = written(spark, _matches(canonical(docs, ["doc_id"]), own), "matches")
    # the slots of what matched: one row per occurrence, its windows and its pairs of values
    occurrences = found.groupBy("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("shift"), "length").agg(F.collect_set("at").alias("ats"))
    ids = fits(found.select("doc_id").distinct())
    words = valued(docs.join(ids, "doc_id", "left_semi"), ["doc_id"]).select("doc_id", F.col("values").alias("doc_values"))
    both = occurrences.join(words, "doc_id").join(fits(items.withColumnRenamed("values", "item_values")), "item_id")
    at = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("length") - 1))))
    slots = F.filter(at, lambda i: F.get("codes", i).between(1, 3))
    pairs = F.array_distinct(F.transform(slots, lambda i: F.struct(F.get("item_values", i).alias("a"), F.get("doc_values", i + F.col("shift")).alias("b"))))
    both = both.select("doc_id", "item_id", "ats", pairs.alias("pairs"))
    clashes = F.size("pairs") - F.least(F.size(F.array_distinct("pairs.a")), F.size(F.array_distinct("pairs.b")))
    return both.where(clashes <= slack).select("doc_id", "item_id", F.explode("ats").alias("at"), F.forall("pairs", lambda p: p.a == p.b).alias("same"))


def remove_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that leak no item, all columns as they were; null doc_ids stay."""
    bad = written(spark, benchmark_leaks(spark, docs, benchmark, **how).select("doc_id").distinct(), "leaks")
    return docs.join(fits(bad), "doc_id", "left_anti").select(*docs.columns)
