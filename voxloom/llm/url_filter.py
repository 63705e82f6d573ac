"""URL filters by expressions of host suffix and path prefix, joined on short hash prefixes.

A rule is a host, a path and a verdict; it fits its host and all subdomains, if the URL's path starts with the rule's.
Each URL is expanded into expressions, one for each suffix of its host (at label boundaries) and each length of path
that rules of as many labels have; each expression and each rule is a SHA-256 digest. Both sides are equi-joined on the
digests' first 32 bits, confirmed by the whole digest, and the longest rule wins.

Everything is DataFrame operations. Rows of one URL are counted where they are read and judged once; whole URLs are
shuffled once, their expressions only if the rules are too many to broadcast (then the skewed side of the join can be split).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a digest that the join compares, in hex digits.
PREFIX_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end.

    Without ``://``, or null: both empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(host: Column, path: Column) -> Column:
    """A host has no slash and a path begins with one or is empty, so the two joined are told apart."""
    return F.sha2(F.concat(host, path), 256)


def prepared(rules: DataFrame) -> DataFrame:
    """(prefix, digest, labels, size, rank, rule, verdict): one row for each rule that can fit; of equal rules a blocking one stays.

    rank orders the rules that fit one URL: longest in all, then longest host, then block before allow.
    """
    host, path = F.translate(F.col("host"), UPPER, LOWER), F.col("path")
    can = rules.where("host is not null and path is not null and verdict in ('allow', 'block') and instr(host, '/') = 0 and (path = '' or path like '/%') and path not rlike '[?#]'")
    rows = can.select(host.alias("host"), "path", (F.col("verdict") == "block").alias("blocks")).groupBy("host", "path").agg(F.max("blocks").alias("blocks"))
    digest = _digest(F.col("host"), path)
    rank = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), "blocks")
    return rows.select(
        F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"), digest.alias("digest"), _labels(F.col("host")).alias("labels"), F.length("path").alias("size"), rank.alias("rank"),
        F.concat("host", "path").alias("rule"), F.when(F.col("blocks"), "block").otherwise("allow").alias("verdict"),
    )


def filter_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per row of ``pages``; rule is null and verdict ``default`` where no rule fits.

    ``rules``: host, path, verdict (allow or block). Rules with a null, another verdict, a host with a slash, or a path
    that neither is empty nor begins with a slash or that holds ``?`` or ``#`` can fit no URL and are passed over. An
    empty rule host fits URLs with an empty host alone. Null and empty URLs have an empty host and path. Rows with a
    null or repeated page_id, and repeated rows, each count. Other columns are not read. URLs may have any length: a URL
    has at most as many expressions as there are pairs of label count and path length among the rules.
    """
    known = prepared(rules)
    deepest = known.agg(F.max("labels")).first()[0]  # one number
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.spark_partition_id().alias("part"))
    # the part is a key so that copies of one row make no larger group than a partition has rows
    urls = rows.groupBy("page_id", "url", "part").agg(F.count("*").alias("times"))
    host, path = host_and_path(F.col("url"))
    urls = urls.select("page_id", "url", "part", "times", host.alias("host"), path.alias("path"))
    if deepest is None:
        judged = urls.withColumns({"best": F.lit(None).cast("struct<rule:string,verdict:string>")})
    else:
        shapes = known.groupBy("labels").agg(F.sort_array(F.collect_set("size")).alias("sizes"))  # one row per count of labels
        suffixes = urls.withColumn("labels", F.explode(F.sequence(F.lit(1), F.least(_labels(F.col("host")), F.lit(deepest)))))
        shaped = suffixes.join(fits(shapes), "labels", "left").withColumn("size", F.explode_outer(F.filter("sizes", lambda n: n <= F.length("path"))))
        digest = F.when(F.col("size").isNotNull(), _digest(F.expr("substring_index(host, '.', -labels)"), F.substring(F.col("path"), F.lit(1), F.col("size"))))
        prefix = F.coalesce(F.substring(digest, 1, PREFIX_DIGITS), F.hex(F.xxhash64("page_id", "url")))  # without expressions: 16 digits, no rule's
        expressions = shaped.select("page_id", "url", "part", "times", "host", "path", prefix.alias("prefix"), digest.alias("digest"))
        met = expressions.join(fits(known.select("prefix", "digest", "rank", F.struct("rule", "verdict").alias("found"))), ["prefix", "digest"], "left")
        judged = met.groupBy("page_id", "url", "part").agg(F.first("times").alias("times"), F.first("host").alias("host"), F.first("path").alias("path"), F.max_by("found", "rank").alias("best"))
    each = judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return each.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
