"""Connected components of a table of links, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir


def _to_least(both: DataFrame) -> DataFrame:
    """(v, m) for each row (u, v): m is the least of u and its neighbours."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def _checksum(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart, without a shuffle of their rows."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def components(spark: SparkSession, links: DataFrame, most: int = 60) -> DataFrame:
    """(id, component): for each end of a link the smallest id that links reach from it.

    ``links``: columns a, b (long, not null). Nulls are passed over; loops and repeated links are harmless; no links
    give no rows. Each round is two aggregations and two joins on the node, both with map-side combination or
    splittable by AQE, so that a node with many links is no single task; rounds are checkpointed to the shared
    folder. Nothing but one count a round reaches the driver.
    """
    shared_dir(spark)
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    nodes, now = edges, _checksum(edges)
    for _ in range(most):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = _to_least(large)
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = small.checkpoint()
        edges, before, now = small, now, _checksum(small)
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = nodes.select(F.col("v").alias("id")).union(nodes.select(F.col("u").alias("id"))).distinct().join(found, "id", "left_anti")
    return found.union(roots.select("id", F.col("id").alias("component")))
