"""The driver's tables read as images: pure expressions of stored columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import Frame
from .space import Space

EVENTS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bold(spark: SparkSession, sf_dir: str) -> Frame:
    """Embeddings as an 8 x 8 x nz series of 64 times; cells beyond the last id are outside its mask."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.max("vec_id")).first()[0] + 1
    df = e.select(F.col("vec_id").alias("v"), F.posexplode("embedding").alias("t", "x0")).select("v", "t", F.col("x0").cast("double").alias("x"))
    return Frame(df, Space((8, 8, -(-n // 64), 64), (2.0, 2.0, 3.0, 1.5)), "series", sparse=True, every_time=True)


def atlas(spark: SparkSession, sf_dir: str) -> Frame:
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.max("vec_id")).first()[0] + 1
    return Frame(e.select(F.col("vec_id").alias("v"), (F.col("label") + 1).alias("label")), Space((8, 8, -(-n // 64)), (2.0, 2.0, 3.0)), "labels", sparse=True)


def volume(spark: SparkSession, sf_dir: str, value: str = "p_retailprice") -> Frame:
    p = table(spark, sf_dir, "part")
    n = p.agg(F.max("p_partkey")).first()[0] + 1
    return Frame(p.select(F.col("p_partkey").alias("v"), F.col(value).cast("double").alias("value")), Space((10, 10, -(-n // 100)), (2.0, 2.0, 2.0)), "volume", sparse=n % 100 != 0)


def counts(spark: SparkSession, sf_dir: str) -> Frame:
    """Quantities by part and line number: a sparse series."""
    li = table(spark, sf_dir, "lineitem")
    n = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] + 1
    df = li.groupBy(F.col("l_partkey").alias("v"), (F.col("l_linenumber") - 1).cast("int").alias("t")).agg(F.sum("l_quantity").alias("x"))
    return Frame(df, Space((10, 10, -(-n // 100), 7)), "series", sparse=True)


def hyper(spark: SparkSession, sf_dir: str) -> Frame:
    """Mean event values by user, day and event type."""
    e = table(spark, sf_dir, "events")
    n = e.agg(F.max("user_id")).first()[0] + 1
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    kind = F.array_position(F.array(*[F.lit(x) for x in EVENTS]), F.col("event_type")) - 1
    df = e.groupBy(F.col("user_id").alias("v"), day.cast("int").alias("t"), kind.cast("int").alias("f")).agg(F.avg("value").alias("x"))
    return Frame(df, Space((10, 10, -(-n // 100), 31, len(EVENTS))), "hyper", sparse=True)
