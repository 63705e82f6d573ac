"""Frames: a DataFrame, the space it lies in, and its provenance.

kind        columns             meaning
volume      v, value            one value a voxel; a mask has BOOLEAN values
series      v, t, x             a value per voxel and time
hyper       v, t, f, x          a value per voxel, time and feature
labels      v, label            a partition; background rows are absent
parcels     label, t, x         a series per label

A sparse frame has no rows for zeros; a dense one has a row for every voxel of the grid. ``every_time`` says of a sparse
series that its voxels have a row for every time, so that only voxels are absent.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .contracts import InvalidArgument, Receipt
from .space import Space

KEYS = {"volume": ("v",), "series": ("v", "t"), "hyper": ("v", "t", "f"), "labels": ("v",), "parcels": ("label", "t")}
VALUE = {"volume": "value", "series": "x", "hyper": "x", "labels": "label", "parcels": "x"}


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    space: Space
    kind: str = "volume"
    sparse: bool = False
    receipt: Receipt | None = None
    every_time: bool = False

    def __post_init__(self):
        if self.kind not in KEYS:
            raise InvalidArgument(f"no frame kind {self.kind!r}")
        missing = [c for c in (*KEYS[self.kind], VALUE[self.kind]) if c not in self.df.columns]
        if missing:
            raise InvalidArgument(f"a {self.kind} frame lacks {missing}")

    @property
    def keys(self) -> tuple[str, ...]:
        return KEYS[self.kind]

    @property
    def value(self) -> str:
        return VALUE[self.kind]

    @property
    def has_all_times(self) -> bool:
        return not self.sparse or self.every_time

    def like(self, df: DataFrame, **changes) -> Frame:
        return replace(self, df=df, **changes)

    def __array__(self, *args, **kwargs):
        from .contracts import ImplicitConversion

        raise ImplicitConversion("a frame is distributed: collect its DataFrame explicitly")


def grid(spark: SparkSession, space: Space) -> DataFrame:
    """(v): every voxel of the grid."""
    return spark.range(space.nvox).select(F.col("id").alias("v"))


def met(df: DataFrame) -> DataFrame:
    """``df`` for a join that is to shuffle both sides: Spark's sizes know neither what Parquet packed nor what an explode
    adds, and a side that is as large as the grid would be broadcast, whole, through the driver."""
    return df.hint("merge")


def densified(frame: Frame, fill: float = 0.0) -> Frame:
    """A volume with a row for every voxel; a series with one for every voxel and time that occurs."""
    if not frame.sparse:
        return frame
    spark = frame.df.sparkSession
    every = grid(spark, frame.space)
    if frame.kind == "series":
        # times are few and known from the space, so that this multiplies rows by a constant
        every = every.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(frame.space.dim[3] - 1))))
    df = every.join(met(frame.df), list(frame.keys), "left")
    return frame.like(df.select(*frame.keys, F.coalesce(F.col(frame.value), F.lit(fill)).alias(frame.value)), sparse=False)


def with_all_times(frame: Frame) -> DataFrame:
    """(v, t, x): the stored voxels of a series at all times, zero where a row is absent; a shuffle by voxel, if one is needed."""
    if frame.has_all_times:
        return frame.df.select("v", "t", "x")
    held = frame.df.groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct(F.col("t").cast("int"), F.col("x")))).alias("at"))  # at most one entry a time
    every = held.select("v", "at", F.explode(F.sequence(F.lit(0), F.lit(frame.space.dim[3] - 1))).alias("t"))
    return every.select("v", "t", F.coalesce(F.try_element_at("at", F.col("t")), F.lit(0.0)).alias("x"))


def sparsified(frame: Frame) -> Frame:
    """Without zeros; of a series, without voxels that are zero at all times."""
    if frame.kind == "series":
        some = frame.df.where(F.col("x") != 0).select("v").distinct()
        return frame.like(frame.df.join(some, "v", "left_semi"), sparse=True, every_time=frame.has_all_times)
    return frame.like(frame.df.where(F.col(frame.value) != 0), sparse=True)


def numbered(df: DataFrame, order: str, name: str, first: int = 0) -> DataFrame:
    """``df`` with a column of places in the order of a column, counting from ``first``: a range partitioning and one count
    per partition, so no task sees more than its partition."""
    rows = checkpointed(df)
    if rows.count() <= SMALL:  # few enough for one task
        return rows.withColumn(name, F.row_number().over(Window.orderBy(order)).cast("long") + F.lit(first - 1))
    rows = checkpointed(rows.orderBy(order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(part).count().collect())  # one row per partition
    before, offset = {}, first
    for k, n in sizes:
        before[k] = offset
        offset += n
    if not sizes:
        return rows.withColumn(name, F.col("_at")).drop("_at")
    starts = F.split(F.lit(",".join(str(before.get(k, 0)) for k in range(sizes[-1][0] + 1))), ",").cast("array<bigint>")
    return rows.withColumn(name, F.get(starts, part.cast("int")) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def numbered_sums(df: DataFrame, order: str, size: str, name: str) -> tuple[DataFrame, int]:
    """(``df`` with the sum of ``size`` over all rows before, in the order of a column; the sum over all rows): a range
    partitioning, one sum per partition, and a window within each."""
    rows = checkpointed(df.orderBy(order).withColumn("_part", F.spark_partition_id()))
    sums = dict(rows.groupBy("_part").agg(F.sum(size)).collect())  # one row per partition
    before, total = [], 0
    for k in range(max(sums, default=-1) + 1):
        before.append(total)
        total += sums.get(k) or 0
    within = F.sum(size).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    starts = F.split(F.lit(",".join(map(str, before or [0]))), ",").cast("array<bigint>")
    return rows.withColumn(name, F.get(starts, F.col("_part")) + F.coalesce(within, F.lit(0))).drop("_part"), total


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode else one of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise InvalidArgument("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="voxloom-"))
        found = str(sc._jsc.sc().getCheckpointDir().get())
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


#: The most rows of a few numbers that are broadcast.
SMALL = 200_000


def small(df: DataFrame) -> DataFrame:
    """``df`` for a broadcast if it has at most SMALL rows, else as it is: the join then shuffles."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Through a checkpoint in the folder that the cluster names; one of our own only in local mode."""
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
