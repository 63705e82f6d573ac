"""Exact quantiles without a sort, and the display limits that use them.

A double's 64 bits, turned so that they order like the numbers, are read in three rounds of 22, 21 and 21 bits. Each
round counts, with map-side combination, how many values have which next bits among those that still share a wanted
rank's bits; a running sum over these bins (at most 2^22 a group) says where the rank goes on. After the third round the
bits are the value. No group of values meets in a task, and the plan reads its input once a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.contracts import InvalidArgument
from ..plans.frame import Frame, checkpointed, small

SHIFTS = (42, 21, 0)
_LOW = np.int64(0x7FFFFFFFFFFFFFFF)


def _ordered_bits(batches):
    for batch in batches:
        x = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # one zero
        bits = x.view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits ^ ((bits >> np.int64(63)) & _LOW)), batch.column(2)], names=["g", "bits", "n"])


def _numbers(batches):
    for batch in batches:
        out = []
        for c in (2, 3):
            bits = batch.column(c).to_numpy()
            out.append(pa.array((bits ^ ((bits >> np.int64(63)) & _LOW)).view(np.float64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out, batch.column(4)], names=["g", "q", "low", "high", "part"])


def quantiles(values: DataFrame, column: str, qs, by: str | None = None, times: str | None = None) -> DataFrame:
    """(by, q, value): the quantiles ``qs`` of a column, by linear interpolation between the two nearest ranks.

    NaN and null take no part; infinities do. ``by``: a column of whole numbers (null is a group); without it one row a
    quantile. ``times``: a column with how often each row counts. Groups without a value have no row.
    """
    qs = [float(q) for q in qs]
    if not qs or any(not 0 <= q <= 1 for q in qs):
        raise InvalidArgument("quantiles from 0 to 1")
    x = F.col(column).cast("double")
    group = F.col(by).cast("long") if by else F.lit(0).cast("long")
    rows = values.select(group.alias("g"), x.alias("x"), (F.col(times).cast("long") if times else F.lit(1).cast("long")).alias("n")).where("x is not null and not isnan(x) and n > 0")
    bits = rows.mapInArrow(_ordered_bits, "g long, bits long, n long")
    sizes = rows.groupBy("g").agg(F.sum("n").alias("size"))
    at = F.col("q") * (F.col("size") - 1)
    asked = sizes.withColumn("q", F.explode(F.array(*map(F.lit, sorted(set(qs)))))).withColumn("low", F.floor(at)).withColumn("part", at - F.floor(at))
    targets = asked.select("g", "q", "part", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("low").alias("rank")), F.struct(F.lit(1).alias("side"), F.least(F.col("low") + 1, F.col("size") - 1).alias("rank")))).alias("s")).select("g", "q", "part", "s.side", "s.rank", F.lit(0).cast("long").alias("prefix"))
    targets = checkpointed(targets)
    before = None
    for shift in SHIFTS:
        prefix = F.lit(0).cast("long") if before is None else F.shiftright("bits", before)
        own = bits.select("g", prefix.alias("prefix"), F.shiftright("bits", shift).alias("bin"), "n")
        if before is not None:
            own = _of_targets(own, targets)
        bins = own.groupBy("g", "prefix", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("g", "prefix").orderBy("bin"))
        bins = bins.select(F.col("g").alias("bg"), F.col("prefix").alias("bp"), "bin", "n", (upto - F.col("n")).alias("first"))
        here = F.col("g").eqNullSafe(F.col("bg")) & (F.col("prefix") == F.col("bp")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
        targets = checkpointed(bins.join(small(targets), here).select("g", "q", "part", "side", (F.col("rank") - F.col("first")).alias("rank"), F.col("bin").alias("prefix")))
        before = shift
    ends = targets.groupBy("g", "q").agg(F.max(F.when(F.col("side") == 0, F.col("prefix"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("prefix"))).alias("high"), F.max("part").alias("part"))
    out = ends.mapInArrow(_numbers, "g long, q double, low double, high double, part double")
    value = F.when((F.col("low") == F.col("high")) | (F.col("part") == 0), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("part"))
    return out.select(*([F.col("g").alias(by)] if by else []), "q", value.alias("value"))


def _of_targets(own: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows whose bits so far are those of a wanted rank."""
    wanted = targets.select(F.col("g").alias("tg"), F.col("prefix").alias("tp")).distinct()
    return own.join(small(wanted), F.col("g").eqNullSafe(F.col("tg")) & (F.col("prefix") == F.col("tp")), "left_semi")


def frame_quantiles(frame: Frame, qs, by: str | None = None) -> DataFrame:
    """Of all cells of a frame, or of those of each time (by "t"); what a sparse frame lacks is zero."""
    if by not in (None, "t") or (by and frame.kind != "series"):
        raise InvalidArgument("by must be None, or t of a series")
    rows = frame.df.select(*([F.col("t").cast("long").alias("t")] if by else []), F.col(frame.value).cast("double").alias("x"), F.lit(1).cast("long").alias("n"))
    if frame.sparse:
        cells = frame.space.nvox * (frame.space.dim[3] if frame.kind == "series" and not by else 1)
        if by:
            every = frame.df.sparkSession.range(frame.space.dim[3]).withColumnRenamed("id", "t")
            stored = every.join(rows.groupBy("t").agg(F.count("*").alias("c")), "t", "left").select("t", F.lit(0.0).alias("x"), (F.lit(cells) - F.coalesce("c", F.lit(0))).cast("long").alias("n"))
        else:
            stored = rows.agg(F.lit(0.0).alias("x"), (F.lit(cells) - F.count("*")).cast("long").alias("n"))
        rows = rows.union(stored)
    return quantiles(rows, "x", qs, by, "n")


def display_limits(frame: Frame, mode="robust", probs=(0.02, 0.98), by: str | None = None) -> DataFrame:
    """(by, lo, hi): between which values to show a frame, or each of its times.

    Finite values only. "robust": the quantiles ``probs``, or the extremes where these are equal; "data": the extremes;
    two numbers: these, in order. Equal limits are one apart. A frame without finite values has 0 and 1.
    """
    spark = frame.df.sparkSession
    if not isinstance(mode, str):
        lo, hi = sorted(map(float, mode))
        if not np.isfinite([lo, hi]).all() or lo == hi:
            raise InvalidArgument("two distinct finite limits")
        return spark.createDataFrame([(lo, hi)], "lo double, hi double")
    if mode not in ("robust", "data"):
        raise InvalidArgument(f"no mode {mode!r}")
    finite = frame.like(frame.df.where(~F.isnan(F.col(frame.value).cast("double")) & (F.abs(F.col(frame.value).cast("double")) < float("inf"))))
    if frame.sparse:  # absent cells are counted before those that are not finite go
        finite = frame.like(frame.df.withColumn(frame.value, F.when(F.abs(F.col(frame.value).cast("double")) < float("inf"), F.col(frame.value).cast("double"))))
    asked = (0.0, 1.0) if mode == "data" else (0.0, 1.0, *probs)
    got = frame_quantiles(finite, asked, by)

    def of(q: float):
        return F.max(F.when(F.col("q") == q, F.col("value")))

    rows = got.groupBy(*([by] if by else [])).agg(of(0.0).alias("least"), of(1.0).alias("most"), *((of(probs[0]).alias("lo"), of(probs[1]).alias("hi")) if mode == "robust" else ()))
    if mode == "data":
        rows = rows.withColumns({"lo": F.col("least"), "hi": F.col("most")})
    same = F.col("lo") == F.col("hi")
    rows = rows.withColumns({"lo": F.when(same, F.col("least")).otherwise(F.col("lo")), "hi": F.when(same, F.col("most")).otherwise(F.col("hi"))})
    lo = F.coalesce("lo", F.lit(0.0))
    hi = F.when(F.col("lo").isNull(), 1.0).when(F.col("lo") == F.col("hi"), F.col("lo") + 1).otherwise(F.col("hi"))
    return rows.select(*([by] if by else []), lo.alias("lo"), hi.alias("hi"))
