"""Element-wise arithmetic, comparison, mask algebra and value maps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.contracts import InvalidArgument, SpaceMismatch
from ..plans.frame import Frame, densified, grid

NAN, INF = float("nan"), float("inf")


def divide(a: Column, b: Column) -> Column:
    """IEEE division, without ANSI's error."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


OPS = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide}


def _any_nan(a: Column, b: Column) -> Column:
    return F.isnan(a) | F.isnan(b)


COMPARE = {
    ">": lambda a, b: ~_any_nan(a, b) & (a > b),
    "<": lambda a, b: ~_any_nan(a, b) & (a < b),
    ">=": lambda a, b: ~_any_nan(a, b) & (a >= b),
    "<=": lambda a, b: ~_any_nan(a, b) & (a <= b),
    "==": lambda a, b: ~_any_nan(a, b) & (a == b),
    "!=": lambda a, b: _any_nan(a, b) | (a != b),
}


def arithmetic(a: Frame, b: Frame | float, op: str, reflected: bool = False) -> Frame:
    """a op b (reflected: b op a).

    A number meets stored values only. Two dense volumes need equal spaces; a sparse and another frame meet over all
    rows either has, absent ones as zero. A series meets a series on (v, t), or a volume at every t.
    """
    if op not in OPS:
        raise InvalidArgument(f"no operation {op!r}")
    f = OPS[op] if not reflected else (lambda x, y: OPS[op](y, x))
    value = a.value
    if not isinstance(b, Frame):
        return a.like(a.df.select(*a.keys, f(F.col(value), F.lit(float(b))).alias(value)))
    if a.kind == "volume" and b.kind == "volume":
        if not a.sparse and not b.sparse and a.space != b.space:
            raise SpaceMismatch("arithmetic needs equal spaces")
    if a.space.dim[:3] != b.space.dim[:3]:
        raise SpaceMismatch("arithmetic needs equal grids")
    keys = list(b.keys)
    other = b.df.select(*keys, F.col(b.value).alias("other"))
    if a.sparse or b.sparse:
        if a.sparse and b.sparse and a.kind == b.kind:
            df = a.df.join(other, keys, "full")
            both = f(F.coalesce(F.col(value), F.lit(0.0)), F.coalesce("other", F.lit(0.0)))
            return a.like(df.select(*a.keys, both.alias(value)))
        df = densified(a).df.join(other, keys, "left")
        return a.like(df.select(*a.keys, f(F.col(value), F.coalesce("other", F.lit(0.0))).alias(value)), sparse=False)
    df = a.df.join(other, keys)
    return a.like(df.select(*a.keys, f(F.col(value), F.col("other")).alias(value)))


def compare(a: Frame, b: Frame | float, op: str) -> Frame:
    """A mask (for volumes) or boolean values; a comparison with NaN is false, but != is true."""
    f = COMPARE[op]
    if not isinstance(b, Frame):
        a = densified(a)
        return a.like(a.df.select(*a.keys, f(F.col(a.value), F.lit(float(b))).alias(a.value)))
    if a.space != b.space:
        raise SpaceMismatch("a comparison needs equal spaces")
    a, b = densified(a), densified(b)
    df = a.df.join(b.df.select(*b.keys, F.col(b.value).alias("other")), list(b.keys))
    return a.like(df.select(*a.keys, f(F.col(a.value), F.col("other")).alias(a.value)))


def mask_algebra(a: Frame, b: Frame, op: str) -> Frame:
    """and, or, xor of two masks of equal spaces, by their true voxels; the result is sparse."""
    if a.space != b.space:
        raise SpaceMismatch("mask algebra needs equal spaces")
    x, y = a.df.where("value").select("v"), b.df.where("value").select("v")
    if op == "and":
        df = x.join(y, "v", "left_semi")
    elif op == "or":
        df = x.union(y).distinct()
    elif op == "xor":
        df = x.join(y, "v", "left_anti").union(y.join(x, "v", "left_anti"))
    else:
        raise InvalidArgument(f"no mask operation {op!r}")
    return a.like(df.withColumn("value", F.lit(True)), sparse=True)


def mask_not(a: Frame) -> Frame:
    df = grid(a.df.sparkSession, a.space).join(a.df.where("value").select("v"), "v", "left_anti")
    return a.like(df.withColumn("value", F.lit(True)), sparse=True)


def map_values(frame: Frame, lookup: dict) -> Frame:
    """Values replaced all at once; what the lookup lacks stays."""
    if not lookup:
        return frame
    if len(lookup) <= 200:
        table = F.create_map(*[F.lit(x) for k, v in lookup.items() for x in (float(k), float(v))])
        new = F.coalesce(F.element_at(table, F.col(frame.value).cast("double")), F.col(frame.value).cast("double"))
        return frame.like(frame.df.select(*frame.keys, new.alias(frame.value)))
    pairs = frame.df.sparkSession.createDataFrame([(float(k), float(v)) for k, v in lookup.items()], "old double, new double")
    df = frame.df.withColumn("old", F.col(frame.value).cast("double")).join(pairs, "old", "left")
    return frame.like(df.select(*frame.keys, F.coalesce("new", "old").alias(frame.value)))


def mapf(frame: Frame, f) -> Frame:
    """f: a function of Columns."""
    return frame.like(frame.df.select(*frame.keys, f(F.col(frame.value)).alias(frame.value)))


def scale_mapper(scale: float, center: float = 0.0):
    return lambda x: (x - center) * scale + center


def log_mapper(base: float = math.e, offset: float = 0.0):
    """ln(x + offset) / ln(base), IEEE at and below zero."""
    return lambda x: F.when(x + offset > 0, F.log(x + offset) / math.log(base)).when(x + offset == 0, F.lit(-INF if base > 1 else INF)).otherwise(F.lit(NAN))


def threshold_mapper(threshold: float, below: float = 0.0):
    return lambda x: F.when(~F.isnan(x) & (x < threshold), F.lit(float(below))).otherwise(x)


def normalised(frame: Frame, lo: float | None = None, hi: float | None = None) -> Frame:
    """Values scaled to 0..1 between limits, by default of the finite ones; equal limits widen by one."""
    x = F.col(frame.value)
    finite = ~F.isnan(x) & (F.abs(x) != INF)
    if lo is None or hi is None:
        got = frame.df.where(finite).agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
        lo, hi = got.lo if lo is None else lo, got.hi if hi is None else hi
    if lo is None:
        return frame
    hi = lo + 1 if hi == lo else hi
    return frame.like(frame.df.select(*frame.keys, F.when(finite, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - lo) / (hi - lo)))).otherwise(F.lit(NAN)).alias(frame.value)))
