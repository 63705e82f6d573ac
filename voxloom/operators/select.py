"""Projection, filtering, selection and extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.contracts import InvalidArgument, OpParams, OutOfBounds, WorldOutOfBounds, assert_same_space, receipt_for
from ..plans.digests import mask_hash_of
from ..plans.frame import Frame
from ..plans.space import Space


def _requests(frame: Frame, voxels, out_of_bounds: str = "raise") -> DataFrame:
    """(ord, v): a driver list of voxel indices, in request order, repeats kept."""
    if out_of_bounds not in ("raise", "zero"):
        raise InvalidArgument("out_of_bounds must be raise or zero")
    voxels = [int(v) for v in voxels]
    if out_of_bounds == "raise" and any(v < 0 or v >= frame.space.nvox for v in voxels):
        raise OutOfBounds("a requested voxel is outside the space")
    return frame.df.sparkSession.createDataFrame(list(enumerate(voxels)), "ord int, v long")


#: So many voxels are asked for by their numbers; more by their range and a join.
LITERALS, BROADCAST_ROWS = 2000, 1_000_000


def pruned(df: DataFrame, asked: DataFrame | list[int]) -> DataFrame:
    """The rows of ``df`` at the voxels asked for (a list, or a column v), by a filter that reaches the source."""
    known = getattr(asked, "_voxels", None)  # a region that the driver listed
    if isinstance(asked, list) or (known is not None and len(known) <= LITERALS):
        found = sorted(set(asked if known is None else known))
        asked = df.sparkSession.createDataFrame([(v,) for v in found], "v long") if known is None and len(found) > LITERALS else asked
    else:
        rows = asked.select("v").limit(LITERALS + 1).collect()
        found = sorted({r[0] for r in rows}) if len(rows) <= LITERALS else None
    if found is not None and len(found) <= LITERALS:
        return df.where(F.col("v").isin(found)) if found else df.where("false")
    got = asked.agg(F.min("v"), F.max("v"), F.count("v")).first()
    near = df.where(F.col("v").between(got[0], got[1]))
    asked = asked.select("v").distinct()
    return near.join(F.broadcast(asked) if got[2] <= BROADCAST_ROWS else asked, "v", "left_semi")


def series_at(frame: Frame, voxels, out_of_bounds: str = "raise") -> DataFrame:
    """(ord, t, x): series of the requested voxels; those outside the mask, or allowed out of bounds, are zero."""
    asked = _requests(frame, voxels, out_of_bounds)
    asked = asked.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(frame.space.dim[3] - 1))))
    return asked.join(pruned(frame.df, [int(v) for v in voxels]), ["v", "t"], "left").select("ord", "t", F.coalesce("x", F.lit(0.0)).alias("x"))


def series_at_coords(frame: Frame, coords, out_of_bounds: str = "raise") -> DataFrame:
    nx, ny, nz = frame.space.dim[:3]
    inside = [0 <= i < nx and 0 <= j < ny and 0 <= k < nz for i, j, k in coords]
    if out_of_bounds == "raise" and not all(inside):
        raise OutOfBounds("a requested coordinate is outside the space")
    return series_at(frame, [i + nx * (j + ny * k) if ok else -1 for ok, (i, j, k) in zip(inside, coords)], "zero")


def series_at_world(frame: Frame, world, out_of_bounds: str = "raise") -> DataFrame:
    return series_at_coords(frame, [tuple(map(int, g)) for g in frame.space.spatial.world_to_grid(world)], out_of_bounds)


def volume_values_at(frame: Frame, voxels) -> DataFrame:
    """(ord, value): linear access, in request order; what a sparse frame lacks is zero."""
    return _requests(frame, voxels).join(pruned(frame.df, [int(v) for v in voxels]), "v", "left").select("ord", F.coalesce("value", F.lit(0.0)).alias("value"))


def matrix_access(frame: Frame, times, voxels) -> DataFrame:
    """(row, col, x): the sub-matrix of the requested times and voxels."""
    spark = frame.df.sparkSession
    t = spark.createDataFrame(list(enumerate(map(int, times))), "row int, t int")
    cells = _requests(frame, voxels).withColumnRenamed("ord", "col")
    found = pruned(frame.df, [int(v) for v in voxels]).join(F.broadcast(t), "t").join(F.broadcast(cells), "v").select("row", "col", "x")  # requests come from the driver
    return found


def in_mask(frame: Frame, mask: Frame) -> Frame:
    """Only what lies in a mask of the same space; the result is sparse."""
    assert_same_space(frame.space, mask.space)
    on = mask.df.where("value") if mask.kind == "volume" and dict(mask.df.dtypes)["value"] == "boolean" else mask.df.where(F.col(mask.value) != 0)
    out = frame.df.join(on.select("v"), "v", "left_semi")
    return frame.like(out, sparse=True, every_time=frame.has_all_times, receipt=receipt_for(frame.space, OpParams("in_mask"), mask_hash_of(mask), upstream=frame.receipt))


def apply_mask(frame: Frame, mask: Frame) -> Frame:
    """The same rows, zero outside the mask."""
    on = mask.df.where(F.col(mask.value).cast("double") != 0).select("v", F.lit(True).alias("on"))
    df = frame.df.join(on, "v", "left").select(*frame.keys, F.when(F.col("on"), F.col(frame.value)).otherwise(0.0).alias(frame.value))
    return frame.like(df)


def series_roi(frame: Frame, roi: DataFrame, space=None) -> DataFrame:
    """(ord, v, t, x) of a region (ord, v); voxels it has outside the grid or the mask are zero."""
    if space is not None:
        assert_same_space(frame.space, space)
    asked = roi.select("ord", "v").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(frame.space.dim[3] - 1))))
    return asked.join(pruned(frame.df, roi), ["v", "t"], "left").select("ord", "v", "t", F.coalesce("x", F.lit(0.0)).alias("x"))


def values_roi(frame: Frame, roi: DataFrame, space=None) -> DataFrame:
    """(ord, v, value) of a region (ord, v), zero outside."""
    if space is not None:
        assert_same_space(frame.space, space)
    return roi.select("ord", "v").join(pruned(frame.df, roi), "v", "left").select("ord", "v", F.coalesce("value", F.lit(0.0)).alias("value"))


def volume_at(frame: Frame, t: int) -> Frame:
    if not 0 <= t < frame.space.dim[3]:
        raise OutOfBounds(f"no time {t}")
    return Frame(frame.df.where(F.col("t") == t).select("v", F.col("x").alias("value")), frame.space.spatial, "volume", frame.sparse, frame.receipt)


def time_slice(frame: Frame, start: int, stop: int, step: int = 1) -> Frame:
    """Times start, start + step, ... before stop, numbered anew."""
    picked = range(*slice(start, stop, step).indices(frame.space.dim[3]))
    if step <= 0 or not len(picked):
        raise InvalidArgument("a time slice needs times and a positive step")
    a, b = picked[0], picked[-1]
    df = frame.df.where((F.col("t") >= a) & (F.col("t") <= b) & ((F.col("t") - a) % step == 0))
    space = frame.space.drop_dim(3).add_dim(len(picked), frame.space.spacing[3] * step)
    receipt = receipt_for(frame.space, OpParams(f"temporal_slice({start},{stop},{step})"), upstream=frame.receipt)
    return frame.like(df.withColumn("t", ((F.col("t") - a) / step).cast("int")), space=space, receipt=receipt)


def sub_vector(frame: Frame, times) -> Frame:
    """The requested times, numbered in request order; repeats are repeated."""
    pick = frame.df.sparkSession.createDataFrame(list(enumerate(map(int, times))), "n int, t int")
    df = frame.df.join(F.broadcast(pick), "t").select("v", F.col("n").alias("t"), "x")
    return frame.like(df, space=frame.space.drop_dim(3).add_dim(len(list(times)), frame.space.spacing[3]))


def packed(frame: Frame) -> DataFrame:
    """(v, ts): a series' values as one array in order of time."""
    return frame.df.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("p")).select("v", F.transform("p", lambda s: s.x).alias("ts"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("v", F.posexplode("ts").alias("t", "x"))


def to_matrix(frame: Frame) -> DataFrame:
    """(t, row): time by voxel, a row's values in order of v."""
    return frame.df.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("v", "x"))).alias("p")).select("t", F.transform("p", lambda s: s.x).alias("row"))


def from_matrix(df: DataFrame) -> DataFrame:
    """(v, t, x) of (t, row)."""
    return df.select("t", F.posexplode("row").alias("v", "x")).select(F.col("v").cast("long").alias("v"), "t", "x")


def orthogonal_slice(frame: Frame, world, axis: int) -> DataFrame:
    """(a, b, value): the plane through a world point, its grid coordinate truncated; axis 0 sagittal, 1 coronal, 2 axial."""
    g = frame.space.world_to_grid([world], rounded=False)[0]
    at = int(g[axis])
    if not 0 <= at < frame.space.dim[axis]:
        raise WorldOutOfBounds("the point is outside the volume")
    return plane(frame, at, axis)


def plane(frame: Frame, level: int, axis: int) -> DataFrame:
    """(a, b, value): grid plane ``level`` along an axis."""
    if not 0 <= level < frame.space.dim[axis]:
        raise OutOfBounds(f"no plane {level} along axis {axis}")
    ijk = frame.space.ijk()
    a, b = (ijk[x] for x in range(3) if x != axis)
    return frame.df.where(ijk[axis] == level).select(a.cast("int").alias("a"), b.cast("int").alias("b"), frame.value)


def slice_frame(frame: Frame, level: int, axis: int) -> Frame:
    """A plane of a volume as a frame of its own, on the grid of the two other axes: arithmetic and the like take it as any."""
    found, keep = plane(frame, level, axis), [x for x in range(3) if x != axis]
    space = Space(*(tuple(values[x] for x in keep) for values in (frame.space.dim, frame.space.spacing, frame.space.origin)), axes=tuple(frame.space.axes[x] for x in keep))
    place = F.col("a").cast("long") + space.dim[0] * F.col("b").cast("long")
    return frame.like(found.select(place.alias("v"), F.col(frame.value)), space=space)


def coordinates(frame: Frame, real: bool = False) -> DataFrame:
    """(v, i, j, k), or world coordinates (v, x, y, z)."""
    ijk = frame.space.ijk()
    if not real:
        return frame.df.select("v", *(c.cast("long").alias(n) for c, n in zip(ijk, "ijk")))
    return frame.df.select("v", *(c.alias(n) for c, n in zip(frame.space.xyz(*ijk), "xyz")))


def updated(frame: Frame, new: DataFrame) -> Frame:
    """The frame with the values of ``new`` (keys, value) in place of its own."""
    value = frame.value
    df = frame.df.join(new.select(*frame.keys, F.col(value).alias("new")), list(frame.keys), "full" if frame.sparse else "left")
    return frame.like(df.select(*frame.keys, F.coalesce("new", value).alias(value)))


def select_features(frame: Frame, features) -> Frame:
    """The requested features of a hyper frame, numbered in request order."""
    pick = frame.df.sparkSession.createDataFrame(list(enumerate(map(int, features))), "n int, f int")
    df = frame.df.join(F.broadcast(pick), "f").select("v", "t", F.col("n").alias("f"), "x")
    return frame.like(df, space=frame.space.drop_dim(4).add_dim(len(list(features))))


def squeeze_features(frame: Frame) -> Frame:
    if frame.space.dim[4] != 1:
        raise InvalidArgument("only a single feature can be squeezed")
    return Frame(frame.df.select("v", "t", "x"), frame.space.drop_dim(4), "series", frame.sparse, frame.receipt)


def cluster_values(values: Frame, labels: Frame, label: int | None = None, name: str | None = None, names: DataFrame | None = None) -> DataFrame:
    """(label, v, value) of one label or of all; a missing id gives no rows, a missing name raises."""
    assert_same_space(values.space, labels.space)
    chosen = labels.df
    if name is not None:
        found = names.where(F.col("name") == name).select("label").limit(2).collect()
        if not found:
            raise KeyError(name)
        label = found[0].label
    if label is not None:
        chosen = chosen.where(F.col("label") == label)
    return chosen.join(values.df, "v").select("label", "v", "value")


def lookup_strict(requests: DataFrame, lookup: DataFrame, key: str, to: str) -> DataFrame:
    """Grid index to table row or back, through a bijection (grid_idx, table_idx); a request without a partner raises."""
    found = requests.join(lookup, key, "left")
    checked: Column = F.when(F.col(to).isNull(), F.raise_error(F.concat(F.lit(f"no {to} for "), F.col(key).cast("string"))).cast("long")).otherwise(F.col(to))
    return found.withColumn(to, checked)
