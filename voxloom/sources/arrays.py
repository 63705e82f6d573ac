"""Numpy arrays to frames and back, within stated sizes.

An array goes to the executors as Arrow batches of raw bytes, a run of places each; voxel numbers and values are made
there. What is larger than the driver should hold is refused: files are the way for it (``images``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans.contracts import InvalidArgument, OutOfBounds
from ..plans.frame import Frame
from ..plans.space import Space

#: Bytes of an array that may pass through the driver, either way.
MOST_BYTES = 256 << 20
#: Elements of a batch.
RUN = 1 << 16


def _expand(element: str, nvox: int, times: int):
    def run(batches):
        for batch in batches:
            for first, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(raw, element)
                p = np.arange(first, first + len(x))
                v, rest = p % nvox, p // nvox
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array((rest % times).astype(np.int32)), pa.array((rest // times).astype(np.int32)), pa.array(x.astype(np.float64))], names=["v", "t", "f", "x"])

    return run


def from_array(spark: SparkSession, array, space: Space | None = None, sparse: bool = False, mask: Frame | None = None, most: int = MOST_BYTES) -> Frame:
    """A 3-D array as a volume (of booleans: a mask of what is true), a 4-D as a series, a 5-D as a feature stack.

    The first axis runs fastest among voxel numbers. ``space``: of the array's shape; unit spacing without it.
    ``sparse``: without zeros (of a series: without voxels that are zero throughout).
    ``mask``: only its voxels. Complex numbers and objects are refused, and arrays over ``most`` bytes.
    """
    array = np.asarray(array)
    if array.ndim not in (3, 4, 5) or not array.size:
        raise InvalidArgument(f"an array of 3 to 5 axes that are not empty, not of shape {array.shape}")
    if array.dtype.kind not in "biuf":
        raise InvalidArgument(f"elements of type {array.dtype} are no numbers")
    if array.nbytes > most:
        raise InvalidArgument(f"{array.nbytes} bytes do not go through the driver (at most {most}): write them to a file")
    space = space or Space(array.shape)
    if space.dim[: array.ndim] != array.shape or space.ndim not in (3, array.ndim):
        raise InvalidArgument(f"a space of {space.dim} for an array of {array.shape}")
    if space.ndim < array.ndim:
        for n in array.shape[space.ndim :]:
            space = space.add_dim(n)
    boolean = array.dtype.kind == "b"
    flat = np.ascontiguousarray(array.ravel(order="F"))
    flat = flat.astype(flat.dtype.newbyteorder("="))
    runs = pa.table({"first": pa.array(range(0, len(flat), RUN), pa.int64()), "raw": pa.array([flat[a : a + RUN].tobytes() for a in range(0, len(flat), RUN)], pa.binary())})
    df = spark.createDataFrame(runs).repartition(max(1, min(runs.num_rows, 2 * spark.sparkContext.defaultParallelism)))
    rows = df.mapInArrow(_expand(flat.dtype.str, space.nvox, array.shape[3] if array.ndim > 3 else 1), "v long, t int, f int, x double")
    kind = {3: "volume", 4: "series", 5: "hyper"}[array.ndim]
    if boolean and array.ndim == 3:
        frame = Frame(rows.where("x <> 0").select("v", F.lit(True).alias("value")), space, "volume", True)
    else:
        columns = {"volume": ("v", F.col("x").alias("value")), "series": ("v", "t", "x"), "hyper": ("v", "t", "f", "x")}[kind]
        frame = Frame(rows.select(*columns), space, kind, False)
        if sparse:
            from ..plans.frame import sparsified

            frame = sparsified(frame)
    if mask is not None:
        from ..operators.select import in_mask

        frame = in_mask(frame, mask)
    return frame


def from_coords(spark: SparkSession, space: Space, coords, values) -> Frame:
    """A sparse volume of values at grid coordinates (n x 3); one outside the grid or given twice is an error."""
    coords, values = np.atleast_2d(np.asarray(coords)), np.atleast_1d(np.asarray(values, float))
    if coords.shape != (len(values), 3):
        raise InvalidArgument(f"{len(values)} values for coordinates of shape {coords.shape}")
    v = space.spatial.grid_to_index(coords)  # raises OutOfBounds
    if len(np.unique(v)) != len(v):
        raise InvalidArgument("a coordinate is given twice")
    return Frame(spark.createDataFrame(pa.table({"v": pa.array(v, pa.int64()), "value": pa.array(values)})), space.spatial, "volume", True)


def to_array(frame: Frame, box: tuple | None = None, most: int = MOST_BYTES) -> np.ndarray:
    """The frame, or a box ((first, last) of each spatial axis, both within) of it, as an array; cells without a row are zero.

    The box's rows alone are read and sent, as Arrow batches. Over ``most`` bytes it is refused, before any job.
    """
    space = frame.space
    dims = space.dim[:3] if frame.kind in ("volume", "labels") else space.dim
    box = box or tuple((0, d - 1) for d in dims[:3])
    if any(not 0 <= a <= b < d for (a, b), d in zip(box, dims)):
        raise OutOfBounds(f"the box {box} is not in the grid {dims[:3]}")
    shape = tuple(b - a + 1 for a, b in box) + tuple(dims[3:])
    if frame.kind == "parcels":
        raise InvalidArgument("a parcels frame has no grid")
    boolean = dict(frame.df.dtypes)[frame.value] == "boolean"
    if int(np.prod(shape, dtype=np.int64)) * (1 if boolean else 8) > most:
        raise InvalidArgument(f"an array of shape {shape} is over {most} bytes: take a box, or write a file")
    at = space.ijk()
    first, last = (space.spatial.grid_to_index([[e[k] for e in box]])[0] for k in (0, 1))
    inside = F.col("v").between(int(first), int(last))
    for c, (a, b) in zip(at, box):
        inside = inside & c.between(a, b)
    names = list(frame.keys[1:])
    found = frame.df.where(inside).select(*((c - a).cast("int").alias(n) for c, (a, _), n in zip(at, box, ("i", "j", "k"))), *names, frame.value).toArrow()
    out = np.zeros(shape, bool if boolean else float)
    if found.num_rows:
        out[tuple(found[n].to_numpy() for n in ("i", "j", "k", *names))] = found[frame.value].to_numpy()
    return out

