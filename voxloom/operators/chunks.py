"""Functions over chunks of a frame, as table functions with a partition per chunk.

A chunk is a run of ``size`` positions of one axis. Spark sorts its rows by time and voxel and hands them to the
function in Arrow batches; what it keeps between them is its state, and what it returns at the end its rows. A chunk is
never one object unless the function makes it one (``Whole`` does).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.contracts import InvalidArgument
from ..plans.frame import Frame

AXES = {"x": 0, "y": 1, "z": 2, "t": 3}


def process_chunks(frame: Frame, make: Callable[[int], object], schema: str, size: int, axis: str = "t") -> DataFrame:
    """(chunk, columns of ``schema``): for each chunk what ``make(chunk)`` gives: an object with ``add(t, v, x)``, called
    with arrays in the order of time and voxel, and ``rows()``, an iterable of tuples, called once at the end.

    Chunks without a stored row have none. ``make`` must depend on nothing but its argument, as lost tasks run again.
    """
    if axis not in AXES or (axis == "t" and frame.kind != "series"):
        raise InvalidArgument(f"no axis {axis!r} of a {frame.kind}")
    if size < 1:
        raise InvalidArgument("a chunk has at least one position")
    place = F.col("t") if axis == "t" else frame.space.ijk()[AXES[axis]]
    t = F.col("t").cast("int") if frame.kind == "series" else F.lit(0)
    rows = frame.df.select(F.floor(place / size).cast("long").alias("chunk"), t.alias("t"), F.col("v").cast("long").alias("v"), F.col(frame.value).cast("double").alias("x"))

    names = StructType.fromDDL(f"chunk long, {schema}").names

    @F.arrow_udtf(returnType=f"chunk long, {schema}")
    class Chunk:
        def __init__(self):
            self.number = self.own = None

        def eval(self, table: pa.RecordBatch):
            if not table.num_rows:
                return
            if self.own is None:
                self.number = table.column(0)[0].as_py()
                self.own = make(self.number)
            self.own.add(*(table.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)))
            yield from ()

        def terminate(self):
            if self.own is not None:
                found = [(self.number, *r) for r in self.own.rows()]
                if found:
                    yield pa.table([pa.array(c) for c in zip(*found)], names=names)

    return Chunk(rows.asTable().partitionBy("chunk").orderBy("t", "v"))


class Whole:
    """State that makes a chunk one (time, voxel) array with zeros where rows are absent, for a function of it; as much memory as the chunk has."""

    def __init__(self, f: Callable, voxels: int, first: int = 0, times: int = 1):
        self.f, self.data, self.first = f, np.zeros((times, voxels)), first

    def add(self, t, v, x) -> None:
        self.data[t - self.first, v] = x

    def rows(self):
        return [tuple(np.atleast_1d(self.f(self.data)).tolist())]
