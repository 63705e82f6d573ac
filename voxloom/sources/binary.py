"""Raw numbers on disk: elements of one type, and column-major matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.contracts import InvalidArgument
from ..plans.frame import Frame
from ..plans.space import Space
from .images import filesystem


def read_elements(path: str, dtype: str, n: int | None = None, offset: int = 0) -> np.ndarray:
    """n elements, or all complete ones; too few raise EOFError."""
    kind = np.dtype(dtype)
    store, name = filesystem(path)
    with store.open_input_file(name) as f:
        left = max(0, f.size() - offset) // kind.itemsize
        if n is not None and left < n:
            raise EOFError(f"{left} elements for {n}")
        n = left if n is None else n
        return np.frombuffer(f.read_at(n * kind.itemsize, offset), kind)


def write_elements(path: str, values, dtype: str) -> None:
    store, name = filesystem(path)
    with store.open_output_stream(name, compression=None) as f:
        f.write(np.asarray(values).astype(dtype).tobytes())


def write_rows(df: DataFrame, place: str, value: str, path: str, cells: int, dtype: str = "<f8") -> None:
    """The elements of a distributed vector in one file: ``cells`` of them, those without a row zero; by tasks at their offsets."""
    from . import images

    if cells < 1:
        raise InvalidArgument("no elements")
    frame = Frame(df.select(F.col(place).cast("long").alias("v"), F.col(value).cast("double").alias("value")), Space((cells, 1, 1)), "volume", True)
    images.write_image(frame, path, np.dtype(dtype).str, lambda block, sizes: b"", False)


class _Column(InputPartition):
    def __init__(self, column: int):
        self.column = column


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.dtype, self.rows = options["path"], options.get("dtype", "<f8"), int(options["rows"])
        self.offset = int(options.get("offset", 0))

    def partitions(self):
        store, name = filesystem(self.path)
        with store.open_input_file(name) as f:
            size = f.size() - self.offset
        width = self.rows * np.dtype(self.dtype).itemsize
        if size % width:
            raise InvalidArgument("the file is no whole number of columns")
        return [_Column(c) for c in range(size // width)]

    def read(self, partition):
        kind = np.dtype(self.dtype)
        x = read_elements(self.path, self.dtype, self.rows, self.offset + partition.column * self.rows * kind.itemsize).astype(float)
        for a in range(0, len(x), 1 << 16):
            part = x[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part))), pa.array(np.full(len(part), partition.column, np.int32)), pa.array(part)], names=["row", "col", "value"])


class ColumnMatrixSource(DataSource):
    """(row, col, value) of a column-major matrix; one partition per column. Options: path, rows, dtype, offset."""

    @classmethod
    def name(cls):
        return "colmatrix"

    def schema(self):
        return "row long, col int, value double"

    def reader(self, schema):
        return _Reader(self.options)


def read_columns(spark: SparkSession, path: str, rows: int, dtype: str = "<f8") -> DataFrame:
    spark.dataSource.register(ColumnMatrixSource)
    return spark.read.format("colmatrix").option("path", path).option("rows", rows).option("dtype", dtype).load()
