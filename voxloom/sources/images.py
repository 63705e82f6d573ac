"""Image files as one data source: what is stored where, read by volumes and written by blocks.

``Stored`` says where a file keeps its volumes; ``describe`` reads it from the file's content, whatever its name. The
source's partitions are runs of volumes, or, of a compressed file without an index, the whole file, inflated once and
cut as it comes. Compressed files that this module writes have one gzip member per block and a table of the members'
sizes, so that a task inflates only the blocks that it reads.

Writing: tasks pack blocks of fixed places (place = v + t * voxels). Uncompressed images on a file system are staged as
one file, into which each task writes its blocks at their offsets; otherwise each block is a part file of its own. The
commit messages list what was written, the commit checks that it is whole, and parts are put together by a second job
that copies each to its offset. The image appears by a rename at the end. No row passes through the driver.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..plans.contracts import BackendDrift, InvalidArgument, Receipt, SpaceMismatch
from ..plans.frame import Frame, numbered_sums, shared_folder
from ..plans.space import Space

#: A partition of the reader has volumes of so many bytes at most, or one.
READ_BYTES = 32 << 20
#: Voxels of a block that is written at once: a volume has whole blocks and a shorter last one.
BLOCK = 1 << 20
#: What is inflated from a compressed file at once.
INFLATE = 1 << 20

#: Bytes that this process has inflated of image data.
inflated = [0]


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def local(path: str) -> str | None:
    """The path in the machine's file tree, if it is there (a mount that driver and executors share, or local mode)."""
    from pyarrow import fs

    store, name = filesystem(path)
    return name if isinstance(store, fs.LocalFileSystem) else None


@dataclass(frozen=True)
class Stored:
    """Where a file keeps its volumes. kinds: the element type of each volume, or one for all; slopes alike."""

    path: str
    format: str
    data: str
    dim: tuple[int, ...]
    step: float
    affine: tuple[float, ...]
    kinds: tuple[str, ...]
    slopes: tuple[float, ...]
    intercept: float
    offset: int
    compressed: bool
    #: Of a file with an index: places a member, where the first member of data begins, and sizes of all.
    block: int = 0
    start: int = 0
    sizes: tuple[int, ...] = ()
    receipt: str | None = None

    @property
    def space(self) -> Space:
        return Space(self.dim[:3], trans=tuple(map(tuple, np.reshape(self.affine, (4, 4)).tolist())))

    @property
    def voxels(self) -> int:
        return int(np.prod(self.dim[:3], dtype=np.int64))

    @property
    def times(self) -> int:
        return int(np.prod(self.dim[3:], dtype=np.int64))

    def kind(self, t: int) -> np.dtype:
        return np.dtype(self.kinds[t] if len(self.kinds) > 1 else self.kinds[0])

    def slope(self, t: int) -> float:
        return self.slopes[t] if len(self.slopes) > 1 else self.slopes[0]

    def begin(self, t: int) -> int:
        """Where volume t begins in the inflated data."""
        if len(self.kinds) == 1:
            return self.offset + t * self.voxels * self.kind(0).itemsize
        return self.offset + sum(np.dtype(k).itemsize for k in self.kinds[:t]) * self.voxels


STORED = "path string, format string, data string, dim array<int>, step double, affine array<double>, kinds array<string>, slopes array<double>, intercept double, offset long, compressed boolean, block long, start long, sizes array<long>, receipt string"

_KINDS = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
_FIELDS = [(name, pa.list_(_KINDS[kind[6:-1]]) if kind.startswith("array") else _KINDS[kind]) for name, kind in (f.split() for f in STORED.split(", "))]


def describe(path: str) -> Stored:
    """From the file's content: NIfTI-1 (one file or a pair, compressed or not), or an AFNI pair by either of its names."""
    from . import afni, nifti

    for of in (nifti.stored, afni.stored):
        found = of(path)
        if found is not None:
            return found
    raise InvalidArgument(f"{path} is no image of a known format")


# --- reading --------------------------------------------------------------------------------------


def read_bytes(path: str, start: int = 0, size: int | None = None) -> bytes:
    store, name = filesystem(path)
    with store.open_input_file(name) as f:
        return f.read_at(f.size() - start if size is None else size, start)


def volumes(image: Stored, times: list[int], first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """(t, stored values of voxels ``first`` to ``last``) for ascending times."""
    if not image.compressed:
        store, name = filesystem(image.data)
        with store.open_input_file(name) as f:
            for t in times:
                kind = image.kind(t)
                yield t, np.frombuffer(f.read_at((last - first) * kind.itemsize, image.begin(t) + first * kind.itemsize), kind)
    elif image.sizes:
        per_volume = -(-image.voxels // image.block)
        at = image.start + np.cumsum((0, *image.sizes))
        store, name = filesystem(image.data)
        with store.open_input_file(name) as f:
            for t in times:
                parts = []
                for b in range(first // image.block, -(-last // image.block)):
                    k = t * per_volume + b
                    raw = zlib.decompress(f.read_at(int(at[k + 1] - at[k]), int(at[k])), 31)
                    inflated[0] += len(raw)
                    values = np.frombuffer(raw, image.kind(t))
                    parts.append(values[max(0, first - b * image.block) : last - b * image.block])
                yield t, np.concatenate(parts)
    else:
        stream = _inflating(image.data)
        held, at = b"", 0  # what is inflated and not yet used, and where it begins
        for t in times:
            kind = image.kind(t)
            begin, end = image.begin(t) + first * kind.itemsize, image.begin(t) + last * kind.itemsize
            parts = []
            while at + len(held) < end:
                if at + len(held) > begin:
                    parts.append(held[max(0, begin - at) :])
                at += len(held)
                held = next(stream, b"")
                if not held:
                    raise EOFError(f"{image.data} ends before volume {t}")
            parts.append(held[max(0, begin - at) : end - at])
            yield t, np.frombuffer(b"".join(parts), kind)


def _inflating(path: str) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, in pieces."""
    store, name = filesystem(path)
    with store.open_input_stream(name, compression=None) as f:
        one, raw = zlib.decompressobj(31), b""
        while raw or (raw := f.read(INFLATE)):
            piece = one.decompress(raw, INFLATE)
            raw = one.unconsumed_tail
            if one.eof:
                raw = one.unused_data.lstrip(b"\0")
                one = zlib.decompressobj(31)
            if piece:
                inflated[0] += len(piece)
                yield piece


def first_member(path: str, least: int) -> tuple[bytes, int | None]:
    """The ``least`` first inflated bytes of a gzip file and, if its first member ends with them, where the next begins."""
    store, name = filesystem(path)
    with store.open_input_stream(name, compression=None) as f:
        one, out, taken = zlib.decompressobj(31), b"", 0
        while not one.eof and len(out) <= least:
            raw = one.unconsumed_tail
            if not raw:
                raw = f.read(4096)
                taken += len(raw)
            if not raw:
                break
            out += one.decompress(raw, least + 1 - len(out))
        return out[:least], taken - len(one.unused_data) if one.eof and len(out) == least else None


@dataclass
class Run(InputPartition):
    """Volumes of one file: the times that they have in the result and in the file."""

    image: Stored
    times: list[tuple[int, int]]


class _Reader(DataSourceReader):
    """Filters on t choose volumes, those on v cut what is read of one."""

    def __init__(self, options):
        self.options = dict(options)
        self.first, self.last, self.low, self.high, self.only = 0, None, 0, None, None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("t", "v"):
                low = high = only = None
                if isinstance(f, EqualTo):
                    only = {int(f.value)}
                elif isinstance(f, In) and f.value:
                    only = {int(x) for x in f.value if x is not None}
                elif isinstance(f, GreaterThanOrEqual):
                    low = int(f.value)
                elif isinstance(f, GreaterThan):
                    low = int(f.value) + 1
                elif isinstance(f, LessThan):
                    high = int(f.value)
                elif isinstance(f, LessThanOrEqual):
                    high = int(f.value) + 1
                if only:
                    low, high = min(only), max(only) + 1
                if column == "t":
                    self.low = max(self.low, low or 0)
                    self.high = high if self.high is None else self.high if high is None else min(high, self.high)
                    if only is not None:
                        self.only = only if self.only is None else self.only & only
                else:
                    self.first = max(self.first, low or 0)
                    self.last = high if self.last is None else self.last if high is None else min(high, self.last)
            yield f  # Spark checks all of them again

    def _images(self) -> Iterator[tuple[Stored, int]]:
        """(image, its first time in the result). Of many files the scan has written a table: none is opened here."""
        if "manifest" in self.options:
            import pyarrow.parquet as pq
            from pyarrow import fs

            store, name = filesystem(self.options["manifest"])
            files = sorted(x.path for x in store.get_file_info(fs.FileSelector(name)) if x.path.endswith(".parquet"))
            for file in files:
                for row in pq.read_table(file, filesystem=store).to_pylist():
                    at, row = row["first_t"], {k: row[k] for k in Stored.__dataclass_fields__}
                    yield Stored(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.items()}), at
        else:
            yield describe(self.options["path"]), 0

    def partitions(self):
        out = []
        for image, at in self._images():
            times = [(at + t, t) for t in range(image.times) if (self.only is None or at + t in self.only) and at + t >= self.low and (self.high is None or at + t < self.high)]
            if not times:
                continue
            if image.compressed and not image.sizes:
                out.append(Run(image, times))
                continue
            each = max(1, READ_BYTES // max(1, image.voxels * image.kind(0).itemsize))
            out += [Run(image, times[a : a + each]) for a in range(0, len(times), each)]
        return _grouped(out)

    def read(self, partition):
        for run in partition.runs:
            image = run.image
            first, last = self.first, image.voxels if self.last is None else min(self.last, image.voxels)
            if first >= last:
                continue
            named = {own: t for t, own in run.times}
            for own, values in volumes(image, sorted(named), first, last):
                for a in range(0, len(values), 1 << 16):
                    part = values[a : a + (1 << 16)].astype(np.float64)
                    slope = image.slope(own)
                    if slope != 1.0 or image.intercept != 0.0:
                        part = part * slope + image.intercept
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + a, first + a + len(part))), pa.array(np.full(len(part), named[own], np.int32)), pa.array(part)], names=["v", "t", "x"])


@dataclass
class Runs(InputPartition):
    runs: list[Run]


def _grouped(runs: list[Run]) -> list[Runs]:
    """Small files are read many a task."""
    out, size = [], 0
    for run in runs:
        bytes_of = len(run.times) * run.image.voxels * run.image.kind(0).itemsize
        if not out or size + bytes_of > READ_BYTES:
            out.append(Runs([]))
            size = 0
        out[-1].runs.append(run)
        size += bytes_of
    return out


# --- writing --------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """Blocks of one task: (number, part file or empty, bytes), and how many places had a row."""

    blocks: list[tuple[int, str, int]]
    rows: int


class ImageWriter(DataSourceArrowWriter):
    """Options: stage (a folder), image (name of the staged file in it, or empty for part files), element, cells, block,
    voxels, offset, compressed, whole (all cells must have a row); each: one file a time, named by it and this ending,
    behind the bytes of lead (in hex)."""

    def __init__(self, options):
        self.stage, self.image, self.element = options["stage"], options.get("image", ""), options["element"]
        self.cells, self.block, self.voxels, self.offset = (int(options[k]) for k in ("cells", "block", "voxels", "offset"))
        self.compressed, self.whole = options["compressed"] == "true", options["whole"] == "true"
        self.each, self.lead = options.get("each", ""), bytes.fromhex(options.get("lead", ""))

    def _blocks(self) -> Iterator[tuple[int, int]]:
        per_volume = -(-self.voxels // self.block)
        for k in range(self.cells // self.voxels * per_volume):
            yield self._range(k)

    def _range(self, k: int) -> tuple[int, int]:
        per_volume = -(-self.voxels // self.block)
        t, b = divmod(k, per_volume)
        first = t * self.voxels + b * self.block
        return first, min(first + self.block, (t + 1) * self.voxels)

    def write(self, iterator) -> Written:
        kind = np.dtype(self.element)
        out, rows = [], 0
        number, held, last = None, None, -1

        def save():
            raw = held.tobytes()
            first, _ = self._range(number)
            if self.each:
                out.append((number, self._save_volume(first, raw, kind.itemsize), len(raw)))
                return
            if self.image:
                with open(os.open(f"{local(self.stage)}/{self.image}", os.O_WRONLY | os.O_CREAT, 0o644), "r+b", buffering=0) as f:
                    f.seek(self.offset + first * kind.itemsize)
                    f.write(raw)
                out.append((number, "", len(raw)))
                return
            name = f"{number}-{uuid.uuid4().hex}"
            raw = packed(raw) if self.compressed else raw
            store, folder = filesystem(self.stage)
            with store.open_output_stream(f"{folder}/{name}", compression=None) as f:
                f.write(raw)
            out.append((number, name, len(raw)))

        for batch in iterator:
            blocks, places, values = batch.column("b").to_numpy(), batch.column("p").to_numpy(), batch.column("x").to_numpy(zero_copy_only=False)
            rows += len(places)
            if len(places) and (places.min() < 0 or places.max() >= self.cells):
                raise InvalidArgument(f"a place outside the image's {self.cells}")
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for a, e in zip([0, *cuts], [*cuts, len(blocks)]):
                if a == e:
                    continue
                if blocks[a] != number:
                    if number is not None:
                        save()
                    number, last = int(blocks[a]), -1
                    held = np.zeros(np.diff(self._range(number))[0], kind)
                own = places[a:e]
                if own[0] <= last or (np.diff(own) <= 0).any():
                    raise InvalidArgument(f"more than one value for place {int(own[0])}, or one behind it")
                last = own[-1]
                held[own - self._range(number)[0]] = values[a:e].astype(kind)
        if number is not None:
            save()
        return Written(out, rows)

    def _save_volume(self, first: int, raw: bytes, width: int) -> str:
        """A block of one time's own file: at its offset on a file system, else the block is the whole volume."""
        t, at = divmod(first, self.voxels)
        name = f"{t:06d}{self.each}"
        if (folder := local(self.stage)) is not None:
            with open(os.open(f"{folder}/{name}", os.O_WRONLY | os.O_CREAT, 0o644), "r+b", buffering=0) as f:
                if at == 0:
                    f.write(self.lead)
                f.seek(len(self.lead) + at * width)
                f.write(raw)
        else:
            store, folder = filesystem(self.stage)
            with store.open_output_stream(f"{folder}/{name}", compression=None) as f:
                f.write(self.lead + raw)
        return name

    def commit(self, messages) -> None:
        """Checks that blocks came once and, of a dense frame, all cells; the part files are listed by block, blocks without rows as one of zeros."""
        found = [b for m in messages if m for b in m.blocks]
        rows = sum(m.rows for m in messages if m)
        if self.whole and rows != self.cells:
            self.abort(messages)
            raise InvalidArgument(f"{rows} values for {self.cells} cells")
        if len({k for k, _, _ in found}) != len(found):
            self.abort(messages)
            raise InvalidArgument("a block was written twice")
        store, folder = filesystem(self.stage)
        if self.each:
            missing = self.cells // self.voxels * -(-self.voxels // self.block) - len(found)
            if missing:
                self.abort(messages)
                raise InvalidArgument(f"{missing} blocks have no row")
            return
        if self.image:
            with open(os.open(f"{local(self.stage)}/{self.image}", os.O_WRONLY | os.O_CREAT, 0o644), "r+b") as f:
                f.truncate(self.offset + self.cells * np.dtype(self.element).itemsize)  # cells without a row read as zero
            return
        by_number, zeros, parts = {k: (name, size) for k, name, size in found}, {}, []
        for k, (first, last) in enumerate(self._blocks()):
            if k not in by_number:
                n = last - first
                if n not in zeros:
                    raw = bytes(n * np.dtype(self.element).itemsize)
                    raw = packed(raw) if self.compressed else raw
                    zeros[n] = (f"zeros-{n}", len(raw))
                    with store.open_output_stream(f"{folder}/zeros-{n}", compression=None) as f:
                        f.write(raw)
                by_number[k] = zeros[n]
            parts.append(by_number[k])
        with store.open_output_stream(f"{folder}/manifest.json", compression=None) as f:
            f.write(json.dumps(parts).encode())

    def abort(self, messages) -> None:
        """Nothing of a failed write stays."""
        store, folder = filesystem(self.stage)
        _remove(store, folder)


def packed(raw: bytes) -> bytes:
    """One gzip member."""
    one = zlib.compressobj(4, zlib.DEFLATED, 31)
    return one.compress(raw) + one.flush()


class ImageSource(DataSource):
    """Reads with option path or manifest; writes with those of ImageWriter."""

    @classmethod
    def name(cls):
        return "voxels"

    def schema(self):
        return "v long, t int, x double"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return ImageWriter(dict(self.options))


def _blocks_of(frame: Frame, block: int, element: str) -> DataFrame:
    """(b, p, x): blocks, whole and sorted by place, dealt over tasks of about 64 MB."""
    n, cells = frame.space.nvox, int(np.prod(frame.space.dim, dtype=np.int64))
    per_volume = -(-n // block)
    t = F.col("t").cast("long") if frame.kind == "series" else F.lit(0).cast("long")
    rows = frame.df.select((t * per_volume + F.floor(F.col("v") / block)).cast("long").alias("b"), (t * n + F.col("v")).alias("p"), F.col(frame.value).cast("double").alias("x"))
    tasks = max(frame.df.sparkSession.sparkContext.defaultParallelism, cells * np.dtype(element).itemsize // (64 << 20))
    return rows.repartition(max(1, min(cells // n * per_volume, tasks)), "b").sortWithinPartitions("b", "p")


def write_image(frame: Frame, path: str, element: str, header, compressed: bool, block: int | None = None) -> list[int]:
    """The values of a volume or series in order of voxel, then time, behind the bytes that ``header(block, sizes)`` gives
    (sizes: of the compressed blocks); returns those sizes.

    What a sparse frame lacks is zero; of a dense one all cells must have a row. The file appears at ``path`` at the end,
    or not at all.
    """
    spark = frame.df.sparkSession
    spark.dataSource.register(ImageSource)
    n = frame.space.nvox
    cells = int(np.prod(frame.space.dim, dtype=np.int64))
    block = min(block or BLOCK, n)
    rows = _blocks_of(frame, block, element)
    folder, _, name = path.rpartition("/")
    stage = f"{folder}/.{name}-{uuid.uuid4().hex}"
    store, stage_name = filesystem(stage)
    store.create_dir(stage_name)
    in_place = not compressed and local(stage) is not None
    lead = b"" if compressed else header(0, [])
    options = {"stage": stage, "image": "image" if in_place else "", "element": element, "cells": cells, "block": block, "voxels": n, "offset": len(lead), "compressed": str(compressed).lower(), "whole": str(not frame.sparse).lower()}
    try:
        rows.write.format("voxels").options(**{k: str(v) for k, v in options.items()}).mode("append").save()
        sizes = []
        if in_place:
            with open(f"{local(stage)}/image", "r+b") as f:
                f.write(lead)
        else:
            parts = json.loads(read_bytes(f"{stage}/manifest.json"))
            sizes = [size for _, size in parts]
            _put_together(spark, stage, packed(header(block, sizes)) if compressed and (lead := header(block, sizes)) else lead, parts)
        _, target = filesystem(path)
        store.move(f"{stage_name}/image", target)
    finally:
        _remove(store, stage_name)
    return sizes


def write_volumes(frame: Frame, folder: str, dtype: str = "f4") -> None:
    """A NIfTI file for each time of a dense series, ``000000.nii`` and so on, in a new folder that appears at the end or not at all."""
    from . import nifti

    spark = frame.df.sparkSession
    spark.dataSource.register(ImageSource)
    if frame.kind != "series" or frame.sparse:
        raise InvalidArgument("one file a time is written of a dense series")
    lead, element = nifti.build_header(frame.space.spatial, dtype, frame.receipt), np.dtype(dtype).newbyteorder("<").str
    n, cells = frame.space.nvox, int(np.prod(frame.space.dim, dtype=np.int64))
    above, _, name = folder.rstrip("/").rpartition("/")
    stage = f"{above}/.{name}-{uuid.uuid4().hex}"
    block = min(BLOCK, n) if local(stage) is not None else n
    store, stage_name = filesystem(stage)
    store.create_dir(stage_name)
    options = {"stage": stage, "element": element, "cells": cells, "block": block, "voxels": n, "offset": len(lead), "compressed": "false", "whole": "true", "each": ".nii", "lead": lead.hex()}
    try:
        _blocks_of(frame, block, element).write.format("voxels").options(**{k: str(v) for k, v in options.items()}).mode("append").save()
        store.move(stage_name, filesystem(folder.rstrip("/"))[1])
    finally:
        _remove(store, stage_name)


def _remove(store, folder: str) -> None:
    from pyarrow import fs

    if store.get_file_info(folder).type != fs.FileType.NotFound:
        store.delete_dir(folder)


def _put_together(spark: SparkSession, stage: str, lead: bytes, parts: list) -> None:
    """Header and part files as one: on a file system each task copies some to their offsets, elsewhere one task streams them."""
    at = len(lead) + np.cumsum([0, *(size for _, size in parts)])
    store, folder = filesystem(stage)
    with store.open_output_stream(f"{folder}/lead", compression=None) as f:
        f.write(lead)
    rows = [(k + 1, name, int(at[k])) for k, (name, _) in enumerate(parts)]
    rows.insert(0, (0, "lead", 0))
    in_place = local(stage)
    tasks = min(len(rows), spark.sparkContext.defaultParallelism) if in_place else 1

    def copy(batches):
        own, folder = filesystem(stage)
        total = 0
        if in_place:
            out = open(os.open(f"{folder}/image", os.O_WRONLY | os.O_CREAT, 0o644), "r+b", buffering=0)
        else:
            out = own.open_output_stream(f"{folder}/image", compression=None)
        with out:
            for batch in batches:
                for name, place in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    if in_place:
                        out.seek(place)
                    with own.open_input_stream(f"{folder}/{name}", compression=None) as f:
                        while raw := f.read(8 << 20):
                            out.write(raw)
                            total += len(raw)
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["bytes"])

    table = spark.createDataFrame(rows, "k int, name string, at long")
    dealt = table.repartition(tasks, "k") if in_place else table.coalesce(1).sortWithinPartitions("k")
    got = dealt.mapInArrow(copy, "bytes long").agg(F.sum("bytes")).first()[0]
    if got != at[-1]:
        raise InvalidArgument(f"{got} bytes were put together of {at[-1]}")


# --- many files -----------------------------------------------------------------------------------


def scan_headers(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(ord, all fields of Stored, error): the headers of many files, read by a job; error says why one cannot be read.

    ``paths``: a list, in its order; or a folder or pattern, listed by Spark and ordered by name (an AFNI pair by its HEAD).
    """
    if isinstance(paths, str):
        listed = spark.read.format("binaryFile").load(paths).select("path").where("not path rlike '[.](BRIK|BRIK[.]gz|img|img[.]gz)$'")
        from ..plans.frame import numbered

        named = numbered(listed, "path", "ord").select("ord", "path")
    else:
        named = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "ord long, path string").repartition(max(1, min(len(paths) // 8, 8 * spark.sparkContext.defaultParallelism)), "ord")

    schema = pa.schema([("ord", pa.int64()), *_FIELDS, ("error", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for k, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    out.append({"ord": k, **asdict(describe(path)), "error": None})
                except Exception as e:  # a bad file is a row, not an end of the scan
                    out.append({"ord": k, "path": path, "error": f"{type(e).__name__}: {e}"})
            yield from pa.Table.from_pylist(out, schema=schema).to_batches()

    return named.mapInArrow(run, f"ord long, {STORED}, error string")


def open_images(spark: SparkSession, paths: list[str] | str, atol: float = 1e-6) -> tuple[DataFrame, Stored, int]:
    """(rows, the first image, volumes in all): all files one behind the other in time, as a plan.

    Headers are read by one job, compared with the first one's by an aggregation (a differing grid or affine raises
    BackendDrift and names the first such file, one that cannot be read InvalidArgument), and numbered by a running sum
    of their volumes. The table of headers goes to the shared folder, where the source's planner finds it.
    """
    heads = scan_headers(spark, paths)
    heads.write.parquet(scanned := f"{shared_folder(spark)}/headers-{uuid.uuid4().hex}")
    heads = spark.read.schema(heads.schema).parquet(scanned)
    bad = heads.where("error is not null").agg(F.min_by(F.struct("path", "error"), "ord")).first()[0]
    if bad is not None:
        raise InvalidArgument(f"{bad.path}: {bad.error}")
    first = heads.orderBy("ord").limit(1).collect()
    if not first:
        raise InvalidArgument("no image file")
    stored = Stored(**{k: tuple(v) if isinstance(v, list) else v for k, v in first[0].asDict().items() if k in Stored.__dataclass_fields__})
    affine = F.array(*(F.lit(float(x)) for x in stored.affine))
    moved = F.exists(F.zip_with("affine", affine, lambda a, b: F.abs(a - b) > atol + 1e-5 * F.abs(b)), lambda x: x)
    other = F.slice("dim", 1, 3) != F.array(*(F.lit(int(x)) for x in stored.dim[:3]))
    drift = heads.agg(F.min_by("path", F.when(other | moved, F.col("ord"))), F.min(F.when(other | moved, F.col("ord")))).first()
    if drift[1] is not None:
        raise BackendDrift(f"{drift[0]}: grids or transforms differ from {stored.path}")
    volumes_of = F.aggregate(F.slice("dim", 4, 4), F.lit(1).cast("long"), lambda a, x: a * x)
    ordered, total = numbered_sums(heads.withColumn("times", volumes_of), "ord", "times", "first_t")
    ordered.drop("times").write.parquet(manifest := f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}")
    return _load(spark, manifest=manifest), stored, total


def _load(spark: SparkSession, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageSource)
    return spark.read.format("voxels").options(**options).load()


def read_image(spark: SparkSession, paths: str | list[str], type: str = "auto", index: int | None = None, indices: list[int] | None = None, mask: Frame | None = None) -> Frame:
    """A volume or series of one image file or of many, by their content.

    type "auto": a file with more than one volume is a series, with one a volume; many files are a series, one behind the
    other. "vol": volume ``index`` (0) of one file. "vec": a series. ``indices``: the volumes to read of each file, in
    their order, repeats too; only these are read. ``mask``: a volume frame with BOOLEAN values; the result is sparse,
    with its voxels alone.
    """
    if type not in ("auto", "vol", "vec"):
        raise InvalidArgument(f"no type {type!r}")
    many = not isinstance(paths, str)
    if many and not paths:
        raise InvalidArgument("no image file")
    if many and len(paths) == 1:
        paths, many = paths[0], False
    if many:
        if type == "vol":
            raise InvalidArgument("a volume is read of one file")
        if indices is not None:
            parts = [read_series(spark, p, indices, mask) for p in paths]  # each file's own volumes
            out, at = parts[0].df, parts[0].space.dim[3]
            for part in parts[1:]:
                try:
                    parts[0].space.compatible_with(part.space)
                except SpaceMismatch as e:
                    raise BackendDrift(str(e)) from None
                out = out.union(part.df.withColumn("t", (F.col("t") + at).cast("int")))
                at += part.space.dim[3]
            return parts[0].like(out, space=parts[0].space.spatial.add_dim(at, parts[0].space.spacing[3]))
        df, first, total = open_images(spark, paths)
        return _masked(Frame(df, first.space.add_dim(total, first.step), "series", False, _receipt(first)), mask)
    image = describe(paths)
    if type == "vol" or (type == "auto" and image.times == 1):
        return _masked(read_volume(spark, paths, index or 0), mask)
    return read_series(spark, paths, [index] if indices is None and index is not None else indices, mask)


def read_volume(spark: SparkSession, path: str, index: int = 0, mask: Frame | None = None) -> Frame:
    image = describe(path)
    if not 0 <= index < image.times:
        raise InvalidArgument(f"no volume {index} of {image.times}")
    df = _load(spark, path=path).where(F.col("t") == index).select("v", F.col("x").alias("value"))
    return _masked(Frame(df, image.space, "volume", False, _receipt(image)), mask)


def read_volumes(spark: SparkSession, paths: list[str], index: int = 0) -> list[Frame]:
    """Volume ``index`` of each file; their spaces may differ. Headers are read by one job."""
    rows = scan_headers(spark, list(paths)).orderBy("ord").collect()  # one row per path that was asked for
    out = []
    for r in rows:
        if r.error:
            raise InvalidArgument(f"{r.path}: {r.error}")
        image = Stored(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.asDict().items() if k in Stored.__dataclass_fields__})
        if not 0 <= index < image.times:
            raise InvalidArgument(f"{r.path}: no volume {index} of {image.times}")
        out.append(Frame(_load(spark, path=r.path).where(F.col("t") == index).select("v", F.col("x").alias("value")), image.space, "volume", False, _receipt(image)))
    return out


def read_series(spark: SparkSession, path: str, indices: list[int] | None = None, mask: Frame | None = None) -> Frame:
    image = describe(path)
    df, times = _load(spark, path=path), image.times
    if indices is not None:
        if any(not 0 <= t < times for t in indices):
            raise InvalidArgument(f"indices outside 0 to {times - 1}")
        order = {}
        for k, t in enumerate(indices):
            order.setdefault(t, []).append(k)
        df = df.where(F.col("t").isin(*order)) if order else df.where("false")
        if indices != sorted(order):  # repeats multiply rows by their number
            places = F.broadcast(spark.createDataFrame([(t, k) for t, ks in order.items() for k in ks] or [(0, 0)], "t int, k int"))
            df = df.join(places, "t").select("v", F.col("k").alias("t"), "x")
        elif indices != list(range(len(indices))):
            df = df.select("v", (F.array_position(F.array(*map(F.lit, indices)), F.col("t")) - 1).cast("int").alias("t"), "x")
        times = len(indices)
    return _masked(Frame(df, image.space.add_dim(max(1, times), image.step), "series", False, _receipt(image)), mask)


def _receipt(image: Stored) -> Receipt | None:
    return Receipt.from_json(image.receipt) if image.receipt else None


def _masked(frame: Frame, mask: Frame | None) -> Frame:
    if mask is None:
        return frame
    frame.space.compatible_with(mask.space)
    return frame.like(frame.df.join(mask.df.where(F.col(mask.value).cast("boolean")).select("v"), "v", "left_semi"), sparse=True, every_time=frame.has_all_times)
