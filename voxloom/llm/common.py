"""What the operators of this subpackage share: tables, the shared folder, text to numpy."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An Arrow batch to a Python worker has at most so many rows, and ends at the row that reaches so many bytes.
ROWS_PER_BATCH, BYTES_PER_BATCH = "2000", "1m"
#: Parquet is read in vectors of so many rows: those of a text column are single arrays of the heap.
ROWS_PER_VECTOR = "256"

# Python workers are reused: what they free of 1 MB or more goes back to the machine (glibc's M_MMAP_THRESHOLD)
if hasattr(ctypes.CDLL(None), "mallopt"):
    ctypes.CDLL(None).mallopt(-3, 1 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme: ``spark.checkpoint.dir``; in local mode else one of our own.

    Also bounds Arrow batches by rows and bytes, so that a batch of long texts fits a Python worker, and the rows of a
    vector that Parquet is read into.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", ROWS_PER_VECTOR)
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and (current := context._jsc.sc().getCheckpointDir()).isDefined():
        found = str(current.get())
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="voxloom-"))
        found = str(context._jsc.sc().getCheckpointDir().get())
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; it goes when the driver's process ends, or earlier by ``remove``."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may have gone first
        pass


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(spark: SparkSession, df: DataFrame, what: str, **options) -> DataFrame:
    """``df`` through a Parquet table in the shared folder: lineage is cut and survives lost executors."""
    path = scratch(spark, what)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._voxloom_path = path
    return out


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    for df in frames:
        remove(spark, df._voxloom_path)


#: The most rows of a few numbers each that are broadcast (under 64 MB).
BROADCAST_ROWS = 1_000_000


def fits(df: DataFrame) -> DataFrame:
    """``df`` for a broadcast if it has at most BROADCAST_ROWS rows, else as it is: the join then shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


# --- words and shingles of a batch of texts, as 64-bit hashes -------------------------------------

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (splitmix64's)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", _BASE), ("i", _INVERSE)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values; much faster here than np.unique."""
    a = np.sort(a)
    keep = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=keep[1:])
    return a[keep]


def slices(lengths: np.ndarray, most: int):
    """(first, last) row ranges of at most ``most`` bytes each, or of one longer row."""
    a, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield a, i
            a, total = i, 0
        total += int(n)
    if a < len(lengths):
        yield a, len(lengths)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and for each text where its words begin (one entry more at the end).

    ``data``: UTF-8 bytes of the texts, one behind the other; ``bounds``: where each begins and the last ends.
    A word is a run of bytes outside space, tab, LF, VT, FF and CR; A-Z count as a-z.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = _IS_WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < n)]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    powers, inverses = _powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_LOWER[data] * powers, out=sums[1:])
    hashes = mix((sums[e] - sums[s]) * inverses[s] + (e - s).astype(np.uint64))
    return hashes, np.searchsorted(s, bounds)


def shingle_sets(column, width: int, at_once: int = 1 << 18):
    """For each text of an Arrow string array the sorted distinct hashes of its ``width``-word shingles.

    Fewer words than ``width``: the whole sequence is one shingle; no words or null: none.
    """
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    for a, b in slices(np.diff(offsets), at_once):
        words, first = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        full = len(words) - width + 1
        if full > 0:
            shingles = words[:full].copy()
            for k in range(1, width):
                shingles = mix(shingles * _U(0xD6E8FEB86659FD93) + words[k : full + k])
        for i in range(b - a):
            u, v = first[i], first[i + 1]
            if v - u >= width:
                yield distinct(shingles[u : v - width + 1])
            elif v > u:
                h = words[u]
                with np.errstate(over="ignore"):
                    for k in range(u + 1, v):
                        h = mix(h * _U(0xA0761D6478BD642F) + words[k])
                    yield np.array([mix(h + _U(v - u))], np.uint64)
            else:
                yield np.empty(0, np.uint64)
