"""Best-fit packing into bins of several permitted capacities, planned on the histogram of lengths.

A text longer than the largest capacity is cut into pieces of that capacity and a rest. Pieces are packed in order of
falling length, each into the open bin with the least room that still takes it (best fit). If none does, a bin opens.
Its capacity is chosen from all permitted ones together: for each that holds the piece, a bin is filled on trial with
the piece and then always the longest pieces that still fit, from those that no earlier bin's trial has claimed; the
capacity whose trial costs least per unit of length packed opens (ties: the smaller), and claims its contents. At the
end each bin shrinks to the smallest permitted capacity that holds its contents.

All pieces of one length are alike, so the plan is made for ranges of pieces and of bins: the driver sees only how
many pieces each length has (one row per length, at most the largest capacity). Bins open together as long as every
trial would come out the same, so the work follows the number of lengths, not of pieces, and the result is that of
opening them one by one. Executors then look up which range a piece's rank within its length falls into. Ranks come
from counts per (length, bucket of doc_id), so a length that a third of all rows have is no single task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, shared_dir, written

CAPACITIES = (512, 2048, 8192)
BUCKETS = 256


def bin_cost(capacity: int) -> float:
    """What a bin costs by default: its length, a share for attention that grows with the square, and a fixed share."""
    return capacity * (1 + capacity / 24_576) + 16.0


def trial(length: int, capacity: int, claimable: dict[int, int], lengths: list[int]) -> tuple[dict[int, int], int]:
    """(pieces by length, their total) of a bin that takes a piece of ``length`` and then always the longest that fits.

    lengths: those with claimable pieces, rising; none above ``length`` is looked at.
    """
    room, inside, most = capacity, {}, length
    while (k := bisect_right(lengths, min(room, most)) - 1) >= 0:
        most = lengths[k]
        inside[most] = min(claimable[most], room // most)
        room -= inside[most] * most
        most -= 1
    return inside, capacity - room


def plan(histogram: dict[int, int], capacities: tuple[int, ...], cost=bin_cost) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, int]]]:
    """(placements, bins) for pieces counted by length.

    placements: (length, first rank, last rank, first bin, room taken before, pieces a bin): ranks a..b of the length go
    to the bins from the first on, so many to each. bins: (first bin, last bin, capacity) after downsizing.
    """
    capacities = tuple(sorted(set(capacities)))
    rooms: list[int] = []  # distinct rooms that open bins have, sorted
    groups: dict[int, list[tuple[int, int, int]]] = {}  # room: (first bin, last bin, capacity), first in first out
    placements, opened = [], 0
    claimable = dict(histogram)
    lengths = sorted(histogram)

    def claim(length: int, n: int) -> None:
        claimable[length] = n
        k = bisect_left(lengths, length)
        there = k < len(lengths) and lengths[k] == length
        if n and not there:
            lengths.insert(k, length)
        elif there and not n:
            del lengths[k]

    def put(room: int, group: tuple[int, int, int], place: int | None = None) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].insert(len(groups[room]) if place is None else place, group)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, last, capacity = groups[room].pop(0)
            else:
                claim(length, left)
                trials = [(c, *trial(length, c, claimable, lengths)) for c in capacities if c >= length]
                capacity, inside, _ = min(trials, key=lambda x: (cost(x[0]) / x[2], x[0]))
                # so many that no trial of any capacity would have come out otherwise meanwhile
                many = max(1, min((claimable[x] - max(t.get(x, 0) for _, t, _ in trials)) // inside[x] + 1 for x in inside))
                for x, n in inside.items():
                    claim(x, claimable[x] - many * n)
                room, first, last = capacity, opened, opened + many - 1
                opened += many
            # best fit fills a bin up with this length before it goes to the next with as much room
            per = min(room // length, left)
            n = min(last - first + 1, left // per)
            placements.append((length, rank, rank + n * per - 1, first, capacity - room, per))
            rank, left = rank + n * per, left - n * per
            if first + n <= last:
                put(room, (first + n, last, capacity), 0)
            if room in groups and not groups[room]:
                del groups[room], rooms[bisect_left(rooms, room)]
            put(room - per * length, (first, first + n - 1, capacity))
    bins = []
    for room, ranges in groups.items():
        for first, last, capacity in ranges:
            bins.append((first, last, next(c for c in capacities if c >= capacity - room)))
    return placements, sorted(bins)


def _ranges(spark: SparkSession, rows: list[tuple], **types: pa.DataType) -> DataFrame:
    """The plan's rows as a table, through Arrow: no Python worker of an executor has to start for it."""
    columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), types.values())]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=list(types)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, length: Column | None = None, id_col: str = "doc_id", cost=bin_cost) -> DataFrame:
    """(doc_id, piece, piece_start, length, bin_id, bin_offset, bin_capacity): one row per piece.

    cost: what a bin of a capacity costs. length: a column of ``docs``, by default the UTF-8 bytes of text and one end mark. Null and empty texts are
    pieces of the end mark alone. Every row of ``docs`` is packed, rows that repeat a doc_id or have a null one too.
    Other columns are not read. An empty table gives no rows.
    """
    shared_dir(spark)
    capacities = tuple(sorted(set(capacities)))
    most = capacities[-1]
    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + 1 if length is None else length.cast("long")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(size, F.lit(1)).alias("size"))
    pieces = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(BUCKETS)).cast("int"))
    pieces = pieces.select("doc_id", "bucket", "size", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / most).cast("int"))).alias("piece"))
    pieces = pieces.withColumn("length", F.least(F.lit(most), F.col("size") - F.col("piece").cast("long") * most).cast("int"))
    # equal pieces of equal rows may change places in a retry: they are alike in every column
    pieces = written(spark, pieces, "pieces")
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most the largest capacity rows
    placements, bins = plan(histogram, capacities, cost)
    if not placements:
        return pieces.select("doc_id", "piece", F.lit(0).cast("long").alias("piece_start"), "length", F.lit(0).cast("long").alias("bin_id"), F.lit(0).alias("bin_offset"), F.lit(0).alias("bin_capacity"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("length", "bucket", "before")
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("r") + F.col("before")).drop("r", "before")
    placed = _ranges(spark, placements, length=pa.int32(), a=pa.int64(), b=pa.int64(), first=pa.int64(), bin_offset=pa.int32(), per=pa.int32())
    # a length's placements as one sorted array, searched by the piece's rank
    by_length = placed.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("a", "b", "first", "bin_offset", "per"))).alias("places"))
    # at most the largest capacity's rows, and the plan's size is known here
    ranked = ranked.join(F.broadcast(by_length) if len(placements) <= BROADCAST_ROWS else by_length, "length")
    ranked = ranked.withColumn("place", F.element_at(F.filter("places", lambda p: (p.a <= F.col("rank")) & (F.col("rank") <= p.b)), 1))
    turn = F.col("rank") - F.col("place.a")
    bin_id = F.col("place.first") + F.floor(turn / F.col("place.per"))
    offset = (F.col("place.bin_offset") + F.pmod(turn, F.col("place.per").cast("long")) * F.col("length")).cast("int")
    out = ranked.select("doc_id", "piece", (F.col("piece").cast("long") * most).alias("piece_start"), "length", bin_id.alias("bin_id"), offset.alias("bin_offset"))
    # bins by blocks of ids, so that a range join becomes an equal one
    block = 1 << 10
    sizes = _ranges(spark, bins, a=pa.int64(), b=pa.int64(), bin_capacity=pa.int32()).withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.col("b") / block))))
    sizes = sizes.groupBy("block").agg(F.collect_list(F.struct("a", "b", "bin_capacity")).alias("sizes"))
    out = out.withColumn("block", F.floor(F.col("bin_id") / block)).join(sizes, "block")
    size_of = F.element_at(F.filter("sizes", lambda p: (p.a <= F.col("bin_id")) & (F.col("bin_id") <= p.b)), 1)
    return out.select("doc_id", "piece", "piece_start", "length", "bin_id", "bin_offset", size_of["bin_capacity"].alias("bin_capacity"))
