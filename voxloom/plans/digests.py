"""Digests of a frame's content by a tree of block hashes.

A cell's place is v, then t, then f. A block is a range of ``width`` places; its hash is SHA-256 over the text
``place:value`` of its cells that are not zero, by place and comma-joined (of a mask: the places that are true). Hashes
of ``fan`` neighbouring blocks are hashed together, level by level, up to one. The digest does not depend on how rows
are partitioned or ordered, nor on whether zeros are stored; no task holds more than a block, and one row reaches the driver.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contracts import InvalidArgument, OpParams, Receipt, digest, receipt_for
from .frame import Frame

WIDTH, FAN = 4096, 64


def _place(frame: Frame) -> Column:
    place, size = F.col(frame.keys[0]).cast("long"), frame.space.nvox
    for key, n in zip(frame.keys[1:], frame.space.dim[3:]):
        place, size = place + F.col(key).cast("long") * F.lit(size), size * n
    return place


def _of(rows: DataFrame, cell: Column) -> Column:
    """The hash of a group's rows (p, ...) in the order of p."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", cell.alias("cell")))), lambda x: x.cell), ","), 256)


def block_hashes(frame: Frame, width: int = WIDTH, fan: int = FAN, levels: int | None = None) -> DataFrame:
    """(level, block, hash): level 0 are blocks of cells; those without a cell that is not zero have no row.

    ``levels``: so many, else up to the one of a single block. NaN and infinities are cells like others; -0.0 is zero.
    A repeated cell of different values makes its block's hash depend on both.
    """
    if frame.kind == "parcels" or width < 1 or fan < 2:
        raise InvalidArgument("blocks of voxels, of at least one place and two blocks a level")
    value = F.col(frame.value)
    boolean = dict(frame.df.dtypes)[frame.value] == "boolean"
    cells = frame.df.where(value if boolean else value.cast("double") != 0).select(_place(frame).alias("p"), value.alias("x"))
    text = F.col("p").cast("string") if boolean else F.concat_ws(":", F.col("p").cast("string"), F.col("x").cast("double").cast("string"))
    now = cells.groupBy(F.floor(F.col("p") / width).alias("block")).agg(_of(cells, text).alias("hash"))
    out, level = None, 0
    size = frame.space.nvox
    for n in frame.space.dim[3 : 2 + len(frame.keys)]:
        size *= n
    blocks = -(-size // width)
    while True:
        rows = now.select(F.lit(level).alias("level"), "block", "hash")
        out = rows if out is None else out.union(rows)
        level += 1
        if level == levels or (levels is None and blocks <= 1):
            return out
        below = now.select(F.col("block").alias("p"), "hash")
        now = below.groupBy(F.floor(F.col("p") / fan).alias("block")).agg(_of(below, F.concat_ws(":", F.col("p").cast("string"), "hash")).alias("hash"))
        blocks = -(-blocks // fan)


def frame_digest(frame: Frame) -> str:
    """16 hex digits of the frame's kind, grid and content."""
    top = block_hashes(frame)
    root = top.orderBy(F.desc("level")).limit(1).collect()  # one row
    return digest(frame.kind, frame.space.dim, root[0].hash if root else "empty")


def sealed(mask: Frame) -> Frame:
    """The mask with its digest in its receipt: what is derived with it carries the digest on."""
    own = mask.receipt or receipt_for(mask.space, OpParams("mask"))
    return mask.like(mask.df, receipt=replace(own, mask_hash=frame_digest(mask)))


def mask_hash_of(mask: Frame | None) -> str:
    """The digest that a sealed mask carries; none of another."""
    return mask.receipt.mask_hash if mask is not None and mask.receipt is not None else Receipt().mask_hash
