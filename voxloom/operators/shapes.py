"""Searchlight regions of random and shaped neighbourhoods, as column expressions.

Random numbers are hashes of a seed, the centre and what they are for, so a region is the same however rows are
partitioned and however often a task runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.contracts import InvalidArgument
from ..plans.frame import Frame
from ..plans.space import Space
from .neighbor import ball_offsets, box_offsets, random_centers, scattered


def uniform(seed: int, *of) -> Column:
    """From 0 up to 1, by 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *(F.lit(x) if not isinstance(x, Column) else x for x in of)), 11) * F.lit(2.0**-53)


def normal(seed: int, *of) -> Column:
    """Standard normal, of two uniform numbers."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, *of, 1))) * F.cos(2 * math.pi * uniform(seed, *of, 2))


def _laid(centers: DataFrame, space: Space, offsets) -> DataFrame:
    """(center, v, di, dj, dk): the offsets laid on each centre (a column v), cut at the grid's edges."""
    at = centers.select(F.col("v").alias("center"))
    rows = scattered(at, space, offsets, space.ijk("center"), ["center"])
    return rows.select("center", "v", *((a - b).cast("double").alias(n) for a, b, n in zip(space.ijk(), space.ijk("center"), ("di", "dj", "dk"))))


def ellipsoid_regions(centers: DataFrame, space: Space, radius: float, scales=(1.0, 1.0, 1.0), jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """(center, v): of each centre's ball (``radius`` mm) the voxels whose scaled offset is at most ``radius`` voxels long.

    ``jitter``: each centre's scales are multiplied by 1 and a normal number of that deviation.
    """
    if len(scales) != 3 or min(scales) <= 0 or jitter < 0:
        raise InvalidArgument("three positive scales and a jitter of at least 0")
    sums = F.lit(0.0)
    for axis, (d, s) in enumerate(zip(("di", "dj", "dk"), scales)):
        scale = F.greatest(F.lit(float(s)) * (1 + normal(seed, F.col("center"), axis) * jitter), F.lit(2.0**-52)) if jitter else F.lit(float(s))
        sums = sums + F.pow(F.col(d) * scale, 2)
    return _laid(centers, space, ball_offsets(space, radius)).where(sums <= radius**2).select("center", "v")


def cube_regions(centers: DataFrame, space: Space, radius: float) -> DataFrame:
    """(center, v): cubes that reach ``radius`` mm or the next voxel beyond it, to each side."""
    return _laid(centers, space, box_offsets(tuple(math.ceil(radius / s) for s in space.spacing[:3]))).select("center", "v")


def blobby_regions(centers: DataFrame, space: Space, radius: float, drop: float = 0.3, edge_fraction: float = 0.7, seed: int = 0) -> DataFrame:
    """(center, v): balls whose edge loses voxels by chance.

    The edge are the voxels at least as far from the centre, in voxels, as the quantile ``edge_fraction`` of its ball's
    distances; each of them goes with probability ``drop``. A centre's ball is a window of at most as many rows as offsets.
    """
    if not 0 <= drop <= 1 or not 0 < edge_fraction <= 1:
        raise InvalidArgument("drop from 0 to 1, edge_fraction over 0 and up to 1")
    far = F.sqrt(F.col("di") * F.col("di") + F.col("dj") * F.col("dj") + F.col("dk") * F.col("dk"))
    rows = _laid(centers, space, ball_offsets(space, radius)).select("center", "v", far.alias("far"))
    rows = rows.withColumn("edge", F.percentile("far", F.lit(float(edge_fraction))).over(Window.partitionBy("center")))
    goes = (F.col("far") >= F.col("edge")) & (uniform(seed, F.col("center"), F.col("v")) < drop)
    return rows.where(~goes).select("center", "v")


def bootstrap_regions(mask: Frame, radius: float, n: int = 100, seed: int = 0) -> DataFrame:
    """(draw, center, v): the balls, within the mask, of ``n`` centres drawn from it with replacement."""
    draws = random_centers(mask, n, seed).withColumnRenamed("v", "center")
    balls = scattered(draws, mask.space, ball_offsets(mask.space, radius), mask.space.ijk("center"), ["draw", "center"])
    return balls.join(mask.df.where(F.col(mask.value).cast("double") != 0).select("v"), "v", "left_semi").select("draw", "center", "v")
