"""Iso-contours of planes: marching squares by column expressions, lines joined plane by plane.

A cell has four points of the plane as corners. Which corners lie above the level picks a case of a fixed table of
directed segments, the higher side to the left; where two opposite corners are above, the mean of all four says whether
they join. A segment ends on cell edges, where the level lies by linear interpolation; an edge is the end of one segment
and the beginning of another, which joins segments to lines. A plane's lines are made in one task, as long as the plane.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.contracts import InvalidArgument
from ..plans.frame import Frame, densified
from .quantile import frame_quantiles

# Edges of a cell: 0 below (corners 0, 1), 1 right (1, 2), 2 above (3, 2), 3 left (0, 3); corners run (0, 0), (1, 0), (1, 1), (0, 1).
#: For each case (bit k: corner k is above) the segments (from edge, to edge).
CASES = (
    (), ((0, 3),), ((1, 0),), ((1, 3),),
    ((2, 1),), ((0, 1), (2, 3)), ((2, 0),), ((2, 3),),
    ((3, 2),), ((0, 2),), ((1, 2), (3, 0)), ((1, 2),),
    ((3, 1),), ((0, 1),), ((3, 0),), (),
)
#: Cases 5 and 10 where the middle is below: their corners are apart.
APART = {5: ((0, 3), (2, 1)), 10: ((1, 0), (3, 2))}


def contour_level(frame: Frame, threshold: float = 0.0) -> float:
    """The threshold if it is over 0, else half the median of the values that are; half of 1 without such values."""
    if threshold and threshold > 0:
        return float(threshold)
    above = frame.like(frame.df.where((F.col(frame.value) > 0) & (F.col(frame.value) < float("inf"))), sparse=False)
    found = frame_quantiles(above, [0.5]).collect()  # one row
    return 0.5 * found[0].value if found and found[0].value > 0 else 0.5


def contour_segments(frame: Frame, axis: int, level: float) -> DataFrame:
    """(plane, from_x, from_y, to_x, to_y, from_edge, to_edge): of all planes across an axis, in grid coordinates of the two others.

    A cell with a corner that is not finite has no segments. An edge's number is 2 * (x + nx * y), and 1 more if it runs along y.
    """
    if axis not in (0, 1, 2):
        raise InvalidArgument("an axis from 0 to 2")
    full = densified(frame)
    ijk, others = full.space.ijk(), [a for a in range(3) if a != axis]
    nx, ny = (full.space.dim[a] for a in others)
    points = full.df.select(ijk[axis].cast("int").alias("plane"), ijk[others[0]].cast("int").alias("x"), ijk[others[1]].cast("int").alias("y"), F.col(full.value).cast("double").alias("z"))
    corner = F.array(*(F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(k).alias("k")) for k, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))))
    met = points.select("plane", F.explode(corner).alias("c"), "z").where(f"c.x between 0 and {nx - 2} and c.y between 0 and {ny - 2}").groupBy("plane", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    cells = met.agg(*(F.max(F.when(F.col("c.k") == k, F.col("z"))).alias(f"z{k}") for k in range(4)))
    z = [F.col(f"z{k}") for k in range(4)]
    finite = F.lit(True)
    for c in z:
        finite = finite & (F.abs(c) < float("inf"))
    case = sum((F.when(c > level, 1 << k).otherwise(0) for k, c in enumerate(z)), F.lit(0))
    middle = (z[0] + z[1] + z[2] + z[3]) / 4 > level

    def table(cases):
        return F.array(*(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in c)) if c else F.array().cast("array<struct<a:int,b:int>>") for c in cases))

    joined, apart = table(CASES), table(APART.get(k, c) for k, c in enumerate(CASES))
    picked = cells.where(finite).select("plane", "x", "y", *z, case.alias("case"), middle.alias("middle"))
    segments = picked.withColumn("s", F.explode(F.when(F.col("middle"), F.get(joined, F.col("case"))).otherwise(F.get(apart, F.col("case")))))

    def share(a: int, b: int):
        return (level - z[a]) / (z[b] - z[a])

    at = {0: (F.col("x") + share(0, 1), F.col("y") + 0.0), 1: (F.col("x") + 1.0, F.col("y") + share(1, 2)), 2: (F.col("x") + share(3, 2), F.col("y") + 1.0), 3: (F.col("x") + 0.0, F.col("y") + share(0, 3))}
    number = {0: 2 * (F.col("x") + nx * F.col("y")), 1: 2 * (F.col("x") + 1 + nx * F.col("y")) + 1, 2: 2 * (F.col("x") + nx * (F.col("y") + 1)), 3: 2 * (F.col("x") + nx * F.col("y")) + 1}

    def of(edge, values):
        out = None
        for k, v in values.items():
            out = F.when(edge == k, v) if out is None else out.when(edge == k, v)
        return out

    a, b = F.col("s.a"), F.col("s.b")
    return segments.select("plane", of(a, {k: v[0] for k, v in at.items()}).alias("from_x"), of(a, {k: v[1] for k, v in at.items()}).alias("from_y"), of(b, {k: v[0] for k, v in at.items()}).alias("to_x"), of(b, {k: v[1] for k, v in at.items()}).alias("to_y"), of(a, number).cast("long").alias("from_edge"), of(b, number).cast("long").alias("to_edge"))


def _lines(group):
    import pandas as pd

    nxt = dict(zip(group.from_edge, group.to_edge))
    place = dict(zip(group.from_edge, zip(group.from_x, group.from_y))) | dict(zip(group.to_edge, zip(group.to_x, group.to_y)))
    out, left = [], set(nxt)
    # lines with a beginning first, then closed ones from their least edge on
    for first in [*sorted(set(nxt) - set(nxt.values())), *sorted(nxt)]:
        if first not in left:
            continue
        at, line = first, [first]
        while at in left:
            left.remove(at)
            at = nxt[at]
            line.append(at)
        out += [(int(group.plane.iloc[0]), first, k, *place[e]) for k, e in enumerate(line)]
    return pd.DataFrame(out, columns=["plane", "line", "ord", "x", "y"])


def contours(frame: Frame, axis: int, level: float) -> DataFrame:
    """(plane, line, ord, x, y): the contour lines of all planes across an axis, their points in order, higher values to the left.

    line: the number of the edge that a line begins on; closed lines begin on the least of theirs and end where they began.
    """
    return contour_segments(frame, axis, level).groupBy("plane").applyInPandas(_lines, "plane int, line long, ord int, x double, y double")
