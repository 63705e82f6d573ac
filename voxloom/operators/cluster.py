"""Connected components of thresholded volumes, their table and maxima, and automatic masks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.frame import SMALL, Frame, checkpointed, densified, grid, numbered
from ..plans.contracts import InvalidArgument
from .neighbor import box_offsets, connectivity, scattered


def c_order(space, v="v"):
    """The place of a voxel when the last axis runs fastest; ties and numbering go by it."""
    i, j, k = space.ijk(v)
    return (k + space.dim[2] * (j + space.dim[1] * i)).cast("long")


#: Components are first found within cubes of so many voxels a side.
SIDE = 32


def _cube_roots(offsets, dim):
    """(v, root, face) of the voxels of one cube: root is the least voxel that they reach inside it, face whether they touch its sides."""
    import numpy as np
    import pandas as pd

    nx, ny = dim[:2]
    wide = SIDE + 2
    steps = np.array([dx + wide * (dy + wide * dz) for dx, dy, dz in offsets])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(g.v.to_numpy())
        at = np.stack([v % nx, v // nx % ny, v // (nx * ny)]) % SIDE
        cell = at[0] + 1 + wide * (at[1] + 1 + wide * (at[2] + 1))  # cells rise as voxels do
        place = np.full(wide**3, len(v))  # len(v): nothing there
        place[cell] = np.arange(len(v))
        near = place[cell[:, None] + steps]
        root = np.arange(len(v) + 1)
        while True:
            least = np.minimum(root[:-1], root[near].min(1))
            hooked = root.copy()
            np.minimum.at(hooked, root[:-1], least)
            while not np.array_equal(hooked, hooked[hooked]):
                hooked = hooked[hooked]
            new = hooked[root]
            if np.array_equal(new, root):
                break
            root = new
        return pd.DataFrame({"v": v, "root": v[root[:-1]], "face": ((at == 0) | (at == SIDE - 1)).any(0)})

    return run


def components(on: DataFrame, space, connect: str = "26-connect", most: int = 100) -> DataFrame:
    """(v, root): the smallest voxel of each component of the voxels (v).

    Cubes of the grid find theirs alone; then only voxels on the cubes' sides meet, and the cubes' roots that they join
    settle among themselves, so that rounds and rows follow the faces and not the voxels.
    """
    offsets = connectivity(connect)
    i, j, k = space.ijk()
    wide = [-(-d // SIDE) for d in space.dim[:3]]
    cube = F.floor(i / SIDE) + wide[0] * (F.floor(j / SIDE) + wide[1] * F.floor(k / SIDE))
    own = on.select("v").distinct().withColumn("cube", cube).groupBy("cube").applyInPandas(_cube_roots(offsets, space.dim), "v long, root long, face boolean")
    own = checkpointed(own)
    side = own.where("face").select("v", "root")
    met = scattered(side.select(F.col("v").alias("w"), F.col("root").alias("a")), space, offsets, space.ijk("w"), ["a"]).distinct()
    edges = checkpointed(met.join(side, "v").select("a", F.col("root").alias("b")).where("a <> b").distinct())
    final = _settled(edges, most)
    return own.join(final.withColumnRenamed("v", "root"), "root", "left").select("v", F.coalesce("to", "root").alias("root"))


def _settle_together(batches):
    import numpy as np
    import pyarrow as pa

    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held))
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    while True:
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        while not np.array_equal(low, low[low]):
            low = low[low]
        new = low[root]
        if np.array_equal(new, root):
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["v", "to"])


def _settled(edges: DataFrame, most: int) -> DataFrame:
    """(v, to): the least vertex that each end of the edges (a, b), given both ways, reaches.

    Labels fall to the least of the neighbours and then jump to their label's label, so a chain of n settles in about
    log n rounds, checkpointed each.
    """
    labels = edges.select(F.col("a").alias("v")).distinct().withColumn("to", F.col("v"))
    size = edges.count()
    if size == 0:
        return labels
    if size <= SMALL:
        return edges.coalesce(1).mapInArrow(_settle_together, "v long, to long")  # few enough for one task
    for _ in range(most):
        near = edges.join(labels.select(F.col("v").alias("a"), "to"), "a").groupBy(F.col("b").alias("v")).agg(F.min("to").alias("near"))
        low = labels.join(near, "v").select("v", F.col("to").alias("was"), F.least("to", "near").alias("low"))
        # a vertex and the one it points to both take the least label seen; then all pointers jump twice
        hooked = low.select("v", "low").union(low.select(F.col("was").alias("v"), "low")).groupBy("v").agg(F.min("low").alias("p"))
        for _ in range(2):
            hooked = hooked.join(hooked.select(F.col("v").alias("p"), F.col("p").alias("q")), "p").select("v", F.col("q").alias("p"))
        new = checkpointed(labels.join(hooked, "v").select("v", F.col("p").alias("to"), F.col("to").alias("was")))
        labels = new.select("v", "to")
        if new.where("to <> was").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def conn_comp(frame: Frame, threshold: float = 0.0, connect: str = "26-connect", mask: Frame | None = None, two_tailed: bool = False) -> DataFrame:
    """(v, index, size): components of what exceeds the threshold; index counts from 1 by the first voxel in C order."""
    x = F.abs("value") if two_tailed else F.col("value")
    on = frame.df.where(~F.isnan("value") & (x > threshold)).select("v")
    if mask is not None:
        on = on.join(mask.df.where(F.col(mask.value).cast("double") != 0).select("v"), "v", "left_semi")
    found = components(on, frame.space, connect)
    per = found.groupBy("root").agg(F.count("*").alias("size"), F.min(c_order(frame.space)).alias("first"))
    return found.join(numbered(per, "first", "index", 1), "root").select("v", "index", "size")


def cluster_table(frame: Frame, comp: DataFrame) -> DataFrame:
    """(index, x, y, z, n, volume, mean, peak, peak_x, peak_y, peak_z): world coordinates of the mean voxel and of the
    voxel with the largest absolute value (the first in C order)."""
    space = frame.space
    i, j, k = space.ijk()
    rows = comp.join(frame.df, "v").select("index", "value", *(c.cast("double").alias(n) for c, n in zip((i, j, k), ("gi", "gj", "gk"))), c_order(space).alias("c"))
    best = F.max_by(F.struct("value", "gi", "gj", "gk"), F.struct(F.abs("value"), -F.col("c"))).alias("p")
    t = rows.groupBy("index").agg(*(F.avg(c).alias(c) for c in ("gi", "gj", "gk")), F.count("*").alias("n"), F.avg("value").alias("mean"), best)
    cell = float(space.spacing[0] * space.spacing[1] * space.spacing[2])
    world = space.xyz(F.col("gi"), F.col("gj"), F.col("gk"))
    peak = space.xyz(F.col("p.gi"), F.col("p.gj"), F.col("p.gk"))
    return t.select("index", *(c.alias(n) for c, n in zip(world, "xyz")), "n", (F.col("n") * cell).alias("volume"), "mean", F.col("p.value").alias("peak"), *(c.alias(f"peak_{n}") for c, n in zip(peak, "xyz")))


def local_maxima(frame: Frame, comp: DataFrame, min_distance: float = 15.0) -> DataFrame:
    """(index, v, value): voxels that no neighbour of 26 exceeds, by falling value, each at least the distance from those kept before.

    The distance is in mm, by the mean spacing; ties go to the smaller voxel; NaN is no peak. Rounds keep, in all
    components at once, the peaks that come before all undecided ones of their component nearer than the distance, and
    drop what is nearer to them: the same peaks as one walk by falling value.
    """
    space = frame.space
    top = scattered(densified(frame).df.select("v", F.col("value").alias("y")), space, box_offsets(1), space.ijk(), ["y"]).groupBy("v").agg(F.max("y").alias("top"))
    peaks = checkpointed(comp.join(frame.df, "v").join(top, "v").where("value = top and not isnan(value)").select("index", "v", "value"))
    limit = min_distance / (sum(space.spacing[:3]) / 3)
    # peaks nearer than the distance lie in the same cube of that side or in one next to it
    side = max(1, math.ceil(limit))
    at = peaks.select("index", "v", "value", *(c.cast("int").alias(n) for c, n in zip(space.ijk(), "ijk"))).withColumns({f"c{n}": F.floor(F.col(n) / side).cast("int") for n in "ijk"})
    nearby = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(o, "ijk"))) for o in box_offsets(1)))
    laid = at.select("index", F.col("v").alias("own"), F.col("value").alias("own_value"), *(F.col(n).alias(f"own_{n}") for n in "ijk"), "ci", "cj", "ck", F.explode(nearby).alias("o"))
    laid = laid.withColumns({f"c{n}": F.col(f"c{n}") + F.col(f"o.{n}") for n in "ijk"})
    far = sum((F.pow(F.col(n) - F.col(f"own_{n}"), 2) for n in "ijk"), F.lit(0.0))
    # (own, v): a peak and one of its component too near to it that comes before it
    before = laid.join(at, ["index", "ci", "cj", "ck"]).where(F.sqrt(far) < limit).where((F.col("value") > F.col("own_value")) | ((F.col("value") == F.col("own_value")) & (F.col("v") < F.col("own"))))
    before = checkpointed(before.select("own", "v"))
    left, kept = peaks.select("v"), None
    while not left.isEmpty():
        alive = before.join(left, "v", "left_semi").select("own").distinct()  # those that an undecided peak comes before
        new = checkpointed(left.join(alive, left.v == alive.own, "left_anti"))
        kept = new if kept is None else kept.union(new)
        gone = before.join(new, "v", "left_semi").select(F.col("own").alias("v")).union(new)
        left = checkpointed(left.join(gone, "v", "left_anti"))
    return peaks.join(kept, "v", "left_semi").select("index", "v", "value") if kept is not None else peaks


def largest_component(on: DataFrame, space, connect: str = "26-connect") -> DataFrame:
    found = components(on, space, connect)
    per = found.groupBy("root").agg(F.count("*").alias("n"), F.min(c_order(space)).alias("first"))
    best = per.agg(F.max_by("root", F.struct("n", -F.col("first"))).alias("root"))
    return found.join(F.broadcast(best), "root", "left_semi").select("v")  # one row


def fill_holes(on: DataFrame, space) -> DataFrame:
    """The voxels and all background that does not reach the grid's edge through faces."""
    spark = on.sparkSession
    off = grid(spark, space).join(on, "v", "left_anti")
    found = components(off, space, "6-connect")
    i, j, k = space.ijk()
    nx, ny, nz = space.dim[:3]
    edge = (i == 0) | (i == nx - 1) | (j == 0) | (j == ny - 1) | (k == 0) | (k == nz - 1)
    open_ = found.where(edge).select("root").distinct()
    return on.select("v").union(found.join(open_, "root", "left_anti").select("v"))


def neighbor_count_18(on: DataFrame, space) -> DataFrame:
    """(v, n): how many of the 18 neighbours are on, for every voxel that has any; beyond the edge the nearest cell counts."""
    spark = on.sparkSession
    offsets = connectivity("18-connect")
    nx, ny, nz = space.dim[:3]
    every = grid(spark, space)
    i, j, k = (c.cast("int") for c in space.ijk())
    table = F.array(*(F.struct(*(F.lit(d).alias(n) for d, n in zip(o, ("dx", "dy", "dz")))) for o in offsets))
    at = every.select("v", i.alias("i"), j.alias("j"), k.alias("k"), F.explode(table).alias("o"))
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c))
    near = space.index(clamp(F.col("i") + F.col("o.dx"), nx).cast("long"), clamp(F.col("j") + F.col("o.dy"), ny), clamp(F.col("k") + F.col("o.dz"), nz))
    return at.select("v", near.alias("w")).join(on.select(F.col("v").alias("w")), "w", "left_semi").groupBy("v").agg(F.count("*").alias("n"))


def peel_restore(on: DataFrame, space, peels: int = 1, threshold: int = 17) -> DataFrame:
    """Voxels with under ``threshold`` (1 to 18) neighbours on are peeled off, ``peels`` times. Then, the last peel first,
    peeled voxels come back that touch what stayed: by any neighbour in the first round, by two or more in later ones."""
    if peels < 1:
        return on.select("v")
    core, peeled = on.select("v"), None
    for p in range(1, peels + 1):
        stay = core.join(neighbor_count_18(core, space).where(F.col("n") >= min(18, max(1, threshold))), "v", "left_semi")
        off = core.join(stay, "v", "left_anti").withColumn("peel", F.lit(p))
        core, peeled = checkpointed(stay), off if peeled is None else peeled.union(off)
    peeled = checkpointed(peeled)
    for p in range(peels, 0, -1):
        near = neighbor_count_18(core, space).where(F.col("n") > (0 if p == peels else 1))
        back = peeled.where(F.col("peel") >= p).join(near, "v", "left_semi").join(core, "v", "left_anti").select("v")
        core = checkpointed(core.union(back))
    return core


def automask(frame: Frame, mfrac: float = 0.5, gradual: bool = True, representative: str = "mean_abs", peels: int = 1, threshold: int = 17, connect: str = "26-connect") -> Frame:
    """Clip, keep the largest component, peel and restore, keep the largest again, fill holes, keep the largest again.

    gradual: levels vary over space (``reduce.gradual_clip``). A series is represented by the mean or the median of its
    absolute values over time. No voxel is kept where the level of the whole volume is 0.
    """
    from .reduce import clip_level, gradual_clip

    if representative not in ("mean_abs", "median"):
        raise InvalidArgument("representative must be mean_abs or median")
    if frame.kind == "series":
        how = F.sum(F.abs("x")) / frame.space.dim[3] if representative == "mean_abs" else F.median(F.abs("x"))
        data = densified(frame) if representative == "median" else frame
        frame = Frame(data.df.groupBy("v").agg(how.alias("value")), frame.space.spatial, "volume", data.sparse)
    frame = frame.like(frame.df.select("v", F.abs("value").alias("value")))
    level, threshold_at = gradual_clip(frame, mfrac) if gradual else ((one := clip_level(frame, mfrac)), F.lit(one))
    on = frame.df.where(F.col("value") >= threshold_at).select("v") if level > 0 else frame.df.where("false").select("v")
    on = checkpointed(largest_component(on, frame.space, connect))
    if peels > 0:
        on = checkpointed(largest_component(peel_restore(on, frame.space, peels, threshold), frame.space, connect))
    on = largest_component(checkpointed(fill_holes(on, frame.space)), frame.space, connect)
    return Frame(on.withColumn("value", F.lit(True)), frame.space, "volume", True)
