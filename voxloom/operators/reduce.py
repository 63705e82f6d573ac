"""Aggregation, grouping, scaling, union; parcels and matrices."""

from __future__ import annotations

from functools import reduce as fold

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.contracts import InvalidArgument, OpParams, assert_same_space, receipt_for
from ..plans.digests import mask_hash_of
from ..plans.frame import Frame, densified, with_all_times

NAN = float("nan")


def _or_nan(c: Column) -> Column:
    return F.coalesce(c, F.lit(NAN))


def global_stats(frame: Frame, na_rm: bool = False) -> DataFrame:
    """One row (n, total, mean, lo, hi, sd) over all voxels of the grid; a sparse frame's absent rows count as zeros.

    Without na_rm one NaN makes every figure NaN.
    """
    x = F.col(frame.value).cast("double")
    nan = F.isnan(x)
    ok = frame.df.select(x.alias("x"), nan.alias("nan"))
    kept = F.when(~F.col("nan"), F.col("x"))
    got = ok.agg(F.count("*").alias("rows"), F.count(kept).alias("n"), F.sum(kept).alias("s"), F.sum(kept * kept).alias("q"), F.min(kept).alias("lo"), F.max(kept).alias("hi"), F.coalesce(F.bool_or("nan"), F.lit(False)).alias("bad"), F.var_pop(kept).alias("var"), F.avg(kept).alias("m"))
    cells = frame.space.nvox if frame.kind == "volume" else frame.space.nvox * frame.space.dim[3]
    absent = F.lit(cells) - F.col("rows") if frame.sparse else F.lit(0)
    n = (F.col("n") + absent).cast("double")
    mean = F.try_divide(F.coalesce("s", F.lit(0.0)), n)
    # zeros join a group of known mean and variance
    var = F.try_divide(F.col("n") * F.coalesce("var", F.lit(0.0)) + F.try_divide(F.col("n") * absent, n) * F.pow(F.coalesce("m", F.lit(0.0)), 2), n)
    lo, hi = (F.when(absent > 0, f(F.coalesce(c, F.lit(0.0)), F.lit(0.0))).otherwise(F.col(c)) for f, c in ((F.least, "lo"), (F.greatest, "hi")))
    hide = F.lit(not na_rm) & F.col("bad")

    def out(c: Column, name: str) -> Column:
        return F.when(hide, F.lit(NAN)).otherwise(_or_nan(c)).alias(name)

    return got.select(n.cast("long").alias("n"), out(F.coalesce("s", F.lit(0.0)), "total"), out(mean, "mean"), out(lo, "lo"), out(hi, "hi"), out(F.sqrt(var), "sd"))


def which_extreme(frame: Frame) -> DataFrame:
    """(which_min, which_max): the first voxel with the least and the largest value."""
    f = densified(frame)
    return f.df.agg(F.min_by("v", F.struct("value", "v")).alias("which_min"), F.max_by("v", F.struct("value", -F.col("v"))).alias("which_max"))


def _moments(frame: Frame) -> DataFrame:
    """(v, m, s): mean and standard deviation over all times; times that a sparse frame lacks at a stored voxel are zero."""
    some = frame.df.groupBy("v").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n"))
    if not frame.sparse:
        return some.select("v", "m", "s")
    share = F.col("n") / F.lit(frame.space.dim[3])
    # the variance of the stored times, and between them and the zeros
    spread = F.sqrt(share * F.col("s") * F.col("s") + share * (1 - share) * F.col("m") * F.col("m"))
    whole = F.col("n") == frame.space.dim[3]
    return some.select("v", F.when(whole, F.col("m")).otherwise(F.col("m") * share).alias("m"), F.when(whole, F.col("s")).otherwise(spread).alias("s"))


def mean_over_time(frame: Frame) -> Frame:
    df = _moments(frame).select("v", F.col("m").alias("value"))
    return Frame(df, frame.space.spatial, "volume", frame.sparse, receipt_for(frame.space, OpParams("mean"), upstream=frame.receipt))


def temporal_snr(frame: Frame, mask: Frame | None = None) -> Frame:
    """Mean over standard deviation (of all times); 0 where that is 0 and outside the mask."""
    if mask is not None:
        assert_same_space(frame.space, mask.space)
    df = _moments(frame).select("v", F.when(F.col("s") > 0, F.col("m") / F.col("s")).otherwise(0.0).alias("value"))
    if mask is not None:
        on = mask.df.where(F.col(mask.value).cast("double") != 0).select("v", F.lit(True).alias("on"))
        df = df.join(on, "v", "left").select("v", F.when(F.col("on"), F.col("value")).otherwise(0.0).alias("value"))
    return Frame(df, frame.space.spatial, "volume", frame.sparse, receipt_for(frame.space, OpParams("temporal_snr"), mask_hash_of(mask), upstream=frame.receipt))


def parcel_means(frame: Frame, labels: Frame) -> Frame:
    """The mean series of each label's voxels; what a sparse frame lacks in them is zero."""
    assert_same_space(frame.space, labels.space)
    df = frame.df.join(labels.df, "v").groupBy("label", "t")
    if not frame.sparse:
        df = df.agg(F.avg("x").alias("x"))
    else:
        sizes = labels.df.groupBy("label").agg(F.count("*").alias("n"))
        every = sizes.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(frame.space.dim[3] - 1))))
        df = every.join(df.agg(F.sum("x").alias("s")), ["label", "t"], "left").select("label", "t", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("x"))
    return Frame(df, frame.space, "parcels", False, receipt_for(frame.space, OpParams("parcel_means"), upstream=frame.receipt))


def contrast(parcels: Frame, condition: DataFrame) -> DataFrame:
    """(label, effect): mean over the times of a condition (t, condition) less the mean over the others; both must occur."""
    kinds = condition.agg(F.countDistinct("condition").alias("n")).first().n
    if kinds != 2:
        raise InvalidArgument("a contrast needs times with and without the condition")
    df = parcels.df.join(F.broadcast(condition), "t")  # one row per time
    on, off = (F.avg(F.when(F.col("condition") == c, F.col("x"))) for c in (True, False))
    return df.groupBy("label").agg((on - off).alias("effect"))


def winning_label(effects: DataFrame) -> DataFrame:
    return effects.agg(F.max_by("label", F.struct("effect", -F.col("label"))).alias("label"))


def map_to_volume(labels: Frame, per_label: DataFrame, column: str, fill: float = 0.0) -> Frame:
    """A value per label written to all voxels of it, ``fill`` elsewhere in the grid."""
    df = labels.df.join(per_label.select("label", F.col(column).alias("value")), "label", "left").select("v", F.coalesce("value", F.lit(float(fill))).alias("value"))
    return densified(Frame(df, labels.space.spatial, "volume", True), fill)


def connectome(parcels: Frame, metric: str = "correlation") -> DataFrame:
    """(p, q, value): correlations or covariances (n - 1) of all pairs of parcels; NaN with a constant series."""
    if metric not in ("correlation", "covariance"):
        raise InvalidArgument(f"no metric {metric!r}")
    centred = parcels.df.withColumn("d", F.col("x") - F.avg("x").over(Window.partitionBy("label")))
    a, b = centred.select("t", F.col("label").alias("p"), F.col("d").alias("a")), centred.select("t", F.col("label").alias("q"), F.col("d").alias("b"))
    sums = a.join(b, "t").groupBy("p", "q").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.count("*").alias("n"))
    value = F.try_divide(F.col("ab"), F.col("n") - 1) if metric == "covariance" else F.try_divide(F.col("ab"), F.sqrt(F.col("aa")) * F.sqrt(F.col("bb")))
    return sums.select("p", "q", _or_nan(value).alias("value"))


def seed_correlation(frame: Frame, seed: DataFrame) -> Frame:
    """Pearson correlation of every stored voxel's series with a seed series (t, s); NaN where either is constant.

    What a sparse frame lacks is zero, and so is a seed at a time that it lacks.
    """
    if frame.has_all_times:
        df = frame.df.join(F.broadcast(seed), "t")  # one row per time
    else:
        df = with_all_times(frame).join(F.broadcast(seed), "t", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    sums = df.groupBy("v").agg(F.covar_pop("x", "s").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("s").alias("ss"))
    return Frame(sums.select("v", _or_nan(F.try_divide("c", F.col("sx") * F.col("ss"))).alias("value")), frame.space.spatial, "volume", frame.sparse)


def cluster_table(labels: Frame) -> DataFrame:
    """(label, size, ci, cj, ck): voxels of each label and their mean grid coordinate."""
    i, j, k = labels.space.ijk()
    return labels.df.groupBy("label").agg(F.count("*").alias("size"), F.avg(i).alias("ci"), F.avg(j).alias("cj"), F.avg(k).alias("ck"))


def centroids(labels: Frame, method: str = "center_of_mass") -> DataFrame:
    i, j, k = labels.space.ijk()
    if method == "center_of_mass":
        return cluster_table(labels).drop("size")
    if method != "median":
        raise InvalidArgument(f"no method {method!r}")
    return labels.df.groupBy("label").agg(F.median(i).alias("ci"), F.median(j).alias("cj"), F.median(k).alias("ck"))


def center_of_mass(frame: Frame) -> DataFrame:
    """(ci, cj, ck) weighted by positive finite values; the grid's centre if there are none."""
    i, j, k = frame.space.ijk()
    x = F.col("value")
    df = frame.df.where(~F.isnan(x) & (x > 0) & (x < float("inf")))
    names = ("ci", "cj", "ck")
    return df.agg(*(F.coalesce(F.try_divide(F.sum(c * x), F.sum(x)), F.lit((d - 1) / 2)).alias(n) for c, d, n in zip((i, j, k), frame.space.dim, names)))


def split_blocks(frame: Frame, nblocks: int) -> DataFrame:
    """(block, v): contiguous runs of voxel numbers, all but the last of equal length."""
    if nblocks < 1:
        raise InvalidArgument("at least one block")
    return frame.df.select(F.floor(F.col("v") / -(-frame.space.nvox // nblocks)).cast("int").alias("block"), "v")


def split_clusters(frame: Frame, labels: Frame) -> DataFrame:
    """(label, v, value) of non-zero labels; a series gives its mean over time."""
    assert_same_space(frame.space, labels.space)
    values = mean_over_time(frame).df if frame.kind == "series" else frame.df
    return labels.df.where("label <> 0").join(values, "v").select("label", "v", "value")


def split_fill(frame: Frame, factor: DataFrame) -> DataFrame:
    """(level, v, t, x): the volumes of each level of a factor (t, level), times numbered anew in each."""
    numbered = factor.withColumn("n", F.row_number().over(Window.partitionBy("level").orderBy("t")) - 1)
    return frame.df.join(F.broadcast(numbered), "t").select("level", "v", F.col("n").alias("t"), "x")  # one row per time


def split_reduce(frame: Frame, factor: DataFrame, f=F.avg) -> Frame:
    """An aggregate per voxel and level, then its mean over levels; times that a sparse frame lacks at a stored voxel are zero."""
    by_level = with_all_times(frame).join(F.broadcast(factor), "t").groupBy("v", "level").agg(f("x").alias("r"))
    return Frame(by_level.groupBy("v").agg(F.avg("r").alias("value")), frame.space.spatial, "volume", frame.sparse)


def _standardised(df: DataFrame, window, center: bool, scale: bool) -> DataFrame:
    m, s = F.avg("x").over(window), F.stddev_pop("x").over(window)
    x = F.col("x") - m if center else F.col("x")
    return df.withColumn("x", x / F.when(s > 0, s).otherwise(1.0) if scale else x)


def split_scale(frame: Frame, factor: DataFrame, center: bool = True, scale: bool = True) -> Frame:
    """Centred and scaled within voxel and level; a standard deviation of 0 counts as 1.

    Times that a sparse frame lacks at a stored voxel are zero, and have a row in the result.
    """
    df = with_all_times(frame).join(F.broadcast(factor), "t")
    return frame.like(_standardised(df, Window.partitionBy("v", "level"), center, scale).select("v", "t", "x"), every_time=frame.sparse)


def scale_series(frame: Frame, method: str = "zscore") -> Frame:
    """Each stored voxel's series scaled; times that a sparse frame lacks at it are zero, and have a row in the result."""
    w, df = Window.partitionBy("v"), with_all_times(frame)
    if method in ("zscore", "mean_center"):
        return frame.like(_standardised(df, w, True, method == "zscore"), every_time=frame.sparse)
    if method == "unit_scale":
        lo, span = F.min("x").over(w), F.max("x").over(w) - F.min("x").over(w)
        return frame.like(df.withColumn("x", (F.col("x") - lo) / F.when(span > 0, span).otherwise(1.0)), every_time=frame.sparse)
    raise InvalidArgument(f"no method {method!r}")


def dot_reduce(frame: Frame, weights) -> Frame:
    """Each voxel's sum over time of weight times value."""
    weights = list(map(float, weights))
    if len(weights) != frame.space.dim[3]:
        raise InvalidArgument("one weight per time")
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("t") + 1)
    return Frame(frame.df.groupBy("v").agg(F.sum(F.col("x") * w).alias("value")), frame.space.spatial, "volume", frame.sparse)


def concat(*frames: Frame) -> Frame:
    """Series one behind the other in time, or volumes as the times of a series."""
    if len(frames) < 2:
        raise InvalidArgument("at least two frames")
    parts, at = [], 0
    for f in frames:
        assert_same_space(frames[0].space, f.space)
        if f.kind == "volume":
            parts.append(f.df.select("v", F.lit(at).alias("t"), F.col("value").alias("x")))
            at += 1
        else:
            parts.append(f.df.select("v", (F.col("t") + at).alias("t"), "x"))
            at += f.space.dim[3]
    first = frames[0]
    spacing = first.space.spacing[3] if first.kind == "series" else 1.0
    receipt = fold(lambda a, b: a.merge(b) if a and b else a or b, (f.receipt for f in frames))
    return Frame(fold(DataFrame.unionByName, parts), first.space.spatial.add_dim(at, spacing), "series", any(f.sparse for f in frames), receipt)


def concat_features(*frames: Frame) -> Frame:
    parts, at = [], 0
    for f in frames:
        if f.space.dim[:4] != frames[0].space.dim[:4]:
            raise InvalidArgument("features need equal grids and times")
        parts.append(f.df.select("v", "t", (F.col("f") + at).alias("f"), "x"))
        at += f.space.dim[4]
    return frames[0].like(fold(DataFrame.unionByName, parts), space=frames[0].space.drop_dim(4).add_dim(at))


def reduce_features(frame: Frame, how: str = "mean", weights=None) -> DataFrame:
    """(v, t, x): mean, standard deviation (of all), or weighted mean over features; over times and features for mean_time."""
    if how == "mean_time":
        return frame.df.groupBy("v").agg(F.avg("x").alias("x"))
    by = frame.df.groupBy("v", "t")
    if how == "weighted":
        if len(weights) != frame.space.dim[4] or not sum(weights):
            raise InvalidArgument("one weight per feature, not all zero")
        w = F.element_at(F.array(*(F.lit(float(x) / sum(weights)) for x in weights)), F.col("f") + 1)
        return by.agg(F.sum(F.col("x") * w).alias("x"))
    return by.agg({"mean": F.avg, "std": F.stddev_pop}[how]("x").alias("x"))


def apply_feature_function(frame: Frame, f) -> DataFrame:
    """(v, t, x) of a Python function of a cell's feature values in order; for what aggregates cannot say."""
    import pyarrow as pa

    cells = frame.df.groupBy("v", "t").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("fx"))  # as many as features
    cells = cells.select(F.col("v").cast("long").alias("v"), F.col("t").cast("int").alias("t"), F.col("fx.x").cast("array<double>").alias("x"))

    def run(batches):
        for batch in batches:
            flat, ends = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.cumsum(batch.column(2).value_lengths().to_numpy())
            found = [float(f(flat[a:b])) for a, b in zip(np.append(0, ends[:-1]), ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["v", "t", "x"])

    return cells.mapInArrow(run, "v long, t int, x double")


def partition(frame: Frame, k: int, seed: int = 0) -> Frame:
    """Voxels in k clusters of similar value, numbered by their centres from 1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["value"], outputCol="features").transform(frame.df.where(~F.isnan("value")))
    model = KMeans(k=k, seed=seed).fit(data)
    order = sorted(range(len(model.clusterCenters())), key=lambda c: model.clusterCenters()[c][0])
    rank = F.element_at(F.array(*(F.lit(order.index(c) + 1) for c in range(len(order)))), F.col("prediction") + 1)
    return Frame(model.transform(data).select("v", rank.alias("label")), frame.space, "labels", True)


def clip_levels(frame: Frame, boxes: list[tuple[tuple[int, int], tuple[int, int], tuple[int, int]]], mfrac: float = 0.5) -> list[float]:
    """A level for each box of the grid ((first, last) by axis) under which values are background.

    The level is ``mfrac`` times the median of what lies over it, the fixed point of at most 66 steps on a histogram of
    the positive values: one bin per value for integers up to 32,767, else 10,000 bins. The walk starts where 65 % of
    the values lie above, or at half the root mean square if that is higher. 222 positive values or fewer give 0.
    """
    import numpy as np

    mfrac = mfrac if 0 < mfrac < 0.99 else 0.5
    x = F.col("value")
    at = frame.space.ijk()
    inside = [F.when(F.lit(True), F.lit(n)) if box is None else F.when(_all_between(at, box), F.lit(n)) for n, box in enumerate(boxes)]
    rows = frame.df.where(~F.isnan(x) & (x > 0) & (x < float("inf"))).select("value", F.explode(F.array_compact(F.array(*inside))).alias("box"))
    stats = {r.box: r for r in rows.groupBy("box").agg(F.count("*").alias("n"), F.max(x).alias("hi"), F.bool_and(F.abs(x - F.rint(x)) < 1e-8).alias("whole")).collect()}  # one row per box
    scale, tops, place = {}, {}, F.lit(None).cast("long")
    for n, r in stats.items():
        if r.n <= 222 or r.hi < 1e-100:
            continue
        whole = r.whole and r.hi <= 32767
        tops[n] = (255 if r.hi <= 255 else 32767) if whole else 10_000
        scale[n] = 1.0 if whole else tops[n] / r.hi
        place = F.when(F.col("box") == n, (F.rint(x) if whole else F.floor(x * scale[n] + 0.499)).cast("long")).otherwise(place)
    if not scale:
        return [0.0] * len(boxes)
    counts = {n: np.zeros(top + 1, np.int64) for n, top in tops.items()}
    for r in rows.select("box", place.alias("bin")).where("bin is not null").groupBy("box", "bin").count().collect():  # at most 32,768 a box
        if r.bin <= tops[r.box]:
            counts[r.box][r.bin] = r["count"]
    return [_fixed_point(counts[n], mfrac) / scale[n] if n in scale else 0.0 for n in range(len(boxes))]


def _all_between(at, box):
    out = F.lit(True)
    for c, (first, last) in zip(at, box):
        out = out & c.between(first, last)
    return out


def _fixed_point(count, mfrac: float) -> int:
    """The bin of the level; the topmost bin is not walked over."""
    import numpy as np

    total, top = int(count.sum()), len(count) - 1
    if total <= 222:
        return 0
    below = np.append(0, np.cumsum(count[:top]))  # values under each bin
    square = float((np.arange(top + 1, dtype=float) ** 2 * count).sum())
    enough = np.flatnonzero(below[top] - below[1:] >= int(0.65 * total))
    cut = max(0, round(0.5 * (square / total) ** 0.5) - 1, int(enough[-1]) if len(enough) else 0)
    for _ in range(66):
        half = (below[top] - below[min(cut, top)]) // 2
        middle = max(cut, min(top, int(np.searchsorted(below, below[min(cut, top)] + half))))
        new = int(mfrac * middle)
        if new == cut:
            break
        cut = new
    return cut


def clip_level(frame: Frame, mfrac: float = 0.5) -> float:
    """The level of the whole volume, as ``clip_levels``."""
    return clip_levels(frame, [None], mfrac)[0]


def gradual_clip(frame: Frame, mfrac: float = 0.5):
    """(level of the whole volume, a column of levels that vary over space).

    Eight boxes meet, with a little overlap, at the centre of mass of the positive values. Each has its own level, at
    least a third of the whole volume's; between the boxes' middles levels are interpolated along each axis.
    """
    from itertools import product

    dim, at = frame.space.dim[:3], frame.space.ijk()
    weight = F.when(~F.isnan("value") & (F.col("value") > 0) & (F.col("value") < float("inf")), F.col("value"))
    mass = frame.df.agg(*(F.try_divide(F.sum(c.cast("double") * weight), F.sum(weight)).alias(n) for c, n in zip(at, "ijk"))).first()
    ends = []
    for n, m in zip(dim, mass):
        center = min(max(round((n - 1) / 2 if m is None else m), 0), n - 1)
        lap = max(1, round(0.01 * n))
        ends.append((center, (0, min(center + lap, n - 1)), (max(center - lap, 0), n - 1)))
    corners = list(product((0, 1), repeat=3))
    whole, *levels = clip_levels(frame, [None, *(tuple(e[1 + c] for e, c in zip(ends, corner)) for corner in corners)], mfrac)
    levels = [max(level, 0.333 * whole) for level in levels]
    upper = []
    for (center, _, _), n, c in zip(ends, dim, at):
        a, b = 0.5 * center, 0.5 * (center + n - 1)
        upper.append(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c - F.lit(a)) / F.lit(b - a))) if b > a else F.lit(0.0))
    column = F.lit(0.0)
    for corner, level in zip(corners, levels):
        share = F.lit(level)
        for c, u in zip(corner, upper):
            share = share * (u if c else 1 - u)
        column = column + share
    return whole, column
