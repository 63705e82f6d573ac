"""Steps whose memory must not grow with the grid: no side as large as the grid is broadcast, no matrix of a line's length, no table of all balls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import neighbor, resample
from voxloom.plans import frame as frames
from voxloom.plans.frame import Frame, densified
from voxloom.plans.space import Space


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def series(spark, data) -> Frame:
    rows = [(v, t, float(x)) for (v, t), x in np.ndenumerate(data) if not np.isnan(x)]
    return Frame(spark.createDataFrame(rows, "v long, t int, x double"), Space((6, 5, 7, data.shape[1]), (2.0, 2.0, 3.0, 1.0)), "series", sparse=True)


def plain_bilateral(data, offsets, sigma):
    """data: (6, 5, 7, times), NaN where there is no cell."""
    out = np.full(data.shape, np.nan)
    for at in zip(*np.nonzero(~np.isnan(data))):
        s = w = 0.0
        for *o, weight in offsets:
            p = tuple(np.add(at, o))
            if all(0 <= a < n for a, n in zip(p, data.shape)) and not np.isnan(data[p]):
                share = weight * np.exp(-(((data[p] - data[at]) / sigma) ** 2) / 2)
                s, w = s + share * data[p], w + share
        out[at] = s / w
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(neighbor, "_block_sides", lambda dim, reach, times: [2, 3, 2, 4])


def test_bilateral_4d_meets_its_neighbours_in_blocks(spark, small_blocks):
    data = np.random.default_rng(1).normal(0, 2, (210, 9))
    data[::7, ::2] = np.nan
    bold = series(spark, data)
    on = Frame(spark.range(210).where("id % 5 <> 0").select(F.col("id").alias("v"), F.lit(True).alias("value")), bold.space.spatial, "volume", True)
    got = neighbor.bilateral_filter_4d(bold, on, range_scale=1.5).df
    assert plan(got).count("Join") == 1 and "BroadcastHashJoin" not in plan(got)  # with the mask only
    data[::5] = np.nan
    near = [(*o, d, np.exp(-(4 * (o[0] ** 2 + o[1] ** 2) + 9 * o[2] ** 2) / 8) * np.exp(-(d * d) / 2)) for o in neighbor.box_offsets(1) for d in (-1, 0, 1)]
    want = plain_bilateral(data.reshape(7, 5, 6, 9).transpose(2, 1, 0, 3), near, 1.5).transpose(2, 1, 0, 3).reshape(210, 9)
    rows = got.collect()
    assert len(rows) == (~np.isnan(want)).sum()
    assert all(abs(want[r.v, r.t] - r.x) < 1e-9 for r in rows)


def test_bilateral_meets_its_neighbours_in_blocks(spark, small_blocks):
    data = np.random.default_rng(2).normal(0, 2, (210, 3))
    dense = series(spark, data)
    dense = dense.like(dense.df, sparse=False)
    got = neighbor.bilateral_filter(dense, 1.5, 2.0, 1).df
    assert "Join" not in plan(got)
    near = [(*o, 0, np.exp(-sum(d * d for d in o) / 4.5)) for o in neighbor.box_offsets(1)]
    want = plain_bilateral(data.reshape(7, 5, 6, 3).transpose(2, 1, 0, 3), near, 2.0).transpose(2, 1, 0, 3).reshape(210, 3)
    rows = got.collect()
    assert len(rows) == 630 and all(abs(want[r.v, r.t] - r.x) < 1e-9 for r in rows)
    gap = dense.like(dense.df.withColumn("x", F.when(F.col("v") != 50, F.col("x"))))  # a null cell stays null and has no part
    on = Frame(spark.range(60, 70).select(F.col("id").alias("v"), F.lit(True).alias("value")), dense.space.spatial, "volume", True)
    told = {(r.v, r.t): r.x for r in neighbor.bilateral_filter(gap, 1.5, 2.0, 1).df.collect()}
    assert told[50, 0] is None and sum(x is None for x in told.values()) == 3
    masked = {(r.v, r.t): r.x for r in neighbor.bilateral_filter(gap, 1.5, 2.0, 1, on).df.collect()}
    assert masked[65, 1] == told[65, 1] and masked[10, 2] == data[10, 2]


def test_a_spline_of_a_long_line_needs_no_matrix(spark):
    n = 150_000  # a matrix of n * n doubles has 180 GB
    line = Frame(spark.range(n).select(F.col("id").alias("v"), F.sin("id").alias("value")), Space((1, 1, n)), "volume")
    got = resample._spline(line).orderBy("v").toPandas()["value"].to_numpy()
    c = np.concatenate([[got[1]], got, [got[-2]]])
    assert np.abs((c[:-2] + 4 * c[1:-1] + c[2:]) / 6 - np.sin(np.arange(n))).max() < 1e-12


def test_a_spline_of_pieces_is_that_of_whole_lines(spark):
    x = np.random.default_rng(3).normal(size=6 * 70 * 101)
    vol = Frame(spark.createDataFrame(list(enumerate(x.tolist())), "v long, value double"), Space((6, 70, 101)), "volume")
    whole, pieces = ({r.v: r.value for r in resample._spline(vol, p).collect()} for p in (1 << 15, 1))
    assert len(pieces) == len(whole) == len(x) and max(abs(whole[v] - pieces[v]) for v in whole) < 1e-12
    c = np.array([whole[v] for v in range(len(x))]).reshape(101, 70, 6)
    for axis in range(3):
        c = np.pad(c, [(1, 1) if a == axis else (0, 0) for a in range(3)], mode="reflect")
        take = lambda lo: np.take(c, range(lo, lo + c.shape[axis] - 2), axis)  # noqa: B023, E731
        c = (take(0) + 4 * take(1) + take(2)) / 6
    assert np.abs(c.ravel() - x).max() < 1e-12


def test_a_grid_is_filled_by_a_join_that_shuffles(spark):
    counts = Frame(spark.range(40).select(F.col("id").alias("v"), F.lit(1).alias("t"), F.lit(2.0).alias("x")), Space((5, 5, 4, 3)), "series", sparse=True)
    full = densified(counts).df
    assert "SortMergeJoin" in plan(full) and "BroadcastHashJoin" not in plan(full)
    assert full.count() == 300 and full.where("x = 2").count() == 40


def test_covering_centers_keep_no_table_of_balls(spark, monkeypatch):
    space = Space((9, 8, 10))
    on = spark.range(720).where("id % 3 <> 0").select(F.col("id").alias("v"), F.lit(True).alias("value"))
    held = []

    def counted(df):
        out = frames.checkpointed(df)
        held.append(out.count())
        return out

    monkeypatch.setattr(neighbor, "checkpointed", counted)
    monkeypatch.setattr(neighbor, "CELLS", 100, raising=False)
    got = {r.center for r in neighbor.covering_centers(Frame(on, space, "volume", True), 2.0, 5).collect()}
    assert held and max(held) <= 480
    kept: list[tuple] = []
    for r in sorted(on.select("v", F.xxhash64("v", F.lit(5)).alias("h")).collect(), key=lambda r: r.h):
        at = (r.v % 9, r.v // 9 % 8, r.v // 72)
        if all(sum((a - b) ** 2 for a, b in zip(at, k)) > 4 for k in kept):
            kept.append(at)
    assert got == {i + 9 * (j + 8 * k) for i, j, k in kept}
