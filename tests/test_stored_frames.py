"""Frames as bucketed tables, and digests of frames by a tree of block hashes."""

import hashlib
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_engine import mask, series, volume
from voxloom.operators import reduce, select
from voxloom.plans import catalogue, digests
from voxloom.plans.contracts import InvalidArgument, MaskMismatch, NO_MASK, Receipt, assert_same_mask
from voxloom.plans.frame import Frame, densified
from voxloom.plans.space import Space


def name():
    return f"frame_{uuid.uuid4().hex}"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_round_trip_with_space_and_receipt(spark, tmp_path):
    c, s = np.cos(0.3), np.sin(0.3)
    space = Space((3, 2, 2, 4, 2), trans=((2 * c, -2 * s, 0, 1), (2 * s, 2 * c, 0, 2), (0, 0, 3, 4), (0, 0, 0, 1)))
    rows = [(v, t, f, float(v + 10 * t + 100 * f)) for v in range(12) for t in range(4) for f in range(2)]
    hyper = Frame(spark.createDataFrame(rows, "v long, t int, f int, x double"), space, "hyper", False, Receipt("it's a \\ test", "s", source_affine=tuple(map(tuple, space.trans))))
    n = name()
    for back in (catalogue.save(hyper, n, f"{tmp_path}/h", 3), catalogue.open_frame(spark, n), catalogue.attach(spark, name(), f"{tmp_path}/h")):
        assert back.space == space and back.space.axes == space.axes and back.receipt == hyper.receipt
        assert (back.kind, back.sparse) == ("hyper", False) and sorted(map(tuple, back.df.collect())) == sorted(rows)
        assert "Exchange" not in plan_of(back.df.groupBy("v").agg(F.sum("x")))
    assert len(list((tmp_path / "h").glob("*.parquet"))) == 3
    with pytest.raises(Exception, match="already exists"):
        catalogue.save(hyper, n, buckets=3)
    spark.range(3).write.saveAsTable(other := name(), path=f"{tmp_path}/o")
    with pytest.raises(InvalidArgument):
        catalogue.open_frame(spark, other)


def test_stored_frames_meet_without_a_shuffle(spark, tmp_path):
    space = Space((4, 4, 2))
    data = np.random.default_rng(1).random((32, 6))
    bold, on = series(spark, space.add_dim(6), data), mask(spark, space, range(0, 32, 3))
    labels = Frame(spark.createDataFrame([(v, v % 3) for v in range(32)], "v long, label int"), space, "labels")
    b, m, a = (catalogue.save(x, name(), f"{tmp_path}/{k}", 4) for k, x in enumerate((bold, on, labels)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        tsnr = reduce.temporal_snr(b, m)
        assert "Exchange" not in plan_of(tsnr.df)
        got = {r.v: r.value for r in tsnr.df.collect()}
        assert all(got[v] == pytest.approx(data[v].mean() / data[v].std() if v % 3 == 0 else 0) for v in range(32))
        means = reduce.parcel_means(b, a).df
        plan = plan_of(means)
        assert plan.count("Exchange hashpartitioning(label") == 1 and plan.count("Exchange") == 1 and "partial_avg" in plan
        assert {(r.label, r.t): r.x for r in means.collect()} == pytest.approx({(k, t): data[k::3, t].mean() for k in range(3) for t in range(6)})
        assert "Exchange" not in plan_of(select.in_mask(b, m).df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plain_digest(cells, width, fan):
    level = {}
    for p, text in sorted(cells):
        level.setdefault(p // width, []).append(text)
    level = {b: hashlib.sha256(",".join(x).encode()).hexdigest() for b, x in level.items()}
    out = [level]
    while len(out) < 3:
        above = {}
        for b, h in sorted(out[-1].items()):
            above.setdefault(b // fan, []).append(f"{b}:{h}")
        out.append({b: hashlib.sha256(",".join(x).encode()).hexdigest() for b, x in above.items()})
    return out


def test_block_hashes_against_plain(spark):
    rng = np.random.default_rng(4)
    data = rng.integers(0, 3, (60, 3)) * rng.random((60, 3)).round(3)
    s = series(spark, Space((5, 4, 3)).add_dim(3), data)
    want = plain_digest([(v + 60 * t, f"{v + 60 * t}:{float(data[v, t])!r}") for v in range(60) for t in range(3) if data[v, t]], 16, 4)
    got = [{}, {}, {}]
    for r in digests.block_hashes(s, 16, 4, 3).collect():
        got[r.level][r.block] = r.hash
    assert got == want


def test_digest_is_of_the_content(spark):
    data = np.random.default_rng(4).integers(0, 3, (60, 3)).astype(float)
    space = Space((5, 4, 3)).add_dim(3)
    s = series(spark, space, data)
    d = digests.frame_digest(s)
    assert len(d) == 16 and d == digests.frame_digest(s.like(s.df.repartition(7, "x").orderBy(F.rand(1))))
    sparse = s.like(s.df.where("x <> 0"), sparse=True)
    assert d == digests.frame_digest(sparse) == digests.frame_digest(densified(sparse))
    changed = s.like(s.df.withColumn("x", F.when((F.col("v") == 59) & (F.col("t") == 2), 7.5).otherwise(F.col("x"))))
    other_grid = s.like(s.df, space=Space((4, 5, 3)).add_dim(3))
    odd = s.like(s.df.withColumn("x", F.when(F.col("v") == 0, float("nan")).otherwise(F.col("x"))))
    minus = volume(spark, Space((2, 1, 1)), [-0.0, 1])
    assert len({d, digests.frame_digest(changed), digests.frame_digest(other_grid), digests.frame_digest(odd)}) == 4
    assert digests.frame_digest(minus) == digests.frame_digest(volume(spark, Space((2, 1, 1)), [0.0, 1]))
    empty = volume(spark, Space((2, 1, 1)), [0, 0])
    assert digests.frame_digest(empty) != digests.frame_digest(minus)
    # more than one level
    big = Frame(spark.range(300_000).select(F.col("id").alias("v"), F.lit(True).alias("value")), Space((100, 100, 30)), "volume", True)
    assert {r.level for r in digests.block_hashes(big).collect()} == {0, 1, 2}
    assert digests.frame_digest(big) != digests.frame_digest(big.like(big.df.where("v <> 299999")))
    with pytest.raises(InvalidArgument):
        digests.block_hashes(s, 0)


def test_receipts_carry_the_masks_digest(spark):
    space = Space((5, 4, 3))
    s = series(spark, space.add_dim(3), np.ones((60, 3)))
    a, b = digests.sealed(mask(spark, space, [1, 2, 3])), digests.sealed(mask(spark, space, [1, 2, 4]))
    again = digests.sealed(a.like(a.df.repartition(5), receipt=None))
    x, y, z = (select.in_mask(s, m).receipt for m in (a, b, again))
    assert x.mask_hash not in ("", NO_MASK) and reduce.temporal_snr(s, a).receipt.mask_hash == x.mask_hash
    assert_same_mask(x, z)
    with pytest.raises(MaskMismatch):
        assert_same_mask(x, y)
    with pytest.raises(MaskMismatch):
        select.in_mask(select.in_mask(s, a), b)
    assert select.in_mask(s, mask(spark, space, [1])).receipt.mask_hash == NO_MASK
