"""Image files: the committing writer, the member index, scans of many headers, and reading by indices and masks."""

import gzip
import os
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_engine import mask, series, values, volume
from voxloom.operators import select
from voxloom.plans.contracts import BackendDrift, InvalidArgument, Receipt, SpaceMismatch
from voxloom.plans.space import Space
from voxloom.sources import afni, binary, images, nifti


def rows(df):
    return sorted(map(tuple, df.collect()))


def moving(spark, dim=(5, 4, 3), times=6, seed=0, **kw):
    data = np.random.default_rng(seed).random((int(np.prod(dim)), times)).round(2) * (1 if not kw.get("sparse") else np.random.default_rng(seed).integers(0, 2, (int(np.prod(dim)), 1)))
    return data, series(spark, Space(dim, (2, 2, 3)).add_dim(times, 1.5), data, **kw)


@pytest.mark.parametrize("name", ["a.nii", "a.nii.gz"])
@pytest.mark.parametrize("block", [None, 7, 60])
def test_series_round_trips_in_blocks(spark, tmp_path, name, block):
    data, frame = moving(spark)
    frame = frame.like(frame.df.orderBy(F.rand(3)), receipt=Receipt("m", "s"))
    nifti.write(frame, f"{tmp_path}/{name}", "f8", block)
    got = images.read_image(spark, f"{tmp_path}/{name}")
    assert got.kind == "series" and got.receipt == frame.receipt and got.space.dim == (5, 4, 3, 6) and got.space.spacing[3] == 1.5
    assert rows(got.df) == rows(frame.df.select("v", "t", "x"))
    assert [p.name for p in tmp_path.iterdir()] == [name]  # nothing staged is left
    raw = (gzip.open if name.endswith("gz") else open)(tmp_path / name, "rb").read()  # foreign readers see one stream
    header = nifti.read_header(f"{tmp_path}/{name}")
    assert np.array_equal(np.frombuffer(raw[header.vox_offset :], "<f8"), data.T.ravel())


def test_cells_without_rows(spark, tmp_path):
    data, frame = moving(spark, sparse=True)
    for name in ("s.nii", "s.nii.gz"):
        nifti.write(frame, f"{tmp_path}/{name}", "f8", 4)
        got = images.read_image(spark, f"{tmp_path}/{name}").df.collect()
        assert {(r.v, r.t): r.x for r in got} == {(v, t): data[v, t] for v in range(60) for t in range(6)}
    lacking = frame.like(frame.df.where("v <> 3"), sparse=False)
    for name in ("d.nii", "d.nii.gz"):
        with pytest.raises(Exception, match="values for 360 cells"):
            nifti.write(lacking, f"{tmp_path}/{name}")
    twice = frame.like(frame.df.union(frame.df), sparse=True)
    with pytest.raises(Exception, match="more than one value"):
        nifti.write(twice, f"{tmp_path}/d.nii")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["s.nii", "s.nii.gz"]


@pytest.mark.parametrize("name", ["x.nii", "x.nii.gz"])
def test_a_killed_task_leaves_nothing(spark, tmp_path, name):
    _, frame = moving(spark)
    nifti.write(frame, f"{tmp_path}/{name}", "f4", 10)
    before = (tmp_path / name).read_bytes()
    dies = frame.like(frame.df.withColumn("x", F.when((F.col("v") == 59) & (F.col("t") == 5), F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("x"))))
    with pytest.raises(Exception, match="killed"):
        nifti.write(dies, f"{tmp_path}/{name}", "f4", 10)
    assert [p.name for p in tmp_path.iterdir()] == [name] and (tmp_path / name).read_bytes() == before


def test_attempts_that_do_not_count(tmp_path):
    """Of two attempts of a task only the one that the driver names is put together."""
    stage = tmp_path / "stage"
    stage.mkdir()
    options = {"stage": str(stage), "element": "<f8", "cells": 6, "block": 3, "voxels": 6, "offset": 0, "compressed": "false", "whole": "true"}
    writer = images.ImageWriter(options)

    def batch(b, values):
        return iter([pa.RecordBatch.from_pydict({"b": [b] * 3, "p": [3 * b + k for k in range(3)], "x": values})])

    lost, kept, other = writer.write(batch(0, [9.0, 9, 9])), writer.write(batch(0, [1.0, 2, 3])), writer.write(batch(1, [4.0, 5, 6]))
    assert lost.blocks[0][1] != kept.blocks[0][1]
    writer.commit([other, kept])
    import json

    parts = json.loads((stage / "manifest.json").read_text())
    assert np.frombuffer(b"".join((stage / name).read_bytes() for name, _ in parts), "<f8").tolist() == [1, 2, 3, 4, 5, 6]
    writer.abort([lost, kept])
    assert not stage.exists()


def test_parts_streamed_by_one_task(spark, tmp_path, monkeypatch):
    """As on a store without offsets."""
    data, frame = moving(spark)
    monkeypatch.setattr(images, "local", lambda path: None)
    for name in ("a.nii", "b.nii.gz"):
        nifti.write(frame, f"{tmp_path}/{name}", "f8", 9)
        assert rows(images.read_image(spark, f"{tmp_path}/{name}").df) == rows(frame.df)


def inflated_for(path, times, first=0, last=None):
    image = images.describe(path)
    images.inflated[0] = 0
    got = dict(images.volumes(image, times, first, image.voxels if last is None else last))
    return image, images.inflated[0], got


def test_member_index_inflates_what_is_read(spark, tmp_path):
    data, frame = moving(spark, times=12)
    path = f"{tmp_path}/m.nii.gz"
    nifti.write(frame, path, "f8", 16)  # 4 members a volume: 16, 16, 16 and 12 voxels
    image, size, got = inflated_for(path, [7])
    assert len(image.sizes) == 48 and size == 60 * 8 and np.array_equal(got[7], data[:, 7])
    _, size, got = inflated_for(path, [0, 11], 20, 31)  # one member of each
    assert size == 2 * 16 * 8 and np.array_equal(got[11], data[20:31, 11])
    total = 0
    for t in range(12):  # a task a volume: as many bytes as the volumes have
        total += inflated_for(path, [t])[1]
    assert total == 12 * 60 * 8
    # a foreign file of one member is inflated once, no further than needed
    foreign = tmp_path / "f.nii.gz"
    foreign.write_bytes(gzip.compress(gzip.open(path).read()))
    image, size, got = inflated_for(str(foreign), [2, 5, 11], 3, 50)
    assert image.sizes == () and size <= image.offset + 12 * 60 * 8 and np.array_equal(got[5], data[3:50, 5])
    assert [len(p.runs) for p in images._Reader({"path": str(foreign)}).partitions()] == [1]
    assert rows(images.read_image(spark, str(foreign)).df) == rows(frame.df)
    several = tmp_path / "g.nii.gz"
    raw = gzip.open(path).read()
    several.write_bytes(b"".join(gzip.compress(raw[a : a + 1000]) for a in range(0, len(raw), 1000)))
    assert rows(images.read_image(spark, str(several), indices=[4]).df) == rows(frame.df.where("t = 4").withColumn("t", F.lit(0)))


def test_filters_reach_the_partitions(tmp_path, spark):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    _, frame = moving(spark)
    path = f"{tmp_path}/p.nii"
    nifti.write(frame, path)
    reader = images._Reader({"path": path})
    list(reader.pushFilters([In(("t",), (1, 4, 5)), LessThanOrEqual(("t",), 4), GreaterThan(("v",), 9), EqualTo(("v",), 12)]))
    assert [t for p in reader.partitions() for r in p.runs for t, _ in r.times] == [1, 4] and (reader.first, reader.last) == (12, 13)
    assert images._load(spark, path=path).where("t in (1, 4) and v = 12").count() == 2


def test_indices_and_masks(spark, tmp_path):
    data, frame = moving(spark)
    path = f"{tmp_path}/i.nii.gz"
    nifti.write(frame, path, "f8")
    for indices in ([2], [5, 0], [1, 1, 4], []):
        got = images.read_series(spark, path, indices)
        assert rows(got.df) == sorted((v, k, data[v, t]) for v in range(60) for k, t in enumerate(indices))
    with pytest.raises(InvalidArgument):
        images.read_series(spark, path, [6])
    m = mask(spark, frame.space.spatial, [3, 50])
    got = images.read_image(spark, path, mask=m)
    assert got.sparse and rows(got.df) == sorted((v, t, data[v, t]) for v in (3, 50) for t in range(6))
    assert values(images.read_image(spark, path, "vol", index=2, mask=m)) == {v: data[v, 2] for v in (3, 50)}
    with pytest.raises(SpaceMismatch):
        images.read_image(spark, path, mask=mask(spark, Space((5, 4, 3)), [1]))


def test_dispatch_by_content(spark, tmp_path):
    space = Space((2, 3, 2), (2, 2, 3), (1, 2, 3))
    one = volume(spark, space, range(12))
    nifti.write(one, f"{tmp_path}/plain.nii")
    (tmp_path / "named.bin").write_bytes((tmp_path / "plain.nii").read_bytes())
    (tmp_path / "zipped.dat").write_bytes(gzip.compress((tmp_path / "plain.nii").read_bytes()))
    head, brick = afni.write(series(spark, space.add_dim(3), np.arange(36).reshape(12, 3)), f"{tmp_path}/pair.HEAD", compress=True)
    raw = (tmp_path / "plain.nii").read_bytes()
    hdr = bytearray(raw[:348])
    struct.pack_into("<f", hdr, 108, 0.0)
    hdr[344:348] = b"ni1\0"
    (tmp_path / "two.hdr").write_bytes(bytes(hdr))
    (tmp_path / "two.img").write_bytes(raw[352:])
    for name in ("plain.nii", "named.bin", "zipped.dat", "two.hdr", "two.img"):
        got = images.read_image(spark, f"{tmp_path}/{name}")
        assert got.kind == "volume" and values(got) == {v: float(v) for v in range(12)} and got.space.compatible_with(space)
    for path in (head, brick):
        got = images.read_image(spark, path)
        assert got.kind == "series" and got.df.where("t = 2").count() == 12 and got.space.compatible_with(space)
    assert images.describe(head).sizes and images.read_image(spark, [f"{tmp_path}/plain.nii"] * 2).space.dim == (2, 3, 2, 2)
    (tmp_path / "other").write_bytes(b"none of them")
    for bad in ("other",):
        with pytest.raises(InvalidArgument):
            images.read_image(spark, f"{tmp_path}/{bad}")
    vols = images.read_volumes(spark, [f"{tmp_path}/plain.nii", head], 0)
    assert [values(v)[11] for v in vols] == [11.0, 33.0]
    with pytest.raises(InvalidArgument):
        images.read_volumes(spark, [f"{tmp_path}/plain.nii", f"{tmp_path}/other"])
    with pytest.raises(InvalidArgument):
        images.read_image(spark, [])


def test_many_files_by_one_scan(spark, tmp_path, monkeypatch):
    data, frame = moving(spark, times=9)
    folder = f"{tmp_path}/volumes"
    images.write_volumes(frame, folder, "f8")
    assert len(list((tmp_path / "volumes").iterdir())) == 9 and len(list(tmp_path.iterdir())) == 1
    nifti.write(moving(spark, times=4, seed=5)[1], f"{folder}/1-more.nii.gz", "f8", 16)  # behind 000008.nii by name
    here, describe = os.getpid(), images.describe
    monkeypatch.setattr(images, "describe", lambda path: pytest.fail("a file was opened on the driver") if os.getpid() == here else describe(path))
    df, first, total = images.open_images(spark, folder)
    assert total == 13 and first.times == 1
    got = {(r.v, r.t): r.x for r in df.collect()}
    more = moving(spark, times=4, seed=5)[0]
    assert got == {(v, t): (data[v, t] if t < 9 else more[v, t - 9]) for v in range(60) for t in range(13)}
    assert df.where("t >= 8 and t < 10").count() == 120
    again, _, n = images.open_images(spark, [f"{folder}/000003.nii", f"{folder}/1-more.nii.gz", f"{folder}/000003.nii"])
    assert n == 6 and {r.x for r in again.where("t = 5").collect()} == set(data[:, 3])


def test_drift_names_the_file(spark, tmp_path):
    good = volume(spark, Space((2, 2, 2), (2, 2, 2)), range(8))
    paths = []
    for k in range(6):
        moved = good.like(good.df, space=Space((2, 2, 2), (2, 2, 2), (0, 0, 1e-3 if k >= 4 else 1e-8)))
        nifti.write(moved, f"{tmp_path}/{k}.nii")
        paths.append(f"{tmp_path}/{k}.nii")
    assert images.open_images(spark, paths[:4])[2] == 4
    with pytest.raises(BackendDrift, match="4.nii"):
        images.open_images(spark, paths)
    (tmp_path / "bad.nii").write_bytes(b"\0" * 400)
    with pytest.raises(InvalidArgument, match="bad.nii"):
        images.open_images(spark, [*paths[:2], f"{tmp_path}/bad.nii"])
    found = images.scan_headers(spark, [*paths[:2], f"{tmp_path}/gone.nii"]).orderBy("ord").collect()
    assert [r.error is None for r in found] == [True, True, False] and found[1].dim[:3] == [2, 2, 2]
    with pytest.raises(InvalidArgument):
        images.open_images(spark, [])


def test_elements_of_rows(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("at"), (F.col("id") * 2).alias("y")).where("at <> 17")
    binary.write_rows(df, "at", "y", f"{tmp_path}/e.bin", 1000, "<i4")
    want = np.arange(1000) * 2
    want[17] = 0
    assert np.array_equal(binary.read_elements(f"{tmp_path}/e.bin", "<i4"), want)


def test_volume_at_of_a_file(spark, tmp_path):
    data, frame = moving(spark)
    nifti.write(frame, f"{tmp_path}/v.nii.gz", "f8")
    assert values(select.volume_at(images.read_series(spark, f"{tmp_path}/v.nii.gz"), 3)) == {v: data[v, 3] for v in range(60)}
