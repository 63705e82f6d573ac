"""Functions over chunks, shaped and random regions, contours, and header extensions."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_engine import mask, series, volume
from voxloom.operators import chunks, contour, shapes
from voxloom.plans.contracts import InvalidArgument, Receipt
from voxloom.plans.space import Space
from voxloom.sources import extensions, nifti


def tracer():
    """A class that workers get by value."""

    class Trace:
        """Checks that rows come in order, and keeps a running state."""

        def __init__(self, chunk):
            self.chunk, self.last, self.n, self.weighted = chunk, (-1, -1), 0, 0.0

        def add(self, t, v, x):
            keys = list(zip(t.tolist(), v.tolist()))
            assert keys == sorted(keys) and keys[0] > self.last
            self.last, self.n = keys[-1], self.n + len(keys)
            self.weighted += float((x * (t + 1)).sum())

        def rows(self):
            return [(self.n, self.weighted)] * 2 if self.chunk else []

    return Trace


def test_chunks_of_each_axis(spark):
    Trace = tracer()  # noqa: N806
    data = np.random.default_rng(2).random((4 * 3 * 5, 7))
    s = series(spark, Space((4, 3, 5)).add_dim(7), data)
    s = s.like(s.df.repartition(6))
    for axis, size in (("t", 3), ("z", 2), ("x", 10)):
        place = {"t": np.tile(np.arange(7), 60), "z": np.repeat(np.arange(60) // 12, 7), "x": np.repeat(np.arange(60) % 4, 7)}[axis] // size
        weights = (data * np.arange(1, 8)).ravel()
        got = chunks.process_chunks(s, Trace, "n long, weighted double", size, axis)
        assert sorted(map(tuple, got.collect())) == [(c, (place == c).sum(), pytest.approx(weights[place == c].sum())) for c in sorted(set(place)) if c for _ in (0, 1)]
    whole = chunks.process_chunks(s, lambda c: chunks.Whole(lambda a: (a.mean(), float(a.max())), 60, 3 * c, min(3, 7 - 3 * c)), "mean double, most double", 3)
    assert {r.chunk: r.most for r in whole.collect()} == {c: data[:, 3 * c : 3 * c + 3].max() for c in range(3)}
    v = volume(spark, Space((4, 3, 5)), range(60))
    assert chunks.process_chunks(v, Trace, "n long, w double", 1, "z").where("chunk = 4").first().n == 12
    for bad in ((s, 0, "t"), (s, 1, "q"), (v, 1, "t")):
        with pytest.raises(InvalidArgument):
            chunks.process_chunks(bad[0], Trace, "n long, w double", *bad[1:])


def test_a_chunk_in_many_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        s = series(spark, Space((4, 3, 5)).add_dim(2), np.ones((60, 2)))
        assert [tuple(r) for r in chunks.process_chunks(s, tracer(), "n long, w double", 1).collect()] == [(1, 60, 120.0)] * 2
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def regions(df):
    out = collections.defaultdict(set)
    for r in df.collect():
        out[r.center].add(r.v)
    return out


def test_shapes_against_plain(spark):
    space = Space((6, 5, 4), (2, 2, 3))
    grid = [(i, j, k) for k in range(4) for j in range(5) for i in range(6)]
    at = [0, 37, 64, 119]
    centers = spark.createDataFrame([(c,) for c in at], "v long")

    def ball(c):
        return {v for v, p in enumerate(grid) if sum(((a - b) * s) ** 2 for a, b, s in zip(p, grid[c], (2, 2, 3))) <= 36}

    got = regions(shapes.ellipsoid_regions(centers, space, 6.0, (3.0, 1.0, 2.5)))
    for c in at:
        assert got[c] == {v for v in ball(c) if sum(((a - b) * s) ** 2 for a, b, s in zip(grid[v], grid[c], (3, 1, 2.5))) <= 36}
    got = regions(shapes.cube_regions(centers, space, 4.0))
    for c in at:
        assert got[c] == {v for v, p in enumerate(grid) if all(abs(a - b) <= h for a, b, h in zip(p, grid[c], (2, 2, 2)))}
    for drop, fraction in ((1.0, 0.7), (0.0, 0.7), (0.5, 0.6)):
        got = regions(shapes.blobby_regions(centers, space, 6.0, drop, fraction, seed=5))
        for c in at:
            far = {v: math.dist(grid[v], grid[c]) for v in ball(c)}
            edge = np.quantile(list(far.values()), fraction)
            inner = {v for v in far if far[v] < edge}
            assert inner <= got[c] <= ball(c) and (drop != 1 or got[c] == inner) and (drop or got[c] == ball(c))


def test_chance_is_repeatable(spark):
    space = Space((12, 12, 12))
    some = spark.range(0, 1728, 7).select(F.col("id").alias("v"))
    for make in (lambda c, s: shapes.blobby_regions(c, space, 3.0, 0.4, 0.5, s), lambda c, s: shapes.ellipsoid_regions(c, space, 3.0, (1.2, 1.2, 1.2), 0.3, s)):
        a, b, other = regions(make(some, 1)), regions(make(some.repartition(9, F.rand(2)), 1)), regions(make(some, 2))
        assert a == b and a != other and len({frozenset(v - c for v in r) for c, r in a.items()}) > 20
    u = spark.range(20_000).select(shapes.uniform(3, F.col("id")).alias("u"), shapes.normal(3, F.col("id")).alias("z")).agg(F.min("u"), F.max("u"), F.avg("u"), F.avg("z"), F.stddev("z")).first()
    assert 0 <= u[0] and u[1] < 1 and u[2] == pytest.approx(0.5, abs=0.01) and u[3] == pytest.approx(0, abs=0.03) and u[4] == pytest.approx(1, abs=0.03)
    for bad in (lambda: shapes.blobby_regions(some, space, 3.0, 1.5), lambda: shapes.ellipsoid_regions(some, space, 3.0, (0, 1, 1))):
        with pytest.raises(InvalidArgument):
            bad()


def test_bootstrap_regions(spark):
    space = Space((6, 5, 4), (2, 2, 2))
    on = set(range(0, 120, 2))
    m = mask(spark, space, on)
    rows = shapes.bootstrap_regions(m, 4.0, 50, seed=3).collect()
    grid = [(i, j, k) for k in range(4) for j in range(5) for i in range(6)]
    by_draw = collections.defaultdict(set)
    for r in rows:
        by_draw[r.draw, r.center].add(r.v)
    assert len(by_draw) == 50 and {d for d, _ in by_draw} == set(range(50))
    for (_, c), vs in by_draw.items():
        assert c in on and vs == {v for v in on if math.dist(grid[v], grid[c]) <= 2}


# --- contours


def lines_of(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("plane", "line", "ord").collect():
        out[r.plane, r.line].append((r.x, r.y))
    return out


def test_a_hill_and_its_orientation(spark):
    x, y = np.meshgrid(np.arange(9), np.arange(8))  # rows are y
    z = np.stack([10 - np.hypot(x - 4, y - 3.5), np.zeros((8, 9)) + x])  # a hill, and a slope along x
    v = volume(spark, Space((9, 8, 2)), z.ravel())
    found = lines_of(contour.contours(v, 2, 7.5))
    hill = [p for (k, _), p in found.items() if k == 0]
    assert len(hill) == 1 and hill[0][0] == hill[0][-1]
    assert all(math.hypot(a - 4, b - 3.5) == pytest.approx(2.5, abs=0.1) for a, b in hill[0])
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hill[0], hill[0][1:])) / 2
    assert area == pytest.approx(math.pi * 6.25, rel=0.1)  # the high side to the left: counter-clockwise
    slope = [p for (k, _), p in found.items() if k == 1]
    assert len(slope) == 1 and [a for a, _ in slope[0]] == [7.5] * 8 and [b for _, b in slope[0]] == list(range(7, -1, -1))
    # the same planes along another axis
    turned = volume(spark, Space((2, 9, 8)), np.moveaxis(z, 0, -1).ravel())
    again = lines_of(contour.contours(turned, 0, 7.5))
    assert sorted(map(len, again.values())) == sorted(map(len, found.values()))


@pytest.mark.parametrize("seed", [0, 1])
def test_contours_against_plain(spark, seed):
    nx, ny, nz = 7, 6, 3
    z = np.random.default_rng(seed).integers(0, 9, (nz, ny, nx)).astype(float)
    if seed:
        z[1, 2, 3], z[2, 0, 0] = np.nan, np.inf
    level = 4.5
    rows = contour.contour_segments(volume(spark, Space((nx, ny, nz)), z.ravel()), 2, level).collect()
    want = collections.Counter()
    for k in range(nz):
        for j in range(ny - 1):
            for i in range(nx - 1):
                corners = {(a, b): z[k, j + b, i + a] for a in (0, 1) for b in (0, 1)}
                if not np.isfinite(list(corners.values())).all():
                    continue
                points = []
                for (p, q) in (((0, 0), (1, 0)), ((1, 0), (1, 1)), ((0, 1), (1, 1)), ((0, 0), (0, 1))):
                    u, w = corners[p], corners[q]
                    if (u > level) != (w > level):
                        s = (level - u) / (w - u)
                        points.append((round(i + p[0] + s * (q[0] - p[0]), 9), round(j + p[1] + s * (q[1] - p[1]), 9)))
                if len(points) == 4:  # below, right, above, left
                    joined = np.mean(list(corners.values())) > level
                    low_left = corners[0, 0] > level
                    pairs = [(points[0], points[1]), (points[2], points[3])] if joined == low_left else [(points[0], points[3]), (points[1], points[2])]
                else:
                    pairs = [tuple(points)] if points else []
                want.update((k, frozenset(p)) for p in pairs)
    assert collections.Counter((r.plane, frozenset({(round(r.from_x, 9), round(r.from_y, 9)), (round(r.to_x, 9), round(r.to_y, 9))})) for r in rows) == want
    lines = lines_of(contour.contours(volume(spark, Space((nx, ny, nz)), z.ravel()), 2, level))
    got = collections.Counter((k, frozenset({(round(a[0], 9), round(a[1], 9)), (round(b[0], 9), round(b[1], 9))})) for (k, _), p in lines.items() for a, b in zip(p, p[1:]))
    assert got == want and len({(k, n) for k, n in lines}) == len(lines)


def test_levels_and_flat_planes(spark):
    v = volume(spark, Space((3, 3, 1)), [0, 0, 2, 4, 10, float("nan"), -1, 0, 6])
    assert contour.contour_level(v) == 2.5 and contour.contour_level(v, 3) == 3.0
    flat = volume(spark, Space((3, 3, 1)), [0] * 9)
    assert contour.contour_level(flat) == 0.5 and contour.contours(flat, 2, 0.5).collect() == []
    thin = volume(spark, Space((1, 9, 1)), range(9))
    assert contour.contours(thin, 2, 3.5).collect() == []
    with pytest.raises(InvalidArgument):
        contour.contours(v, 3, 1.0)


# --- extensions


def test_extensions_of_many_files(spark, tmp_path):
    v = volume(spark, Space((2, 2, 2)), range(8))
    receipt = Receipt("m", "s")
    good = b'<?xml version="1.0" ?>\n<AFNI_attributes self_idcode="XYZ_1" ni_form="ni_group">\n<AFNI_atr ni_type="String" ni_dimen="1" atr_name="HISTORY_NOTE">\n "made by hand" </AFNI_atr>\n<AFNI_atr ni_type="float" ni_dimen="2" atr_name="BRICK_STATS">\n 0 7.5 </AFNI_atr>\n</AFNI_attributes>\n'
    plans = {"a.nii": [], "b.nii": [(4, good), (6, b"h\xc3\xa9llo\xff"), (99, b"\x01\x02")], "c.nii": [(4, b"<AFNI_attributes><broken"), (4, b"")]}
    for name, more in plans.items():
        head = nifti.build_header(v.space, "f8", receipt if name == "a.nii" else None, more=b"".join(nifti.extension(body, code) for code, body in more))
        (tmp_path / name).write_bytes(head + np.arange(8.0).tobytes())
    (tmp_path / "d.nii").write_bytes(b"no image")
    (tmp_path / "e.nii").write_bytes(nifti.build_header(v.space, "f8") + np.arange(8.0).tobytes())
    for where in (str(tmp_path), [str(p) for p in tmp_path.iterdir()]):
        df = extensions.read_extensions(spark, where)
        rows = {(r.path.rsplit("/", 1)[1], r.place): r for r in df.collect()}
        assert set(rows) == {("a.nii", 0), ("b.nii", 0), ("b.nii", 1), ("b.nii", 2), ("c.nii", 0), ("c.nii", 1), ("d.nii", None)}
        assert rows["a.nii", 0].name == "comment" and Receipt.from_extension(bytes(rows["a.nii", 0].content)) == receipt
        b = [rows["b.nii", k] for k in range(3)]
        assert [r.name for r in b] == ["afni", "comment", "unknown"] and b[1].text == "héllo�" and b[2].text is None and bytes(b[2].content).rstrip(b"\0") == b"\x01\x02"
        assert b[0].afni._self_idcode == "XYZ_1" and rows["c.nii", 0].afni is None and rows["c.nii", 1].afni is None and rows["d.nii", None].code is None
        got = {r.attribute: (r.type, r.value) for r in extensions.afni_attributes(df).collect()}
        assert got == {"HISTORY_NOTE": ("String", "made by hand"), "BRICK_STATS": ("float", "0 7.5")}
    assert extensions.name_of(4) == "afni" and extensions.name_of(5) == "unknown"
