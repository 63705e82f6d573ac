"""Golden values, contracts and round trips of the volumetric engine."""

import collections
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import cluster, elementwise, neighbor, reduce, resample, select
from voxloom.plans import frame as frame_module
from voxloom.plans.contracts import BackendDrift, ImplicitConversion, InvalidArgument, InvalidSpace, MaskMismatch, OutOfBounds, Receipt, SpaceMismatch
from voxloom.plans.frame import Frame, densified, sparsified
from voxloom.plans.space import Space, axis_codes, matrix_to_quaternion, obliquity, output_aligned_space, quaternion_to_matrix, rescale_affine, voxel_sizes

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def volume(spark, space, values, sparse=False):
    rows = [(i, float(x)) for i, x in enumerate(values) if not (sparse and x == 0)]
    return Frame(spark.createDataFrame(rows, "v long, value double"), space, "volume", sparse)


def series(spark, space, matrix, sparse=False):
    rows = [(v, t, float(x)) for v, row in enumerate(matrix) for t, x in enumerate(row)]
    return Frame(spark.createDataFrame(rows, "v long, t int, x double"), space, "series", sparse)


def mask(spark, space, voxels):
    return Frame(spark.createDataFrame([(int(v), True) for v in voxels], "v long, value boolean"), space, "volume", True)


def values(frame):
    return {r[0]: r[1] for r in frame.df.select("v", frame.value).collect()}


# --- spaces


def test_space_goldens():
    s = Space((4, 4, 4), (2, 2, 2), (-3, -3, -3))
    assert s.grid_to_world([(0, 1, 2)]).tolist() == [[-3, -1, 1]]
    assert s.world_to_grid([(3, 5, 7)]).tolist() == [[3, 4, 5]]
    assert s.grid_to_index([(1, 2, 3)]).tolist() == [57] and s.index_to_grid([57]).tolist() == [[1, 2, 3]]
    assert Space((4, 4)).spacing == (1, 1) and Space((4, 4, 4, 9), (2,)).spacing == (2, 1, 1, 1)
    assert s.world_to_grid([(-2, 0, 2)]).tolist() == [[0, 2, 2]]  # halves to even


@pytest.mark.parametrize("bad", [{"dim": (0, 1, 1)}, {"dim": (2, 2, 2), "spacing": (1, -1, 1)}, {"dim": (2, 2), "spacing": (1, 1, 1)}, {"dim": (2, 2, 2), "trans": ((0,) * 4,) * 4}])
def test_invalid_spaces(bad):
    with pytest.raises(InvalidSpace):
        Space(**bad)


def test_compatible_spaces():
    a = Space((4, 4, 4), (2, 2, 2))
    assert a.compatible_with(a.add_dim(7)) and a == Space((4, 4, 4), (2, 2, 2)) and a != Space((4, 4, 4))
    flipped = a.with_trans(np.diag([-2, 2, 2, 1]))
    with pytest.raises(SpaceMismatch):
        a.compatible_with(flipped)
    with pytest.raises(OutOfBounds):
        a.grid_to_index([(4, 0, 0)])
    assert a.drop_dim().dim == (4, 4) and a.which_dim("L") == 0 and a.dim_of("S") == 4


def test_orientation():
    assert axis_codes(np.diag([-2, 3, 1, 1])) == ("L", "A", "S")
    assert axis_codes([[0, 0, 2, 0], [-3, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 1]]) == ("P", "S", "R")
    c, s = np.cos(0.1), np.sin(0.1)
    turned = np.array([[2 * c, -2 * s, 0, 5], [2 * s, 2 * c, 0, 6], [0, 0, 3, 7], [0, 0, 0, 1]])
    assert obliquity(turned).max() == pytest.approx(np.degrees(0.1)) and voxel_sizes(turned) == pytest.approx([2, 2, 3])
    b, q, d, fac, sizes = matrix_to_quaternion(turned)
    assert quaternion_to_matrix(b, q, d, fac, sizes, turned[:3, 3]) == pytest.approx(turned)
    again = rescale_affine(turned, (10, 10, 10), (1, 1, 1), (20, 20, 30))
    assert again @ [9.5, 9.5, 14.5, 1] == pytest.approx(turned @ [4.5, 4.5, 4.5, 1])
    box = output_aligned_space(Space((10, 10, 10), trans=tuple(map(tuple, turned))))
    assert box.spacing == (2, 2, 2)


def test_receipts():
    a = Receipt("mean", "s", "none", 3.0, 5)
    b = Receipt("tsnr", "s", "m1", 4.0, 9)
    m = a.merge(b)
    assert (m.method_name, m.mask_hash, m.radius, m.n_voxels) == ("mean+tsnr", "m1", None, 9)
    assert Receipt.from_json(a.to_json()) == a and Receipt.from_extension(a.to_extension() + b"\0\0") == a
    assert Receipt.from_extension(b"other") is None and a.diff(b)["radius"] == (3.0, 4.0)
    with pytest.raises(SpaceMismatch):
        a.merge(Receipt("x", "other"))
    with pytest.raises(MaskMismatch):
        b.merge(Receipt("x", "s", "m2"))


# --- frames


def test_series_golden(spark):
    space = Space((2, 2, 2, 5))
    s = series(spark, space, [[10 * (t + 1) + v + 1 for t in range(5)] for v in range(8)])
    assert [r.x for r in select.series_at(s, [0]).orderBy("t").collect()] == [11, 21, 31, 41, 51]
    assert sum(values(select.volume_at(s, 0)).values()) == 116
    assert [r.x for r in select.series_at(s, [7, 0, 7]).where("t = 0").orderBy("ord").collect()] == [18, 11, 18]
    with pytest.raises(OutOfBounds):
        select.series_at(s, [8])
    assert [r.x for r in select.series_at_coords(s, [(9, 0, 0)], "zero").collect()] == [0.0] * 5
    back = select.from_matrix(select.to_matrix(s))
    assert sorted(back.collect()) == sorted(s.df.collect())
    with pytest.raises(ImplicitConversion):
        np.asarray(s)


def test_dense_and_sparse_zeros(spark):
    space = Space((2, 2, 1))
    v = volume(spark, space, [0, 4, -2, 0], sparse=True)
    got = reduce.global_stats(v).first()
    assert (got.n, got.total, got.mean, got.lo, got.hi) == (4, 2, 0.5, -2, 4) and got.sd == pytest.approx(np.std([0, 4, -2, 0]))
    assert values(densified(v)) == {0: 0, 1: 4, 2: -2, 3: 0} and values(sparsified(densified(v))) == {1: 4, 2: -2}
    assert values(elementwise.arithmetic(v, 1.0, "+")) == {1: 5, 2: -1}
    nan = volume(spark, space, [float("nan"), 1, 2, 3])
    assert np.isnan(reduce.global_stats(nan).first().mean) and reduce.global_stats(nan, na_rm=True).first().mean == 2
    assert reduce.which_extreme(volume(spark, space, [1, 5, 5, 1])).first() == (0, 1)


def test_arithmetic_is_ieee(spark):
    space = Space((4, 1, 1))
    a, b = volume(spark, space, [1, -1, 0, 6]), volume(spark, space, [0, 0, 0, 3])
    got = values(elementwise.arithmetic(a, b, "/"))
    assert got[0] == np.inf and got[1] == -np.inf and np.isnan(got[2]) and got[3] == 2
    nan = volume(spark, space, [float("nan"), 1, 2, 3])
    assert values(elementwise.compare(nan, 1.5, ">")) == {0: False, 1: False, 2: True, 3: True}
    assert values(elementwise.compare(nan, 1.0, "!="))[0]
    with pytest.raises(SpaceMismatch):
        elementwise.arithmetic(a, volume(spark, Space((4, 1, 1), (2, 2, 2)), [1, 1, 1, 1]), "+")
    assert values(elementwise.map_values(a, {1: -1, -1: 1})) == {0: -1, 1: 1, 2: 0, 3: 6}


def test_factor_reductions(spark):
    space = Space((1, 1, 3, 4))
    s = series(spark, space, [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12]])
    f = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 2)], "t int, level int")
    assert values(reduce.split_reduce(s, f)) == {0: 2.5, 1: 6.5, 2: 10.5}
    scaled = reduce.split_scale(s, f).df.orderBy("v", "t").collect()
    assert [r.x for r in scaled] == [-1, 1] * 6
    filled = reduce.split_fill(s, f).where("level = 2 and v = 1").orderBy("t").collect()
    assert [(r.t, r.x) for r in filled] == [(0, 7), (1, 8)]
    assert values(reduce.dot_reduce(s, [1, 0, 0, 2])) == {0: 9, 1: 21, 2: 33}
    both = reduce.concat(s, s)
    assert both.space.dim == (1, 1, 3, 8) and both.df.where("v = 0 and t = 5").first().x == 2


def test_connectome_of_a_constant(spark):
    rows = [(l, t, float(x)) for l, xs in ((1, [1, 2, 4]), (2, [2, 4, 8]), (3, [5, 5, 5])) for t, x in enumerate(xs)]
    p = Frame(spark.createDataFrame(rows, "label int, t int, x double"), Space((1, 1, 1, 3)), "parcels")
    got = {(r.p, r.q): r.value for r in reduce.connectome(p).collect()}
    assert got[1, 2] == pytest.approx(1) and np.isnan(got[1, 3]) and np.isnan(got[3, 3]) and len(got) == 9


# --- neighbourhoods


def test_regions(spark):
    space = Space((5, 5, 5), (2, 2, 2))
    assert neighbor.spherical_roi(spark, space, (2, 2, 2), 2.0).count() == 7
    assert neighbor.cuboid_roi(spark, space, (0, 0, 0), (1, 1, 1)).count() == 8
    assert neighbor.square_roi(spark, space, (2, 2, 2), 1, 0).count() == 9
    with pytest.raises(InvalidArgument):
        neighbor.spherical_roi(spark, space, (2, 2, 2), 1.0)
    with pytest.raises(OutOfBounds):
        neighbor.cuboid_roi(spark, space, (5, 0, 0), 1)
    k = neighbor.kernel("gaussian", (3, 3, 3), 1.0)
    assert sum(w for *_, w in k) == pytest.approx(1) and len(neighbor.embed_kernel(k, space, (2, 2, 2))) == 27
    with pytest.raises(OutOfBounds):
        neighbor.embed_kernel(k, space, (0, 2, 2))


def test_gaussian_reflects(spark):
    row = [0, 0, 0, 0, 1.0, 3, 0, 0, 2]
    for n in (9, 600):
        x = np.array((row * 70)[:n], float)
        got = values(neighbor.gaussian_blur(volume(spark, Space((n, 1, 1)), x), 1.0, 3.0))
        w = neighbor.gaussian_weights(1.0, 3.0)
        r = len(w) // 2
        padded = np.pad(x, r, mode="symmetric")
        want = sum(c * padded[r + d : r + d + n] for d, c in w)
        assert [got[i] for i in range(n)] == pytest.approx(want.tolist())


def test_components_golden(spark):
    a = np.zeros((10, 10, 10))
    a[1:3, 1:3, 1:3], a[5:8, 5:8, 5:8], a[9, 0, 9] = 5, 10, 3
    v = volume(spark, Space((10, 10, 10), (2, 2, 2)), a.ravel(order="F"))
    comp = cluster.conn_comp(v, 2.0, "26-connect")
    sizes = {r["index"]: r["size"] for r in comp.collect()}
    assert sizes == {1: 8, 2: 27, 3: 1}
    table = {r["index"]: (r.volume, r["mean"], r.peak) for r in cluster.cluster_table(v, comp).collect()}
    assert table == {1: (64, 5, 5), 2: (216, 10, 10), 3: (8, 3, 3)}
    assert cluster.local_maxima(v, comp, 100.0).count() == 3


def test_a_long_chain_settles(spark):
    space = Space((40, 40, 1))
    snake = [x + 40 * y for y in range(0, 40, 2) for x in range(40)] + [(39 if y % 4 == 1 else 0) + 40 * y for y in range(1, 39, 2)]
    on = spark.createDataFrame([(v,) for v in snake], "v long")
    assert cluster.components(on, space, "6-connect").select("root").distinct().count() == 1


def test_holes_and_largest(spark):
    space = Space((5, 5, 5))
    a = np.ones((5, 5, 5), bool)
    a[2, 2, 2] = False
    a[0] = False
    a[0, 0, 0] = True
    on = spark.createDataFrame([(int(v),) for v in np.flatnonzero(a.ravel(order="F"))], "v long")
    assert cluster.fill_holes(on, space).count() == on.count() + 1


def test_cover_is_the_greedy_walk(spark):
    space = Space((6, 6, 2))
    m = mask(spark, space, range(72))
    spark.sparkContext.setCheckpointDir("/tmp/voxloom-tests")
    got = {r.center for r in neighbor.covering_centers(m, 1.5, 3).collect()}
    order = [r.v for r in m.df.orderBy(F.xxhash64("v", F.lit(3)), "v").collect()]
    balls = {}
    for r in neighbor.searchlight_coords(m, 1.5).collect():
        balls.setdefault(r.center, set()).add(r.v)
    kept, gone = set(), set()
    for v in order:
        if v not in gone:
            kept.add(v)
            gone |= balls[v]
    assert got == kept


# --- resampling


def test_reorient_round_trip(spark):
    s = Space((3, 4, 5), (1, 2, 3))
    v = volume(spark, s, range(60))
    turned = resample.reorient(v, ("P", "S", "L"))
    assert resample.codes(turned) == ("P", "S", "L") and turned.space.dim == (4, 5, 3)
    back = resample.as_canonical(turned)
    assert back.space == s and values(back) == values(v)


def test_linear_and_cubic_hit_the_grid(spark):
    s = Space((4, 4, 4), (2, 2, 2))
    rng = np.random.default_rng(1)
    v = volume(spark, s, rng.random(64))
    for order in (0, 1, 3):
        got = values(resample.resample(v, s, order))
        assert [got[i] for i in range(64)] == pytest.approx([values(v)[i] for i in range(64)])
    plane = volume(spark, s, [i + 2 * j + 3 * k for k in range(4) for j in range(4) for i in range(4)])
    half = Space((3, 3, 3), (2, 2, 2), (1, 1, 1))
    assert values(resample.resample(plane, half, 1))[0] == pytest.approx(3)
    assert values(resample.resample(plane, Space((1, 1, 1), (2, 2, 2), (100, 0, 0)), 1)) == {0: 0.0}


# --- files


def test_nifti(spark, tmp_path):
    from voxloom.sources import formats, nifti

    c, s = np.cos(0.3), np.sin(0.3)
    space = Space((3, 4, 5), trans=((2 * c, -2 * s, 0, 1), (2 * s, 2 * c, 0, 2), (0, 0, 3, 4), (0, 0, 0, 1))).add_dim(3, 1.5)
    data = series(spark, space, np.random.default_rng(2).random((60, 3)).round(3))
    data = data.like(data.df, receipt=Receipt("mean", "s"))
    for name in ("a.nii", "a.nii.gz"):
        path = f"{tmp_path}/{name}"
        nifti.write(data, path, "f8")
        header = nifti.read_header(path)
        assert header.dim == (3, 4, 5, 3) and header.receipt == data.receipt and header.space.compatible_with(space)
        got = nifti.read_series(spark, path)
        assert sorted(got.df.collect()) == sorted(data.df.collect())
        assert values(nifti.read_volume(spark, path, 2)) == values(select.volume_at(data, 2))
        assert nifti.read(spark, path).where("v >= 10 and v < 12 and t = 1").count() == 2
        assert formats.find_format(path).file_matches(path)
    assert nifti.read(spark, path, path).where("t = 5").count() == 60
    other = f"{tmp_path}/b.nii"
    nifti.write(data.like(data.df, space=Space((3, 4, 5)).add_dim(3)), other)
    with pytest.raises(Exception, match="transforms differ"):
        nifti.read(spark, path, other).count()
    assert issubclass(BackendDrift, ValueError) and formats.find_format(f"{tmp_path}/none.nii") is None


def test_afni_and_niml(spark, tmp_path):
    from voxloom.sources import afni

    space = Space((2, 3, 2), (2, 2, 3), (1, 2, 3)).add_dim(2)
    data = series(spark, space, np.arange(24).reshape(12, 2))
    for compress in (False, True):
        head, _ = afni.write(data, f"{tmp_path}/x{int(compress)}.HEAD", "f4", compress)
        got = afni.read_series(spark, head)
        assert got.space.compatible_with(space) and sorted(got.df.collect()) == sorted(data.df.collect())
    raw = b'<group a="1"><tab ni_type="2*float" ni_dimen="3" ni_form="binary.lsbfirst">' + np.arange(6, dtype="<f4").tobytes() + b'</tab><t ni_type="int" ni_dimen="2"> 4 5 </t></group>'
    (tmp_path / "n.niml").write_bytes(raw)
    got = afni.read_niml(spark, f"{tmp_path}/n.niml").orderBy("element", "component", "n").collect()
    assert [r.value for r in got] == [0, 2, 4, 1, 3, 5, 4, 5]


def test_columns(spark, tmp_path):
    from voxloom.sources import binary

    m = np.arange(12.0).reshape(3, 4)
    binary.write_elements(f"{tmp_path}/m.bin", m.ravel(order="F"), "<f8")
    assert (binary.read_elements(f"{tmp_path}/m.bin", "<f8", 5) == m.ravel(order="F")[:5]).all()
    with pytest.raises(EOFError):
        binary.read_elements(f"{tmp_path}/m.bin", "<f8", 13)
    got = {(r.row, r.col): r.value for r in binary.read_columns(spark, f"{tmp_path}/m.bin", 3).collect()}
    assert got == {(i, j): m[i, j] for i in range(3) for j in range(4)}


def test_design(spark):
    from voxloom.functions import design

    assert sum(design.time_weights(9, "linear")) == pytest.approx(1) and max(design.hemodynamic_response(np.arange(0, 30, 0.1))) == 1
    motion = spark.createDataFrame([(0, 1.0), (1, 4.0)], "t int, rx double")
    assert design.confounds(motion, True, True).orderBy("t").collect()[1] == (1, 4.0, 3.0, 16.0, 9.0)
    a, b = (design.simulate(spark, Space((3, 3, 3)), 5, 1, seed=4).df.repartition(n, "t") for n in (1, 3))
    assert sorted(a.collect()) == sorted(b.collect())


def test_streams(spark, tmp_path):
    from voxloom.streaming.windows import sessions, tumbling

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = tumbling(stream, "1 day", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.start, r.event_type, r.n) for r in tumbling(events, "1 day", ["event_type"]).collect()}
    assert {(r.start, r.event_type, r.n) for r in spark.sql("select * from days").collect()} == want
    assert sessions(events, "1 hour", "user_id").agg(F.sum("n")).first()[0] == events.count()


# --- all queries


def _names():
    from voxloom.queries import ORACLE_SQL

    return sorted(ORACLE_SQL)


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", _names())
def test_query_against_sql(spark, tables, name):
    from voxloom.queries import ORACLE_SQL, QUERIES

    got = QUERIES[name](spark, SF).toPandas()
    want = tables.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for c in cols:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c], b[c].astype(float), rtol=1e-7, atol=2e-6, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_entry_lists_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


# --- sparse frames, large balls, components over cubes, clip levels -------------------------------


def _sparse_series(spark, seed=1):
    rng = np.random.default_rng(seed)
    cells = [(int(v), int(t), float(rng.normal())) for v in rng.choice(27, 20, replace=False) for t in range(6) if rng.random() < 0.6]
    df = spark.createDataFrame(cells, "v long, t int, x double")
    data = np.zeros((27, 6))
    for v, t, x in cells:
        data[v, t] = x
    return Frame(df, Space((3, 3, 3, 6)), "series", True), data


def test_absent_cells_of_sparse_series_are_zeros(spark):
    frame, data = _sparse_series(spark)
    stored = {r.v for r in frame.df.select("v").distinct().collect()}
    mean = {r.v: r.value for r in reduce.mean_over_time(frame).df.collect()}
    snr = {r.v: r.value for r in reduce.temporal_snr(frame).df.collect()}
    assert set(mean) == set(snr) == stored
    for v in stored:
        assert mean[v] == pytest.approx(data[v].mean()) and snr[v] == pytest.approx(data[v].mean() / data[v].std())
    mask = Frame(spark.createDataFrame([(v, True) for v in range(20)], "v long, value boolean"), frame.space.spatial, "volume", True)
    at = np.array([(v % 3, v // 3 % 3, v // 9) for v in range(27)])
    for how, f in (("mean", np.mean), ("sd", np.std), ("min", np.min)):
        got = {(r.v, r.t): r.x for r in neighbor.searchlight(frame, mask, 1.0, how).df.collect()}
        for v in range(20):
            ball = [u for u in range(20) if ((at[u] - at[v]) ** 2).sum() <= 1]
            for t in range(6):
                assert got[v, t] == pytest.approx(f(data[ball, t]))
    runs = spark.createDataFrame([(t, t // 2) for t in range(6)], "t int, run int")
    got = {(r.v, r.run): r.value for r in neighbor.leave_one_run_out(frame, runs).collect()}
    assert got == {(v, k): pytest.approx(np.delete(data[v], [2 * k, 2 * k + 1]).mean()) for v in stored for k in range(3)}


def test_large_balls():
    space = Space((64, 64, 64), (1.0, 1.0, 1.0))
    assert len(neighbor.ball_offsets(space, 8.0)) == 2109 and len(neighbor.ball_offsets(space, 10.0)) == 4169
    assert len(neighbor.ellipsoid_offsets((10, 10, 10))) == 4169


def test_a_large_ball_is_laid_out(spark):
    space = Space((64, 64, 64), (1.0, 1.0, 1.0))
    got = neighbor.spherical_roi(spark, space, (32, 32, 32), 10.0)
    assert got.count() == 4169 and got.select("v").distinct().count() == 4169


def _walked(on, offsets, dim):
    """(v: least voxel reached) by a plain walk."""
    nx, ny, nz = dim
    left, root = set(on), {}
    for v in sorted(on):
        if v not in left:
            continue
        left.discard(v)
        todo = [v]
        while todo:
            u = todo.pop()
            root[u] = v
            i, j, k = u % nx, u // nx % ny, u // (nx * ny)
            for a, b, c in offsets:
                if 0 <= i + a < nx and 0 <= j + b < ny and 0 <= k + c < nz:
                    w = i + a + nx * (j + b + ny * (k + c))
                    if w in left:
                        left.discard(w)
                        todo.append(w)
    return root


@pytest.mark.parametrize("connect,share", [("6-connect", 0.4), ("26-connect", 0.09)])
def test_components_across_cubes(spark, connect, share):
    dim = (70, 6, 40)
    on = np.flatnonzero(np.random.default_rng(2).random(70 * 6 * 40) < share)
    df = spark.createDataFrame([(int(v),) for v in on], "v long")
    got = {r.v: r.root for r in cluster.components(df, Space(dim), connect).collect()}
    assert got == _walked(on.tolist(), neighbor.connectivity(connect), dim)


def _is_level(values, level, mfrac=0.5):
    """Whether the level is what defines it: ``mfrac`` times the median of what lies over it, in whole bins."""
    x = np.sort(np.asarray(values)[np.asarray(values) > 0])
    if len(x) <= 222:
        return level == 0
    whole = np.allclose(x, np.rint(x), atol=1e-8) and x[-1] <= 32767
    bins = {True: 255 if x[-1] <= 255 else 32767, False: 10000}[bool(whole)]
    scale = 1.0 if whole else bins / x[-1]
    place = np.rint(x) if whole else np.floor(scale * x + 0.499)
    cut = round(level * scale)
    over = place[(place >= cut) & (place < bins)]
    return level == pytest.approx(cut / scale) and int(mfrac * (over[len(over) // 2 - 1] + 1)) == cut


def test_clip_levels(spark):
    rng = np.random.default_rng(6)
    for data in (rng.gamma(2.0, 100.0, 1000), np.round(rng.gamma(2.0, 30.0, 1000)), np.round(rng.gamma(2.0, 3000.0, 1000)), rng.random(200), np.append(rng.random(500) * 3, rng.random(500) * 900 + 600)):
        n = len(data) // 10
        frame = Frame(spark.createDataFrame([(k, float(x)) for k, x in enumerate(data)], "v long, value double"), Space((10, 1, n)), "volume", False)
        boxes = [None, ((0, 4), (0, 0), (0, n - 1)), ((3, 9), (0, 0), (0, n // 2))]
        cube = data.reshape(n, 10)
        parts = (data, cube[:, :5].ravel(), cube[: n // 2 + 1, 3:].ravel())
        assert all(_is_level(part, level) for part, level in zip(parts, reduce.clip_levels(frame, boxes)))


def test_gradual_clip_by_value(spark):
    rng = np.random.default_rng(8)
    dim = (24, 20, 18)
    data = rng.gamma(3.0, 40.0, dim[::-1]) * np.linspace(1, 4, 24)  # brighter along x
    frame = volume(spark, Space(dim), data.ravel())
    whole, column = reduce.gradual_clip(frame)
    got = np.array([r.c for r in frame.df.select("v", column.alias("c")).orderBy("v").collect()]).reshape(dim[::-1])
    grid = np.meshgrid(*(np.arange(d) for d in dim[::-1]), indexing="ij")[::-1]
    middle = [int(np.rint((g * data).sum() / data.sum())) for g in grid]
    ends = [((0, min(m + 1, d - 1)), (max(m - 1, 0), d - 1)) for m, d in zip(middle, dim)]
    shares = [np.interp(np.arange(d), [m / 2, (m + d - 1) / 2], [0, 1]) for m, d in zip(middle, dim)]
    want = np.zeros(dim[::-1])
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                (x0, x1), (y0, y1), (z0, z1) = ends[0][a], ends[1][b], ends[2][c]
                box = data[z0 : z1 + 1, y0 : y1 + 1, x0 : x1 + 1].ravel()
                level = reduce.clip_level(volume(spark, Space((len(box), 1, 1)), box))
                assert _is_level(box, level)
                weight = [s if on else 1 - s for s, on in zip(shares, (a, b, c))]
                want += max(level, 0.333 * whole) * np.einsum("k,j,i->kji", weight[2], weight[1], weight[0])
    assert whole == pytest.approx(reduce.clip_level(frame)) and got == pytest.approx(want) and got[:, :, -1].mean() > 1.5 * got[:, :, 0].mean()


def test_automask_follows_brightness_over_space(spark):
    dim = (24, 24, 24)
    rng = np.random.default_rng(9)
    k, j, i = np.meshgrid(*(np.arange(24),) * 3, indexing="ij")
    ball = (i - 12) ** 2 + (j - 12) ** 2 + (k - 12) ** 2 <= 81
    hole = (i - 12) ** 2 + (j - 12) ** 2 + (k - 12) ** 2 <= 4
    data = np.where(ball & ~hole, 300.0 + 60.0 * i, 0) + rng.random(24**3).reshape(24, 24, 24) * 20
    frame = Frame(spark.createDataFrame([(n, float(x)) for n, x in enumerate(data.ravel())], "v long, value double"), Space(dim), "volume", False)
    got = np.zeros(24**3, bool)
    got[[r.v for r in cluster.automask(frame).df.collect()]] = True
    assert (got.reshape(24, 24, 24) != ball).sum() <= 12  # the hole is filled, single voxels of the rim may go
    assert cluster.automask(frame.like(frame.df.where("v < 100"), sparse=True)).df.count() == 0


def test_random_centers_and_places(spark):
    on = spark.createDataFrame([(v, True) for v in range(0, 90, 3)], "v long, value boolean").repartition(7)
    mask = Frame(on, Space((10, 10, 1)), "volume", True)
    got = {r.draw: r.v for r in neighbor.random_centers(mask, 200, 4).collect()}
    assert sorted(got) == list(range(200)) and set(got.values()) <= set(range(0, 90, 3)) and len(set(got.values())) > 20
    assert got == {r.draw: r.v for r in neighbor.random_centers(mask, 200, 4).collect()}
    assert neighbor.random_centers(mask.like(on.where("false")), 5).collect() == []
    places = frame_module.numbered(on.select("v"), "v", "n", 1).orderBy("v").collect()
    assert [r.n for r in places] == list(range(1, 31))


def test_point_reads_reach_the_source(spark, tmp_path):
    spark.range(5000).selectExpr("id AS vec_id", "array(cast(id AS float), 1f) AS e").write.parquet(f"{tmp_path}/e")
    df = spark.read.parquet(f"{tmp_path}/e").select(F.col("vec_id").alias("v"), F.posexplode("e").alias("t", "x"))
    frame = Frame(df.withColumn("x", F.col("x").cast("double")), Space((50, 50, 2, 2)), "series")
    for got in (select.series_at(frame, [7, 3, 7]), select.series_roi(frame, spark.createDataFrame([(0, 7), (1, 3), (2, 7)], "ord int, v long"))):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "In(vec_id" in plan
        assert sorted((r.ord, r.t, r.x) for r in got.collect()) == [(0, 0, 7.0), (0, 1, 1.0), (1, 0, 3.0), (1, 1, 1.0), (2, 0, 7.0), (2, 1, 1.0)]
    many = select.series_roi(frame, spark.range(4000).selectExpr("cast(id AS int) AS ord", "id + 500 AS v"))
    assert "GreaterThanOrEqual(vec_id,500)" in many._jdf.queryExecution().executedPlan().toString()
    assert many.agg(F.sum("x")).first()[0] == sum(range(500, 4500)) + 4000


def test_resampled_searchlight_takes_any_function(spark):
    frame, data = _sparse_series(spark, 3)
    mask = Frame(spark.createDataFrame([(v, True) for v in range(27)], "v long, value boolean"), frame.space.spatial, "volume", True)
    closed = {r.v: r.value for r in neighbor.resampled_searchlight(frame, mask, 1.0, n_resamples=6, seed=2).collect()}
    called = {r.v: r.value for r in neighbor.resampled_searchlight(frame, mask, 1.0, lambda a: a.mean(), 6, 2).collect()}
    assert closed == pytest.approx(called)
    clusters = neighbor.clustered_searchlight(mask, csize=4, seed=1)
    assert clusters.count() == 27 and clusters.select("label").distinct().count() == 4
