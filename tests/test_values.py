"""Values of operators that SQL does not say: maxima, peeling, partitions, design vectors, simulated data, arrays in and out."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_engine import mask, series, values, volume
from voxloom.functions import design
from voxloom.operators import cluster, neighbor, reduce, resample, select
from voxloom.plans.contracts import InvalidArgument, OutOfBounds
from voxloom.plans.frame import Frame
from voxloom.plans.space import Space
from voxloom.sources import arrays


def points(dim):
    return np.array([(i, j, k) for k in range(dim[2]) for j in range(dim[1]) for i in range(dim[0])])


@pytest.mark.parametrize("distance", [1.0, 4.5, 7.0, 300.0])
def test_local_maxima_against_a_walk(spark, distance):
    dim, space = (9, 8, 7), Space((9, 8, 7), (2, 2, 2))
    data = np.random.default_rng(4).integers(0, 12, dim[::-1]).astype(float)
    vol = volume(spark, space, data.ravel())
    at, flat = points(dim), data.ravel()
    padded = np.pad(data, 1, constant_values=-np.inf)
    top = np.max([padded[1 + c : dim[2] + 1 + c, 1 + b : dim[1] + 1 + b, 1 + a : dim[0] + 1 + a] for a, b, c in itertools.product((-1, 0, 1), repeat=3)], 0).ravel()
    comp = spark.createDataFrame([(v, v % 2 + 1) for v in range(504) if flat[v] > 3], "v long, index int")
    want = set()
    for index in (1, 2):
        kept = []
        for v in sorted((v for v in range(504) if v % 2 + 1 == index and flat[v] > 3 and flat[v] == top[v]), key=lambda v: (-flat[v], v)):
            if all(math.dist(at[v], at[w]) >= distance / 2 for w in kept):
                kept.append(v)
        want |= {(index, v, flat[v]) for v in kept}
    assert {tuple(r) for r in cluster.local_maxima(vol, comp, distance).collect()} == want


@pytest.mark.parametrize("peels", [1, 2])
def test_peel_and_restore_against_plain(spark, peels):
    dim, space = (8, 7, 6), Space((8, 7, 6))
    on = set(np.flatnonzero(np.random.default_rng(1).random(336) < 0.4).tolist())
    at = [tuple(p) for p in points(dim).tolist()]
    number = {p: v for v, p in enumerate(at)}
    steps = [o for o in itertools.product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, o)) <= 2]

    def near(v, among):
        return sum(number[tuple(min(max(a + b, 0), d - 1) for a, b, d in zip(at[v], o, dim))] in among for o in steps)  # at an edge the nearest cell counts

    core, off = set(on), {}
    for p in range(1, peels + 1):
        stay = {v for v in core if near(v, core) >= 9}
        off.update({v: p for v in core - stay})
        core = stay
    for p in range(peels, 0, -1):
        core = core | {v for v, q in off.items() if q >= p and v not in core and near(v, core) > (0 if p == peels else 1)}
    df = spark.createDataFrame([(v,) for v in on], "v long")
    assert {r.v for r in cluster.peel_restore(df, space, peels, 9).collect()} == core and core <= on


def test_partition_is_a_fixed_point(spark):
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.normal(m, 1, 60) for m in (0, 10, 30)])
    got = reduce.partition(volume(spark, Space((60, 3, 1)), data), 3).df.collect()
    label = np.zeros(180, int)
    label[[r.v for r in got]] = [r.label for r in got]
    centers = np.array([data[label == k].mean() for k in (1, 2, 3)])
    assert (np.diff(centers) > 0).all() and (np.abs(data[:, None] - centers).argmin(1) + 1 == label).all()


def test_feature_function_and_nuisance(spark):
    rng = np.random.default_rng(3)
    space = Space((3, 2, 2, 2, 4))
    data = rng.random((12, 2, 4))
    rows = [(v, t, f, float(data[v, t, f])) for v in range(12) for t in range(2) for f in range(4)]
    hyper = Frame(spark.createDataFrame(rows, "v long, t int, f int, x double").repartition(5), space, "hyper")
    got = {(r.v, r.t): r.x for r in reduce.apply_feature_function(hyper, lambda x: x[0] - x[3] * x[1]).collect()}
    assert got == pytest.approx({(v, t): data[v, t, 0] - data[v, t, 3] * data[v, t, 1] for v in range(12) for t in range(2)})
    dim = (4, 4, 3)
    y, c = rng.random(48) * 100 + 1000, rng.random((48, 2))
    on = sorted(rng.choice(48, 40, replace=False).tolist())
    conf = spark.createDataFrame([(v, *map(float, c[v]), float(c[v, 0] * 2)) for v in range(48)], "v long, c0 double, c1 double, c2 double")
    found = {r.v: r.value for r in neighbor.nuisance_residual(volume(spark, Space(dim), y), conf, mask(spark, Space(dim), on)).collect()}
    at = points(dim)
    for v in on:
        ball = [w for w in on if np.abs(at[v] - at[w]).sum() <= 1]
        x = np.c_[np.ones(len(ball)), c[ball], 2 * c[ball, 0]]
        beta = np.linalg.lstsq(x, y[ball], rcond=None)[0]
        if len(ball) > 3:  # fewer points are met exactly by any solution
            assert found[v] == pytest.approx(y[v] - np.r_[1, c[v], 2 * c[v, 0]] @ beta, abs=1e-6)
        else:
            assert found[v] == pytest.approx(0, abs=1e-6)


def test_regions_of_lists_and_of_jobs(spark, monkeypatch):
    space = Space((7, 6, 5))
    centers = [(0, 0, 0), (3, 3, 2), (6, 5, 4)]
    offsets = neighbor.ball_offsets(space, 2.0)
    listed = {tuple(r) for r in neighbor.roi(spark, space, centers, offsets).collect()}
    monkeypatch.setattr(neighbor, "ON_DRIVER", 0)
    assert listed == {tuple(r) for r in neighbor.roi(spark, space, centers, offsets).collect()}
    s = series(spark, space.add_dim(2), np.arange(420).reshape(210, 2))
    by_job = {tuple(r) for r in select.series_roi(s, neighbor.spherical_roi(spark, space, (3, 3, 2), 2.0)).collect()}
    monkeypatch.undo()
    assert by_job == {tuple(r) for r in select.series_roi(s, neighbor.spherical_roi(spark, space, (3, 3, 2), 2.0)).collect()}


def test_components_settled_together_and_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    on = spark.createDataFrame([(int(v),) for v in np.flatnonzero(rng.random(70 * 70 * 3) < 0.45)], "v long")
    together = {tuple(r) for r in cluster.components(on, Space((70, 70, 3)), "6-connect").collect()}
    monkeypatch.setattr(cluster, "SMALL", 0)
    assert together == {tuple(r) for r in cluster.components(on, Space((70, 70, 3)), "6-connect").collect()}


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_boxes_pass_by_pass(spark, radius):
    dim = (7, 5, 2)
    data = np.random.default_rng(radius).random(dim).round(2) * (np.random.default_rng(1).random(dim) < 0.6)

    def mean(a):
        wide = np.pad(a, radius)
        return np.array([[[wide[i : i + 2 * radius + 1, j : j + 2 * radius + 1, k : k + 2 * radius + 1].sum() for k in range(dim[2])] for j in range(dim[1])] for i in range(dim[0])]) / (2 * radius + 1) ** 3

    for sparse in (False, True):
        v = arrays.from_array(spark, data, sparse=sparse)
        assert arrays.to_array(neighbor.box_mean(v, radius)) == pytest.approx(mean(data))
        m, q = mean(data), mean(data * data)
        a = (q - m * m) / (q - m * m + 0.1)
        want = np.where(data != 0, mean(a) * data + mean((1 - a) * m), data)
        assert arrays.to_array(neighbor.guided_filter(v, radius, 0.1)) == pytest.approx(want)


def zoomed(data, shape):
    """Linear interpolation axis by axis, ends on ends."""
    for axis, m in enumerate(shape):
        n = data.shape[axis]
        at = np.arange(m) * ((n - 1) / (m - 1) if m > 1 else 0)
        data = np.apply_along_axis(lambda line: np.interp(at, np.arange(n), line), axis, data)
    return data


def test_downsample_to(spark):
    space = Space((6, 5, 4), (2, 2, 3)).add_dim(2, 1.5)
    data = np.random.default_rng(6).random((6, 5, 4, 2))
    s = arrays.from_array(spark, data, space)
    got = resample.downsample_to(s, outdim=(3, 5, 2))
    assert got.space.dim == (3, 5, 2, 2) and got.space.spacing == (4, 2, 6, 1.5)
    assert got.space.grid_to_world([(1, 2, 0.5)]) == pytest.approx(space.grid_to_world([(2.5, 2, 1.5)]))  # the middle stays
    assert arrays.to_array(got) == pytest.approx(data.reshape(3, 2, 5, 1, 2, 2, 2).mean((1, 3, 5)))
    for kw, dim in (({"outdim": (4, 3, 1)}, (4, 3, 1)), ({"factor": 0.7}, (4, 3, 2)), ({"factor": 2}, (3, 2, 2)), ({"spacing": 3.0}, (4, 3, 4)), ({"spacing": (4, 2, 12)}, (3, 5, 1))):
        got = resample.downsample_to(s, **kw)
        assert got.space.dim == (*dim, 2)
        blocks = all(a % b == 0 for a, b in zip(space.dim, dim))
        if not blocks:
            assert arrays.to_array(got) == pytest.approx(np.stack([zoomed(data[..., t], dim) for t in (0, 1)], -1))
    v = arrays.from_array(spark, data[..., 0] * (data[..., 0] > 0.5), Space((6, 5, 4), (2, 2, 3)), sparse=True)
    assert arrays.to_array(resample.downsample_to(v, outdim=(4, 3, 2))) == pytest.approx(zoomed(data[..., 0] * (data[..., 0] > 0.5), (4, 3, 2)))
    for bad in ({}, {"factor": 2, "spacing": 1}, {"factor": 1.5}, {"factor": -1}, {"outdim": (7, 5, 4)}, {"outdim": 3}, {"spacing": (1, 2)}, {"factor": 0.1}):
        with pytest.raises(InvalidArgument):
            resample.downsample_to(s, **bad)


# --- design


def test_response_and_weights(spark):
    t = np.arange(0, 30, 0.5)
    density = lambda k: np.where(t > 0, t ** (k - 1) * np.exp(-t) / math.gamma(k), 0)
    raw = density(6) - 0.167 * density(16)
    assert design.hemodynamic_response(t) == pytest.approx(raw / raw.max()) and design.hemodynamic_response([-1.0, 0.0]).tolist() == [0, 0]
    rows = spark.range(60).select((F.col("id") / 2).alias("t"), design.response(F.col("id") / 2).alias("h")).orderBy("t").collect()
    assert [r.h for r in rows] == pytest.approx(raw)
    assert design.time_weights(4, "linear") == pytest.approx([0, 1 / 6, 1 / 3, 1 / 2]) and design.time_weights(1, "linear") == [1]
    assert design.time_weights(3, "uniform") == pytest.approx([1 / 3] * 3)
    e = np.exp(-0.3 * np.arange(5))
    assert design.time_weights(5, "exponential", 0.3) == pytest.approx(e / e.sum())
    for bad in ((0, "linear"), (3, "other")):
        with pytest.raises(InvalidArgument):
            design.time_weights(*bad)


def test_confounds_of_many_series(spark):
    rows = [(s, t, float(10 * s + t * t)) for s in (1, 2) for t in range(4)]
    df = spark.createDataFrame(rows, "subject int, t int, m double").repartition(3)
    got = sorted(map(tuple, design.confounds(df, True, True, by=["subject"]).select("subject", "t", "m_d", "m_d_2").collect()))
    assert got == [(s, t, float(2 * t - 1 if t else 0), float((2 * t - 1) ** 2 if t else 0)) for s in (1, 2) for t in range(4)]


def test_simulated_series(spark):
    space, times = Space((16, 15, 14), (2, 2, 2)), 50
    still = design.simulate(spark, space, times, 4, noise_sd=0.0, signal_sd=3.0, seed=7)
    x = arrays.to_array(still)
    signal = np.array(design.block_signal(times))
    assert signal.min() == 0 and signal.max() == 1
    stimulus = (np.arange(times) // 10 % 2 == 0).astype(float)
    raw = np.convolve(stimulus, design.hemodynamic_response(np.arange(0, 30, 2.0)))[:times]
    assert signal == pytest.approx((raw - raw.min()) / np.ptp(raw))
    times_covered = x.max(3) / 3.0
    assert set(np.rint(times_covered).astype(int).ravel()) >= {0, 1} and np.allclose(times_covered, np.rint(times_covered)) and np.allclose(x, np.rint(times_covered)[..., None] * 3 * signal)
    noisy = arrays.to_array(design.simulate(spark, space, times, 0, noise_sd=2.0, seed=7))
    assert noisy.std() == pytest.approx(2, rel=0.01) and abs(noisy.mean()) < 0.02
    again = design.simulate(spark, space, times, 0, noise_sd=2.0, seed=7)
    assert np.array_equal(noisy, arrays.to_array(again.like(again.df.repartition(7))))
    assert design.simulate(spark, Space((1, 1, 1)), 2, 2).df.count() == 2


# --- arrays


@pytest.mark.parametrize("shape", [(4, 3, 5), (4, 3, 5, 6), (2, 3, 2, 4, 3)])
def test_arrays_there_and_back(spark, monkeypatch, shape):
    monkeypatch.setattr(arrays, "RUN", 17)
    data = np.random.default_rng(1).integers(-2, 3, shape).astype(">f4")
    frame = arrays.from_array(spark, data)
    assert frame.kind == {3: "volume", 4: "series", 5: "hyper"}[len(shape)] and frame.space.dim == shape and not frame.sparse
    assert np.array_equal(arrays.to_array(frame), data)
    one = tuple(n - 1 for n in shape)
    row = frame.df.where(" and ".join(f"{k} = {n}" for k, n in zip(("v", "t", "f"), (int(np.prod(shape[:3])) - 1, *one[3:])))).collect()
    assert len(row) == 1 and row[0][frame.value] == data[one]
    box = ((1, 1), (0, 2), (1, 1))
    assert np.array_equal(arrays.to_array(frame, box), data[1:2, 0:3, 1:2])
    if len(shape) < 5:
        thin = arrays.from_array(spark, data * (np.arange(shape[0]) > 1).reshape(-1, *[1] * (len(shape) - 1)), sparse=True)
        assert thin.sparse and thin.df.count() < frame.df.count() and np.array_equal(arrays.to_array(thin)[2:], data[2:]) and not arrays.to_array(thin)[:2].any()


def test_masks_and_scattered_values(spark):
    on = np.random.default_rng(2).random((4, 3, 5)) < 0.4
    m = arrays.from_array(spark, on)
    assert m.sparse and dict(m.df.dtypes)["value"] == "boolean" and np.array_equal(arrays.to_array(m), on)
    data = np.arange(240.0).reshape(4, 3, 5, 4)
    kept = arrays.from_array(spark, data, mask=m)
    assert np.array_equal(arrays.to_array(kept), data * on[..., None])
    at = arrays.from_coords(spark, Space((4, 3, 5)), [(0, 0, 0), (3, 2, 4)], [5, 7])
    assert values(at) == {0: 5.0, 59: 7.0}
    for coords, x, error in (([(4, 0, 0)], [1], OutOfBounds), ([(0, 0, 0)] * 2, [1, 2], InvalidArgument), ([(0, 0, 0)], [1, 2], InvalidArgument)):
        with pytest.raises(error):
            arrays.from_coords(spark, Space((4, 3, 5)), coords, x)


def test_what_is_refused(spark):
    for bad in (np.zeros((2, 2)), np.zeros((0, 2, 2)), np.zeros((2, 2, 2), complex), np.array([[["a"]]])):
        with pytest.raises(InvalidArgument):
            arrays.from_array(spark, bad)
    with pytest.raises(InvalidArgument, match="write them to a file"):
        arrays.from_array(spark, np.zeros((10, 10, 10)), most=7999)
    with pytest.raises(InvalidArgument):
        arrays.from_array(spark, np.zeros((2, 2, 2)), Space((2, 2, 3)))
    frame = arrays.from_array(spark, np.zeros((10, 10, 10)))
    with pytest.raises(InvalidArgument, match="take a box"):
        arrays.to_array(frame, most=7999)
    assert arrays.to_array(frame, ((0, 0), (0, 9), (0, 9)), most=7999).shape == (1, 10, 10)
    with pytest.raises(OutOfBounds):
        arrays.to_array(frame, ((0, 10), (0, 9), (0, 9)))
