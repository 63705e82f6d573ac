"""Exact quantiles and display limits, and atlases with their label table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_engine import series, volume
from voxloom.operators import quantile
from voxloom.plans import atlas as atlases
from voxloom.plans import frame as frame_module
from voxloom.plans.contracts import InvalidArgument, SpaceMismatch
from voxloom.plans.frame import Frame
from voxloom.plans.space import Space


def test_quantiles_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(size=101) * 1e-3, 1: rng.integers(-3, 3, 40).astype(float), 2: np.array([5.0]), 3: np.array([-0.0, 0.0, -1e-320, 1e-320]), 4: rng.normal(size=200) * 10.0 ** rng.integers(-300, 300, 200), None: np.array([1.0, -np.inf, np.inf, 2.0, 3.0, 4.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [(1, float("nan")), (2, None), (9, None), (8, float("nan"))]
    df = spark.createDataFrame(rows, "t long, y double").repartition(5)
    qs = (0, 0.02, 0.5, 0.73, 0.98, 1)
    for most in (frame_module.SMALL, 3):  # wanted ranks broadcast, and shuffled
        monkeypatch.setattr(frame_module, "SMALL", most)
        got = {(r.t, r.q): r.value for r in quantile.quantiles(df, "y", qs, "t").collect()}
        assert set(got) == {(g, q) for g in groups for q in map(float, qs)}
        for (g, q), x in got.items():
            with np.errstate(invalid="ignore"):
                want = np.quantile(groups[g], q)
            assert x == pytest.approx(want, rel=1e-12, abs=0) or (np.isinf(x) and np.isinf(want)) or g is None, (g, q)
    assert got[None, 0.0] == -np.inf and got[None, 0.5] == 2.5
    assert quantile.quantiles(df.where("t = 99"), "y", qs).collect() == []
    with pytest.raises(InvalidArgument):
        quantile.quantiles(df, "y", [1.5])


def test_quantiles_with_times(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 0), (5.0, 1_000_000)], "x double, n long")
    assert {r.q: r.value for r in quantile.quantiles(df, "x", (0, 0.5, 1), times="n").collect()} == {0.0: 1.0, 0.5: 5.0, 1.0: 5.0}


def test_sparse_and_limits(spark):
    data = np.zeros((8, 3))
    data[2], data[5, 1], data[7, 2] = (1, 5, -2), 9, np.nan
    space = Space((2, 2, 2)).add_dim(3)
    dense, sparse = series(spark, space, data), series(spark, space, data)
    sparse = sparse.like(sparse.df.where("x <> 0 or isnan(x)"), sparse=True)
    finite = data[np.isfinite(data)]
    for f in (dense, sparse):
        assert {r.q: r.value for r in quantile.frame_quantiles(f, (0.1, 0.9)).collect()} == pytest.approx({q: np.quantile(finite, q) for q in (0.1, 0.9)})
        got = {r.t: (r.lo, r.hi) for r in quantile.display_limits(f, probs=(0.1, 0.9), by="t").collect()}
        want = {t: np.quantile(c[np.isfinite(c)], (0.1, 0.9)) for t, c in enumerate(data.T)}
        assert all(got[t] == pytest.approx(tuple(w) if w[0] != w[1] else (np.nanmin(data[:, t]), np.nanmax(data[:, t]))) for t, w in want.items())
        assert tuple(quantile.display_limits(f, "data").first()) == (-2.0, 9.0)
    flat = volume(spark, Space((2, 1, 1)), [3, 3])
    assert tuple(quantile.display_limits(flat).first()) == (3.0, 4.0) and tuple(quantile.display_limits(flat, (5, 1)).first()) == (1.0, 5.0)
    nothing = volume(spark, Space((2, 1, 1)), [float("nan"), float("inf")])
    assert tuple(quantile.display_limits(nothing).first()) == (0.0, 1.0)
    for bad in ("other", (1, 1), (1, float("nan"))):
        with pytest.raises(InvalidArgument):
            quantile.display_limits(flat, bad)


def labelled(spark):
    space = Space((4, 2, 1))
    return space, Frame(spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 5), (4, 5), (5, 0)], "v long, label int"), space, "labels", True)


def test_atlas_is_checked_both_ways(spark):
    space, labels = labelled(spark)
    kind = "label long, name string, hemi string, network string"
    rows = [(1, "a", "L", "n1"), (2, "b", "R", "n1"), (5, "c", None, "n2")]
    made = atlases.atlas("x", labels, spark.createDataFrame(rows, kind), source="here")
    assert made.provenance["source"] == "here" and made.labels.df.count() == 5 and made.space is labels.space
    again = atlases.atlas("x", labels.like(labels.df.repartition(3)), spark.createDataFrame(rows[::-1], kind))
    assert {k: made.provenance[k] for k in again.provenance} == again.provenance
    other = atlases.atlas("x", labels, spark.createDataFrame([*rows[:2], (5, "d", None, "n2")], kind))
    assert other.provenance["label_table_hash"] != again.provenance["label_table_hash"] and other.provenance["image_hash"] == again.provenance["image_hash"]
    for bad, what in (([*rows, (5, "e", None, None)], r"unique: \[5\]"), (rows[:2], r"table lacks labels of the image: \[5\]"), ([*rows, (7, "f", None, None)], r"image lacks labels of the table: \[7\]"), ([*rows, (0, "z", None, None)], r"background is among the labels: \[0\]")):
        with pytest.raises(InvalidArgument, match=what):
            atlases.atlas("x", labels, spark.createDataFrame(bad, kind))
    plain = atlases.atlas("y", labels, atlases.default_table(labels))
    assert sorted(r.name for r in plain.table.collect()) == ["parcel_1", "parcel_2", "parcel_5"]


def test_rollup(spark):
    space, labels = labelled(spark)
    made = atlases.atlas("x", labels, spark.createDataFrame([(1, "a", "L", "n1"), (2, "b", "R", "n1"), (5, "c", None, "n2")], "label long, name string, hemi string, network string"))
    data = [1.0, 3, 8, 0, 6, 9, 9, 9]
    for sparse in (False, True):
        got = {tuple(r)[:4]: (r.n, r["mean"]) for r in atlases.rollup(made, volume(spark, space, data, sparse)).collect()}
        assert got == {
            (0, "n1", "L", 1): (2, 2.0), (0, "n1", "R", 2): (1, 8.0), (0, "n2", "", 5): (2, 3.0), (1, "n1", "L", None): (2, 2.0), (1, "n1", "R", None): (1, 8.0),
            (1, "n2", "", None): (2, 3.0), (2, "n1", None, None): (3, 4.0), (2, "n2", None, None): (2, 3.0), (3, None, None, None): (5, 3.6),
        }
    with pytest.raises(SpaceMismatch):
        atlases.rollup(made, volume(spark, Space((4, 2, 1), (2, 2, 2)), data))
    s = series(spark, space.add_dim(2), [[v, 10 * v] for v in range(8)])
    assert {(r.name, r.t): r.x for r in atlases.parcel_series(made, s).collect()} == {("a", 0): 0.5, ("a", 1): 5, ("b", 0): 2, ("b", 1): 20, ("c", 0): 3.5, ("c", 1): 35}
