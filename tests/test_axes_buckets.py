"""Axes, slices as frames, and named volumes."""

import numpy as np
import pytest

from test_engine import values, volume
from voxloom.operators import elementwise, select
from voxloom.plans import axes
from voxloom.plans.bucket import Bucket, bucket
from voxloom.plans.contracts import InvalidArgument, InvalidSpace, OutOfBounds, SpaceMismatch
from voxloom.plans.space import Space


def test_axes_by_code_and_name():
    assert [axes.match_axis(x) for x in ("L", "left", "Left-to-Right", "p", "SUPERIOR", "superior_to_inferior")] == ["R", "R", "R", "A", "I", "I"]
    assert axes.find_anatomy("LPI") == ("R", "A", "S") and axes.find_anatomy("r-a-s") == ("L", "P", "I")
    assert [axes.named(a) for a in ("R", "A", "S", "t")] == ["Left-to-Right", "Posterior-to-Anterior", "Inferior-to-Superior", "t"]
    for bad in ("LRP", "LP", "XYZ"):
        with pytest.raises(InvalidArgument):
            axes.find_anatomy(bad)


def test_sets_of_axes():
    own = ("R", "A", "S", "t")
    assert axes.flip(own, "A") == ("R", "P", "S", "t") and axes.flip(own, "Left-to-Right")[0] == "L" and axes.flip(axes.flip(own, 3), 3) == own
    assert axes.permute(own, (2, 0, 1, 3)) == ("S", "R", "A", "t") and axes.drop(own, "S") == ("R", "A", "t") == axes.drop(own, 2)
    assert axes.add(own, "f") == (*own, "f")
    for bad in (lambda: axes.permute(own, (0, 0, 1, 2)), lambda: axes.add(own, "t")):
        with pytest.raises(InvalidArgument):
            bad()
    with pytest.raises(InvalidSpace):
        axes.drop(own, "f")


def test_slices_in_space():
    space = Space((4, 5, 6), (2, 3, 4), (-1, -2, -3))
    assert axes.slice_orientation(space, "axial") == "Left-to-Right-Posterior-to-Anterior"
    assert axes.slice_orientation(space, "sagittal") == "Posterior-to-Anterior-Inferior-to-Superior"
    lo, hi = axes.slice_bounds(space, "coronal", 2)
    assert lo.tolist() == [-1, 4, -3] and hi.tolist() == [5, 4, 17]
    turned = space.with_trans([[0, -3, 0, 0], [2, 0, 0, 0], [0, 0, 4, 0], [0, 0, 0, 1]])
    lo, hi = axes.slice_bounds(turned, "axial")
    assert lo.tolist() == [-12, 0, 0] and hi.tolist() == [0, 6, 20]
    with pytest.raises(OutOfBounds):
        axes.slice_bounds(space, "axial", 6)
    with pytest.raises(InvalidArgument):
        axes.slice_orientation(space, "other")


def test_slice_frames(spark):
    space = Space((3, 4, 2), (2, 3, 4), (1, 2, 3))
    data = np.random.default_rng(1).random((2, 4, 3))
    v = volume(spark, space, data.ravel())
    for axis, plane in ((2, data[1]), (1, data[:, 1]), (0, data[:, :, 1])):
        s = select.slice_frame(v, 1, axis)
        assert s.space.dim == plane.shape[::-1] and values(s) == dict(enumerate(plane.ravel()))
    s, t = select.slice_frame(v, 1, 2), select.slice_frame(v, 0, 2)
    assert s.space == t.space == Space((3, 4), (2, 3), (1, 2)) and s.space.axes == ("R", "A")
    got = elementwise.arithmetic(elementwise.arithmetic(s, t, "-"), 2.0, "*")
    assert values(got) == pytest.approx(dict(enumerate((2 * (data[1] - data[0])).ravel())))
    assert values(elementwise.arithmetic(s, 1.0, "-", reflected=True))[5] == pytest.approx(1 - data[1].ravel()[5])
    assert s.space.grid_to_index([(2, 3)]).tolist() == [11] and s.space.index_to_grid([11]).tolist() == [[2, 3]]
    with pytest.raises(SpaceMismatch):
        elementwise.arithmetic(s, select.slice_frame(v, 0, 1), "+")
    with pytest.raises(OutOfBounds):
        select.slice_frame(v, 2, 2)


def test_buckets(spark):
    space = Space((2, 2, 1))
    a, b, c = (volume(spark, space, [k, k + 1, k + 2, k + 3]) for k in (0, 10, 20))
    held = bucket(["a", "b", "c"], a, b, c)
    assert len(held) == 3 and "b" in held and "d" not in held and values(held.volume("b")) == values(b) == values(held.volume(1)) and values(held.volume(-1)) == values(c)
    assert held.part(slice(1, None)).names == ("b", "c") and values(held.part(["c", "a"]).volume(0)) == values(c)
    assert {(r.name, r.value) for r in held.rows().where("v = 3").collect()} == {("a", 3), ("b", 13), ("c", 23)}
    assert values(bucket(["x"], a).volume("x")) == values(a)
    for bad in (lambda: bucket(["a"], a, b), lambda: bucket(["a", "a"], a, b), lambda: bucket([]), lambda: held.volume("z"), lambda: Bucket(("a",), held.series)):
        with pytest.raises(InvalidArgument):
            bad()
    with pytest.raises(IndexError):
        held.volume(3)
    with pytest.raises(SpaceMismatch):
        bucket(["a", "b"], a, volume(spark, Space((2, 1, 2)), [1, 2, 3, 4]))
