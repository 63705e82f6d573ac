"""The spatial frame of a grid: frozen driver-side metadata, and column expressions for its index arithmetic.

Voxels are numbered ``v = i + nx * (j + ny * k)``, from 0. World coordinates are ``trans @ (i, j, k, 1)``; world to grid
rounds halves to even.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .contracts import InvalidSpace, OutOfBounds, SpaceMismatch, digest

DEFAULT_AXES = ("R", "A", "S")


def _padded(values, n: int, fill: float, what: str) -> tuple[float, ...]:
    values = tuple(float(x) for x in (values if values is not None else ()))
    if len(values) > n:
        raise InvalidSpace(f"{what} has {len(values)} entries for {n} dimensions")
    return values + (fill,) * (n - len(values))


@dataclass(frozen=True, eq=False)
class Space:
    dim: tuple[int, ...]
    spacing: tuple[float, ...] = None
    origin: tuple[float, ...] = None
    trans: tuple[tuple[float, ...], ...] = None
    axes: tuple[str, ...] = field(default=DEFAULT_AXES)

    def __post_init__(self):
        dim = tuple(int(d) for d in self.dim)
        if not dim or any(d <= 0 for d in dim):
            raise InvalidSpace(f"dimensions must be positive: {dim}")
        spatial = min(3, len(dim))
        if self.trans is not None and self.spacing is None and self.origin is None:
            m = np.array(self.trans, float)
            k = min(spatial, m.shape[0] - 1)
            spacing = tuple(np.sqrt((m[:k, :k] ** 2).sum(0)))
            origin = tuple(m[:k, -1])
        else:
            spacing, origin = self.spacing, self.origin
        spacing = _padded(spacing, len(dim), 1.0, "spacing")
        origin = _padded(origin, len(dim), 0.0, "origin")
        if any(s <= 0 for s in spacing):
            raise InvalidSpace(f"spacing must be positive: {spacing}")
        if self.trans is None:
            m = np.eye(spatial + 1)
            m[range(spatial), range(spatial)] = spacing[:spatial]
            m[:spatial, -1] = origin[:spatial]
        else:
            m = np.array(self.trans, float)
            if m.shape[0] != m.shape[1]:
                raise InvalidSpace("the transform must be square")
            if m.shape[0] > spatial + 1:  # spatial part of a wider one
                m = m[np.ix_([*range(spatial), -1], [*range(spatial), -1])]
        if not np.isfinite(m).all() or abs(np.linalg.det(m)) < 1e-12:
            raise InvalidSpace("the transform must be invertible")
        for name, value in (("dim", dim), ("spacing", spacing), ("origin", origin), ("trans", tuple(map(tuple, m.tolist()))), ("axes", tuple(self.axes))):
            object.__setattr__(self, name, value)

    # --- identity

    def __eq__(self, other) -> bool:
        return isinstance(other, Space) and (self.dim, self.spacing, self.origin, self.trans) == (other.dim, other.spacing, other.origin, other.trans)

    def __hash__(self) -> int:
        return hash((self.dim, self.spacing, self.origin, self.trans))

    @property
    def hash(self) -> str:
        return digest(self.dim[:3], self.trans)

    def compatible_with(self, other: Space, atol: float = 1e-6) -> bool:
        """True, or SpaceMismatch: spatial dimensions equal, transforms close."""
        if self.dim[:3] != other.dim[:3]:
            raise SpaceMismatch(f"dimensions differ: {self.dim[:3]} and {other.dim[:3]}")
        if not np.allclose(self.trans, other.trans, atol=atol):
            raise SpaceMismatch("transforms differ")
        return True

    # --- sizes

    @property
    def ndim(self) -> int:
        return len(self.dim)

    @property
    def matrix(self) -> np.ndarray:
        return np.array(self.trans)

    @property
    def inverse(self) -> np.ndarray:
        return np.linalg.inv(self.matrix)

    @property
    def nvox(self) -> int:
        return int(np.prod(self.dim[:3]))

    @property
    def spatial(self) -> Space:
        return Space(self.dim[:3], self.spacing[:3], self.origin[:3], self.trans, self.axes)

    def dim_of(self, axis: str) -> int:
        return self.dim[self.which_dim(axis)]

    def which_dim(self, axis: str) -> int:
        opposite = dict(zip("LRPAIS", "RLAPSI"))
        for k, a in enumerate(self.axes):
            if axis in (a, opposite.get(a)):
                return k
        raise InvalidSpace(f"no axis {axis} among {self.axes}")

    def drop_dim(self, k: int | None = None) -> Space:
        k = self.ndim - 1 if k is None else k
        keep = [i for i in range(self.ndim) if i != k]
        if k >= 3:
            return Space(tuple(self.dim[i] for i in keep), tuple(self.spacing[i] for i in keep), tuple(self.origin[i] for i in keep), self.trans, self.axes)
        return Space(tuple(self.dim[i] for i in keep), tuple(self.spacing[i] for i in keep), tuple(self.origin[i] for i in keep), None, tuple(a for i, a in enumerate(self.axes) if i != k))

    def add_dim(self, n: int, spacing: float = 1.0) -> Space:
        return Space((*self.dim, n), (*self.spacing, spacing), (*self.origin, 0.0), self.trans, self.axes)

    def bounds(self) -> np.ndarray:
        """World coordinates of the first and of the last voxel, in rows."""
        return self.grid_to_world([(0,) * len(self.dim[:3]), tuple(d - 1 for d in self.dim[:3])])

    def centroid(self) -> np.ndarray:
        return self.grid_to_world([tuple((d - 1) / 2 for d in self.dim[:3])])[0]

    # --- driver-side coordinates

    def grid_to_world(self, grid) -> np.ndarray:
        g = np.atleast_2d(np.asarray(grid, float))
        return (np.c_[g, np.ones(len(g))] @ self.matrix.T)[:, :-1]

    def world_to_grid(self, world, rounded: bool = True) -> np.ndarray:
        w = np.atleast_2d(np.asarray(world, float))
        g = (np.c_[w, np.ones(len(w))] @ self.inverse.T)[:, :-1]
        return np.round(g).astype(np.int64) if rounded else g

    def grid_to_grid(self, grid, target: Space) -> np.ndarray:
        return target.world_to_grid(self.grid_to_world(grid), rounded=False)

    def grid_to_index(self, grid) -> np.ndarray:
        g = np.atleast_2d(np.asarray(grid, np.int64))
        if (g < 0).any() or (g >= np.array(self.dim[: g.shape[1]])).any():
            raise OutOfBounds("a grid coordinate is outside the space")
        return g @ np.cumprod([1, *self.dim[: g.shape[1] - 1]])

    def index_to_grid(self, index) -> np.ndarray:
        v = np.atleast_1d(np.asarray(index, np.int64))
        if (v < 0).any() or (v >= self.nvox).any():
            raise OutOfBounds("an index is outside the space")
        out = []
        for d in self.dim[:3]:
            out.append(v % d)
            v = v // d
        return np.stack(out, 1)

    def index_to_world(self, index) -> np.ndarray:
        return self.grid_to_world(self.index_to_grid(index))

    def world_to_index(self, world) -> np.ndarray:
        return self.grid_to_index(self.world_to_grid(world))

    # --- column expressions

    def ijk(self, v: Column | str = "v") -> tuple[Column, Column, Column]:
        v = F.col(v) if isinstance(v, str) else v
        nx, ny = self.dim[0], self.dim[1] if self.ndim > 1 else 1
        return v % nx, F.floor(v / nx) % ny, F.floor(v / (nx * ny))

    def index(self, i: Column, j: Column, k: Column) -> Column:
        return (i + self.dim[0] * (j + self.dim[1] * k)).cast("long")

    def inside(self, i: Column, j: Column, k: Column) -> Column:
        nx, ny, nz = self.dim[:3]
        return (i >= 0) & (i < nx) & (j >= 0) & (j < ny) & (k >= 0) & (k < nz)

    def xyz(self, i: Column, j: Column, k: Column, m: np.ndarray | None = None) -> tuple[Column, ...]:
        m = self.matrix if m is None else m
        return tuple(i * float(r[0]) + j * float(r[1]) + k * float(r[2]) + float(r[3]) for r in m[:3])

    def with_trans(self, trans, dim=None) -> Space:
        return replace(self, dim=tuple(dim or self.dim), spacing=None, origin=None, trans=tuple(map(tuple, np.array(trans).tolist())))


# --- axes and orientation -------------------------------------------------------------------------

_POSITIVE = ("R", "A", "S")
_NEGATIVE = ("L", "P", "I")


def orientation(affine) -> np.ndarray:
    """(input axis -> output axis, direction) rows: each axis goes to the world axis it follows most, no axis twice."""
    m = np.array(affine, float)[:3, :3]
    scale = np.sqrt((m**2).sum(0))
    r = m / np.where(scale == 0, 1, scale)
    u, _, vt = np.linalg.svd(r)
    r = u @ vt
    out = np.full((3, 2), np.nan)
    free = set(range(3))
    for axis in np.argsort(-np.abs(r).max(0), kind="stable"):
        best = max(free, key=lambda a: abs(r[a, axis]))
        free.remove(best)
        out[axis] = best, -1 if r[best, axis] < 0 else 1
    return out


def axis_codes(affine) -> tuple[str, ...]:
    return tuple((_POSITIVE if d > 0 else _NEGATIVE)[int(a)] for a, d in orientation(affine))


def codes_to_orientation(codes) -> np.ndarray:
    out = []
    for c in codes:
        if c in _POSITIVE:
            out.append((_POSITIVE.index(c), 1))
        elif c in _NEGATIVE:
            out.append((_NEGATIVE.index(c), -1))
        else:
            raise InvalidSpace(f"no axis code {c!r}")
    return np.array(out, float)


def orientation_transform(start, end) -> np.ndarray:
    """For each axis of ``start`` the axis of ``end`` and the direction that lead to it."""
    out = np.empty((3, 2))
    for k, (axis, direction) in enumerate(np.asarray(start)):
        to = int(np.flatnonzero(np.asarray(end)[:, 0] == axis)[0])
        out[k] = to, direction * np.asarray(end)[to, 1]
    return out


def voxel_sizes(affine) -> np.ndarray:
    return np.sqrt((np.array(affine, float)[:-1, :-1] ** 2).sum(0))


def obliquity(affine) -> np.ndarray:
    """Degrees between each voxel axis and the world axis nearest to it."""
    m = np.array(affine, float)[:3, :3]
    return np.degrees(np.arccos(np.clip(np.abs(m / voxel_sizes(affine)).max(0), -1, 1)))


def rescale_affine(affine, shape, sizes, new_shape=None) -> np.ndarray:
    """The affine of other voxel sizes (and shape) with the same centre of the field of view."""
    m = np.array(affine, float)
    shape = np.array(shape[:3])
    new_shape = shape if new_shape is None else np.array(new_shape[:3])
    out = m.copy()
    out[:3, :3] = m[:3, :3] / voxel_sizes(m) * np.asarray(sizes, float)
    out[:3, 3] = m[:3, :3] @ ((shape - 1) / 2) + m[:3, 3] - out[:3, :3] @ ((new_shape - 1) / 2)
    return out


def output_aligned_space(space: Space, sizes=None) -> Space:
    """The axis-aligned box around a space's corners."""
    from itertools import product

    corners = space.grid_to_world(list(product(*((0, d - 1) for d in space.dim[:3]))))
    sizes = np.asarray(sizes if sizes is not None else [min(voxel_sizes(space.matrix))] * 3, float)
    lo, hi = corners.min(0), corners.max(0)
    return Space(tuple((np.ceil((hi - lo) / sizes) + 1).astype(int)), tuple(sizes), tuple(lo))


def slice_affine(index: int, axis: int) -> np.ndarray:
    """4 x 3: coordinates in a slice (0-based, axis 0 to 2) to coordinates in its volume."""
    out = np.zeros((4, 3))
    for column, row in enumerate(a for a in range(3) if a != axis):
        out[row, column] = 1
    out[axis, 2], out[3, 2] = index, 1
    return out


def matrix_to_quaternion(m) -> tuple[float, float, float, float, np.ndarray]:
    """(b, c, d, qfac, sizes) of a 4 x 4 transform, the quaternion's a >= 0."""
    m = np.array(m, float)[:3, :3]
    sizes = np.sqrt((m**2).sum(0))
    u, _, vt = np.linalg.svd(m / sizes)
    r = u @ vt
    qfac = 1.0
    if np.linalg.det(r) < 0:
        r, qfac = r * np.array([1, 1, -1]), -1.0
    k = np.array([
        [r[0, 0] - r[1, 1] - r[2, 2], 0, 0, 0],
        [r[0, 1] + r[1, 0], r[1, 1] - r[0, 0] - r[2, 2], 0, 0],
        [r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], r[2, 2] - r[0, 0] - r[1, 1], 0],
        [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], np.trace(r)],
    ]) / 3
    w, vectors = np.linalg.eigh(k)
    b, c, d, a = vectors[:, np.argmax(w)]
    sign = -1.0 if a < 0 else 1.0
    return sign * b, sign * c, sign * d, qfac, sizes


def quaternion_to_matrix(b, c, d, qfac=1.0, sizes=(1, 1, 1), offset=(0, 0, 0)) -> np.ndarray:
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    out = np.eye(4)
    out[:3, :3] = np.array([
        [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
        [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
        [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
    ]) * np.asarray(sizes) * np.array([1, 1, qfac or 1.0])
    out[:3, 3] = offset
    return out
