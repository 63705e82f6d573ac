"""Resampling to other grids, reorientation and block means."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from ..plans.contracts import InvalidArgument
from ..plans.frame import Frame, densified, grid, met
from ..plans.space import Space, axis_codes, codes_to_orientation, orientation, orientation_transform, output_aligned_space, rescale_affine, voxel_sizes


def _source_coords(frame: Frame, target: Space):
    """(v, s0, s1, s2): for each target voxel its place in the source grid."""
    m = frame.space.inverse @ target.matrix
    ijk = target.ijk()
    at = target.xyz(*ijk, m)
    return grid(frame.df.sparkSession, target).select("v", *(F.round(c, 9).alias(f"s{n}") for n, c in enumerate(at)))


def resample(frame: Frame, target: Space, order: int = 1) -> Frame:
    """The frame on another grid: order 0 nearest (halves to even), 1 trilinear, 3 cubic; zero outside the source.

    Cubic: the interpolating spline's coefficients are found along each axis (one group per line), then 64 taps.
    """
    return _interpolated(frame, _source_coords(frame, target.spatial), target.spatial, order)


def _interpolated(frame: Frame, at, target: Space, order: int) -> Frame:
    """Values at places (v, s0, s1, s2) of the source grid, for the voxels of the target."""
    keys = [k for k in frame.keys if k != "v"]
    value = frame.value
    src = frame.space
    if order == 0:
        g = [F.bround(f"s{n}").cast("long") for n in range(3)]
        taps = at.where(src.inside(*g)).select("v", src.index(*g).alias("sv"), F.lit(1.0).alias("w"))
        data = frame.df
    elif order in (1, 3):
        reach = (0, 1) if order == 1 else (-1, 0, 1, 2)
        inside = F.lit(True)
        for n in range(3):
            inside = inside & (F.col(f"s{n}") >= 0) & (F.col(f"s{n}") <= src.dim[n] - 1)
        at = at.where(inside).select("v", *(F.floor(f"s{n}").cast("long").alias(f"g{n}") for n in range(3)), *((F.col(f"s{n}") - F.floor(f"s{n}")).alias(f"f{n}") for n in range(3)))
        taps = at.select("*", F.lit(1.0).alias("w"), F.lit(0).cast("long").alias("sv"))
        stride = 1
        for n in range(3):  # axis by axis, so that taps of no weight are gone before the next one multiplies them
            taps = taps.select("*", F.explode(F.sequence(F.lit(reach[0]), F.lit(reach[-1]))).alias("o"))
            d = F.abs(F.col(f"f{n}") - F.col("o"))
            w = (1 - d) if order == 1 else F.when(d < 1, 2 / 3 - d * d + d * d * d / 2).when(d < 2, (2 - d) * (2 - d) * (2 - d) / 6).otherwise(0.0)
            p = F.col(f"g{n}") + F.col("o")
            if order == 3:  # mirror about the outer cells' centres, as the coefficients do
                last = max(1, src.dim[n] - 1)
                m = F.pmod(p, F.lit(2 * last))
                p = F.when(m <= last, m).otherwise(2 * last - m) if src.dim[n] > 1 else F.lit(0)
            kept = [c for c in taps.columns if c not in (f"g{n}", f"f{n}", "w", "sv", "o")]
            taps = taps.select(*kept, "sv", "w", w.alias("_w"), p.cast("long").alias("_p")).where(f"_w <> 0 and _p between 0 and {src.dim[n] - 1}")
            taps = taps.select(*kept, (F.col("w") * F.col("_w")).alias("w"), (F.col("sv") + F.col("_p") * F.lit(stride)).alias("sv"))
            stride *= src.dim[n]
        data = frame.df if order == 1 else _spline(frame)
    else:
        raise InvalidArgument("order must be 0, 1 or 3")
    got = taps.join(met(data.withColumnRenamed("v", "sv")), "sv").groupBy("v", *keys).agg(F.sum(F.col("w") * F.col(value)).alias(value))
    space = target if frame.kind != "series" else target.add_dim(src.dim[3], src.spacing[3])
    out = Frame(got.select(*frame.keys, value), space, frame.kind, True, None)
    return densified(out) if frame.kind == "volume" and not frame.sparse else out


#: The spline's coefficients are sums over so many cells on either side, the rest is below the precision of doubles: POLE ** REACH is 5e-19.
POLE, REACH = 3**0.5 - 2, 32
#: A task solves pieces of about so many cells together, of as many lines as there are in them or of a part of a line.
PIECE = 1 << 15


def _spline(frame: Frame, piece: int = PIECE):
    """Coefficients of the interpolating cubic B-spline, mirrored at the ends, along each axis.

    The inverse of the filter (1/6, 4/6, 1/6) is sqrt(3) * POLE ** |d|. Lines come in pieces; those of a long line hold the
    REACH cells beyond both ends too, so that a piece's size does not depend on the line's.
    """
    import pyarrow as pa

    frame = densified(frame)
    value, keys = frame.value, list(frame.keys)
    piece = max(piece, REACH)
    weights = [3**0.5 * POLE ** abs(d) for d in range(-REACH, REACH + 1)]
    df = frame.df.select(*keys, F.col(value).cast("double").alias(value))
    kind = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    for axis in range(3):
        n = frame.space.dim[axis]
        if n == 1:
            continue
        stride = int(np.prod(frame.space.dim[:axis], dtype=np.int64))
        lines = max(1, piece // n)

        def run(t):
            line, p, x = (t.column(c).to_numpy() for c in ("_line", "_p", "_x"))
            first = int(p.min())
            held = np.zeros((lines, int(p.max()) - first + 1))
            held[line, p - first] = x
            at = np.abs(np.arange(-REACH, held.shape[1] + REACH) + first) % (2 * (n - 1))
            at = np.clip(np.where(at < n, at, 2 * (n - 1) - at) - first, 0, held.shape[1] - 1)  # clipped: only for cells of other pieces
            wide = held[:, at]
            out = sum(w * wide[:, d : d + held.shape[1]] for d, w in enumerate(weights))
            own = t.column("_own").to_numpy()
            kept = t.filter(pa.array(own))
            return pa.table([*(kept.column(k) for k in keys), pa.array(out[line, p - first][own])], names=[*keys, value])

        place = frame.space.ijk()[axis].cast("long")
        line = F.floor(F.col("v") / (stride * n)) * stride + F.col("v") % stride
        rows = df.select(*keys, F.col(value).alias("_x"), place.alias("_p"), (line % lines).alias("_line"), F.floor(line / lines).alias("_lines"))
        if n > piece:
            last = (n - 1) // piece
            pieces = F.sequence(F.greatest(F.floor((F.col("_p") - REACH) / piece), F.lit(0)), F.least(F.floor((F.col("_p") + REACH) / piece), F.lit(last)))
            rows = rows.withColumn("_piece", F.explode(pieces)).withColumn("_own", F.floor(F.col("_p") / piece) == F.col("_piece"))
        else:
            rows = rows.withColumns({"_piece": F.lit(0), "_own": F.lit(True)})
        df = rows.groupBy("_lines", "_piece", *[k for k in keys if k != "v"]).applyInArrow(run, kind)
    return df


def resample_labels(frame: Frame, target: Space) -> Frame:
    out = resample(Frame(frame.df.select("v", F.col("label").cast("double").alias("value")), frame.space, "volume", True), target, 0)
    return Frame(out.df.select("v", F.col("value").cast("int").alias("label")), target.spatial, "labels", True)


def reorient(frame: Frame, codes) -> Frame:
    """The same image with axes along the given codes, e.g. ('R', 'A', 'S'): flips and permutations only."""
    ornt = orientation_transform(orientation(frame.space.matrix), codes_to_orientation(codes))
    dim = frame.space.dim
    i = frame.space.ijk()
    new: list = [None] * 3
    new_dim = [0] * 3
    m = np.zeros((4, 4))
    m[3, 3] = 1
    for axis, (to, direction) in enumerate(ornt):
        to = int(to)
        new[to] = i[axis] if direction > 0 else dim[axis] - 1 - i[axis]
        new_dim[to] = dim[axis]
        m[axis, to] = direction
        m[axis, 3] = 0 if direction > 0 else dim[axis] - 1
    space = frame.space.spatial.with_trans(frame.space.matrix @ m, new_dim)
    if frame.kind == "series":
        space = space.add_dim(dim[3], frame.space.spacing[3])
    df = frame.df.withColumn("v", space.index(*(c.cast("long") for c in new)))
    return frame.like(df, space=space)


def as_canonical(frame: Frame) -> Frame:
    return reorient(frame, ("R", "A", "S"))


def codes(frame: Frame) -> tuple[str, ...]:
    return axis_codes(frame.space.matrix)


def downsample(frame: Frame, factor: int) -> Frame:
    """Means of blocks of ``factor`` voxels along each axis, the field of view kept; incomplete blocks at the ends are left out."""
    dim = tuple(max(1, d // factor) for d in frame.space.dim[:3])
    size = tuple(min(factor, d) for d in frame.space.dim[:3])
    i, j, k = (F.floor(c / s) for c, s in zip(frame.space.ijk(), size))
    m = rescale_affine(frame.space.matrix, tuple(d * s for d, s in zip(dim, size)), voxel_sizes(frame.space.matrix) * np.array(size), dim)
    space = frame.space.spatial.with_trans(m, dim)
    cells = int(np.prod(size))
    df = frame.df.where(space.inside(i, j, k)).withColumn("v", space.index(i.cast("long"), j, k))
    total = F.sum(frame.value) / cells if frame.sparse else F.avg(frame.value)
    df = df.groupBy(*frame.keys).agg(total.alias(frame.value))
    if frame.kind == "series":
        space = space.add_dim(frame.space.dim[3], frame.space.spacing[3])
    return frame.like(df, space=space)


def downsampled_dim(space: Space, factor=None, spacing=None, outdim=None) -> tuple[int, int, int]:
    """The grid that one of these asks for: a ratio up to 1 or whole block sizes, voxel sizes in mm, or the dimensions."""
    dim = np.array(space.dim[:3])
    if sum(x is not None for x in (factor, spacing, outdim)) != 1:
        raise InvalidArgument("exactly one of factor, spacing and outdim")
    asked = np.array(next(x for x in (factor, spacing, outdim) if x is not None), float)
    if asked.ndim and asked.shape != (3,) or (outdim is not None and not asked.ndim):
        raise InvalidArgument("a number, or one for each axis; three dimensions")
    asked = np.broadcast_to(asked, 3)
    if not (np.isfinite(asked) & (asked > 0)).all():
        raise InvalidArgument("positive numbers")
    if spacing is not None:
        out = dim * voxel_sizes(space.matrix) / asked
    elif outdim is not None:
        out = asked
    elif (asked <= 1).all():
        out = dim * asked
    elif np.allclose(asked, np.rint(asked)):
        out = dim / np.rint(asked)
    else:
        raise InvalidArgument("factors over 1 are whole block sizes")
    out = np.floor(out + 1e-9).astype(int)
    if (out < 1).any() or (out > dim).any():
        raise InvalidArgument(f"a grid of {tuple(out)} of one of {tuple(dim)}")
    return tuple(int(n) for n in out)


def downsample_to(frame: Frame, factor=None, spacing=None, outdim=None) -> Frame:
    """The frame on a coarser grid with the same field of view: means of blocks where all sides are whole multiples, else
    linear between the voxels, first on first and last on last (``downsample`` leaves incomplete blocks out instead).

    One of ``factor``, ``spacing`` and ``outdim``, see ``downsampled_dim``. Of a series, each time. What a sparse frame lacks is zero.
    """
    src = frame.space
    dim = downsampled_dim(src, factor, spacing, outdim)
    ratio = np.array(src.dim[:3]) / np.array(dim)
    matrix = rescale_affine(src.matrix, src.dim[:3], voxel_sizes(src.matrix) * ratio, dim)
    space = src.spatial.with_trans(matrix, dim)
    if np.allclose(ratio, np.rint(ratio)):
        sides = [int(round(x)) for x in ratio]
        to = space.index(*(F.floor(c / s).cast("long") for c, s in zip(src.ijk(), sides)))
        df = frame.df.withColumn("v", to).groupBy(*frame.keys).agg((F.sum(frame.value) / int(np.prod(sides))).alias(frame.value))
        return frame.like(df, space=space if frame.kind != "series" else space.add_dim(src.dim[3], src.spacing[3]))
    step = [(n - 1) / (m - 1) if m > 1 else 0.0 for n, m in zip(src.dim[:3], dim)]
    at = grid(frame.df.sparkSession, space).select("v", *(F.round(c * s, 9).alias(f"s{n}") for n, (c, s) in enumerate(zip(space.ijk(), step))))
    return _interpolated(frame, at, space, 1)


def deoblique(frame: Frame) -> Frame:
    return resample(frame, output_aligned_space(frame.space), 1)
