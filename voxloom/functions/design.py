"""Design vectors and synthetic series: haemodynamic response, weights, confounds, simulated data."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.contracts import InvalidArgument
from ..plans.frame import Frame, grid
from ..plans.space import Space

#: Lobes of the response: shape of a gamma density, and what it is multiplied by.
LOBES = ((6.0, 1.0), (16.0, -0.167))
#: Weights of time t of n by kind, before they are divided by their sum.
WEIGHTS = {
    "uniform": lambda t, n, decay: t * 0.0 + 1.0,
    "linear": lambda t, n, decay: t / max(1, n - 1) + (n == 1),
    "exponential": lambda t, n, decay: 1.0 / np.exp(decay * t),
}


def response(t: Column, lobes=LOBES) -> Column:
    """The haemodynamic response at ``t`` seconds, not scaled: a sum of gamma densities, 0 up to 0."""
    parts = (F.exp((shape - 1) * F.log(t) - t - math.lgamma(shape)) * amplitude for shape, amplitude in lobes)
    return F.when(t > 0, sum(parts, F.lit(0.0))).otherwise(0.0)


def hemodynamic_response(t, lobes=LOBES) -> np.ndarray:
    """``response`` at many times, for short vectors on the driver, scaled to a maximum of 1 if it has one over 0."""
    t = np.asarray(t, float)
    late = np.maximum(t, np.finfo(float).tiny)
    h = (t > 0) * sum(amplitude * np.exp((shape - 1) * np.log(late) - late - math.lgamma(shape)) for shape, amplitude in lobes)
    return h / max(h.max(initial=0.0), 0.0) if h.max(initial=0.0) > 0 else h


def time_weights(n: int, method: str = "exponential", decay: float = 0.1) -> list[float]:
    """Weights of n times that sum to 1: exp(-decay t), t / (n - 1), or all equal."""
    if n < 1 or method not in WEIGHTS:
        raise InvalidArgument(f"{n} times by {method!r}")
    w = WEIGHTS[method](np.arange(float(n)), n, decay)
    return (w / w.sum()).tolist()


def confounds(motion: DataFrame, derivatives: bool = True, squares: bool = False, time: str = "t", by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Motion columns by time, with first differences (0 at the first time) and the squares of all.

    ``by``: columns that name a series (a subject, a run), each with its own first time; a window is one series. Without
    them all rows are one.
    """
    names = [c for c in motion.columns if c != time and c not in by]
    out = motion
    if derivatives:
        w = Window.partitionBy(*by).orderBy(time) if by else Window.orderBy(time)
        out = out.withColumns({f"{c}_d": F.col(c) - F.coalesce(F.lag(c).over(w), F.col(c)) for c in names})
        names = names + [f"{c}_d" for c in names]
    if squares:
        out = out.withColumns({f"{c}_2": F.col(c) * F.col(c) for c in names})
    return out


def block_signal(times: int, tr: float = 2.0, block: int = 10, length: float = 30.0) -> list[float]:
    """Blocks of ``block`` times, on and off, through ``length`` seconds of the response; from 0 to 1."""
    lags = -(-length // tr)
    stimulus = 1.0 - np.arange(times) // block % 2
    raw = np.convolve(stimulus, hemodynamic_response(np.arange(lags) * tr))[:times]
    span = raw.max() - raw.min()
    return ((raw - raw.min()) / span if span > 0 else raw).tolist()


def simulate(spark: SparkSession, space: Space, times: int, regions: int = 5, noise_sd: float = 1.0, signal_sd: float = 2.0, tr: float = 2.0, seed: int = 0) -> Frame:
    """Normal noise by voxel and time, and in balls about ``regions`` random centres a block design; where balls meet, it adds up.

    Centres keep two voxels from the grid's edges, where it has room; radii are from 1 voxel to under a quarter of the
    shortest side. Noise is a hash of (seed, voxel, time) turned normal: the same however rows are partitioned.
    """
    from ..operators.shapes import normal

    rng = np.random.default_rng(seed)
    dim = space.dim[:3]
    balls = []
    for _ in range(regions):
        room = [min(2, (d - 1) // 2) for d in dim]
        balls.append((*(int(rng.integers(a, d - a)) for a, d in zip(room, dim)), int(rng.integers(1, max(2, min(dim) // 4)))))
    at = space.spatial.ijk()
    covered = F.lit(0)
    for *center, radius in balls:
        far = sum((F.pow(c - F.lit(p), 2) for c, p in zip(at, center)), F.lit(0.0))
        covered = covered + F.when(far <= radius * radius, 1).otherwise(0)
    cells = grid(spark, space.spatial).select("v", covered.alias("covered"), F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("t"))
    shape = F.element_at(F.array(*(F.lit(x * signal_sd) for x in block_signal(times, tr))), F.col("t") + 1)
    noise = normal(seed, F.col("v"), F.col("t")) * noise_sd if noise_sd else F.lit(0.0)
    return Frame(cells.select("v", "t", (noise + F.col("covered") * shape).alias("x")), space.spatial.add_dim(times, tr), "series")
