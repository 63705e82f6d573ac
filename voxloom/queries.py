"""Registered queries of the operators, each with the same computation in SQL where SQL can express it.

Figures are rounded to 6 digits on both sides: sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunks, cluster, contour, elementwise, neighbor, quantile, reduce, resample, select, shapes
from .plans import fixtures as fx
from .plans.frame import Frame, densified, shared_folder
from .plans.space import Space

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) + F.lit(0.0) for n in names})


def lattice(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


BOLD = "bold AS (SELECT vec_id AS v, generate_subscripts(embedding, 1) - 1 AS t, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
ATLAS = "atlas AS (SELECT vec_id AS v, label + 1 AS label FROM embeddings)"
BDIM = "bdim AS (SELECT CAST(ceil((max(vec_id) + 1) / 64.0) AS BIGINT) AS nz FROM embeddings)"
VOL = "vol AS (SELECT p_partkey AS v, p_retailprice AS value FROM part)"
VDIM = "vdim AS (SELECT CAST(ceil((max(p_partkey) + 1) / 100.0) AS BIGINT) AS nz FROM part)"
MASK = "mask AS (SELECT p_partkey AS v FROM part WHERE p_size > 20)"
SIZES = "vol AS (SELECT p_partkey AS v, CAST(p_size AS DOUBLE) AS value FROM part)"
DENSE = "dense AS (SELECT g.v, coalesce(vol.value, 0.0) AS value FROM (SELECT unnest(range(0, nz * 100)) AS v FROM vdim) g LEFT JOIN vol ON g.v = vol.v)"
COUNTS = "counts AS (SELECT l_partkey AS v, l_linenumber - 1 AS t, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2)"
HYPER = "hyper AS (SELECT user_id AS v, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS f, avg(value) AS x FROM events GROUP BY 1, 2, 3)"
VIJK = "CAST(v % 10 AS BIGINT) AS i, CAST((v // 10) % 10 AS BIGINT) AS j, CAST(v // 100 AS BIGINT) AS k"


def w(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def R(expr: str, name: str) -> str:  # noqa: N802
    return f"round({expr}, 6) + 0.0 AS {name}"


def near(reach: int, where: str) -> str:
    """Offsets of a box that fit a predicate, as a CTE."""
    return f"o AS (SELECT a.d AS dx, b.d AS dy, c.d AS dz FROM (SELECT unnest(range({-reach}, {reach + 1})) AS d) a, (SELECT unnest(range({-reach}, {reach + 1})) AS d) b, (SELECT unnest(range({-reach}, {reach + 1})) AS d) c WHERE {where})"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    import uuid

    from .sources.images import filesystem

    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"
    store, inner = filesystem(path)
    store.create_dir(inner.rpartition("/")[0])
    return path


def mask_of(spark: SparkSession, sf_dir: str) -> Frame:
    sizes = fx.volume(spark, sf_dir, "p_size")
    return sizes.like(sizes.df.where("value > 20").select("v", F.lit(True).alias("value")), sparse=True)


# --- selection ------------------------------------------------------------------------------------


@query(w(BOLD) + "SELECT CAST(q.ord AS INT) AS ord, t.t AS t, coalesce(x, 0.0) AS x FROM (VALUES (0, 5), (1, 2), (2, 5), (3, 100)) q(ord, v), (SELECT unnest(range(0, 64)) AS t) t LEFT JOIN bold ON bold.v = q.v AND bold.t = t.t")
def series_at(spark, sf_dir):
    return lattice(select.series_at(fx.bold(spark, sf_dir), [5, 2, 5, 100]), "t")


@query(w(BOLD) + "SELECT t, avg(coalesce(x, 0.0)) AS x FROM (SELECT unnest(range(0, 64)) AS t) t LEFT JOIN (SELECT * FROM bold WHERE v = 3 + 8 * (4 + 8 * 2)) b USING (t) GROUP BY t")
def series_at_world(spark, sf_dir):
    return lattice(select.series_at_world(fx.bold(spark, sf_dir), [(6.4, 7.7, 5.9)]).select("t", "x"), "t")


@query(w(BOLD, near(3, "4 * (dx * dx + dy * dy) + 9 * dz * dz <= 36")) + f", r AS (SELECT 4 + dx AS i, 4 + dy AS j, 3 + dz AS k FROM o), g AS (SELECT i + 8 * (j + 8 * k) AS v FROM r, (SELECT ceil((max(vec_id) + 1) / 64.0) AS nz FROM embeddings) WHERE i BETWEEN 0 AND 7 AND j BETWEEN 0 AND 7 AND k BETWEEN 0 AND nz - 1) SELECT t.t AS t, {R('avg(coalesce(x, 0.0))', 'x')}, count(*) AS n FROM g CROSS JOIN (SELECT unnest(range(0, 64)) AS t) t LEFT JOIN bold ON bold.v = g.v AND bold.t = t.t GROUP BY t.t")
def seed_sphere_mean(spark, sf_dir):
    """The mean series of a 6 mm ball: a scenario of region extraction."""
    bold = fx.bold(spark, sf_dir)
    ball = neighbor.spherical_roi(spark, bold.space, (4, 4, 3), 6.0)
    rows = select.series_roi(bold, ball).groupBy("t").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return lattice(r6(rows, "x"), "t")


@query(w(VOL) + "SELECT 4 - abs(i - 5) - abs(j - 5) AS d, count(*) AS n, round(avg(value), 6) + 0.0 AS value FROM (SELECT value, CAST(v % 10 AS BIGINT) AS i, CAST((v // 10) % 10 AS BIGINT) AS j, v // 100 AS k FROM vol) WHERE i BETWEEN 3 AND 7 AND j BETWEEN 3 AND 7 AND k BETWEEN 0 AND 1 GROUP BY 1")
def cuboid_roi(spark, sf_dir):
    vol = fx.volume(spark, sf_dir)
    box = neighbor.cuboid_roi(spark, vol.space, (5, 5, 0), (2, 2, 1))
    got = select.values_roi(vol, box)
    i, j, _ = vol.space.ijk()
    return r6(got.groupBy((4 - F.abs(i - 5) - F.abs(j - 5)).alias("d")).agg(F.count("*").alias("n"), F.avg("value").alias("value")), "value")


@query(w(VOL, near(3, "(dx / 3.0) ** 2 + (dy / 2.0) ** 2 + (dz / 1.0) ** 2 <= 1")) + "SELECT 5 + dx + 10 * (5 + dy + 10 * (1 + dz)) AS v, coalesce(value, 0.0) AS value FROM o LEFT JOIN vol ON vol.v = 5 + dx + 10 * (5 + dy + 10 * (1 + dz)) WHERE 1 + dz BETWEEN 0 AND (SELECT ceil((max(p_partkey) + 1) / 100.0) - 1 FROM part)")
def ellipsoid_roi(spark, sf_dir):
    vol = fx.volume(spark, sf_dir)
    return select.values_roi(vol, neighbor.ellipsoid_roi(spark, vol.space, (5, 5, 1), (3.0, 2.0, 1.0))).select("v", "value")


@query(w(VOL) + "SELECT CAST(q.ord AS INT) AS ord, coalesce(value, 0.0) AS value FROM (VALUES (0, 7), (1, 0), (2, 7), (3, 55)) q(ord, v) LEFT JOIN vol USING (v)")
def linear_access(spark, sf_dir):
    return select.volume_values_at(fx.volume(spark, sf_dir), [7, 0, 7, 55])


@query(w(BOLD) + "SELECT CAST(r.n AS INT) AS row, CAST(c.n AS INT) AS col, x FROM (VALUES (0, 3), (1, 60)) r(n, t), (VALUES (0, 11), (1, 4), (2, 11)) c(n, v), bold WHERE bold.t = r.t AND bold.v = c.v")
def matrix_access(spark, sf_dir):
    return select.matrix_access(fx.bold(spark, sf_dir), [3, 60], [11, 4, 11])


@query(w(BOLD) + "SELECT v, CAST((t - 8) / 4 AS BIGINT) AS t, x FROM bold WHERE t >= 8 AND t < 40 AND (t - 8) % 4 = 0")
def time_slice(spark, sf_dir):
    return lattice(select.time_slice(fx.bold(spark, sf_dir), 8, 40, 4).df, "t")


@query(w(BOLD) + "SELECT v, CAST(q.n AS BIGINT) AS t, x FROM bold JOIN (VALUES (0, 9), (1, 1), (2, 9)) q(n, t) USING (t)")
def sub_vector(spark, sf_dir):
    return lattice(select.sub_vector(fx.bold(spark, sf_dir), [9, 1, 9]).df, "t")


@query(w(BOLD) + "SELECT v, x AS value FROM bold WHERE t = 10")
def volume_at(spark, sf_dir):
    return select.volume_at(fx.bold(spark, sf_dir), 10).df


@query(w(BOLD) + f"SELECT t, {R('sum(x)', 'total')}, {R('sum(x * v)', 'weighted')}, count(*) AS n FROM bold GROUP BY t")
def matrix_round_trip(spark, sf_dir):
    """A series as rows of a matrix and back, summed by time."""
    back = select.from_matrix(select.to_matrix(fx.bold(spark, sf_dir)))
    return lattice(r6(back.groupBy("t").agg(F.sum("x").alias("total"), F.sum(F.col("x") * F.col("v")).alias("weighted"), F.count("*").alias("n")), "total", "weighted"), "t")


@query(w(VOL) + f"SELECT CAST(v % 10 AS BIGINT) AS a, CAST((v // 10) % 10 AS BIGINT) AS b, value FROM vol WHERE v // 100 = 1")
def orthogonal_slice(spark, sf_dir):
    return lattice(select.orthogonal_slice(fx.volume(spark, sf_dir), (3.0, 3.0, 3.9), 2), "a", "b")


@query(w(VOL) + "SELECT v, (v % 10) * 2.0 AS x, ((v // 10) % 10) * 2.0 AS y, (v // 100) * 2.0 AS z FROM vol")
def world_coordinates(spark, sf_dir):
    return select.coordinates(fx.volume(spark, sf_dir), real=True)


@query(w(VOL, MASK) + "SELECT v, CASE WHEN m.v IS NULL THEN 0.0 ELSE value END AS value FROM vol LEFT JOIN mask m USING (v)".replace("m.v IS NULL", "m.one IS NULL").replace("mask m", "(SELECT v, 1 AS one FROM mask) m"))
def apply_mask(spark, sf_dir):
    return select.apply_mask(fx.volume(spark, sf_dir), mask_of(spark, sf_dir)).df


@query(w(VOL) + "SELECT v, CASE WHEN v % 7 = 0 THEN -1.0 ELSE value END AS value FROM vol")
def functional_update(spark, sf_dir):
    vol = fx.volume(spark, sf_dir)
    return select.updated(vol, vol.df.where("v % 7 = 0").withColumn("value", F.lit(-1.0))).df.where("v is not null")


@query(w(VOL, VDIM, DENSE) + "SELECT count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM dense")
def densify(spark, sf_dir):
    return r6(densified(fx.volume(spark, sf_dir)).df.agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")


@query(w(COUNTS) + "SELECT v, CAST(t AS BIGINT) AS t, x FROM counts WHERE v IN (SELECT v FROM counts WHERE x <> 0)")
def sparsify(spark, sf_dir):
    from .plans.frame import sparsified

    return lattice(sparsified(fx.counts(spark, sf_dir)).df, "t")


# --- elementwise ----------------------------------------------------------------------------------


@query(w(BOLD) + f", m AS (SELECT v, avg(x) AS value FROM bold GROUP BY v) SELECT v, t, {R('x * 2 - value', 'x')} FROM bold JOIN m USING (v)")
def series_volume_arithmetic(spark, sf_dir):
    bold = fx.bold(spark, sf_dir)
    mean = Frame(reduce.mean_over_time(bold).df, bold.space.spatial, "volume", False)
    full = bold.like(bold.df, sparse=False)
    out = elementwise.arithmetic(elementwise.arithmetic(full, 2.0, "*"), mean, "-")
    return lattice(r6(out.df, "x"), "t")


@query(w(VOL, VDIM) + ", a AS (SELECT v, value FROM vol WHERE v % 2 = 0), b AS (SELECT v, value FROM vol WHERE v % 3 = 0) SELECT v, round(coalesce(a.value, 0.0) - coalesce(b.value, 0.0), 6) + 0.0 AS value FROM a FULL JOIN b USING (v)")
def sparse_arithmetic(spark, sf_dir):
    vol = fx.volume(spark, sf_dir)
    a, b = (vol.like(vol.df.where(f"v % {n} = 0"), sparse=True) for n in (2, 3))
    return r6(elementwise.arithmetic(a, b, "-").df, "value")


@query(w(VOL) + ", z AS (SELECT v, value, (v % 5)::DOUBLE AS d FROM vol) SELECT CASE WHEN d = 0 THEN 'inf' ELSE 'finite' END AS kind, count(*) AS n, round(sum(CASE WHEN d <> 0 THEN value / d END), 4) + 0.0 AS total FROM z GROUP BY 1")
def ieee_division(spark, sf_dir):
    vol = fx.volume(spark, sf_dir)
    vol = vol.like(vol.df, sparse=False)
    d = vol.like(vol.df.withColumn("value", (F.col("v") % 5).cast("double")))
    x = elementwise.arithmetic(vol, d, "/").df
    kind = F.when(F.col("value") == float("inf"), "inf").otherwise("finite")
    got = x.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("value") < float("inf"), F.col("value"))).alias("total"))
    return got.withColumn("total", F.round("total", 4) + 0.0)


@query(w(SIZES) + "SELECT v % 10 AS i, count(*) AS n FROM vol WHERE value > 20 GROUP BY 1")
def comparison_mask(spark, sf_dir):
    mask = elementwise.compare(fx.volume(spark, sf_dir, "p_size"), 20.0, ">")
    return mask.df.where("value").groupBy((F.col("v") % 10).alias("i")).agg(F.count("*").alias("n"))


@query(w(VOL) + ", a AS (SELECT v FROM vol WHERE v % 2 = 0), b AS (SELECT v FROM vol WHERE v % 3 = 0) SELECT 'and' AS op, count(*) AS n, sum(v)::BIGINT AS s FROM a JOIN b USING (v) UNION ALL SELECT 'or', count(*), sum(v)::BIGINT FROM (SELECT v FROM a UNION SELECT v FROM b) UNION ALL SELECT 'xor', count(*), sum(v)::BIGINT FROM vol WHERE (v % 2 = 0) <> (v % 3 = 0)")
def mask_algebra(spark, sf_dir):
    vol = fx.volume(spark, sf_dir)
    a, b = (vol.like(vol.df.where(f"v % {n} = 0").withColumn("value", F.lit(True)), sparse=True) for n in (2, 3))
    out = None
    for op in ("and", "or", "xor"):
        part = elementwise.mask_algebra(a, b, op).df.agg(F.lit(op).alias("op"), F.count("*").alias("n"), F.sum("v").alias("s"))
        out = part if out is None else out.union(part)
    return out


@query(w(VOL, VDIM, MASK) + "SELECT g.v FROM (SELECT unnest(range(0, nz * 100)) AS v FROM vdim) g WHERE g.v NOT IN (SELECT v FROM mask)")
def mask_complement(spark, sf_dir):
    return elementwise.mask_not(mask_of(spark, sf_dir)).df.select("v")


@query("SELECT vec_id AS v, CASE label + 1 WHEN 1 THEN 2.0 WHEN 2 THEN 1.0 WHEN 5 THEN 50.0 ELSE (label + 1)::DOUBLE END AS label FROM embeddings")
def map_values(spark, sf_dir):
    return elementwise.map_values(fx.atlas(spark, sf_dir), {1: 2, 2: 1, 5: 50}).df


@query(w(VOL) + f"SELECT v, {R('ln((value - 900) * 0.5 + 900 + 1) / ln(10)', 'value')} FROM vol WHERE (value - 900) * 0.5 + 900 >= 1000 UNION ALL SELECT v, {R('0', 'value')} FROM vol WHERE (value - 900) * 0.5 + 900 < 1000")
def mapped_series(spark, sf_dir):
    """Scale, threshold and log mappers in a row; ln(0 + 1) = 0 below the threshold."""
    vol = elementwise.mapf(fx.volume(spark, sf_dir), elementwise.scale_mapper(0.5, 900.0))
    vol = elementwise.mapf(vol, elementwise.threshold_mapper(1000.0, 0.0))
    return r6(elementwise.mapf(vol, elementwise.log_mapper(10.0, 1.0)).df, "value")


@query(w(VOL) + f"SELECT v, {R('(value - lo) / (hi - lo)', 'value')} FROM vol, (SELECT min(value) AS lo, max(value) AS hi FROM vol)")
def normalise_for_colors(spark, sf_dir):
    return r6(elementwise.normalised(fx.volume(spark, sf_dir)).df, "value")


# --- reductions -----------------------------------------------------------------------------------


@query(w(VOL, VDIM, DENSE) + f"SELECT count(*) AS n, {R('sum(value)', 'total')}, {R('avg(value)', 'mean')}, {R('min(value)', 'lo')}, {R('max(value)', 'hi')}, {R('stddev_pop(value)', 'sd')} FROM dense")
def global_stats(spark, sf_dir):
    return r6(reduce.global_stats(fx.volume(spark, sf_dir)), "total", "mean", "lo", "hi", "sd")


@query(w(VOL, VDIM, DENSE) + "SELECT (SELECT v FROM dense ORDER BY value, v LIMIT 1) AS which_min, (SELECT v FROM dense ORDER BY value DESC, v LIMIT 1) AS which_max")
def which_extreme(spark, sf_dir):
    return reduce.which_extreme(fx.volume(spark, sf_dir))


@query(w(BOLD) + f"SELECT v, {R('avg(x)', 'value')} FROM bold GROUP BY v")
def mean_over_time(spark, sf_dir):
    return r6(reduce.mean_over_time(fx.bold(spark, sf_dir)).df, "value")


@query(w(BOLD, ATLAS) + f"SELECT v, {R('CASE WHEN any_value(label) > 3 AND stddev_pop(x) > 0 THEN avg(x) / stddev_pop(x) ELSE 0 END', 'value')} FROM bold JOIN atlas USING (v) GROUP BY v")
def temporal_snr(spark, sf_dir):
    bold = fx.bold(spark, sf_dir)
    atlas = fx.atlas(spark, sf_dir)
    mask = Frame(atlas.df.where("label > 3").select("v", F.lit(True).alias("value")), bold.space.spatial, "volume", True)
    return r6(reduce.temporal_snr(bold, mask).df, "value")


#: The sparse series with a zero for every time that a stored voxel lacks.
FULL = "full7 AS (SELECT g.v, g.t, coalesce(c.x, 0.0) AS x FROM (SELECT v, unnest(range(0, 7)) AS t FROM (SELECT DISTINCT v FROM counts)) g LEFT JOIN counts c USING (v, t))"


@query(w(COUNTS, FULL) + f"SELECT v, {R('avg(x)', 'value')} FROM full7 GROUP BY v")
def mean_over_time_sparse(spark, sf_dir):
    return r6(reduce.mean_over_time(fx.counts(spark, sf_dir)).df, "value")


@query(w(COUNTS, FULL) + f"SELECT v, {R('CASE WHEN stddev_pop(x) > 0 THEN avg(x) / stddev_pop(x) ELSE 0 END', 'value')} FROM full7 GROUP BY v")
def temporal_snr_sparse(spark, sf_dir):
    return r6(reduce.temporal_snr(fx.counts(spark, sf_dir)).df, "value")


def sizes_as_labels(spark, sf_dir, space: Space) -> Frame:
    sizes = fx.volume(spark, sf_dir, "p_size")
    return Frame(sizes.df.select("v", F.col("value").cast("int").alias("label")), space, "labels", True)


@query(w(COUNTS) + f", g AS (SELECT p_partkey AS v, p_size AS label, unnest(range(0, 7)) AS t FROM part) SELECT label, t, {R('avg(coalesce(x, 0.0))', 'x')} FROM g LEFT JOIN counts USING (v, t) GROUP BY label, t")
def parcel_means_sparse(spark, sf_dir):
    counts = fx.counts(spark, sf_dir)
    rows = reduce.parcel_means(counts, sizes_as_labels(spark, sf_dir, counts.space.spatial)).df
    return lattice(r6(rows, "x"), "t")


@query(w(COUNTS) + f", g AS (SELECT p_partkey AS v, p_size AS label, unnest(range(0, 7)) AS t FROM part) SELECT CAST(label AS BIGINT) AS label, {R('max(coalesce(x, 0.0)) - min(coalesce(x, 0.0))', 'value')} FROM g LEFT JOIN counts USING (v, t) GROUP BY label")
def cluster_series_range(spark, sf_dir):
    counts = fx.counts(spark, sf_dir)
    return r6(neighbor.cluster_searchlight_series(counts, sizes_as_labels(spark, sf_dir, counts.space.spatial), lambda a: a.max() - a.min()), "value")


@query("SELECT p_size AS label, count(*) AS n, sum(p_partkey)::BIGINT AS s FROM part WHERE p_size > 20 GROUP BY 1")
def clustered_regions(spark, sf_dir):
    mask = mask_of(spark, sf_dir)
    rows = neighbor.clustered_searchlight(mask, sizes_as_labels(spark, sf_dir, mask.space))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("v").alias("s"))


PARCELS = "parcels AS (SELECT label, t, avg(x) AS x FROM bold JOIN atlas USING (v) GROUP BY label, t)"


@query(w(BOLD, ATLAS, PARCELS) + f"SELECT label, t, {R('x', 'x')} FROM parcels")
def parcel_means(spark, sf_dir):
    return lattice(r6(reduce.parcel_means(fx.bold(spark, sf_dir), fx.atlas(spark, sf_dir)).df, "x"), "t")


def conditions(spark: SparkSession) -> DataFrame:
    return spark.range(64).select(F.col("id").cast("int").alias("t"), (F.floor(F.col("id") / 8) % 2 == 0).alias("condition"), (F.col("id") % 4).cast("int").alias("level"), F.floor(F.col("id") / 16).cast("int").alias("run"))


EFFECT = "effect AS (SELECT label, avg(x) FILTER ((t // 8) % 2 = 0) - avg(x) FILTER ((t // 8) % 2 <> 0) AS effect FROM parcels GROUP BY label)"


@query(w(BOLD, ATLAS, PARCELS, EFFECT) + f"SELECT label, {R('effect', 'effect')} FROM effect")
def parcel_contrast(spark, sf_dir):
    parcels = reduce.parcel_means(fx.bold(spark, sf_dir), fx.atlas(spark, sf_dir))
    return r6(reduce.contrast(parcels, conditions(spark)), "effect")


@query(w(BOLD, ATLAS, BDIM, PARCELS, EFFECT) + f"SELECT g.v, {R('coalesce(effect, -9)', 'value')} FROM (SELECT unnest(range(0, nz * 64)) AS v FROM bdim) g LEFT JOIN atlas USING (v) LEFT JOIN effect USING (label)")
def effect_map(spark, sf_dir):
    atlas = fx.atlas(spark, sf_dir)
    parcels = reduce.parcel_means(fx.bold(spark, sf_dir), atlas)
    return r6(reduce.map_to_volume(atlas, reduce.contrast(parcels, conditions(spark)), "effect", -9.0).df, "value")


@query(w(BOLD, ATLAS, PARCELS) + f"SELECT a.label AS p, b.label AS q, {R('corr(a.x, b.x)', 'value')} FROM parcels a JOIN parcels b USING (t) GROUP BY 1, 2")
def connectome_corr(spark, sf_dir):
    return r6(reduce.connectome(reduce.parcel_means(fx.bold(spark, sf_dir), fx.atlas(spark, sf_dir))), "value")


@query(w(BOLD, ATLAS, PARCELS) + "SELECT a.label AS p, b.label AS q, round(covar_samp(a.x, b.x), 8) + 0.0 AS value FROM parcels a JOIN parcels b USING (t) GROUP BY 1, 2")
def connectome_cov(spark, sf_dir):
    return reduce.connectome(reduce.parcel_means(fx.bold(spark, sf_dir), fx.atlas(spark, sf_dir)), "covariance").withColumn("value", F.round("value", 8) + 0.0)


@query(w(BOLD) + f", s AS (SELECT t, x AS s FROM bold WHERE v = 12) SELECT v, {R('corr(x, s)', 'value')} FROM bold JOIN s USING (t) GROUP BY v")
def seed_correlation(spark, sf_dir):
    bold = fx.bold(spark, sf_dir)
    return r6(reduce.seed_correlation(bold, bold.df.where("v = 12").select("t", F.col("x").alias("s"))).df, "value")


@query(w(ATLAS) + f"SELECT label, count(*) AS size, {R('avg(v % 8)', 'ci')}, {R('avg((v // 8) % 8)', 'cj')}, {R('avg(v // 64)', 'ck')} FROM atlas GROUP BY label")
def cluster_sizes_and_centers(spark, sf_dir):
    return r6(reduce.cluster_table(fx.atlas(spark, sf_dir)), "ci", "cj", "ck")


@query(w(ATLAS) + f"SELECT label, {R('median(v % 8)', 'ci')}, {R('median((v // 8) % 8)', 'cj')}, {R('median(v // 64)', 'ck')} FROM atlas GROUP BY label")
def median_centroids(spark, sf_dir):
    return r6(reduce.centroids(fx.atlas(spark, sf_dir), "median"), "ci", "cj", "ck")


@query(w(VOL) + f"SELECT {R('sum((v % 10) * value) / sum(value)', 'ci')}, {R('sum(((v // 10) % 10) * value) / sum(value)', 'cj')}, {R('sum((v // 100) * value) / sum(value)', 'ck')} FROM vol WHERE value > 0")
def center_of_mass(spark, sf_dir):
    return r6(reduce.center_of_mass(fx.volume(spark, sf_dir)), "ci", "cj", "ck")


@query(w(VOL, VDIM) + "SELECT v // CAST(ceil(nz * 100 / 7.0) AS BIGINT) AS block, count(*) AS n, min(v) AS a, max(v) AS b FROM vol, vdim GROUP BY 1")
def split_blocks(spark, sf_dir):
    rows = reduce.split_blocks(fx.volume(spark, sf_dir), 7)
    return lattice(rows.groupBy("block").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")), "block")


@query(w(BOLD, ATLAS) + f"SELECT label, v, {R('avg(x)', 'value')} FROM bold JOIN atlas USING (v) GROUP BY label, v")
def split_clusters(spark, sf_dir):
    return r6(reduce.split_clusters(fx.bold(spark, sf_dir), fx.atlas(spark, sf_dir)), "value")


@query(w(BOLD) + f"SELECT t % 4 AS level, t // 4 AS t, {R('avg(x)', 'x')} FROM bold GROUP BY 1, 2")
def split_fill(spark, sf_dir):
    rows = reduce.split_fill(fx.bold(spark, sf_dir), conditions(spark).select("t", "level"))
    return lattice(r6(rows.groupBy("level", "t").agg(F.avg("x").alias("x")), "x"), "level", "t")


@query(w(BOLD) + f"SELECT v, {R('avg(m)', 'value')} FROM (SELECT v, t % 4 AS level, max(x) AS m FROM bold GROUP BY 1, 2) GROUP BY v")
def split_reduce(spark, sf_dir):
    return r6(reduce.split_reduce(fx.bold(spark, sf_dir), conditions(spark).select("t", "level"), F.max).df, "value")


@query(w(BOLD) + f"SELECT v, t, {R('(x - avg(x) OVER g) / CASE WHEN stddev_pop(x) OVER g > 0 THEN stddev_pop(x) OVER g ELSE 1 END', 'x')} FROM bold WINDOW g AS (PARTITION BY v, t % 4)")
def split_scale(spark, sf_dir):
    return lattice(r6(reduce.split_scale(fx.bold(spark, sf_dir), conditions(spark).select("t", "level")).df, "x"), "t")


@query(w(BOLD) + f"SELECT v, t, {R('(x - avg(x) OVER g) / stddev_pop(x) OVER g', 'x')} FROM bold WINDOW g AS (PARTITION BY v)")
def zscore_series(spark, sf_dir):
    return lattice(r6(reduce.scale_series(fx.bold(spark, sf_dir)).df, "x"), "t")


@query(w(BOLD) + f"SELECT v, t, {R('(x - min(x) OVER g) / (max(x) OVER g - min(x) OVER g)', 'x')} FROM bold WINDOW g AS (PARTITION BY v)")
def unit_scale_series(spark, sf_dir):
    return lattice(r6(reduce.scale_series(fx.bold(spark, sf_dir), "unit_scale").df, "x"), "t")


@query(w(BOLD) + f"SELECT v, {R('sum(x * exp(-0.1 * t)) / (SELECT sum(exp(-0.1 * t)) FROM (SELECT unnest(range(0, 64)) AS t))', 'value')} FROM bold GROUP BY v")
def dot_reduce(spark, sf_dir):
    from .functions.design import time_weights

    return r6(reduce.dot_reduce(fx.bold(spark, sf_dir), time_weights(64, "exponential", 0.1)).df, "value")


#: A sparse series at all times of its stored voxels.
FILLED = COUNTS + ", filled AS (SELECT v, CAST(t AS BIGINT) AS t, coalesce(x, 0.0) AS x FROM (SELECT DISTINCT v FROM counts) g CROSS JOIN (SELECT unnest(range(0, 7)) AS t) t LEFT JOIN counts USING (v, t))"


def halves(spark):
    return spark.createDataFrame([(t, t % 2) for t in range(7)], "t int, level int")


@query(w(FILLED) + f"SELECT v, {R('avg(r)', 'value')} FROM (SELECT v, t % 2 AS level, avg(x) AS r FROM filled GROUP BY 1, 2) GROUP BY v")
def split_reduce_sparse(spark, sf_dir):
    return r6(reduce.split_reduce(fx.counts(spark, sf_dir), halves(spark)).df, "value")


@query(w(FILLED) + f"SELECT v, t, {R('(x - avg(x) OVER g) / CASE WHEN stddev_pop(x) OVER g > 0 THEN stddev_pop(x) OVER g ELSE 1 END', 'x')} FROM filled WINDOW g AS (PARTITION BY v, t % 2)")
def split_scale_sparse(spark, sf_dir):
    return lattice(r6(reduce.split_scale(fx.counts(spark, sf_dir), halves(spark)).df, "x"), "t")


@query(w(FILLED) + f"SELECT v, t, {R('(x - avg(x) OVER g) / CASE WHEN stddev_pop(x) OVER g > 0 THEN stddev_pop(x) OVER g ELSE 1 END', 'x')} FROM filled WINDOW g AS (PARTITION BY v)")
def scale_series_sparse(spark, sf_dir):
    return lattice(r6(reduce.scale_series(fx.counts(spark, sf_dir)).df, "x"), "t")


@query(w(FILLED) + f"SELECT f.v, {R('coalesce(covar_pop(f.x, s.x) / nullif(stddev_pop(f.x) * stddev_pop(s.x), 0), CAST(' + chr(39) + 'nan' + chr(39) + ' AS DOUBLE))', 'value')} FROM filled f JOIN filled s ON s.t = f.t AND s.v = 11 GROUP BY f.v")
def seed_correlation_sparse(spark, sf_dir):
    counts = fx.counts(spark, sf_dir)
    return r6(reduce.seed_correlation(counts, counts.df.where("v = 11").select("t", F.col("x").alias("s"))).df, "value")


@query(w(BOLD) + f"SELECT v, {R('avg(x)', 'value')}, count(*) AS n FROM (SELECT * FROM bold UNION ALL SELECT v, t + 64, x * 3 FROM bold) GROUP BY v")
def concat_series(spark, sf_dir):
    bold = fx.bold(spark, sf_dir)
    both = reduce.concat(bold, elementwise.arithmetic(bold, 3.0, "*"))
    return r6(both.df.groupBy("v").agg(F.avg("x").alias("value"), F.countDistinct("t").alias("n")), "value")


@query(w(HYPER) + f"SELECT v, t, {R('avg(x)', 'mean')}, {R('stddev_pop(x)', 'sd')} FROM hyper GROUP BY v, t")
def feature_statistics(spark, sf_dir):
    h = fx.hyper(spark, sf_dir)
    mean = reduce.reduce_features(h, "mean").withColumnRenamed("x", "mean")
    sd = reduce.reduce_features(h, "std").withColumnRenamed("x", "sd")
    return lattice(r6(mean.join(sd, ["v", "t"]), "mean", "sd"), "t")


@query(w(HYPER) + f"SELECT v, t, {R('sum(x * (f + 1) / 15.0)', 'x')} FROM hyper GROUP BY v, t")
def weighted_features(spark, sf_dir):
    return lattice(r6(reduce.reduce_features(fx.hyper(spark, sf_dir), "weighted", [1, 2, 3, 4, 5]), "x"), "t")


@query(w(HYPER) + "SELECT v, round(avg(x), 9) + 0.0 AS x FROM hyper GROUP BY v")
def mean_time_features(spark, sf_dir):
    return reduce.reduce_features(fx.hyper(spark, sf_dir), "mean_time").withColumn("x", F.round("x", 9) + 0.0)


@query(w(HYPER) + f"SELECT v, t, CAST(CASE f WHEN 4 THEN 0 ELSE 1 END AS BIGINT) AS f, {R('x', 'x')} FROM hyper WHERE f IN (4, 1)")
def select_features(spark, sf_dir):
    return lattice(r6(select.select_features(fx.hyper(spark, sf_dir), [4, 1]).df, "x"), "t", "f")


@query(w(HYPER) + f"SELECT CAST(f AS BIGINT) AS f, {R('sum(x)', 'x')}, count(*) AS n FROM (SELECT f, x FROM hyper UNION ALL SELECT f + 5, -x FROM hyper) GROUP BY f")
def concat_features(spark, sf_dir):
    h = fx.hyper(spark, sf_dir)
    both = reduce.concat_features(h, elementwise.arithmetic(h, -1.0, "*"))
    return lattice(r6(both.df.groupBy("f").agg(F.sum("x").alias("x"), F.count("*").alias("n")), "x"), "f")


@query(w(HYPER) + f"SELECT v, t, {R('max(x) - min(x)', 'x')} FROM hyper GROUP BY v, t")
def feature_function(spark, sf_dir):
    return lattice(r6(reduce.apply_feature_function(fx.hyper(spark, sf_dir), lambda a: a.max() - a.min()), "x"), "t")


@query()
def kmeans_partition(spark, sf_dir):
    rows = reduce.partition(fx.volume(spark, sf_dir), 4).df
    return rows.groupBy("label").agg(F.count("*").alias("n"))


@query()
def clip_level(spark, sf_dir):
    return spark.createDataFrame([(reduce.clip_level(fx.volume(spark, sf_dir)),)], "level double")


# --- neighbourhoods -------------------------------------------------------------------------------

BALL2 = near(2, "4 * (dx * dx + dy * dy + dz * dz) <= 16")
PAIRS = "pairs AS (SELECT c.v AS v, n.v AS u FROM (SELECT v, " + VIJK + " FROM mask) c, o, vdim, LATERAL (SELECT c.i + dx + 10 * (c.j + dy + 10 * (c.k + dz)) AS v) n WHERE c.i + dx BETWEEN 0 AND 9 AND c.j + dy BETWEEN 0 AND 9 AND c.k + dz BETWEEN 0 AND nz - 1)"
INMASK = "near AS (SELECT pairs.v, vol.value AS y FROM pairs JOIN mask m ON m.v = pairs.u JOIN vol ON vol.v = pairs.u)"


@query(w(VOL, VDIM, MASK, BALL2, PAIRS, INMASK) + f"SELECT v, {R('avg(y)', 'value')} FROM near GROUP BY v")
def searchlight_mean(spark, sf_dir):
    return r6(neighbor.searchlight(fx.volume(spark, sf_dir), mask_of(spark, sf_dir), 4.0).df, "value")


@query(w(VOL, VDIM, MASK, BALL2, PAIRS, INMASK) + f"SELECT v, {R('max(y) - min(y)', 'value')} FROM near GROUP BY v")
def searchlight_range(spark, sf_dir):
    return r6(neighbor.searchlight(fx.volume(spark, sf_dir), mask_of(spark, sf_dir), 4.0, "range").df, "value")


@query(w(VOL, VDIM, MASK, BALL2, PAIRS, INMASK) + "SELECT v, round(stddev_pop(y), 4) + 0.0 AS value FROM near GROUP BY v")
def searchlight_sd(spark, sf_dir):
    return neighbor.searchlight(fx.volume(spark, sf_dir), mask_of(spark, sf_dir), 4.0, "sd").df.withColumn("value", F.round("value", 4) + 0.0)


@query(w(VOL, VDIM, MASK, BALL2, PAIRS) + "SELECT v AS center, count(*) AS n, sum(u)::BIGINT AS s FROM pairs GROUP BY v")
def searchlight_coords(spark, sf_dir):
    rows = neighbor.searchlight_coords(mask_of(spark, sf_dir), 4.0, nonzero=False)
    return rows.groupBy("center").agg(F.count("*").alias("n"), F.sum("v").alias("s"))


BMASK = "bm AS (SELECT vec_id AS v, CAST(vec_id % 8 AS BIGINT) AS i, CAST((vec_id // 8) % 8 AS BIGINT) AS j, CAST(vec_id // 64 AS BIGINT) AS k FROM embeddings WHERE label < 5)"
BBALL = near(2, "4 * (dx * dx + dy * dy) + 9 * dz * dz <= 16")


def _bold_mask(spark, sf_dir) -> tuple[Frame, Frame]:
    bold = fx.bold(spark, sf_dir)
    ids = fx.table(spark, sf_dir, "embeddings").where("label < 5")
    return bold, Frame(ids.select(F.col("vec_id").alias("v"), F.lit(True).alias("value")), bold.space.spatial, "volume", True)


@query(w(BOLD, BMASK, BBALL) + f", pairs AS (SELECT a.v, b.v AS u FROM bm a, o, bm b WHERE b.i = a.i + dx AND b.j = a.j + dy AND b.k = a.k + dz) SELECT p.v, {R('avg(x) FILTER ((t // 8) % 2 = 0) - avg(x) FILTER ((t // 8) % 2 <> 0)', 'value')} FROM pairs p JOIN bold ON bold.v = p.u GROUP BY p.v")
def searchlight_contrast(spark, sf_dir):
    bold, mask = _bold_mask(spark, sf_dir)
    return r6(neighbor.searchlight_contrast(bold, mask, 4.0, conditions(spark).select("t", "condition")), "value")


@query(w(BOLD, BMASK, BBALL) + f", pairs AS (SELECT a.v, b.v AS u FROM bm a, o, bm b WHERE b.i = a.i + dx AND b.j = a.j + dy AND b.k = a.k + dz) SELECT p.v AS center, {R('max(x)', 'value')} FROM pairs p JOIN bold ON bold.v = p.u GROUP BY p.v")
def searchlight_function(spark, sf_dir):
    bold, mask = _bold_mask(spark, sf_dir)
    return r6(neighbor.searchlight_apply(bold, mask, 4.0, lambda a: a.max()), "value")


BPAIRS = "pairs AS (SELECT a.v, b.v AS u FROM bm a, o, bm b WHERE b.i = a.i + dx AND b.j = a.j + dy AND b.k = a.k + dz)"


def _draws_sql(n: int, seed: int) -> str:
    drawn = neighbor.bootstrap_draws(64, n, seed)
    return "drawn AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {t})" for k, d in enumerate(drawn) for t in d) + ") d(k, t))"


@query(w(BOLD, BMASK, BBALL, BPAIRS, _draws_sql(50, 3)) + f", m AS (SELECT v AS u, avg(x) AS m FROM bold JOIN drawn USING (t) GROUP BY v) SELECT p.v, {R('avg(m)', 'value')} FROM pairs p JOIN m USING (u) GROUP BY p.v")
def searchlight_bootstrap(spark, sf_dir):
    bold, mask = _bold_mask(spark, sf_dir)
    return r6(neighbor.resampled_searchlight(bold, mask, 4.0, n_resamples=50, seed=3), "value")


@query(w(BOLD, BMASK, BBALL, BPAIRS, _draws_sql(8, 5)) + f", best AS (SELECT p.v, b.t, max(x) AS x FROM pairs p JOIN bold b ON b.v = p.u GROUP BY 1, 2), tops AS (SELECT v, k, max(x) AS x FROM best JOIN drawn USING (t) GROUP BY 1, 2) SELECT v, {R('avg(x)', 'value')} FROM tops GROUP BY v")
def searchlight_bootstrap_max(spark, sf_dir):
    bold, mask = _bold_mask(spark, sf_dir)
    return r6(neighbor.resampled_searchlight(bold, mask, 4.0, lambda a: a.max(), 8, 5), "value")


@query(w(COUNTS, BALL2, MASK, VDIM, PAIRS) + f", g AS (SELECT p.v, p.u, unnest(range(0, 7)) AS t FROM pairs p JOIN mask m ON m.v = p.u) SELECT g.v, g.t, {R('avg(coalesce(c.x, 0.0))', 'x')} FROM g LEFT JOIN counts c ON c.v = g.u AND c.t = g.t GROUP BY g.v, g.t")
def searchlight_mean_sparse(spark, sf_dir):
    counts, mask = fx.counts(spark, sf_dir), mask_of(spark, sf_dir)
    return lattice(r6(neighbor.searchlight(counts.like(counts.df, space=Space((*mask.space.dim, 7), (2.0, 2.0, 2.0, 1.0))), mask, 4.0).df, "x"), "t")


@query()
def searchlight_random_centers(spark, sf_dir):
    return neighbor.random_centers(mask_of(spark, sf_dir), 20, 7)


@query()
def searchlight_cover(spark, sf_dir):
    return neighbor.covering_centers(mask_of(spark, sf_dir), 4.0, 1)


def _gauss_sql() -> str:
    weights = ", ".join(f"({d}, {x!r}::DOUBLE)" for d, x in neighbor.gaussian_weights(1.5, 2.0))

    def one(src: str, name: str, axis: str, n: str, stride: int) -> str:
        return f"{name} AS (SELECT c.v, sum(g.w * s.value) AS value FROM (SELECT v, {axis} AS p FROM dense) c, g, vdim, {src} s WHERE s.v = c.v + {stride} * (CASE WHEN ((c.p + g.d) % (2 * {n}) + 2 * {n}) % (2 * {n}) < {n} THEN ((c.p + g.d) % (2 * {n}) + 2 * {n}) % (2 * {n}) ELSE 2 * {n} - 1 - ((c.p + g.d) % (2 * {n}) + 2 * {n}) % (2 * {n}) END - c.p) GROUP BY c.v)"

    return w(VOL, VDIM, DENSE, f"g AS (SELECT * FROM (VALUES {weights}) t(d, w))", one("dense", "ax", "v % 10", "10", 1), one("ax", "ay", "(v // 10) % 10", "10", 10), one("ay", "az", "v // 100", "nz", 100)) + f"SELECT v, {R('value', 'value')} FROM az"


@query(_gauss_sql())
def gaussian_blur(spark, sf_dir):
    return r6(neighbor.gaussian_blur(fx.volume(spark, sf_dir), 1.5, 2.0).df, "value")


BOX1 = near(1, "true")
ALL_PAIRS = "pairs AS (SELECT c.v AS v, n.v AS u, dx, dy, dz FROM (SELECT v, " + VIJK + " FROM dense) c, o, vdim, LATERAL (SELECT c.i + dx + 10 * (c.j + dy + 10 * (c.k + dz)) AS v) n WHERE c.i + dx BETWEEN 0 AND 9 AND c.j + dy BETWEEN 0 AND 9 AND c.k + dz BETWEEN 0 AND nz - 1)"


@query(w(VOL, VDIM, DENSE, BOX1, ALL_PAIRS) + f"SELECT p.v, {R('sum(d.value) / 27', 'value')} FROM pairs p JOIN dense d ON d.v = p.u GROUP BY p.v")
def box_blur(spark, sf_dir):
    return r6(neighbor.box_mean(densified(fx.volume(spark, sf_dir)), 1).df, "value")


@query(w(VOL, VDIM, DENSE, BOX1, ALL_PAIRS) + f", m AS (SELECT p.v, sum(value) / 27 AS m, sum(value * value) / 27 AS q FROM pairs p JOIN dense d ON d.v = p.u GROUP BY p.v), ab AS (SELECT v, (q - m * m) / (q - m * m + 0.49) AS a, (1 - (q - m * m) / (q - m * m + 0.49)) * m AS b FROM m), s AS (SELECT p.v, sum(a) / 27 AS a, sum(b) / 27 AS b FROM pairs p JOIN ab ON ab.v = p.u GROUP BY p.v) SELECT v, round(CASE WHEN value <> 0 THEN a * value + b ELSE value END, 4) + 0.0 AS value FROM dense JOIN s USING (v)")
def guided_filter(spark, sf_dir):
    return neighbor.guided_filter(fx.volume(spark, sf_dir), 1).df.withColumn("value", F.round("value", 4) + 0.0)


@query(w(VOL, VDIM, DENSE, BOX1, ALL_PAIRS) + f", q AS (SELECT p.v, d.value AS y, exp(-(dx * dx + dy * dy + dz * dz) / 8.0) * exp(-pow(d.value - c.value, 2) / (2 * 2500.0)) AS w FROM pairs p JOIN dense d ON d.v = p.u JOIN dense c ON c.v = p.v) SELECT v, {R('sum(w * y) / sum(w)', 'value')} FROM q GROUP BY v")
def bilateral_filter(spark, sf_dir):
    return r6(neighbor.bilateral_filter(fx.volume(spark, sf_dir), 2.0, 50.0, 1).df, "value")


@query(w(BOLD, BMASK, BOX1) + f", d AS (SELECT bold.v, t, x, i, j, k FROM bold JOIN bm USING (v)), s AS (SELECT stddev_pop(x) AS sd FROM d), td AS (SELECT unnest(range(-1, 2)) AS dt), q AS (SELECT a.v, a.t, b.x AS y, exp(-(4 * (dx * dx + dy * dy) + 9 * dz * dz) / 8.0) * exp(-(dt * dt) / 2.0) * exp(-pow((b.x - a.x) / sd, 2) / 2) AS w FROM d a, o, td, s, d b WHERE b.v = a.i + dx + 8 * (a.j + dy + 8 * (a.k + dz)) AND a.i + dx BETWEEN 0 AND 7 AND a.j + dy BETWEEN 0 AND 7 AND a.k + dz >= 0 AND b.t = a.t + dt) SELECT v, t, {R('sum(w * y) / sum(w)', 'x')} FROM q GROUP BY v, t")
def bilateral_filter_4d(spark, sf_dir):
    bold, mask = _bold_mask(spark, sf_dir)
    return lattice(r6(neighbor.bilateral_filter_4d(bold, mask).df, "x"), "t")


FACE = near(1, "abs(dx) + abs(dy) + abs(dz) = 1")
EDGES = "edges AS (SELECT pairs.v AS src, pairs.u AS dst FROM pairs JOIN mask m ON m.v = pairs.u)"


@query(w(VOL, VDIM, MASK, FACE, PAIRS, EDGES) + "SELECT src, dst FROM edges")
def graph_edges(spark, sf_dir):
    return neighbor.make_graph(mask_of(spark, sf_dir))


@query(w(VOL, VDIM, MASK, FACE, PAIRS, EDGES) + f"SELECT vol.v, {R('coalesce(avg(n.value), 0)', 'value')} FROM vol LEFT JOIN edges ON src = vol.v LEFT JOIN vol n ON n.v = dst GROUP BY vol.v")
def graph_filter(spark, sf_dir):
    return r6(neighbor.graph_filter(fx.volume(spark, sf_dir).df, neighbor.make_graph(mask_of(spark, sf_dir))), "value")


@query(w(VOL, VDIM, MASK, FACE, PAIRS, EDGES) + f", e AS (SELECT src AS v, dst AS u, exp(-1 / (2 * pow(1.5 / (2 * sqrt(2 * ln(2.0))), 2))) AS w FROM edges UNION ALL SELECT v, v, 1.0 FROM mask) SELECT e.v, {R('sum(w * value) / sum(w)', 'value')} FROM e JOIN vol ON vol.v = e.u GROUP BY e.v")
def graph_smooth(spark, sf_dir):
    return r6(neighbor.graph_smooth(fx.volume(spark, sf_dir), 1.5, mask_of(spark, sf_dir)).df, "value")


@query(w(VOL, VDIM, MASK, FACE, PAIRS, EDGES) + f"SELECT vol.v, {R('vol.value + 0.5 * (count(n.v) * vol.value - coalesce(sum(n.value), 0))', 'value')} FROM vol LEFT JOIN edges ON src = vol.v LEFT JOIN vol n ON n.v = dst GROUP BY vol.v, vol.value")
def laplace_enhance(spark, sf_dir):
    return r6(neighbor.laplace_enhance(fx.volume(spark, sf_dir), mask_of(spark, sf_dir)).df, "value")


@query(w(VOL, VDIM, MASK, FACE, PAIRS, EDGES) + f", e AS (SELECT src AS v, dst AS u FROM edges UNION ALL SELECT v, v FROM mask), d AS (SELECT e.v, e.u, value AS y, p_size::DOUBLE AS c FROM e JOIN vol ON vol.v = e.u JOIN part ON p_partkey = e.u), b AS (SELECT v, CASE WHEN var_pop(c) > 0 THEN covar_pop(c, y) / var_pop(c) ELSE 0 END AS b, avg(y) AS my, avg(c) AS mc FROM d GROUP BY v) SELECT d.v, round(y - my - b * (c - mc), 4) + 0.0 AS value FROM d JOIN b USING (v) WHERE d.v = d.u")
def nuisance_residual(spark, sf_dir):
    confounds = fx.volume(spark, sf_dir, "p_size").df.withColumnRenamed("value", "c0")
    return neighbor.nuisance_residual(fx.volume(spark, sf_dir), confounds, mask_of(spark, sf_dir)).withColumn("value", F.round("value", 4) + 0.0)


@query(w(COUNTS, FULL) + f", r AS (SELECT v, t // 3 AS run, sum(x) AS s, count(*) AS n FROM full7 GROUP BY 1, 2), a AS (SELECT v, sum(s) AS s, sum(n) AS n FROM r GROUP BY v) SELECT v, run, {R('(a.s - r.s) / (a.n - r.n)', 'value')} FROM r JOIN a USING (v)")
def leave_one_run_out_sparse(spark, sf_dir):
    runs = spark.createDataFrame([(t, t // 3) for t in range(7)], "t int, run int")
    return lattice(r6(neighbor.leave_one_run_out(fx.counts(spark, sf_dir), runs), "value"), "run")


@query(w(BOLD) + f", r AS (SELECT v, t // 16 AS run, sum(x) AS s, count(*) AS n FROM bold GROUP BY 1, 2), a AS (SELECT v, sum(s) AS s, sum(n) AS n FROM r GROUP BY v) SELECT v, run, {R('(a.s - r.s) / (a.n - r.n)', 'value')} FROM r JOIN a USING (v)")
def leave_one_run_out(spark, sf_dir):
    return lattice(r6(neighbor.leave_one_run_out(fx.bold(spark, sf_dir), conditions(spark).select("t", "run")), "value"), "run")


@query(w(BOLD, BMASK, FACE) + ", e AS (SELECT a.v, b.v AS u, exp(-1 / (2 * pow(3.0 / (2 * sqrt(2 * ln(2.0))), 2))) AS w FROM bm a, o, bm b WHERE b.i = a.i + dx AND b.j = a.j + dy AND b.k = a.k + dz UNION ALL SELECT v, v, 1.0 FROM bm), r AS (SELECT v, t // 16 AS run, sum(x) AS s, count(*) AS n FROM bold JOIN bm USING (v) GROUP BY 1, 2), a AS (SELECT v, sum(s) AS s, sum(n) AS n FROM r GROUP BY v), r0 AS (SELECT v, run, (a.s - r.s) / (a.n - r.n) AS value FROM r JOIN a USING (v)), r1 AS (SELECT e.v, run, sum(w * value) / sum(w) AS value FROM e JOIN r0 ON r0.v = e.u GROUP BY 1, 2)" + f" SELECT e.v, CAST(run AS BIGINT) AS run, {R('sum(w * value) / sum(w)', 'value')} FROM e JOIN r1 ON r1.v = e.u GROUP BY 1, 2")
def smooth_leave_one_run_out(spark, sf_dir):
    bold, mask = _bold_mask(spark, sf_dir)
    return lattice(r6(neighbor.smooth_leave_one_run_out(bold, 3.0, conditions(spark).select("t", "run"), mask), "value"), "run")


# --- components -----------------------------------------------------------------------------------

#: Components by a recursive walk: the least voxel that each reaches.
REACH = "reach AS (SELECT v AS a, v AS b FROM mask UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON e.src = r.b)"
ROOTS = "roots AS (SELECT b AS v, min(a) AS root FROM reach GROUP BY b)"


def _components_sql(threshold: int, tail: str) -> str:
    mask = f"mask AS (SELECT v FROM vol WHERE value > {threshold})"
    return "WITH RECURSIVE " + ", ".join((SIZES, VDIM, mask, FACE, PAIRS, EDGES, REACH, ROOTS, "sizes AS (SELECT root, count(*) AS size, min((v // 100) + nz * ((v // 10) % 10 + 10 * (v % 10))) AS first FROM roots, vdim GROUP BY root), named AS (SELECT root, size, row_number() OVER (ORDER BY first) AS index FROM sizes)")) + tail


@query(_components_sql(38, " SELECT v, CAST(index AS BIGINT) AS index, size FROM roots JOIN named USING (root)"))
def conn_comp(spark, sf_dir):
    return lattice(cluster.conn_comp(fx.volume(spark, sf_dir, "p_size"), 38.0, "6-connect"), "index")


@query(_components_sql(38, f" SELECT CAST(index AS BIGINT) AS index, count(*) AS n, {R('avg(v % 10) * 2', 'x')}, {R('avg((v // 10) % 10) * 2', 'y')}, {R('avg(v // 100) * 2', 'z')}, {R('count(*) * 8.0', 'volume')}, {R('avg(value)', 'mean')}, {R('max(value)', 'peak')} FROM roots JOIN named USING (root) JOIN vol USING (v) GROUP BY index"))
def cluster_table(spark, sf_dir):
    vol = fx.volume(spark, sf_dir, "p_size")
    rows = cluster.cluster_table(vol, cluster.conn_comp(vol, 38.0, "6-connect"))
    return lattice(r6(rows.select("index", "n", "x", "y", "z", "volume", "mean", "peak"), "x", "y", "z", "volume", "mean", "peak"), "index")


@query()
def local_maxima(spark, sf_dir):
    vol = fx.volume(spark, sf_dir, "p_size")
    return cluster.local_maxima(vol, cluster.conn_comp(vol, 38.0, "26-connect"), 6.0)


@query()
def automask(spark, sf_dir):
    return cluster.automask(fx.volume(spark, sf_dir, "p_size")).df.select("v")


# --- resampling -----------------------------------------------------------------------------------


@query(w(VOL, VDIM, DENSE) + ", t AS (SELECT unnest(range(0, 8 * 8 * 2)) AS v) SELECT t.v, coalesce(d.value, 0.0) AS value FROM t LEFT JOIN dense d ON d.v = round_even((t.v % 8) * 1.25, 0) + 10 * (round_even(((t.v // 8) % 8) * 1.25, 0) + 10 * round_even((t.v // 64) * 1.25, 0)) AND round_even((t.v % 8) * 1.25, 0) BETWEEN 0 AND 9 AND round_even(((t.v // 8) % 8) * 1.25, 0) BETWEEN 0 AND 9")
def resample_nearest(spark, sf_dir):
    vol = densified(fx.volume(spark, sf_dir))
    return resample.resample(vol, Space((8, 8, 2), (2.5, 2.5, 2.5)), 0).df


@query(w(VOL, VDIM, DENSE) + f", t AS (SELECT v, (v % 8) * 1.2 + 0.25 AS a, ((v // 8) % 8) * 1.2 + 0.25 AS b, 0.5 AS c FROM (SELECT unnest(range(0, 64)) AS v)), q AS (SELECT t.v, d.value * (1 - abs(a - (d.v % 10))) * (1 - abs(b - ((d.v // 10) % 10))) * (1 - abs(c - (d.v // 100))) AS y FROM t JOIN dense d ON abs(a - (d.v % 10)) < 1 AND abs(b - ((d.v // 10) % 10)) < 1 AND abs(c - (d.v // 100)) < 1 WHERE a <= 9 AND b <= 9 AND (SELECT nz FROM vdim) > 1) SELECT t.v, {R('coalesce(sum(y), 0)', 'value')} FROM t LEFT JOIN q USING (v) GROUP BY t.v")
def resample_linear(spark, sf_dir):
    vol = densified(fx.volume(spark, sf_dir))
    return r6(resample.resample(vol, Space((8, 8, 1), (2.4, 2.4, 2.4), (0.5, 0.5, 1.0)), 1).df, "value")


@query(w(VOL, VDIM, DENSE) + f"SELECT v, {R('value', 'value')} FROM dense")
def resample_cubic_identity(spark, sf_dir):
    """A cubic resampling onto the frame's own grid gives its values."""
    vol = densified(fx.volume(spark, sf_dir))
    return r6(resample.resample(vol, vol.space, 3).df, "value")


@query(w(VOL, VDIM) + "SELECT CAST((9 - v % 10) + 10 * (v // 100 + nz * (9 - (v // 10) % 10)) AS BIGINT) AS v, value FROM vol, vdim")
def reorient(spark, sf_dir):
    vol = fx.volume(spark, sf_dir)
    return resample.reorient(vol, ("L", "S", "P")).df


@query(w(VOL, VDIM, DENSE) + f"SELECT (v % 10) // 2 + 5 * (((v // 10) % 10) // 2 + 5 * ((v // 100) // least(2, nz))) AS v, {R('sum(value) / (4 * least(2, nz))', 'value')} FROM dense, vdim WHERE (v // 100) // least(2, nz) < greatest(1, nz // 2) GROUP BY 1, nz")
def downsample(spark, sf_dir):
    return r6(resample.downsample(densified(fx.volume(spark, sf_dir)), 2).df, "value")


@query(w(VOL, VDIM, DENSE) + f", g AS (SELECT unnest(range(0, 35)) AS v), s AS (SELECT v, 2.25 * (v % 5) AS s0, 1.5 * (v // 5) AS s1 FROM g), q AS (SELECT v, floor(s0) + di AS i, floor(s1) + dj AS j, (1 - abs(s0 - floor(s0) - di)) * (1 - abs(s1 - floor(s1) - dj)) AS w FROM s, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj)) SELECT q.v, {R('sum(w * value)', 'value')} FROM q JOIN dense d ON d.v = CAST(i AS BIGINT) + 10 * CAST(j AS BIGINT) AND i <= 9 AND j <= 9 GROUP BY q.v")
def downsample_zoom(spark, sf_dir):
    """To 5 x 7 x 1 voxels, which no blocks give: linear between the voxels."""
    return r6(resample.downsample_to(fx.volume(spark, sf_dir), outdim=(5, 7, 1)).df, "value")


@query(w(VOL) + f", a AS (SELECT v, value FROM vol WHERE v < 100), b AS (SELECT v - 100 AS v, value FROM vol WHERE v BETWEEN 100 AND 199) SELECT v, {R('coalesce(b.value, 0) - coalesce(a.value, 0)', 'value')} FROM a FULL JOIN b USING (v)")
def slice_difference(spark, sf_dir):
    """One plane of a volume less the one below it."""
    vol = fx.volume(spark, sf_dir)
    above, below = (select.slice_frame(vol.like(vol.df, sparse=True), k, 2) for k in (1, 0))
    return r6(elementwise.arithmetic(above, below, "-").df, "value")


@query(w(VOL, SIZES.replace("vol AS", "sizes AS")) + "SELECT 'price' AS name, v, value FROM vol UNION ALL SELECT 'size', v, value FROM sizes")
def named_volumes(spark, sf_dir):
    """Volumes of one grid under names: two of three, in another order."""
    from .plans.bucket import bucket

    price, size = (fx.volume(spark, sf_dir, c) for c in ("p_retailprice", "p_size"))
    return bucket(("none", "size", "price"), elementwise.arithmetic(size, 0.0, "*"), size, price).part(["price", "size"]).rows()


#: Turned by 0.2 about z, the grid's axis-aligned box has 12 x 12 columns and begins at x = -18 sin 0.2.
BOX = "g AS (SELECT unnest(range(0, 144 * nz)) AS v FROM vdim), s AS (SELECT v, v // 144 AS k, round(((2 * (v % 12) - 18 * sin(0.2)) * cos(0.2) + 2 * ((v // 12) % 12) * sin(0.2)) / 2, 9) AS s0, round((2 * ((v // 12) % 12) * cos(0.2) - (2 * (v % 12) - 18 * sin(0.2)) * sin(0.2)) / 2, 9) AS s1 FROM g), q AS (SELECT v, k, floor(s0) + di AS i, floor(s1) + dj AS j, (1 - abs(s0 - floor(s0) - di)) * (1 - abs(s1 - floor(s1) - dj)) AS w FROM s, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj) WHERE s0 BETWEEN 0 AND 9 AND s1 BETWEEN 0 AND 9), m AS (SELECT q.v, sum(w * value) AS value FROM q JOIN dense d ON d.v = CAST(i AS BIGINT) + 10 * (CAST(j AS BIGINT) + 10 * k) AND i <= 9 AND j <= 9 GROUP BY 1)"


@query(w(VOL, VDIM, DENSE, BOX) + f"SELECT g.v, {R('coalesce(value, 0)', 'value')} FROM g LEFT JOIN m USING (v)")
def deoblique(spark, sf_dir):
    import math

    c, s = math.cos(0.2), math.sin(0.2)
    vol = densified(fx.volume(spark, sf_dir))
    turned = vol.like(vol.df, space=vol.space.with_trans([[2 * c, -2 * s, 0, 0], [2 * s, 2 * c, 0, 0], [0, 0, 2, 0], [0, 0, 0, 1]]))
    return r6(resample.deoblique(turned).df, "value")


# --- workflows, sources, streams ------------------------------------------------------------------


@query(w(BOLD, BDIM) + f", s AS (SELECT v, CASE WHEN stddev_pop(x) > 0 THEN avg(x) / stddev_pop(x) ELSE 0 END AS value FROM bold WHERE t >= 4 GROUP BY v) SELECT g.v, {R('coalesce(value, 0)', 'value')} FROM (SELECT unnest(range(0, nz * 64)) AS v FROM bdim) g LEFT JOIN s USING (v)")
def drop_first_volumes_tsnr(spark, sf_dir):
    bold = select.time_slice(fx.bold(spark, sf_dir), 4, 64)
    return r6(densified(reduce.temporal_snr(bold)).df, "value")


@query(w(BOLD) + f", s AS (SELECT (v % 2) AS subject, v // 2 AS v, CASE WHEN stddev_pop(x) > 0 THEN avg(x) / stddev_pop(x) ELSE 0 END AS value FROM bold GROUP BY bold.v) SELECT v, {R('avg(value)', 'value')}, count(*) AS n FROM s GROUP BY v")
def group_mean_tsnr(spark, sf_dir):
    """Maps of two subjects (even and odd voxels), averaged."""
    bold = fx.bold(spark, sf_dir)
    maps = None
    for subject in (0, 1):
        own = bold.like(bold.df.where(F.col("v") % 2 == subject).withColumn("v", F.floor(F.col("v") / 2)))
        part = reduce.temporal_snr(own).df
        maps = part if maps is None else maps.union(part)
    return r6(maps.groupBy("v").agg(F.avg("value").alias("value"), F.count("*").alias("n")), "value")


@query(w(VOL, VDIM, DENSE) + "SELECT v, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM dense")
def nifti_round_trip(spark, sf_dir):
    """Written as a NIfTI file and read back by the source; values as 32-bit floats."""
    from .sources import nifti

    path = fresh(spark, "volume.nii.gz")
    nifti.write(fx.volume(spark, sf_dir), path)
    return nifti.read(spark, path).where("t = 0").select("v", F.col("x").alias("value"))


DBOLD = "dbold AS (SELECT g.v, t.t, CAST(CAST(coalesce(x, 0) AS FLOAT) AS DOUBLE) AS x FROM (SELECT unnest(range(0, nz * 64)) AS v FROM bdim) g CROSS JOIN (SELECT unnest(range(0, 64)) AS t) t LEFT JOIN bold ON bold.v = g.v AND bold.t = t.t)"


@query(w(BOLD, BDIM, DBOLD) + "SELECT q.k AS t, v, x FROM dbold JOIN (VALUES (0, 60), (1, 3), (2, 60)) q(k, t) ON dbold.t = q.t")
def series_image_round_trip(spark, sf_dir):
    """A sparse series in one indexed gzip image; three of its volumes read back, in the order asked for."""
    from .sources import images, nifti

    path = fresh(spark, "series.nii.gz")
    nifti.write(fx.bold(spark, sf_dir), path)
    return lattice(images.read_image(spark, path, indices=[60, 3, 60]).df, "t")


@query(w(COUNTS, VDIM) + ", g AS (SELECT v, t FROM (SELECT unnest(range(0, nz * 100)) AS v FROM vdim), (SELECT unnest(range(0, 7)) AS t)) SELECT g.v, g.t, coalesce(x, 0.0) AS x FROM g LEFT JOIN counts ON g.v = counts.v AND g.t = counts.t JOIN part ON g.v = p_partkey WHERE p_size > 20")
def pair_image_round_trip(spark, sf_dir):
    """A sparse series as a compressed AFNI pair, read back where a mask is true."""
    from .sources import afni, images

    counts, mask = fx.counts(spark, sf_dir), mask_of(spark, sf_dir)
    head, _ = afni.write(counts, fresh(spark, "counts.HEAD"), "f4", compress=True)
    return lattice(images.read_image(spark, head, mask=mask.like(mask.df, space=counts.space.spatial)).df, "t")


@query(w(BOLD, BDIM, DBOLD) + f"SELECT v, {R('CASE WHEN stddev_pop(x) > 0 THEN avg(x) / stddev_pop(x) ELSE 0 END', 'value')} FROM dbold GROUP BY v")
def file_per_volume_tsnr(spark, sf_dir):
    """A file for each time, their headers read by a job and compared, then temporal signal-to-noise over all."""
    from .sources import images

    folder = fresh(spark, "volumes")
    images.write_volumes(densified(fx.bold(spark, sf_dir)), folder)
    df, first, total = images.open_images(spark, folder)
    return r6(densified(reduce.temporal_snr(Frame(df, first.space.add_dim(total), "series"))).df, "value")


def stored(spark, frame: Frame) -> Frame:
    """Through a table of its own in the shared folder, in four buckets."""
    import uuid

    from .plans import catalogue

    return catalogue.save(frame, f"frame_{uuid.uuid4().hex}", fresh(spark, "frame"), 4)


@query(w(HYPER) + f"SELECT v, t, f, {R('x', 'x')}, 31 AS days FROM hyper")
def stored_hyper(spark, sf_dir):
    """A feature stack stored as a bucketed table and opened again, with its space."""
    back = stored(spark, fx.hyper(spark, sf_dir))
    return lattice(r6(back.df.withColumn("days", F.lit(back.space.dim[3])), "x"), "t", "f")


@query(w(BOLD, ATLAS) + f"SELECT b.v, {R('CASE WHEN any_value(a.label) % 2 = 1 AND stddev_pop(x) > 0 THEN avg(x) / stddev_pop(x) ELSE 0 END', 'value')} FROM bold b JOIN atlas a USING (v) GROUP BY b.v")
def stored_tsnr(spark, sf_dir):
    """Masked temporal signal-to-noise of stored frames: no shuffle (the mask: odd labels)."""
    labels = fx.atlas(spark, sf_dir)
    mask = Frame(labels.df.where("label % 2 = 1").select("v", F.lit(True).alias("value")), labels.space, "volume", True)
    return r6(reduce.temporal_snr(stored(spark, fx.bold(spark, sf_dir)), stored(spark, mask)).df, "value")


@query(w(BOLD, ATLAS) + f"SELECT CAST(label AS BIGINT) AS label, t, {R('avg(x)', 'x')} FROM bold JOIN atlas USING (v) GROUP BY 1, 2")
def stored_parcel_means(spark, sf_dir):
    """Parcel series of stored frames: only partial sums are shuffled."""
    got = reduce.parcel_means(stored(spark, fx.bold(spark, sf_dir)), stored(spark, fx.atlas(spark, sf_dir)))
    return lattice(r6(got.df, "x"), "label", "t")


LEVELS = "l0 AS (SELECT p // 64 AS block, sha256(string_agg(cell, ',' ORDER BY p)) AS hash FROM cells GROUP BY 1), l1 AS (SELECT block // 8 AS block, sha256(string_agg(block || ':' || hash, ',' ORDER BY block)) AS hash FROM l0 GROUP BY 1), l2 AS (SELECT block // 8 AS block, sha256(string_agg(block || ':' || hash, ',' ORDER BY block)) AS hash FROM l1 GROUP BY 1) SELECT 0 AS level, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2"


@query(w(MASK, "cells AS (SELECT v AS p, CAST(v AS VARCHAR) AS cell FROM mask)").rstrip() + ", " + LEVELS)
def mask_digest_levels(spark, sf_dir):
    """Block hashes of a mask, and of 8 blocks each, twice."""
    from .plans import digests

    return lattice(digests.block_hashes(mask_of(spark, sf_dir), 64, 8, 3), "level")


@query(w(COUNTS, VDIM, "cells AS (SELECT CAST(v + t * nz * 100 AS BIGINT) AS p, CAST(v + t * nz * 100 AS BIGINT) || ':' || CAST(CAST(x AS DOUBLE) AS VARCHAR) AS cell FROM counts, vdim WHERE x <> 0)").rstrip() + ", " + LEVELS)
def series_digest_levels(spark, sf_dir):
    """Block hashes of a sparse series' cells that are not zero, whose rows were dealt anew and zeros put in."""
    from .plans import digests

    counts = fx.counts(spark, sf_dir)
    dealt = counts.like(densified(counts).df.repartition(5, "t"), sparse=False)
    return lattice(digests.block_hashes(dealt, 64, 8, 3), "level")


@query(w(BOLD) + f"SELECT t, {R('quantile_cont(x, 0.02)', 'lo')}, {R('quantile_cont(x, 0.98)', 'hi')} FROM bold GROUP BY t")
def display_limits_by_time(spark, sf_dir):
    """Robust limits of each time of a series, of stored voxels (exact quantiles by rounds of histograms)."""
    bold = fx.bold(spark, sf_dir)
    return lattice(r6(quantile.display_limits(bold.like(bold.df, sparse=False), by="t"), "lo", "hi"), "t")


@query(w(COUNTS, VDIM) + ", dense AS (SELECT coalesce(x, 0.0) AS x FROM (SELECT v, t FROM (SELECT unnest(range(0, nz * 100)) AS v FROM vdim), (SELECT unnest(range(0, 7)) AS t)) g LEFT JOIN counts USING (v, t)) SELECT q.q, round(CASE q.q WHEN 0.1 THEN a WHEN 0.5 THEN b ELSE c END, 6) + 0.0 AS value FROM (SELECT quantile_cont(x, 0.1) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.999) AS c FROM dense), (VALUES (CAST(0.1 AS DOUBLE)), (0.5), (0.999)) q(q)")
def sparse_quantiles(spark, sf_dir):
    """Of all cells of a sparse series, absent ones as zeros."""
    return r6(quantile.frame_quantiles(fx.counts(spark, sf_dir), (0.1, 0.5, 0.999)), "value")


def named_atlas(spark, sf_dir):
    from .plans import atlas

    labels = fx.atlas(spark, sf_dir)
    found = atlas.default_table(labels)
    return atlas.atlas("fixture", labels, found.select("label", "name", F.when(F.col("label") % 2 == 0, "L").otherwise("R").alias("hemi"), F.concat(F.lit("net"), F.col("label") % 3).alias("network")))


@query(w(BOLD, ATLAS) + f", s AS (SELECT v, avg(x) AS x FROM bold GROUP BY v), r AS (SELECT 'net' || (label % 3) AS network, CASE WHEN label % 2 = 0 THEN 'L' ELSE 'R' END AS hemi, CAST(label AS BIGINT) AS label, x FROM s JOIN atlas USING (v)) SELECT CAST(grouping(network) + grouping(hemi) + grouping(label) AS BIGINT) AS level, network, hemi, label, count(*) AS n, {R('avg(x)', 'mean')} FROM r GROUP BY ROLLUP (network, hemi, label)")
def atlas_rollup(spark, sf_dir):
    """Mean signal by label, network and hemisphere, network, and in all, of an atlas checked against its table."""
    from .plans import atlas

    got = atlas.rollup(named_atlas(spark, sf_dir), reduce.mean_over_time(fx.bold(spark, sf_dir)))
    return lattice(r6(got, "mean"), "level")


@query(w(BOLD, ATLAS) + f"SELECT CAST(label AS BIGINT) AS label, 'parcel_' || label AS name, t, {R('avg(x)', 'x')} FROM bold JOIN atlas USING (v) GROUP BY 1, 2, 3")
def atlas_parcel_series(spark, sf_dir):
    from .plans import atlas

    return lattice(r6(atlas.parcel_series(named_atlas(spark, sf_dir), fx.bold(spark, sf_dir)), "x"), "t")


@query(w(BOLD) + f"SELECT CAST(t // 10 AS BIGINT) AS chunk, count(*) AS n, {R('sum(x)', 'total')}, min(t) AS first, max(t) AS last FROM bold GROUP BY 1")
def chunk_sums(spark, sf_dir):
    """A function with state over chunks of ten times, by a table function partitioned by chunk."""
    class Sums:
        def __init__(self, chunk):
            self.n, self.total, self.first, self.last = 0, 0.0, None, None

        def add(self, t, v, x):
            self.n, self.total = self.n + len(x), self.total + float(x.sum())
            self.first, self.last = int(t[0]) if self.first is None else self.first, int(t[-1])

        def rows(self):
            return [(self.n, self.total, self.first, self.last)]

    got = chunks.process_chunks(fx.bold(spark, sf_dir), Sums, "n long, total double, first long, last long", 10)
    return r6(got, "total")


BALLS = f"spots AS (SELECT v, {VIJK} FROM mask), laid AS (SELECT v AS center, sqrt(dx * dx + dy * dy + dz * dz) AS far, dx, dy, dz FROM spots, o, vdim WHERE i + dx BETWEEN 0 AND 9 AND j + dy BETWEEN 0 AND 9 AND k + dz BETWEEN 0 AND nz - 1)"


@query(w(MASK, VDIM, near(2, "dx * dx + dy * dy + dz * dz <= 4"), BALLS) + "SELECT center, count(*) AS n, CAST(sum(dx * dx + 3 * dy * dy + 5 * dz * dz) AS BIGINT) AS moment FROM laid WHERE power(dx * 2.5, 2) + power(dy * 1.0, 2) + power(dz * 3.0, 2) <= 16 GROUP BY 1")
def ellipsoid_regions(spark, sf_dir):
    """Ellipsoidal neighbourhoods of all mask voxels."""
    mask = mask_of(spark, sf_dir)
    return moments(mask, shapes.ellipsoid_regions(mask.df.select("v"), mask.space, 4.0, (2.5, 1.0, 3.0)))


@query(w(MASK, VDIM, near(2, "dx * dx + dy * dy + dz * dz <= 4"), BALLS) + ", e AS (SELECT center, quantile_cont(far, 0.7) AS edge FROM laid GROUP BY 1) SELECT center, count(*) AS n, CAST(sum(dx * dx + 3 * dy * dy + 5 * dz * dz) AS BIGINT) AS moment FROM laid JOIN e USING (center) WHERE far < edge GROUP BY 1")
def blobby_regions(spark, sf_dir):
    """Balls of all mask voxels without their whole edge (all of it is dropped, so that nothing is left to chance)."""
    mask = mask_of(spark, sf_dir)
    return moments(mask, shapes.blobby_regions(mask.df.select("v"), mask.space, 4.0, drop=1.0, edge_fraction=0.7))


def moments(mask: Frame, regions: DataFrame) -> DataFrame:
    d = [a - b for a, b in zip(mask.space.ijk(), mask.space.ijk("center"))]
    return regions.groupBy("center").agg(F.count("*").alias("n"), F.sum(d[0] * d[0] + 3 * d[1] * d[1] + 5 * d[2] * d[2]).cast("long").alias("moment"))


@query(w(SIZES, VDIM, DENSE) + f", p AS (SELECT {VIJK}, value AS z FROM dense), e AS (SELECT a.k, a.i + (20.5 - a.z) / (b.z - a.z) AS x, a.j + 0.0 AS y FROM p a JOIN p b ON a.k = b.k AND a.j = b.j AND b.i = a.i + 1 WHERE (a.z > 20.5) <> (b.z > 20.5) UNION ALL SELECT a.k, a.i + 0.0, a.j + (20.5 - a.z) / (b.z - a.z) FROM p a JOIN p b ON a.k = b.k AND a.i = b.i AND b.j = a.j + 1 WHERE (a.z > 20.5) <> (b.z > 20.5)) SELECT CAST(k AS BIGINT) AS plane, {R('x', 'x')}, {R('y', 'y')} FROM e")
def contour_points(spark, sf_dir):
    """Where the contour lines of all planes run: their points, once each (closed lines end where they began)."""
    lines = contour.contours(fx.volume(spark, sf_dir, "p_size"), 2, 20.5)
    return lattice(r6(lines.groupBy("plane", "line", "x", "y").agg(F.min("ord").alias("ord")).select("plane", "x", "y"), "x", "y"), "plane")


@query(w(BOLD, near(4, "4 * (dx * dx + dy * dy) + 9 * dz * dz <= 64")) + f", r AS (SELECT 4 + dx AS i, 4 + dy AS j, 3 + dz AS k FROM o), g AS (SELECT i + 8 * (j + 8 * k) AS v FROM r, (SELECT ceil((max(vec_id) + 1) / 64.0) AS nz FROM embeddings) WHERE i BETWEEN 0 AND 7 AND j BETWEEN 0 AND 7 AND k BETWEEN 0 AND nz - 1), s AS (SELECT t.t AS t, avg(coalesce(x, 0.0)) AS s FROM g CROSS JOIN (SELECT unnest(range(0, 64)) AS t) t LEFT JOIN bold ON bold.v = g.v AND bold.t = t.t GROUP BY t.t) SELECT v, {R('coalesce(covar_pop(x, s) / nullif(stddev_pop(x) * stddev_pop(s), 0), CAST(' + chr(39) + 'nan' + chr(39) + ' AS DOUBLE))', 'value')} FROM bold JOIN s USING (t) GROUP BY v")
def seed_ball_correlation(spark, sf_dir):
    """The mean series of an 8 mm ball, correlated with every voxel's."""
    bold = fx.bold(spark, sf_dir)
    ball = neighbor.spherical_roi(spark, bold.space, (4, 4, 3), 8.0)
    seed = select.series_roi(bold, ball).groupBy("t").agg(F.avg("x").alias("s"))
    return r6(reduce.seed_correlation(bold, seed).df, "value")


@query(w(BOLD, BDIM, ATLAS) + f", s AS (SELECT b.v, CASE WHEN any_value(a.label) % 2 = 1 AND stddev_pop(x) > 0 THEN avg(x) / stddev_pop(x) ELSE 0 END AS value FROM bold b JOIN atlas a USING (v) GROUP BY b.v) SELECT g.v, {R('coalesce(value, 0)', 'value')}, 'temporal_snr' AS method, true AS same_mask FROM (SELECT unnest(range(0, nz * 64)) AS v FROM bdim) g LEFT JOIN s USING (v)")
def receipt_across_files(spark, sf_dir):
    """A masked map written to a file and read again, with what its receipt says: the method, and that the mask is the one at hand."""
    from .plans import digests
    from .sources import images, nifti

    labels, path = fx.atlas(spark, sf_dir), fresh(spark, "map.nii")
    mask = digests.sealed(Frame(labels.df.where("label % 2 = 1").select("v", F.lit(True).alias("value")), labels.space, "volume", True))
    nifti.write(reduce.temporal_snr(fx.bold(spark, sf_dir), mask), path, "f8")
    back = images.read_image(spark, path)
    again = digests.frame_digest(mask.like(mask.df.repartition(3)))
    return r6(back.df.select("v", "value", F.lit(back.receipt.method_name).alias("method"), F.lit(back.receipt.mask_hash == again).alias("same_mask")), "value")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM events GROUP BY 1, 2")
def daily_windows(spark, sf_dir):
    from .streaming.windows import tumbling

    rows = tumbling(fx.table(spark, sf_dir, "events"), "1 day", ["event_type"])
    return r6(rows.select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total"), "total")

