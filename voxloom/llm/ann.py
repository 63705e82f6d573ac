"""Approximate nearest neighbours by a permutation index.

Each vector is represented by its ``ORDER`` nearest of ``PIVOTS`` pivots, in order. The rows are spread over blocks by a
hash of their id; each block posts its vectors in one inverted file per pivot, with the pivot's place in the vector's
order. A query walks the files of its own pivots and sums each posted vector's footrule distance (a pivot that one of
both lacks counts as place ORDER), takes the ``share`` of the block that is nearest by it (``k`` rows at least), and
ranks these by exact cosine in double precision; the blocks' results are merged. Pivots are a bounded sample; every
row is indexed. Queries are a stated set, cut into groups of QUERIES, and meet every block, so no task holds more than
one block and one group. The cut is the same share of every table and every block, whatever their size.

Ties go to the smaller id everywhere. With any number of copies of one vector, a block's cut by (footrule, id) keeps the
smallest ids of them, so the result is what an exhaustive search gives for them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import shared_dir, written

PIVOTS, ORDER = 256, 64
BLOCK_ROWS, QUERIES = 4_000, 20_000


def _prepare(pivots):
    schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary()), ("places", pa.binary())])

    def run(batches):
        p = pivots.value
        for batch in batches:
            vectors = np.array([np.frombuffer(v.as_buffer(), np.float64) for v in batch.column(1)]).reshape(-1, p.shape[1])
            near = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ p.T
            order = np.argsort(-near, axis=1, kind="stable")[:, : min(ORDER, len(p))].astype(np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o.tobytes() for o in order], pa.binary())], schema=schema)

    return run


def _clean(batches):
    """Vectors as doubles, without those that are null, zero or hold null or non-finite components."""
    for batch in batches:
        ids, out = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                continue
            x = np.asarray(v.values, np.float64)
            if np.isfinite(x).all() and x.any():
                ids.append(i)
                out.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "vector"])


def _search(k: int, share: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("is_query", "ascending"), ("vec_id", "ascending")])
        is_query = table["is_query"].to_numpy()
        n = int((is_query == 0).sum())
        ids = table["vec_id"].to_numpy()
        found = {"query_id": [], "vec_id": [], "score": []}
        if n and n < len(ids):
            vectors = np.array([np.frombuffer(v, np.float64) for v in table["vector"].to_pylist()])
            norms = np.sqrt((vectors * vectors).sum(1))
            places = np.array([np.frombuffer(p, np.uint16) for p in table["places"].to_pylist()]).astype(np.int64)
            width = places.shape[1]
            # inverted files: for each pivot its postings (row, place)
            flat = places[:n].reshape(-1)
            by_pivot = np.argsort(flat, kind="stable")
            rows, place = by_pivot // width, by_pivot % width
            ends = np.searchsorted(flat[by_pivot], np.arange(PIVOTS + 1))
            cut = min(n, max(k, int(np.ceil(share * n))) + 1)  # one more: the query itself may be among them
            for q in range(n, len(ids)):
                score = np.zeros(n, np.int64)
                for i, pivot in enumerate(places[q]):
                    a, b = ends[pivot], ends[pivot + 1]
                    score[rows[a:b]] += 2 * (np.maximum(place[a:b], i) - width)
                key = score * n + np.arange(n)
                near = np.argpartition(key, cut - 1)[:cut] if cut < n else np.arange(n)
                near = near[ids[near] != ids[q]]
                cosine = (vectors[near] * vectors[q]).sum(1) / (norms[near] * norms[q])
                best = np.lexsort((ids[near], -cosine))[:k]
                found["query_id"] += [ids[q]] * len(best)
                found["vec_id"] += ids[near[best]].tolist()
                found["score"] += cosine[best].tolist()
        return pa.table({"query_id": pa.array(found["query_id"], pa.int64()), "vec_id": pa.array(found["vec_id"], pa.int64()), "score": pa.array(found["score"], pa.float64())})

    return run


def nearest_neighbours(spark: SparkSession, vectors: DataFrame, queries: str = "vec_id % 50 = 0", k: int = 5, share: float = 0.15, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row that the condition ``queries`` selects.

    Rows with a null id, or a vector that is null, empty, zero or holds null or non-finite components, take no part,
    nor do vectors of another length than most. A row that repeats another one's id takes part as a candidate of
    others, never of its own id; repeated query rows are searched once. No other column is read.
    """
    shared_dir(spark)
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    lengths = source.where("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths or not lengths[0].n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = source.where(F.size("v") == lengths[0].n).mapInArrow(_clean, "vec_id long, vector binary")
    rows = written(spark, rows, "vectors")
    total = rows.count()
    chance = min(1.0, 8.0 * PIVOTS / max(1, total))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(chance * (1 << 20)) + 1).orderBy(F.xxhash64("vec_id"), "vector").limit(4 * PIVOTS).collect()
    distinct = list(dict.fromkeys(bytes(r.vector) for r in sample))[:PIVOTS]
    if not distinct:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    p = np.array([np.frombuffer(v, np.float64) for v in distinct])
    pivots = spark.sparkContext.broadcast(p / np.linalg.norm(p, axis=1, keepdims=True))
    index = written(spark, rows.mapInArrow(_prepare(pivots), "vec_id long, vector binary, places binary"), "permutations")
    asked = index.where(queries).dropDuplicates(["vec_id"])
    blocks = -(-total // BLOCK_ROWS)
    groups = max(1, -(-asked.count() // QUERIES))
    as_rows = index.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(0).alias("is_query"), "vec_id", "vector", "places")
    as_queries = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int").alias("part"), F.lit(1).alias("is_query"), "vec_id", "vector", "places")
    met = as_rows.union(as_queries).groupBy("block", "part").applyInArrow(_search(k, share), "query_id long, vec_id long, score double")
    # equal (vec_id, score) of repeated ids count once
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.distinct().withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
