"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, decontam, jaccard, langid, packing, quality, secret_scan, spelling, tokens, toxicity, url_filter, warc
from .common import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = scratch(spark, "tokens")
    tokens.encode_corpus(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out, end_id=2)
    return tokens.read_corpus(spark, out, digest=True)


@query
def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(spark, table(spark, sf_dir, "embeddings"), queries="vec_id % 50 = 0", k=5)


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard_join(spark, table(spark, sf_dir, "documents"), width=4, percent=85)


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    warc.write_warc(spark, table(spark, sf_dir, "pages"), out)
    return warc.archived(warc.read_warc(spark, out, payload=False))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.benchmark_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7, folds=3, fold=1)


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(spark, table(spark, sf_dir, "documents"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(spark, table(spark, sf_dir, "documents"))


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(spark, table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("findings", lambda x: (x.kind == kind) & (x.depth == 0))).cast("long").alias(f"n_{kind}")

    def spans(findings):
        return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")

    base = F.filter("findings", lambda x: x.depth == 0)
    return found.select("doc_id", *(count(k) for k in secret_scan.KINDS), F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans"))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_language(spark, table(spark, sf_dir, "documents"), folds=4, fold=2)


#: host, path and verdict of the rules of op11_url_filter.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark, table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spark, table(spark, sf_dir, "documents"), least=3, shortest=5, slip=97)


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align_tokenizers(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


ORACLE_SQL["op11_url_filter"] = f"""
WITH rules(r_host, r_path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
r AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS n FROM pages
), u AS (
  SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r
), f AS (
  SELECT n, r_host || r_path AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(r_host) + length(r_path) DESC, length(r_host) DESC, verdict DESC) AS k
  FROM u JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (n)
"""

ORACLE_SQL["op4_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), f AS (
  SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest,
       CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h AND p.n >= 100
"""
