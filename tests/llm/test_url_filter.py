"""URL filters against a plain version, and on nulls, odd URLs, ties, copies and many rules."""

import random

import pytest
from pyspark.sql import functions as F

from voxloom.llm import common, url_filter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("Example.NET", "", "block"), ("a.b", "/x", "allow"), ("a.b", "/x", "block"), ("b", "/x/y", "block"), ("z.b", "/xy", "allow")]


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for h, p, v in rules:
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (), (len(h) + len(p), len(h), v == "block", h + p, v))
    return host, path, best and best[3], best[4] if best else default


def urls(rng, n=400):
    hosts = ["example.org", "m.example.org", "badexample.org", "x.com", "COM", "a.b", "q.a.b", "z.b", "b", "example.net", "www.Example.Net", "org", "a..org", ".org", "org.", ""]
    paths = ["", "/", "/es/", "/es/1", "/en/1", "/en/12/3", "/en/2", "/ES/", "/fr/x", "/de/", "/de", "/x", "/x/y", "/xy", "/xyz"]
    ends = ["", "?q=/es/", "#/es/", "?a://b", "#"]
    out = [None, "", "example.org/es/", "mailto:x", "://", "http://", "https://EXAMPLE.org:80/es/", "http://u@example.org/es/", "http://example.org?/es/", "a://b://c/d", "http://" + "a." * 5000 + "org/" + "p" * 100_000]
    return out + [rng.choice(["http", "https", "x"]) + "://" + rng.choice(hosts) + rng.choice(paths) + rng.choice(ends) for _ in range(n)]


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_filter_against_plain(spark, monkeypatch, most):
    """With few rows broadcast, and with none."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rows = list(enumerate(urls(random.Random(3))))
    rows += [(7, rows[40][1])] * 30 + [(None, rows[41][1])] * 3 + [(None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "part": F.lit(1), "rule": F.lit(2), "times": F.lit(9)})
    got = url_filter.filter_urls(spark, pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, *plain(u, RULES)) for i, u in rows], key=str)


def test_rules_that_fit_nothing_and_empty_tables(spark):
    kind = "host string, path string, verdict string"
    pages = spark.createDataFrame([(1, "http://a.b/x")], "page_id long, url string")
    odd = spark.createDataFrame([(None, "/", "block"), ("a.b", None, "block"), ("a.b", "/x", "deny"), ("a.b/x", "", "block"), ("a.b", "x", "block"), ("a.b", "/x?", "block")], kind)
    assert [tuple(r) for r in url_filter.filter_urls(spark, pages, odd, "block").collect()] == [(1, "a.b", "/x", None, "block")]
    assert url_filter.filter_urls(spark, pages.limit(0), spark.createDataFrame(RULES, kind)).collect() == []
    many = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".b")).alias("host"), F.concat(F.lit("/"), F.repeat(F.lit("x"), (F.col("id") % 40).cast("int"))).alias("path"), F.lit("block").alias("verdict"))
    some = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://w.h"), "id", F.lit(".b/"), F.repeat(F.lit("x"), 39)).alias("url"))
    assert url_filter.filter_urls(spark, some, many).groupBy("verdict").count().collect() == [("block", 3000)]
