"""The pipeline's stage of near duplicates: no document is lost without another of its component."""

from test_operators import corpus, plain_join
import random

from pyspark.sql import functions as F

import corpus_pipeline as C


def words(k, n=60):
    rng = random.Random(k)
    return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))


def test_repeated_and_null_ids(spark):
    a, b = words(1), words(2)
    near = " ".join(a.split()[:-1] + ["other"])
    rows = [(1, a), (5, a), (5, b), (None, near), (None, near), (None, words(3)), (7, None), (7, None), (8, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_row": F.lit(3), "component_id": F.lit("x")})
    got = C.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sum(t in (a, near) for _, t in kept) == 1 and (5, b) in kept and (None, words(3)) in kept
    assert sum(t in (None, "") for _, t in kept) == 4 and len(kept) == 7


def test_one_of_each_component_stays(spark):
    docs = corpus(random.Random(11), families=5, copies=9)
    again = docs + [(i, t) for i, t in docs[:7]]
    df = spark.createDataFrame(again, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in C.near_duplicates(spark, df, "").collect()]
    component = {i: c for i, (n, c) in plain_join(docs, 5, 80).items()}
    blank = {i for i, (n, _) in plain_join(docs, 5, 80).items() if n == 0}
    full = [component[i] for i, _ in kept if i not in blank]
    assert len(full) == len(set(full)) and set(full) == {c for i, c in component.items() if i not in blank}
    assert sum(i in blank for i, _ in kept) == sum(i in blank for i, _ in again)


def test_empty(spark):
    assert C.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string"), "").collect() == []


def test_a_group_that_mostly_does_not_link(spark):
    """Copies of one text, a fifth of their words changed by and by: many share signatures, few link."""
    from voxloom.llm import jaccard

    rng = random.Random(4)
    base = words(9, 240).split()
    docs = []
    for k in range(150):
        own = list(base)
        for i in rng.sample(range(240), rng.choice([2, 6, 9, 12, 14])):
            own[i] = f"y{rng.randint(0, 10**6)}"
        docs.append((k, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {i: c for i, (_, c) in plain_join(docs, 5, 80).items()}
    assert {r.doc_id: r.component_id for r in jaccard.ngram_jaccard_join(spark, df, 5, 80, links=False).collect()} == want
    assert 5 < len(set(want.values())) < 150
