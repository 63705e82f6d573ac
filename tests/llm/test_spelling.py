"""Spelling variants against a plain version, and on nulls, ties, long words, runs of one letter and empty tables."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from voxloom.llm import spelling
from voxloom.llm.queries import op12_spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def edits(w, letters):
    for i in range(len(w) + 1):
        for x in letters:
            yield w[:i] + x + w[i:]
            if i < len(w):
                yield w[:i] + x + w[i + 1 :]
        if i < len(w):
            yield w[:i] + w[i + 1 :]


def plain_words(docs, least, shortest, slip):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if k >= least and len(w) >= shortest}


def plain(docs, least=3, shortest=5, slip=97):
    words = plain_words(docs, least, shortest, slip)
    letters = {x for w in words for x in w}
    form, about = {}, {}
    for w, n in words.items():
        about[w] = {c for c in edits(w, letters) if c in words and c != w}
        best = min(about[w], key=lambda c: (-words[c], c), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(about[w]), form[w], words.get(form[w]), root))
    return out


def corpus(rng, n=60):
    base = ["".join(rng.choice("abéàÿzab×") for _ in range(rng.choice([4, 5, 6, 7, 12]))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "Ébène", "ébène"]
    docs = []
    for i in range(n):
        words = []
        for _ in range(rng.choice([0, 1, 30, 200])):
            w = rng.choice(base)
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abzé") + w[k:], w[:k] + rng.choice("abzé") + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice([" ", "1", "\n_"]).join(words)))
    return docs + [(None, "aaaaa aaaaa"), (None, None), (3, ""), (3, "aaaaaa " * 3), (3, "aaaaaa " * 3)]


@pytest.mark.parametrize("block,asked,slip", [(spelling.BLOCK, spelling.ASKED, 5), (40, 25, 97)])
def test_variants_against_plain(spark, monkeypatch, block, asked, slip):
    """In one range, and in many that their words are dealt to in parts."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "ASKED", asked)
    docs = corpus(random.Random(block))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1)})
    got = [tuple(r) for r in spelling.spelling_variants(spark, df, slip=slip).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(docs, slip=slip)


def test_chains_long_words_and_none(spark):
    long = "xy" * 3000
    docs = [(0, " ".join([long] * 3 + [long + "y"] * 6 + ["a" * 2000] * 3 + ["a" * 2001] * 7 + ["Chain"] * 3 + ["chains"] * 6 + ["chainst"] * 12 + ["cainst"] * 24 + ["lonely"] * 5))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(spark, df).collect()}
    assert got[long] == (3, 1, long + "y", 6, long + "y")
    assert got["a" * 2000] == (3, 1, "a" * 2001, 7, "a" * 2001)
    assert got["chain"][2:] == ("chains", 6, "cainst") and got["lonely"] == (5, 0, None, None, "lonely")
    assert spelling.spelling_variants(spark, df.limit(0)).collect() == []
    assert spelling.spelling_variants(spark, spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect() == []


def test_index_finds_what_is_near():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))) for _ in range(700)})
    index = spelling.Index(sorted(w[::-1] for w in words))
    order = sorted(words, key=lambda w: w[::-1])
    import numpy as np

    q, c = spelling.near_words(index, words, np.array([len(w) // 2 for w in words]))
    got = {(words[i], order[j]) for i, j in zip(q, c)}
    assert got == {(a, b) for a in words for b in words if near(a, b) and a[: len(a) // 2] == b[: len(a) // 2]}


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in op12_spelling(spark, sf).collect()} == plain(docs)
