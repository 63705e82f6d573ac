"""Cross-tokenizer alignment against a plain version that encodes whole texts, and on odd texts, copies and empty tables."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from voxloom.llm import alignment
from voxloom.llm.queries import op13_alignment

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = alignment.byte_level()
    by_id = {k: bytes(table[c] for c in t) for t, k in a.get_vocab(with_added_tokens=False).items()}
    found, held = [], collections.Counter()
    for i, text in docs:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_a = [by_id[k] for k in ids_a]
        raw_b = [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x(..)>", p)) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            found.append((i, 0, 0, 0, [], ""))
            continue
        spans = []
        for raw in (raw_a, raw_b):
            at, out = 0, []
            for x in raw:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links, first = [], 0
        for (s, e), k in zip(spans[0], ids_a):
            while spans[1][first][1] <= s:
                first += 1
            j = first
            while j < len(ids_b) and spans[1][j][0] < e:
                links.append((k, ids_b[j]))
                j += 1
        held.update(set(links))
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, u, v = [], 0, 0
        for end in ends:
            x, y = u, v
            while x < len(ids_a) and spans[0][x][1] <= end:
                x += 1
            while y < len(ids_b) and spans[1][y][1] <= end:
                y += 1
            groups.append(",".join(map(str, ids_a[u:x])) + "|" + ",".join(map(str, ids_b[v:y])))
            u, v = x, y
        found.append((i, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [(i, na, nb, g, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), sha) for i, na, nb, g, links, sha in found]


def corpus(rng):
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéßœ") for _ in range(rng.randint(1, 12))) for _ in range(150)] + ["Hello", "don't", "I'm", "12345", "日本語", "naïve", "🎉🎉", "<|endoftext|>", "<s>", "</s>", "<0x41>", "...", "--", "/usr/bin", "x=1;", "{\r"]
    gaps = [" "] * 30 + ["  ", "   ", "\n", "\n\n", " \n", "\n ", "\t", " \t ", "\r\n", "\xa0", "　", "  ", "\x1c", "\x00", "\x85 ", ""]
    docs = [(i, "".join(x for _ in range(rng.choice([1, 3, 40, 300])) for x in (rng.choice(words), rng.choice(gaps)))) for i in range(80)]
    odd = ["", None, " ", "  ", "\n", "\t", " a", "a ", "a  ", "\na", "a\n", " \n a \n ", "a▁b", "▁", "ﬁ ½ Å", "é", "<unk>", "a\x1c b", "!\x1c x", "; \r x", ";\r x", "\r\r\n  x", "x" * 500, " " * 70, "\n" * 40, "ab " * 400]
    docs += [(1000 + k, t) for k, t in enumerate(odd)]
    return docs + [docs[3], docs[3], (None, docs[4][1]), (None, docs[4][1]), (7, None)]


@pytest.mark.parametrize("chunk,once,known,piece,places", [(alignment.CHUNK, alignment.AT_ONCE, alignment.KNOWN, alignment.PIECE, alignment.PLACES), (900, 250, 40, 60, 6)])
def test_alignment_against_plain(spark, monkeypatch, chunk, once, known, piece, places):
    """As it is, and with small chunks, merges, pieces and caches (tasks run in this process's children: by closure)."""
    docs = corpus(random.Random(chunk))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"chunk": F.lit("clash"), "pair": F.lit(1)})
    small = {"CHUNK": chunk, "AT_ONCE": once, "KNOWN": known, "PIECE": piece, "PLACES": places, "LOOKED_UP": 50 if chunk < 1000 else alignment.LOOKED_UP}
    build = alignment._build

    def build_small(shared):
        def run(batches):
            for k, v in small.items():
                setattr(alignment, k, v)
            yield from build(shared)(batches)

        return run

    monkeypatch.setattr(alignment, "_build", build_small)
    monkeypatch.setattr(alignment, "PLACES", places)
    got = alignment.align_tokenizers(spark, df, JSON, MODEL)
    assert sorted((tuple(r[n] for n in NAMES) for r in got.collect()), key=str) == sorted(plain(docs), key=str)


def test_pair_counts_and_planes(spark):
    docs = [(0, "one two one two one"), (1, "one"), (2, "two two"), (3, "one " * 700), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = alignment.pair_index(spark, df, JSON, MODEL)
    rows = {(r.a, r.b): r for r in alignment.pair_counts(index).collect()}
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(JSON).encode(" one").ids[0]
    ours = [r for (a, _), r in rows.items() if a == one]
    assert [(r.documents, r.links, r.best) for r in ours] == [(3, 3 + 1 + 700, True)]


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_tokenizers(spark, df, JSON, MODEL).collect() == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r[n] for n in NAMES) for r in alignment.align_tokenizers(spark, only, JSON, MODEL).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op13_alignment(spark, sf).collect()
    assert sorted((tuple(r[n] for n in NAMES) for r in got), key=str) == sorted(plain(docs), key=str)
