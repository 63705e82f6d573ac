"""Each operator against a plain version, and on nulls, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import ann, decontam, jaccard, langid, quality, tokens, toxicity, warc
from voxloom.llm.components import components
from voxloom.llm.queries import op1_tokens, op2_nearest_neighbours, op4_warc, op6_toxicity, op10_language

SF = "/root/testdata/sf0.001"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


# --- n-gram Jaccard join


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain_join(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(rng, families=6, copies=12):
    docs = []
    for _ in range(families):
        base = words(rng, rng.choice([3, 9, 30, 120, 300])).split()
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
            docs.append(" ".join(w) if rng.random() < 0.7 else " \n".join(w).upper())
    docs += ["", " \t\n", "one", "One", "a b c", "A  B\tC", "é É", "é é"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("percent,seed", [(85, 1), (80, 2)])
def test_jaccard_against_all_pairs(spark, percent, seed):
    docs = corpus(random.Random(seed))
    k = 4 if percent == 85 else 5
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard_join(spark, df, k, percent).collect()}
    assert got == plain_join(docs, k, percent)


@pytest.mark.parametrize("block,held", [(jaccard.WITHIN, jaccard.HELD), (7, 1 << 14)])
def test_all_links_are_counted_and_listed(spark, monkeypatch, block, held):
    monkeypatch.setattr(jaccard, "WITHIN", block)
    monkeypatch.setattr(jaccard, "HELD", held)
    rng = random.Random(5)
    base = words(rng, 200).split()
    docs = corpus(rng, 3)
    docs += [(1000 + i, " ".join(base[:i] + ["y"] + base[i + 1 :])) for i in range(0, 60, 2)]
    docs += [(2000, docs[-1][1]), (1002, "one text of a doc_id that stands twice")]
    rows = {}
    for i, t in docs:
        rows.setdefault(shingles(t, 4), []).append(i)
    sets = [s for s in rows if s]
    close = [(x, y) for x, y in itertools.combinations(sets, 2) if 100 * len(x & y) >= 85 * len(x | y)]
    times = collections.Counter(s for pair in close for s in pair)
    assert max(times.values()) >= 29
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = jaccard.ngram_jaccard_join(spark, df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.n_links) for r in got) == sorted((i, len(s), times[s]) for s in rows for i in rows[s])
    pairs = [(r.a, r.b) for r in jaccard.ngram_jaccard_links(spark, df).collect()]
    assert sorted(pairs) == sorted(tuple(sorted((min(rows[x]), min(rows[y])))) for x, y in close)


def test_shared_items_of_blocks(monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 7)
    rng = np.random.default_rng(8)
    for size, kinds in ((1, 5), (5, 40), (30, 60), (40, 4000)):
        sets = [np.unique(rng.integers(1, kinds, rng.integers(1, 50)).astype(np.uint64)) for _ in range(2 * size)]
        for left, right in ((sets, sets), (sets[:size], sets[size:])):
            got = np.concatenate([same for _, same in jaccard._shared(left, right)])
            assert got.tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]


def test_signatures_meet_for_every_close_pair():
    rng = np.random.default_rng(3)
    for frequent in (0, 1, 10**9):
        for _ in range(150):
            n = int(rng.integers(6, 400))
            base = rng.integers(1, 1 << 62, n, dtype=np.uint64)
            drop = int(rng.integers(0, n // 7 + 1))
            other = np.unique(np.concatenate([base[drop // 2 :], rng.integers(1, 1 << 62, drop // 2, dtype=np.uint64)]))
            base = np.unique(base)
            same = len(np.intersect1d(base, other))
            if 100 * same < 85 * (len(base) + len(other) - same):
                continue
            counts = rng.integers(0, 3, jaccard.SLOTS)
            a, b = (np.concatenate(jaccard.signatures(x, counts, frequent, 85)) for x in (base, other))
            assert len(np.intersect1d(a, b)), (n, drop, frequent)


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(5, None, 1), (4, "", 1), (None, "a b c d e f", 1), (3, "a b c d e f", 1), (3, "a b c d e f", 1), (9, "a b c d e f", 1)], "doc_id long, text string, n long")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard_join(spark, df).collect())
    assert got == [(0, 3, None), (3, 3, 3), (3, 3, 3), (4, 0, 4), (5, 0, 5), (9, 3, 3)]
    assert jaccard.ngram_jaccard_join(spark, df.where("false")).collect() == []


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {r.id: r.component for r in components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}


# --- token ids


def test_ranks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = rng.choice(np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32), n)
        control, data = tokens.pack_ranks(ranks)
        assert len(control) == -(-n // 4) and (tokens.unpack_ranks(control, data, n) == ranks).all()


def test_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    start = 0
    got = op1_tokens(spark, SF).orderBy("doc_id").collect()
    assert len(got) == len(docs)
    for d, g in zip(docs, got):
        ids = np.array([*plain.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_pieces_encode_as_whole_texts():
    import public_tokenizers

    encoder = tokens.Encoder(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    rng = random.Random(2)
    texts = ["".join(rng.choice("a b \n\t'sé.,1!<|endoftext|>　中") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["x <|endoftext|> y", "", " ", "a.\nB c, d"]
    for t, got in zip(texts, encoder.batch(texts)):
        assert np.frombuffer(got, encoder.type).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_edges(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(2, None, 0), (None, "b", 0), (1, "a b", 0), (1, "a", 0)], "doc_id long, text string, ids long")
    tokens.encode_corpus(spark, df, path, f"file://{tmp_path}/t")
    rows = sorted(tokens.read_corpus(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids[-1]) for r in rows] == [(None, 0, 2, 2), (1, 2, 2, 2), (1, 4, 3, 2), (2, 7, 1, 2)]
    tokens.encode_corpus(spark, df.where("false"), path, f"file://{tmp_path}/e")
    assert tokens.read_corpus(spark, f"file://{tmp_path}/e").collect() == []


# --- nearest neighbours


def plain_neighbours(rows, queries, k):
    out = {}
    for q in queries:
        x = np.array(rows[q], float)
        found = sorted((-(np.dot(x, v) / np.sqrt(np.dot(x, x) * np.dot(v, v))), i) for i, v in rows.items() if i != q)
        out[q] = [i for _, i in found[:k]]
    return out


def test_neighbour_recall(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = op2_nearest_neighbours(spark, SF).orderBy("query_id", "rank").collect()
    want = plain_neighbours(rows, [i for i in rows if i % 50 == 0], 5)
    hits = sum(r.vec_id in want[r.query_id] for r in got)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for r in got[:20]:
        x, y = rows[r.query_id], rows[r.vec_id]
        assert r.score == pytest.approx(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)), abs=1e-12)


def test_neighbour_edges(spark):
    nan = float("nan")
    rows = [(i, [1.0, 2.0], 0) for i in range(0, 9)] + [(50, [1.0, 2.0], 0), (51, [0.0, 0.0], 0), (52, None, 0), (53, [nan, 1.0], 0), (54, [None, 1.0], 0), (55, [2.0, 1.0], 0), (None, [1.0, 1.0], 0), (56, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest_neighbours(spark, df).orderBy("query_id", "rank").collect()]
    assert got == [(0, n + 1, i) for n, i in enumerate([1, 2, 3, 4, 5])] + [(50, n + 1, i) for n, i in enumerate([0, 1, 2, 3, 4])]
    two = ann.nearest_neighbours(spark, df.where("vec_id in (50, 55)")).collect()
    assert [(r.query_id, r.vec_id) for r in two] == [(50, 55)]
    assert ann.nearest_neighbours(spark, df.where("false")).collect() == []
    assert ann.nearest_neighbours(spark, df.where("vec_id in (51, 52, 53)")).collect() == []


# --- WARC


def plain_archive(rows):
    first = {}
    for i, html in rows:
        b = (html or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, html in rows:
        b = (html or "").encode()
        to = first.get(b)
        revisit = to is not None and i != to
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def test_warc(spark, tmp_path):
    long = "é" * 100_000 + "\r\nWARC/1.1\r\n\r\n"
    rows = [(3, "x" * 120), (1, "x" * 120), (2, "y" * 99), (4, "y" * 99), (5, None), (6, ""), (7, long), (8, long), (8, "x" * 120), (None, "x" * 120), (9, "\r\n\r\n")]
    df = spark.createDataFrame([(i, f"http://a/{i}\n b", h, "z") for i, h in rows], "page_id long, url string, html string, payload string")
    warc.write_warc(spark, df, f"file://{tmp_path}/w")
    chunks = warc.read_warc(spark, f"file://{tmp_path}/w")
    got = [tuple(r) for r in warc.archived(chunks).collect()]
    assert sorted(got, key=key) == sorted(plain_archive(rows), key=key)
    stored = chunks.where("page_id = 7").orderBy("chunk_no").collect()
    assert len(stored) > 1 and b"".join(bytes(r.chunk) for r in stored) == long.encode()
    at = hashlib.sha256()
    for r in stored:
        at.update(bytes(r.chunk))
        assert r.digest == at.hexdigest()
    warc.write_warc(spark, df.where("false"), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").collect() == []


def test_warc_query(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted(tuple(r) for r in op4_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == sorted(plain_archive(rows))


# --- decontamination


def plain_codes(text):
    raw = [t for t in re.split(r"[^\w.!?]+|_|(?<=[0-9])(?=[^\W\d_])", text or "") if t.rstrip(".!?")]
    out, values = [], []
    for t in raw:
        core = t.rstrip(".!?")
        low = core.lower()
        if re.fullmatch(r"[0-9.]+", core):
            c = 1
        elif low in decontam.UNITS:
            c = 2
        elif len(core) > 1 and core[0] != low[0] and core[1] == low[1]:
            c = 3
        else:
            c = low
        if c in (1, 3) and out and out[-1] == c:
            values[-1] += " " + low
        else:
            out.append(c)
            values.append(low)
    return out, values


def plain_words(text):
    low = [t.rstrip(".!?").lower() for t in re.split(r"[^\w.!?]+|_|(?<=[0-9])(?=[^\W\d_])", text or "") if t.rstrip(".!?")]
    return low, low


def plain_leaks(docs, items, window=8, least=3, coverage=0.5, enough=12, slack=1):
    leaks = set()
    for i, item in items:
        for codes_of in (plain_codes, plain_words):
            codes, values = codes_of(item)
            n = min(window, len(codes))
            own = {a: tuple(codes[a : a + n]) for a in range(len(codes) - n + 1) if n and sum(isinstance(c, str) for c in codes[a : a + n]) >= least}
            if own:
                break
        for d, text in docs:
            dc, dv = codes_of(text)
            places = {}
            for p in range(len(dc) - n + 1):
                places.setdefault(tuple(dc[p : p + n]), []).append(p)
            shifts = {}
            for a, h in own.items():
                for p in places.get(h, ()):
                    shifts.setdefault(p - a, set()).add(a)
            covered = set()
            for s, ats in shifts.items():
                slots = {x for a in ats for x in range(a, a + n) if not isinstance(codes[x], str)}
                pairs = {(values[x], dv[x + s]) for x in slots}
                if len(pairs) - min(len({a for a, _ in pairs}), len({b for _, b in pairs})) <= slack:
                    covered |= ats
            if covered and (len(covered) >= coverage * len(own) or len(covered) >= enough):
                leaks.add((d, i))
    return leaks


def test_leaks_against_plain_version(spark):
    items = [
        (1, "A train from Berlin travels 120 km in 2 hours. How far does Anna go in 5 hours at that speed?"),
        (2, "short item of five"),
        (3, "12 34 56"),
        (4, None),
        (5, "Mix 3 kg of flour with 2 liters of milk and 4 eggs, then wait 30 minutes before baking it."),
        (6, "Alice has 3 apples. Alice buys 5 more apples. How many apples does Alice have now?"),
        (7, "A bus leaves New York with 1,234 passengers and drives 5km to the next stop where 7 people get off."),
        (8, "What is 12 + 7?"),
        (9, "Yes"),
    ]
    rng = random.Random(7)
    filler = [words(rng, 40) for _ in range(6)]
    docs = [
        (10, f"{filler[0]} {items[0][1]} {filler[1]}"),
        (11, f"{filler[2]}. A train from Paris travels 90 miles in 3 minutes. How far does Tom go in 7 minutes at that speed? {filler[3]}"),
        (12, f"{filler[4]} short item of five {filler[5]}"),
        (13, "12 34 56 78"),
        (14, None),
        (15, ""),
        (16, "mix 9 g of flour with 7 ml of milk and 1 eggs, then wait 8 hours before baking it"),
        (17, "Mix 9 kg of flour with 9 liters of milk and 9 eggs, then wait 9 minutes before baking it."),
        (18, " ".join(filler)),
        (19, items[0][1] + " " + items[0][1]),
        (20, f"{filler[0]} Brenda has 7 apples. Brenda buys 9 more apples. How many apples does Brenda have now?"),
        (21, f"{filler[1]} a bus leaves Paris with 950 passengers and drives 12 km to the next stop where 30 people get off. {filler[0]}"),
        (22, f"{filler[2]} what is 12 + 7? {filler[3]}"),
        (23, "What is 12 + 8? Yes, twenty."),
        (24, "The train leaves at 5. Alice has 3 pears and the apples. How is it now?"),
    ]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id long")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id): r for r in decontam.benchmark_leaks(spark, d, b).collect()}
    assert set(got) == plain_leaks(docs, [i for i in items if i[1]])
    assert {(10, 1), (11, 1), (12, 2), (13, 3), (16, 5), (19, 1), (20, 6), (21, 7), (22, 8)} <= set(got) and (17, 5) not in got
    assert not {x for x, _ in got} & {18, 23, 24}
    assert got[10, 1].verbatim and not got[11, 1].verbatim
    kept = decontam.remove_leaks(spark, d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted({x for x, _ in docs} - {x for x, _ in got})
    assert decontam.benchmark_leaks(spark, d.where("false"), b).collect() == []
    assert decontam.benchmark_leaks(spark, d, b.where("false")).collect() == []


# --- models


def accuracy(pairs):
    return sum(a == b for a, b in pairs) / max(1, len(pairs))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op6_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    own = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert accuracy(own) > 0.85


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(5)
    y = rng.random(20000) < 0.2
    right = [0.95, 0.9, 0.8, 0.9]
    v = np.stack([np.where(rng.random(len(y)) < a, y, ~y) for a in right], 1)
    v[:, 3] = v[:, 1]  # one voter repeats another
    rows, counts = np.unique(np.where(v, 1, -1), axis=0, return_counts=True)
    post, accuracy_, correlation = toxicity.label_model(rows, counts, 0.2)
    assert np.abs(accuracy_[:3] - right[:3]).max() < 0.05 and correlation[1, 3] > 0.9
    known = {r.tobytes(): p for r, p in zip(rows, post)}
    guess = np.array([known[np.where(x, 1, -1).tobytes()] > 0.5 for x in v])
    assert (guess == y).mean() > 0.93


def test_models_on_edges(spark):
    df = spark.createDataFrame([(1, None, "en", 0.0), (2, "", None, 0.0), (None, "idiot moron scum", "en", 0.0), (2, "12 34 !!", "de", 0.0), (3, "the cat", "en", 0.0), (3, "the cat", "en", 0.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(1, 0, 1), (None, 1, 1), (3, None, None), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.where("false")):
        rows = toxicity.score_toxicity(spark, df, l).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.keep_clean(spark, df, l).columns == df.columns
        assert toxicity.score_toxicity(spark, df.where("false"), l).collect() == []
    rows = quality.score_quality(spark, df).collect()
    assert len(rows) == 6 and all(not r.keep and r.score == 0 for r in rows if r.doc_id == 1)
    assert quality.score_quality(spark, df.where("false")).collect() == []
    rows = langid.identify_language(spark, df).collect()
    assert len(rows) == 6 and sorted(r.lang_pred for r in rows if r.doc_id in (1, 2)) == ["und"] * 3
    assert langid.identify_language(spark, df.where("false")).collect() == []
    untaught = langid.identify_language(spark, df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in untaught} == {"und"}


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = quality.score_quality(spark, spark.read.parquet(f"{sf}/documents.parquet")).collect()
    own = [(int(r.keep), truth[r.doc_id]) for r in got if r.doc_id in truth]
    assert accuracy(own) > 0.85
    assert sum(k for k, t in own if t == 1) >= 0.97 * sum(t for _, t in own)


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op10_language(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert accuracy([(r.lang_pred, truth[r.doc_id]) for r in got if r.held_out]) > 0.97


def plain_profile(text):
    chars = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    if not chars.strip():
        return []
    counts = collections.Counter(chars[i : i + n] for n in (1, 2, 3) for i in range(len(chars) - n + 1))
    counts.pop(" ", None)

    def code(gram):
        out = 0
        for c in gram:
            out = out << 21 | (langid.BLANK if c == " " else ord(c))
        return out

    return [code(g) for g in sorted(counts, key=lambda g: (-counts[g], code(g)))[: langid.MOST]]


def test_profiles_against_counting():
    rng = random.Random(3)
    for _ in range(20):
        text = "".join(rng.choice("abc\u00e9 XY,z \u4e00\u0434") for _ in range(rng.randint(0, 60)))
        assert langid.profile(text).tolist() == plain_profile(text)


def test_languages_against_plain_distances(spark):
    rng = random.Random(4)
    vocabularies = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(40)] for lang, letters in (("x", "abcde"), ("y", "cdefg"), ("z", "\u0430\u0431\u0432\u0433"))}
    docs = [(i, lang, " ".join(rng.choice(vocabularies[lang]) for _ in range(rng.randint(1, 60)))) for i, lang in enumerate(rng.choices(list(vocabularies), k=60))]
    taught = collections.defaultdict(collections.Counter)
    for i, lang, text in docs:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            chars = " " + text + " "
            taught[lang].update(g for n in (1, 2, 3) for g in (chars[j : j + n] for j in range(len(chars) - n + 1)) if g != " ")

    def code(gram):
        out = 0
        for c in gram:
            out = out << 21 | (langid.BLANK if c == " " else ord(c))
        return out

    ranks = {lang: {code(g): r for r, g in enumerate(sorted(c, key=lambda g: (-c[g], code(g)))[: langid.MOST])} for lang, c in taught.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_language(spark, spark.createDataFrame(docs, "doc_id long, lang string, text string")).collect()}
    for i, _, text in docs:
        own = plain_profile(text)
        away = {lang: sum(abs(known[g] - r) if g in known else langid.MOST for r, g in enumerate(own)) for lang, known in ranks.items()}
        best = min(sorted(away), key=away.get)
        assert got[i] == (best, pytest.approx(1 - away[best] / (langid.MOST * len(own))))


def test_recall_where_the_cut_decides(spark):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(60, 32))
    x = np.concatenate([centers[rng.integers(0, 60, 9000)] + rng.normal(size=(9000, 32)) * 0.7, np.repeat(rng.normal(size=(1, 32)), 1000, 0)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest_neighbours(spark, df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 10000, 50):
        near = np.round(u @ u[q], 12)
        near[q] = -9
        want = np.lexsort((np.arange(10000), -near))[:5]
        hits += sum((q, int(v)) in got for v in want)
        total += 5
    assert len(got) == total and hits >= 0.9 * total


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    text = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    spec = json.loads(text)
    assert tokens.breaks_before_spaces(text)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "use_regex": False}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}):
        other = json.dumps({**spec, **change})
        assert not tokens.breaks_before_spaces(other)
        encoder = tokens.encoder_of(other)
        texts = ["A word, another. And so", "  two  spaces \n and lines\n", "", "x"]
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(b, encoder.type).tolist() for b in encoder.batch(texts)] == want


def test_scripts_beyond_the_frequent_letters_are_told_apart(spark):
    rng = random.Random(6)
    scripts = {"zh": [chr(0x4E00 + i) for i in range(90)], "ko": [chr(0xAC00 + i) for i in range(90)], "ja": [chr(0x3041 + i) for i in range(80)], "en": list("abcdefghijklmnopqrstuvwxyz"), "xx": [chr(c) for c in range(0xE0, 0x17F) if chr(c).isalpha()]}
    docs = [(i, lang, "".join(rng.choice(scripts[lang]) + " " * (rng.random() < 0.2) for _ in range(60 if lang in ("zh", "ko", "ja") else 400))) for i, lang in enumerate(list(scripts) * 24)]
    got = langid.identify_language(spark, spark.createDataFrame(docs, "doc_id long, lang string, text string")).collect()
    assert any(r.held_out for r in got) and all(r.lang_pred == docs[r.doc_id][1] for r in got)
    grams = langid.profile("a\u4e00 b")
    assert len(grams) == len(set(grams.tolist())) == 3 + 5 + 4


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = C.table(spark, SF, "documents")
    before = docs.count()
    for name, stage in C.STAGES[:-1]:
        out = C.written(spark, stage(spark, docs, SF), f"test-{name}")
        assert out.columns == docs.columns and out.count() <= docs.count()
        docs = out
    assert docs.count() > 0.6 * before
    ids = {r.doc_id for r in docs.collect()}
    found = jaccard.ngram_jaccard_join(spark, docs, 5, 80).collect()
    assert all(r.doc_id == r.component_id for r in found)
    assert decontam.benchmark_leaks(spark, docs, C.table(spark, SF, "benchmark")).collect() == []
    packed = C.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == ids
