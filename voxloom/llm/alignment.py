"""Cross-tokenizer alignment: two tokenizers' tokens of one text, linked where their bytes overlap, scored by inverted pair bitmaps.

Both tokenizers break where a space or line end follows another character, so a text is cut there into units, and a
unit's tokens, groups and links are found once for all its places. An id pair is the link of an id of one with an id of
the other. The corpus is read in chunks of about CHUNK links; for each chunk the index holds, for each pair,

* the bitmap of documents (places in the chunk) that hold the pair, as sorted 16-bit places (the array container of a
  compressed bitmap), OR-merged over the pieces that a chunk is read in;
* multiplicity planes: bit k of plane k says, for each document of the bitmap, whether 2^k counts towards how often the
  document holds the pair, less one. A pair's links are its documents and 2^k for each bit of plane k.

Popcounts of the chunks' bitmaps, summed, are the pairs' document counts; the largest of each first id is known by one
aggregation. Counts go back to each chunk (joined on the pair), whose postings return scores to its documents. The
index is written to the shared folder. No task holds more than one chunk and no pair's postings are gathered.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, written
from .tokens import breaks_before_spaces

CHUNK = 3_000_000
#: Documents of a chunk have places of 16 bits.
PLACES = 1 << 16
#: Links that are sorted at once, and characters of a text that are cut into units at once.
AT_ONCE, PIECE = 1_500_000, 1 << 20
#: When a Python worker knows more units than these, it forgets those that it met least, more than half of them.
KNOWN = 600_000
#: Units of documents that are looked up together.
LOOKED_UP = 1 << 16

# What both tokenizers' patterns hold for white space (Unicode's White_Space).
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ODD = re.compile("[\\t\\x0b\\x0c\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_UNITS = re.compile("[ \n]*[^ \n]+|[ \n]+")
_CUT = re.compile(f"(?<=[^{_SPACE}])(?=[ \n])")
_BYTE = re.compile("<0x([0-9A-F]{2})>")
BLANK = "\u2581"


def byte_level() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Aligner:
    """Units of texts with their tokens by both tokenizers, aligned; the latest units are kept."""

    def __init__(self, json_text: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(json_text)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        table = byte_level()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(BLANK, " ").encode() for p in pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        # pieces that join a character and a space or line end behind it would reach across units
        self.cuts = breaks_before_spaces(json_text) and not any(re.search(f"[^{_SPACE}{BLANK}][ \n{BLANK}]", p) for p in pieces)
        if len(self.a_bytes) > 1 << 23 or len(self.b_bytes) > 1 << 24:
            raise ValueError("a pair of ids takes more than 47 bits")
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.numbers = np.zeros((1024, 5), np.int64)  # tokens of A and B, groups, links; 1 if the bytes of both are the unit's
        self.first = np.zeros(1024, np.int64)  # where a unit's links begin in pairs
        self.met = np.zeros(1024, np.int64)
        self.pairs, self.n_pairs = np.empty(1 << 14, np.int64), 0

    def forget(self) -> None:
        """All but the units met most, at most half of KNOWN."""
        n = len(self.groups)
        met = self.met[:n]
        keep = np.flatnonzero(met > (np.partition(met, n - KNOWN // 2 - 1)[n - KNOWN // 2 - 1] if n > KNOWN // 2 else -1))
        number = np.full(n, -1)
        number[keep] = np.arange(len(keep))
        place = number.tolist()
        self.known = {u: place[k] for u, k in self.known.items() if place[k] >= 0}
        self.groups = [self.groups[k] for k in keep.tolist()]
        pairs = self.links(keep)
        self.pairs, self.n_pairs = pairs.copy(), len(pairs)
        self.numbers, self.met = self.numbers[keep], self.met[keep]
        count = self.numbers[:, 3]
        self.first = np.cumsum(count) - count

    def links(self, units: np.ndarray) -> np.ndarray:
        """The pairs of all links of units, one behind the other."""
        count = self.numbers[units, 3]
        ends = np.cumsum(count)
        return self.pairs[np.repeat(self.first[units] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _room(self, units: int, pairs: int) -> None:
        while len(self.numbers) < len(self.groups) + units:
            more = max(1024, len(self.numbers))
            self.numbers = np.concatenate((self.numbers, np.zeros((more, 5), np.int64)))
            self.first, self.met = (np.concatenate((x, np.zeros(more, np.int64))) for x in (self.first, self.met))
        while len(self.pairs) < self.n_pairs + pairs:
            self.pairs = np.concatenate((self.pairs, np.empty(max(1 << 14, len(self.pairs)), np.int64)))

    def units(self, text: str) -> list[str]:
        """``text`` cut into units."""
        if not self.cuts:
            return [text]
        return _CUT.split(text) if _ODD.search(text) else _UNITS.findall(text)

    def learn(self, units: list[str]) -> None:
        new = list(dict.fromkeys(u for u in units if u not in self.known))
        # units that begin and end like words stand behind each other as in a text; each other one alone
        joint = [u for u in new if u[0] in " \n" and not u[-1].isspace()] if self.cuts else []
        for at in range(0, len(joint), 4096):
            self._learn(joint[at : at + 4096])
        for u in new:
            if u not in self.known:
                self._learn([u])

    def _tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids_a = self.a.encode(text, add_special_tokens=False).ids
        # the second adds a space of its own; what does not begin with one is encoded behind a letter
        ids_b = self.b.encode(text[1:]) if text[0] == " " and len(text) > 1 else self.b.encode("a" + text)[1:]
        return np.array(ids_a, np.int64), np.array(ids_b, np.int64)

    def _learn(self, new: list[str]) -> None:
        text = "".join(new)
        ids_a, ids_b = self._tokens(text)
        ok = b"".join([self.a_bytes[k] for k in ids_a.tolist()]) == (raw := text.encode()) and b"".join([self.b_bytes[k] for k in ids_b.tolist()]) == raw
        if not ok and len(new) > 1:
            for u in new:
                self._learn([u])
            return
        first = len(self.groups)
        self._room(len(new), 0)
        if ok:
            self._align(ids_a, ids_b, np.cumsum([len(u.encode()) for u in new]), first)
        else:
            self.numbers[first], self.first[first] = 0, self.n_pairs
            self.groups.append(b"")
        self.met[first : first + len(new)] = 0
        self.known.update((u, first + i) for i, u in enumerate(new))

    def _align(self, ids_a: np.ndarray, ids_b: np.ndarray, ends: np.ndarray, first: int) -> None:
        """Groups and links of units that stand behind each other and end at ``ends``."""
        ends_a, ends_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        begin = np.searchsorted(ends_b, ends_a - self.a_size[ids_a], side="right")
        count = np.searchsorted(ends_b - self.b_size[ids_b], ends_a, side="left") - begin
        left = np.repeat(np.arange(len(ids_a)), count)
        right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + begin[left]
        pairs = (ids_a[left] << 24) | ids_b[right]
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)  # where a group ends
        group_a, group_b = np.searchsorted(ends_a, common) + 1, np.searchsorted(ends_b, common) + 1
        upto_a, upto_b, upto_group = (np.searchsorted(x, ends) + 1 for x in (ends_a, ends_b, common))
        upto_link = np.cumsum(count)[upto_a - 1]
        if not (common[upto_group - 1] == ends).all():
            raise ValueError("these tokenizers do not break between units")
        own = self.numbers[first : first + len(ends)]
        for k, upto in enumerate((upto_a, upto_b, upto_group, upto_link)):
            own[:, k] = np.diff(upto, prepend=0)
        own[:, 4] = 1
        self._room(0, len(pairs))
        self.pairs[self.n_pairs : self.n_pairs + len(pairs)] = pairs
        self.first[first : first + len(ends)] = self.n_pairs + upto_link - own[:, 3]
        self.n_pairs += len(pairs)
        text_a, text_b = [str(k) for k in ids_a.tolist()], [str(k) for k in ids_b.tolist()]
        u = v = 0
        parts = []
        for x, y in zip(group_a.tolist(), group_b.tolist()):
            parts.append(f"{text_a[u] if x == u + 1 else ','.join(text_a[u:x])}|{text_b[v] if y == v + 1 else ','.join(text_b[v:y])}")
            u, v = x, y
        u = 0
        for g in upto_group.tolist():
            self.groups.append(";".join(parts[u:g]).encode())
            u = g


_ALIGNERS: dict[int, Aligner] = {}


def aligner_of(shared) -> Aligner:
    """This process's aligner: the units that one task met are known to the worker's next."""
    json_text, model = shared.value
    key = hash((json_text, model))
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(json_text, model)
    return _ALIGNERS[key]


# --- the index of a chunk -----------------------------------------------------------------------


class Chunk:
    """Postings of the links of some documents: OR-merged and summed as they come."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.links = self.held = 0
        self.parts: list[np.ndarray] = []
        self.pair, self.place, self.times = (np.empty(0, t) for t in (np.int64, np.int64, np.int64))

    def add(self, links: np.ndarray) -> None:
        self.parts.append((links << 16) | len(self.rows))
        self.links += len(links)
        self.held += len(links)
        if self.held >= AT_ONCE:
            self.merge()

    def merge(self) -> None:
        if not self.parts:
            return
        own = (self.pair << 16) | self.place
        codes = np.concatenate((*self.parts, own))
        weight = np.concatenate((np.ones(len(codes) - len(own), np.int64), self.times))
        order = np.argsort(codes)
        codes, weight = codes[order], weight[order]
        begin = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
        self.times = np.add.reduceat(weight, begin) if len(begin) else np.empty(0, np.int64)
        self.pair, self.place = codes[begin] >> 16, codes[begin] & 0xFFFF
        self.parts, self.held = [], 0

    def packed(self) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
        """(pairs, documents of each, its postings in bytes, links of each)."""
        self.merge()
        begin = np.flatnonzero(np.append(True, self.pair[1:] != self.pair[:-1])) if len(self.pair) else np.empty(0, np.int64)
        documents = np.diff(np.append(begin, len(self.pair)))
        more = self.times - 1
        planes = [np.packbits((more >> k) & 1).tobytes() for k in range(int(more.max(initial=0)).bit_length())]
        body = np.array([len(begin), len(self.pair), len(planes)], np.int64).tobytes() + documents.astype(np.uint16 if len(self.rows) < PLACES else np.uint32).tobytes() + self.place.astype(np.uint16).tobytes() + b"".join(planes)
        links = np.add.reduceat(self.times, begin) if len(begin) else np.empty(0, np.int64)
        return self.pair[begin], documents, zlib.compress(body, 1), links


def unpacked(raw: bytes, documents_of_chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents of each pair, places, times) of a chunk's postings."""
    raw = zlib.decompress(raw)
    pairs, postings, planes = np.frombuffer(raw, np.int64, 3)
    kind = np.dtype(np.uint16 if documents_of_chunk < PLACES else np.uint32)
    at = 24
    documents = np.frombuffer(raw, kind, pairs, at).astype(np.int64)
    at += pairs * kind.itemsize
    places = np.frombuffer(raw, np.uint16, postings, at).astype(np.int64)
    at += postings * 2
    times = np.ones(postings, np.int64)
    width = -(-postings // 8)
    for k in range(planes):
        times += np.unpackbits(np.frombuffer(raw, np.uint8, width, at), count=postings).astype(np.int64) << k
        at += width
    return documents, places, times


_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]))
_INDEX = pa.schema([("chunk", pa.int64()), ("docs", _DOCS), ("postings", pa.binary()), ("pair", pa.int64()), ("documents", pa.int64()), ("links", pa.int64())])


def _pieces(text: str):
    """The text in pieces of about PIECE characters, cut where units are."""
    at = 0
    while len(text) - at > 2 * PIECE:
        m = _CUT.search(text, at + PIECE)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def _build(shared):
    """Rows of the index: for each chunk one with its documents and postings, and one for each pair."""

    def out(chunk: Chunk, number: int):
        pairs, documents, raw, links = chunk.packed()
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([[dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), r)) for r in chunk.rows]], _DOCS), pa.array([raw], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], schema=_INDEX)
        for a in range(0, len(pairs), 1 << 16):
            n = len(pairs[a : a + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.nulls(n, _DOCS), pa.nulls(n, pa.binary()), pa.array(pairs[a : a + n]), pa.array(documents[a : a + n]), pa.array(links[a : a + n])], schema=_INDEX)

    def run(batches):
        from pyspark import TaskContext

        aligner = aligner_of(shared)
        number = TaskContext.get().partitionId() << 32
        chunk = Chunk()
        waiting: list[tuple] = []  # (doc_id, units; None for a text that is read in pieces; the text)
        size = 0

        def look_up(units: list[str]) -> np.ndarray:
            found = np.array([aligner.known[u] for u in units], np.int64)
            np.add.at(aligner.met, found, 1)
            return found

        def documents():
            """(doc_id, ids of the units of each piece of its text): no piece for a text without tokens."""
            if len(aligner.known) > KNOWN:
                aligner.forget()
            aligner.learn([u for _, units, _ in waiting for u in units or ()])
            for doc_id, units, text in waiting:
                if units is not None:
                    found = look_up(units)
                    yield doc_id, [found] if len(found) and aligner.numbers[found, 4].all() else []
                else:
                    # twice: whether the bytes of all pieces are the text's, then their tokens
                    whole = True
                    for piece in _pieces(text):
                        whole = whole and bool(aligner.numbers[units_of(piece), 4].all())
                    yield doc_id, map(units_of, _pieces(text)) if whole else []

        def units_of(piece: str) -> np.ndarray:
            """Such a text is the last that waits, so that units may be forgotten between its pieces."""
            if len(aligner.known) > KNOWN:
                aligner.forget()
            aligner.learn(units := aligner.units(piece))
            return look_up(units)

        def flush():
            nonlocal chunk, number
            for doc_id, pieces in documents():
                total, digest, mark = np.zeros(5, np.int64), hashlib.sha256(), b""
                for found in pieces:
                    total += aligner.numbers[found].sum(0)
                    digest.update(mark + b";".join([aligner.groups[i] for i in found.tolist()]))
                    mark = b";"
                    chunk.add(aligner.links(found))
                chunk.rows.append((doc_id, *total[:4].tolist(), digest.hexdigest() if mark else ""))
                if chunk.links >= CHUNK or len(chunk.rows) >= PLACES - 1:
                    yield from out(chunk, number)
                    chunk, number = Chunk(), number + 1
            waiting.clear()

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                if not text or BLANK in text:
                    waiting.append((doc_id, [], ""))
                elif aligner.cuts and len(text) > 2 * PIECE:
                    waiting.append((doc_id, None, " " + text))
                    size += LOOKED_UP
                else:
                    waiting.append((doc_id, aligner.units(" " + text), ""))
                    size += len(waiting[-1][1])
                if size >= LOOKED_UP:
                    yield from flush()
                    size = 0
        yield from flush()
        if chunk.rows:
            yield from out(chunk, number)

    return run


def _score(key, index: pa.Table, scores: pa.Table) -> pa.Table:
    """Postings of a chunk return the pairs' scores to its documents."""
    rows = index["docs"].to_pylist()[0]
    documents, places, times = unpacked(index["postings"].to_pylist()[0], len(rows))
    pair = scores["pair"].to_numpy()
    order = np.argsort(pair)
    count, best = scores["documents"].to_numpy()[order], scores["best"].to_numpy(zero_copy_only=False)[order]
    if len(count) != len(documents):
        raise ValueError("a chunk's pairs and their counts differ")
    own = np.repeat(np.arange(len(documents)), documents)
    n_best, total = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    np.add.at(n_best, places, times * best[own])
    np.add.at(total, places, times * count[own])
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    kinds = dict(zip(names, (pa.int64(),) * 5 + (pa.string(),)))
    return pa.table({n: pa.array([r[n] for r in rows], kinds[n]) for n in names} | {"n_best": pa.array(n_best), "count_sum": pa.array(total)})


def pair_index(spark: SparkSession, docs: DataFrame, json_path: str, model_path: str) -> DataFrame:
    """The written index: see the module. Its rows with a pair are one for each pair of a chunk, the others one for each chunk."""
    shared_dir(spark)
    with open(json_path, encoding="utf-8") as f, open(model_path, "rb") as g:
        shared = spark.sparkContext.broadcast((f.read(), g.read()))
    kind = "chunk long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>, postings binary, pair long, documents long, links long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(spark, rows.mapInArrow(_build(shared), kind), "pair-index", compression="zstd")


def pair_counts(index: DataFrame) -> DataFrame:
    """(a, b, documents, links, best): of each linked id pair, how many documents hold it and how many links it has; best: no pair of its a is held by more."""
    pairs = index.where("pair is not null").groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))
    pairs = pairs.select(F.shiftright("pair", 24).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFF)).alias("b"), "documents", "links", "pair")
    most = pairs.groupBy("a").agg(F.max("documents").alias("most"))
    return pairs.join(most, "a").select("a", "b", "documents", "links", (F.col("documents") == F.col("most")).alias("best"), "pair")


def align_tokenizers(spark: SparkSession, docs: DataFrame, json_path: str, model_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per row of ``docs``.

    A: " " + text by the byte-level tokenizer of ``json_path``; B: text by the sentencepiece model of ``model_path``;
    both without special tokens, whose strings are plain text. Byte offsets where tokens of both end cut them into
    groups; links are all pairs of token occurrences whose bytes overlap. A pair's count: how many rows of ``docs`` hold
    it. n_best: links whose count is the highest of their A id, ties included; count_sum: the sum of counts over links.
    Texts that are null or empty, or whose joined A or B bytes differ from " " + text, have zeros and an empty digest
    and count nowhere. Null and repeated doc_ids, and repeated rows, each count. Other columns are not read. Very long
    texts are read in pieces.
    """
    index = pair_index(spark, docs, json_path, model_path)
    scores = written(spark, pair_counts(index).select("pair", "documents", "best"), "pair-counts")
    asked = index.where("pair is not null").select(F.col("chunk").alias("of"), "pair").join(scores, "pair").select("of", "pair", "documents", "best")
    chunks = index.where("pair is null").select("chunk", "docs", "postings")
    kind = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    found = chunks.groupBy("chunk").cogroup(asked.groupBy("of")).applyInArrow(_score, kind)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
