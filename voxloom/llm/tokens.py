"""Token ids in binary shards: frequency-ranked ids in 1 to 4 bytes, control bytes apart.

``encode_corpus`` runs a tokenizer over every whole text, ranks ids by how often the corpus has them, and writes
shards of documents in ascending doc_id order. A shard holds, for each document, its control bytes (two bits an id:
how many bytes its rank takes, less one; four ids a byte) and its data bytes (ranks, little-endian, without leading
zero bytes), then an index and a footer:

    b"VXTOKEN1" | documents: control bytes, data bytes | index: doc_id, null, tokens, data bytes (4 x int64 each) |
    index offset int64, documents int64, b"VXTOKEN1"

Beside the shards lie two Parquet tables: ``table`` (rank, id) and ``shards`` (shard, file, documents, tokens, ...),
whose rows name the files of successful attempts only; a file that a lost attempt left is never read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, shared_dir, written

MAGIC = b"VXTOKEN1"
#: A Python worker keeps the ids of the latest words: of so many at least, and twice as many at most.
CACHED = 800_000
#: Texts of so many bytes are cut together.
TEXTS_AT_ONCE = 4 << 20
SHARD_TOKENS = 16_000_000
_ODD_SPACES = "\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_SPACE = re.compile(f"[{_ODD_SPACES}]")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of every range, one range behind the other."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Encoder:
    """Ids of whole texts, with what single spaces separate encoded once.

    Arrow cuts many texts, numbers their distinct pieces, so that Python meets each of them once, and lays the pieces'
    ids out. Texts with other spaces than single ones, special tokens or zeros are cut one by one.

    ``cut``: for byte-level vocabularies whose pre-tokenizer always breaks before a single space between two other
    characters, as byte_bpe_50k's does. Pieces not known yet are encoded as one text and told apart by their bytes.
    """

    def __init__(self, tokenizer_json: str, cut: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.bytes = np.zeros(self.size, np.int64)
        for token, k in vocabulary.items():
            self.bytes[k] = len(token)
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.cut, self.known, self.before = cut, {}, {}
        #: What a text has that Arrow does not cut, for RE2.
        self.odd = "|".join([r"  | \n|\n |\A | \z", rf"[\x00{_ODD_SPACES}]", *map(re.escape, self.special)])
        self.marks = {c: x.tobytes() for c, x in zip(".,!?", self._encode(list(".,!?")))} if cut else {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keys(self, text: str) -> list[str]:
        """Pieces without the space before them; a first one is marked by a zero, one behind a line end keeps that instead."""
        if not self.cut or "\0" in text or any(s in text for s in self.special):
            return ["\0" + text]
        if "  " in text or " \n" in text or "\n " in text or _ODD_SPACE.search(text):
            first, *rest = _CUT.split(text)
            keys = [p[1:] for p in rest]
        else:
            first, *keys = (text if "\n\n" in text or text[:1] == "\n" or text[-1:] == "\n" else text.replace("\n", " \n")).split(" ")
            if keys and not (first and keys[-1]):  # a space at either end
                first, *rest = _CUT.split(text)
                keys = [p[1:] for p in rest]
        keys.insert(0, "\0" + first)
        return keys

    def _learn(self, new: list[str]) -> None:
        alone = [k for k in new if k[0] == "\0" or k[-1].isspace()]
        self.known.update(zip(alone, (x.tobytes() for x in self._encode([k[1:] if k[0] == "\0" else k if k[0] == "\n" else " " + k for k in alone]))))
        told = set(alone)
        joint = [k for k in new if k not in told]
        for a in range(0, len(joint), 8192):
            some = joint[a : a + 8192]
            some = [k if k[0] == "\n" else " " + k for k in some]
            text = "".join(some)
            ids = self._encode([text])[0]
            ends = np.cumsum(self.bytes[ids])
            size = np.cumsum([len(k.encode()) for k in some])
            cuts = np.searchsorted(ends, size) + 1
            if not np.array_equal(ends[cuts - 1], size):
                raise ValueError("this tokenizer does not break before single spaces: use cut=False")
            raw, width = ids.tobytes(), self.type.itemsize
            at = [0, *(cuts * width).tolist()]
            self.known.update((k, raw[u:v]) for k, u, v in zip(joint[a : a + 8192], at, at[1:]))

    def _ids(self, keys: list[str]) -> list[bytes]:
        """The ids of each of some distinct pieces."""
        if len(self.known) > CACHED:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        found = list(map(known.get, keys))
        new = [k for k, x in zip(keys, found) if x is None]
        if not new:
            return found
        if before:
            again = {k: x for k in new if (x := before.get(k)) is not None}
            known.update(again)
            new = [k for k in new if k not in again]
        # a word before a mark of punctuation: both are pre-tokens of their own
        ended = [k for k in new if k[-1] in ".,!?" and k[:-1].isalpha()] if self.cut else []
        marked = set(ended)
        stems = dict.fromkeys(k[:-1] for k in ended if k[:-1] not in known)
        stems.update(dict.fromkeys(k for k in new if k not in marked))
        if stems:
            self._learn(list(stems))
        known.update([(k, known[k[:-1]] + self.marks[k[-1]]) for k in ended])
        return [known[k] if x is None else x for k, x in zip(keys, found)]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one text behind the other; where each text's ids end) of a string array (null: empty)."""
        if not len(texts):
            return np.empty(0, self.type), np.empty(0, np.int64)
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.cut else np.ones(len(texts), bool)
        plain = texts.filter(pa.array(~odd))
        plain = pc.if_else(pc.match_substring_regex(plain, r"\n\n|\A\n|\n\z"), plain, pc.replace_substring(plain, "\n", " \n"))  # as in _keys
        cut = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\0", plain.type), plain, pa.scalar("", plain.type)), " ")
        coded = cut.flatten().dictionary_encode()
        # to_pylist takes many times as long, and no piece of these has a space
        keys = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", plain.type))[0].as_py().split(" ") if len(coded) else []
        rest = [self._keys(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        own: dict[str, int] = {}
        piece = np.append(coded.indices.to_numpy(), np.array([own.setdefault(k, len(keys) + len(own)) for pieces in rest for k in pieces], np.int32))
        pieces, offsets = np.zeros(len(texts), np.int64), cut.offsets.to_numpy()
        pieces[~odd] = np.diff(offsets)
        pieces[odd] = [len(x) for x in rest]
        if rest:
            begins = np.zeros(len(texts), np.int64)
            begins[~odd] = offsets[:-1]
            begins[odd] = len(coded) + np.cumsum(pieces[odd]) - pieces[odd]
            piece = piece[_ranges(begins, pieces)]
        laid = pa.array(self._ids(keys + list(own)), pa.large_binary()).take(pa.array(piece))
        ends = np.frombuffer(laid.buffers()[1], np.int64, len(piece) + 1)[np.cumsum(pieces)] // self.type.itemsize
        return np.frombuffer(laid.buffers()[2] or b"", self.type, int(ends[-1])), ends

    def batch(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.column(pa.array(texts, pa.large_string()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if len(texts) else []


_ENCODERS: dict[int, Encoder] = {}


def breaks_before_spaces(tokenizer_json: str) -> bool:
    """Whether pieces between single spaces may be encoded alone: a byte-level pre-tokenizer with its own pattern, and no normalizer."""
    spec = json.loads(tokenizer_json)
    before = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)


def encoder_of(tokenizer_json: str) -> Encoder:
    """This process's encoder: the words that one task met are known to the worker's next. Where pieces may not be cut, whole texts are encoded."""
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer_json, breaks_before_spaces(tokenizer_json))
    return _ENCODERS[key]


def gathered(batches, most: int = TEXTS_AT_ONCE):
    """The rows of consecutive batches together, until they reach ``most`` bytes: fewer texts repeat what others have learned."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(some)
            some, size = [], 0
    if some:
        yield pa.concat_batches(some)


def _tokenize(shared, end_id: int | None):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("id", pa.int32()), ("times", pa.int64())])

    def run(batches):
        encoder = encoder_of(shared.value)
        counts = np.zeros(max(encoder.size, (end_id or 0) + 1), np.int64)
        for batch in gathered(batches):
            n = batch.num_rows
            ids, ends = encoder.column(batch.column(1))
            if end_id is not None:
                ids, ends = np.insert(ids, ends, np.array(end_id, encoder.type)), ends + np.arange(1, n + 1)
            counts += np.bincount(ids, minlength=len(counts))
            offsets = np.append(0, ends * encoder.type.itemsize)
            ids = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            for a in range(0, n, 512):
                some = ids[a : a + 512].cast(pa.binary())
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + 512], some, none.cast(pa.int32()), none], schema=schema)
        used = np.flatnonzero(counts)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.nulls(len(used), pa.binary()), pa.array(used.astype(np.int32)), pa.array(counts[used])], schema=schema)

    return run


def pack_documents(ranks: np.ndarray, sizes: np.ndarray) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """(control bytes, data bytes, ends of each document's control bytes, of its data bytes) of the unsigned 32-bit ranks
    of consecutive documents of so many ranks each."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    most = int(ranks.max(initial=0))
    code = (ranks > 0xFF).view(np.uint8)
    for limit in (0xFFFF, 0xFFFFFF):
        if most > limit:
            code = code + (ranks > limit)
    quads = -(-sizes // 4)
    control_ends, last = np.cumsum(quads), np.cumsum(sizes)
    # what fills a document's last control byte lies behind its codes
    pads = 4 * quads - sizes
    own = np.ones(4 * int(quads.sum()), bool)
    own[_ranges(4 * control_ends - pads, pads)] = False
    padded = np.zeros(len(own), np.uint8)
    padded[own] = code
    padded = padded.reshape(-1, 4)
    control = padded[:, 0] | (padded[:, 1] << 2) | (padded[:, 2] << 4) | (padded[:, 3] << 6)
    width = 1 + (most > 0xFF) if most <= 0xFFFF else 4
    data = ranks.astype("<u2").view(np.uint8) if width == 2 else ranks.astype(np.uint8) if width == 1 else ranks.view(np.uint8)
    if width > 1:
        kept = np.ones((len(ranks), width), bool)
        for k in range(1, width):
            np.greater_equal(code, k, out=kept[:, k])
        data = data[kept.reshape(-1)]
    return control.tobytes(), data.tobytes(), control_ends, last + np.append(0, np.cumsum(code, dtype=np.int64))[last]


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    return pack_documents(ranks, np.array([len(ranks)]))[:2]


_CODES = np.array([[c >> (2 * k) & 3 for k in range(4)] for c in range(256)], np.uint8)


def unpack_documents(raw: bytes, sizes: np.ndarray, data_sizes: np.ndarray) -> np.ndarray:
    """The ranks of consecutive documents, each its control bytes and then its data bytes, of so many ranks and data bytes."""
    raw = np.frombuffer(raw, np.uint8)
    quads = -(-sizes // 4)
    ends = np.cumsum(quads + data_sizes)
    is_data = np.ones(len(raw), bool)
    is_data[_ranges(ends - quads - data_sizes, quads)] = False
    codes = _CODES[raw[~is_data]].reshape(-1)
    pads = 4 * quads - sizes
    own = np.ones(len(codes), bool)
    own[_ranges(4 * np.cumsum(quads) - pads, pads)] = False
    code = codes[own]
    most = int(code.max(initial=0))
    width = most + 1 if most < 2 else 4
    out = np.zeros((len(code), width), np.uint8)
    kept = np.ones((len(code), width), bool)
    for k in range(1, width):
        np.greater_equal(code, k, out=kept[:, k])
    out[kept] = raw[is_data]
    return out.reshape(-1).view(f"<u{width}").astype(np.uint32)


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    return unpack_documents(control + data, np.array([n]), np.array([len(data)]))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _write_shards(root: str, shared):
    schema = pa.schema([("file", pa.string()), ("null_first", pa.bool_()), ("first_id", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        filesystem, base = _filesystem(root)
        rank_of, kind = shared.value
        out, name, index, tokens, at = None, f"{uuid.uuid4().hex}.vxt", [], 0, len(MAGIC)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                filesystem.create_dir(base, recursive=True)
                out = filesystem.open_output_stream(f"{base}/{name}")
                out.write(MAGIC)
            ids = batch.column(1).to_pylist()
            sizes = np.array([len(x) for x in ids], np.int64) // kind.itemsize
            control, data, c, d = pack_documents(rank_of[np.frombuffer(b"".join(ids), kind)], sizes)
            c, d = np.append(0, c), np.append(0, d)
            parts = zip(c.tolist(), c[1:].tolist(), d.tolist(), d[1:].tolist())
            out.write(b"".join([x for a, b, u, v in parts for x in (control[a:b], data[u:v])]))
            doc_ids = batch.column(0)
            index.append(np.stack([doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), sizes, np.diff(d)], axis=1))
            at += len(control) + len(data)
            tokens += int(sizes.sum())
        if out is None:
            return
        rows = np.concatenate(index)
        out.write(rows.tobytes())
        out.write(np.array([at, len(rows)], np.int64).tobytes() + MAGIC)
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([bool(rows[0, 1])]), pa.array(rows[:1, 0]), pa.array([len(rows)]), pa.array([tokens]), pa.array([at + rows.nbytes + 24])], schema=schema)

    return run


def encode_corpus(spark: SparkSession, docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int | None = 2) -> None:
    """Writes the ids of every whole text of ``docs`` (null: empty), each followed by ``end_id``, under ``out_dir``.

    A null doc_id sorts first; rows that repeat a doc_id are all kept, ordered by their ids. Columns other than doc_id
    and text are not read. ``out_dir`` is a folder that driver and executors share.
    """
    shared_dir(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenize(shared, end_id), "doc_id long, ids binary, id int, times long")
    both = written(spark, rows, "ids", compression="zstd")
    counts = both.where("id is not null").groupBy("id").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "id").collect()  # at most the vocabulary
    encoder = encoder_of(shared.value)
    size = max([encoder.size, (end_id or 0) + 1])
    rank_of = np.zeros(size, np.uint32)
    rank_of[[r.id for r in counts]] = np.arange(len(counts), dtype=np.uint32)
    spark.createDataFrame([(k, r.id) for k, r in enumerate(counts)], "rank int, id int").coalesce(1).write.parquet(f"{out_dir}/table")
    tokens = sum(r.times for r in counts)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // SHARD_TOKENS))
    ranks = spark.sparkContext.broadcast((rank_of, encoder.type))
    ordered = both.where("id is null").select("doc_id", "ids").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "ids")
    shards = ordered.mapInArrow(_write_shards(f"{out_dir}/data", ranks), "file string, null_first boolean, first_id long, documents long, tokens long, bytes long")
    shards.write.parquet(f"{out_dir}/shards")
    drop(spark, both)


def _read_shards(root: str, shared, digest: bool, at_once: int = 1 << 20):
    def run(batches):
        filesystem, base = _filesystem(root)
        id_of = shared.value
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with filesystem.open_input_file(f"{base}/{name}") as f:
                    size = f.size()
                    offset, documents = (int(x) for x in np.frombuffer(f.read_at(16, size - 24), np.int64))
                    if f.read_at(8, size - 8) != MAGIC or f.read_at(8, 0) != MAGIC:
                        raise ValueError(f"{name} is no shard of token ids")
                    index = np.frombuffer(f.read_at(32 * documents, offset), np.int64).reshape(-1, 4)
                    control = -(-index[:, 2] // 4)
                    ends = len(MAGIC) + np.cumsum(control + index[:, 3])
                    starts = start + np.cumsum(index[:, 2]) - index[:, 2]
                    a = 0
                    while a < documents:
                        first = len(MAGIC) if a == 0 else int(ends[a - 1])
                        b = max(a + 1, int(np.searchsorted(ends, first + at_once, side="right")))
                        raw = f.read_at(int(ends[b - 1]) - first, first)
                        ids = id_of[unpack_documents(raw, index[a:b, 2], index[a:b, 3])].astype("<u4")
                        ends_of = np.append(0, np.cumsum(index[a:b, 2])).tolist()
                        out = [zlib.crc32(ids[u:v]) if digest else ids[u:v] for u, v in zip(ends_of, ends_of[1:])]
                        last = pa.array(out, pa.int64()) if digest else pa.array(out, pa.list_(pa.int32()))
                        ids = pa.array(index[a:b, 0], mask=index[a:b, 1].astype(bool))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(starts[a:b]), pa.array(index[a:b, 2]), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
                        a = b

    return run


def read_corpus(spark: SparkSession, out_dir: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files, or with ``digest`` ids_crc32 in place of ids.

    start: ids of all documents before it. ids_crc32: crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    shards = spark.read.parquet(f"{out_dir}/shards").orderBy(F.desc("null_first"), "first_id").collect()  # one row per shard
    table = spark.read.parquet(f"{out_dir}/table").orderBy("rank").collect()  # at most the vocabulary
    shared = spark.sparkContext.broadcast(np.array([r.id for r in table], np.uint32))
    rows, start = [], 0
    for s in shards:
        rows.append((s.file, start))
        start += s.tokens
    kind = "ids_crc32 long" if digest else "ids array<int>"
    if not rows:
        return spark.createDataFrame([], f"doc_id long, start long, n_tokens long, {kind}")
    files = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "file string, start long")
    return files.mapInArrow(_read_shards(f"{out_dir}/data", shared, digest), f"doc_id long, start long, n_tokens long, {kind}")
