"""Secret scans by a recursive decoding worklist.

A text is layer 0. Each layer is searched for secrets, then unwrapped: its URL and Unicode escapes (the whole layer,
decoded), and each run of base64, as text or, if its bytes are gzip, zlib, bzip2 or xz data, inflated. What comes out
is a new layer, unless the text has had an equal one from the same places before (no cycles); the worklist ends when
no layer gives a new one. Every character of a layer knows the span of the original text it came from, so each finding is reported in code
points of the original; findings in layers never replace those of layer 0. Nothing bounds the depth: each layer but an
inflated one is shorter than its parent, and a text escaped n times over costs n passes.

Base64 may be wrapped: lines of 16 characters or more and a last line of any length. As a short line behind a run may
be a word of its own, the run is also read without it where it does not decode with it, or not to whole groups of four.
Escaped bytes that are no UTF-8, and halves of surrogate pairs, stay as they are; what stands around them is decoded.
Compressed data may have several members, or plain data behind them. It is searched in pieces, cut only where no
secret and no run can go on, so that memory follows the longest unbroken run and nothing is lost at a cut.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"([A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*)(\r?\n[A-Za-z0-9+/_-]{1,15}(?![A-Za-z0-9+/_-]))?={0,2}")
_FOREIGN = bytes(set(range(256)) - {9, 10, 13, *range(32, 127), *range(128, 256)})
#: Inflated data is searched in pieces of about so many bytes, so that its size needs no memory.
PIECE = 1 << 20
#: Where inflated data may be cut: behind a byte that no pattern above knows, or a space that is not beside : or =.
_BREAK = re.compile(rb"[!$()*,<>?@\[\]^`|~\x00-\x09\x0b\x0c\x0e-\x1f]|(?<=[^\x20:=])\x20(?=[^\x20:=])")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, those that fail the kind's length dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def _escapes(text: str, pattern, decode):
    """The text with its escapes decoded and, for each of its characters, where it starts and ends in ``text``; or None."""
    parts, starts, ends, at, changed = [], [], [], 0, False
    for m in pattern.finditer(text):
        got = decode(m[0])
        if got is None:
            continue
        changed = True
        plain = np.arange(at, m.start())
        parts.append(text[at : m.start()])
        starts.append(plain)
        ends.append(plain + 1)
        for piece, a, b in got:
            parts.append(piece)
            starts.append(np.full(len(piece), m.start() + a))
            ends.append(np.full(len(piece), m.start() + b))
        at = m.end()
    if not changed:
        return None
    plain = np.arange(at, len(text))
    parts.append(text[at:])
    return "".join(parts), np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1])


def _literal(text: str, at: int):
    """Characters that stay as they are, each in its own place."""
    return [(c, at + k, at + k + 1) for k, c in enumerate(text)]


def _decode_url(run: str):
    out, at, good = [], 0, False
    for c in bytes.fromhex(run.replace("%", "")).decode(errors="surrogateescape"):
        if 0xDC80 <= ord(c) <= 0xDCFF:  # a byte that is no UTF-8
            out += _literal(run[at : at + 3], at)
            at += 3
            continue
        n = 3 * len(c.encode())
        out.append((c, at, at + n))
        at, good = at + n, True
    return out if good else None


def _decode_unicode(run: str):
    if run.startswith("\\u") and "{" not in run:
        units = [int(x, 16) for x in run.split("\\u")[1:]]
        out, k, good = [], 0, False
        while k < len(units):
            c, n = units[k], 1
            if 0xD800 <= c < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1] < 0xE000:
                c, n = 0x10000 + ((c - 0xD800) << 10) + units[k + 1] - 0xDC00, 2
            if 0xD800 <= c < 0xE000:  # half a pair
                out += _literal(run[6 * k : 6 * k + 6], 6 * k)
            else:
                out.append((chr(c), 6 * k, 6 * (k + n)))
                good = True
            k += n
        return out if good else None
    digits = run.strip("\\ux{}&#X;")
    c = int(digits, 10 if run.startswith("&#") and run[2] not in "xX" else 16)
    return [(chr(c), 0, len(run))] if c < 0x110000 and not 0xD800 <= c < 0xE000 else None


def _tool(data: bytes):
    """What inflates ``data``, or None."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if data[:6] == b"\xfd7zXZ\x00" else None


def _raw(data: bytes):
    """Inflated data as it comes, of all members one behind the other and what stands behind the last. Returns if their ends were met."""
    while (tool := _tool(data)) is not None:
        while not tool.eof:
            try:
                piece = tool.decompress(data, PIECE)
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                return False
            data = getattr(tool, "unconsumed_tail", b"")
            if piece:
                yield piece
            elif not data and not tool.eof and getattr(tool, "needs_input", True):
                return False
        data = tool.unused_data.lstrip(b"\0")
    if data:
        yield data
    return True


def _inflated(data: bytes):
    """Pieces of inflated data, or nothing if ``data`` is not compressed or breaks off at once. Returns if its end was met.

    A piece ends where no secret and no encoded run can go on.
    """
    if _tool(data) is None:
        return False
    held, fresh, whole = [], 0, _raw(data)
    while True:
        try:
            piece = next(whole)
        except StopIteration as end:
            if held:
                yield b"".join(held)
            return end.value
        held.append(piece)
        fresh += len(piece)
        if fresh >= PIECE:
            text, fresh = b"".join(held), 0
            # what came before the latest pieces has no break, or it would have gone
            *_, last = [0, *(m.end() for m in _BREAK.finditer(text, max(0, len(text) - 2 * PIECE)))]
            if last:
                yield text[:last]
            held = [text[last:]]


def _text(data: bytes, sure: bool = False) -> str | None:
    """``data`` as text if it is UTF-8 without control characters (``sure``: whatever can be read of it)."""
    if sure:
        return data.decode(errors="replace")
    if data.translate(None, _FOREIGN) != data:
        return None
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def _ends(data: bytes) -> bool:
    """Whether ``data`` is compressed and whole."""
    pieces = _inflated(data)
    while True:
        try:
            next(pieces)
        except StopIteration as end:
            return bool(end.value)


def _original(starts, ends, a, b):
    """Where characters of a layer, from starts ``a`` to last ones ``b``, stand in the original (starts None: are it)."""
    return (a, b + 1) if starts is None else (starts[a], ends[b])


def unescaped(text: str, starts, ends):
    """The layers (text, starts, ends) of decoded escapes, with spans in the original; starts None stands for the original itself."""
    for pattern, decode, mark in ((_URL, _decode_url, ("%",)), (_UNICODE, _decode_unicode, ("\\u", "\\x", "&#"))):
        if any(m in text for m in mark) and (got := _escapes(text, pattern, decode)):
            yield got[0], *_original(starts, ends, got[1], got[2] - 1)


def unwrapped(text: str, starts, ends):
    """The layers of runs of base64, as ``unescaped``."""
    for m in _BASE64.finditer(text):
        whole = _decoded(text, m.start(), m.end())
        if m[2] is None:
            yield from _read(*whole, m.start(), m.end(), starts, ends)
            continue
        part = _decoded(text, m.start(), m.end(1))
        if _ends(part[0]):
            yield from _read(*part, m.start(), m.end(1), starts, ends)
            continue
        read = False
        for layer in _read(*whole, m.start(), m.end(), starts, ends):
            read = True
            yield layer
        if not read or len(m[0].translate({13: None, 10: None})) % 4:
            yield from _read(*part, m.start(), m.end(1), starts, ends)


def _decoded(text: str, start: int, end: int):
    """The bytes of a run of base64 and where its digits are."""
    keep = np.array([i for i, c in enumerate(text[start:end]) if c not in "\r\n="]) + start
    digits = text[start:end].translate({13: None, 10: None, 61: None, 45: 43, 95: 47})
    if len(digits) % 4 == 1:
        digits, keep = digits[:-1], keep[:-1]
    return base64.b64decode(digits + "=" * (-len(digits) % 4)), keep


def _read(data: bytes, keep, start: int, end: int, starts, ends):
    a, b = _original(starts, ends, start, end - 1)
    inflated = False
    for piece in _inflated(data):
        inflated = True
        inner = _text(piece, sure=True)
        yield inner, np.full(len(inner), a), np.full(len(inner), b)
    inner = None if inflated else _text(data)
    if inner:
        sizes = np.array([len(c.encode()) for c in inner])
        end_of = np.cumsum(sizes)
        first = keep[(end_of - sizes) * 4 // 3]
        last = keep[np.minimum((end_of * 4 + 2) // 3, len(keep)) - 1]
        yield inner, *_original(starts, ends, first, last)


def scan(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, depth) of one text, each span once, with the least depth, by start, kind, end."""
    found = {(kind, a, b): 0 for kind, a, b in base_spans(text)}
    seen: dict[bytes, int] = {}
    work = [(0, unwrapped(text, None, None), (text, None, None))]
    while work:
        depth, runs, own = work[-1]
        inner = next(runs, None)
        if inner is None:
            work.pop()  # before its escapes are decoded, so that a deep chain of them is not held
        for layer in unescaped(*own) if inner is None else (inner,):
            inner, starts, ends = layer
            # an equal text from other places is another layer: its secrets stand there too
            digest = hashlib.blake2b(inner.encode("utf-8", "surrogatepass"), digest_size=16)
            digest.update(np.asarray(starts, np.int64).tobytes())
            digest.update(np.asarray(ends, np.int64).tobytes())
            key = digest.digest()
            if seen.get(key, depth + 2) <= depth + 1:
                continue
            seen[key] = depth + 1
            for kind, a, b in base_spans(inner):
                span = (kind, int(starts[a]), int(ends[b - 1]))
                found[span] = min(found.get(span, depth + 1), depth + 1)
            work.append((depth + 1, unwrapped(*layer), layer))
    return sorted(((k, a, b, d) for (k, a, b), d in found.items()), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


FINDINGS = "array<struct<kind: string, start: bigint, end: bigint, depth: int>>"
_FINDING = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())]))


def _scan_batches(batches):
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end", "depth"), x)) for x in scan(t or "")] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _FINDING)], names=["doc_id", "findings"])


def secret_scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, findings): one row per row of ``docs``; findings (kind, start, end, depth) by start, kind, end.

    depth 0: in the text itself. Null and empty texts have none. Spans are code points of the text, end exclusive.
    Null and repeated ids are kept as they are; other columns are not read.
    """
    shared_dir(spark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan_batches, f"doc_id long, findings {FINDINGS}")


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping findings replaced by ``mark``."""
    if not text:
        return text
    out, at, end = [], 0, 0
    for _, a, b, _ in scan(text):
        if a >= end or not end:
            out += [text[at:a], mark]
        at = end = max(end, b)
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in text replaced and n_chars counted anew; all other columns and rows as they were."""
    shared_dir(spark)

    def run(batches):
        for batch in batches:
            text = pa.array([redact(t) for t in batch.column("text").to_pylist()], pa.string())
            arrays = [text if name == "text" else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
