"""AFNI HEAD/BRIK pairs and NIML elements."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..plans.contracts import InvalidArgument
from ..plans.frame import Frame
from ..plans.space import Space
from . import images
from .formats import AFNI, AFNI_GZ, exists
from .images import filesystem, read_bytes
from .nifti import is_compressed

#: Fixed values of the format: brick types.
BRICK_TYPES = {0: "u1", 1: "i2", 3: "f4"}
_BLOCK = re.compile(r"type\s*=\s*(\S+)\s+name\s*=\s*(\S+)\s+count\s*=\s*(\d+)\s+(.*)", re.S)


def parse_head(text: str) -> dict[str, list | str]:
    """Attributes of a HEAD file: numbers as lists, strings without their mark and end."""
    out: dict[str, list | str] = {}
    for block in re.split(r"\n\s*\n", text):
        m = _BLOCK.search(block)
        if not m:
            continue
        kind, name, count, body = m[1], m[2], int(m[3]), m[4]
        if kind.startswith("string"):
            out[name] = body.lstrip("'")[:count].rstrip("~\n")
        else:
            out[name] = [(float if kind.startswith("float") else int)(x) for x in body.split()[:count]]
    return out


def read_head(path: str) -> tuple[Space, int, list[str], list[float], str]:
    """(space, volumes, brick types, factors, byte order) of a HEAD file."""
    head = parse_head(read_bytes(path).decode("latin1"))
    for name in ("IJK_TO_DICOM", "DATASET_DIMENSIONS", "BRICK_TYPES"):
        if name not in head:
            raise InvalidArgument(f"{path} lacks {name}")
    m = np.array(head["IJK_TO_DICOM"], float)
    if len(m) != 12 or not np.isfinite(m).all():
        raise InvalidArgument("IJK_TO_DICOM must be 12 finite numbers")
    # DICOM axes run to L and P; ours to R and A
    affine = np.vstack([np.diag([-1, -1, 1]) @ m.reshape(3, 4), [0, 0, 0, 1]])
    types = head["BRICK_TYPES"]
    if any(t not in BRICK_TYPES for t in types):
        raise InvalidArgument(f"brick types {sorted(set(types))} are not supported")
    factors = [f or 1.0 for f in head.get("BRICK_FLOAT_FACS", [])] or [1.0] * len(types)
    order = ">" if str(head.get("BYTEORDER_STRING", "LSB_FIRST")).startswith("MSB") else "<"
    space = Space(tuple(head["DATASET_DIMENSIONS"][:3]), trans=tuple(map(tuple, affine.tolist())))
    return space, len(types), [order + BRICK_TYPES[t] for t in types], factors, order


def _brick(path: str) -> str:
    for f in (AFNI, AFNI_GZ):
        if exists(p := f.data_file(path)):
            return p
    raise FileNotFoundError(AFNI.data_file(path))


def stored(path: str) -> images.Stored | None:
    """Where an AFNI pair, by either of its names, keeps its volumes; None if its content is another format's."""
    base = re.sub(r"[.](HEAD|BRIK|BRIK[.]gz)$", "", path)
    if base == path or not exists(head := f"{base}.HEAD"):
        return None
    space, n, types, factors, _ = read_head(head)
    sizes = parse_head(read_bytes(head).decode("latin1")).get("VOXLOOM_MEMBERS", [])
    brick = _brick(head)
    compressed = is_compressed(brick)
    same = len(set(types)) == 1 and len(set(factors)) == 1
    return images.Stored(path, "afni", brick, (*space.dim[:3], n), 1.0, tuple(float(x) for r in space.trans for x in r), tuple(types[:1] if same else types), tuple(factors[:1] if same else factors), 0.0, 0, compressed, sizes[0] if sizes else 0, 0, tuple(sizes[1:]))


def read(spark: SparkSession, path: str) -> DataFrame:
    return images._load(spark, path=path)


def read_series(spark: SparkSession, path: str) -> Frame:
    return images.read_series(spark, path)


def _attribute(kind: str, name: str, values) -> str:
    body = f"'{values}~" if kind == "string" else " ".join(f"{v:g}" if kind == "float" else str(v) for v in values)
    count = len(values) + 1 if kind == "string" else len(values)
    return f"\ntype = {kind}-attribute\nname = {name}\ncount = {count}\n{body}\n"


def write(frame: Frame, path: str, dtype: str = "f4", compress: bool = False) -> tuple[str, str]:
    """A HEAD/BRIK pair of a volume or series; returns the two paths."""
    kind = np.dtype(dtype)
    codes = {np.dtype(v): k for k, v in BRICK_TYPES.items()}
    if kind not in codes:
        raise InvalidArgument(f"data type {kind} cannot be written")
    times = frame.space.dim[3] if frame.kind == "series" else 1
    base = path.removesuffix(".HEAD")
    brick = f"{base}.BRIK" + ".gz" * compress
    used = []

    def header(block: int, sizes: list[int]) -> bytes:
        used.append(block)
        return b""

    sizes = images.write_image(frame, brick, kind.newbyteorder("<").str, header, compress)
    dicom = (np.diag([-1, -1, 1]) @ frame.space.matrix[:3]).ravel()
    text = "".join((
        _attribute("integer", "DATASET_DIMENSIONS", [*frame.space.dim[:3], 0, 0]),
        _attribute("integer", "DATASET_RANK", [3, times, 0, 0, 0, 0, 0, 0]),
        _attribute("integer", "BRICK_TYPES", [codes[kind]] * times),
        _attribute("float", "BRICK_FLOAT_FACS", [0.0] * times),
        _attribute("float", "IJK_TO_DICOM", dicom.tolist()),
        _attribute("float", "DELTA", (np.array(frame.space.spacing[:3]) * [-1, -1, 1]).tolist()),
        _attribute("string", "BYTEORDER_STRING", "LSB_FIRST"),
        _attribute("integer", "VOXLOOM_MEMBERS", [used[-1], *sizes]) if compress else "",
    ))
    store, name = filesystem(f"{base}.HEAD")
    with store.open_output_stream(name) as f:  # last: with it the image is there
        f.write(text.encode())
    return f"{base}.HEAD", brick


_ELEMENT = re.compile(rb"<(\w[\w:.-]*)((?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>")
_PAIR = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def parse_niml(raw: bytes) -> list[dict]:
    """Elements of a NIML text: name, attributes and, where ni_type and ni_dimen tell, numbers (values by component)."""
    out, at = [], 0
    while m := _ELEMENT.search(raw, at):
        attributes = {k: a or b for k, a, b in _PAIR.findall(m[2].decode("latin1"))}
        element = {"name": m[1].decode(), "attributes": attributes, "data": None}
        at = m.end()
        if not m[3] and "ni_type" in attributes and "ni_dimen" in attributes:
            n = int(attributes["ni_dimen"].split(",")[0])
            kinds: list[str] = []
            for part in attributes["ni_type"].split(","):
                times, _, kind = part.strip().rpartition("*")
                kinds += [kind] * int(times or 1)
            form = attributes.get("ni_form", "")
            if form.startswith("binary") and len(set(kinds)) == 1:
                order = ">" if form.endswith("msbfirst") else "<"
                kind = np.dtype(order + {"int": "i4", "float": "f4", "double": "f8"}[kinds[0]])
                size = n * len(kinds) * kind.itemsize
                element["data"] = np.frombuffer(raw[at : at + size], kind).reshape(n, len(kinds)).T.astype(float)
                at += size
            else:
                end = raw.find(b"<", at)
                words = raw[at : end if end >= 0 else len(raw)].split()
                element["data"] = np.array(words[: n * len(kinds)], float).reshape(n, len(kinds)).T
        out.append(element)
    return out


def read_niml(spark: SparkSession, path: str) -> DataFrame:
    """(file, element, component, n, value) of NIML files, parsed where they are read."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content):
                for k, e in enumerate(parse_niml(bytes(content))):
                    if e["data"] is not None:
                        c, n = e["data"].shape
                        yield pd.DataFrame({"file": name, "element": k, "component": np.repeat(np.arange(c), n), "n": np.tile(np.arange(n), c), "value": e["data"].ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, element int, component int, n long, value double")
