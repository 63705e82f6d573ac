"""NIfTI-1 files: header parsing and building; reading and writing by ``images``.

Files are read through Arrow's filesystems, so paths may lie on any store that it knows. Compressed files are written
as one gzip member for the header and one for each block of voxels; an extension of the header holds their sizes.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..plans.contracts import InvalidArgument, Receipt
from ..plans.frame import Frame
from ..plans.space import Space, matrix_to_quaternion, quaternion_to_matrix
from . import images
from .images import filesystem, first_member, read_bytes

#: Fixed values of the format: data type codes.
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
CODES = {np.dtype(v): k for k, v in DTYPES.items()}
HEADER = 348


#: Tag of the extension with the places a gzip member and the members' sizes.
MEMBERS_TAG = b"voxloom/members/v1:"


def is_compressed(path: str) -> bool:
    store, name = filesystem(path)
    with store.open_input_file(name) as f:
        return f.size() >= 2 and f.read_at(2, 0) == b"\x1f\x8b"


def head_bytes(path: str, size: int) -> bytes:
    """The first bytes of a file, inflated if it is gzip."""
    return first_member(path, size)[0] if is_compressed(path) else read_bytes(path, 0, size)


@dataclass(frozen=True)
class Header:
    dim: tuple[int, ...]
    pixdim: tuple[float, ...]
    dtype: str
    vox_offset: int
    slope: float
    intercept: float
    affine: tuple
    qform: int
    sform: int
    qfac: float
    description: str
    cal: tuple[float, float]
    extensions: tuple = ()

    @property
    def space(self) -> Space:
        space = Space(self.dim[:3], trans=self.affine)
        return space if len(self.dim) < 4 else space.add_dim(self.dim[3], self.pixdim[3] or 1.0)

    @property
    def receipt(self) -> Receipt | None:
        return next((r for code, raw in self.extensions if code == 6 and (r := Receipt.from_extension(raw))), None)

    @property
    def members(self) -> tuple[int, tuple[int, ...]] | None:
        """(places a member, sizes) of a file written with an index."""
        raw = next((raw for code, raw in self.extensions if code == 6 and raw.startswith(MEMBERS_TAG)), None)
        if raw is None:
            return None
        found = json.loads(raw.rstrip(b"\0")[len(MEMBERS_TAG) :])
        return found["block"], tuple(found["sizes"])


def parse_header(raw: bytes) -> Header:
    order = "<" if struct.unpack("<i", raw[:4])[0] == HEADER else ">"
    if struct.unpack(order + "i", raw[:4])[0] != HEADER or raw[344:347] not in (b"n+1", b"ni1"):
        raise InvalidArgument("not a NIfTI-1 header")

    def get(kind: str, at: int):
        return struct.unpack_from(order + kind, raw, at)

    dim = get("8h", 40)
    dims = tuple(max(1, d) for d in dim[1 : 1 + dim[0]])
    dims = dims + (1,) * (3 - len(dims))
    pixdim = get("8f", 76)
    code = get("h", 70)[0]
    if code not in DTYPES:
        raise InvalidArgument(f"data type {code} is not supported")
    slope, inter = get("2f", 112)
    qform, sform = get("2h", 252)
    b, c, d, qx, qy, qz = get("6f", 256)
    rows = get("12f", 280)
    qfac = -1.0 if pixdim[0] < 0 else 1.0
    if sform > 0:
        affine = np.vstack([np.array(rows).reshape(3, 4), [0, 0, 0, 1]])
    elif qform > 0:
        affine = quaternion_to_matrix(b, c, d, qfac, pixdim[1:4], (qx, qy, qz))
    else:
        affine = np.diag([*(p or 1.0 for p in pixdim[1:4]), 1.0])
    offset = int(get("f", 108)[0])
    extensions, at = [], 352
    if len(raw) > 351 and raw[348]:
        while at + 8 <= min(len(raw), offset or len(raw)):
            size, ecode = get("2i", at)
            if size < 8:
                break
            extensions.append((ecode, bytes(raw[at + 8 : at + size])))
            at += size
    return Header(dims, tuple(pixdim[1 : 1 + len(dims)]), order + DTYPES[code], offset, slope if np.isfinite(slope) and slope != 0 else 1.0, inter if np.isfinite(inter) else 0.0, tuple(map(tuple, affine.tolist())), qform, sform, qfac, raw[148:228].rstrip(b"\0").decode("latin1"), get("2f", 124), tuple(extensions))


def _header_and_data(path: str) -> tuple[str, str]:
    for a, b in ((".hdr", ".img"), (".hdr.gz", ".img.gz")):
        if path.endswith(a):
            return path, path[: -len(a)] + b
        if path.endswith(b):
            return path[: -len(b)] + a, path
    return path, path


def read_header(path: str) -> Header:
    head, data = _header_and_data(path)
    header = parse_header(head_bytes(head, 352))
    more = header.vox_offset if head == data else 0
    return parse_header(head_bytes(head, more)) if more > 352 else header


def stored(path: str) -> images.Stored | None:
    """Where a NIfTI file keeps its volumes; None if its content is another format's."""
    head, data = _header_and_data(path)
    raw = head_bytes(head, 352)
    if len(raw) < HEADER or raw[344:347] not in (b"n+1", b"ni1"):
        return None
    header = read_header(path)
    compressed = is_compressed(data)
    offset = header.vox_offset if head == data else 0
    start = first_member(data, offset)[1] if compressed and head == data and header.members else None
    block, sizes = header.members if start is not None else (0, ())
    dim = tuple(header.dim) + (1,) * (4 - len(header.dim))
    step = (header.pixdim[3] or 1.0) if len(header.dim) > 3 else 1.0
    receipt = header.receipt
    return images.Stored(path, "nifti", data, dim, float(step), tuple(float(x) for r in header.affine for x in r), (header.dtype,), (float(header.slope),), float(header.intercept), offset, compressed, block, start or 0, sizes, receipt.to_json() if receipt else None)


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """(v, t, x) of one file, or of many one behind the other in time; differing spaces raise BackendDrift."""
    return images._load(spark, path=paths[0]) if len(paths) == 1 else images.open_images(spark, list(paths))[0]


def read_series(spark: SparkSession, *paths: str) -> Frame:
    return images.read_image(spark, list(paths), "vec")


def read_volume(spark: SparkSession, path: str, index: int = 0) -> Frame:
    return images.read_volume(spark, path, index)


def extension(body: bytes, code: int = 6) -> bytes:
    size = -(-(len(body) + 8) // 16) * 16
    return struct.pack("<2i", size, code) + body.ljust(size - 8, b"\0")


def build_header(space: Space, dtype="f4", receipt: Receipt | None = None, description: str = "", more: bytes = b"") -> bytes:
    """The bytes before the data. more: further extensions."""
    kind = np.dtype(dtype)
    if kind not in CODES:
        raise InvalidArgument(f"data type {kind} cannot be written")
    extensions = (extension(receipt.to_extension()) if receipt is not None else b"") + more
    b, c, d, qfac, sizes = matrix_to_quaternion(space.matrix)
    raw = bytearray(HEADER)
    struct.pack_into("<i", raw, 0, HEADER)
    dims = list(space.dim) + [1] * (7 - space.ndim)
    struct.pack_into("<8h", raw, 40, space.ndim, *dims)
    struct.pack_into("<2h", raw, 70, CODES[kind], kind.itemsize * 8)
    struct.pack_into("<8f", raw, 76, qfac, *sizes, *(space.spacing[3:]), *[1.0] * (7 - 3 - len(space.spacing[3:])))
    struct.pack_into("<3f", raw, 108, 352 + len(extensions), 1.0, 0.0)
    struct.pack_into("<B", raw, 123, 10)
    raw[148:228] = description.encode("latin1")[:79].ljust(80, b"\0")
    struct.pack_into("<2h", raw, 252, 1, 1)
    struct.pack_into("<6f", raw, 256, b, c, d, *space.matrix[:3, 3])
    struct.pack_into("<12f", raw, 280, *space.matrix[:3].ravel())
    raw[344:348] = b"n+1\0"
    return bytes(raw) + (b"\1\0\0\0" if extensions else b"\0\0\0\0") + extensions


def write(frame: Frame, path: str, dtype: str = "f4", block: int | None = None) -> None:
    """One image file of a dense or sparse volume or series, by ``images.write_image``; compressed if its name ends in .gz."""
    build_header(frame.space, dtype)  # a type that cannot be written raises before any job

    def header(block: int, sizes: list[int]) -> bytes:
        index = extension(MEMBERS_TAG + json.dumps({"block": block, "sizes": sizes}).encode()) if sizes else b""
        return build_header(frame.space, dtype, frame.receipt, more=index)

    images.write_image(frame, path, np.dtype(dtype).newbyteorder("<").str, header, path.endswith(".gz"), block)
