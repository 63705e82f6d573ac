"""Errors, space and mask contracts, and the provenance record that derived frames carry."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace


class VoxloomError(Exception):
    """Base of all contract errors."""


class SpaceMismatch(VoxloomError, ValueError):
    pass


class MaskMismatch(VoxloomError, ValueError):
    pass


class OutOfBounds(VoxloomError, IndexError):
    pass


class WorldOutOfBounds(OutOfBounds):
    pass


class BackendDrift(VoxloomError, ValueError):
    pass


class Immutable(VoxloomError, AttributeError):
    pass


class InvalidSpace(VoxloomError, ValueError):
    pass


class InvalidArgument(VoxloomError, ValueError):
    pass


class ImplicitConversion(VoxloomError, TypeError):
    pass


#: Tag of a record inside a file header extension.
RECEIPT_TAG = b"voxloom/receipt/v1:"
NO_MASK = "none"


@dataclass(frozen=True)
class Receipt:
    """What made a frame: hashes come from driver metadata, never from row order."""

    method_name: str = ""
    space_hash: str = ""
    mask_hash: str = NO_MASK
    radius: float | None = None
    n_voxels: int = 0
    seed: int | None = None
    source_affine: tuple = ()
    version: str = "1"

    def diff(self, other: Receipt) -> dict[str, tuple]:
        a, b = asdict(self), asdict(other)
        return {k: (a[k], b[k]) for k in a if a[k] != b[k]}

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Receipt:
        data = json.loads(text)
        affine = data.get("source_affine") or ()
        return cls(**{**data, "source_affine": tuple(tuple(r) if isinstance(r, list) else r for r in affine)})

    def merge(self, other: Receipt) -> Receipt:
        """One record for a result of two inputs; their spaces and real masks must agree."""
        if self.space_hash != other.space_hash:
            raise SpaceMismatch(f"receipts of two spaces: {self.space_hash} and {other.space_hash}")
        masks = {self.mask_hash, other.mask_hash} - {NO_MASK}
        if len(masks) > 1:
            raise MaskMismatch(f"receipts of two masks: {sorted(masks)}")

        def agreed(name):
            a, b = getattr(self, name), getattr(other, name)
            return a if a == b else None

        return replace(self, method_name="+".join(x for x in (self.method_name, other.method_name) if x), mask_hash=masks.pop() if masks else NO_MASK, radius=agreed("radius"), seed=agreed("seed"), n_voxels=max(self.n_voxels, other.n_voxels))

    def chain(self, op: str, n_voxels: int | None = None) -> Receipt:
        return replace(self, method_name=f"{self.method_name}+{op}" if self.method_name else op, n_voxels=self.n_voxels if n_voxels is None else n_voxels)

    def to_extension(self) -> bytes:
        return RECEIPT_TAG + self.to_json().encode()

    @classmethod
    def from_extension(cls, payload: bytes) -> Receipt | None:
        payload = payload.rstrip(b"\0")
        if not payload.startswith(RECEIPT_TAG):
            return None
        try:
            return cls.from_json(payload[len(RECEIPT_TAG) :].decode())
        except (ValueError, TypeError):
            return None


def digest(*parts) -> str:
    """16 hex digits of SHA-256 over the parts' texts."""
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class OpParams:
    """Parameters of one operation; radius and seed reach its receipt."""

    method_name: str
    radius: float | None = None
    seed: int | None = None
    extra: dict = field(default_factory=dict)


def receipt_for(space, params: OpParams, mask_hash: str = NO_MASK, n_voxels: int = 0, upstream: Receipt | None = None) -> Receipt:
    own = Receipt(params.method_name, space.hash, mask_hash, params.radius, n_voxels, params.seed, tuple(map(tuple, space.trans)))
    return upstream.merge(own) if upstream is not None else own


def assert_same_space(a, b) -> None:
    a.compatible_with(b)


def assert_same_mask(a: Receipt, b: Receipt) -> None:
    if a.mask_hash != b.mask_hash:
        raise MaskMismatch(f"masks differ: {a.mask_hash} and {b.mask_hash}")
