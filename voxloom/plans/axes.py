"""Anatomical axes: names and codes, sets of axes, orientation and bounds of slices.

An axis is the letter of the side that it runs to: R, L, A, P, S or I; other axes keep whatever name they have.
"""

from __future__ import annotations

import numpy as np

from .contracts import InvalidArgument, InvalidSpace, OutOfBounds
from .space import Space

# Names of the directions, by the side that an axis begins on, in pairs of opposites.
NAMES = {"L": "Left-to-Right", "R": "Right-to-Left", "P": "Posterior-to-Anterior", "A": "Anterior-to-Posterior", "I": "Inferior-to-Superior", "S": "Superior-to-Inferior"}
OPPOSITE = dict(zip("LRPAIS", "RLAPSI"))
#: The axis across each kind of slice.
ACROSS = {"sagittal": 0, "coronal": 1, "axial": 2}


def named(axis: str) -> str:
    """The direction's name: an axis that runs to R goes from left to right; another axis has its own."""
    return NAMES.get(OPPOSITE.get(axis, ""), axis)


def match_axis(text: str) -> str:
    """The axis for a code or a name of where it begins: ``L``, ``left`` and ``Left-to-Right`` all run to R."""
    key = "".join(c for c in str(text).upper() if c.isalpha())
    for side, name in NAMES.items():
        if key in (side, name.split("-")[0].upper(), "".join(c for c in name.upper() if c.isalpha())):
            return OPPOSITE[side]
    raise InvalidArgument(f"no axis {text!r}")


def find_anatomy(codes: str) -> tuple[str, str, str]:
    """Three axes of codes such as ``LPI`` (each the side that an axis begins on); two of one line are an error."""
    letters = "".join(c for c in codes.upper() if c.isalpha())
    if len(letters) != 3:
        raise InvalidArgument(f"three codes, not {codes!r}")
    axes = tuple(match_axis(c) for c in letters)
    if len({frozenset((a, OPPOSITE[a])) for a in axes}) < 3:
        raise InvalidArgument(f"{codes!r} names one line twice")
    return axes


def _at(axes: tuple, which: int | str) -> int:
    if isinstance(which, str):
        found = [k for k, a in enumerate(axes) if which in (a, named(a))]
        if not found:
            raise InvalidSpace(f"no axis {which!r} among {axes}")
        return found[0]
    return range(len(axes))[which]


def flip(axes: tuple, which: int | str) -> tuple:
    """One axis turned round; an axis that is not anatomical gets a minus, or loses it."""
    k = _at(axes, which)
    turned = OPPOSITE.get(axes[k]) or (axes[k][1:] if axes[k].startswith("-") else f"-{axes[k]}")
    return (*axes[:k], turned, *axes[k + 1 :])


def permute(axes: tuple, order) -> tuple:
    if sorted(order) != list(range(len(axes))):
        raise InvalidArgument(f"{tuple(order)} is no order of {len(axes)} axes")
    return tuple(axes[k] for k in order)


def drop(axes: tuple, which: int | str) -> tuple:
    k = _at(axes, which)
    return (*axes[:k], *axes[k + 1 :])


def add(axes: tuple, axis: str) -> tuple:
    if axis in axes:
        raise InvalidArgument(f"axis {axis} is there")
    return (*axes, axis)


def slice_orientation(space: Space, kind: str) -> str:
    """The names of the two axes that a slice shows, joined by a dash."""
    if kind not in ACROSS:
        raise InvalidArgument(f"no slice {kind!r}")
    return "-".join(named(a) for k, a in enumerate(space.axes[:3]) if k != ACROSS[kind])


def slice_bounds(space: Space, kind: str, index: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest world coordinates of the voxel centres of a slice, or of the whole grid."""
    if kind not in ACROSS:
        raise InvalidArgument(f"no slice {kind!r}")
    ends = [(0, d - 1) for d in space.dim[:3]]
    if index is not None:
        if not 0 <= index < space.dim[ACROSS[kind]]:
            raise OutOfBounds(f"no slice {index}")
        ends[ACROSS[kind]] = (index, index)
    corners = space.spatial.grid_to_world([(i, j, k) for i in ends[0] for j in ends[1] for k in ends[2]])
    return corners.min(0), corners.max(0)
