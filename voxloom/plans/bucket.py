"""Named volumes of one grid: a series whose times have names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contracts import InvalidArgument
from .frame import Frame


@dataclass(frozen=True)
class Bucket:
    """``series`` has a time for each of ``names``."""

    names: tuple[str, ...]
    series: Frame

    def __post_init__(self):
        if not self.names or len(set(self.names)) != len(self.names):
            raise InvalidArgument("names must be there, and differ")
        if self.series.kind != "series" or self.series.space.dim[3] != len(self.names):
            raise InvalidArgument(f"{len(self.names)} names for a series of {self.series.space.dim[3:]} times")

    def __len__(self) -> int:
        return len(self.names)

    def __contains__(self, name: str) -> bool:
        return name in self.names

    def volume(self, which: int | str) -> Frame:
        """By name, or by place (from the end if negative)."""
        from ..operators.select import volume_at

        if isinstance(which, str):
            if which not in self.names:
                raise InvalidArgument(f"no volume {which!r}")
            return volume_at(self.series, self.names.index(which))
        return volume_at(self.series, range(len(self))[which])

    def part(self, which: slice | list[str]) -> Bucket:
        """The volumes of a range, or of a list of names in its order."""
        from ..operators.select import sub_vector

        places = list(range(len(self)))[which] if isinstance(which, slice) else [self.names.index(n) for n in which]
        return Bucket(tuple(self.names[k] for k in places), sub_vector(self.series, places))

    def rows(self) -> DataFrame:
        """(name, v, value)."""
        return self.series.df.select(F.element_at(F.array(*map(F.lit, self.names)), F.col("t") + 1).alias("name"), "v", F.col("x").alias("value"))


def bucket(names, *volumes: Frame) -> Bucket:
    """Volumes of one space under names, in order."""
    from ..operators.reduce import concat

    names = tuple(names)
    if len(names) != len(volumes) or not volumes:
        raise InvalidArgument(f"{len(names)} names for {len(volumes)} volumes")
    if len(volumes) > 1:
        return Bucket(names, concat(*volumes))
    one = volumes[0]
    return Bucket(names, Frame(one.df.select("v", F.lit(0).alias("t"), F.col("value").alias("x")), one.space.spatial.add_dim(1), "series", one.sparse))
