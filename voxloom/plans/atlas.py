"""Atlases: a partition with a table of its labels, checked against each other, and figures by the labels' hierarchy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contracts import InvalidArgument, assert_same_space, digest
from .digests import frame_digest
from .frame import Frame, small

COLUMNS = ("label", "name", "hemi", "network")
#: Ids that an error message names.
NAMED = 20


@dataclass(frozen=True)
class Atlas:
    """``labels``: a labels frame; ``table``: label, name, hemi, network (hemi and network may be null).

    ``provenance`` has whatever the caller gives and two digests: of the image (image_hash) and of the table (label_table_hash).
    """

    id: str
    labels: Frame
    table: DataFrame
    background: int = 0
    provenance: dict = field(default_factory=dict)

    @property
    def space(self):
        return self.labels.space


def atlas(id: str, labels: Frame, table: DataFrame, background: int = 0, **provenance) -> Atlas:
    """An atlas whose image and table have been compared both ways; a mismatch raises and names the labels.

    Rows of the image with the background's label are dropped. Missing columns hemi and network are null.
    """
    if labels.kind != "labels":
        raise InvalidArgument("an atlas needs a labels frame")
    own = table.select(F.col("label").cast("long").alias("label"), F.col("name").cast("string").alias("name"), *((F.col(c) if c in table.columns else F.lit(None)).cast("string").alias(c) for c in COLUMNS[2:]))
    image = labels.like(labels.df.where(F.col("label") != background).select("v", F.col("label").cast("long").alias("label")), sparse=True)
    told = own.groupBy("label").agg(F.count("*").alias("rows"))
    seen = image.df.select("label").distinct().withColumn("seen", F.lit(True))
    both = told.join(seen, "label", "full").select("label", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("seen", F.lit(False)).alias("seen"))
    wrong = {"label numbers must be unique": F.col("rows") > 1, "the background is among the labels": (F.col("label") == background) & (F.col("rows") > 0), "the table lacks labels of the image": F.col("rows") == 0, "the image lacks labels of the table": ~F.col("seen")}
    found = both.agg(*(F.slice(F.sort_array(F.collect_set(F.when(c, F.col("label")))), 1, NAMED) for c in wrong.values())).first()
    for what, ids in zip(wrong, found):
        if ids:
            raise InvalidArgument(f"{what}: {list(ids)}")
    text = F.concat_ws(":", F.col("label").cast("string"), F.coalesce("name", F.lit("")), F.coalesce("hemi", F.lit("")), F.coalesce("network", F.lit("")))
    rows = own.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", text.alias("text")))), lambda x: x.text), "|"), 256)).first()[0]  # a row per label
    return Atlas(id, image, own, background, {**provenance, "image_hash": frame_digest(image), "label_table_hash": digest(rows)})


def default_table(labels: Frame, background: int = 0) -> DataFrame:
    """A table for an image without one: a row for each label, named after it."""
    found = labels.df.where(F.col("label") != background).select(F.col("label").cast("long").alias("label")).distinct()
    return found.select("label", F.concat(F.lit("parcel_"), F.col("label").cast("string")).alias("name"))


def rollup(of: Atlas, values: Frame) -> DataFrame:
    """(network, hemi, label, n, mean): of a volume by label, by network and hemisphere, by network, and in all (nulls stand for what is summed over; level: 0 to 3).

    A label without a network or hemisphere has that of the name "". What a sparse volume lacks is zero.
    """
    assert_same_space(of.space, values.space)
    value = F.col(values.value).cast("double")
    sums = of.labels.df.join(values.df.select("v", value.alias("x")), "v", "left" if values.sparse else "inner").groupBy("label").agg(F.sum(F.coalesce("x", F.lit(0.0))).alias("s"), F.count("*").alias("n"))
    named = sums.join(small(of.table), "label").select(F.coalesce("network", F.lit("")).alias("network"), F.coalesce("hemi", F.lit("")).alias("hemi"), "label", "s", "n")
    level = F.when(F.grouping("network") == 1, 3).when(F.grouping("hemi") == 1, 2).when(F.grouping("label") == 1, 1).otherwise(0)
    out = named.rollup("network", "hemi", "label").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), level.alias("level"))
    return out.select("level", "network", "hemi", "label", "n", F.try_divide("s", "n").alias("mean"))


def parcel_series(of: Atlas, series: Frame) -> DataFrame:
    """(label, name, t, x): the mean series of each parcel, with its name."""
    from ..operators.reduce import parcel_means

    return parcel_means(series, of.labels).df.join(small(of.table.select("label", "name")), "label").select("label", "name", "t", "x")
