"""Frames as tables: bucketed and sorted by voxel, with space and receipt in the table's properties.

Frames of one space that are stored with equally many buckets meet voxel by voxel without a shuffle: scans keep the
buckets as the partitioning of aggregations and joins on ``v``. The properties are also written beside the data, so that
another session can attach a stored frame by its folder.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from .contracts import InvalidArgument, Receipt
from .frame import KEYS, Frame
from .space import Space

PROPERTY = "voxloom.frame"
BESIDE = "_voxloom_frame.json"


def to_json(frame: Frame, buckets: int) -> str:
    s = frame.space
    space = {"dim": s.dim, "spacing": s.spacing, "origin": s.origin, "trans": s.trans, "axes": s.axes}
    return json.dumps({"kind": frame.kind, "sparse": frame.sparse, "every_time": frame.every_time, "space": space, "receipt": frame.receipt.to_json() if frame.receipt else None, "buckets": buckets, "columns": frame.df.select(*frame.keys, frame.value).dtypes}, sort_keys=True)


def _described(text: str) -> dict:
    found = json.loads(text)
    space = found["space"]
    found["space"] = Space(tuple(space["dim"]), tuple(space["spacing"]), tuple(space["origin"]), tuple(map(tuple, space["trans"])), tuple(space["axes"]))
    found["receipt"] = Receipt.from_json(found["receipt"]) if found["receipt"] else None
    return found


def save(frame: Frame, name: str, path: str | None = None, buckets: int | None = None) -> Frame:
    """Stores a frame as the table ``name`` (in ``path``, else in the warehouse) and returns it as stored.

    One shuffle, by the bucketing key; a bucket is one file. ``buckets``: the session's shuffle partitions, unless given.
    A table of that name is an error.
    """
    spark = frame.df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = KEYS[frame.kind][0]
    rows = frame.df.select(*frame.keys, frame.value).repartition(buckets, key)
    writer = rows.write.format("parquet").bucketBy(buckets, key).sortBy(*frame.keys).mode("error")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    text = to_json(frame, buckets)
    _set(spark, name, text)
    from ..sources.images import filesystem

    store, inner = filesystem(_location(spark, name))
    with store.open_output_stream(f"{inner}/{BESIDE}", compression=None) as f:
        f.write(text.encode())
    return open_frame(spark, name)


def _set(spark: SparkSession, name: str, text: str) -> None:
    quoted = text.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{PROPERTY}' = '{quoted}')")


def _location(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").collect()
    return rows[0].data_type.replace("file:/", "file:///", 1) if rows[0].data_type.startswith("file:/") and not rows[0].data_type.startswith("file://") else rows[0].data_type


def open_frame(spark: SparkSession, name: str) -> Frame:
    """A stored frame; a table without its properties is an error."""
    found = dict(spark.sql(f"SHOW TBLPROPERTIES {name}").collect())
    if PROPERTY not in found:
        raise InvalidArgument(f"{name} is no stored frame")
    about = _described(found[PROPERTY])
    return Frame(spark.table(name), about["space"], about["kind"], about["sparse"], about["receipt"], about["every_time"])


def attach(spark: SparkSession, name: str, path: str) -> Frame:
    """Names the stored frame in a folder, as a session does that has not stored it itself."""
    from ..sources.images import read_bytes

    text = read_bytes(f"{path.rstrip('/')}/{BESIDE}").decode()
    about = _described(text)
    columns = ", ".join(f"{c} {kind}" for c, kind in about["columns"])
    keys = ", ".join(KEYS[about["kind"]])
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEYS[about['kind']][0]}) SORTED BY ({keys}) INTO {about['buckets']} BUCKETS LOCATION '{path}'")
    _set(spark, name, text)
    return open_frame(spark, name)
