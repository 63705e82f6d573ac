"""Header extensions of many NIfTI files as rows, their content as columns by code."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: names of extension codes.
CODES = {
    0: "unknown", 2: "dicom", 4: "afni", 6: "comment", 8: "xcede", 10: "jimdiminfo", 12: "workflow_fwds", 14: "freesurfer",
    16: "pypickle", 18: "mind_ident", 20: "b_value", 22: "spherical_direction", 24: "dt_component", 26: "shc_degreeorder",
    28: "voxbo", 30: "caret", 32: "cifti", 34: "variable_frame_timing", 38: "eval", 40: "matlab", 42: "quantiphyse", 44: "mrs",
}

#: How Spark reads an AFNI extension: attributes of elements get the prefix, the text of one that has some is ``text``.
AFNI = "AFNI_atr array<struct<_atr_name string, _ni_type string, _ni_dimen string, text string>>, _self_idcode string"


def name_of(code: int) -> str:
    return CODES.get(int(code), "unknown")


def read_extensions(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, place, code, name, content, text, afni): a row for each extension of each file, in the header's order.

    content: the bytes; text: of comments (code 6), without zeros at the end, bytes that are no UTF-8 replaced; afni: of
    code 4, id and attributes, null where the content is no such XML. ``paths``: a list, or a folder or pattern.
    Files without extensions have no row; one that is no NIfTI file has one row with all but its path null.
    """
    if isinstance(paths, str):
        named = spark.read.format("binaryFile").load(paths).select("path")
    else:
        named = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)))
    schema = pa.schema([("path", pa.string()), ("place", pa.int32()), ("code", pa.int32()), ("content", pa.binary()), ("text", pa.string())])

    def run(batches):
        from . import nifti

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    found = nifti.read_header(path).extensions
                except Exception:  # a row says so
                    rows.append({"path": path})
                    continue
                rows += [{"path": path, "place": k, "code": code, "content": raw, "text": raw.rstrip(b"\0").decode("utf-8", "replace")} for k, (code, raw) in enumerate(found)]
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    rows = named.mapInArrow(run, "path string, place int, code int, content binary, text string")
    names = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    afni = F.from_xml(F.when(F.col("code") == 4, F.col("text")), AFNI, {"attributePrefix": "_", "valueTag": "text", "mode": "PERMISSIVE"})
    whole = F.when(afni.AFNI_atr.isNotNull(), afni)
    return rows.select("path", "place", "code", F.when(F.col("code").isNotNull(), F.coalesce(F.try_element_at(names, F.col("code")), F.lit("unknown"))).alias("name"), "content", F.when(F.col("code") == 6, F.col("text")).alias("text"), whole.alias("afni"))


def afni_attributes(extensions: DataFrame) -> DataFrame:
    """(path, place, attribute, type, value): the attributes of all AFNI extensions; the value without blanks and quotes about it."""
    rows = extensions.where("code = 4 and afni is not null").select("path", "place", F.explode("afni.AFNI_atr").alias("a"))
    value = F.regexp_replace(F.trim(F.col("a.text")), '^"|"$', "")
    return rows.select("path", "place", F.col("a._atr_name").alias("attribute"), F.col("a._ni_type").alias("type"), value.alias("value"))
