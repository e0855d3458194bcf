"""Batch scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.sources.committed import ATTEMPT, is_committed, only_committed
from strayrow.sources.parsing import Parsed, mark_csv, mark_json, split_marked


#: Stands in no line, so that a line is one field.
LINE_SEPARATOR = "\u0001\u0002\u0001"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> Parsed:
    """Headerless CSV with a declared schema: one record per line, malformed lines set aside.

    A blank line is no record at all, as in Spark's own CSV source.
    """
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return split_marked(mark_csv(lines, schema), "malformed csv", path)


def scan_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines. Without a schema Spark infers one, which costs a pass over the data.

    With a schema, malformed lines are no records; ``scan_json_checked`` returns them as well.
    Of a folder that streams write in batches, only entered batches are read.
    """
    if schema is not None:
        return scan_json_checked(spark, path, schema).rows
    return only_committed(spark.read.json(path), path)


def scan_json_checked(spark: SparkSession, path: str, schema: T.StructType) -> Parsed:
    """JSON lines with a declared schema, malformed lines set aside.

    A field that is a directory column has the directory's value, as declared; other directory columns
    follow the schema's.
    """
    lines = spark.read.text(path)
    folders = [c for c in lines.columns if c != "value"]
    declared = [f for f in schema.fields if f.name in folders]
    if declared:
        attempt = [T.StructField(ATTEMPT, T.StringType())] if ATTEMPT in folders else []
        layout = T.StructType([T.StructField("value", T.StringType()), *declared, *attempt])
        lines = spark.read.schema(layout).text(path)
    lines = only_committed(lines, path)
    folders = [c for c in folders if c in lines.columns or c != ATTEMPT]
    lines = lines.filter(F.length(F.trim("value")) > 0)
    body = T.StructType([f for f in schema.fields if f.name not in folders])
    parsed = split_marked(mark_json(lines, body), "malformed json", path)
    names = list(dict.fromkeys([*schema.fieldNames(), *folders]))
    return Parsed(parsed.rows.select(*(F.col(f"`{c}`") for c in names)), parsed.quarantine)


def scan_sites_checked(
    spark: SparkSession, root: str, schema: T.StructType, sites: list[str] | None = None
) -> Parsed:
    """All records landed under ``root/date=.../site=...``, as one table, and the malformed lines.

    ``date`` and ``site`` come from the directory names, so filters on them prune directories.
    """
    names = [("value", T.StringType()), ("date", T.DateType()), ("site", T.StringType())]
    if is_committed(spark, root):
        names.append((ATTEMPT, T.StringType()))
    layout = T.StructType([T.StructField(*field) for field in names])
    # Whole lines: the text source can't take the declared types of directory columns in every case.
    whole = {"sep": LINE_SEPARATOR, "quote": "", "escape": "", "enforceSchema": "true"}
    lines = only_committed(spark.read.schema(layout).options(**whole).csv(root), root)
    lines = lines if sites is None else lines.filter(F.col("site").isin(sites))
    lines = lines.filter(F.length(F.trim("value")) > 0)
    parsed = split_marked(mark_json(lines, schema), "malformed json", root)
    return Parsed(parsed.rows.select(*schema.fieldNames(), "date", "site"), parsed.quarantine)


def scan_sites(
    spark: SparkSession, root: str, schema: T.StructType, sites: list[str] | None = None
) -> DataFrame:
    """The records of ``scan_sites_checked``: a malformed line is none."""
    return scan_sites_checked(spark, root, schema, sites).rows


def scan_records(
    spark: SparkSession, path: str, data_format: str, schema: T.StructType | None = None
) -> DataFrame:
    """Records from ``json`` or ``csv`` files; any other format is an error."""
    if data_format == "json":
        return scan_json(spark, path, schema)
    if data_format == "csv":
        if schema is None:
            raise ValueError("csv records need a declared schema")
        return scan_csv(spark, path, schema).rows
    raise ValueError(f"unknown data format: {data_format!r}")
