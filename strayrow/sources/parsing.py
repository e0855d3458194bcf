"""Text to typed rows, with malformed rows marked instead of lost."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad"
FAILED = "_failed"
OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}


class Parsed(NamedTuple):
    """Rows that fit the schema, and the others as (raw, reason, source)."""

    rows: DataFrame
    quarantine: DataFrame


def _marked(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])


def mark_csv(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """The columns of ``schema``, and the text in ``_bad`` where a line does not fit it.

    The corrupt-record column is part of the parsed struct, so the parser always converts every
    field: which rows are bad does not depend on the columns a query goes on to read.
    """
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _marked(schema).fields)
    return _unpacked(lines, F.from_csv(F.col(column), ddl, OPTIONS), schema, column)


def mark_json(messages: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """As ``mark_csv`` for JSON text; a wrong field type marks the whole message.

    A message is one JSON value: null messages, further values and trailing text mark it as well.
    """
    values = F.from_json(F.concat(F.lit("["), F.col(column), F.lit("]")), "array<string>")
    single = F.coalesce(F.size(values) == 1, F.lit(False))
    parsed = F.from_json(F.col(column), _marked(schema), OPTIONS)
    return _unpacked(messages, parsed, schema, column, ~single)


def _unpacked(
    df: DataFrame, parsed: Column, schema: T.StructType, column: str, wrong: Column | None = None
) -> DataFrame:
    others = [F.col(c) for c in df.columns if c != column]
    wrong = F.lit(False) if wrong is None else wrong
    staged = df.select(*others, F.col(column).alias("_text"), parsed.alias("_parsed"), wrong.alias("_wrong"))
    fields = [F.col(f"_parsed.`{f.name}`").alias(f.name) for f in schema.fields]
    failed = F.col("_parsed").isNull() | F.col(f"_parsed.{BAD}").isNotNull() | F.col("_wrong")
    return staged.select(*others, *fields, F.when(failed, F.col("_text")).alias(BAD), failed.alias(FAILED))


def split_marked(marked: DataFrame, reason: str, source: str) -> Parsed:
    """Good rows, and the others' texts; a message without text is set aside with a null text."""
    rows = marked.filter(~F.col(FAILED)).drop(BAD, FAILED)
    quarantine = marked.filter(FAILED).select(
        F.col(BAD).alias("raw"), F.lit(reason).alias("reason"), F.lit(source).alias("source")
    )
    return Parsed(rows, quarantine)
