"""Record and message expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALERT_TEXT = "predicted to be an anomaly"  # fixed value: consumers match on it


def sum_of(*columns: str) -> Column:
    """Sum of columns; null as soon as one of them is null."""
    total = F.col(columns[0])
    for name in columns[1:]:
        total = total + F.col(name)
    return total


def to_message(columns: list[str]) -> Column:
    """One JSON text per row, nulls written out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def message_value(value: str = "value") -> Column:
    """The text of a (key, value) message."""
    return F.col(value).cast("string")


def utc_text(moment: Column) -> Column:
    """ISO-8601 text without a zone, in UTC, from a TIMESTAMP."""
    in_utc = F.to_utc_timestamp(moment, F.current_timezone())
    return F.date_format(in_utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def parse_utc(text: Column) -> Column:
    """Zone-free ISO-8601 text, with or without a fraction, as TIMESTAMP_NTZ."""
    return F.to_timestamp_ntz(text)


def as_alert(df: DataFrame, vector: str = "features", text: str = ALERT_TEXT) -> DataFrame:
    """Drop what JSON cannot carry and attach the alert text."""
    return df.drop(vector, "rawPrediction", "probability", "prediction").withColumn(
        "alert_text", F.lit(text)
    )
