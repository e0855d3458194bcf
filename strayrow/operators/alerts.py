"""From predictions to alerts and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strayrow.functions.expressions import as_alert

ALERTS_PER_BATCH = 5


def anomalies(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Rows predicted to be anomalies."""
    return df.filter(F.col(prediction) <= 0)


def first_alerts(df: DataFrame, order: Sequence[str], limit: int = ALERTS_PER_BATCH) -> DataFrame:
    """The first ``limit`` anomalies of one batch, as alert records."""
    return as_alert(df.orderBy(*order).limit(limit))


def first_alerts_per_batch(
    df: DataFrame, batch: str, order: Sequence[str], limit: int = ALERTS_PER_BATCH
) -> DataFrame:
    """The first ``limit`` anomalies of every batch of a history, as alert records.

    Spark keeps at most ``limit`` rows per batch in each map task before the shuffle, so a batch
    that holds most of the rows still sends few.
    """
    within = Window.partitionBy(batch).orderBy(*order)
    numbered = df.withColumn("_rank", F.row_number().over(within))
    return as_alert(numbered.filter(F.col("_rank") <= limit).drop("_rank"))


def count_flagged(
    df: DataFrame, batch: Sequence[str] = (), prediction: str = "prediction"
) -> DataFrame:
    """Rows, anomalies and emptiness, per batch or over everything."""
    return df.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(prediction) <= 0).alias("anomalies"),
        (F.count(F.lit(1)) == 0).alias("empty"),
    )
