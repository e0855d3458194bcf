"""Folders that streams write batch by batch, read as if every batch had been written once.

A batch is written below ``_attempt=<name>`` in its partitions, by a name of its own, and counts once
the name is entered in ``_batches``. What an interrupted attempt has left is never read, a batch that is
run again after its entry is not written again, and runs with different checkpoints share a folder
without touching each other's files.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrow.sources import filesystem

ATTEMPT = "_attempt"
ENTRIES = "_batches"
RUN_FILE = "run-id"
#: Up to so many entries are broadcast to the rows they let through; more are joined by sorting.
MAX_BROADCAST_ENTRIES = 100_000


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint belongs to, kept beside its offsets; made by the first start."""
    path = f"{checkpoint}/{RUN_FILE}"
    known = filesystem.read_line(spark, path)
    if not known:
        made = f"r{uuid.uuid4().hex}"
        filesystem.write_line(spark, path, made, replace=known is not None)
        known = filesystem.read_line(spark, path)
    return known


class CommittedSink:
    """JSON lines of one run's batches under ``root``, in folders of ``by`` and of the attempt."""

    def __init__(self, spark: SparkSession, root: str, run: str, by: Sequence[str] = ("batch",)) -> None:
        self.spark = spark
        self.root = root
        self.run = run
        self.by = list(by)

    def _entry(self, batch_id: int) -> str:
        return f"{self.root}/{ENTRIES}/{self.run}.{batch_id}"

    def has(self, batch_id: int) -> bool:
        return bool(filesystem.read_line(self.spark, self._entry(batch_id)))

    def write(self, df: DataFrame, batch_id: int) -> None:
        """Write and enter a batch; nothing happens if it has been entered before."""
        if self.has(batch_id):
            return
        attempt = f"{self.run}.{batch_id}.{uuid.uuid4().hex[:8]}"
        named = df.withColumn(ATTEMPT, F.lit(attempt))
        if "batch" in self.by:
            named = named.withColumn("batch", F.lit(batch_id))
        named.write.mode("append").partitionBy(*self.by, ATTEMPT).json(self.root)
        # An empty entry is one whose writer died: it has never counted.
        filesystem.write_line(self.spark, self._entry(batch_id), attempt, replace=True)


def is_committed(spark: SparkSession, root: str) -> bool:
    return filesystem.exists(spark, f"{root}/{ENTRIES}")


def only_committed(rows: DataFrame, root: str) -> DataFrame:
    """Rows of entered attempts, without the attempt's name; all rows of a folder that has no entries."""
    spark = rows.sparkSession
    if ATTEMPT not in rows.columns or not is_committed(spark, root):
        return rows
    entered = spark.read.text(f"{root}/{ENTRIES}").select(F.col("value").alias(ATTEMPT)).distinct()
    if entered.count() <= MAX_BROADCAST_ENTRIES:
        entered = F.broadcast(entered)
    return rows.join(entered, ATTEMPT, "left_semi").drop(ATTEMPT)
