"""State of a stateful stream: where it is kept, and reading what a checkpoint holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb_session(spark: SparkSession) -> SparkSession:
    """A session whose streams keep their state in RocksDB: on disk, not in the executors' heaps.

    Only what changes is uploaded to the checkpoint. A stream stays with the store it was first
    started with.
    """
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return own


def state_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, value, partition_id) of the state after the last batch of a stopped stream."""
    return spark.read.format("statestore").load(checkpoint)
