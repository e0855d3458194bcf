"""Where intermediate tables go: the shared folder the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
WAREHOUSE_CONF = "spark.sql.warehouse.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ONE_FILE = str(1 << 40)  # bytes no file reaches, yet small enough for Spark to add up


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and Spark runs locally, one in the warehouse.

    On a cluster the setting is demanded: what it would be by default lies on the driver's machine.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    return (folder or f"{spark.conf.get(WAREHOUSE_CONF).rstrip('/')}/_intermediate").rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path nothing has been written to yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, keeps pruning."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_compact(df: DataFrame, name: str) -> str:
    """As ``materialize``, for large tables: gives the path, compresses harder, keeps no shuffle files.

    Spark would keep what it shuffled on the executors' disks until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    kept = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP_CONF, kept)
    return path


def whole_file_session(spark: SparkSession) -> SparkSession:
    """A session that reads every file as one partition, so that tables keep the layout they were written in."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.files.maxPartitionBytes", ONE_FILE)
    own.conf.set("spark.sql.files.openCostInBytes", ONE_FILE)
    own.conf.set("spark.sql.files.maxPartitionNum", str((1 << 31) - 1))
    return own
