"""Message streams: Kafka topics and replayed files."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def kafka_read_options(
    brokers: str,
    topic: str,
    starting_offsets: str = "latest",
    rate_per_sec: float | None = None,
    interval_sec: float = 15.0,
    group_id: str | None = None,
) -> dict[str, str]:
    """Options of a Kafka scan; a rate admits at most ``rate * interval`` messages per batch."""
    options = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
    }
    if group_id is not None:
        options["kafka.group.id"] = group_id
    if rate_per_sec is not None and rate_per_sec > 0:
        options["maxOffsetsPerTrigger"] = str(max(1, math.ceil(rate_per_sec * interval_sec)))
    return options


def kafka_messages(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """A topic as a stream of (key, value, ...) messages."""
    return spark.readStream.format("kafka").options(**options).load()


def replay_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    data_format: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Files of a directory or glob as a stream, oldest first, a bounded number per batch."""
    reader = spark.readStream.schema(schema).format(data_format)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def replay_messages(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """Text files as a stream of messages, one per line, in a ``value`` column."""
    schema = T.StructType([T.StructField("value", T.StringType())])
    return replay_table(spark, path, schema, "text", files_per_batch)
