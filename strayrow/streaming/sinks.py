"""Topic outputs of one micro-batch; ``sources.committed`` has the file outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strayrow.functions.expressions import to_message


def kafka_write_options(brokers: str, topic: str, linger_ms: int = 10) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": brokers,
        "topic": topic,
        "kafka.linger.ms": str(linger_ms),
    }


def as_messages(df: DataFrame) -> DataFrame:
    """Rows as JSON text in the ``value`` column a topic expects."""
    return df.select(to_message(df.columns).alias("value"))


def send_messages(df: DataFrame, options: dict[str, str]) -> None:
    """Send rows to a topic; every task sends its own partition.

    A replayed batch is sent again: consumers remove the copies by the record's ``uuid``.
    """
    as_messages(df).write.format("kafka").options(**options).save()
