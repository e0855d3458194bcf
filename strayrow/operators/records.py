"""Enriching, stamping and de-duplicating records."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.functions.expressions import sum_of, utc_text
from strayrow.functions.hashing import row_text
from strayrow.operators.positions import dense_index, ordered_index


def enrich(
    df: DataFrame, parts: Iterable[str] = ("src_bytes", "dst_bytes"), out: str = "total_bytes"
) -> DataFrame:
    """Add the sum of ``parts``; null if any part is null."""
    return df.withColumn(out, sum_of(*parts))


def dedupe(
    df: DataFrame, key: Sequence[str] | None, keep_first_by: Sequence[str] = ()
) -> DataFrame:
    """One row per key: any of its copies, or the first by ``keep_first_by``.

    The first by an order is found with an aggregate, not a window: each map task reduces a hot
    key to one row before the shuffle. What the order leaves open, the remaining columns decide.
    ``key=None`` leaves the rows as they are.
    """
    if key is None:
        return df
    key = list(key)
    order = [c for c in keep_first_by if c not in key]
    if not order:
        return df.dropDuplicates(key)
    rest = [c for c in df.columns if c not in key and c not in order]
    kept = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return kept.select(*[c if c in key else F.col(f"_first.`{c}`").alias(c) for c in df.columns])


def dedupe_stream(
    df: DataFrame, key: Iterable[str], event_time: str, delay: str, spread: bool = False
) -> DataFrame:
    """One row per key of a stream, for copies that arrive within ``delay`` of each other.

    ``event_time`` must be a TIMESTAMP. With ``spread`` the copies of a key are first reduced
    per source partition, so a hot key reaches its final task already thinned out.
    """
    key = list(key)
    marked = df.withWatermark(event_time, delay)
    if spread:
        # Any value is right here: this step may only drop copies of a row it has let through.
        thinned = marked.withColumn("_source_task", F.spark_partition_id())
        marked = thinned.dropDuplicatesWithinWatermark([*key, "_source_task"]).drop("_source_task")
    return marked.dropDuplicatesWithinWatermark(key)


def stamp_records(
    df: DataFrame,
    key: Sequence[str] | None = None,
    order: Sequence[str] | None = None,
    source_index: str | None = None,
    random_uuid: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Add ``sequence_id``, ``uuid``, ``utc`` and ``index``.

    Without ``source_index`` the records are one pass over the source: ``sequence_id`` and
    ``index`` are both the dense position, in the given ``order`` or else in hash order. With it
    ``df`` holds drawn records, numbered by ``sequence_id`` already, and ``source_index`` names
    the position each was drawn from.

    ``uuid`` is the md5 of the sequence number and the record, so a re-run gives the same ids;
    ``random_uuid`` asks for version 4 ids instead.
    """
    names = list(df.columns)
    if source_index is None:
        if order is not None:
            numbered = ordered_index(df, order)
        else:
            numbered = dense_index(df, key, "index", rows)
        stamped = numbered.withColumn("sequence_id", F.col("index"))
    else:
        stamped = df.withColumnRenamed(source_index, "index")
        names = [c for c in names if c not in (source_index, "sequence_id")]
    if random_uuid:
        uuid = F.uuid()
    else:
        uuid = F.md5(F.concat_ws("|", F.col("sequence_id"), row_text(stamped, names)))
    utc = utc_text(F.current_timestamp())
    return stamped.select(*names, "sequence_id", uuid.alias("uuid"), utc.alias("utc"), "index")
