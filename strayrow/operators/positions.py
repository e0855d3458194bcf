"""Dense positions 0..n-1 without a single-task sort, and the numbering of identical rows."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strayrow.functions.hashing import HASH_BITS, key_hash, row_text, text_hash
from strayrow.workspace import materialize

ROWS_PER_BUCKET = 1 << 18
MIN_BUCKET_BITS = 5
MAX_BUCKET_BITS = 40
#: Bucket sizes that one task adds up, at most: more buckets are added up in two steps.
SUM_BITS = 20
REPEATS_PER_CHUNK = 1000


def bucket_bits(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Leading hash bits that cut ``rows`` rows into buckets of about ``rows_per_bucket``."""
    wanted = math.ceil(math.log2(max(1.0, rows / rows_per_bucket)))
    return min(MAX_BUCKET_BITS, max(MIN_BUCKET_BITS, wanted))


def explode_range(
    df: DataFrame, size: str, out: str, per_chunk: int = REPEATS_PER_CHUNK
) -> DataFrame:
    """Repeat each row ``size`` times, numbered 0.. in ``out``; drops ``size``.

    Rows repeated more than ``per_chunk`` times are cut into chunks that spread over the cluster
    first. The number of partitions is given outright, because the few rows to be spread look too
    small to Spark to be worth several tasks.
    """
    zero = F.lit(0).cast("bigint")
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    usual = df.filter(F.col(size) <= per_chunk).withColumn(
        out, F.explode(F.sequence(zero, F.col(size) - 1))
    )
    # The square root keeps both the list of chunks and the chunks short, however large the size.
    step = F.greatest(F.lit(per_chunk), F.ceil(F.sqrt(F.col(size)))).cast("bigint")
    last = F.least(F.col("_first") + step, F.col(size)) - 1
    hot = (
        df.filter(F.col(size) > per_chunk)
        .withColumn("_first", F.explode(F.sequence(zero, F.col(size) - 1, step)))
        .repartition(spread, *df.columns, "_first")
        .withColumn(out, F.explode(F.sequence(F.col("_first"), last)))
        .drop("_first")
    )
    return usual.unionByName(hot).drop(size)


def number_copies(
    df: DataFrame, out: str = "copy_no", per_chunk: int = REPEATS_PER_CHUNK
) -> DataFrame:
    """Number identical rows 0..c-1, so that (row, number) is unique.

    Copies are counted with a map-side aggregate and written out again afterwards, so no task
    ever holds one hot group.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return explode_range(counted, "_copies", out, per_chunk)


def with_row_id(df: DataFrame, key: Sequence[str] | None, out: str = "row_id") -> DataFrame:
    """Attach a text that identifies each row.

    ``key`` names columns that are unique together, for instance those a table was de-duplicated
    on. Without one the whole row plus the number of the copy identifies it.
    """
    if key is not None:
        return df.withColumn(out, row_text(df, key))
    numbered = number_copies(df, "_copy_no")
    return numbered.withColumn(
        out, F.concat_ws("#", F.md5(row_text(df, df.columns)), F.col("_copy_no"))
    ).drop("_copy_no")


def with_row_hash(df: DataFrame, key: Sequence[str] | None, out: str) -> DataFrame:
    """Attach a 60-bit hash of each row's identity, as ``with_row_id`` understands it."""
    if key is not None:
        return df.withColumn(out, key_hash(df, key))
    numbered = number_copies(df, "_copy_no")
    identity = F.concat_ws("#", row_text(df, df.columns), F.col("_copy_no"))
    return numbered.withColumn(out, text_hash(identity)).drop("_copy_no")


def _bucket_starts(sizes: DataFrame, group: list[str], bits: int) -> DataFrame:
    """(group, _bucket, _start): the rows of a group in the buckets before each, from (group, _bucket, _size).

    No task adds up more than 2^``SUM_BITS`` sizes: beyond that, runs of buckets are added up by
    themselves and shifted by the sums of the runs before them.
    """

    def before(value: str, by: list[str], order: str) -> Column:
        frame = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(frame), F.lit(0))

    if bits <= SUM_BITS:
        return sizes.select(*group, "_bucket", before("_size", group, "_bucket").alias("_start"))
    runs = sizes.withColumn("_run", F.shiftright("_bucket", bits - bits // 2))
    inside = runs.withColumn("_inside", before("_size", [*group, "_run"], "_bucket"))
    totals = runs.groupBy(*group, "_run").agg(F.sum("_size").alias("_size"))
    ahead = totals.select(*group, "_run", before("_size", group, "_run").alias("_ahead"))
    return inside.join(ahead, [*group, "_run"]).select(
        *group, "_bucket", (F.col("_ahead") + F.col("_inside")).alias("_start")
    )


def _bucketed(df: DataFrame, hash_column: str, bits: int) -> DataFrame:
    # Declared non-null, or the join with the bucket starts would hash every row twice to look for nulls.
    bucket = F.coalesce(F.shiftright(hash_column, HASH_BITS - bits), F.lit(0).cast("bigint"))
    return df.withColumn("_bucket", bucket)


def bucket_starts(
    df: DataFrame, hash_column: str, bits: int, group: Iterable[str] = ()
) -> DataFrame:
    """(group, _bucket, _start): the rank of the first row of every bucket of 2^``bits``."""
    sizes = _bucketed(df, hash_column, bits).groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    return _bucket_starts(sizes, list(group), bits)


def rank_by_hash(
    df: DataFrame,
    hash_column: str,
    out: str,
    expected_rows: int,
    group: Iterable[str] = (),
    ties: Iterable[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Dense rank 0..n-1 by a 60-bit hash, within each ``group``; ties break by ``ties``.

    The leading hash bits form buckets in hash order. Every bucket is ranked by itself and
    shifted by the sizes of the buckets before it. The sizes come from a pass that reads only
    what the hash needs; the join on the bucket reuses the partitioning of the ranking. With
    ``starts`` from ``bucket_starts`` of a whole table, ``df`` may be some of its buckets.
    """
    bits = bucket_bits(expected_rows, rows_per_bucket)
    keys = [*group, "_bucket"]
    if starts is None:
        starts = bucket_starts(df, hash_column, bits, group)
    within = Window.partitionBy(*keys).orderBy(hash_column, *ties)
    ranked = _bucketed(df, hash_column, bits).withColumn("_rank", F.row_number().over(within) - 1)
    return (
        ranked.join(starts, keys)
        .withColumn(out, (F.col("_start") + F.col("_rank")).cast("bigint"))
        .drop("_bucket", "_start", "_rank")
    )


def dense_index(
    df: DataFrame,
    key: Sequence[str] | None = None,
    out: str = "index",
    rows: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Number rows 0..n-1 in the order of their hashed identity.

    The numbering depends on the rows alone, not on how they are partitioned.
    """
    total = df.count() if rows is None else rows
    ranked = rank_by_hash(
        with_row_hash(df, key, "_hash"),
        "_hash",
        out,
        total,
        ties=df.columns if key is None else key,
        rows_per_bucket=rows_per_bucket,
    )
    return ranked.drop("_hash")


def ordered_index(df: DataFrame, order: Sequence[str], out: str = "index") -> DataFrame:
    """Number rows 0..n-1 in the order of ``order``, then of the remaining columns.

    The rows are range-partitioned on the whole row and the number of the copy, so a value that
    many rows share still splits over tasks. The sorted rows are written out once: their
    partitions must be the same when they are counted and when they are numbered.
    """
    rest = [c for c in df.columns if c not in order]
    ordered = (
        number_copies(df, "_copy_no")
        .orderBy(*order, *rest, "_copy_no")
        .drop("_copy_no")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    written = materialize(ordered, "ordered")
    # One row per sort partition.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        written.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    )
    return written.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + F.col("_place")).alias(out)
    )
