"""Landing messages as text under ``date=.../site=...``, and merging the small files later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from strayrow.functions.expressions import message_value
from strayrow.sources.committed import only_committed

FILE_BYTES = 134217728  # fixed value: landed files roll at 128 MiB
#: Files are read in so many blocks for each target file; a block goes to one file whole.
BLOCKS_PER_FILE = 8
#: Up to so many source files are broadcast, 16 bytes each, to the lines read from them.
MAX_BROADCAST_FILES = 1_000_000
#: Parts of a folder's files whose running sums are taken apart.
SUM_PARTS = 256


def with_landing_columns(messages: DataFrame, site: str) -> DataFrame:
    """Message text with the date of arrival and the site it arrived at."""
    return messages.select(
        message_value().alias("value"), F.current_date().alias("date"), F.lit(site).alias("site")
    )


def land_stream(dated: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends (value, date, site) to ``root``; set a trigger and start it.

    Tasks write their own files per directory: nothing is shuffled, so a site that holds most of
    the messages is written by as many tasks as read them.
    """
    return (
        dated.writeStream.format("text")
        .partitionBy("date", "site")
        .option("path", root)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def land_table(dated: DataFrame, root: str) -> None:
    """The same layout from a batch table."""
    dated.write.mode("append").partitionBy("date", "site").text(root)


def _of_dates(df: DataFrame, dates: Sequence[str] | None) -> DataFrame:
    return df if dates is None else df.filter(F.col("date").isin(list(dates)))


def _listed(session: SparkSession, root: str, dates: Sequence[str] | None) -> DataFrame:
    files = only_committed(session.read.format("binaryFile").load(root).select("*", "_metadata"), root)
    return _of_dates(files.select(F.col("_metadata.file_path").alias("path"), "date", "site", "length"), dates)


def landed_files(spark: SparkSession, root: str, dates: Sequence[str] | None = None) -> DataFrame:
    """(path, date, site, length) of the landed files, from the listing alone: no content is read."""
    return _listed(_reading_in_blocks(spark, FILE_BYTES), root, dates)


def target_files(files: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(path, date, site, length, offset, share, first): where each file lies among its directory's bytes.

    A directory of b bytes becomes round(b / ``file_bytes``) files, one at least, of ``share`` bytes each.
    They are numbered over all directories; ``first`` is the number of a directory's first one. Running
    sums are taken in parts and joined by the parts' sums, so no task holds all files of a directory.
    """
    folder = ["date", "site"]
    parted = files.withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(SUM_PARTS)))
    sums = parted.groupBy(*folder, "_part").agg(F.sum("length").alias("_bytes"))
    before = Window.partitionBy(*folder).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select(
        *folder,
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_start"),
        F.sum("_bytes").over(Window.partitionBy(*folder)).alias("_total"),
    ).withColumn("_files", F.greatest(F.lit(1), F.round(F.col("_total") / file_bytes)).cast("bigint"))
    # One row for each directory.
    numbered = parts.select(*folder, "_files").distinct()
    earlier = Window.orderBy(*folder).rowsBetween(Window.unboundedPreceding, -1)
    numbered = numbered.withColumn("first", F.coalesce(F.sum("_files").over(earlier), F.lit(0))).drop("_files")
    within = Window.partitionBy(*folder, "_part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    placed = parted.withColumn("_ahead", F.coalesce(F.sum("length").over(within), F.lit(0)))
    return (
        placed.join(parts, [*folder, "_part"])
        .join(numbered, folder)
        .select(
            "path",
            *folder,
            "length",
            (F.col("_start") + F.col("_ahead")).alias("offset"),
            F.greatest(F.lit(1.0), F.col("_total") / F.col("_files")).alias("share"),
            "first",
            "_files",
        )
    )


def _reading_in_blocks(spark: SparkSession, block_bytes: int) -> SparkSession:
    """A session of the same settings that reads files in blocks of at most ``block_bytes``."""
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes))
    own.conf.set("spark.sql.files.openCostInBytes", "0")
    # Dates and sites are directory names: 007 is not 7.
    own.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    return own


def compact(
    spark: SparkSession,
    root: str,
    target: str,
    file_bytes: int = FILE_BYTES,
    dates: Sequence[str] | None = None,
) -> None:
    """Rewrite landed text into files of about ``file_bytes``, in the same layout at ``target``.

    With ``dates`` only those are read, and only their directories are replaced at ``target``: others
    stay as they are. Lines are moved as text, unparsed, and shuffled once. Files are read in blocks of an
    eighth of a target file; a block goes to the target file its first byte falls into, so files lie
    between 0.54 and 1.46 of ``file_bytes``, but for directories below half of it and for source files
    that cannot be split. Every target file is one task's. Only entered batches of a committed
    folder are read. A line's file is looked up by a hash of its path: two paths of equal hash could only
    move lines to another file of the run.
    """
    if root.rstrip("/") == target.rstrip("/"):
        raise ValueError("the compacted files need a folder of their own")
    own = _reading_in_blocks(spark, max(1, file_bytes // BLOCKS_PER_FILE))
    planned = target_files(_listed(own, root, dates), file_bytes)
    size = planned.agg(
        F.count(F.lit(1)).alias("sources"), F.max(F.col("first") + F.col("_files")).alias("targets")
    ).first()
    if not size["sources"]:
        return
    lines = only_committed(own.read.text(root).select("*", "_metadata"), root)
    lines = _of_dates(lines, dates).select(
        "value",
        "date",
        "site",
        F.xxhash64("_metadata.file_path").alias("_source"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    paths = planned.select(F.xxhash64("path").alias("_source"), "offset", "share", "first", "_files")
    paths = paths.dropDuplicates(["_source"])
    if size["sources"] <= MAX_BROADCAST_FILES:
        paths = F.broadcast(paths)
    number = F.least(F.floor((F.col("offset") + F.col("_block")) / F.col("share")), F.col("_files") - 1)
    dealt = lines.join(paths, "_source", "left").withColumn(
        "_file", F.coalesce(F.col("first") + number, F.lit(0)).cast("int")
    )
    moved = dealt.repartitionById(int(size["targets"]), "_file").select("value", "date", "site")
    moved.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "site").text(target)
