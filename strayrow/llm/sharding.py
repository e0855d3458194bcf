"""Size-balanced shards by sampled splitters, in SQL functions only.

Records are ordered by a hash of their text, then by id, so equal texts lie together. Keys are drawn
with a chance proportional to their size; quantiles of the sample are the splitters of key ranges.
Ranges that turn out overfull are sampled again and subdivided. With the exact sizes of the ranges
known, a running sum inside each range places every record in the whole order, and the shard is the
share of all bytes that lies before it: sizes differ by one record at most, however keys repeat.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strayrow.workspace import materialize

#: Ranges for each shard and sampled keys for each range; bound what the driver sees.
RANGES_PER_SHARD = 16
KEYS_PER_RANGE = 64
OVERFULL = 1.5
ROUNDS = 3


def records(docs: DataFrame, id_column: str, text_column: str, overhead: int) -> DataFrame:
    """(doc_id, size, text_crc32, key) of every row."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )


def _key(value: tuple) -> tuple:
    """Sorts on the driver as Spark sorts (key, doc_id): nulls first."""
    key, doc_id = value
    return key, doc_id is not None, doc_id


def sampled_splitters(rows: DataFrame, total: int, ranges: int) -> list[tuple]:
    """About ``ranges - 1`` keys that cut ``rows`` into ranges of equal size, from a size-weighted sample."""
    if ranges < 2 or not total:
        return []
    draws = ranges * KEYS_PER_RANGE
    chance = F.least(F.lit(1.0), F.col("size") * draws / F.lit(float(total)))
    ticket = F.pmod(F.xxhash64(F.lit("splitter"), "key", "doc_id"), F.lit(1 << 30)) / (1 << 30)
    # Expected draws: ranges * KEYS_PER_RANGE. A record larger than one draw counts with its own weight.
    weight = F.greatest(F.lit(1.0), F.col("size") * draws / F.lit(float(total)))
    sample = rows.where(ticket < chance).select("key", "doc_id", weight.alias("weight")).collect()
    sample.sort(key=lambda r: _key((r["key"], r["doc_id"])))
    whole = sum(r["weight"] for r in sample)
    splitters, seen, step = [], 0.0, 1
    for row in sample:
        seen += row["weight"]
        if seen >= whole * step / ranges:
            splitters.append((row["key"], row["doc_id"]))
            step = int(seen * ranges / whole) + 1
    return sorted(set(splitters[:-1]), key=_key)


def constant(value: list, kind: str) -> Column:
    """A list as one literal, however long."""
    return F.from_json(F.lit(json.dumps(value, default=str)), kind)


def range_number(splitters: list[tuple], id_type: str) -> Column:
    """How many splitters are at or below the row's (key, doc_id): two short searches, one in the other."""
    if not splitters:
        return F.lit(0)

    own = F.struct(F.col("key"), F.col("doc_id"))
    width = max(1, int(len(splitters) ** 0.5))
    pairs = [{"key": key, "doc_id": doc_id} for key, doc_id in splitters]
    blocks = [pairs[n : n + width] for n in range(0, len(pairs), width)]
    kind = f"array<struct<key:bigint,doc_id:{id_type}>>"
    block = F.size(F.filter(constant([b[0] for b in blocks], kind), lambda s: s <= own))
    inner = F.element_at(constant([b[1:] for b in blocks], f"array<{kind}>"), block)
    return F.when(block == 0, F.lit(0)).otherwise(
        (block - 1) * width + 1 + F.size(F.filter(inner, lambda s: s <= own))
    )


def _sizes(rows: DataFrame, splitters: list[tuple], id_type: str) -> dict[int, tuple[int, int]]:
    """range: (rows, bytes), for a bounded number of ranges."""
    found = (
        rows.groupBy(range_number(splitters, id_type).alias("range"))
        .agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
        .collect()
    )
    return {r["range"]: (r["rows"], r["bytes"]) for r in found}


def key_ranges(rows: DataFrame, total: int, ranges: int, id_type: str) -> tuple[list[tuple], dict[int, tuple[int, int]]]:
    """(splitters, sizes of the ranges), overfull ranges subdivided by splitters of their own sample."""
    splitters = sampled_splitters(rows, total, ranges)
    sizes = _sizes(rows, splitters, id_type)
    for _ in range(ROUNDS):
        full = [n for n, (count, size) in sizes.items() if count > 1 and size > OVERFULL * total / ranges]
        if not full:
            break
        inside = rows.where(range_number(splitters, id_type).isin(full))
        size = sum(sizes[n][1] for n in full)
        more = sampled_splitters(inside, size, max(2, -(-2 * size * ranges // total)))
        known = [_key(s) for s in splitters]
        fresh = [s for s in more if (at := bisect_left(known, _key(s))) == len(known) or known[at] != _key(s)]
        if not fresh:
            break
        splitters = sorted([*splitters, *fresh], key=_key)
        sizes = _sizes(rows, splitters, id_type)
    return splitters, sizes


def shard(
    docs: DataFrame,
    shards: int = 24,
    id_column: str = "doc_id",
    text_column: str = "text",
    overhead: int = 8,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row.

    A record's size is its text's UTF-8 bytes (null: none) plus ``overhead``. The law is ``bytes``:
    shards are consecutive in the order of (hash of the text, id) and a record belongs where its
    middle byte falls, so shard sizes are equal but for a record at each end. Equal texts, however
    many, are neighbours and are cut only where a shard is full. Slots count a shard's records from
    0 in that order. Null ids come first among equal texts; rows equal in id and text are
    interchangeable; other columns are not read; an empty table gives an empty result.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    rows = materialize(records(docs, id_column, text_column, overhead), "shard-records")
    total = rows.select(F.sum("size")).first()[0] or 0
    splitters, sizes = key_ranges(rows, total, shards * RANGES_PER_SHARD, id_type)
    rows_before, bytes_before = [0], [0]
    for n in range(len(splitters) + 1):
        count, size = sizes.get(n, (0, 0))
        rows_before.append(rows_before[-1] + count)
        bytes_before.append(bytes_before[-1] + size)

    def before(values: list[int]) -> Column:
        return F.element_at(constant(values, "array<bigint>"), F.col("_range") + 1)

    order = Window.partitionBy("_range").orderBy("key", "doc_id")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = before(bytes_before) + F.sum("size").over(running) - F.col("size")
    placed = (
        rows.withColumn("_range", range_number(splitters, id_type))
        .withColumn("_start", start)
        .withColumn("_place", before(rows_before) + F.row_number().over(order) - 1)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.expr(f"least({shards - 1}, (2 * _start + size) * {shards} div {max(2 * total, 1)})").cast("int").alias("shard"),
            "_place",
        )
    )
    placed = materialize(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("_place").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_place") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
