"""Row hashes and the uniforms drawn from them.

A row's identity is hashed once; every draw made for the row then only mixes that number with
the seed and the number of the draw. Everything random in the package is a pure function of
these, so a task that runs again after an executor is lost emits the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_MARK = "n"
HASH_BITS = 60  # 15 hex digits: the widest whole-digit hash that stays positive in a BIGINT
UNIFORM_BITS = 52
UNIFORM_STEPS = 1 << UNIFORM_BITS
UNIFORM_TAG, ORDER_TAG, REPLICA_TAG = 0, 1, 2


def row_text(df: DataFrame, columns: Iterable[str]) -> Column:
    """One text per row from the given columns, a different one for rows that differ anywhere.

    Every value has its length before it and a null a mark of its own, so no text in one column can
    look like another column's. It does not depend on the session time zone.
    """
    parts = [F.lit("")]
    for name in columns:
        col, kind = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(kind, T.TimestampType):
            col = F.unix_micros(col)
        elif isinstance(kind, T.BinaryType):
            col = F.hex(col)
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            col = F.when(col.isNotNull(), F.to_json(F.struct(col), {"ignoreNullFields": "false"}))
        text = col.cast("string")
        sized = F.concat(F.length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(sized, F.lit(NULL_MARK)))
    return F.concat(*parts)


def text_hash(text: Column) -> Column:
    """60-bit BIGINT hash of a text."""
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def key_hash(df: DataFrame, key: Iterable[str]) -> Column:
    """60-bit hash of key columns; whole numbers hash alike whatever their width.

    Hashing passes nulls over, so which columns are null is hashed too if there are several.
    """
    columns, nulls = [], F.lit(0).cast("bigint")
    for place, name in enumerate(key):
        whole = isinstance(df.schema[name].dataType, T.IntegralType)
        columns.append(F.col(name).cast("bigint") if whole else F.col(name))
        nulls = nulls + F.shiftleft(F.col(name).isNull().cast("bigint"), place % 63)
    if len(columns) > 1:
        columns.append(nulls)
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - HASH_BITS)


def _mixed(*numbers: Column | int) -> Column:
    longs = [F.lit(n) if isinstance(n, int) else n for n in numbers]
    return F.xxhash64(*[n.cast("bigint") for n in longs])


def uniform(row_hash: Column, seed: int, feature: Column | int) -> Column:
    """A uniform integer below ``UNIFORM_STEPS`` for one feature of one row."""
    mixed = _mixed(row_hash, seed, feature, UNIFORM_TAG)
    return F.shiftrightunsigned(mixed, 64 - UNIFORM_BITS)


def order_hash(row_hash: Column, seed: int, feature: Column | int, draw: Column) -> Column:
    """60-bit hash that puts the draws of a feature in random order."""
    mixed = _mixed(row_hash, seed, feature, draw, ORDER_TAG)
    return F.shiftrightunsigned(mixed, 64 - HASH_BITS)


def replica_hash(row_hash: Column, replica: Column) -> Column:
    """The hash of one of several replicas of a row."""
    return F.shiftrightunsigned(_mixed(row_hash, replica, REPLICA_TAG), 64 - HASH_BITS)
