"""Feature vectors, and tables turned between one row per record and one row per feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.operators.positions import ordered_index


def assemble(
    df: DataFrame, columns: Sequence[str], out: str = "features", handle_invalid: str = "error"
) -> DataFrame:
    """Append a vector of ``columns`` in the given order.

    ``handle_invalid``: ``error`` raises on a null or NaN, ``skip`` drops the row, ``keep`` turns
    a null into NaN.
    """
    assembler = VectorAssembler(
        inputCols=list(columns), outputCol=out, handleInvalid=handle_invalid
    )
    return assembler.transform(df)


def only_vectors(df: DataFrame, vector: str = "features") -> DataFrame:
    return df.select(vector)


def vector_columns(df: DataFrame, names: Sequence[str], vector: str = "features") -> DataFrame:
    """A vector as one double column per position."""
    values = vector_to_array(F.col(vector))
    kept = [c for c in df.columns if c != vector and c not in names]
    return df.select(*kept, values.alias("_values")).select(
        *kept, *[F.col("_values")[i].alias(name) for i, name in enumerate(names)]
    )


def index_labels(df: DataFrame, label: str, out: str = "label_index") -> DataFrame:
    """Number text labels by falling frequency, ties alphabetically; a null label has no number.

    The labels are a table like any other: their number is not limited and none reach the driver.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg((-F.count("*")).alias("_rarity"))
    numbered = ordered_index(counts, ["_rarity", label], "_number")
    numbers = numbered.select(F.col(label).alias("_label_text"), F.col("_number").cast("double").alias(out))
    return df.join(numbers, F.col(label) == F.col("_label_text"), "left").drop("_label_text")


def labeled_points(df: DataFrame, label: str, vector: str = "features") -> DataFrame:
    """(label, vector) pairs; a text label becomes its index."""
    if isinstance(df.schema[label].dataType, T.StringType):
        df = index_labels(df.select(label, vector), label, "_label")
        return df.select(F.col("_label").alias(label), vector)
    return df.select(F.col(label).cast("double").alias(label), vector)


def unpivot_features(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], feature: str = "feature",
    value: str = "value",
) -> DataFrame:
    """One row per record and feature: its number in ``columns``, and the value as a double."""
    values = F.array(*[F.col(name).cast("double") for name in columns])
    return df.select(*ids, F.posexplode(values).alias(feature, value))


def explode_vector(
    df: DataFrame, ids: Sequence[str], vector: str = "features", feature: str = "feature",
    value: str = "value",
) -> DataFrame:
    """As ``unpivot_features``, from a vector column."""
    return df.select(*ids, F.posexplode(vector_to_array(vector)).alias(feature, value))


def rebuild_rows(
    pieces: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    feature: str = "feature",
    value: str = "value",
    incomplete: str = "keep",
    unique: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """One row per id from its single-feature pieces, in ``tasks`` partitions by the id if that is given.

    The pieces are shuffled as they are: building rows before the shuffle would widen every piece
    to a whole row. Unless the caller knows the pieces to be ``unique``, repeated ones are first
    reduced to one (the largest), so a hot id cannot pile up in a task.

    An id without a piece of every feature is kept with nulls (``keep``), dropped (``drop``: the
    inner join of the features on the id), or fails the job (``error``).
    """
    wide = [
        F.max(F.when(F.col(feature) == number, F.col(value))).alias(name)
        for number, name in enumerate(columns)
    ]
    if not unique:
        pieces = pieces.groupBy(*ids, feature).agg(F.max(value).alias(value))
    dealt = pieces.repartition(*([tasks] if tasks else []), *ids)
    rebuilt = dealt.groupBy(*ids).agg(F.count(F.lit(1)).alias("_pieces"), *wide)
    complete = F.col("_pieces") == len(columns)
    if incomplete == "drop":
        rebuilt = rebuilt.filter(complete)
    elif incomplete == "error":
        failure = F.raise_error(F.lit("a row lacks a piece of some feature"))
        rebuilt = rebuilt.filter(F.when(complete, F.lit(True)).otherwise(failure))
    elif incomplete != "keep":
        raise ValueError(f"unknown choice for incomplete rows: {incomplete!r}")
    return rebuilt.drop("_pieces")


def constant_label(df: DataFrame, label: float, out: str = "label") -> DataFrame:
    return df.withColumn(out, F.lit(float(label)))


def union_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bag union by column name."""
    for other in others:
        first = first.unionByName(other)
    return first

