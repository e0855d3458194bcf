"""Turning a table of records back into a stream of stamped messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from strayrow.operators.positions import dense_index
from strayrow.operators.records import stamp_records
from strayrow.operators.sampling import bootstrap_rows
from strayrow.streaming.sinks import as_messages
from strayrow.workspace import materialize


def stamped_pass(records: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Every record once, numbered in ``order`` or else in hash order."""
    return stamp_records(records, order=order)


def stamped_draws(records: DataFrame, seed: int, draws: int | None = None) -> DataFrame:
    """Records drawn at random with replacement, as many as there are unless told otherwise."""
    indexed = materialize(dense_index(records, out="_place"), "indexed")
    rows = indexed.count()
    drawn = bootstrap_rows(indexed, rows if draws is None else draws, seed, ["_place"], rows)
    return stamp_records(drawn, source_index="_place")


def replay_to_files(stamped: DataFrame, path: str) -> None:
    """Messages as text files, to be read with a bounded number of files per batch."""
    as_messages(stamped).write.text(path)
