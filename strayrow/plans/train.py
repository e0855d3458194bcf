"""The training job: records to a published model."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame

from strayrow.operators.forest import ForestSettings, contrast_fit, forest_estimator
from strayrow.operators.records import dedupe
from strayrow.sources.models import pointer_number, publish_model
from strayrow.workspace import materialize


class TrainingOptions(NamedTuple):
    columns: Sequence[str]
    key: Sequence[str] | None = ("uuid",)
    keep_first_by: Sequence[str] = ()
    fraction: float = 0.1
    seed: int = 0
    mode: str = "exact"
    handle_invalid: str = "error"
    forest: ForestSettings = ForestSettings()


def feature_table(records: DataFrame, options: TrainingOptions) -> DataFrame:
    """De-duplicated key and features, written out once: training reads them many times."""
    names = dict.fromkeys([*(options.key or ()), *options.keep_first_by, *options.columns])
    kept = dedupe(records.select(*names), options.key, options.keep_first_by)
    if options.handle_invalid == "skip":
        kept = kept.dropna(subset=list(options.columns))
    return materialize(kept, "features")


def train(records: DataFrame, options: TrainingOptions) -> RandomForestClassificationModel:
    return contrast_fit(
        feature_table(records, options),
        forest_estimator(options.seed, options.forest),
        options.columns,
        options.fraction,
        options.seed,
        options.key,
        options.mode,
        handle_invalid=options.handle_invalid,
    )


def train_and_publish(
    records: DataFrame, options: TrainingOptions, root: str, version: str
) -> str:
    """Train, save and switch to the new model; on any failure the old one stays in use.

    A model published by someone else during the training stays in use too: this one then fails.
    """
    spark = records.sparkSession
    after = pointer_number(spark, root)
    return publish_model(spark, train(records, options), root, version, after)
