"""Saving, publishing and loading models.

A published model lives in a folder of its own below ``root``; the last numbered file in
``root/pointers`` names the version in use and its folder. A failed training or save never touches
either the pointers or an older version, and of two publishers at once one wins.
"""

from __future__ import annotations

import uuid

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import SparkSession

from strayrow.sources.filesystem import NumberedLines

POINTERS = "pointers"


class PublishConflict(RuntimeError):
    """Another model was published since this publisher looked."""


def save_model(model: RandomForestClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def _current(spark: SparkSession, root: str) -> tuple[int, str | None, str | None]:
    """(number of the last pointer, version in use, its folder)."""
    number, line = NumberedLines(spark, f"{root}/{POINTERS}").latest()
    folder, _, version = (line or "").partition("\t")
    return number, version or None, folder or None


def current_version(spark: SparkSession, root: str) -> str | None:
    return _current(spark, root)[1]


def pointer_number(spark: SparkSession, root: str) -> int:
    """How often ``root`` has been published to; what a publisher may build on."""
    return _current(spark, root)[0]


def publish_model(
    spark: SparkSession,
    model: RandomForestClassificationModel,
    root: str,
    version: str,
    after: int | None = None,
) -> str:
    """Save a model as a new version and only then make it the current one; gives its folder.

    It follows the pointer numbered ``after``, by default the last one when called. If another publisher
    has followed that one meanwhile, theirs stays in use and this call raises ``PublishConflict``.
    """
    number, current, _ = _current(spark, root)
    if version == current:
        raise ValueError(f"version {version!r} is in use")
    after = number if after is None else after
    folder = f"v={version}-{uuid.uuid4().hex[:8]}"
    save_model(model, f"{root}/{folder}")
    if not NumberedLines(spark, f"{root}/{POINTERS}").follow(after, f"{folder}\t{version}"):
        raise PublishConflict(f"{root}: pointer {after} has been followed already")
    return f"{root}/{folder}"


def load_published(spark: SparkSession, root: str) -> RandomForestClassificationModel | None:
    """The current model, or None where nothing has been published."""
    folder = _current(spark, root)[2]
    if folder is None:
        return None
    return RandomForestClassificationModel.load(f"{root}/{folder}")
