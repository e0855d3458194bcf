"""Document quality by Bradley-Terry pairwise ranking.

Labelled documents make preference pairs, a good one over a bad one. The chance that one beats the
other is the logistic function of the difference of their scores, and scores are linear in features
of the whole text; so the weights come from a logistic regression on feature differences. The
decision threshold is a quantile of the training scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.llm import bytetext as bt

#: The score at which a document counts as good.
ACCEPT = 0.7
_SIGNS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_GROUPS = {
    "lower": [*range(97, 123)],
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "line": [10],
    "space": [9, 11, 12, 13, 32],
    "control": [b for b in [*range(9), *range(14, 32), 127]],
    "wide": [*range(128, 256)],
}


def _shares() -> np.ndarray:
    groups = [[b] for b in _SIGNS] + list(_GROUPS.values())
    table = np.zeros((256, len(groups)), np.float32)
    for n, group in enumerate(groups):
        table[group, n] = 1
    return table


_SHARES = _shares()
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
N_FEATURES = _SHARES.shape[1] + 9


def _per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[edges[1:]] - sums[edges[:-1]]


def _distinct_per_text(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Number of distinct values among those of each text."""
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    keys = bt.mix(hashes ^ bt.mix(owner.astype(np.uint64)))
    _, sample, _ = bt.distinct(keys)
    return np.bincount(owner[sample], minlength=len(edges) - 1)


def text_features(buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of kinds of characters, repetition of words and lines, sizes: a row for each text."""
    rows = len(offsets) - 1
    out = np.zeros((rows, N_FEATURES), np.float32)
    if not len(buffer):
        return out
    lengths = np.maximum(np.diff(offsets), 1)
    owner = np.repeat(np.arange(rows, dtype=np.int64) * 256, np.diff(offsets))
    counts = np.bincount(owner + buffer, minlength=rows * 256).reshape(rows, 256)
    out[:, : _SHARES.shape[1]] = np.sqrt((counts @ _SHARES) / lengths[:, None])
    sums = bt.prefix_hashes(buffer)
    starts, ends = bt.words(buffer, offsets)
    edges = np.searchsorted(starts, offsets)
    n_words = np.maximum(np.diff(edges), 1)
    at = _SHARES.shape[1]
    if len(starts):
        hashes = bt.range_hashes(sums, starts, ends)
        same = np.zeros(len(hashes))
        same[1:] = hashes[1:] == hashes[:-1]
        same[edges[:-1][edges[:-1] < len(hashes)]] = 0
        letters = np.concatenate([[0], np.cumsum(_LETTER[buffer])])
        with_letter = letters[ends] - letters[starts]
        size = ends - starts
        columns = (
            np.sqrt(_per_text(same, edges) / n_words),
            _distinct_per_text(hashes, edges) / n_words,
            np.log1p(n_words) / 10,
            _per_text(size, edges) / n_words / 10,
            np.sqrt(_per_text(with_letter == 0, edges) / n_words),
            np.sqrt(_per_text(~_LETTER[buffer[ends - 1]], edges) / n_words),
            np.sqrt(_per_text(size > 30, edges) / n_words),
        )
        for n, column in enumerate(columns):
            out[:, at + n] = column
    line = np.zeros(256, bool)
    line[10] = True
    starts, ends = bt.words(buffer, offsets, line)
    edges = np.searchsorted(starts, offsets)
    n_lines = np.maximum(np.diff(edges), 1)
    if len(starts):
        out[:, at + 7] = _distinct_per_text(bt.range_hashes(sums, starts, ends), edges) / n_lines
    out[:, at + 8] = np.log1p(n_lines) / 10
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def strength(self, features: np.ndarray) -> np.ndarray:
        """The Bradley-Terry score on its own scale."""
        return ((features - self.mean) / self.scale) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        """0 to 1; exactly the threshold quantile scores ``ACCEPT``."""
        shift = np.log(ACCEPT / (1 - ACCEPT))
        away = np.clip(self.slope * (self.strength(features) - self.threshold) + shift, -40, 40)
        return 1 / (1 + np.exp(-away))


def _newton(matrix: np.ndarray, weight_decay: float, rounds: int = 25) -> np.ndarray:
    """Logistic regression without intercept; every row is a difference that should be positive."""
    weights = np.zeros(matrix.shape[1])
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(np.clip(matrix @ weights, -30, 30)))
        slope = matrix.T @ chance / len(matrix) - weight_decay * weights
        curve = (matrix * (chance * (1 - chance))[:, None]).T @ matrix / len(matrix)
        step = np.linalg.solve(curve + weight_decay * np.eye(len(weights)), slope)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(features: np.ndarray, labels: np.ndarray, pairs: int = 20_000, seed: int = 5) -> QualityModel | None:
    """Weights from ``pairs`` drawn preference pairs; the threshold quantile that errs least in training."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = features.mean(0), features.std(0) + 1e-3
    scaled = ((features - mean) / scale).astype(float)
    draw = np.random.default_rng(seed)
    better, worse = draw.choice(good, pairs), draw.choice(bad, pairs)
    weights = _newton(scaled[better] - scaled[worse], 1e-3)
    strength = scaled @ weights
    levels = np.linspace(0.005, 0.995, 199)
    cuts = np.quantile(strength, levels)
    errors = [
        (strength[good] < cut).mean() + (strength[bad] >= cut).mean() for cut in cuts
    ]
    least = np.flatnonzero(np.array(errors) <= min(errors) + 1e-12)
    threshold = float(cuts[least[len(least) // 2]])
    spread = np.abs(strength - threshold).mean() or 1.0
    return QualityModel(mean, scale, weights, threshold, float(3 / spread))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    held_out: F.Column | None = None,
    max_labelled: int = 20_000,
) -> QualityModel | None:
    """Fit on about ``max_labelled`` labelled rows at most, chosen by a hash of the id, over whole texts.

    Null ids and null labels teach nothing; several labels of a document count each. None if either
    class is missing.
    """
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    known = labels.select(
        labels[id_column].alias("doc_id"), labels[label_column].cast("int").alias("label")
    ).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held)
    total = known.count()
    rate = min(1.0, max_labelled / max(total, 1))
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    sample = known.where(draw < rate)
    rows = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    # The sample is bounded by max_labelled narrow rows.
    joined = rows.join(F.broadcast(sample), "doc_id").select("text", "label")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.slices(batches, "text"):
            found = text_features(*bt.text_buffer(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([r.tobytes() for r in found], pa.binary())],
                ["label", "features"],
            )

    taught = joined.mapInArrow(features, "label int, features binary").collect()
    if not taught:
        return None
    matrix = np.stack([np.frombuffer(r.features, np.float32) for r in taught])
    return fit(matrix, np.array([r.label for r in taught]))


def score(
    docs: DataFrame, model: QualityModel | None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, score, predicted) of every whole text, a row for each row.

    Null and empty texts are scored as texts without characters. Without a model every score is 0.5.
    Null ids stay null, repeated rows repeat, an empty table gives an empty result.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_column].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
        ]
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.slices(batches, "text"):
            if model is None:
                found = np.full(batch.num_rows, 0.5)
            else:
                found = model.score(text_features(*bt.text_buffer(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.float64()), pa.array((found >= ACCEPT).astype(np.int32))],
                schema.fieldNames(),
            )

    narrow = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    return narrow.mapInArrow(scored, schema)
