"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language has a codeword; one binary logistic classifier predicts each bit from the n-grams of
the whole text. Decoding adds, for every language, the logistic losses of the bits against its
codeword, weighted by how reliable each bit was in training, and takes the smallest. Texts whose two
best codewords are nearly as close are flagged ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.llm import bytetext as bt
from strayrow.workspace import materialize

FEATURES = 4096
#: Text bytes read at once, of which a task holds some 60 times as much, and rows, each of FEATURES numbers.
SLICE_BYTES = 1 << 18
SLICE_ROWS = 256
UNKNOWN = "und"
#: Pairs of codewords compared while a code is drawn, and codewords compared with all at once.
CODE_PAIRS = 1 << 31
CODE_ROWS = 1024
#: Texts that may hold a letter; which do is told by ``has_letter``, which can know more letters.
_LETTER = r"[\p{L}\p{Cn}]"
#: Bytes as features see them: lower case, and all signs, digits and white space as one separator.
_FOLDED = bt.LOWER_ASCII.copy()
_FOLDED[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def ngram_features(buffer: np.ndarray, offsets: np.ndarray, size: int = FEATURES) -> np.ndarray:
    """Square roots of the shares of hashed byte 1-, 2- and 3-grams, a row for each text."""
    rows = len(offsets) - 1
    counts = np.zeros(rows * size, np.float32)
    if len(buffer):
        folded = _FOLDED[buffer].astype(np.uint32)
        lengths = np.diff(offsets)
        base = np.repeat(np.arange(rows, dtype=np.int64) * size, lengths)
        left = np.repeat(offsets[1:], lengths) - np.arange(len(buffer))
        gram = np.zeros(len(buffer), np.uint32)
        for n in (1, 2, 3):
            gram[: len(gram) - n + 1] = gram[: len(gram) - n + 1] * np.uint32(257) + folded[n - 1 :]
            code = (gram * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20)
            inside = left >= n
            found = base[inside] + (code[inside] % np.uint32(size))
            counts += np.bincount(found, minlength=rows * size).astype(np.float32)
    counts = counts.reshape(rows, size)
    totals = np.maximum(counts.sum(1, keepdims=True), 1)
    return np.sqrt(counts / totals)


def has_letter(buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    marks = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buffer])])
    found = marks[offsets[1:]] > marks[offsets[:-1]]
    for row in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        text = buffer[offsets[row] : offsets[row + 1]].tobytes().decode()
        found[row] = any(c.isalpha() for c in text)
    return found


def codewords(classes: int, seed: int = 11) -> np.ndarray:
    """A row of +1 and -1 for each class: the exhaustive code of few classes, a well-spread random one of many."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 6:
        columns = [c for c in itertools.product((1, -1), repeat=classes) if c[0] == 1 and -1 in c]
        return np.array(columns, float).T
    bits = 15 + 2 * int(np.ceil(np.log2(classes)))
    draw = np.random.default_rng(seed)
    best, distance, tries = None, 0, 0
    while best is None or tries < min(200, CODE_PAIRS // classes**2):
        tries += 1
        code = np.where(draw.random((classes, bits)) < 0.5, 1.0, -1.0)
        apart = bits
        for at in range(0, classes, CODE_ROWS):
            some = (bits - code[at : at + CODE_ROWS] @ code.T) / 2
            some[np.arange(len(some)), at + np.arange(len(some))] = bits
            apart = min(apart, some.min())
        if apart > distance and (np.abs(code.sum(0)) < classes).all():
            best, distance = code, apart
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, features: np.ndarray) -> np.ndarray:
        """Weighted decoding loss of every text against every codeword."""
        margins = features @ self.weights + self.bias
        right = np.logaddexp(0, -margins) * self.trust
        wrong = np.logaddexp(0, margins) * self.trust
        chosen = (self.code > 0).T
        return right @ chosen + wrong @ ~chosen

    def predict(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the nearest codeword, score, is the next one nearly as near)."""
        losses = self.losses(features)
        best = losses.argmin(1)
        odds = np.exp(losses.min(1, keepdims=True) - losses)
        score = 1 / odds.sum(1)
        return best, score, score < 0.6


def fit(features: np.ndarray, labels: np.ndarray, languages: list[str], rounds: int = 120, decay: float = 1e-5):
    """One logistic classifier for each bit, all fitted together by accelerated gradient steps."""
    code = codewords(len(languages))
    target = code[labels].astype(np.float32)
    size = features.shape[1]
    share = np.bincount(labels, minlength=len(languages)).astype(float)
    row_weight = ((1 / share[labels])[:, None] / len(languages)).astype(np.float32)
    weights, bias = np.zeros((size, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    ahead, ahead_bias = weights, bias
    rate = np.float32(8)
    transposed = np.ascontiguousarray(features.T)
    for step in range(rounds):
        margins = features @ ahead + ahead_bias
        slope = -target * row_weight / (1 + np.exp(np.clip(target * margins, -30, 30)))
        new = ahead - rate * (transposed @ slope + np.float32(decay) * ahead)
        new_bias = ahead_bias - slope.sum(0)
        speed = np.float32(step / (step + 3))
        ahead, ahead_bias = new + speed * (new - weights), new_bias + speed * (new_bias - bias)
        weights, bias = new, new_bias
    hits = ((features @ weights + bias) * target > 0).mean(0)
    trust = np.clip(2 * hits - 1, 0.05, 1)
    return LanguageModel(languages, code, weights, bias, trust)


def train(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "lang",
    held_out: F.Column | None = None,
    rows_per_language: int = 500,
    sample_rows: int = 50_000,
) -> LanguageModel | None:
    """Fit on about ``rows_per_language`` rows of each label, chosen by a hash of the id, over whole texts.

    Every label is taught, by one row at least. The sample is bounded by about ``sample_rows``: the more
    labels, the fewer rows of each. Null labels, null texts and texts without a letter teach nothing.
    None without any labelled row.
    """
    rows = docs.select(
        docs[id_column].alias("doc_id"),
        docs[text_column].alias("text"),
        docs[label_column].alias("lang"),
        (F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))).alias("_out"),
    ).where(~F.col("_out") & F.col("lang").isNotNull() & F.col("text").rlike(_LETTER))
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1 << 20)) / (1 << 20)
    rows = rows.withColumn("_draw", draw)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_count"), F.min("_draw").alias("_least"))
    counts = materialize(counts, "labels")
    labels = counts.count()
    if not labels:
        return None
    each = max(1, min(rows_per_language, sample_rows // labels))
    rates = counts.withColumn("_rate", F.least(F.lit(1.0), each / F.col("_count")))
    drawn = rows.join(F.broadcast(rates), "lang")
    first = drawn.where((F.col("_least") >= F.col("_rate")) & (F.col("_draw") == F.col("_least")))
    sample = drawn.where(F.col("_draw") < F.col("_rate")).select("text", "lang")
    sample = sample.union(first.groupBy("lang").agg(F.min("text").alias("text")).select("text", "lang"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.slices(batches, "text", SLICE_BYTES, SLICE_ROWS):
            buffer, offsets = bt.text_buffer(batch.column("text"))
            kept = pa.array(has_letter(buffer, offsets))
            found = ngram_features(buffer, offsets).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").filter(kept), pa.array([r.tobytes() for r in found], pa.binary()).filter(kept)],
                ["lang", "features"],
            )

    taught = sample.mapInArrow(features, "lang string, features binary").collect()
    if not taught:
        return None
    languages = sorted({r.lang for r in taught})
    numbers = {lang: n for n, lang in enumerate(languages)}
    matrix = np.stack([np.frombuffer(r.features, np.float16) for r in taught]).astype(np.float32)
    return fit(matrix, np.array([numbers[r.lang] for r in taught]), languages)


def identify(
    docs: DataFrame,
    model: LanguageModel | None,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: tuple[str, ...] = (),
    with_letters: bool = False,
) -> DataFrame:
    """Predict every whole text: (id, *keep, lang_pred, score, ambiguous[, has_letter]), a row for each row.

    ``lang_pred`` is ``und`` with score 0 where the text is null, empty or has no letter, and
    everywhere if there is no model; ``has_letter`` doesn't depend on the model. Null ids stay null,
    repeated rows repeat, an empty table gives an empty result; ties between codewords go to the label
    first in order. ``keep`` names other columns to carry along under their names.
    """
    columns = list(dict.fromkeys([id_column, *keep, text_column]))
    carried = [c for c in columns if c == id_column or c in keep]
    schema = T.StructType(
        [
            *(docs.schema[c] for c in carried),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("ambiguous", T.BooleanType()),
            *([T.StructField("has_letter", T.BooleanType())] if with_letters else []),
        ]
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.slices(batches, text_column, SLICE_BYTES, SLICE_ROWS):
            buffer, offsets = bt.text_buffer(batch.column(text_column))
            letters = has_letter(buffer, offsets) if model or with_letters else np.zeros(batch.num_rows, bool)
            known = letters if model else np.zeros(batch.num_rows, bool)
            names = np.full(batch.num_rows, UNKNOWN, object)
            score = np.zeros(batch.num_rows)
            unsure = np.zeros(batch.num_rows, bool)
            if known.any():
                best, found, near = model.predict(ngram_features(buffer, offsets))
                names[known] = np.array(model.languages, object)[best[known]]
                score[known], unsure[known] = found[known], near[known]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in carried),
                    pa.array(names, pa.string()),
                    pa.array(np.clip(score, 0, 1)),
                    pa.array(unsure),
                    *([pa.array(letters)] if with_letters else []),
                ],
                schema.fieldNames(),
            )

    return docs.select(*columns).mapInArrow(predict, schema)
