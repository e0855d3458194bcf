"""Document probability by a subword lattice: every segmentation of a text counts.

The pieces and their first weights are those of an existing subword vocabulary. Expectation
maximisation over the words of all training texts, with their counts, re-estimates what each piece
weighs; the given weights stay as a prior. A word's probability is the sum over all its
segmentations, by the forward recursion in logarithms; a text's is the product over its words and an
end symbol, which are pieces of the same distribution.

Texts are dealt by hash to blocks of bounded size. A block sends each of its distinct words once and
gets back the word's count over all blocks, so a frequent word makes one row a block, not one for
each occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.llm import bytetext as bt
from strayrow.workspace import materialize

BLOCK_BYTES = 6 << 20
MIN_BLOCKS = 16
#: Fixed: what stands for the beginning of a word in the vocabulary.
WORD_START = "▁".encode()
#: Share of the prior that lets any byte be a piece of its own.
BYTE_SHARE = 1e-4
#: Pseudo-occurrences that the given weights are worth beside the counts.
PRIOR_COUNT = 1000.0
ROUNDS = 2
BATCH_WORDS = 4096
_SLOTS = 20
_NEVER = -1e30
#: Logs of probabilities down to minus this are left alone as doubles, which end at minus 708.
_PLAIN_RANGE = 600.0


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """(pieces that can be part of a word, their shares) of a sentencepiece model.

    Scores of a unigram model are log probabilities; a merge vocabulary scores a piece by its rank
    alone, which is read as Zipf's law.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores = [], []
    for n in range(model.get_piece_size()):
        raw = model.id_to_piece(n).encode()
        if model.is_control(n) or model.is_unknown(n) or model.is_byte(n) or WORD_START in raw[1:]:
            continue
        pieces.append(raw)
        scores.append(model.get_score(n))
    scores = np.array(scores)
    ranks = scores[scores < 0]
    if len(ranks) and (ranks == np.round(ranks)).all():
        shares = 1 / (10 - scores)
    else:
        shares = np.exp(scores)
    return pieces, shares / shares.sum()


@dataclass
class Lattice:
    """Piece weights, looked up by the hash of their bytes. The last 256 pieces are single bytes."""

    pieces: list[bytes]
    log_share: np.ndarray
    log_end: float = 0.0

    def __post_init__(self) -> None:
        self.longest = max([len(p) for p in self.pieces], default=1)
        flat = np.frombuffer(b"".join(self.pieces), np.uint8)
        ends = np.cumsum([len(p) for p in self.pieces]).astype(np.int64)
        starts = ends - np.array([len(p) for p in self.pieces], np.int64)
        hashes = bt.range_hashes(bt.prefix_hashes(flat), starts, ends)
        size = 1 << _SLOTS
        self._hash = np.zeros(size + 64, np.uint64)
        self._piece = np.full(size + 64, -1, np.int32)
        self._probes = 1
        for n, value in enumerate(hashes.tolist()):
            home = slot = value >> (64 - _SLOTS)
            while self._piece[slot] >= 0:
                slot += 1
            self._hash[slot], self._piece[slot] = value, n
            self._probes = max(self._probes, slot - home + 1)
        self._taken = self._piece >= 0

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the hashes that pieces have, numbers of those pieces)."""
        slot = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
        # Nothing that belongs to an empty slot lies further on; most ranges are no pieces and end here.
        place = np.flatnonzero(self._taken[slot])
        slot, hashes = slot[place], hashes[place]
        found = np.full(len(place), -1, np.int32)
        for step in range(self._probes):
            found = np.where(self._hash[slot + step] == hashes, self._piece[slot + step], found)
        met = found >= 0
        return place[met], found[met]

    def _arcs(self, sums: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, begin, piece) of each piece that ends at byte ``at`` of a word."""
        reach = min(at, self.longest)
        starts = at - np.arange(1, reach + 1)
        raw = (sums[:, at, None] - sums[:, starts]) * bt.powers(at + 1, inverse=True)[starts]
        lengths = np.arange(1, reach + 1, dtype=np.uint64)
        place, piece = self._find(bt.mix(raw + lengths * np.uint64(0xD6E8FEB86659FD93)).ravel())
        word, back = np.divmod(place, reach)
        return word, at - 1 - back, piece

    def _plain(self, width: int) -> bool:
        """Whether the probabilities of words of this width are far from the least double, so need no logs."""
        return -width * self.log_share[len(self.pieces) :].min() < _PLAIN_RANGE

    def _forward(self, letters: np.ndarray):
        """(forward sums by position, arcs by position) of words of at most the matrix's width.

        The sums are probabilities where ``_plain`` says so, else their logs.
        """
        rows, width = letters.shape
        sums = np.zeros((rows, width + 1), np.uint64)
        np.cumsum(bt._BYTE_VALUES[letters] * bt.powers(width), axis=1, out=sums[:, 1:])
        arcs = [self._arcs(sums, at) for at in range(1, width + 1)]
        single = self.log_share[len(self.pieces) :]
        if self._plain(width):
            forward = np.zeros((rows, width + 1))
            forward[:, 0] = 1
            share, lone = np.exp(self.log_share), np.exp(single)
            for at, (word, begin, piece) in enumerate(arcs, 1):
                paths = np.bincount(word, forward[word, begin] * share[piece], rows)
                forward[:, at] = paths + forward[:, at - 1] * lone[letters[:, at - 1]]
            return forward, arcs
        forward = np.full((rows, width + 1), _NEVER)
        forward[:, 0] = 0
        for at, (word, begin, piece) in enumerate(arcs, 1):
            paths = np.full((rows, min(at, self.longest) + 1), _NEVER)
            paths[word, at - 1 - begin] = forward[word, begin] + self.log_share[piece]
            paths[:, -1] = forward[:, at - 1] + single[letters[:, at - 1]]
            top = paths.max(1)
            forward[:, at] = top + np.log(np.exp(paths - top[:, None]).sum(1))
        return forward, arcs

    @staticmethod
    def _matrices(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(word numbers, letters with the word start, lengths) of batches of words of similar length."""
        lengths = ends - starts
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            # Fewer words in a batch the longer they are: a matrix stays a few megabytes.
            most = max(1, min(BATCH_WORDS, (1 << 19) // max(1, int(lengths[order[at]]))))
            rows = order[at : at + most]
            rows = rows[lengths[rows] <= 2 * lengths[rows[0]] + 4]
            at += len(rows)
            width = int(lengths[rows].max()) if len(rows) else 0
            letters = np.zeros((len(rows), width + len(WORD_START)), np.uint8)
            letters[:, : len(WORD_START)] = np.frombuffer(WORD_START, np.uint8)
            inside = np.arange(width) < lengths[rows, None]
            letters[:, len(WORD_START) :][inside] = buffer[bt.expand(starts[rows], lengths[rows])]
            yield rows, letters, lengths[rows] + len(WORD_START)

    def log_words(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability over all segmentations."""
        result = np.zeros(len(starts))
        for rows, letters, lengths in self._matrices(buffer, starts, ends):
            forward, _ = self._forward(letters)
            whole = forward[np.arange(len(rows)), lengths]
            result[rows] = np.log(whole) if self._plain(letters.shape[1]) else whole
        return result

    def expected(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected occurrences of every piece in words that occur ``counts`` times."""
        total = np.zeros(len(self.log_share))
        for rows, letters, lengths in self._matrices(buffer, starts, ends):
            forward, arcs = self._forward(letters)
            used = self._used if self._plain(letters.shape[1]) else self._used_by_logs
            found, weights = zip(*used(letters, lengths, counts[rows].astype(float), forward, arcs), strict=True)
            total += np.bincount(np.concatenate(found), np.concatenate(weights), len(total))
        return total

    def _used(self, letters: np.ndarray, lengths: np.ndarray, times: np.ndarray, forward: np.ndarray, arcs: list):
        """(pieces, their expected occurrences) by position, from the last, of words that occur ``times`` times."""
        n, width = letters.shape
        share = np.exp(self.log_share)
        single = share[len(self.pieces) :]
        backward = np.zeros((n, width + 1))
        backward[np.arange(n), lengths] = 1
        each = times / forward[np.arange(n), lengths]
        for at in range(width, 0, -1):
            here = backward[:, at]
            word, begin, piece = arcs[at - 1]
            path = share[piece] * here[word]
            yield piece, forward[word, begin] * path * each[word]
            byte = letters[:, at - 1].astype(np.int64)
            lone = single[byte] * here
            yield byte + len(self.pieces), forward[:, at - 1] * lone * each
            backward[word, begin] += path
            backward[:, at - 1] += lone

    def _used_by_logs(self, letters: np.ndarray, lengths: np.ndarray, times: np.ndarray, forward: np.ndarray, arcs: list):
        """As ``_used``, for words so long that a probability may be below the least double."""
        n, width = letters.shape
        single = self.log_share[len(self.pieces) :]
        backward = np.full((n, width + 1), _NEVER)
        backward[np.arange(n), lengths] = 0
        whole = forward[np.arange(n), lengths]
        for at in range(width, 0, -1):
            here = backward[:, at]
            live = here > _NEVER / 2
            word, begin, piece = (x[live[arcs[at - 1][0]]] for x in arcs[at - 1])
            path = self.log_share[piece] + here[word]
            yield piece, np.exp(np.minimum(forward[word, begin] + path - whole[word], 0)) * times[word]
            live = np.flatnonzero(live)
            byte = letters[live, at - 1].astype(np.int64)
            lone = single[byte] + here[live]
            yield byte + len(self.pieces), np.exp(np.minimum(forward[live, at - 1] + lone - whole[live], 0)) * times[live]
            backward[word, begin] = np.logaddexp(backward[word, begin], path)
            backward[live, at - 1] = np.logaddexp(backward[live, at - 1], lone)


def first_lattice(path: str) -> Lattice:
    pieces, shares = vocabulary(path)
    return Lattice(pieces, np.log(np.concatenate([shares * (1 - BYTE_SHARE), np.full(256, BYTE_SHARE / 256)])))


def _string_array(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    data = buffer[bt.expand(starts, lengths)]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _block_words(table: pa.Table | pa.RecordBatch):
    """(lower-case bytes, word starts, ends, a sample of each distinct word, number of each word, word edges of texts).

    Distinct words are numbered in the order of their hash, so a block's rows may come in any order.
    """
    column = table.column("text")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    buffer, offsets = bt.text_buffer(column)
    low = bt.LOWER_ASCII[buffer]
    starts, ends = bt.words(low, offsets)
    edges = np.searchsorted(starts, offsets)
    if not len(starts):
        return low, starts, ends, starts, starts, edges
    _, sample, codes = bt.distinct(bt.range_hashes(bt.prefix_hashes(low), starts, ends))
    return low, starts, ends, sample, codes, edges


def block_words(texts: DataFrame) -> DataFrame:
    """(block, number, word, times): each block's distinct words and how often they occur in training texts."""

    def collect(table: pa.Table) -> pa.Table:
        low, starts, ends, sample, codes, edges = _block_words(table)
        taught = ~table["held_out"].to_numpy(zero_copy_only=False).astype(bool)
        times = np.bincount(codes, np.repeat(taught, np.diff(edges)), len(sample)).astype(np.int64)
        return pa.table(
            {
                "block": pa.array(np.full(len(sample), table["block"][0].as_py(), np.int64)),
                "number": pa.array(np.arange(len(sample), dtype=np.int32)),
                "word": _string_array(low, starts[sample], ends[sample]),
                "times": pa.array(times),
            }
        )

    return texts.groupBy("block").applyInArrow(collect, "block long, number int, word string, times long")


def train_pieces(words: DataFrame, end_count: int, path: str) -> Lattice:
    """Piece weights from (word, count) rows by expectation maximisation; the driver sees the vocabulary only."""
    lattice = prior = first_lattice(path)
    for _ in range(ROUNDS):
        current = lattice

        def expect(batches: Iterator[pa.RecordBatch], current: Lattice = current) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(current.log_share))
            for batch in bt.slices(batches, "word"):
                buffer, offsets = bt.text_buffer(batch.column("word"))
                total += current.expected(buffer, offsets[:-1], offsets[1:], batch.column("count").to_numpy())
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "times"])

        summed = words.mapInArrow(expect, "piece long, times double").groupBy("piece").agg(F.sum("times").alias("times"))
        counts = np.exp(prior.log_share) * PRIOR_COUNT
        for row in summed.collect():
            counts[row["piece"]] += row["times"]
        whole = counts.sum() + end_count + 1
        lattice = Lattice(prior.pieces, np.log(counts / whole), float(np.log((end_count + 1) / whole)))
    return lattice


def score(
    docs: DataFrame,
    path: str,
    held_out: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    ``held_out`` is a condition on the column ``doc_id``; rows it is true for teach nothing. Tokens are
    words of the text, A-Z in lower case, then one end. ``base_score`` sums
    log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens with their counts c among N training tokens
    of V kinds; ``score`` is the lattice's log10 probability. Null and empty texts are an end alone.
    Null ids stay null, repeated rows repeat and count as often, other columns are not read, an empty
    table gives an empty result.
    """
    texts = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")).withColumn(
        "held_out", F.coalesce(held_out, F.lit(False))
    )
    totals = texts.select(
        F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held_out")).alias("taught")
    ).first()
    blocks = max(MIN_BLOCKS, -(-(totals["bytes"] or 0) // block_bytes))
    texts = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    same = Window.partitionBy("word")
    counted = (
        block_words(texts)
        .withColumn("count", F.sum("times").over(same))
        .withColumn("_first", F.row_number().over(same.orderBy("block")) == 1)
    )
    counted = materialize(
        counted.select("block", "number", "count", F.when(F.col("_first") & (F.col("count") > 0), F.col("word")).alias("word")),
        "word-counts",
    )
    ends = totals["taught"]
    known = counted.where(F.col("word").isNotNull())
    vocabulary_size = known.agg(F.count("*").alias("kinds"), F.sum("count").alias("tokens")).first()
    train_tokens = (vocabulary_size["tokens"] or 0) + ends
    kinds = vocabulary_size["kinds"] + (ends > 0)
    lattice = train_pieces(known.select("word", "count"), ends, path)
    floor = np.log10(train_tokens + 0.5 * (kinds + 1))
    schema = T.StructType(
        [
            texts.schema["doc_id"],
            T.StructField("held_out", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("train_tokens", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        low, starts, ends_at, sample, codes, edges = _block_words(left)
        counts = np.zeros(len(sample), np.int64)
        counts[right["number"].to_numpy()] = right["count"].to_numpy()
        each = np.stack(
            [
                np.log10(counts + 0.5) - floor,
                lattice.log_words(low, starts[sample], ends_at[sample]) / np.log(10),
                counts > 0,
            ]
        )[:, codes]
        sums = np.concatenate([np.zeros((3, 1)), np.cumsum(each, axis=1)], axis=1)
        base, full, seen = sums[:, edges[1:]] - sums[:, edges[:-1]]
        n = len(left)
        return pa.table(
            [
                left["doc_id"],
                left["held_out"],
                pa.array(np.diff(edges) + 1),
                pa.array(np.round(seen).astype(np.int64) + (ends > 0)),
                pa.array(np.full(n, train_tokens, np.int64)),
                pa.array(base + np.log10(ends + 0.5) - floor),
                pa.array(full + lattice.log_end / np.log(10)),
            ],
            names=schema.fieldNames(),
        )

    numbered = counted.select("block", "number", "count")
    return texts.groupBy("block").cogroup(numbered.groupBy("block")).applyInArrow(rate, schema)
