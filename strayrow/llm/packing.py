"""Pack token sequences of whole texts into fixed-length training sequences, bounded-space best fit.

Texts are tokenized where they lie; only sizes travel. Pieces are dealt by hash to packing groups of
bounded size. Each group is packed online: a piece goes to the open bin with the least free space
that still takes it, found in a bitset whose n-th bit says that some open bin has n places free. At
most ``open_bins`` bins are open; beyond that the fullest closes first. Groups grow in number with the
text, so what a group's last bins leave free stays a small, constant share.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.llm import bytetext as bt
from strayrow.llm.token_counts import byte_letters

#: Fixed: how the word-level vocabulary splits lower-cased text before any merge.
PRETOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+""")
#: Characters whose lower case and composition need no context; other words go through the library.
_SIMPLE = regex.compile(r"[\x21-\x7E¡-įĲ-ɏ]+")
#: Words a Python worker remembers of each kind, and text bytes it reads at once.
CACHE_ENTRIES = 300_000
SLICE_BYTES = 1 << 20
GROUP_BYTES = 64 << 20
MIN_GROUPS = 8


#: Fixed classes of bytes: 0 white space, 1 letter, 2 digit, 3 other.
_CLASSES = np.full(256, 3, np.uint8)
_CLASSES[bt.ASCII_SPACE] = 0
_CLASSES[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = 1
_CLASSES[48:58] = 2


class WordTokenizer:
    """Token ids of buffers of texts; every distinct pretoken is tokenized once per worker.

    Words of ASCII and Latin-1 letters, digits and signs are lower-cased and split with array
    operations; all others (apostrophes, special tokens, other scripts, control characters) take the
    library's whole way word by word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._letters = byte_letters()
        self._specials = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        #: Ids as the bytes of unsigned ints: a third of what tuples of ints take.
        self._hard: dict[bytes, bytes] = {}
        self._plain: dict[bytes, bytes] = {}

    def _pretoken(self, raw: bytes) -> tuple[int, ...]:
        letters = raw.decode() if raw.isascii() else "".join([self._letters[b] for b in raw])
        return tuple([t.id for t in self._model.tokenize(letters)])

    def _word(self, raw: bytes) -> tuple[int, ...]:
        text = raw.decode()
        if not _SIMPLE.fullmatch(text) or any(s in text for s in self._specials):
            return tuple(self._tokenizer.encode(text, add_special_tokens=False).ids)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        parts: tuple[int, ...] = ()
        for piece in PRETOKEN.findall(text.lower()):
            parts += self._pretoken(piece.encode())
        return parts

    @staticmethod
    def units(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes with plain words in lower case, starts, ends, is it a hard word) of pretokens and hard words."""
        starts, ends = bt.words(buffer, offsets)
        if not len(starts):
            return buffer, starts, ends, np.zeros(0, bool)
        after = np.zeros(len(buffer), np.uint8)
        after[1:] = buffer[:-1]
        accented = (after == 0xC3) & (buffer >= 0x80) & (buffer != 0x97) & (buffer != 0xB7)
        odd = (buffer < 0x21) | (buffer == 0x27) | (buffer == 0x7F) | ((buffer >= 0x80) & (buffer != 0xC3) & ~accented)
        odd |= (buffer == 0x7C) & (after == 0x3C)
        odd[buffer == 0xC3] = ~accented[np.minimum(np.flatnonzero(buffer == 0xC3) + 1, len(buffer) - 1)]
        marks = np.concatenate([[0], np.cumsum(odd)])
        hard = marks[ends] > marks[starts]
        low = bt.LOWER_ASCII[buffer]
        low[accented & (buffer <= 0x9E)] += 0x20
        if hard.any():
            kept = bt.expand(starts[hard], (ends - starts)[hard])
            low[kept] = buffer[kept]
        kinds = _CLASSES[low]
        first = np.zeros(len(buffer), bool)
        first[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)
        first &= kinds > 0
        if hard.any():
            first[kept] = False
        first[starts] = True
        begin = np.flatnonzero(first)
        word = np.searchsorted(starts, begin, side="right") - 1
        stop = np.minimum(np.append(begin[1:], len(buffer)), ends[word])
        return low, begin, stop, hard[word]

    def buffer(self, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, n+1 offsets into them)."""
        low, starts, ends, hard = self.units(buffer, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        _, sample, codes = bt.distinct(bt.range_hashes(bt.prefix_hashes(low), starts, ends))
        raw = low.tobytes()
        each = []
        known = self._plain
        for a, b, slow in zip(
            starts[sample].tolist(), ends[sample].tolist(), hard[sample].tolist(), strict=True
        ):
            unit = raw[a:b]
            if slow:
                ids = self._hard.get(unit)
                if ids is None:
                    ids = self._hard[unit] = array("I", self._word(unit)).tobytes()
            else:
                ids = known.get(unit)
                if ids is None:
                    ids = known[unit] = array("I", self._pretoken(unit)).tobytes()
            each.append(ids)
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), np.uint32)
        begins = np.cumsum(sizes) - sizes
        ids = flat[bt.expand(begins[codes], sizes[codes])]
        sums = np.concatenate([[0], np.cumsum(sizes[codes])])
        for cache in (self._hard, self._plain):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
        return ids, sums[np.searchsorted(starts, offsets)]


def cut(
    batch: pa.RecordBatch, tokenizer: WordTokenizer, capacity: int, end_id: int
) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, piece, start, length, crc32 of the ids) of each piece of each text."""
    buffer, offsets = bt.text_buffer(batch.column("text"))
    ids, edges = tokenizer.buffer(buffer, offsets)
    end = np.array([end_id], "<u4").tobytes()
    ids = np.ascontiguousarray(ids, "<u4")
    view = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
    for row, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        total = b - a + 1
        for piece, start in enumerate(range(0, total, capacity)):
            stop = min(start + capacity, total)
            last = stop == total
            crc = zlib.crc32(view[4 * (a + start) : 4 * (a + stop - last)])
            yield row, piece, start, stop - start, zlib.crc32(end, crc) if last else crc


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset of each piece; fill of each bin) for pieces taken in the given order."""
    free_bits = 0
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    n_open = 0
    bins, offsets, fills = [], [], []
    for length in lengths:
        fitting = free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            stack = open_at[free]
            number = stack.pop()
            if not stack:
                free_bits ^= 1 << free
            n_open -= 1
        else:
            number, free = len(fills), capacity
            fills.append(0)
        bins.append(number)
        offsets.append(capacity - free)
        fills[number] = capacity - free + length
        left = free - length
        if left:
            open_at[left].append(number)
            free_bits |= 1 << left
            n_open += 1
            if n_open > open_bins:
                fullest = (free_bits & -free_bits).bit_length() - 1
                open_at[fullest].pop()
                if not open_at[fullest]:
                    free_bits ^= 1 << fullest
                n_open -= 1
    return bins, offsets, fills


_tokenizers: dict[str, WordTokenizer] = {}


def tokenized_pieces(
    docs: DataFrame, path: str, id_column: str, text_column: str, capacity: int, end_id: int
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, _copy) of every text, tokenized where it lies.

    ``_copy`` numbers equal rows of a partition, in whatever order they are read.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_column].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("_copy", T.LongType()),
        ]
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        seen: Counter = Counter()
        for batch in bt.slices(batches, "text", SLICE_BYTES):
            found = np.array(list(cut(batch, _tokenizers[path], capacity, end_id)), np.int64)
            ids = batch.column("doc_id").take(pa.array(found[:, 0]))
            copies = []
            for row in zip(ids.to_pylist(), found[:, 1].tolist(), found[:, 4].tolist(), strict=True):
                copies.append(seen[row])
                seen[row] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(found[:, 1].astype(np.int32)),
                    *(pa.array(found[:, n]) for n in (2, 3, 4)),
                    pa.array(copies, pa.int64()),
                ],
                schema.fieldNames(),
            )

    narrow = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    return narrow.mapInArrow(pieces, schema)


def pack(
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    open_bins: int = 512,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document's ids are those of its text by the tokenizer file ``path`` without special tokens,
    then ``end_id``; a null or empty text is that id alone. Only longer documents are cut, into pieces
    of ``capacity`` ids, the last one shorter. Pieces in one sequence fill it from 0 without gaps.
    Null ids stay null, repeated rows are documents of their own, other columns are not read, an
    empty table packs into nothing. ``group_bytes`` of text make a packing group, so the packing's
    tasks grow in number and not in size; rows of one id, and copies of a row, are dealt to all groups.
    """
    total = docs.select(F.sum(F.octet_length(text_column))).first()[0] or 0
    groups = max(MIN_GROUPS, -(-total // group_bytes))
    pieces = tokenized_pieces(docs, path, id_column, text_column, capacity, end_id)
    schema = T.StructType(
        [
            *pieces.schema.fields[:-1],
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    columns = pieces.columns[:-1]

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        table = table.sort_by([(c, "ascending") for c in ("_order", "doc_id", "piece", "ids_crc32", "length")])
        bins, offsets, _ = best_fit(table.column("length").to_pylist(), capacity, open_bins)
        numbers = np.array(bins, np.int64) * groups + group
        return (
            table.select(columns)
            .append_column("sequence_id", pa.array(numbers))
            .append_column("offset", pa.array(offsets, pa.int64()))
        )

    order = F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id(), "_copy")
    return (
        pieces.withColumn("_order", order)
        .withColumn("_group", F.pmod(F.xxhash64("_order"), F.lit(groups)))
        .groupBy("_group")
        .applyInArrow(fill, schema)
    )
