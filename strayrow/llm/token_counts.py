"""Token counts of whole texts from a byte-level BPE vocabulary compiled into a counting transducer.

A BPE segmentation is fixed by which pairs of tokens may stand side by side: a sequence is the
segmentation of its bytes exactly if the merges turn each two neighbours into themselves. The last
token of a prefix is therefore the only vocabulary entry that ends there and is compatible with the
last token of what stands before it. A state of the transducer holds, for each earlier boundary that
a later token can still begin at, the bytes since, the token before, and the count up to there
relative to the count so far. A transition reads one byte; its output is the change of the count.
States and transitions are compiled from the vocabulary when first met and shared by all rows a
Python worker reads.

Texts are cut into chunks. A chunk's state map sends any entry state through the chunk's head, and is
constant after the first place where every state resets: before white space that follows something
else. So a map is kept as (head, count, tail); maps compose associatively and a prefix scan over the
chunks of a text gives its count, however long it is.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strayrow.llm import bytetext as bt

#: Fixed: how byte-level BPE vocabularies of this family split text before any merge.
PRETOKEN = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
#: Entries a worker keeps before it starts compiling anew; results don't depend on it.
CACHE_ENTRIES = 400_000
CHUNK_BYTES = 1 << 20
#: Longer pieces between two resets are not cached, only run.
CACHED_BYTES = 64

#: Fixed: UTF-8 of all white space beyond ASCII.
_WIDE_SPACES = [
    chr(c).encode()
    for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
]


def byte_letters() -> list[str]:
    """The printable letter a byte-level vocabulary writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in letters)
    letters.update((b, chr(256 + n)) for n, b in enumerate(rest))
    return [letters[b] for b in range(256)]


class CountingTransducer:
    """Deterministic byte transducer whose outputs add up to the number of BPE tokens."""

    def __init__(self, tokenizer):
        self._model = tokenizer.model
        self._letters = byte_letters()
        numbers = {letter: b for b, letter in enumerate(self._letters)}
        self._tokens = set()
        self._prefixes = set()
        for token in tokenizer.get_vocab(with_added_tokens=False):
            if all(c in numbers for c in token):
                raw = bytes(numbers[c] for c in token)
                self._tokens.add(raw)
                self._prefixes.update(raw[:n] for n in range(1, len(raw)))
        self._reset()

    def _reset(self) -> None:
        start = ((b"", b"", 0),)
        self._states = [start]
        self._numbers = {start: 0}
        self._moves: list[dict[int, tuple[int, int]]] = [{}]
        self._pairs: dict[tuple[bytes, bytes], bool] = {}

    def _text(self, raw: bytes) -> str:
        return "".join([self._letters[b] for b in raw])

    def _side_by_side(self, left: bytes, right: bytes) -> bool:
        pair = (left, right)
        known = self._pairs.get(pair)
        if known is None:
            found = [t.value for t in self._model.tokenize(self._text(left + right))]
            known = self._pairs[pair] = found == [self._text(x) for x in pair if x]
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        boundaries = self._states[state]
        letter = bytes([byte])
        for since, before, count in boundaries:
            token = since + letter
            if token in self._tokens and self._side_by_side(before, token):
                break
        else:
            raise ValueError("the vocabulary has no token for a byte")
        output = count + 1
        following = tuple(
            (since + letter, before, count - output)
            for since, before, count in boundaries
            if since + letter in self._prefixes
        ) + ((b"", token, 0),)
        number = self._numbers.get(following)
        if number is None:
            number = self._numbers[following] = len(self._states)
            self._states.append(following)
            self._moves.append({})
        move = self._moves[state][byte] = (number, output)
        return move

    def count(self, raw: bytes) -> int:
        """Tokens of one pretoken."""
        if len(self._states) > CACHE_ENTRIES:
            self._reset()
        moves, state, total = self._moves, 0, 0
        for byte in raw:
            move = moves[state].get(byte)
            if move is None:
                if len(self._states) > 2 * CACHE_ENTRIES:
                    # A single very long pretoken: go on from the same state in an emptied table.
                    kept = self._states[state]
                    self._reset()
                    moves = self._moves
                    state = self._numbers.setdefault(kept, len(self._states))
                    if state == len(self._states):
                        self._states.append(kept)
                        moves.append({})
                move = self._compile(state, byte)
            state, output = move
            total += output
        return total


class TokenCounter:
    """Counts of byte ranges between resets, through the pretoken split and the transducer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(path)
        self._transducer = CountingTransducer(tokenizer)
        specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self._special_bytes = [s.encode() for s in specials]
        self._pretokens: dict[str, int] = {}
        self._ranges: dict[bytes, int] = {}

    def _plain(self, text: str) -> int:
        total = 0
        known = self._pretokens
        for piece in PRETOKEN.findall(text):
            count = known.get(piece)
            if count is None:
                count = self._transducer.count(piece.encode())
                if len(piece) <= CACHED_BYTES:
                    known[piece] = count
            total += count
        return total

    def _count(self, raw: bytes) -> int:
        text = raw.decode()
        if self._specials and any(s in raw for s in self._special_bytes):
            parts = self._specials.split(text)
            return sum(map(self._plain, parts)) + len(parts) - 1
        return self._plain(text)

    def count(self, raw: bytes) -> int:
        """Tokens of a range that begins and ends at resets."""
        count = self._ranges.get(raw)
        if count is None:
            count = self._count(raw)
            if len(raw) <= CACHED_BYTES:
                self._ranges[raw] = count
        return count

    def trim(self) -> None:
        for cache in (self._pretokens, self._ranges):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()


def resets(buffer: np.ndarray) -> np.ndarray:
    """Positions before white space that follows anything else: a pretoken always ends there."""
    if len(buffer) < 2:
        return np.zeros(0, np.int64)
    space = bt.ASCII_SPACE[buffer]
    unclear = space | ((buffer >= 0x1C) & (buffer <= 0x1F))
    if (buffer >= 0xC2).any():
        raw = buffer.tobytes()
        for wide in _WIDE_SPACES:
            at = raw.find(wide)
            while at >= 0:
                unclear[at : at + len(wide)] = True
                at = raw.find(wide, at + len(wide))
    return np.flatnonzero(space[1:] & ~unclear[:-1]) + 1


class StateMap:
    """What a chunk does to the count: head before its first reset, count between, tail after its last."""

    __slots__ = ("head", "count", "tail")

    def __init__(self, head: bytes, count: int | None, tail: bytes):
        self.head, self.count, self.tail = head, count, tail

    @classmethod
    def of(cls, raw: bytes, counter: TokenCounter) -> StateMap:
        cuts = resets(np.frombuffer(raw, np.uint8))
        if not len(cuts):
            return cls(raw, None, b"")
        edges = cuts.tolist()
        count = sum(counter.count(raw[a:b]) for a, b in zip(edges, edges[1:], strict=False))
        return cls(raw[: edges[0]], count, raw[edges[-1] :])

    def then(self, other: StateMap, counter: TokenCounter) -> StateMap:
        """Composition: this chunk, then the other."""
        if self.count is None and other.count is None:
            return StateMap.of(self.head + other.head, counter)
        if self.count is None:
            joined = StateMap.of(self.head + other.head, counter)
            if joined.count is None:
                return StateMap(joined.head, other.count, other.tail)
            return StateMap(
                joined.head, joined.count + counter.count(joined.tail) + other.count, other.tail
            )
        joined = StateMap.of(self.tail + other.head, counter)
        if other.count is None:
            if joined.count is None:
                return StateMap(self.head, self.count, joined.head)
            middle = counter.count(joined.head) + joined.count
            return StateMap(self.head, self.count + middle, joined.tail)
        if joined.count is None:
            middle = counter.count(joined.head)
        else:
            middle = counter.count(joined.head) + joined.count + counter.count(joined.tail)
        return StateMap(self.head, self.count + middle + other.count, other.tail)

    def total(self, counter: TokenCounter) -> int:
        ends = counter.count(self.head) if self.head else 0
        ends += counter.count(self.tail) if self.tail else 0
        return ends + (self.count or 0)


def scan(maps: list[StateMap], counter: TokenCounter) -> StateMap:
    """Compose neighbours level by level, as a parallel prefix scan does for its last element."""
    while len(maps) > 1:
        paired = [a.then(b, counter) for a, b in zip(maps[::2], maps[1::2], strict=False)]
        maps = paired + maps[len(paired) * 2 :]
    return maps[0]


def count_long(raw: bytes, counter: TokenCounter, chunk: int = CHUNK_BYTES) -> int:
    """Tokens of one text of any length, chunk by chunk."""
    cuts, at = [0], chunk
    while at < len(raw):
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        cuts.append(at)
        at += chunk
    maps = [StateMap.of(raw[a:b], counter) for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
    return scan(maps, counter).total(counter)


def count_buffer(buffer: np.ndarray, offsets: np.ndarray, counter: TokenCounter) -> np.ndarray:
    """Tokens of each text of a buffer; each distinct range between resets is counted once."""
    n = len(offsets) - 1
    counts = np.zeros(n, np.int64)
    if not len(buffer):
        return counts
    filled = np.flatnonzero(np.diff(offsets) > 0)
    starts = np.unique(np.concatenate([resets(buffer), offsets[:-1][filled]]))
    ends = np.append(starts[1:], len(buffer))
    _, sample, codes = bt.distinct(bt.range_hashes(bt.prefix_hashes(buffer), starts, ends))
    raw = buffer.tobytes()
    each = np.fromiter(
        (counter.count(raw[a:b]) for a, b in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)),
        np.int64,
        len(sample),
    )
    sums = np.concatenate([[0], np.cumsum(each[codes])])
    edges = np.searchsorted(starts, offsets)
    return sums[edges[1:]] - sums[edges[:-1]]


_counters: dict[str, TokenCounter] = {}


def count_tokens(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 512
) -> DataFrame:
    """One row per row of ``docs``: (id, n_bytes, n_tokens, over_limit).

    ``path`` names a byte-level BPE ``tokenizer.json`` that every executor can read. No begin or end
    tokens are added; special strings inside a text count as one token each, the library's default.
    A null or empty text has no bytes and no tokens. A null id stays null, repeated rows repeat,
    other columns are not read. An empty table gives an empty result.
    """
    id_type = docs.schema[id_column].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = TokenCounter(path)
        counter = _counters[path]
        for batch in bt.slices(batches, "text"):
            buffer, offsets = bt.text_buffer(batch.column("text"))
            if batch.num_rows == 1 and len(buffer) > CHUNK_BYTES:
                counts = np.array([count_long(buffer.tobytes(), counter)], np.int64)
            else:
                counts = count_buffer(buffer, offsets, counter)
            counter.trim()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    return narrow.mapInArrow(count, schema)
