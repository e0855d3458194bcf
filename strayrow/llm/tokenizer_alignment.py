"""Cross-tokenizer alignment: where two tokenizers' tokens end together, and which ids go with which.

A byte-level BPE (``tokenizers``) reads a space and the text, a piece model (``sentencepiece``) the text, to
which it adds that space. Both give the characters each token spans. A span's end is a coarse cut: tokens
that end inside one character, parts of a multibyte character or byte-fallback tokens, share it. Those
are told apart by their decoded bytes, counted back from the character's end. Where both have a cut, the
text falls into groups.

Both tokenizers read words apart, with the space before them, so a text is cut there and every different
word is tokenized and aligned once a task; what a document has of each word is put together again.

How often two ids are linked over the whole corpus comes back to the documents by blocks: a block of
neighbouring texts is one list of different id pairs, summed and looked up once, however often its
documents hold them. Texts are tokenized once; links are kept as places in their block's list.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.llm import bytetext as bt
from strayrow.workspace import materialize

#: Text bytes read at once, and of a block whose id pairs are listed together.
SLICE_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20
#: Words a Python worker remembers, and their bytes; beyond that it forgets those met least often.
MAX_WORDS = 400_000
MAX_WORD_BYTES = 32 << 20
#: Words tokenized at once: the libraries give objects of 1 to 2 KB for each.
NEW_WORDS = 10_000
#: A single space between no space and a letter or digit: neither tokenizer joins what stands before and after.
_CUT = re.compile(r"(?<=\S) (?=[^\W_])")
_WORD = re.compile(r"[^\W_](.*\S)?", re.DOTALL)
#: New words that are given to the tokenizers as one text.
JOINED = 100


class Vocabulary:
    """The bytes of every token: ``data[starts[i] : starts[i] + sizes[i]]``."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, others from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + n): b for n, b in enumerate(rest)}


class ByteTokens:
    """A byte-level vocabulary with the character spans of its tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        letters = byte_letters()
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(names.values()) + 1)
        for name, number in names.items():
            known = all(c in letters for c in name)
            tokens[number] = bytes(letters[c] for c in name) if known else name.encode()
        self.vocabulary = Vocabulary(tokens)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[tuple[int, int]]]]:
        found = self.tokenizer.encode_batch([f" {t}" for t in texts], add_special_tokens=False)
        return [e.ids for e in found], [e.offsets for e in found]


class PieceTokens:
    """A piece vocabulary with byte fallback; spans count the characters of the text without the added space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: Whether a space can only begin a piece, so that texts may be cut before one.
        self.words = not any(re.search("[^▁]▁", p) for p in pieces)
        self.vocabulary = Vocabulary(
            [
                bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in enumerate(pieces)
            ]
        )

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[tuple[int, int]]]]:
        found = self.model.encode(texts, return_type="offset_mapping", num_threads=1)
        return [e["ids"] for e in found], [e["offsets"] for e in found]


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(a_path), PieceTokens(b_path)


def byte_ends(starts: np.ndarray, ends: np.ndarray, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where tokens end, in bytes, given their spans in characters, the characters' first bytes and the tokens' sizes.

    A span's end is the token's if the span isn't empty and the next one begins there; other tokens end
    inside a character, as many bytes before the next known end as the tokens between have.
    """
    known = ends > starts
    known[:-1] &= starts[1:] >= ends[:-1]
    known[-1:] = True
    following = np.where(known, np.arange(len(ends)), len(ends))
    following = np.minimum.accumulate(following[::-1])[::-1]
    until = np.cumsum(sizes)
    return chars[ends[following]] - (until[following] - until)


class Encoded:
    """One tokenizer's tokens of many texts, as far as their bytes are those of the texts with a space before."""

    def __init__(self, tokens, texts: list[str], shift: int, joined: np.ndarray, edges: np.ndarray, chars: np.ndarray, firsts: np.ndarray):
        ids, spans = tokens.encode(texts)
        counts = np.array([len(i) for i in ids], np.int64)
        self.ids = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
        flat = chain.from_iterable(chain.from_iterable(spans))
        both = np.fromiter(flat, np.int64, 2 * len(self.ids)).reshape(-1, 2) + shift
        self.owner = np.repeat(np.arange(len(texts)), counts)
        vocabulary = tokens.vocabulary
        self.sizes = vocabulary.sizes[self.ids]
        total = np.bincount(self.owner, self.sizes, len(texts)).astype(np.int64)
        self.good = total == np.diff(edges)
        both = np.minimum(firsts[self.owner][:, None] + both, firsts[self.owner + 1][:, None])
        self.ends = byte_ends(both[:, 0], both[:, 1], chars, self.sizes)
        self.take(self.good[self.owner])
        # Bytes of the tokens left, beside those of their parts.
        said = vocabulary.data[bt.expand(vocabulary.starts[self.ids], self.sizes)]
        there = bt.expand(edges[:-1][self.good], np.diff(edges)[self.good])
        wrong = np.searchsorted(edges, there[said != joined[there]], side="right") - 1
        self.good[wrong] = False
        self.take(self.good[self.owner])
        # Should a library report other spans for some text, the tokens' bytes decide.
        until = np.cumsum(self.sizes)
        first = np.searchsorted(self.owner, self.owner)
        decoded = edges[self.owner] + until - (until - self.sizes)[first]
        self.ends = np.where(self.ends == decoded, self.ends, decoded)

    def take(self, keep: np.ndarray) -> None:
        self.ids, self.ends, self.owner, self.sizes = (x[keep] for x in (self.ids, self.ends, self.owner, self.sizes))


def _numbers(limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, sizes) of ``;n``, of all numbers below ``limit``; the first byte is a separator to be set."""
    written = [b";%d" % n for n in range(limit)]
    sizes = np.array([len(w) for w in written], np.int64)
    return np.frombuffer(b"".join(written), np.uint8), np.cumsum(sizes) - sizes, sizes


_written = lru_cache(maxsize=2)(_numbers)


class Aligned:
    """Words with a space before, aligned: their tokens, groups and links, and the groups written out.

    ``joined`` words that may stand beside others are tokenized together; those of a text that fails have
    no tokens and are not ``good``. ``pairs`` has the links of all words, word by word; ``written`` is
    ``;a1,a2|b1;a3|b2,b3`` for each.
    """

    def __init__(self, words: list[str], a: ByteTokens, b: PieceTokens, joined: int = JOINED):
        plain = [w for w in words if b.words and _WORD.fullmatch(w)]
        kept = set(plain)
        self.words = plain + [w for w in words if w not in kept]
        cuts = np.array([*range(0, len(plain), joined), *range(len(plain), len(words) + 1)], np.int64)
        texts = [" ".join(self.words[s:e]) for s, e in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
        buffer = np.frombuffer("".join(f" {w}" for w in self.words).encode(), np.uint8)
        edges = np.cumsum([0, *(len(w.encode()) + 1 for w in self.words)], dtype=np.int64)
        chars = np.append(np.flatnonzero((buffer & 0xC0) != 0x80), len(buffer))
        firsts = np.cumsum([0, *(len(w) + 1 for w in self.words)], dtype=np.int64)
        sides = [Encoded(x, texts, shift, buffer, edges[cuts], chars, firsts[cuts]) for shift, x in enumerate((a, b))]
        good = sides[0].good & sides[1].good
        # Both must end where a word does.
        of_word = np.repeat(np.arange(len(texts)), np.diff(cuts))
        whole = np.isin(edges[1:], sides[0].ends) & np.isin(edges[1:], sides[1].ends)
        good[of_word[~whole]] = False
        for x in sides:
            x.take(good[x.owner])
            x.owner = np.searchsorted(edges, x.ends) - 1
        left, right = sides
        self.good = good[of_word]
        n = len(words)
        shared = np.intersect1d(left.ends, right.ends, assume_unique=True)
        ends_a, ends_b = np.searchsorted(left.ends, shared), np.searchsorted(right.ends, shared)
        self.n_a, self.n_b = np.bincount(left.owner, minlength=n), np.bincount(right.owner, minlength=n)
        self.n_groups = np.bincount(left.owner[ends_a], minlength=n)
        self.pairs = left.ids[ends_a] * len(b.vocabulary.sizes) + right.ids[ends_b]
        self.written = self._written(left, right, shared, max(len(a.vocabulary.sizes), len(b.vocabulary.sizes)))

    def _written(self, left: Encoded, right: Encoded, shared: np.ndarray, limit: int) -> list[bytes]:
        group_a, group_b = np.searchsorted(shared, left.ends), np.searchsorted(shared, right.ends)
        count = len(shared)
        before_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=count))])
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=count))])
        # Tokens of A stand after those of B of earlier groups, tokens of B after those of A up to their own.
        place_a = np.arange(len(group_a)) + before_b[group_a]
        place_b = np.arange(len(group_b)) + before_a[group_b + 1]
        total = len(group_a) + len(group_b)
        ids, marks = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        ids[place_a], ids[place_b] = left.ids, right.ids
        marks[place_a[before_a[:-1]]] = ord(";")
        marks[place_b[before_b[:-1]]] = ord("|")
        data, starts, sizes = _numbers(limit)
        lengths = sizes[ids]
        text = data[bt.expand(starts[ids], lengths)]
        at = np.concatenate([[0], np.cumsum(lengths)])
        text[at[:-1]] = marks
        cuts = at[np.cumsum([0, *(self.n_a + self.n_b)])].tolist()
        whole = text.tobytes()
        return [whole[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def _numbers(limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, sizes) of ``;n``, of all numbers below ``limit``; the first byte is a mark to be set."""
    written = [b";%d" % n for n in range(limit)]
    sizes = np.array([len(w) for w in written], np.int64)
    return np.frombuffer(b"".join(written), np.uint8), np.cumsum(sizes) - sizes, sizes


class Words:
    """Words aligned so far, numbered; texts are put together from them."""

    def __init__(self, a: ByteTokens, b: PieceTokens):
        self.a, self.b = a, b
        self.numbers: dict[str, int] = {}
        self.written: list[bytes] = []
        self.bytes = 0
        self.good = np.zeros(0, bool)
        self.n_a = self.n_b = self.n_groups = self.pairs = self.met = np.zeros(0, np.int64)

    def forget(self, most: int = 0) -> None:
        """Forget all words but those met more than once, ``most`` of them."""
        often = np.flatnonzero(self.met > 1)
        kept = np.sort(often[np.argsort(-self.met[often], kind="stable")[:most]])
        named = [""] * len(self.written)
        for word, number in self.numbers.items():
            named[number] = word
        starts = np.cumsum(self.n_groups) - self.n_groups
        self.pairs = self.pairs[bt.expand(starts[kept], self.n_groups[kept])]
        self.numbers = {named[k]: n for n, k in enumerate(kept.tolist())}
        self.written = [self.written[k] for k in kept.tolist()]
        self.bytes = sum(map(len, self.numbers)) + sum(map(len, self.written))
        for name in ("good", "n_a", "n_b", "n_groups"):
            setattr(self, name, getattr(self, name)[kept])
        self.met = np.ones(len(kept), np.int64)

    def learn(self, words: list[str]) -> None:
        parts = [Aligned(words[at : at + NEW_WORDS], self.a, self.b) for at in range(0, len(words), NEW_WORDS)]
        failed = [w for x in parts for w, good in zip(x.words, x.good.tolist(), strict=True) if not good]
        parts += [Aligned(failed[at : at + NEW_WORDS], self.a, self.b, 1) for at in range(0, len(failed), NEW_WORDS)]
        for found in parts:
            # A word that failed beside others gets a new number.
            self.numbers.update(zip(found.words, range(len(self.written), len(self.written) + len(found.words)), strict=True))
            self.written += found.written
            self.bytes += sum(map(len, found.words)) + sum(map(len, found.written))
        for name in ("good", "n_a", "n_b", "n_groups", "pairs"):
            setattr(self, name, np.concatenate([getattr(self, name), *(getattr(found, name) for found in parts)]))
        self.met = np.concatenate([self.met, np.zeros(len(self.good) - len(self.met), np.int64)])

    def align(self, texts: list[str | None]) -> Texts:
        if len(self.written) > MAX_WORDS or self.bytes > MAX_WORD_BYTES:
            self.forget(MAX_WORDS // 2 if self.bytes <= MAX_WORD_BYTES else 0)
        cut = [(_CUT.split(t) if self.b.words else [t]) if t else [] for t in texts]
        words = list(chain.from_iterable(cut))
        new = [w for w in dict.fromkeys(words) if w not in self.numbers]
        if new:
            self.learn(new)
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self.met += np.bincount(number, minlength=len(self.met))
        return Texts(self, number, np.cumsum([0, *map(len, cut)], dtype=np.int64))


class Texts:
    """Texts as runs of words: their tokens, groups, links and digests. A text with a word that fails has none."""

    def __init__(self, words: Words, number: np.ndarray, edges: np.ndarray):
        n = len(edges) - 1
        owner = np.repeat(np.arange(n), np.diff(edges))
        failed = np.bincount(owner, ~words.good[number], n) > 0
        kept = ~failed[owner]
        number, owner = number[kept], owner[kept]

        def total(of: np.ndarray) -> np.ndarray:
            return np.bincount(owner, of[number], n).astype(np.int64)

        self.n_a, self.n_b, self.n_groups = total(words.n_a), total(words.n_b), total(words.n_groups)
        starts = np.cumsum(words.n_groups) - words.n_groups
        self.pairs = words.pairs[bt.expand(starts[number], words.n_groups[number])]
        ends = np.searchsorted(owner, np.arange(n + 1))
        said = list(map(words.written.__getitem__, number.tolist()))
        self.digests = [
            hashlib.sha256(b"".join(said[s:e])[1:]).hexdigest() if e > s else ""
            for s, e in zip(ends.tolist(), ends[1:].tolist(), strict=False)
        ]


@lru_cache(maxsize=1)
def remembered(a_path: str, b_path: str) -> Words:
    """The words a Python worker has aligned in any of its tasks."""
    return Words(*tokenizers(a_path, b_path))


def encoded(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row a text: (block, doc_id, n_a, n_b, n_groups, groups_sha256, links), a block's first also with its list.

    ``links`` are places in the block's ``pairs``, whose ``counts`` are the links of the block. A pair is
    A's id times B's vocabulary size plus B's id.
    """
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    counted = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups")]
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            texts.schema["doc_id"],
            *counted,
            T.StructField("groups_sha256", T.StringType()),
            T.StructField("links", ints),
            T.StructField("pairs", longs),
            T.StructField("counts", ints),
        ]
    )

    def block(number: int, batches: list[pa.RecordBatch], found: list[Texts]) -> pa.RecordBatch:
        pairs = np.concatenate([x.pairs for x in found])
        listed, places, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        groups = np.concatenate([x.n_groups for x in found])
        n = len(groups)
        edges = pa.array(np.concatenate([[0], np.cumsum(groups)]), pa.int32())
        first = pa.array([0] + [len(listed)] * n, pa.int32())
        ids = pa.concat_arrays([x.column("doc_id") for x in batches])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, number, np.int64)),
                ids,
                *(pa.array(np.concatenate([getattr(x, c) for x in found])) for c in ("n_a", "n_b", "n_groups")),
                pa.array([d for x in found for d in x.digests], pa.string()),
                pa.ListArray.from_arrays(edges, pa.array(places.astype(np.int32))),
                pa.ListArray.from_arrays(first, pa.array(listed)),
                pa.ListArray.from_arrays(first, pa.array(counts.astype(np.int32))),
            ],
            schema.fieldNames(),
        )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = remembered(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        held, found, size = [], [], 0
        for batch in bt.slices(batches, "text", SLICE_BYTES):
            column = batch.column("text")
            held.append(batch.select(["doc_id"]))
            found.append(words.align(column.to_pylist()))
            size += column.nbytes
            if size >= BLOCK_BYTES:
                yield block(number, held, found)
                held, found, size, number = [], [], 0, number + 1
        if held:
            yield block(number, held, found)

    return texts.mapInArrow(align, schema)


def align(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of ``docs``.

    A link is a token of A and one of B that end at the same byte; a pair of ids counts as often as it is
    linked in all texts. ``n_best``: links whose count is the highest of their id of B. Null and empty
    texts, and texts that the tokens' bytes do not give back (the piece model rewrites some characters),
    have no tokens: zeros and an empty ``groups_sha256``. Special tokens in texts are plain text. Rows of
    one id, or none, stay rows of their own; other columns are not read; an empty table gives an empty
    result. A text is read in one task.
    """
    texts = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    rows = materialize(encoded(texts, a_path, b_path), "aligned-texts")
    _, b = tokenizers(a_path, b_path)
    modulus = F.lit(len(b.vocabulary.sizes))
    listed = rows.where(F.size("pairs") > 0).select(
        "block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "entry")
    )
    listed = listed.select("block", "place", F.col("entry.pairs").alias("pair"), F.col("entry.counts").alias("count"))
    totals = listed.groupBy("pair").agg(F.sum("count").alias("n")).withColumn("piece", F.col("pair") % modulus)
    # One row for each id of B at most.
    highest = F.broadcast(totals.groupBy("piece").agg(F.max("n").alias("most")))
    marked = totals.join(highest, "piece").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    looked = listed.join(marked, "pair").select(F.col("block").alias("of_block"), "place", "n", "best")
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = T.StructType(
        [
            texts.schema["doc_id"],
            *(T.StructField(c, T.LongType()) for c in names),
            T.StructField("groups_sha256", T.StringType()),
        ]
    )

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right["place"].to_numpy()
        n[at], best[at] = right["n"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        links = left["links"].combine_chunks()
        groups = left["n_groups"].to_numpy()
        flat = links.flatten().to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.cumsum(groups)])
        of = [np.concatenate([[0], np.cumsum(x[flat])])[edges] for x in (best, n)]
        made = [left["doc_id"], left["n_a"], left["n_b"], left["n_groups"], left["n_groups"]]
        return pa.table([*made, *(pa.array(np.diff(x)) for x in of), left["groups_sha256"]], names=schema.fieldNames())

    kept = rows.select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    return kept.groupBy("block").cogroup(looked.groupBy("of_block")).applyInArrow(summed, schema)
