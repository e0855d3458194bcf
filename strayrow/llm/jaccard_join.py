"""Near-duplicate documents by an exact Jaccard join of word n-grams.

Every document is the set of its shingles, ordered rare first by how many documents hold a shingle. Two
sets as similar as asked share a shingle in their first few, the prefix, so documents meet on prefix
shingles alone, and only on those that some other document holds: a document with enough shingles of
its own meets none. Equal sets are one node from the start and are counted once.

How many documents hold a shingle is counted in cells, ``CELLS`` for every shingle of the corpus. Blocks
of documents send the cells they use to the tasks that count them, as sorted differences, and get a
level for each cell back in the same order; no table of counts is held in one place. Where shingles
share a cell the order changes, never the result, as it is the same for all documents.

Three bounds drop pairs before they are compared: the lengths; what the places of the shared shingle
leave possible; and, in place of probing the suffixes, how many parts of the key space hold an odd
number of shingles of one set and an even number of the other, since two sets differ in at least as
many shingles. The intersection then decides once per pair.

Documents that share a prefix shingle are compared in rounds: each with a few members of the group
drawn by hash, then with four times as many each round, and always only across components; what has
been compared with all others leaves the group. So a large group of near copies costs a few comparisons
for each, no link that joins two components is missed, and groups of connected texts are never expanded
into all their pairs. Groups are counted and drawn from by aggregates and hashes alone, so none is
gathered or sorted in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.llm import bytetext as bt
from strayrow.llm.components import components
from strayrow.workspace import materialize

#: Counting cells for each shingle of the corpus, at least, and shingles whose cells one task counts.
CELLS = 16
PART_SHINGLES = 2_000_000
#: Text bytes of a block of documents, a row counting for some itself: a task holds some 40 times as much.
BLOCK_BYTES = 2 << 20
ROW_BYTES = 256
#: Text bytes whose shingles are held at once where documents are described: some 40 times as much.
SLICE_BYTES = 1 << 20
#: Groups up to this size are compared in full; of larger ones about so many members in the first round.
SMALL_GROUP = 16
PIVOTS = 3
PIVOT_GROWTH = 4
#: Words of 64 parts of the key space whose parities the suffix filter compares.
PARITY_WORDS = 8
_FACTORS = bt.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(buffer: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the n-word shingles in text order, n+1 edges of the texts); a shorter text is one shingle."""
    low = bt.LOWER_ASCII[buffer]
    starts, ends = bt.words(low, offsets)
    edges = np.searchsorted(starts, offsets)
    counts = np.diff(edges)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    words = bt.range_hashes(bt.prefix_hashes(low), starts, ends)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    at = bt.expand(edges[:-1], sizes)
    taken = np.repeat(np.minimum(counts, n), sizes)
    hashes = taken.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    for step in range(n):
        inside = taken > step
        hashes[inside] += words[at[inside] + step] * _FACTORS[step]
    return bt.mix(hashes), np.concatenate([[0], np.cumsum(sizes)])


def distinct_shingles(buffer: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, edges): each text's distinct shingles in ascending order."""
    hashes, edges = shingles(buffer, offsets, n)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(edges))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(offsets)))


def set_digests(keys: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """MD5 of each set of shingles: equal sets are one node."""
    cuts = edges.tolist()
    return [
        hashlib.md5(keys[a:b].tobytes(), usedforsecurity=False).digest() for a, b in zip(cuts, cuts[1:], strict=False)
    ]


def sliced_sets(
    batches: Iterator[pa.RecordBatch], n: int
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[bytes]]]:
    """(rows, sizes, digests) of the sets of slice after slice."""
    for batch in bt.slices(batches, "text", SLICE_BYTES):
        keys, edges = distinct_shingles(*bt.text_buffer(batch.column("text")), n)
        yield batch, np.diff(edges), set_digests(keys, edges)


def described(texts: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_key, size, digest) of every row."""
    schema = T.StructType(
        [
            texts.schema["doc_id"],
            T.StructField("text_key", T.LongType()),
            T.StructField("size", T.LongType()),
            T.StructField("digest", T.BinaryType()),
        ]
    )

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sizes, digests in sliced_sets(batches, n):
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return texts.mapInArrow(describe, schema)


def blocks_of_sets(texts: DataFrame, n: int, blocks: int) -> DataFrame:
    """(block, digest, text): a text of every set that has shingles, dealt to blocks by its digest.

    A task sends one text of each set it meets; sets of all tasks are then reduced to one, in order, so a
    set that a third of all rows have is a row for each task.
    """
    schema = "block int, digest binary, text string"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch, sizes, digests in sliced_sets(batches, n):
            wanted = []
            for row, (size, digest) in enumerate(zip(sizes.tolist(), digests, strict=True)):
                if size and digest not in met:
                    met.add(digest)
                    wanted.append(row)
            chosen = [digests[row] for row in wanted]
            numbers = [int.from_bytes(d[:8], "little") % blocks for d in chosen]
            text = batch.column("text").take(pa.array(wanted, pa.int64()))
            columns = [pa.array(numbers, pa.int32()), pa.array(chosen, pa.binary()), text]
            yield pa.RecordBatch.from_arrays(columns, ["block", "digest", "text"])

    dealt = texts.select("text").mapInArrow(deal, schema).repartition("block")
    return dealt.groupBy("block", "digest").agg(F.first("text").alias("text"))


class Cells:
    """Counting cells for a corpus of so many shingles, and the parts that are counted apart."""

    def __init__(self, total: int):
        self.bits = max(16, (total * CELLS - 1).bit_length())
        self.part_bits = max(0, ((total - 1) // PART_SHINGLES).bit_length())

    def of(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - self.bits)

    def cut(self, cells: np.ndarray) -> np.ndarray:
        """Where the parts of sorted cells begin and end."""
        firsts = np.arange((1 << self.part_bits) + 1, dtype=np.uint64) << np.uint64(self.bits - self.part_bits)
        return np.searchsorted(cells, firsts)


def _packed(cells: np.ndarray) -> bytes:
    """Sorted cells as differences, byte by byte: high bytes are nearly all zero and compress well."""
    steps = np.diff(cells, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def cell_levels(blocks: DataFrame, n: int, cells: Cells) -> DataFrame:
    """(of_block, part, levels): for the sorted cells of each block in a part, how frequent each is.

    Level 0 is a cell that one set has; above that there are four levels to a doubling.
    """

    def used(table: pa.Table) -> pa.Table:
        found = cells.of(_block_keys(table, n)[0])
        values, counts = np.unique(found, return_counts=True)
        cuts = cells.cut(values).tolist()
        counts = np.minimum(counts, 0xFFFF).astype(np.uint16)
        spans = [(part, a, b) for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        return pa.table(
            {
                "of_block": pa.array([table["block"][0].as_py()] * len(spans), pa.int32()),
                "part": pa.array([part for part, _, _ in spans], pa.int32()),
                "cells": pa.array([_packed(values[a:b]) for _, a, b in spans], pa.binary()),
                "counts": pa.array([counts[a:b].tobytes() for _, a, b in spans], pa.binary()),
            }
        )

    def level(table: pa.Table) -> pa.Table:
        asked = [_unpacked(x) for x in table["cells"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint16) for x in table["counts"].to_pylist()])
        _, place = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(place, counts)
        levels = np.where(total < 2, 0, np.minimum(4 * np.log2(np.maximum(total, 1)), 255)).astype(np.uint8)[place]
        ends = np.cumsum([len(x) for x in asked])
        answers = [x.tobytes() for x in np.split(levels, ends[:-1])]
        return pa.table([table["of_block"], table["part"], pa.array(answers, pa.binary())], ["of_block", "part", "levels"])

    sent = blocks.groupBy("block").applyInArrow(used, "of_block int, part int, cells binary, counts binary")
    return sent.groupBy("part").applyInArrow(level, "of_block int, part int, levels binary")


def _block_keys(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    bt.release()
    return distinct_shingles(*bt.text_buffer(table["text"].combine_chunks()), n)


def needed(size, threshold: int):
    """The smallest size, and so the smallest overlap, of a set similar to one of ``size``."""
    return (threshold * size + 99) // 100


def _parities(keys: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """PARITY_WORDS numbers a text: bit by bit, whether a part of the key space holds an odd number of its shingles."""
    rows, parts = len(edges) - 1, 64 * PARITY_WORDS
    owner = np.repeat(np.arange(rows), np.diff(edges))
    part = (bt.mix(keys) % np.uint64(parts)).astype(np.int64)
    odd = np.bincount(owner * parts + part, minlength=rows * parts).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def prefixed_sets(blocks: DataFrame, levels: DataFrame, n: int, threshold: int, cells: Cells) -> DataFrame:
    """(node, size, parities, places, tokens, keys) of the sets with a prefix shingle that others may have.

    ``places`` are those of the prefix in the whole set, rare first; ``keys`` the whole set.
    """
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [
            T.StructField("node", T.BinaryType()),
            T.StructField("size", T.LongType()),
            T.StructField("parities", longs),
            T.StructField("places", longs),
            T.StructField("tokens", longs),
            T.StructField("keys", longs),
        ]
    )

    def lists(edges: np.ndarray, values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values))

    def edges_of(sizes: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in _arrow_types()], schema.fieldNames())
        keys, edges = _block_keys(left, n)
        ordered = sorted(zip(right["part"].to_pylist(), right["levels"].to_pylist(), strict=True))
        known = np.frombuffer(b"".join(x for _, x in ordered), np.uint8)
        values, place = np.unique(cells.of(keys), return_inverse=True)
        rank = known[place]
        sizes = np.diff(edges)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((keys, rank, owner))
        at = np.arange(len(keys)) - edges[:-1][owner]
        short = sizes - needed(sizes, threshold) + 1
        # In order, level 0 comes first: those are in no other set.
        met = (at < short[owner]) & (rank[order] > 0)
        tokens, places, owners = keys[order][met], at[met], owner[met]
        counts = np.bincount(owners, minlength=len(sizes))
        rows = np.flatnonzero(counts)
        inside = bt.expand(edges[:-1][rows], sizes[rows])
        parities = _parities(keys, edges).reshape(-1, PARITY_WORDS)[rows].ravel()
        return pa.table(
            [
                left["digest"].take(pa.array(rows)).combine_chunks(),
                pa.array(sizes[rows]),
                lists(np.arange(len(rows) + 1) * PARITY_WORDS, parities),
                lists(edges_of(counts[rows]), places),
                lists(edges_of(counts[rows]), tokens.view(np.int64)),
                lists(edges_of(sizes[rows]), keys[inside].view(np.int64)),
            ],
            schema.fieldNames(),
        )

    def _arrow_types() -> list[pa.DataType]:
        return [pa.binary(), pa.int64(), *[pa.list_(pa.int64())] * 4]

    return blocks.groupBy("block").cogroup(levels.groupBy("of_block")).applyInArrow(build, schema)


def _overlap(a: Column, b: Column, threshold: int) -> Column:
    """The smallest overlap with which sets of sizes a and b are similar."""
    return F.ceil(threshold * (a + b) / F.lit(100 + threshold))


def _possible(a: str, b: str, threshold: int) -> Column:
    """Length, positional and parity bounds for two members that share a shingle."""
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    place_a, place_b = F.col(f"{a}.place"), F.col(f"{b}.place")
    least = _overlap(size_a, size_b, threshold)
    most = F.least(size_a - place_a, size_b - place_b) + F.least(place_a, place_b)
    apart = F.lit(0)
    for word in range(PARITY_WORDS):
        apart += F.bit_count(F.col(f"{a}.parities")[word].bitwiseXOR(F.col(f"{b}.parities")[word]))
    return (
        (100 * F.least(size_a, size_b) >= threshold * F.greatest(size_a, size_b))
        & (most >= least)
        & (apart <= size_a + size_b - 2 * least)
    )


def candidate_pairs(members: DataFrame, threshold: int, pivots: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """(pairs to compare this round, what is left of the groups after it).

    ``members`` is (token, node, size, place, parities, component, group). About ``pivots`` members of
    a group, drawn by a hash of node and round, meet all members not connected with them; in a small
    group all members are pivots.
    """
    ticket = F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    drawn = (F.col("group") <= max(SMALL_GROUP, pivots)) | (ticket * F.col("group") < F.lit(float(pivots)))
    known = members.withColumn("pivot", drawn)
    met = (
        known.alias("x")
        .join(known.where("pivot").alias("y"), F.col("x.token") == F.col("y.token"))
        .where(
            (F.col("x.component") != F.col("y.component"))
            & (~F.col("x.pivot") | (F.col("x.node") < F.col("y.node")))
            & _possible("x", "y", threshold)
        )
    )
    pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    return pairs, known.where("not pivot").drop("pivot", "component", "group")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that are as similar as asked, by their whole sets."""

    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("keys").alias(f"{name}_keys"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = F.size("a_keys") + F.size("b_keys")
    shared = F.size(F.array_intersect("a_keys", "b_keys"))
    return both.where(100 * shared >= threshold * (sizes - shared)).select("a", "b").distinct()


def _mixed_groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their components, of groups that still hold more than one component."""
    joined = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = (
        joined.groupBy("token")
        .agg(F.count("*").alias("group"), F.min("component").alias("_least"), F.max("component").alias("_most"))
        .where("_least != _most")
        .select("token", "group")
    )
    return joined.join(mixed, "token")


def linked_sets(sets: DataFrame, threshold: int) -> DataFrame | None:
    """(node, component) of the sets that are linked with others; None if no set shares a prefix shingle."""
    entry = F.explode(F.arrays_zip("tokens", "places")).alias("entry")
    entries = sets.select("node", "size", "parities", entry).select(
        "node", "size", "parities", F.col("entry.tokens").alias("token"), F.col("entry.places").alias("place")
    )
    shared = entries.groupBy("token").agg(F.count("*").alias("group")).where("group > 1")
    groups = materialize(entries.join(shared, "token").withColumn("component", F.col("node")), "shingle-groups")
    compared, links, labels = None, None, None
    turn, pivots = 0, PIVOTS
    while not groups.isEmpty():
        pairs, left = candidate_pairs(groups, threshold, pivots, turn)
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "shingle-pairs")
        compared = pairs if compared is None else compared.union(pairs)
        found = materialize(verified(pairs, sets, threshold), "shingle-links")
        turn, pivots = turn + 1, pivots * PIVOT_GROWTH
        if labels is not None and found.isEmpty():
            groups = materialize(_mixed_groups(left, labels), "shingle-groups")
            continue
        # What earlier rounds have connected is kept as a link from every node to its component.
        links = found if labels is None else found.union(labels.select(F.col("component").alias("a"), F.col("node").alias("b")))
        labels = components(links)
        groups = materialize(_mixed_groups(left, labels), "shingle-groups")
    return labels


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, threshold: int = 80
) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_key, group_key), a row for each row of ``docs``.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a document is the set of its
    shingles of ``words`` words, or its whole word sequence if it has fewer. Two documents link when
    their Jaccard similarity is at least ``threshold`` per cent; ``component_id`` is the smallest id
    reachable by links. Null, empty and blank texts have no shingles and link with nothing. Rows with
    a null id get a null component. Rows of one id are documents of their own, which ``text_key``, the
    xxHash64 of the text, tells apart, and their groups may have the same smallest id, so ``group_key``
    names a group (null without shingles or id). An empty table gives an empty result; other columns are
    not read.
    """
    text = docs[text_column]
    texts = docs.select(docs[id_column].alias("doc_id"), text.alias("text"), text_key(text).alias("text_key"))
    rows = materialize(described(texts, words), "shingle-rows")
    named = rows.where((F.col("size") > 0) & F.col("doc_id").isNotNull())
    nodes = named.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("size").alias("size"))
    shingled = nodes.agg(F.sum("size")).first()[0] or 0
    size = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    cells = Cells(max(1, shingled))
    blocks = blocks_of_sets(texts.where("doc_id is not null"), words, max(1, -(-size // BLOCK_BYTES)))
    levels = cell_levels(blocks, words, cells)
    sets = materialize(prefixed_sets(blocks, levels, words, threshold, cells), "shingle-sets")
    labels = linked_sets(sets, threshold)
    if labels is not None:
        joined = nodes.join(labels.select(F.col("node").alias("digest"), "component"), "digest", "left")
        joined = joined.select("digest", "least", F.coalesce("component", "digest").alias("component"))
        smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
        nodes = joined.join(smallest, "component")
    else:
        nodes = nodes.withColumns({"component_id": F.col("least"), "component": F.col("digest")})
    nodes = nodes.select("digest", "component_id", F.col("component").alias("group_key"))
    own, none = F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("group_key")
    columns = ("doc_id", F.col("size").alias("n_shingles"))
    alone = rows.where((F.col("size") == 0) | F.col("doc_id").isNull()).select(*columns, own, "text_key", none)
    # Of empty sets, which a large part of all rows may be, none takes part in the join.
    found = named.join(nodes, "digest").select(*columns, "component_id", "text_key", "group_key")
    return found.union(alone)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))
