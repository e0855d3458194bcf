"""Connected components of a table of links, by contraction.

Every batch of links is contracted where it lies: its nodes point to the least node they reach in it.
Where batches give a node several, they become the links of the next, smaller round. A node comes from
a batch once, however many links it has, so a hub is as many rows as there are batches. The pointers of
all rounds, followed from the last to the first, give every node its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.workspace import materialize

#: Links contracted together.
BATCH_LINKS = 500_000


def least_reachable(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """For nodes 0, 1, ... the least node that links (a, b) connect each with."""
    label = np.arange(nodes)
    while True:
        least = np.minimum(label[a], label[b])
        following = label.copy()
        np.minimum.at(following, a, least)
        np.minimum.at(following, b, least)
        # What a node pointed to points on, and everything that points to it follows.
        np.minimum.at(following, label[a], least)
        np.minimum.at(following, label[b], least)
        following = following[following]
        if np.array_equal(following, label):
            return label
        label = following


def contracted(links: DataFrame) -> DataFrame:
    """(node, root): every node of each batch of links (a, b) with the least node it reaches there."""
    kind = links.schema["a"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("root", kind)])

    def stars(batch: pa.Table) -> pa.RecordBatch:
        both = pa.chunked_array([*batch["a"].chunks, *batch["b"].chunks]).combine_chunks()
        coded = both.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes = rank[coded.indices.to_numpy(zero_copy_only=False)]
        half = len(codes) // 2
        roots = least_reachable(codes[:half], codes[half:], len(order))
        named = coded.dictionary.take(pa.array(order))
        return pa.RecordBatch.from_arrays([named, named.take(pa.array(roots))], ["node", "root"])

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BATCH_LINKS:
                yield stars(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield stars(pa.Table.from_batches(held))

    return links.select("a", "b").mapInArrow(contract, schema)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable from it."""
    rounds = []
    while True:
        # Full batches: as many tasks as there are, and few links are contracted at once.
        batches = max(1, -(-links.count() // BATCH_LINKS))
        stars = materialize(contracted(links.coalesce(batches)), "component-stars")
        least = stars.groupBy("node").agg(F.min("root").alias("component"), F.max("root").alias("_most"))
        least = materialize(least, "component-roots")
        rounds.append(least.select("node", "component"))
        # A root has a row of its own, so what it points to is among the links too.
        split = least.where("component <> _most").select("node", "component")
        links = materialize(
            stars.join(split, "node").where("component <> root").select(F.col("component").alias("a"), F.col("root").alias("b")).distinct(),
            "component-links",
        )
        if links.isEmpty():
            break
    labels = rounds.pop()
    while rounds:
        named = labels.select(F.col("node").alias("component"), F.col("component").alias("_last"))
        joined = rounds.pop().join(named, "component", "left")
        labels = materialize(
            joined.select("node", F.coalesce("_last", "component").alias("component")), "component-labels"
        )
    return labels
