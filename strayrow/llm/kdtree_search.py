"""Exact top-k inner products by KD-trees over shards.

Vectors are dealt by hash to shards of bounded size. In its shard a KD-tree is built by median splits
of the widest side, and every node keeps the tight box around its vectors. The inner product of a
query with any vector of a box is at most the sum of its larger products with the box's two sides; a
search visits nodes in the order of that bound and stops at the first one below the kth score so far.
Every query searches its own shard first. The kth score found there goes along to all other shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strayrow.workspace import materialize

SHARD_ROWS = 16_384
MIN_SHARDS = 8
QUERY_BLOCK = 2048
LEAF_ROWS = 128
#: Sums of products below this are exact in doubles.
_EXACT = 2**53
_RESULT = "query_no long, query_id long, vec_id long, score long"


def integer_vectors(rows: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(vec_id, vector of floor(scale * x)); rows with a null id, vector or component, or one that isn't finite, go."""
    finite = F.forall(
        vector_column,
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")),
    )
    return rows.where(F.col(id_column).isNotNull() & (F.size(vector_column) > 0) & finite).select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.transform(vector_column, lambda x: F.floor(x.cast("double") * scale)).alias("vector"),
    )


class KDTree:
    """Median splits with a tight box around every node's vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self._low, self._high, self._children = [], [], []
        self._leaves: dict[int, np.ndarray] = {}
        self._split(np.arange(len(ids)), leaf)
        self.low, self.high = np.array(self._low), np.array(self._high)

    def _split(self, rows: np.ndarray, leaf: int) -> int:
        node = len(self._low)
        box = self.vectors[rows]
        low, high = box.min(0), box.max(0)
        self._low.append(low)
        self._high.append(high)
        self._children.append(None)
        widest = int((high - low).argmax())
        if len(rows) <= leaf or high[widest] == low[widest]:
            self._leaves[node] = np.sort(rows)
            return node
        half = len(rows) // 2
        order = np.argpartition(box[:, widest], half)
        self._children[node] = (self._split(rows[order[:half]], leaf), self._split(rows[order[half:]], leaf))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No vector of a node has a larger inner product with a query than this."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.high.T + down @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, known: float):
        """(ids, scores) of the k best but ``own``; scores below ``known`` are not of interest."""
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, bounds.dtype)
        kth = known
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < kth:
                break
            if self._children[node] is not None:
                for child in self._children[node]:
                    if bounds[child] >= kth:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            rows = self._leaves[node]
            scores = self.vectors[rows] @ query
            good = (scores >= kth) & (self.ids[rows] != own)
            if not good.any():
                continue
            best = np.concatenate([best, scores[good]])
            best_ids = np.concatenate([best_ids, self.ids[rows[good]]])
            first = np.lexsort((best_ids, -best))[:k]
            best, best_ids = best[first], best_ids[first]
            if len(best) == k:
                kth = max(kth, best[-1])
        return best_ids, best


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def search_shard(left: pa.Table, right: pa.Table, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the query, ids, scores) for the queries in ``right`` over the vectors in ``left``, all of one length."""
    vectors, queries = _matrix(left["vector"], len(left)), _matrix(right["vector"], len(right))
    reach = float(np.abs(vectors.astype(float)).max()) * float(np.abs(queries.astype(float)).max())
    if reach * vectors.shape[1] < _EXACT:
        vectors, queries = vectors.astype(float), queries.astype(float)
    else:
        vectors, queries = vectors.astype(object), queries.astype(object)
    tree = KDTree(left["vec_id"].to_numpy(), vectors)
    bounds = tree.bounds(queries)
    lowest = -float("inf")
    for n, (own, known) in enumerate(zip(right["query_id"].to_pylist(), right["known"].to_pylist(), strict=True)):
        ids, scores = tree.search(queries[n], bounds[n], own, k, lowest if known is None else known)
        yield n, ids, scores


def _search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Search every (shard, block, length) of ``queries`` in the shard's vectors."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(search_shard(left, right, k)) if len(left) and len(right) else []
        ids = [np.asarray(f[1], np.int64) for f in found]
        asked = pa.array([n for (n, _, _), i in zip(found, ids, strict=True) for _ in i], pa.int64())
        return pa.table(
            {
                "query_no": right["query_no"].take(asked),
                "query_id": right["query_id"].take(asked),
                "vec_id": pa.array([v for i in ids for v in i.tolist()], pa.int64()),
                "score": pa.array([int(s) for f in found for s in f[2]], pa.int64()),
            }
        )

    keys = ["shard", "block", "length"]
    queries = queries.select(*(F.col(c).alias(c) for c in queries.columns))
    return vectors.groupBy(keys).cogroup(queries.groupBy(keys)).applyInArrow(run, _RESULT)


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query's row.

    ``is_query`` is a condition on the column ``vec_id``. Ties go to the smaller id; a query's own id
    is no candidate; vectors of another length are not comparable. Rows with a null id, a null or
    empty vector, or a component that is null or not finite take no part. Rows of a repeated
    id are queries and candidates of their own, but no candidates for one another. A score beyond 64 bits is an error. Tables without a query give an empty result.
    """
    vectors = integer_vectors(rows, id_column, vector_column, scale)
    count = vectors.count()
    shards = max(MIN_SHARDS, -(-count // shard_rows))
    vectors = vectors.select(
        "vec_id",
        "vector",
        F.size("vector").alias("length"),
        F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int").alias("shard"),
    )
    queries = vectors.where(is_query).withColumnRenamed("vec_id", "query_id")
    # Written out, so that a row keeps its number: rows of one id are queries of their own.
    queries = materialize(queries.withColumn("query_no", F.monotonically_increasing_id()), "topk-queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    dealt = vectors.withColumn("block", every_block)
    home = materialize(_search(dealt, queries.withColumn("known", F.lit(None).cast("long")), k), "topk-home")
    place = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    known = (
        home.withColumn("_rank", F.row_number().over(place))
        .where(F.col("_rank") == k)
        .select("query_no", F.col("score").alias("known"))
    )
    travelling = (
        queries.withColumnRenamed("shard", "_home")
        .join(known, "query_no", "left")
        .withColumn("shard", every_shard)
        .where(F.col("shard") != F.col("_home"))
        .drop("_home")
    )
    found = home.unionByName(_search(dealt, travelling, k))
    return (
        found.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
