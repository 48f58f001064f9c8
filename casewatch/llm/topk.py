"""Exact top-k by inner product, by aggregation of sorted lists without random access.

In each shard of the vectors every component has a list of the rows sorted by it. A query reads all its lists from the
end that adds most to the score, a stretch at a time. What has been read of a row gives a lower bound of its score (the
least of each unread list) and an upper one (the front of each unread list). Reading stops when few rows have an upper
bound that reaches the k-th best lower bound; only their scores are resolved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewatch.llm.batches import by_value, slices

by_value(__name__)

# Vectors of one shard, and numbers of the queries that every task holds.
SHARD = 8_192
QUERY_VALUES = 1 << 20
# Shares of the lists after which the bounds are compared; reading ends when so many rows are left.
DEPTHS = (1 / 4, 1 / 2, 3 / 4, 7 / 8, 15 / 16, 1)
FEW = 64
# Queries whose bounds are in memory at a time.
GROUP = 64
# Bounds are sums of floating-point products; this share of the largest possible sum covers their rounding.
ROUNDING = 2.0**-44


def quantized(vector: Column) -> Column:
    """floor(256 * x) of each component; null where the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * 256)))


class Lists:
    """The rows of a shard and, for each component, its values in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.exact = vectors.astype(np.float64)
        self.sorted = np.sort(self.exact, axis=0)

    def bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """What each component of each row adds at least and at most, once `depth` rows of its list have been read from
        the high end (left half, for positive weights) and from the low end (right half, for negative ones)."""
        x, rows = self.exact, len(self.ids)
        high, low = self.sorted[rows - depth], self.sorted[depth - 1]
        least = np.concatenate([np.where(x >= high, x, self.sorted[0]), np.where(x <= low, x, self.sorted[-1])], axis=1)
        most = np.concatenate([np.maximum(x, high), np.minimum(x, low)], axis=1)
        return least, most

    def top(self, own: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number of a query, ids and scores of rows that hold its k best but the query's own id."""
        rows = len(self.ids)
        weights = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1).astype(np.float64).T
        reach = np.abs(self.sorted[[0, -1]]).max(axis=0) if rows else np.zeros(queries.shape[1])
        slack = ROUNDING * (np.abs(queries) @ reach + 1)
        pending = np.arange(len(queries))
        for share in DEPTHS:
            if not len(pending) or not rows:
                return
            least, most = self.bounds(max(1, int(rows * share)))
            later = []
            for start in range(0, len(pending), GROUP):
                asked = pending[start : start + GROUP]
                mine = self.ids[:, None] == own[asked]
                lower, upper = least @ weights[:, asked], most @ weights[:, asked]
                lower[mine], upper[mine] = -np.inf, -np.inf
                best = min(k, rows)
                floor = np.partition(lower, rows - best, axis=0)[rows - best] - 2 * slack[asked]
                left = (upper >= floor) & ~mine
                settled = (left.sum(axis=0) <= FEW) | (share == 1)
                later.append(asked[~settled])
                for i in np.flatnonzero(settled).tolist():
                    chosen = np.flatnonzero(left[:, i])
                    yield int(asked[i]), self.ids[chosen], self.vectors[chosen] @ queries[asked[i]]
            pending = np.concatenate(later)


def _searching(queries: list[tuple[int, int, list[int]]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for number, own, vector in queries:
            asked.setdefault(len(vector), []).append((number, own, np.array(vector, np.int64)))
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(width: int) -> Iterator[pa.RecordBatch]:
            parts = held.pop(width)
            lists = Lists(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]))
            mine = asked.get(width)
            if not mine:
                return
            numbers, owners = np.array([n for n, _, _ in mine]), np.array([o for _, o, _ in mine])
            for i, ids, scores in lists.top(owners, np.stack([v for _, _, v in mine]), k):
                first = np.lexsort((ids, -scores))[:k]
                n = len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, numbers[i])), pa.array(np.full(n, owners[i])), pa.array(ids[first]), pa.array(scores[first])],
                    names=["number", "query_id", "vec_id", "score"],
                )

        for part in slices(batches, 1_024):
            vectors = part.column("vector")
            widths = vectors.value_lengths().to_numpy()
            values, ends = vectors.flatten().to_numpy(), np.cumsum(widths)
            ids = part.column("vec_id").to_numpy()
            for width in np.unique(widths).tolist():
                mine = np.flatnonzero(widths == width)
                places = (ends - widths)[mine][:, None] + np.arange(width)
                held.setdefault(width, []).append((ids[mine], values[places].reshape(len(mine), width)))
                if sum(len(i) for i, _ in held[width]) >= SHARD:
                    yield from flush(width)
        for width in list(held):
            yield from flush(width)

    return run


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", query_values: int | None = None
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k rows with the highest integer inner products with each query.

    Candidates are all rows but those with the query's own id; ties go to the smaller id; fewer rows give fewer ranks.
    Ids are whole numbers. Rows without id, and vectors that are null or hold a null or non-finite component, take no
    part; vectors of different lengths do not meet. Equal query rows count once, equal candidate rows one by one. Inner
    products must fit a long. Queries reach tasks in blocks of at most `query_values` numbers, each a pass over the
    candidates; no task holds more than one shard and one block.
    """
    limit = QUERY_VALUES if query_values is None else query_values
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), quantized(F.col(vector)).alias("vector"), is_query.alias("asks"))
    rows = rows.where("vec_id IS NOT NULL AND vector IS NOT NULL")
    asked = rows.where("asks").select("vec_id", "vector").distinct()
    total, numbers, queries = rows.agg(
        F.count("*"), F.sum(F.when(F.col("asks"), F.greatest(F.size("vector"), F.lit(1)))), F.count(F.when(F.col("asks"), 1))
    ).first()
    blocks = max(1, -(-int(numbers or 0) // limit))
    shards = max(1, -(-total // SHARD))
    spread = rows.select("vec_id", "vector").repartition(shards)
    found = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).sort("vec_id", "vector").collect()
        queries = [(block << 32 | i, r["vec_id"], r["vector"]) for i, r in enumerate(mine)]
        part = spread.mapInArrow(_searching(queries, k), "number long, query_id long, vec_id long, score long")
        found = part if found is None else found.union(part)
    best = Window.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
