"""Nearest names by cosine similarity of given vectors, exact and by cells."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from casewatch.plans.lineage import cut_lineage
from casewatch.plans.ranking import top_k_per_key
from casewatch.plans.skew import CELL, Side, spread

# Executors need not have this package: what runs in tasks travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Similarities are rounded before ranking, so that equal vectors tie and the smaller id wins.
DIGITS = 6
# Numbers in the query matrix every task may hold (32 MB as doubles).
MAX_BROADCAST_VALUES = 4_000_000
# Rows of one block of the grid that compares two large sets.
QUERY_BLOCK = 2_048
VECTOR_BLOCK = 65_536
# Rows compared at a time with so many queries (16 MB of scores as doubles), however many queries a task holds.
SLICE = 4_096
QUERY_STEP = 512


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows from a column of float lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    matrix = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


class _Best:
    """The best `k` (score, id) of each query over the blocks seen so far."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, other_id_only: bool):
        self.query_ids, self.queries, self.k, self.other_id_only = query_ids, queries, k, other_id_only
        count = len(query_ids)
        self.rows = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=query_ids.dtype)
        self.scores = np.empty(0)
        self.floor = np.full(count, -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for start in range(0, len(ids), SLICE):
            part = ids[start : start + SLICE]
            kept = [self._step(at, part, vectors[start : start + SLICE]) for at in range(0, len(self.queries), QUERY_STEP)]
            if kept:
                rows, columns, scores = (np.concatenate(x) for x in zip(*kept))
                self._merge(rows, part[columns], scores)

    def _step(self, at: int, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, place and score of what may be among the best of the queries from `at` on."""
        own = slice(at, at + QUERY_STEP)
        scores = np.round(self.queries[own] @ vectors.T, DIGITS)
        if self.other_id_only:
            scores[self.query_ids[own, None] == ids[None, :]] = -np.inf
        if scores.shape[1] > self.k:
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
        else:
            kth = np.full(len(scores), -np.inf)
        keep = (scores >= np.maximum(kth, self.floor[own])[:, None]) & (scores > -np.inf)
        rows, columns = np.nonzero(keep)
        return rows + at, columns, scores[rows, columns]

    def _merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows = np.concatenate([self.rows, rows])
        ids = np.concatenate([self.ids, ids])
        scores = np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        starts = np.searchsorted(rows, rows, side="left")
        place = np.arange(len(rows)) - starts
        kept = place < self.k
        self.rows, self.ids, self.scores = rows[kept], ids[kept], scores[kept]
        last = place == self.k - 1
        self.floor[rows[last]] = scores[last]

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = [self.query_ids[self.rows], self.ids, self.scores]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _result_schema(query_type, vector_type) -> StructType:
    return StructType(
        [StructField("query_id", query_type), StructField("id", vector_type)]
    ).add("similarity", "double")


def _arrow(query_type, vector_type) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema(
        [("query_id", to_arrow_type(query_type)), ("id", to_arrow_type(vector_type)), ("similarity", pa.float64())]
    )


def _sides(queries: DataFrame, vectors: DataFrame, id_column: str, vector_column: str) -> list[DataFrame]:
    """(id, vector) of both inputs, without missing vectors."""
    usable = F.col(vector_column).isNotNull() & (F.size(vector_column) > 0)
    return [df.filter(usable).select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector")) for df in (queries, vectors)]


def _ranked(best: DataFrame, k: int) -> DataFrame:
    ranked = top_k_per_key(best, ["query_id"], k, [F.desc("similarity"), F.asc("id")])
    return ranked.select("query_id", "rank", "id", "similarity")


def nearest_names_exact(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    other_id_only: bool = False,
) -> DataFrame:
    """(query_id, rank, id, similarity): the `k` most similar vectors of every query.

    A counted small set of queries goes to every task and the vectors are read in place. A larger set
    is compared block by block: both inputs are cut into blocks and each pair of blocks is one task.
    `other_id_only` leaves out the vector with the query's own id.
    """
    wanted, known = _sides(queries, vectors, id_column, vector_column)
    size = wanted.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("width")).first()
    if size["rows"] * (size["width"] or 0) > MAX_BROADCAST_VALUES:
        return _by_blocks(wanted.withColumn("cell", F.lit(0)), known.withColumn("cell", F.lit(0)), k, other_id_only)
    schema = _result_schema(wanted.schema["id"].dataType, known.schema["id"].dataType)
    arrow = _arrow(schema["query_id"].dataType, schema["id"].dataType)
    table = wanted.toArrow()  # at most MAX_BROADCAST_VALUES numbers
    query_ids = table["id"].to_numpy()
    matrix = _matrix(table["vector"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(query_ids, matrix, k, other_id_only)
        if len(query_ids):
            for batch in batches:
                if batch.num_rows:
                    best.add(batch["id"].to_numpy(zero_copy_only=False), _matrix(batch["vector"]))
        yield best.batch(arrow)

    return _ranked(known.mapInArrow(search, schema), k)


def _by_blocks(queries: DataFrame, vectors: DataFrame, k: int, other_id_only: bool) -> DataFrame:
    """Compare (cell, id, vector) rows of the same cell, a block of queries with a block of vectors at a time."""
    schema = _result_schema(queries.schema["id"].dataType, vectors.schema["id"].dataType)
    arrow = _arrow(schema["query_id"].dataType, schema["id"].dataType)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return arrow.empty_table()
        best = _Best(left["id"].to_numpy(), _matrix(left["vector"]), k, other_id_only)
        for start in range(0, right.num_rows, SLICE):
            part = right.slice(start, SLICE)
            best.add(part["id"].to_numpy(), _matrix(part["vector"]))
        return pa.Table.from_batches([best.batch(arrow)])

    unlimited = 1 << 30
    left, right = spread(
        [
            Side(queries, ("id",), rows_per_part=QUERY_BLOCK, max_parts=unlimited),
            Side(vectors, ("id",), rows_per_part=VECTOR_BLOCK, max_parts=unlimited),
        ],
        "cell",
    )
    grid = left.groupBy("cell", CELL).cogroup(right.groupBy("cell", CELL))
    return _ranked(grid.applyInArrow(compare, schema), k)


def nearest_names_in_cells(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    cell_column: str = "cell",
    other_id_only: bool = False,
) -> DataFrame:
    """As `nearest_names_exact`, among the vectors that share a given cell with the query.

    A query may occur once per cell it looks into. A crowded cell is compared in blocks.
    """
    usable = F.col(vector_column).isNotNull() & (F.size(vector_column) > 0)
    sides = [
        df.filter(usable).select(
            F.col(cell_column).alias("cell"), F.col(id_column).alias("id"), F.col(vector_column).alias("vector")
        )
        for df in (queries, vectors)
    ]
    return _by_blocks(*sides, k, other_id_only)


def cell_centres(vectors: DataFrame, cells: int, vector_column: str = "embedding", seed: int = 1) -> np.ndarray:
    """Centres of `cells` groups of vectors, placed by k-means on all unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    rows = vectors.filter(F.size(vector_column) > 0)
    features = rows.select(array_to_vector(F.col(vector_column).cast("array<double>")).alias("raw"))
    unit = Normalizer(inputCol="raw", outputCol="features").transform(features)
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(unit)
    return np.array(model.clusterCenters())


def nearest_cells(vector_column: str, centres: np.ndarray, probes: int) -> Column:
    """The `probes` cells whose centre is nearest to the vector."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def assign(vectors):
        if len(vectors) == 0:
            return vectors
        matrix = _matrix(pa.array(vectors))
        distance = (centres**2).sum(axis=1)[None, :] - 2 * matrix @ centres.T
        import pandas as pd

        return pd.Series(list(np.argsort(distance, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return assign(F.col(vector_column))


def nearest_names_approx(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    cells: int = 16,
    probes: int = 4,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    other_id_only: bool = False,
    seed: int = 1,
) -> DataFrame:
    """Approximate `nearest_names_exact`: each query looks only into its `probes` nearest k-means cells.

    Measure the loss with `retrieval_recall_at_k` and the work with `candidate_share`.
    """
    left, right = assign_cells(queries, vectors, cells, probes, vector_column, seed)
    return nearest_names_in_cells(left, right, k, id_column, vector_column, "cell", other_id_only)


def assign_cells(
    queries: DataFrame, vectors: DataFrame, cells: int, probes: int, vector_column: str = "embedding", seed: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Queries once per probed cell, and vectors once, each with a `cell` column."""
    centres = cell_centres(vectors, cells, vector_column, seed)
    usable = F.size(vector_column) > 0
    left = queries.filter(usable).withColumn("cell", F.explode(nearest_cells(vector_column, centres, probes)))
    right = vectors.filter(usable).withColumn("cell", nearest_cells(vector_column, centres, 1)[0])
    return left, cut_lineage(right)


def candidate_share(queries: DataFrame, vectors: DataFrame, cell_column: str = "cell") -> DataFrame:
    """(candidates, possible, share): vectors looked at over all query-vector pairs, from counts per cell.

    `possible` counts every row of `queries` with every row of `vectors`.
    """
    asked = queries.groupBy(cell_column).agg(F.count(F.lit(1)).alias("asked"))
    held = vectors.groupBy(cell_column).agg(F.count(F.lit(1)).alias("held"))
    cells = asked.join(held, cell_column, "full").na.fill(0, ["asked", "held"])
    totals = cells.agg(
        F.sum(F.col("asked") * F.col("held")).alias("candidates"), (F.sum("asked") * F.sum("held")).alias("possible")
    )
    return totals.withColumn("share", F.col("candidates") / F.col("possible"))
