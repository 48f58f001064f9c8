"""A stored index of vectors for approximate nearest names.

Unit vectors are put into coarse cells, and what they differ by from the centre of their cell is stored as one byte for
each of a few parts (the nearest of up to 256 typical values of that part). A search compares its queries with those
bytes in the cells nearest to them and then ranks the best candidates by their whole vectors. Cells and typical values
are learnt once from a bounded sample; every vector is indexed, and later searches read what was written.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch.operators.answers import retrieval_recall_at_k
from casewatch.operators.vectors import DIGITS, QUERY_BLOCK, VECTOR_BLOCK, _matrix, _sides, nearest_names_exact
from casewatch.plans.ranking import top_k_per_key
from casewatch.plans.sizing import broadcast_if_small
from casewatch.plans.skew import CELL, Side, spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Vectors that cells and codes are learnt from, those of the smallest id hashes.
SAMPLE = 20_000
ROUNDS = 12
# Similarities of queries with the codes of a block that are held at a time (16 MB as doubles).
STEP = 2_000_000


def _nearest(rows: np.ndarray, centres: np.ndarray, count: int = 1) -> np.ndarray:
    """The `count` nearest centres of every row, nearest first."""
    distance = (centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T
    return np.argsort(distance, axis=1, kind="stable")[:, :count]


def _groups(rows: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of at most `count` groups of the rows, by k-means; groups that become empty keep their centre."""
    centres = np.unique(rows[rng.permutation(len(rows))[:count]], axis=0)
    for _ in range(ROUNDS):
        mine = _nearest(rows, centres)[:, 0]
        sizes = np.bincount(mine, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Codebook:
    """Centres of the cells, and for each part of a vector its typical differences from them."""

    centres: np.ndarray
    parts: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.parts[0].shape[1]

    def split(self, rows: np.ndarray) -> list[np.ndarray]:
        padded = np.pad(rows, ((0, 0), (0, self.width * len(self.parts) - rows.shape[1])))
        return np.split(padded, len(self.parts), axis=1)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell, and one byte for each part, of unit rows."""
        cell = _nearest(rows, self.centres)[:, 0]
        left = self.split(rows - self.centres[cell])
        return cell, np.stack([_nearest(x, book)[:, 0] for x, book in zip(left, self.parts)], axis=1).astype(np.uint8)

    def similarities(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate similarity of each query with each of a cell's codes."""
        found = np.repeat((queries @ self.centres[cell])[:, None], len(codes), axis=1)
        for part, book, code in zip(self.split(queries), self.parts, codes.T):
            found += (part @ book.T)[:, code]
        return found


def learn_codebook(vectors: DataFrame, cells: int, parts: int, id_column: str, vector_column: str, seed: int = 1) -> Codebook | None:
    """A codebook from at most `SAMPLE` vectors; None where there is none."""
    _, known = _sides(vectors, vectors, id_column, vector_column)
    sample = known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
    rows = _matrix(sample["vector"])
    if not len(rows):
        return None
    rng = np.random.default_rng(seed)
    centres = _groups(rows, cells, rng)
    left = rows - centres[_nearest(rows, centres)[:, 0]]
    left = np.pad(left, ((0, 0), (0, -left.shape[1] % parts)))
    return Codebook(centres, [_groups(x, min(256, max(1, len(rows) // 2)), rng) for x in np.split(left, parts, axis=1)])


def _encoding(book: Codebook):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, codes = book.encode(_matrix(batch["vector"]))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))])
                columns = [pa.array(cell.astype(np.int32)), batch["id"], packed.cast(pa.binary()), batch["vector"]]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "id", "codes", "vector"])

    return run


def write_index(
    vectors: DataFrame, folder: str, cells: int = 16, parts: int = 16, id_column: str = "vec_id", vector_column: str = "embedding"
) -> None:
    """Learn a codebook and write it with the codes of all vectors, sorted by cell.

    Null and empty vectors are left out. All vectors must have the same length. An empty table gives an empty index.
    """
    spark = vectors.sparkSession
    _, known = _sides(vectors, vectors, id_column, vector_column)
    book = learn_codebook(vectors, cells, parts, id_column, vector_column)
    rows = [] if book is None else [(-1, n, c.tolist()) for n, c in enumerate(book.centres)]
    rows += [] if book is None else [(p, n, c.tolist()) for p, values in enumerate(book.parts) for n, c in enumerate(values)]
    spark.createDataFrame(rows, "part int, number int, value array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/codebook")
    fields = [T.StructField("cell", T.IntegerType()), known.schema["id"], T.StructField("codes", T.BinaryType()), known.schema["vector"]]
    if book is None:
        coded = spark.createDataFrame([], T.StructType(fields))
    else:
        coded = known.mapInArrow(_encoding(book), T.StructType(fields))
    laid = coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
    laid.write.mode("overwrite").parquet(f"{folder}/vectors")


@dataclass(frozen=True)
class Index:
    book: Codebook | None
    vectors: DataFrame


def read_index(spark: SparkSession, folder: str) -> Index:
    """A written index; nothing is learnt again. The codebook has at most cells + 256 * parts rows."""
    rows = spark.read.parquet(f"{folder}/codebook").orderBy("part", "number").collect()
    values: dict[int, list] = {}
    for row in rows:
        values.setdefault(row["part"], []).append(row["value"])
    arrays = [np.array(values[part]) for part in sorted(values)]
    return Index(Codebook(arrays[0], arrays[1:]) if arrays else None, spark.read.parquet(f"{folder}/vectors"))


def _probing(book: Codebook, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = _nearest(_matrix(batch["vector"]), book.centres, probes)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
                columns = [pa.array(cells.ravel().astype(np.int32)), batch["id"].take(rows), batch["vector"].take(rows)]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "id", "vector"])

    return run


def _comparing(book: Codebook, count: int, other_id_only: bool):
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """The `count` best codes of a block for each query of a block, all of one cell."""
        asked, ids = left["id"].combine_chunks(), right["id"].combine_chunks()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(asked) and len(ids):
            queries, cell = _matrix(left["vector"]), left["cell"][0].as_py()
            codes = np.frombuffer(b"".join(right["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
            names, own = ids.to_numpy(zero_copy_only=False), asked.to_numpy(zero_copy_only=False)
            step = max(1, STEP // len(codes))
            for start in range(0, len(queries), step):
                scores = book.similarities(queries[start : start + step], cell, codes)
                if other_id_only:
                    scores[own[start : start + step, None] == names[None, :]] = -np.inf
                best = np.argpartition(-scores, min(count, scores.shape[1]) - 1, axis=1)[:, :count]
                rows = np.repeat(np.arange(len(best)), best.shape[1])
                values = scores[rows, best.ravel()]
                keep = values > -np.inf
                found.append((rows[keep] + start, best.ravel()[keep], values[keep]))
        rows, best, values = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table([asked.take(pa.array(rows)), ids.take(pa.array(best)), pa.array(values)], names=["query_id", "id", "score"])

    return compare


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            value = np.round((_matrix(batch["asked"]) * _matrix(batch["vector"])).sum(axis=1), DIGITS)
            yield pa.RecordBatch.from_arrays([batch["query_id"], batch["id"], pa.array(value)], names=["query_id", "id", "similarity"])


def candidates(
    index: Index,
    queries: DataFrame,
    probes: int,
    rerank: int,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    other_id_only: bool = False,
) -> DataFrame:
    """(query_id, id): the `rerank` stored vectors whose codes are most similar to each query, of its `probes` cells.

    Queries and codes of a cell are compared block by block; a crowded cell and a cell that many queries look into are
    cut into a grid of blocks.
    """
    wanted, _ = _sides(queries, queries, id_column, vector_column)
    kinds = [T.StructField("query_id", wanted.schema["id"].dataType), T.StructField("id", index.vectors.schema["id"].dataType)]
    if index.book is None:
        return queries.sparkSession.createDataFrame([], T.StructType(kinds))
    schema = T.StructType([T.StructField("cell", T.IntegerType()), wanted.schema["id"], wanted.schema["vector"]])
    looking = wanted.mapInArrow(_probing(index.book, probes), schema)
    unlimited = 1 << 30
    left, right = spread(
        [
            Side(looking, ("id",), rows_per_part=QUERY_BLOCK, max_parts=unlimited),
            Side(index.vectors.select("cell", "id", "codes"), ("id",), rows_per_part=VECTOR_BLOCK, max_parts=unlimited),
        ],
        "cell",
    )
    grid = left.groupBy("cell", CELL).cogroup(right.groupBy("cell", CELL))
    scored = grid.applyInArrow(_comparing(index.book, rerank, other_id_only), T.StructType([*kinds, T.StructField("score", T.DoubleType())]))
    return top_k_per_key(scored, ["query_id"], rerank, [F.desc("score"), F.asc("id")]).select("query_id", "id")


def search_index(
    index: Index,
    queries: DataFrame,
    k: int = 10,
    probes: int = 16,
    rerank: int = 100,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    other_id_only: bool = False,
) -> DataFrame:
    """(query_id, rank, id, similarity): as `nearest_names_exact`, of the `rerank` candidates of each query.

    Only candidates' vectors are read whole. Measure the loss with `index_recall`.
    """
    wanted, _ = _sides(queries, queries, id_column, vector_column)
    near = candidates(index, queries, probes, rerank, id_column, vector_column, other_id_only)
    pairs = near.join(index.vectors.select("id", "vector"), "id")
    asked = broadcast_if_small(wanted.select(F.col("id").alias("query_id"), F.col("vector").alias("asked")))
    schema = T.StructType([*near.schema.fields, T.StructField("similarity", T.DoubleType())])
    ranked = top_k_per_key(
        pairs.join(asked, "query_id").select("query_id", "id", "asked", "vector").mapInArrow(_exact, schema),
        ["query_id"],
        k,
        [F.desc("similarity"), F.asc("id")],
    )
    return ranked.select("query_id", "rank", "id", "similarity")


def index_recall(
    index: Index,
    queries: DataFrame,
    k: int = 10,
    probes: int = 16,
    rerank: int = 100,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    other_id_only: bool = False,
) -> DataFrame:
    """(query_count, recall, read_share): the share of the exact neighbours that a search finds, and of all pairs of a
    query and a stored vector those that it compares whole. The exact search compares all, so give a sample of queries."""
    known = index.vectors.select(F.col("id").alias(id_column), F.col("vector").alias(vector_column))
    exact = nearest_names_exact(queries, known, k, id_column, vector_column, other_id_only)
    found = search_index(index, queries, k, probes, rerank, id_column, vector_column, other_id_only)
    read = candidates(index, queries, probes, rerank, id_column, vector_column, other_id_only).count()
    return retrieval_recall_at_k(found, exact).agg(
        F.count(F.lit(1)).alias("query_count"),
        (F.sum("found_count") / F.sum("expected_count")).alias("recall"),
        F.try_divide(F.lit(read), F.count(F.lit(1)) * F.lit(index.vectors.count())).alias("read_share"),
    )
