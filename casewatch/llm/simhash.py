"""Near-duplicates by SimHash fingerprints, found through tables of distances to pivot fingerprints.

A fingerprint has 64 bits; two of them link when at most `max_bits` bits differ. The Hamming distances of every
fingerprint to many fixed reference fingerprints (pivots) are computed beforehand. By the triangle inequality two
fingerprints that differ in d bits have distances to any pivot that differ by at most d, so a pair whose largest
coordinate difference exceeds `max_bits` is discarded without looking at it; the survivors are verified.

What is compared at all is dealt out by agreeing segments: of `SEGMENTS` segments at most `max_bits` can differ, so
any two linked fingerprints agree on the other segments and meet in the block of one choice of them. Nothing is lost
and no block is capped: a block with more than `TILE` fingerprints is dealt out again as a grid of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from casewatch.llm.batches import by_value, fresh, raw_texts, slices
from casewatch.llm.components import components, unite
from casewatch.plans.lineage import cut_lineage

by_value(__name__)

SEGMENTS = 6
# Reference fingerprints; their values do not matter for the result.
PIVOTS = 16
# Fingerprints of one block that one task compares; larger blocks become tiles.
TILE = 16_384
# Rows and pairs held at a time inside a task.
ROWS = 131_072
PAIRS = 1 << 20
SEED = 42


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The SimHash of a text as an unsigned number.

    Words are runs of bytes other than white space, A-Z lower-cased. A text of fewer than `words` words is one
    shingle; one without words, empty or null has fingerprint zero.
    """
    found = text.lower().split() if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: 1 - words].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, dtype="<u8")
    for start in range(0, len(values), 32_768):
        part = values[start : start + 32_768].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", words: int = 4) -> DataFrame:
    """`docs` with its fingerprint (a signed long of the same 64 bits) in column `name`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.array([fingerprint(t, words) for t in raw_texts(part.column(text))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.view(np.int64))], names=[*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same everywhere."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, count, dtype=np.uint64)


def distances(values: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The table of Hamming distances, one row for each reference."""
    return np.stack([np.bitwise_count(values ^ p) for p in references]).astype(np.int16)


def segment_masks(max_bits: int, segments: int = SEGMENTS) -> list[int]:
    """Bit masks of the segments that may agree: one for each choice of `segments - max_bits` segments."""
    segments = max(segments, max_bits + 1)
    if segments > 64:
        raise ValueError("max_bits must be below 64")
    edges = [round(64 * i / segments) for i in range(segments + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(single, segments - max_bits)]


def linked_pairs(
    block: np.ndarray, values: np.ndarray, max_bits: int, references: np.ndarray, side: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked fingerprints of the same block, some at a time; with `side`, only of unequal sides.

    Rows are put in order of block and first pivot distance, so that partners are a window behind each row; the
    other coordinates discard, and the bits verify.
    """
    table = distances(values, references)
    order = np.lexsort((table[0], block))
    table, ranked = table[:, order], values[order]
    rank = np.cumsum(np.r_[0, np.diff(block[order]) != 0]).astype(np.int64)
    place = rank * 128 + table[0]
    until = np.searchsorted(place, place + max_bits, side="right")
    width = until - np.arange(len(place)) - 1
    total = np.cumsum(width)
    start = 0
    while start < len(place):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
        many = width[start:stop]
        i = np.repeat(np.arange(start, stop), many)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        if side is not None:
            near = side[order[i]] != side[order[j]]
            i, j = i[near], j[near]
        for row in table[1:]:
            if not len(i):
                break
            near = np.abs(row[i] - row[j]) <= max_bits
            i, j = i[near], j[near]
        near = np.bitwise_count(ranked[i] ^ ranked[j]) <= max_bits
        if near.any():
            yield order[i[near]], order[j[near]]
        start = stop


def _forest(values: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A few links that join the same fingerprints as all the pairs do: every one to the first of its set."""
    parent = np.arange(len(values))
    for i, j in pairs:
        unite(parent, i, j)
    member = np.flatnonzero(parent != np.arange(len(values)))
    return values[parent[member]].view(np.int64), values[member].view(np.int64)


_FOUND = T.StructType(
    [T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("block", T.StringType())]
)


def _found(a: np.ndarray, b: np.ndarray, block: list | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), pa.array(block if block is not None else [None] * len(a), pa.string())],
        names=["a", "b", "block"],
    )


def _blocks(max_bits: int, tile: int):
    """Links inside sorted blocks; the rows of a block of more than `tile` rows are given back with its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = pivots()
        held: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))
        over: tuple | None = None

        def emit(choice, key, value):
            if len(value):
                first = np.flatnonzero(np.r_[True, (np.diff(choice) != 0) | (np.diff(key) != 0)])
                block = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(value)]))
                bits = value.view(np.uint64)
                yield _found(*_forest(bits, linked_pairs(block, bits, max_bits, references)))

        def give(choice, key, value):
            if len(value):
                yield _found(value, value, [f"{c}:{k}" for c, k in zip(choice.tolist(), key.tolist())])

        for part in slices(batches, ROWS):
            new = tuple(part.column(n).to_numpy() for n in ("choice", "block", "value"))
            if over is not None:  # the block that was too large goes on
                same = (new[0] == over[0]) & (new[1] == over[1])
                yield from give(*(x[same] for x in new))
                if same.all():
                    continue
                new, over = tuple(x[~same] for x in new), None
            held = tuple(np.concatenate(x) for x in zip(held, new))
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            large = _large(held, tile)
            yield from give(*(x[large] for x in held))
            if large[-1]:
                over = (held[0][-1], held[1][-1])
            yield from emit(*(x[~last & ~large] for x in held))
            held = tuple(x[last & ~large] for x in held)
        yield from emit(*held)

    return run


def _large(rows: tuple, tile: int) -> np.ndarray:
    """Which rows belong to a block of more than `tile` rows; blocks lie together."""
    first = np.flatnonzero(np.r_[True, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)])
    size = np.diff(np.r_[first, len(rows[0])])
    return np.repeat(size > tile, size)


def _tiles(max_bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        value = table.column("value").to_numpy().view(np.uint64)
        side = table.column("chunk").to_numpy()
        within = key[1].as_py() == key[2].as_py()
        pairs = linked_pairs(np.zeros(len(value), np.int8), value, max_bits, pivots(), None if within else side)
        return pa.Table.from_batches([_found(*_forest(value, pairs))])

    return run


def links(fingerprints: DataFrame, max_bits: int = 4, tile: int | None = None) -> DataFrame:
    """Links (a, b) that join the distinct longs of `fingerprints.fingerprint` exactly as all pairs of at most
    `max_bits` differing bits do. Written once to the shared folder."""
    tile = TILE if tile is None else tile
    parts = [m - (1 << 64) if m >= 1 << 63 else m for m in segment_masks(max_bits)]
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(parts)])
    rows = (
        fingerprints.select(F.col("fingerprint").alias("value"), F.explode(choices).alias("c"))
        .select(F.col("c.choice").alias("choice"), F.col("value").bitwiseAND(F.col("c.mask")).alias("block"), "value")
        .repartition("choice", "block")
        .sortWithinPartitions("choice", "block")
    )
    found = cut_lineage(rows.mapInArrow(_blocks(max_bits, tile), _FOUND), "links")
    large = found.where("block IS NOT NULL").select("block", F.col("a").alias("value"))
    sizes = large.groupBy("block").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks"))
    dealt = (
        large.join(sizes, "block")
        .withColumn("chunk", F.pmod(F.xxhash64("value"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("block", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "value")
    )
    tiles = dealt.groupBy("block", "i", "j").applyInArrow(_tiles(max_bits), _FOUND)
    return found.where("block IS NULL").union(tiles).select("a", "b").distinct()


def fingerprint_groups(docs: DataFrame, key: str = "doc_id", max_bits: int = 4) -> DataFrame:
    """(fingerprint, root, keep_id): the group of every distinct fingerprint of `docs` (`key`, `fingerprint`).

    `root` is the smallest linked fingerprint, `keep_id` the smallest key of all the group (null if all are).
    """
    each = cut_lineage(docs.groupBy("fingerprint").agg(F.min(key).alias("least")), "fingerprints")
    reached = components(links(each, max_bits)).select(F.col("node").alias("fingerprint"), "root")
    grouped = each.join(reached, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least")
    least = grouped.groupBy("root").agg(F.min("least").alias("keep_id"))
    return grouped.select("fingerprint", "root").join(least, "root")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """One row for each row of `docs`: (`key`, fingerprint long, component_id: smallest key reachable over links).

    Null, empty and wordless texts share fingerprint zero. A null key is ignored when the smallest key is sought;
    repeated rows give repeated result rows. No rows give none.
    """
    rows = with_fingerprints(docs.select(F.col(key), F.col(text)), text, words=words).select(key, "fingerprint")
    rows = cut_lineage(rows, "fingerprints")
    groups = fingerprint_groups(rows, key, max_bits)
    return rows.join(groups, "fingerprint").select(key, "fingerprint", F.col("keep_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """`docs` with one row of each group: the one of the smallest key (a null key only where the group has no other;
    of rows with that same key the smallest fingerprint, then text hash). All columns stay as they are."""
    own, theirs, keep, place = fresh(docs.columns, "fingerprint", "kept_fingerprint", "keep", "place")
    rows = cut_lineage(with_fingerprints(docs, text, own, words), "documents")
    narrow = rows.select(F.col(key).alias("doc_id"), F.col(own).alias("fingerprint"))
    groups = fingerprint_groups(narrow, "doc_id", max_bits)
    mine = narrow.join(groups, "fingerprint").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = mine.groupBy("root").agg(F.min("fingerprint").alias(own), F.first("keep_id").alias(keep)).select(own, keep)
    same = Window.partitionBy(own).orderBy(F.xxhash64(text))
    kept = kept.withColumnRenamed(own, theirs)
    left = rows.join(kept, (F.col(own) == F.col(theirs)) & F.col(key).eqNullSafe(F.col(keep)))
    return left.withColumn(place, F.row_number().over(same)).where(F.col(place) == 1).select(*docs.columns)
