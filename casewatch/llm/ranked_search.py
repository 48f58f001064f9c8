"""Ranked lexical search over a length-stratified index.

A document's normaliser m depends on its length. Documents are range partitioned and sorted by m and cut into blocks;
in a block the documents of equal m are a stratum. A term's postings in a block lie by stratum and, within it, from the
highest tf down, so that the first of them bounds what the term adds to any score of the stratum. An impact is computed
once for each tf of a stratum. For every item the strata are visited from the highest bound down, until the bound is
below the k-th best score found.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch.llm.batches import by_value, raw_texts, slices
from casewatch.plans.lineage import cut_lineage, delete_written
from casewatch.plans.ranking import dense_ids
from casewatch.plans.sizing import broadcast_if_small

by_value(__name__)

# Terms (with repeats) of one partition of the index; postings of one block (a longer document is a block by itself).
PART_TERMS = 2_000_000
BLOCK_POSTINGS = 1_000_000
# Items that are scored together.
ITEMS = 1_024
# Rows of the index in one Arrow batch.
ROWS = 20_000
_SEQUENCE_BITS = 20

# Terms are digits, letters A-Z, lower-cased, and all characters beyond ASCII.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Index:
    """Written blocks with the number of documents that have terms and of all their terms.

    A row of `blocks` holds either a block's documents (`ids`, `lengths`: normalisers, ascending) or one term's postings
    in it (`places` in the list of documents, `tfs`), by normaliser and then from the highest tf down.
    """

    blocks: DataFrame
    documents: int
    terms: int


def terms_of(text: Column) -> Column:
    """Terms of a text in order, in the JVM."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(PATTERN), F.lit(0))


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, n, terms joined by blanks, tfs); documents without terms give no row."""
    for part in slices(batches):
        taken, totals, names, tfs, ends = [], [], [], [], [0]
        for row, text in enumerate(raw_texts(part.column("text"))):
            counted = Counter(text.translate(_TERMS).split()) if text else None
            if counted:
                taken.append(row)
                names.append(b" ".join(counted))
                tfs.append(np.fromiter(counted.values(), np.int32, len(counted)))
                totals.append(int(tfs[-1].sum(dtype=np.int64)))
                ends.append(ends[-1] + len(counted))
        if taken:
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tfs)))
            arrays = [part.column("key").take(pa.array(taken)), pa.array(totals, pa.int64()), pa.array(names, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "n", "terms", "tfs"])


def _schema(kind: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("term", T.BinaryType()),
            T.StructField("places", T.ArrayType(T.IntegerType())),
            T.StructField("tfs", T.ArrayType(T.IntegerType())),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("lengths", T.ArrayType(T.LongType())),
        ]
    )


def _blocking(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents (key, m, terms, tfs), ascending by m, to blocks."""
        task, sequence = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        keys: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        terms: list[np.ndarray] = []
        tfs: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, sequence
            if not terms:
                return
            if sequence >> _SEQUENCE_BITS:
                raise ValueError("too many blocks in a partition of the index")
            block = task << _SEQUENCE_BITS | sequence
            ids, m = pa.concat_arrays(keys), np.array(lengths, np.int64)
            term, tf = np.concatenate(terms), np.concatenate(tfs)
            place = np.repeat(np.arange(len(m), dtype=np.int32), [len(t) for t in terms])
            _, stratum = np.unique(m, return_inverse=True)
            order = np.lexsort((-tf, stratum[place], term))
            tf, place = tf[order], place[order]
            ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(number)))])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block]),
                    pa.array([None], pa.binary()),
                    pa.array([None], pa.list_(pa.int32())),
                    pa.array([None], pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([m], pa.list_(pa.int64())),
                ],
                names=["block", "term", "places", "tfs", "ids", "lengths"],
            )
            names = list(number)
            for start in range(0, len(names), ROWS):
                mine = ends[start : start + ROWS + 1]
                size, cut = len(mine) - 1, pa.array((mine - mine[0]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size, block)),
                        pa.array(names[start : start + size], pa.binary()),
                        pa.ListArray.from_arrays(cut, pa.array(place[mine[0] : mine[-1]])),
                        pa.ListArray.from_arrays(cut, pa.array(tf[mine[0] : mine[-1]])),
                        pa.nulls(size, pa.list_(ids.type)),
                        pa.nulls(size, pa.list_(pa.int64())),
                    ],
                    names=["block", "term", "places", "tfs", "ids", "lengths"],
                )
            sequence += 1
            held = 0
            number = defaultdict()
            number.default_factory = number.__len__
            keys.clear(), lengths.clear(), terms.clear(), tfs.clear()

        for part in slices(batches):
            counts, at = part.column("tfs"), 0
            flat = counts.flatten().to_numpy()
            for row, (m, names) in enumerate(zip(part.column("m").to_pylist(), part.column("terms").to_pylist())):
                split = names.split(b" ")
                if held and held + len(split) > limit:
                    yield from flush()
                keys.append(part.column("key").slice(row, 1))
                lengths.append(m)
                terms.append(np.fromiter(map(number.__getitem__, split), np.int64, len(split)))
                tfs.append(flat[at : at + len(split)])
                at += len(split)
                held += len(split)
        yield from flush()

    return run


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", block_postings: int | None = None) -> Index:
    """The index of all rows of `docs` that hold a term; null texts hold none. Every row is a document, equal ones too."""
    limit = BLOCK_POSTINGS if block_postings is None else block_postings
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType
    counted = T.StructType(
        [
            T.StructField("key", kind),
            T.StructField("n", T.LongType()),
            T.StructField("terms", T.BinaryType()),
            T.StructField("tfs", T.ArrayType(T.IntegerType())),
        ]
    )
    each = cut_lineage(rows.mapInArrow(_counting, counted), "term_counts")
    documents, terms = each.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.lit(100 - 50).cast("long") + F.call_function("div", F.lit(50).cast("long") * F.col("n") * documents, F.lit(max(terms, 1)))
    parts = max(1, -(-terms // PART_TERMS))
    laid = each.withColumn("m", m).drop("n").repartitionByRange(parts, "m", "key").sortWithinPartitions("m", "key")
    blocks = cut_lineage(laid.mapInArrow(_blocking(limit), _schema(kind)), "index")
    delete_written(each)
    return Index(blocks, documents, terms)


class Block:
    """One block's postings of asked terms: row r has those from cuts[r] to cuts[r + 1]."""

    def __init__(self, lengths: np.ndarray, cuts: np.ndarray, places: np.ndarray, tfs: np.ndarray, weights: np.ndarray):
        m, stratum = np.unique(lengths, return_inverse=True)
        self.sizes = np.bincount(stratum, minlength=len(m))
        mine = stratum[places]
        # One impact for each tf of a stratum.
        kinds, which = np.unique(mine.astype(np.int64) << 32 | tfs, return_inverse=True)
        tf = kinds & 0xFFFFFFFF
        impacts = (1_000_000_000 * tf) // (1_000 * tf + 20 * m[kinds >> 32])
        rows = np.repeat(np.arange(len(weights)), np.diff(cuts))
        self.places, self.values = places, weights[rows] * impacts[which]
        # A term's postings within a stratum; the first has the highest tf.
        starts = np.ones(len(places), bool)
        starts[1:] = (rows[1:] != rows[:-1]) | (mine[1:] != mine[:-1])
        self.first = np.flatnonzero(starts)
        self.many = np.diff(np.append(self.first, len(places)))
        self.stratum, self.most = mine[self.first], self.values[self.first]
        self.rows = np.searchsorted(rows[self.first], np.arange(len(weights) + 1))
        self.documents = len(lengths)

    def best(self, rows: np.ndarray, k: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores above 0 of the k best documents for the terms of `rows`, and the strata visited; ties go to
        the place with the smaller number in `order`."""
        runs = _ranges(self.rows[rows], self.rows[rows + 1] - self.rows[rows])
        bounds = np.zeros(len(self.sizes), np.int64)
        np.add.at(bounds, self.stratum[runs], self.most[runs])
        visits = np.argsort(-bounds, kind="stable")
        visits = visits[bounds[visits] > 0]
        falling = -bounds[visits]
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done, least, wanted = 0, 1, 2 * k
        while done < len(visits):
            # Strata that can still hold one of the best; as many as hold `wanted` documents, twice as many each time.
            able = int(np.searchsorted(falling, -least, "right"))
            if able <= done:
                break
            ahead = np.cumsum(self.sizes[visits[done:able]])
            stop = done + min(int(np.searchsorted(ahead, wanted)) + 1, able - done)
            chosen = np.zeros(len(self.sizes), bool)
            chosen[visits[done:stop]] = True
            mine = runs[chosen[self.stratum[runs]]]
            postings = _ranges(self.first[mine], self.many[mine])
            sums = np.zeros(self.documents, np.int64)
            np.add.at(sums, self.places[postings], self.values[postings])
            more = np.flatnonzero(sums >= least)
            found, scores = np.concatenate([found, more]), np.concatenate([scores, sums[more]])
            ahead = np.lexsort((order[found], -scores))[:k]
            found, scores = found[ahead], scores[ahead]
            done, wanted = stop, 2 * wanted
            if len(found) == k:
                least = int(scores[-1])
        return found, scores, done


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _scoring(k: int):
    def run(group: pa.Table) -> pa.Table:
        """The rows of a block for some items to their k best of its documents."""
        group = group.combine_chunks()
        of_documents = pc.is_valid(group.column("ids"))
        head, rest = group.filter(of_documents), group.filter(pc.invert(of_documents))
        ids = head.column("ids").combine_chunks().flatten()
        lengths = head.column("lengths").combine_chunks().flatten().to_numpy()
        order = np.empty(len(ids), np.int64)
        order[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        places, items = rest.column("places").combine_chunks(), rest.column("items").combine_chunks()
        cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(places).to_numpy())]).astype(np.int64)
        weights = rest.column("weight").to_numpy()
        block = Block(lengths, cuts, places.flatten().to_numpy(), rest.column("tfs").combine_chunks().flatten().to_numpy(), weights)
        asked = items.flatten().to_numpy()
        rows = np.repeat(np.arange(len(weights)), pc.list_value_length(items).to_numpy())
        sort = np.argsort(asked, kind="stable")
        asked, rows = asked[sort], rows[sort]
        firsts = np.flatnonzero(np.concatenate([[True], asked[1:] != asked[:-1]])) if len(asked) else []
        numbers, found, scores = [], [], []
        for start, stop in zip(firsts, [*firsts[1:], len(asked)]):
            mine, points, _ = block.best(rows[start:stop], k, order)
            numbers.append(np.full(len(mine), asked[start]))
            found.append(mine)
            scores.append(points)
        whole = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (numbers, found, scores)]
        return pa.table([pa.array(whole[0], pa.int64()), ids.take(pa.array(whole[1], pa.int64())), pa.array(whole[2], pa.int64())], names=["number", "key", "score"])

    return run


def search(
    index: Index, items: DataFrame, k: int = 50, item: str = "item_id", text: str = "text", key: str = "doc_id", block_items: int | None = None
) -> DataFrame:
    """(`item`, rank int from 1, `key`, score long) of the k best documents of each item, with scores above 0.

    Each of an item's terms counts once; rows of the same item (null too) make one item together. Items without terms,
    or whose terms no document holds, give no rows. Equal scores go by ascending key, null last, and each row of a
    repeated document has its own rank. Items are taken in blocks of `block_items`, blocks of documents in any order.
    """
    size = ITEMS if block_items is None else block_items
    kind = index.blocks.schema["ids"].dataType.elementType
    said = items.select(F.col(item).alias("item"), F.explode(F.array_distinct(terms_of(F.col(text)))).alias("term"))
    gathered = said.groupBy("item").agg(F.collect_set("term").alias("terms"))
    numbered = cut_lineage(dense_ids(gathered, "item", "number"), "items")
    asked = numbered.select("number", F.explode("terms").alias("term")).withColumn("term", F.encode("term", "UTF-8"))
    wanted = broadcast_if_small(asked.select("term").distinct())
    matched = index.blocks.where("term IS NOT NULL").join(wanted, "term", "left_semi")
    held = matched.groupBy("term").agg(F.sum(F.size("places").cast("long")).alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1)))
    parts = asked.withColumn("part", F.floor(F.col("number") / size))
    lists = parts.groupBy("term", "part").agg(F.collect_list("number").alias("items"))
    lists = cut_lineage(lists.join(held.withColumn("weight", weight.cast("long")), "term").where("weight > 0").drop("df"), "queries")
    postings = index.blocks.where("term IS NOT NULL").join(broadcast_if_small(lists), "term")
    columns = ["block", "part", "weight", "items", "places", "tfs", "ids", "lengths"]
    heads = index.blocks.where("ids IS NOT NULL").withColumns(
        {
            "part": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(numbered.count() // size).cast("long"))),
            "weight": F.lit(None).cast("long"),
            "items": F.lit(None).cast("array<long>"),
        }
    )
    together = postings.select(*columns).union(heads.select(*columns))
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("key", kind), T.StructField("score", T.LongType())])
    found = together.groupBy("block", "part").applyInArrow(_scoring(k), schema)
    best = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = ranked.join(broadcast_if_small(numbered.select("number", "item")), "number")
    return named.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """`search` of all items in a new index of all documents."""
    return search(build_index(docs), items, k)
