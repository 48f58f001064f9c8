"""Sets of cases as stored bitmaps: counting cases and pairs of drugs without joining on the case.

Cases are numbered. A chunk is a run of 32,768 numbers; for every name (of a drug, a reaction) and chunk there is one
set of the cases that have it: a bitmap, or where that is shorter the list of their places, two bytes each. Sets are made
by one sort, merged by OR when cases arrive, and counted by their bits. A pair of drugs is the AND of two bitmaps, chunk by chunk; every chunk is one unit of work of bounded size.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch.functions.columns import name_key
from casewatch.operators.counts import all_drugs, reactions
from casewatch.plans.lineage import cut_lineage
from casewatch.plans.ranking import dense_ids
from casewatch.plans.sizing import broadcast_if_small, dealt
from casewatch.schemas import CASE

# Executors need not have this package: what runs in tasks travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cases of a chunk, and bytes of its bitmap, as Spark's bitmap functions have them (fixed values).
CHUNK, BYTES = 32_768, 4_096
# Whole-number keys are used as case numbers where they leave no more than this many gaps for each row.
MOST_GAPS = 8
# Cases in a chunk from which a set is compared as a bitmap, below as a list of places.
DENSE = 1_024
# Joined (drug, drug, reaction) places counted at a time in a task, and bitmaps unpacked at a time.
BLOCK = 2_000_000
UNPACKED = 1_024
# Tasks that the chunks are dealt to; beyond that a task has several chunks.
MOST_TASKS = 100_000

DRUG, REACTION = "drug", "reaction"
# Rows of a chunk, in the order in which a task needs them.
_DRUG, _REACTION, _PAIR = 0, 1, 2


def case_numbers(*tables: DataFrame, case: str = CASE) -> DataFrame | None:
    """(case, number) for all cases of the tables; None where the keys themselves are dense whole numbers."""
    keys = tables[0].select(case)
    for table in tables[1:]:
        keys = keys.unionByName(table.select(case))
    if isinstance(keys.schema[case].dataType, T.IntegralType):
        least, most, rows = keys.agg(F.min(case), F.max(case), F.count(case)).first()
        if rows == 0 or (least >= 0 and most <= MOST_GAPS * rows):
            return None
    return dense_ids(keys.where(F.col(case).isNotNull()).distinct(), case, "number").select(case, "number")


def case_sets(rows: DataFrame, by: list[str], numbers: DataFrame | None = None, case: str = CASE) -> DataFrame:
    """(*by, chunk, cases) of (case, *by) rows; a case counts once in a set, rows without case not at all.

    `numbers` is the outcome of `case_numbers`, the same for all sets that are to be compared.
    """
    numbered = rows.withColumn("number", F.col(case)) if numbers is None else rows.join(numbers, case)
    numbered = numbered.where(F.col("number").isNotNull()).withColumn("number", F.col("number").cast("bigint"))
    chunk, place = F.bitmap_bucket_number("number"), F.bitmap_bit_position("number").cast("int")
    placed = numbered.select(*by, chunk.alias("chunk"), place.alias("_place"))
    # Most comparisons of the sort are settled by the hash of a set's names.
    order = [F.xxhash64(*by, "chunk"), *by, "chunk", "_place"]
    sorted_rows = dealt(placed, rows.count(), *by, "chunk").sortWithinPartitions(*order)
    schema = T.StructType([*placed.schema.fields[:-1], T.StructField("cases", T.BinaryType())])
    return sorted_rows.mapInArrow(lambda batches: _by_set(batches, _packed), schema)


def drug_and_reaction_sets(drug: DataFrame, reac: DataFrame) -> DataFrame:
    """(kind, name, chunk, cases): the sets of all drugs (in any role, by `name_key`) and of all reactions, not yet
    written. Both come from one aggregation."""
    drugs, effects = all_drugs(drug), reactions(reac)
    numbers = case_numbers(drugs, effects)
    if numbers is not None:
        numbers = cut_lineage(numbers, "numbers")
    both = drugs.select(CASE, F.lit(DRUG).alias("kind"), F.col("drug").alias("name"))
    both = both.union(effects.select(CASE, F.lit(REACTION).alias("kind"), F.col("side_effect").alias("name")))
    return case_sets(both, ["kind", "name"], numbers)


def drug_sets(sets: DataFrame) -> DataFrame:
    return sets.where(F.col("kind") == DRUG).select(F.col("name").alias("drug"), "chunk", "cases")


def reaction_sets(sets: DataFrame) -> DataFrame:
    return sets.where(F.col("kind") == REACTION).select(F.col("name").alias("side_effect"), "chunk", "cases")


def merge_sets(sets: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables of sets as one: cases that are in both count once."""
    names = [c for c in sets.columns if c != "cases"]
    both = sets.unionByName(more).select(*names, "cases")
    return both.repartition(*names).sortWithinPartitions(*names).mapInArrow(lambda batches: _by_set(batches, _merged), both.schema)


def set_sizes(sets: DataFrame, count: str = "case_count") -> DataFrame:
    """(name, `count`): distinct cases of every set, without moving any of them."""
    names = [c for c in sets.columns if c not in ("chunk", "cases")]
    size = F.when(F.length("cases") < BYTES, (F.length("cases") / 2).cast("bigint")).otherwise(F.bitmap_count("cases"))
    return sets.groupBy(*names).agg(F.sum(size).alias(count))


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether a row has other keys than the one before it; NULL is a key."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for key in keys:
        one, other = batch[key].slice(1), batch[key].slice(0, max(batch.num_rows - 1, 0))
        unlike = pa.compute.fill_null(pa.compute.not_equal(one, other), True).to_numpy(zero_copy_only=False)
        new[1:] |= unlike & ~pa.compute.and_(one.is_null(), other.is_null()).to_numpy(zero_copy_only=False)
    return new


def _by_set(batches: Iterator[pa.RecordBatch], work: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, whole sets at a time, through `work`, which gives one row for each set. The last column has the
    cases; only the rows of one set are held from batch to batch."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        new = _changes(batch, batch.schema.names[:-1])
        if batch.schema.names[-1] == "_place":
            places = batch["_place"].to_numpy()
            keep = new.copy()
            keep[1:] |= places[1:] != places[:-1]
            batch, new = batch.filter(pa.array(keep)), new[keep]
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield work(batch.slice(0, last), new[:last])
        held = batch.slice(last)
    if held is not None:
        yield work(held, np.arange(held.num_rows) == 0)


def _stored(places: np.ndarray) -> bytes:
    """Different places of a set, in order, in the shorter form."""
    if 2 * len(places) < BYTES:
        return places.astype("<u2").tobytes()
    bits = np.zeros(CHUNK, np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _packed(batch: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
    """Different places of sets to one row for each set."""
    starts, places = np.flatnonzero(new), batch["_place"].to_numpy()
    counts = np.diff(np.append(starts, len(places)))
    ends = np.cumsum(2 * np.minimum(counts, BYTES // 2))
    if (2 * counts < BYTES).all():
        stored = places.astype("<u2").tobytes()
    else:
        stored = b"".join(_stored(places[a : a + n]) for a, n in zip(starts.tolist(), counts.tolist()))
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    cases = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(stored)])
    names = batch.schema.names[:-1]
    at = pa.array(starts)
    return pa.RecordBatch.from_arrays([*[batch[c].take(at) for c in names], cases], names=[*names, "cases"])


def _merged(batch: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
    """Sets, equal names and chunks one after another, to one set for each."""
    starts, cases = np.flatnonzero(new).tolist(), batch["cases"].to_pylist()
    one = [cases[a] if b == a + 1 else _stored(np.unique(_members(cases[a:b])[1])) for a, b in zip(starts, [*starts[1:], len(cases)])]
    names, at = batch.schema.names[:-1], pa.array(starts)
    return pa.RecordBatch.from_arrays([*[batch[c].take(at) for c in names], pa.array(one, pa.binary())], names=[*names, "cases"])


def _members(cases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every case of stored sets, by row and place."""
    sizes = np.array([len(c) for c in cases], np.int64)
    few, many = np.flatnonzero(sizes < BYTES), np.flatnonzero(sizes == BYTES)
    row, place = np.repeat(few, sizes[few] // 2), np.frombuffer(b"".join([cases[i] for i in few]), "<u2").astype(np.int64)
    if len(many):
        dense, at = _places(np.frombuffer(b"".join([cases[i] for i in many]), np.uint8).reshape(-1, BYTES))
        row, place = np.concatenate([row, many[dense]]), np.concatenate([place, at])
        order = np.argsort(row, kind="stable")
        row, place = row[order], place[order]
    return row, place


def _places(bitmaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every bit, by row and place."""
    rows, places = [], []
    for start in range(0, len(bitmaps), UNPACKED):
        part = bitmaps[start : start + UNPACKED]
        row, byte = np.nonzero(part)
        which, bit = np.nonzero(np.unpackbits(part[row, byte][:, None], axis=1, bitorder="little"))
        rows.append(row[which] + start)
        places.append(byte[which] * 8 + bit)
    return (np.concatenate(rows), np.concatenate(places)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Members:
    """Numbered sets over the places of a chunk: by set, by place, and as bitmaps where they are large."""

    def __init__(self, cases: list[bytes]):
        self.count = len(cases)
        self.row, self.place = _members(cases)
        self.by_row = np.searchsorted(self.row, np.arange(self.count + 1))
        order = np.argsort(self.place, kind="stable")
        self.at_place = self.row[order]
        self.by_place = np.searchsorted(self.place[order], np.arange(CHUNK + 1))
        self.dense = np.diff(self.by_row) >= DENSE
        self.large = np.flatnonzero(self.dense)
        bits = np.zeros((len(self.large), BYTES), np.uint8)
        for n, row in enumerate(self.large):
            own = np.zeros(CHUNK, np.uint8)
            own[self.of(row)] = 1
            bits[n] = np.packbits(own, bitorder="little")
        self.words = bits.view(np.uint64)

    def of(self, row: int) -> np.ndarray:
        return self.place[self.by_row[row] : self.by_row[row + 1]]

    def few(self) -> Members:
        """The sets that are not large, under the same numbers."""
        rest = object.__new__(Members)
        keep = ~self.dense[self.at_place]
        rest.at_place = self.at_place[keep]
        rest.by_place = np.concatenate([[0], np.cumsum(keep)])[self.by_place]
        return rest

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into `places` and set, for every set at each place."""
        starts, sizes = self.by_place[places], self.by_place[places + 1] - self.by_place[places]
        ends = np.cumsum(sizes)
        index = np.repeat(np.arange(len(places)), sizes)
        return index, self.at_place[np.arange(len(index)) + np.repeat(starts - (ends - sizes), sizes)]


# First drug, second drug and cases of each pair, the end of its reactions, and reactions with their cases.
Counts = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


class Chunk:
    """All drugs and reactions of one chunk."""

    def __init__(self, drugs: list[bytes], effects: list[bytes]):
        self.drugs, self.effects = Members(drugs), Members(effects)
        self.few = self.effects.few()

    def all_pairs(self) -> Counts:
        """Counts of every pair of drugs that share a case, the smaller number first."""
        large = self.drugs.large
        for n, first in enumerate(large):
            together = self.drugs.words[n] & self.drugs.words[n + 1 :]
            for second, bits in zip(large[n + 1 :], together):
                yield from self._both(first, second, bits)
        yield from self._small()

    def asked(self, pairs: list[tuple[int, int]]) -> Counts:
        """Counts of given pairs; a drug with itself has its own cases."""
        large = {int(row): n for n, row in enumerate(self.drugs.large)}
        for first, second in pairs:
            if first in large and second in large:
                yield from self._both(first, second, self.drugs.words[large[first]] & self.drugs.words[large[second]])
            else:
                places = np.intersect1d(self.drugs.of(first), self.drugs.of(second), assume_unique=True)
                if len(places):
                    _, effects = self.effects.gather(places)
                    found, counts = np.unique(effects, return_counts=True)
                    yield from self._pair(first, second, found, counts, len(places))

    def _both(self, first: int, second: int, bits: np.ndarray) -> Counts:
        """One pair by its bitmap: large reactions by AND, the others by the places left."""
        total = int(np.bitwise_count(bits).sum())
        if not total:
            return
        large = np.bitwise_count(self.effects.words & bits).sum(axis=1, dtype=np.int64)
        hit = np.flatnonzero(large)
        _, effects = self.few.gather(np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")))
        found, counts = np.unique(effects, return_counts=True)
        yield from self._pair(
            first, second, np.concatenate([self.effects.large[hit], found]), np.concatenate([large[hit], counts]), total
        )

    def _pair(self, first: int, second: int, effects: np.ndarray, counts: np.ndarray, total: int) -> Counts:
        yield np.array([first]), np.array([second]), np.array([total]), np.array([len(effects)]), effects, counts

    def _small(self) -> Counts:
        """Pairs with a drug that is not large, by the places of their cases."""
        drugs = self.drugs
        row, place = drugs.row, drugs.place
        others = drugs.by_place[place + 1] - drugs.by_place[place]
        work = others * (1 + self.effects.by_place[place + 1] - self.effects.by_place[place])
        small = np.flatnonzero(~drugs.dense[row])
        ends, start = np.cumsum(work[small]), 0
        while start < len(small):
            done = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, done + BLOCK, "right")), start + 1)
            if stop < len(small):
                # Not within a drug, unless it alone is more than a block.
                cut = int(np.searchsorted(row[small], row[small[stop]]))
                stop = cut if cut > start else stop
            mine = small[start:stop]
            index, other = drugs.gather(place[mine])
            one, at = row[mine][index], place[mine][index]
            keep = (other > one) | (drugs.dense[other] & (other != one))
            one, other, at = one[keep], other[keep], at[keep]
            first, second = np.minimum(one, other), np.maximum(one, other)
            order = np.lexsort((second, first))
            first, second, at = first[order], second[order], at[order]
            new = np.ones(len(order), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            heads, pair = np.flatnonzero(new), np.cumsum(new) - 1
            which, effect = self.effects.gather(at)
            key, counts = np.unique(pair[which] * np.int64(self.effects.count) + effect, return_counts=True)
            sizes = np.bincount(key // max(self.effects.count, 1), minlength=len(heads))
            if len(heads):
                totals = np.diff(np.append(heads, len(order)))
                yield first[heads], second[heads], totals, np.cumsum(sizes), key % max(self.effects.count, 1), counts
            start = stop


def _counting(batches: Iterator[pa.RecordBatch], given: bool) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, kind, name, other, number, cases), by chunk and kind, to (drug1, drug2, cases, effects, counts), a
    row for each pair of a chunk; for the `given` pairs or for all. Reactions go by their `number`."""
    chunk: int | None = None
    names: dict[int, list] = {}
    sets: dict[int, list[bytes]] = {}
    others: list = []
    numbers: list[int] = []

    def named(held: list[tuple], drugs: pa.Array, effects: np.ndarray) -> pa.RecordBatch:
        first, second, total, _, effect, count = (np.concatenate(column) for column in zip(*held))
        shift = np.cumsum([0, *[len(part[4]) for part in held]])
        ends = pa.array(np.concatenate([[0], *[part[3] + at for part, at in zip(held, shift)]]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [
                drugs.take(pa.array(first)),
                drugs.take(pa.array(second)),
                pa.array(total.astype(np.int64)),
                pa.ListArray.from_arrays(ends, pa.array(effects[effect])),
                pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32))),
            ],
            names=["drug1", "drug2", "cases", "effects", "counts"],
        )

    def flush() -> Iterator[pa.RecordBatch]:
        drugs, effects = pa.array(names.get(_DRUG, []), pa.string()), np.array(numbers, np.int32)
        work = Chunk(sets.get(_DRUG, []), sets.get(_REACTION, []))
        if given:
            number = {name: n for n, name in enumerate(names.get(_DRUG, []))}
            counts = work.asked([(number[a], number[b]) for a, b in zip(names.get(_PAIR, []), others)])
        else:
            counts = work.all_pairs()
        held: list[tuple] = []
        size = 0
        for part in counts:
            held.append(part)
            size += len(part[4]) + len(part[0])
            if size > 200_000:
                yield named(held, drugs, effects)
                held, size = [], 0
        if held:
            yield named(held, drugs, effects)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("chunk", "kind", "name", "other", "number", "cases"))
        for mine, kind, name, other, number, cases in zip(*columns):
            if mine != chunk:
                if names:
                    yield from flush()
                chunk, names, sets, others, numbers = mine, {}, {}, [], []
            names.setdefault(kind, []).append(name)
            if kind == _PAIR:
                others.append(other)
            else:
                sets.setdefault(kind, []).append(cases)
                if kind == _REACTION:
                    numbers.append(number)
    if names:
        yield from flush()


def _adding(batches: Iterator[pa.RecordBatch], k: int | None, min_cases: int) -> Iterator[pa.RecordBatch]:
    """Rows of `_counting`, equal pairs one after another, to the `k` best reactions of each pair with enough cases:
    (drug1, drug2, rank, number, n). Only one pair's sums are held."""
    pair: tuple[str, str] | None = None
    cases, sums = 0, np.zeros(0, np.int64)
    out: list[tuple[str, str, np.ndarray, np.ndarray]] = []
    size = 0

    def close() -> int:
        if pair is None or cases < min_cases:
            return 0
        effects = np.flatnonzero(sums)
        best = np.lexsort((effects, -sums[effects]))[:k]
        out.append((*pair, effects[best], sums[effects][best]))
        return len(best)

    def made() -> pa.RecordBatch:
        sizes = [len(o[2]) for o in out]
        rows = np.repeat(np.arange(len(out)), sizes)
        first, second = (pa.array([o[n] for o in out], pa.string()).take(pa.array(rows)) for n in (0, 1))
        ranks = np.concatenate([np.arange(1, n + 1) for n in sizes])
        arrays = [first, second, *[pa.array(x.astype(np.int64)) for x in (ranks, *[np.concatenate([o[n] for o in out]) for n in (2, 3)])]]
        return pa.RecordBatch.from_arrays(arrays, names=["drug1", "drug2", "rank", "number", "n"])

    for batch in batches:
        effects, counts = batch.column("effects"), batch.column("counts")
        numbers, added = effects.flatten().to_numpy(), counts.flatten().to_numpy()
        ends = np.cumsum(pa.compute.list_value_length(effects).to_numpy())
        start = 0
        for first, second, total, end in zip(*(batch.column(c).to_pylist() for c in ("drug1", "drug2", "cases")), ends.tolist()):
            if (first, second) != pair:
                size += close()
                if size > 50_000:
                    yield made()
                    out.clear()
                    size = 0
                pair, cases = (first, second), 0
                sums[:] = 0
            cases += total
            mine = numbers[start:end]
            if len(mine) and (most := int(mine.max())) >= len(sums):
                sums = np.concatenate([sums, np.zeros(most + 1 - len(sums), np.int64)])
            sums[mine] += added[start:end]
            start = end
    close()
    if out:
        yield made()


def _row(kind: int, name: str, **columns: Column) -> list[Column]:
    types = {"other": "string", "number": "int", "cases": "binary"}
    rest = [columns.get(c, F.lit(None)).cast(kind_of).alias(c) for c, kind_of in types.items()]
    return [F.col("chunk"), F.lit(kind).alias("kind"), F.col(name).alias("name"), *rest]


def pair_interactions_from_sets(
    sets: DataFrame, k: int | None = 10, min_cases: int = 1, pairs: DataFrame | None = None
) -> DataFrame:
    """(drug1, drug2, rank, shared_side_effect, shared_report_count) as the pair reports give, from stored sets (see
    `drug_and_reaction_sets`).

    All pairs drug1 < drug2 with at least `min_cases` cases, or the pairs of a request table, named as `name_key`.
    Bitmaps are shuffled by chunk: chunks are alike in size whatever cases, drugs or reactions are frequent. What comes
    of a chunk is one row for each pair, and the rows of a pair are added up where they meet.
    """
    drugs, reacs = drug_sets(sets), reaction_sets(sets)
    names = reacs.select("side_effect").where("side_effect IS NOT NULL").distinct()
    numbered = cut_lineage(dense_ids(names, "side_effect", "number").select("side_effect", F.col("number").cast("int").alias("number")), "effects")
    # The nameless reaction is the last, as in the reports.
    last = numbered.count()
    bits, known = F.col("cases"), broadcast_if_small(numbered)
    effects = reacs.join(known, "side_effect", "left").withColumn("number", F.coalesce("number", F.lit(last)))
    rows = drugs.select(*_row(_DRUG, "drug", cases=bits))
    rows = rows.union(effects.select(*_row(_REACTION, "side_effect", cases=bits, number=F.col("number"))))
    given = pairs is not None
    if given:
        asked = pairs.select(name_key("drug1").alias("drug1"), name_key("drug2").alias("drug2"))
        held = drugs.select("chunk", "drug")
        first = held.withColumnRenamed("drug", "drug1").join(broadcast_if_small(asked.distinct()), "drug1")
        both = first.join(held.withColumnRenamed("drug", "drug2"), ["chunk", "drug2"])
        rows = rows.union(both.select(*_row(_PAIR, "drug1", other=F.col("drug2"))))
    # A chunk is little data but much work: one task for each, as far as their number goes.
    tasks = min(max(sets.select("chunk").distinct().count(), 1), MOST_TASKS)
    by_chunk = rows.repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind", "name")
    each = by_chunk.mapInArrow(
        lambda batches: _counting(batches, given), "drug1 string, drug2 string, cases bigint, effects array<int>, counts array<int>"
    )
    # A chunk has about as many bytes of pairs as any other.
    many = tasks > int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = each.repartition(*([tasks] if many else []), "drug1", "drug2").sortWithinPartitions("drug1", "drug2")
    best = met.mapInArrow(lambda batches: _adding(batches, k, min_cases), "drug1 string, drug2 string, rank bigint, number bigint, n bigint")
    named = best.join(known, "number", "left")
    return named.select("drug1", "drug2", "rank", F.col("side_effect").alias("shared_side_effect"), F.col("n").alias("shared_report_count"))
