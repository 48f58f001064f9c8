"""Packing of documents into sequences: best fit, then swap-based local search between underfull bins.

Documents become pieces of at most `size` tokens. Full pieces are sequences of their own. The others are dealt into
shards of about `SHARD` pieces; each shard is packed by best fit and improved by local search: in rounds, every underfull
bin takes the best of a move and of exchanges of one for one, two for one and one for two documents with another one
that raises the sum of the squared fills, until bins empty and no packing can have fewer, or a round brings next to
nothing. The search is no proof of the fewest; `Bins.fewest` is a bound. The pieces of bins that stay underfull go on to a next round, packed with those of
other shards, as long as their number falls by half, so that the rest is not one bin for each shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch.llm.batches import bounded, by_value
from casewatch.llm.tokens import END, encoder
from casewatch.plans.lineage import cut_lineage

by_value(__name__)

SIZE = 4096
# Pieces packed together by one task.
SHARD = 8_192
# A bin with a larger share of free tokens goes on to the next round.
LOOSE = 1 / 64
# The search ends when a round raises the sum of squared fills by no more than this share.
LEAST_GAIN = 1e-6
# Pairs of documents of a bin that are listed as offers of a round, nearest in length first (about 150 MB), and how far
# apart in length order two documents that a bin gives for one may lie.
MOST_PAIRS = 2_000_000
NEAR = 8
# Offers looked at together, from the best one down.
STEP = 512
# Texts, and bytes of text, that are encoded together.
TEXTS, TEXT_BYTES = 256, 1 << 21
_PIECE = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """One row for each piece of each document: (`key`, piece, start, length, ids_crc32).

    A document is its ids by the tokenizer file and the end id; a null or empty text is the end id alone.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(n, k) for n, k in _PIECE]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        for part in bounded(batches, text, TEXTS, TEXT_BYTES):
            rows: list[tuple] = []
            owner: list[int] = []
            for i, ids in enumerate(ids_of.encode(part.column(text).to_pylist())):
                ids = np.append(ids.astype("<u4"), np.uint32(END))
                for n, start in enumerate(range(0, len(ids), size)):
                    cut = ids[start : start + size]
                    owner.append(i)
                    rows.append((n, start, len(cut), zlib.crc32(cut.tobytes())))
            n, start, length, crc = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(key).take(pa.array(owner)), pa.array(n, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[key, *(n for n, _ in _PIECE)],
            )

    return docs.select(key, text).mapInArrow(run, schema)


class Bins:
    """A packing of `lengths`: the bin of each item and the fill of each bin."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.lengths, self.size = lengths.astype(np.int64), size
        self.bin = np.full(len(lengths), -1, np.int64)
        self.fill = np.zeros(0, np.int64)

    def best_fit(self) -> None:
        """Every item, longest first, goes to the fullest bin that has room."""
        by_free: list[list[int]] = [[] for _ in range(self.size + 1)]
        mask, fill = 0, []  # bit f: some bin has f tokens free
        for i in np.argsort(-self.lengths, kind="stable").tolist():
            need = int(self.lengths[i])
            fits = mask >> need
            if fits:
                free = need + (fits & -fits).bit_length() - 1
                b = by_free[free].pop()
                if not by_free[free]:
                    mask ^= 1 << free
            else:
                free, b = self.size, len(fill)
                fill.append(0)
            fill[b] += need
            self.bin[i] = b
            if left := free - need:
                by_free[left].append(b)
                mask |= 1 << left
        self.fill = np.array(fill, np.int64)

    def fewest(self) -> int:
        """A number of bins that no packing can go below: by the total, and by the items of over half a bin with what
        cannot lie beside them, for every least length counted."""
        lengths, size = np.sort(self.lengths), self.size
        sums = np.r_[0, np.cumsum(lengths)]
        half = int(np.searchsorted(lengths, size // 2, side="right"))
        least = np.r_[0, np.unique(lengths[:half])]
        alone = np.searchsorted(lengths, size - least, side="right")
        beside = np.maximum(alone - half, 0)
        room = beside * size - (sums[np.maximum(alone, half)] - sums[half])
        small = sums[half] - sums[np.searchsorted(lengths, least)]
        more = np.maximum(0, -(-(small - room) // size))
        return int((len(lengths) - half + more).max())

    def improve(self) -> None:
        """Local search: rounds of exchanges, each of which increases the sum of squared fills, until no packing can have
        fewer bins or a round brings next to nothing."""
        fewest, before = self.fewest(), -1.0
        while int((self.fill > 0).sum()) > fewest:
            squares = float((self.fill.astype(np.float64) ** 2).sum())
            if squares <= before * (1 + LEAST_GAIN):
                return
            before = squares
            self._round(fewest)

    def _offers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """Items of underfull bins by bin and length, at most two of each length in a bin, with their bins' bounds, and
        what a bin can give: (length, bin, item, item or -1), ascending, for single items and for pairs."""
        open_ = (self.fill > 0) & (self.fill < self.size)
        items = np.flatnonzero(open_[self.bin])
        items = items[np.lexsort((self.lengths[items], self.bin[items]))]
        bins, lengths = self.bin[items], self.lengths[items]
        third = np.zeros(len(items), bool)
        third[2:] = (bins[2:] == bins[:-2]) & (lengths[2:] == lengths[:-2])
        items = items[~third]
        bins, lengths = self.bin[items], self.lengths[items]
        bounds = np.searchsorted(bins, np.arange(len(self.fill) + 1))
        order = np.argsort(lengths, kind="stable")
        singles = (lengths[order], bins[order], items[order], np.full(len(items), -1))
        firsts, seconds, count = [], [], 0
        for lag in range(1, int(np.diff(bounds).max(initial=1))):
            first = np.flatnonzero(bins[:-lag] == bins[lag:])
            if count + len(first) > MOST_PAIRS:
                break
            firsts.append(first)
            seconds.append(first + lag)
            count += len(first)
        first, second = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts, seconds))
        sums = lengths[first] + lengths[second]
        order = np.argsort(sums, kind="stable")
        return items, lengths, bounds, singles, (sums[order], bins[first[order]], items[first[order]], items[second[order]])

    def _round(self, fewest: int) -> None:
        """The fullest bins first: each takes the best of a move, an exchange of one for one, one for two or two for one
        with another underfull bin. A bin takes part once in a round, as what it can give is listed at its start."""
        items, lengths, bounds, singles, pairs = self._offers()
        free_to = np.ones(len(self.fill), bool)
        kept = int((self.fill > 0).sum())
        for a in np.argsort(-self.fill, kind="stable").tolist():
            if not 0 < self.fill[a] < self.size or not free_to[a]:
                continue
            own = items[bounds[a] : bounds[a + 1]].tolist()
            gives: list[tuple[int, list[int]]] = [(0, [])]
            seen: set[int] = set()
            for n, one in enumerate(own):
                length = int(self.lengths[one])
                if length not in seen:
                    seen.add(length)
                    gives.append((length, [one]))
            found: tuple[int, list[int], list[int], int] | None = None
            for given, which in gives:
                for offers in (singles, pairs) if which else (singles,):
                    found = self._best(offers, a, given, which, free_to, found)
            doubles: dict[int, list[int]] = {}
            for n in range(1, len(own)):
                for m in range(max(0, n - NEAR), n):
                    doubles.setdefault(int(self.lengths[own[n]] + self.lengths[own[m]]), [own[m], own[n]])
            for given, which in doubles.items():
                found = self._best(singles, a, given, which, free_to, found)
            if found is None:
                continue
            gain, given_items, taken, b = found
            self._shift(given_items, taken, a, b)
            free_to[[a, b]] = False
            if not self.fill[b]:
                kept -= 1
                if kept <= fewest:
                    return

    def _best(self, offers, a: int, given: int, which: list[int], free_to: np.ndarray, found):
        """The exchange that fills bin `a` most for `given` tokens of its items `which`, where better than `found`."""
        lengths, bins, first, second = offers
        fill, room = int(self.fill[a]), self.size - int(self.fill[a]) + given
        stop = int(np.searchsorted(lengths, room, "right"))
        least = given + (found[0] if found else 0)
        while stop > 0 and lengths[stop - 1] > least:
            start = max(0, stop - STEP)
            gain = lengths[start:stop] - given
            theirs = bins[start:stop]
            # More than the other bin is fuller: only then do the squares grow.
            good = free_to[theirs] & (theirs != a) & (gain > self.fill[theirs] - fill) & (lengths[start:stop] > least)
            hits = np.flatnonzero(good)
            if len(hits):
                at = start + int(hits[-1])
                taken = [int(first[at])] + ([int(second[at])] if second[at] >= 0 else [])
                return int(lengths[at]) - given, which, taken, int(bins[at])
            stop = start
        return found

    def _shift(self, given: list[int], taken: list[int], here: int, there: int) -> None:
        gain = int(self.lengths[given].sum() - self.lengths[taken].sum())
        self.bin[given], self.bin[taken] = there, here
        self.fill[there] += gain
        self.fill[here] -= gain


def pack(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each item its bin, its place there and the fill of that bin."""
    bins = Bins(lengths, size)
    bins.best_fit()
    bins.improve()
    order = np.argsort(bins.bin, kind="stable")
    ends = np.cumsum(bins.lengths[order])
    starts = ends - bins.lengths[order]
    first = np.flatnonzero(np.r_[True, np.diff(bins.bin[order]) != 0]) if len(order) else np.empty(0, np.int64)
    offset = np.empty(len(order), np.int64)
    offset[order] = starts - np.repeat(starts[first], np.diff(np.r_[first, len(order)]))
    return bins.bin, offset, bins.fill[bins.bin]


def _packing(size: int, level: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        at, offset, fill = pack(rows.column("length").to_numpy(), size)
        kept = rows.select([n for n in rows.column_names if n not in ("shard", "sequence_id", "offset", "loose")])
        number = (np.int64(level) << 56) + (np.int64(key[0].as_py()) << 20) + at
        return (
            kept.append_column("sequence_id", pa.array(number))
            .append_column("offset", pa.array(offset))
            .append_column("loose", pa.array(size - fill > size * LOOSE))
        )

    return run


def pack_pieces(rows: DataFrame, size: int = SIZE, shard: int | None = None) -> DataFrame:
    """`rows` (with `length` from 1 to `size`) and their place: sequence_id long, offset long, gapless from 0.

    Any other columns stay. Equal rows are packed one by one. No rows give none.
    """
    shard = SHARD if shard is None else shard
    taken = [n for n in ("sequence_id", "offset", "loose", "shard", "row") if n in rows.columns]
    rows = cut_lineage(rows.drop(*taken).withColumn("row", F.monotonically_increasing_id()), "pieces")
    fields = [f for f in rows.schema.fields]
    schema = T.StructType(
        [*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("loose", T.BooleanType())]
    )
    full = rows.where(F.col("length") == size)
    done = [full.withColumn("sequence_id", F.col("row") + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))]
    left, level, before = rows.where(F.col("length") < size), 0, None
    while True:
        count = left.count()
        shards = -(-count // shard)
        number = F.pmod(F.xxhash64(F.lit(level), "row"), F.lit(max(shards, 1)))
        packed = left.select("*", number.alias("shard")).groupBy("shard").applyInArrow(_packing(size, level), schema)
        if shards <= 1 or (before is not None and 2 * count > before):
            done.append(packed.drop("loose"))
            break
        packed = cut_lineage(packed, "packed")
        done.append(packed.where("NOT loose").drop("loose"))
        left, before, level = packed.where("loose").select(*rows.columns), count, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("row")


def pack_documents(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE, shard: int | None = None
) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most `size` tokens, as few as the search finds."""
    return pack_pieces(pieces(docs, tokenizer, key, text, size), size, shard)
