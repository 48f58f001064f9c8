"""How far the sources of a language differ in their words, by chunk factorisation.

Texts are cut at blanks into chunks, counted for each document. A block of documents gives each of its chunks once, with
the documents that hold it. All blocks' rows of a chunk meet and the chunk is tokenised once for all of them; its terms
take the rows over. Rows of a term then meet in sets of blocks, where a document that holds the term in several chunks
counts once. All later numbers are integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewatch.llm.batches import by_value, raw_texts, slices
from casewatch.plans.lineage import cut_lineage
from casewatch.plans.ranking import dense_ids
from casewatch.plans.sizing import broadcast_if_small

by_value(__name__)

# Documents and (document, chunk) pairs of one block; documents are numbered in 15 bits.
BLOCK_DOCS = 1 << 15
BLOCK_PAIRS = 3_000_000
# Tasks whose blocks' rows of a term meet: 2 ** this.
TASK_BITS = 6
_SEQUENCE_BITS = 20
# Rows, and bytes of payload, of one Arrow batch; rows merged at a time.
ROWS, BYTES = 20_000, 1 << 24
MERGED = 100_000
SCALE = 1_000_000_000

# Terms are letters A-Z, lower-cased, and all characters beyond ASCII.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_TOP, _LOW = 0x8000, 0x7FFF


def terms_of(chunk: bytes) -> list[bytes]:
    return chunk.translate(_TERMS).split()


def _sized(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows in batches of bounded rows and bytes, a larger row alone."""
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = min(max(int(np.searchsorted(ends, done + BYTES, "right")), start + 1), start + ROWS)
        yield batch.slice(start, stop - start)
        start = stop


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


def _payloads(chunk: np.ndarray, doc: np.ndarray, count: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit words for each chunk 0, 1, ...: for each group with the chunk two words that name it (the first with its
    top bit set), then a document and a count for each document; counts beyond 15 bits take several pairs. `group` is
    that of each document and must ascend. Also the end of each chunk's words."""
    order = np.argsort(chunk.astype(np.int64) << 15 | doc)
    chunk, doc, count = chunk[order], doc[order], count[order]
    times = (count - 1) // _LOW + 1
    if times.max(initial=1) > 1:
        last = np.cumsum(times) - 1
        left = count - (times - 1) * _LOW
        chunk, doc = np.repeat(chunk, times), np.repeat(doc, times)
        count = np.full(len(chunk), _LOW, np.int64)
        count[last] = left
    mine = group[doc]
    starts = np.ones(len(chunk), bool)
    starts[1:] = (chunk[1:] != chunk[:-1]) | (mine[1:] != mine[:-1])
    place = 2 * np.arange(len(chunk)) + 2 * np.cumsum(starts)
    words = np.empty(2 * len(chunk) + 2 * int(starts.sum()), "<u2")
    words[place], words[place + 1] = doc, count
    words[place[starts] - 2], words[place[starts] - 1] = _TOP | mine[starts] >> 15, mine[starts] & _LOW
    last = np.ones(len(chunk), bool)
    last[:-1] = chunk[1:] != chunk[:-1]
    return words, place[last] + 2


def _pairs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, group, document and count of each pair, of payloads of `sizes` words one after another."""
    top = words >= _TOP
    named = np.flatnonzero(top)
    low = np.zeros(len(words), bool)
    low[named + 1] = True
    group = (words[named].astype(np.int64) & _LOW) << 15 | words[named + 1]
    rest = np.flatnonzero(~(top | low))
    at = rest[::2]
    row = np.repeat(np.arange(len(sizes)), sizes)[at]
    return row, group[np.cumsum(top)[at] - 1], words[at].astype(np.int64), words[rest[1::2]].astype(np.int64)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents (`group`, `text`) to one row for each chunk of a block."""
    task, sequence = TaskContext.get().partitionId(), 0
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    groups: list[int] = []
    chunks: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number, held, sequence
        if not groups:
            return
        order = np.argsort(np.array(groups, np.int64), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(place, [len(c) for c in chunks])
        words, ends = _payloads(np.concatenate(chunks), doc, np.concatenate(counts), np.array(groups, np.int64)[order])
        names = list(number)
        if sequence >> _SEQUENCE_BITS:
            raise ValueError("too many blocks in a task: use more partitions")
        block = np.full(len(names), task << _SEQUENCE_BITS | sequence, np.int64)
        whole = np.concatenate([[0], ends])
        for start in range(0, len(names), ROWS):
            mine = whole[start : start + ROWS + 1]
            size = len(mine) - 1
            part = pa.RecordBatch.from_arrays(
                [
                    pa.array(names[start : start + ROWS], pa.binary()),
                    pa.array(block[start : start + size]),
                    _binary(words[mine[0] : mine[-1]], 2 * (mine[1:] - mine[0])),
                ],
                names=["chunk", "block", "held"],
            )
            yield from _sized(part, 2 * np.diff(mine) + [len(n) for n in names[start : start + ROWS]])
        sequence += 1
        held = 0
        number = defaultdict()
        number.default_factory = number.__len__
        groups.clear(), chunks.clear(), counts.clear()

    for part in slices(batches):
        for group, text in zip(part.column("group").to_pylist(), raw_texts(part.column("text"))):
            counted = Counter(text.split()) if text else None
            if not counted:
                continue
            groups.append(group)
            chunks.append(np.fromiter(map(number.__getitem__, counted), np.int64, len(counted)))
            counts.append(np.fromiter(counted.values(), np.int64, len(counted)))
            held += len(counted)
            if held >= BLOCK_PAIRS or len(groups) == BLOCK_DOCS:
                yield from flush()
    yield from flush()


def _tokenizing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, block, held), equal chunks one after another, to rows (term, block, times, held)."""
    last: tuple[bytes | None, dict[bytes, int]] = (None, {})
    for batch in batches:
        coded = batch.column("chunk").dictionary_encode()
        found: list[dict[bytes, int]] = []
        for chunk in coded.dictionary.to_pylist():
            if chunk != last[0]:
                words = terms_of(chunk)
                last = (chunk, {words[0]: 1} if len(words) == 1 else Counter(words))
            found.append(last[1])
        many = np.array([len(f) for f in found], np.int64)
        starts = np.cumsum(many) - many
        index = coded.indices.to_numpy()
        mine = many[index]
        row = np.repeat(np.arange(len(index)), mine)
        term = np.arange(len(row)) - np.repeat(np.cumsum(mine) - mine, mine) + starts[index][row]
        names = pa.array([t for f in found for t in f], pa.binary())
        times = np.array([n for f in found for n in f.values()], np.int64)
        sizes = pa.compute.binary_length(batch.column("held")).to_numpy()
        for at in range(0, len(row), ROWS):
            rows, terms = row[at : at + ROWS], term[at : at + ROWS]
            part = pa.RecordBatch.from_arrays(
                [names.take(pa.array(terms)), batch.column("block").take(pa.array(rows)), pa.array(times[terms]), batch.column("held").take(pa.array(rows))],
                names=["term", "block", "times", "held"],
            )
            yield from _sized(part, sizes[rows] + pa.compute.binary_length(part.column(0)).to_numpy())


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the exact sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(values, first) if len(first) else values[:0]


def _merged(part: pa.Table, run: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """One row for each run of rows of a term: its groups, with occurrences and with distinct documents."""
    held = part.column("held").combine_chunks()
    offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
    words = np.frombuffer(held.buffers()[2], "<u2")[offsets[0] // 2 : offsets[-1] // 2]
    row, group, doc, count = _pairs(words, np.diff(offsets) // 2)
    _, block = np.unique(part.column("block").to_numpy(), return_inverse=True)
    key, occurrences = _sums(run[row] << 30 | group, count * part.column("times").to_numpy()[row])
    _, once = np.unique((run[row] << 20 | block[row]) << 15 | doc, return_index=True)
    _, documents = _sums(run[row][once] << 30 | group[once], np.ones(len(once), np.int64))
    ends = np.cumsum(np.bincount(key >> 30, minlength=len(first)))
    return pa.RecordBatch.from_arrays(
        [part.column("term").combine_chunks().take(pa.array(first)), _lists(key & ((1 << 30) - 1), ends), _lists(occurrences, ends), _lists(documents, ends)],
        names=["term", "groups", "occurrences", "documents"],
    )


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, part, block, times, held), equal (term, part) one after another, to one row for each (term, part)."""

    def runs(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        coded = part.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        sets = part.column("part").to_numpy()
        starts = np.ones(len(coded), bool)
        starts[1:] = (coded[1:] != coded[:-1]) | (sets[1:] != sets[:-1])
        return np.cumsum(starts) - 1, np.flatnonzero(starts)

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) < MERGED and sum(b.nbytes for b in waiting) < 4 * BYTES:
            continue
        whole = pa.Table.from_batches(waiting)
        run, first = runs(whole)
        if len(first) > 1:
            stop = int(first[-1])
            yield from _small(_merged(whole.slice(0, stop), run[:stop], first[:-1]))
            waiting = whole.slice(stop).combine_chunks().to_batches()
    if waiting:
        whole = pa.Table.from_batches(waiting)
        yield from _small(_merged(whole, *runs(whole)))


def _small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return _sized(batch, 24 * pa.compute.list_value_length(batch.column("groups")).to_numpy())


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(group, lang, source) of every occurring language and source, and (term, groups, occurrences, documents).

    A term may have several rows, each over other documents, to be added up. Null text, language and source are empty.
    Every row is a document of its own, equal ones too. Terms are maximal runs of letters A-Z, lower-cased, and of
    characters beyond ASCII.
    """
    named = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).alias("text"))
    kinds = named.select(F.struct("lang", "source").alias("kind")).distinct()
    groups = cut_lineage(dense_ids(kinds, "kind", "group").select(F.col("group").cast("long").alias("group"), "kind.lang", "kind.source"), "groups")
    rows = named.join(broadcast_if_small(groups), ["lang", "source"]).select("group", "text")
    blocks = rows.mapInArrow(_counting, "chunk binary, block long, held binary")
    # Rebalanced by chunk: adaptive execution splits what a frequent chunk makes large.
    met = blocks.hint("rebalance", "chunk").sortWithinPartitions("chunk")
    terms = met.mapInArrow(_tokenizing, "term binary, block long, times long, held binary")
    dealt = terms.withColumn("part", F.shiftright("block", _SEQUENCE_BITS + TASK_BITS)).repartition("term", "part")
    merged = dealt.sortWithinPartitions("term", "part").mapInArrow(
        _merging, "term binary, groups array<long>, occurrences array<long>, documents array<long>"
    )
    return groups, cut_lineage(merged.withColumn("term", F.decode("term", "UTF-8")), "terms")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)) without rounding."""
    whole = F.lit(SCALE).cast("decimal(38,0)")
    return F.call_function("div", whole * (count + 2).cast("decimal(19,0)"), (total + 2 * kept).cast("decimal(19,0)")) + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(
    docs: DataFrame, min_docs: int = 10, k: int = 10, lang: str = "lang", source: str = "source", text: str = "text"
) -> DataFrame:
    """(lang, source, part, item, value long, rank int from 1 per language, source and part).

    Part `pair`: the divergence from every other source of the language. Part `term`: the `k` terms that set the source
    apart from its language most, of those it holds more often. Terms held by fewer than `min_docs` documents of the
    language are left out. Ties go to the item that sorts first. Languages without such terms give value 0 for every
    pair; a language of one source gives no pairs; an empty table gives no rows.

    Pairs need no dense table: a source's absent terms have one share, so they enter through the numbers of terms with
    equal counts; only terms that both sources hold are joined.
    """
    groups, terms = term_counts(docs, lang, source, text)
    near = broadcast_if_small(groups)
    each = terms.select("term", F.explode(F.arrays_zip("groups", "occurrences", "documents")).alias("g"))
    each = each.select("term", F.col("g.groups").alias("group"), F.col("g.occurrences").alias("count"), F.col("g.documents").alias("documents"))
    each = each.join(near, "group")
    kept = each.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("count").alias("in_lang"))
    kept = cut_lineage(kept.where(F.col("documents") >= min_docs).select("lang", "term", "in_lang"), "kept")
    counts = each.join(broadcast_if_small(kept), ["lang", "term"]).groupBy("lang", "source", "group", "term", "in_lang")
    counts = cut_lineage(counts.agg(F.sum("count").alias("count")), "counts")

    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total"))
    totals = counts.groupBy("group").agg(F.sum("count").alias("total"))
    sized = groups.join(totals, "group", "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    absent = F.when(F.col("kept") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("kept")))
    sized = cut_lineage(sized.withColumn("absent", absent), "sizes")
    shares = counts.join(broadcast_if_small(sized.drop("lang", "source")), "group").withColumn(
        "p", _share(F.col("count"), F.col("total"), F.col("kept"))
    )

    usual = _share(F.col("in_lang"), F.col("lang_total"), F.col("kept"))
    apart = shares.withColumn("q", usual).where("p > q").select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    apart = apart.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    one = sized.select("lang", "source", "group", "kept", F.col("absent").alias("p0"))
    other = sized.select("lang", F.col("source").alias("item"), F.col("group").alias("other"), F.col("absent").alias("q0"))
    both = one.join(other, "lang").where(F.col("group") != F.col("other"))
    p0, q0, p, q = (F.col(c) for c in ("p0", "q0", "p", "q"))
    none = both.select("group", "other", F.coalesce(F.col("kept") * _apart(p0, q0), F.lit(0)).alias("value"))
    alike = shares.groupBy("group", "p").agg(F.count("*").alias("n"))
    alone = alike.join(both.select("group", "other", "p0", "q0"), "group").select(
        "group", "other", (F.col("n") * (_apart(p, q0) - _apart(p0, q0))).alias("value")
    )
    held = shares.select("lang", "term", "group", "p", F.col("absent").alias("p0"))
    twice = held.join(
        held.select("lang", "term", F.col("group").alias("other"), F.col("p").alias("q"), F.col("p0").alias("q0")), ["lang", "term"]
    ).where(F.col("group") < F.col("other"))
    value = _apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0)
    shared = twice.groupBy("group", "other").agg(F.sum(value).alias("value"))

    def turned(pairs: DataFrame) -> DataFrame:
        return pairs.union(pairs.select(F.col("other").alias("group"), F.col("group").alias("other"), "value"))

    # `none` has both orders already.
    found = none.union(turned(alone)).union(turned(shared)).groupBy("group", "other").agg(F.sum("value").alias("value"))
    pairs = found.join(both.select("group", "other", "lang", "source", "item"), ["group", "other"])
    pairs = pairs.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(best))
    result = pairs.withColumn("part", F.lit("pair")).unionByName(apart.withColumn("part", F.lit("term")))
    return result.select("lang", "source", "part", "item", "value", "rank")
