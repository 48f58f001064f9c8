"""Benchmark decontamination: an FM-index per shard of the training text, searched for all test phrases.

Words of a document that occur in no benchmark phrase cannot be part of an occurrence, so a shard's index holds only
the runs of benchmark words that are at least as long as the shortest phrase. That loses nothing and keeps the index
small. All phrases are searched backwards at once through the ranks of a wavelet matrix; occurrences are located by
sampled suffix positions and merged to spans of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch.llm.batches import by_value, fresh, raw_texts, slices
from casewatch.llm.fm_index import FMIndex

by_value(__name__)

WINDOW = 10
# Benchmark text of one pass over the documents; a larger benchmark takes several passes in one job.
BLOCK_BYTES = 16 << 20
# A shard's index is made once so many words or bytes have been gathered.
SHARD_WORDS = 1 << 18
SHARD_BYTES = 16 << 20

_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_LETTERS).split() if text else []


class Phrases:
    """The distinct windows of benchmark items as word numbers, and the items each belongs to."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for start in range(len(ids) - size + 1 if ids else 0):
                owners.setdefault(tuple(ids[start : start + size]), set()).add(name)
        self.owners = [sorted(x) for x in owners.values()]
        self.lengths = np.array([len(x) for x in owners], np.int64)
        self.words = np.zeros((len(owners), window), np.int64)
        for row, ids in zip(self.words, owners):
            row[: len(ids)] = ids
        self.shortest = int(self.lengths.min()) if owners else 0


class Shard:
    """Documents gathered for one index."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.counts: list[int] = []
        self.runs: list[np.ndarray] = []
        self.begins: list[tuple[int, int, int]] = []  # place in the shard, document, word
        self.size = 0

    def add(self, text: bytes | None) -> None:
        words = words_of(text)
        phrases, document = self.phrases, len(self.counts)
        self.counts.append(len(words))
        if not phrases.shortest or len(words) < phrases.shortest:
            return
        get = phrases.number.get
        ids = np.array([get(w, 0) for w in words], np.int32)
        edge = np.flatnonzero(np.diff(np.r_[0, ids != 0, 0]))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - start >= phrases.shortest:
                self.begins.append((self.size, document, start))
                self.runs.append(np.r_[ids[start:end], 0])
                self.size += end - start + 1

    def hits(self) -> dict[int, tuple[list[tuple[int, int]], list[str]]]:
        """Of each document with occurrences: merged word spans and the items."""
        if not self.runs:
            return {}
        phrases = self.phrases
        index = FMIndex(np.concatenate(self.runs), len(phrases.number))
        low, high = index.search(phrases.words, phrases.lengths)
        many = high - low
        which = np.repeat(np.arange(len(many)), many)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        places = index.locate(rows)
        begin, document, word = np.array(self.begins, np.int64).T
        run = np.searchsorted(begin, places, side="right") - 1
        owner = np.unique(document[run] * len(many) + which)
        items: dict[int, set[str]] = {}
        for d, p in zip((owner // len(many)).tolist(), (owner % len(many)).tolist()):
            items.setdefault(d, set()).update(phrases.owners[p])
        cover = np.zeros(self.size + 1, np.int64)
        np.add.at(cover, places, 1)
        np.add.at(cover, places + phrases.lengths[which], -1)
        edge = np.flatnonzero(np.diff(np.r_[0, np.cumsum(cover) > 0, 0]))
        found: dict[int, tuple[list[tuple[int, int]], list[str]]] = {d: ([], sorted(x)) for d, x in items.items()}
        run = np.searchsorted(begin, edge[::2], side="right") - 1
        shift = word[run] - begin[run]
        for d, a, b in zip(document[run].tolist(), (edge[::2] + shift).tolist(), (edge[1::2] + shift).tolist()):
            found[d][0].append((a, b))
        return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _marking(phrases: Phrases, text: str, names: tuple[str, str, str], again: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard, size = Shard(phrases), 0

        def flush() -> Iterator[pa.RecordBatch]:
            found, done = shard.hits(), 0
            for part in held:
                mine = [found.get(done + i, ([], [])) for i in range(part.num_rows)]
                if again:  # an earlier pass has searched other items
                    old = zip(part.column(names[1]).to_pylist(), part.column(names[2]).to_pylist())
                    mine = [
                        (merged([*s, *((x["start"], x["end"]) for x in spans)]), sorted({*items, *more}))
                        for (s, items), (spans, more) in zip(mine, old)
                    ]
                spans = [[{"start": a, "end": b} for a, b in s] for s, _ in mine]
                kept = [c for c, n in zip(part.columns, part.schema.names) if n not in names]
                kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        *kept,
                        pa.array(shard.counts[done : done + part.num_rows], pa.int64()),
                        pa.array(spans, kinds),
                        pa.array([i for _, i in mine], pa.list_(pa.string())),
                    ],
                    names=[*(n for n in part.schema.names if n not in names), *names],
                )
                done += part.num_rows

        for part in slices(batches):
            for t in raw_texts(part.column(text)):
                size += len(t or b"")
                shard.add(t)
            held.append(part)
            if shard.size >= SHARD_WORDS or size >= SHARD_BYTES:
                yield from flush()
                held, shard, size = [], Shard(phrases), 0
        if held:
            yield from flush()

    return run


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    names: tuple[str, str, str] = ("n_words", "hit_spans", "hit_items"),
    block_bytes: int | None = None,
) -> DataFrame:
    """`docs` with its number of words, the merged spans of words inside an occurrence of a benchmark window, and the
    items (ids as strings, sorted) with such windows, in columns `names` (which replace columns of these names).

    Null and empty texts have no words; items without words are never found; a null item id counts as the id "".
    Items with the same id count as one. The benchmark reaches tasks in blocks of about `block_bytes` of text, each
    one pass in the same job, so its size is bounded for the driver and the tasks; one item is never split.
    """
    limit = BLOCK_BYTES if block_bytes is None else block_bytes
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("id"), F.col(item_text).cast("binary").alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = 1 + int(total) // limit
    out = docs.drop(*[n for n in docs.columns if n in names])
    schema = T.StructType(
        [
            *out.schema.fields,
            T.StructField(names[0], T.LongType()),
            T.StructField(names[1], SPANS),
            T.StructField(names[2], T.ArrayType(T.StringType())),
        ]
    )
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block)
        phrases = Phrases([(r[0], bytes(r[1]) if r[1] is not None else b"") for r in mine.sort("id", "t").collect()], window)
        out = out.mapInArrow(_marking(phrases, text, names, block > 0), schema)
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the stretches from the first to the last word of each span."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, done = [], 0
    for start, end in spans:
        kept.append(text[done : places[start][0]])
        done = places[end - 1][1]
    return "".join([*kept, text[done:]])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """`docs` without the text of benchmark passages; every document stays, `chars` (if there) follows the text."""
    names = tuple(fresh(docs.columns, "words", "spans", "items"))
    marked = mark_contamination(docs, benchmark, text, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            spans = part.column(names[1]).to_pylist()
            columns = {n: c for n, c in zip(part.schema.names, part.columns) if n not in names}
            if any(spans):
                old = columns[text].to_pylist()
                new = [cut_words(t, [(x["start"], x["end"]) for x in s]) if s else t for t, s in zip(old, spans)]
                columns[text] = pa.array(new, columns[text].type)
                if chars in columns:
                    counts = [len(t) if s else n for t, s, n in zip(new, spans, columns[chars].to_pylist())]
                    columns[chars] = pa.array(counts, columns[chars].type)
            yield pa.RecordBatch.from_pydict(columns)

    return marked.mapInArrow(run, docs.schema)
