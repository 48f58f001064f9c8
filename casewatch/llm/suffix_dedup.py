"""Removal of repeated byte strings by suffix sorting with bucket-pointer refinement.

A byte goes if it lies in a string of `window` bytes that also starts elsewhere, in the same text or another. Suffixes
are sorted by their first `window` bytes, which is all that counts: initial buckets of 8-byte grams are refined by
sorting on the bucket identifiers of later offsets (8, 16, 32, ... bytes on), each level using the identifiers the level
before left, and only buckets that still hold several suffixes are sorted again.

The sort is dealt out by content, so that equal strings meet in one task. Every window is named by the gram of `gram`
bytes with the smallest hash in it (the leftmost of equals), which depends on the window alone. Windows in a row with
the same gram travel as one stretch of text to the task of that gram, but only if the gram occurs more than once in the
corpus; a window whose gram occurs once cannot repeat. Hashes decide where texts meet, never whether they are equal.

Equal texts are sorted once. Compressed texts lie in a table bucketed by their hash, which later joins read in place.
A gram with more different stretches than `LIMIT` bytes is not sorted in one task: its windows are counted by 128-bit
hashes, with aggregation before the shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch.llm.batches import by_value, raw_texts, slices
from casewatch.plans.lineage import cut_lineage, delete_written, new_dir

by_value(__name__)

WINDOW = 200
# Bytes of a gram that names windows.
GRAM = 40
# Bytes of stretches sorted at a time, and different bytes of one gram that one task sorts.
BATCH = 2 << 20
LIMIT = 32 << 20
# Text bytes of a bucket of the table of texts.
BUCKET_BYTES = 24 << 20
# Longer texts are looked through in parts, so that a place fits 24 bits.
PART = 8 << 20

_POWER, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_PLACE = np.uint64((1 << 24) - 1)


def _powers(base: int, count: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(count, base, np.uint64)], dtype=np.uint64)


class Naming:
    """The name gram of every window of a text."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, min(gram, window)
        self.up = self.down = np.empty(0, np.uint64)

    def _runs(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, k = len(text), self.gram
        if len(self.up) < n + 1:
            self.up, self.down = _powers(_POWER, 2 * n), _powers(_INVERSE, 2 * n)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((text + np.uint64(1)) * self.up[:n], out=sums[1:])
        grams = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(32)
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        wide, reach = self.window - k + 1, 1
        while reach < wide:  # the least of `reach` grams from each place on
            step = min(reach, wide - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        place = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        return first, np.diff(np.r_[first, len(place)]), grams[place[first]].view(np.int64)

    def runs(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and name of each run of windows with the same gram at the same place."""
        found = []
        for start in range(0, max(1, len(text) - self.window + 1), PART):
            part = np.frombuffer(text, np.uint8, min(len(text) - start, PART + self.window - 1), start).astype(np.uint64)
            if len(part) >= self.window:
                first, count, name = self._runs(part)
                found.append((first + start, count, name))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))


def repeated_windows(stretches: list[bytes], window: int) -> np.ndarray:
    """For each place of the joined stretches, whether a window starts there whose bytes also start elsewhere.

    Bucket-pointer refinement: `bucket` holds for each suffix the place of its bucket in the sorted order.
    """
    sizes = np.array([len(s) for s in stretches], np.int64)
    text = np.frombuffer(b"".join(stretches), np.uint8)
    total = len(text)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)  # bytes to the end of the stretch
    length = 8
    while length > window:
        length //= 2
    code = np.zeros(total, np.uint64)
    for i in range(length):
        code[: total - i] |= text[i:].astype(np.uint64) << np.uint64(8 * (length - 1 - i))
    bucket = np.full(total, -1, np.int64)
    live = np.flatnonzero(left >= length)
    bucket[live], several = _buckets(code[live], np.zeros(len(live), np.int64))
    live = live[several]
    while True:
        step = min(length, window - length)
        if not step or not len(live):
            break
        live = live[left[live] >= length + step]
        # The pair of identifiers; those of places that stayed alone are as good as any.
        key = (bucket[live] << 31) | bucket[live + step]
        fresh, several = _buckets(key, bucket[live])
        bucket[live] = fresh
        live = live[several]
        length += step
    out = np.zeros(total, bool)
    out[live] = True
    return out & (left >= window)


def _buckets(key: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New bucket identifiers of suffixes whose keys sort within their buckets `base`, and which share theirs."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    edge = np.r_[True, ranked[1:] != ranked[:-1]] if len(order) else np.empty(0, bool)
    first = np.flatnonzero(edge)
    size = np.diff(np.r_[first, len(order)])
    old = base[order]
    start = np.flatnonzero(np.r_[True, old[1:] != old[:-1]]) if len(order) else first
    begin = np.repeat(start, np.diff(np.r_[start, len(order)]))
    place = np.repeat(first, size)
    fresh, several = np.empty(len(order), np.int64), np.empty(len(order), bool)
    fresh[order] = old + place - begin
    several[order] = np.repeat(size > 1, size)
    return fresh, several


def spans_of(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches covered by windows at these ascending places."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(np.diff(starts) > window)
    return starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]] + window


_LONG = T.LongType()
_KEY = [T.StructField("k1", _LONG), T.StructField("k2", _LONG)]
_STRETCH = T.StructType(
    [*_KEY, T.StructField("name", _LONG), T.StructField("start", _LONG), T.StructField("end", _LONG), T.StructField("stretch", T.BinaryType())]
)


def _key(text: bytes) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(text)
    return tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (whole >> 64, whole & ((1 << 64) - 1)))


def _table(columns: dict, kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n], k) for n, k in kinds.items()], names=list(kinds))


_L, _B = pa.int64(), pa.binary()
_STRETCH_KINDS = {"k1": _L, "k2": _L, "name": _L, "start": _L, "end": _L, "stretch": _B}


def _described(text: str, window: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t or b"" for t in raw_texts(part.column(text))]
            keys = [_key(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(key),
                    pa.array([k[0] for k in keys], _L),
                    pa.array([k[1] for k in keys], _L),
                    pa.array(map(len, texts), _L),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                ],
                names=[key, "k1", "k2", "n_bytes", "sha"],
            )

    return run


def _packed(text: str, window: int):
    """Texts that have a window, compressed; each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        press = zstandard.ZstdCompressor(level=3)
        for part in slices(batches):
            rows = []
            for t in raw_texts(part.column(text)):
                if t and len(t) >= window and (k := _key(t)) not in seen:
                    seen.add(k)
                    rows.append((*k, press.compress(t)))
            if rows:
                yield _table(dict(zip(("k1", "k2", "z"), zip(*rows))), {"k1": _L, "k2": _L, "z": _B})

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each key; all rows of a key are in the same task."""
    seen: set[tuple[int, int]] = set()
    for part in slices(batches, 1_024):
        keep = []
        for i, k in enumerate(zip(part.column("k1").to_pylist(), part.column("k2").to_pylist())):
            if k not in seen:
                seen.add(k)
                keep.append(i)
        yield part.take(pa.array(keep, pa.int32()))


def _opened(column: pa.Array) -> Iterator[bytes]:
    open_ = zstandard.ZstdDecompressor()
    for z in column.to_pylist():
        yield open_.decompress(z)


def _names(naming: Naming):
    """Names of each text; twice where the text has it twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: list[np.ndarray] = []
            for t in _opened(part.column("z")):
                name, count = np.unique(naming.runs(t)[2], return_counts=True)
                out.append(np.repeat(name, np.minimum(count, 2)))
            sizes = [len(x) for x in out]
            k1, k2 = (np.repeat(part.column(n).to_numpy(), sizes) for n in ("k1", "k2"))
            yield _table({"name": np.concatenate(out), "k1": k1, "k2": k2}, {"name": _L, "k1": _L, "k2": _L})

    return run


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by name those whose name another row has; one row is held at a time between batches."""
    last: pa.RecordBatch | None = None
    shared = False  # whether the row held shares its name with the row before it
    for part in slices(batches, 1 << 16):
        rows = pa.Table.from_batches([*([last] if last is not None else []), part]).combine_chunks().to_batches()[0]
        name = rows.column("name").to_numpy()
        same = name[1:] == name[:-1]
        keep = np.r_[shared, same] | np.r_[same, False]
        shared = bool(same[-1]) if len(same) else shared
        keep[-1] = False
        yield rows.filter(pa.array(keep))
        last = rows.slice(rows.num_rows - 1, 1)
    if last is not None and shared:
        yield last


def _stretches(naming: Naming):
    """Different stretches of each text under the names that are shared; what repeats inside the text is a finding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 16):
            rows: list[tuple] = []
            keys = zip(part.column("k1").to_pylist(), part.column("k2").to_pylist())
            wanted = part.column("names")
            for i, (t, (k1, k2)) in enumerate(zip(_opened(part.column("z")), keys)):
                first, count, name = naming.runs(t)
                chosen = np.flatnonzero(np.isin(name, wanted[i].values.to_numpy()))
                places: dict[bytes, list[int]] = {}
                for at in chosen.tolist():
                    a = int(first[at])
                    places.setdefault(t[a : a + int(count[at]) + naming.window - 1], []).append(at)
                for stretch, ats in places.items():
                    at = ats[0]
                    rows.append((k1, k2, int(name[at]), int(first[at]), 0, stretch))
                    if len(ats) > 1:
                        rows.extend((k1, k2, None, int(first[x]), int(first[x]) + len(stretch), None) for x in ats)
                if len(rows) > 4_096:
                    yield _table(dict(zip(_STRETCH_KINDS, zip(*rows))), _STRETCH_KINDS)
                    rows = []
            if rows:
                yield _table(dict(zip(_STRETCH_KINDS, zip(*rows))), _STRETCH_KINDS)

    return run


def _sorted_out(window: int, limit: int):
    """Findings (`end` above 0, no stretch) of stretches sorted by name; the stretches of a name with more different
    bytes than `limit` are given back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[dict[bytes, list[tuple[int, int, int]]]] = []
        held, size, name, over = {}, 0, None, False
        whole = 0

        def findings() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            stretches = [s for g in groups for s in g]
            owners = [o for g in groups for o in g.values()]
            if not stretches:
                return
            again = repeated_windows(stretches, window)
            begin = 0
            for s, own in zip(stretches, owners):
                if len(own) > 1:
                    spans = [(0, len(s))]
                else:
                    a, b = spans_of(np.flatnonzero(again[begin : begin + len(s)]), window)
                    spans = list(zip(a.tolist(), b.tolist()))
                rows.extend((k1, k2, None, start + a, start + b, None) for k1, k2, start in own for a, b in spans)
                begin += len(s)
            if rows:
                yield _table(dict(zip(_STRETCH_KINDS, zip(*rows))), _STRETCH_KINDS)

        def give(group: dict) -> Iterator[pa.RecordBatch]:
            rows = [(k1, k2, name, start, 0, s) for s, own in group.items() for k1, k2, start in own]
            if rows:
                yield _table(dict(zip(_STRETCH_KINDS, zip(*rows))), _STRETCH_KINDS)

        for part in slices(batches, 1_024):
            columns = [part.column(n).to_pylist() for n in ("k1", "k2", "name", "start", "stretch")]
            for k1, k2, mine, start, stretch in zip(*columns):
                if mine != name:
                    if over:
                        yield from give(held)
                    elif len(held) > 1 or any(len(o) > 1 for o in held.values()):
                        groups.append(held)
                        whole += size
                    if whole >= BATCH:
                        yield from findings()
                        groups, whole = [], 0
                    held, size, name, over = {}, 0, mine, False
                own = held.get(stretch)
                if own is None:
                    held[stretch] = [(k1, k2, start)]
                    size += len(stretch)
                else:
                    own.append((k1, k2, start))
                if size > limit:
                    over = True
                if over:
                    yield from give(held)
                    held = {}
        if over:
            yield from give(held)
        elif held:
            groups.append(held)
        yield from findings()

    return run


def _windows(window: int):
    """Hash and place of every window of stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            rows = []
            for k1, k2, start, s in zip(*(part.column(n).to_pylist() for n in ("k1", "k2", "start", "stretch"))):
                rows.extend((*_key(s[i : i + window]), k1, k2, start + i) for i in range(len(s) - window + 1))
            if rows:
                kinds = {"w1": _L, "w2": _L, "k1": _L, "k2": _L, "start": _L}
                yield _table(dict(zip(kinds, zip(*rows))), kinds)

    return run


def _cut(window: int):
    """n_removed, n_spans and the hash of what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for t, spans in zip(_opened(part.column("z")), part.column("spans").to_pylist()):
                kept, done, removed, count = hashlib.sha256(), 0, 0, 0
                end = -1
                for a, b in sorted((s["start"], s["end"]) for s in spans):
                    if a > end:
                        count += 1
                        kept.update(t[max(end, 0) : a])
                        removed += b - a
                        end = b
                    elif b > end:
                        removed += b - end
                        end = b
                kept.update(t[max(end, 0) :])
                rows.append((removed, count, kept.hexdigest()))
            removed, count, sha = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("k1"), part.column("k2"), pa.array(removed, _L), pa.array(count, _L), pa.array(sha)],
                names=["k1", "k2", "n_removed", "n_spans", "kept"],
            )

    return run


def text_table(docs: DataFrame, text: str, window: int, buckets: int) -> tuple[DataFrame, str]:
    """The different texts with a window, compressed, in a table bucketed by their keys; its name in the catalog."""
    session = docs.sparkSession
    name = f"texts_{uuid.uuid4().hex}"
    once = docs.select(text).mapInArrow(_packed(text, window), "k1 long, k2 long, z binary").repartition(buckets, "k1", "k2")
    rows = once.mapInArrow(_once, "k1 long, k2 long, z binary")
    rows.write.option("path", new_dir(session, name)).option("compression", "uncompressed").bucketBy(buckets, "k1", "k2").saveAsTable(name)
    return session.table(name), name


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int | None = None) -> DataFrame:
    """(k1, k2, start, end): stretches of the texts covered by windows that occur again. They may overlap."""
    naming, limit = Naming(window, gram), LIMIT if limit is None else limit
    names = texts.mapInArrow(_names(naming), "name long, k1 long, k2 long").repartition("name").sortWithinPartitions("name")
    shared = names.mapInArrow(_several, "name long, k1 long, k2 long").groupBy("k1", "k2").agg(F.collect_set("name").alias("names"))
    stretches = texts.join(shared, ["k1", "k2"]).mapInArrow(_stretches(naming), _STRETCH)
    # What repeats inside a text has no name and stays where it is among the tasks.
    dealt = stretches.repartition(F.coalesce("name", "k1")).sortWithinPartitions("name")
    found = dealt.mapInArrow(_with_own(_sorted_out(window, limit)), _STRETCH)
    return cut_lineage(found, "spans")


def _with_own(run):
    """Rows without a name pass; the others go to `run`. Sorted rows without a name come first."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []

        def named() -> Iterator[pa.RecordBatch]:
            for part in batches:
                none = part.column("name").null_count
                if none:
                    own.append(part.slice(0, none))
                yield part.slice(none)

        for out in run(named()):
            while own:
                yield own.pop()
            yield out
        yield from own

    return both


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    limit: int | None = None,
) -> DataFrame:
    """One row for each row of `docs`: (`key`, n_bytes, n_removed, n_spans, kept_sha256 of the bytes left).

    Null texts are empty; texts shorter than `window` lose nothing. All rows are judged on the input: equal texts lose
    everything, each of them. Repeated rows give repeated result rows; keys may be null. The result is written once to
    the shared folder, and what led to it is deleted.
    """
    session = docs.sparkSession
    schema = T.StructType([docs.schema[key], *_KEY, T.StructField("n_bytes", _LONG), T.StructField("sha", T.StringType())])
    rows = cut_lineage(docs.select(key, text).mapInArrow(_described(text, window, key), schema), "rows")
    size = rows.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    texts, name = text_table(docs, text, window, buckets)
    found = repeated_spans(texts, window, gram, limit)
    span = F.struct("start", "end")
    windows = found.where("stretch IS NOT NULL").mapInArrow(_windows(window), "w1 long, w2 long, k1 long, k2 long, start long")
    place = F.struct("k1", "k2", "start")
    again = windows.groupBy("w1", "w2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("w1", "w2")
    more = windows.join(again, ["w1", "w2"]).select("k1", "k2", "start", (F.col("start") + window).alias("end"))
    spans = found.where("stretch IS NULL").select("k1", "k2", "start", "end").union(more)
    each = spans.groupBy("k1", "k2").agg(F.collect_set(span).alias("spans"))
    cut = texts.join(each, ["k1", "k2"]).mapInArrow(_cut(window), "k1 long, k2 long, n_removed long, n_spans long, kept string")
    copied = rows.where(F.col("n_bytes") >= window).groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1")
    whole = F.col("copies").isNotNull()
    empty = hashlib.sha256(b"").hexdigest()
    joined = rows.join(cut, ["k1", "k2"], "left").join(copied, ["k1", "k2"], "left")
    result = cut_lineage(
        joined.select(
            key,
            "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        ),
        "kept",
    )
    for done in (rows, texts, found):
        delete_written(done)
    session.sql(f"DROP TABLE IF EXISTS {name}")
    return result
