"""Document scores by masked pseudo-likelihood: a small window network predicts every token from both sides.

Tokens are words (white space between, A-Z lower-cased): the most frequent of the corpus have ids of their own, the rest
share hash buckets. The network sees the `SIDE` tokens before and behind a place, joins their embeddings into a hidden
layer, and predicts the token there in two digits of its id, the second knowing the first. A document's score is the
sum of the log probabilities of all its tokens, each given its neighbours.

Word counts come from all documents. Every document also trains: each round masks another share of the places of all
documents; every task trains its copy of the network on its part, and the copies are averaged, weighted by the places
they saw, in two steps so that no task meets all copies.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch.llm.batches import by_value, raw_texts, slices
from casewatch.plans.lineage import cut_lineage

by_value(__name__)

DIGIT = 64
SIZE = DIGIT * DIGIT  # ids
BUCKETS = 1_024  # ids for words without one of their own
SIDE = 2
WIDTH = 16
HIDDEN = 32
ROUNDS = 2
# One place of so many is masked in a round.
MASKED = 8
STEP = 0.15
SEED = 11
# Places of one step of training, and of one step of scoring.
TRAINED, SCORED = 1_024, 8_192
# Words a task counts before it passes its counts on.
COUNTED = 200_000
CHUNKS = 16

EDGE = 0  # the id beyond both ends of a document; no word has it


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def vocabulary(docs: DataFrame, text: str = "text") -> dict[bytes, int]:
    """The most frequent words of all documents (ties by word) with ids from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for part in slices(batches):
            for t in raw_texts(part.column(0)):
                counts.update(words_of(t))
            if len(counts) > COUNTED:
                yield out(counts)
                counts = Counter()
        yield out(counts)

    counted = docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(SIZE - BUCKETS - 1).collect()
    return {bytes(r["word"]): i + 1 for i, r in enumerate(top)}


def ids_of(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    get, first = known.get, SIZE - BUCKETS
    return np.array([get(w) or first + zlib.crc32(w) % BUCKETS for w in words], np.int32)


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row with `SIDE` edges around each text, and the places of the tokens."""
    edge = np.full(SIDE, EDGE, np.int32)
    parts, places, at = [edge], [], SIDE
    for ids in texts:
        places.append(np.arange(at, at + len(ids)))
        parts += [ids, edge]
        at += len(ids) + SIDE
    return np.concatenate(parts), np.concatenate(places) if places else np.empty(0, np.int64)


_SHAPES = {
    "embed": (SIZE, WIDTH),
    "mix": (2 * SIDE * WIDTH, HIDDEN),
    "mix0": (HIDDEN,),
    "high": (HIDDEN, DIGIT),
    "high0": (DIGIT,),
    "given": (DIGIT, HIDDEN),
    "low": (HIDDEN, DIGIT),
    "low0": (DIGIT,),
}
_AROUND = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])


class Network:
    """The window network and its training, in numpy."""

    def __init__(self, flat: np.ndarray | None = None):
        rng = np.random.default_rng(SEED)
        total = sum(int(np.prod(s)) for s in _SHAPES.values())
        self.flat = np.empty(total, np.float32) if flat is None else flat.astype(np.float32)
        self.part: dict[str, np.ndarray] = {}
        at = 0
        for name, shape in _SHAPES.items():
            size = int(np.prod(shape))
            self.part[name] = self.flat[at : at + size].reshape(shape)
            if flat is None:
                self.part[name][...] = 0 if len(shape) == 1 else rng.normal(0, 0.1 if name == "embed" else shape[0] ** -0.5, shape)
            at += size
        self.seen = {n: np.full(s, 1e-3, np.float32) for n, s in _SHAPES.items()}

    def _forward(self, ids: np.ndarray, places: np.ndarray):
        p = self.part
        around = ids[places[:, None] + _AROUND]
        x = p["embed"][around].reshape(len(places), -1)
        hidden = np.tanh(x @ p["mix"] + p["mix0"])
        first, second = np.divmod(ids[places], DIGIT)
        second_in = hidden + p["given"][first]
        return around, x, hidden, first, second, second_in, _log_softmax(hidden @ p["high"] + p["high0"]), _log_softmax(second_in @ p["low"] + p["low0"])

    def log_probability(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of the token at each place given its neighbours."""
        out = np.empty(len(places), np.float64)
        for start in range(0, len(places), SCORED):
            part = places[start : start + SCORED]
            *_, first, second, _, high, low = self._forward(ids, part)
            row = np.arange(len(part))
            out[start : start + SCORED] = high[row, first] + low[row, second]
        return out

    def train(self, ids: np.ndarray, places: np.ndarray) -> None:
        """One step of gradient descent with adapted step sizes."""
        p, n = self.part, len(places)
        around, x, hidden, first, second, second_in, high, low = self._forward(ids, places)
        row = np.arange(n)
        d_high, d_low = np.exp(high), np.exp(low)
        d_high[row, first] -= 1
        d_low[row, second] -= 1
        d_high /= n
        d_low /= n
        d_second = d_low @ p["low"].T
        d_hidden = (d_high @ p["high"].T + d_second) * (1 - hidden * hidden)
        given, embed = np.zeros_like(p["given"]), np.zeros_like(p["embed"])
        np.add.at(given, first, d_second)
        np.add.at(embed, around.ravel(), (d_hidden @ p["mix"].T).reshape(-1, WIDTH))
        slopes = {
            "embed": embed, "mix": x.T @ d_hidden, "mix0": d_hidden.sum(axis=0), "high": hidden.T @ d_high,
            "high0": d_high.sum(axis=0), "given": given, "low": second_in.T @ d_low, "low0": d_low.sum(axis=0),
        }
        for name, slope in slopes.items():
            rows = np.unique(around) if name == "embed" else slice(None)
            self.seen[name][rows] += slope[rows] ** 2
            p[name][rows] -= STEP * slope[rows] / np.sqrt(self.seen[name][rows])


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


_COPY = T.StructType(
    [T.StructField("task", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("places", T.DoubleType()), T.StructField("numbers", T.BinaryType())]
)


def _training(flat: np.ndarray, known: dict[bytes, int], round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, trained = Network(flat), 0
        waiting: list[np.ndarray] = []
        for part in slices(batches):
            for t in raw_texts(part.column(0)):
                if ids := words_of(t):
                    waiting.append(ids_of(ids, known))
            if waiting and sum(map(len, waiting)) >= TRAINED * MASKED:
                trained += _fit(net, waiting, round_)
                waiting = []
        trained += _fit(net, waiting, round_)
        if trained:
            task = TaskContext.get().partitionId()
            numbers = [c.astype("<f4").tobytes() for c in np.array_split(net.flat, CHUNKS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * CHUNKS, pa.int64()), pa.array(range(CHUNKS), pa.int32()), pa.array([float(trained)] * CHUNKS), pa.array(numbers)],
                names=_COPY.names,
            )

    return run


def _fit(net: Network, texts: list[np.ndarray], round_: int) -> int:
    ids, places = joined(texts)
    masked = places[(places * 5 + round_) % MASKED == 0]
    masked = masked[np.argsort(masked * 2654435761 % (1 << 32), kind="stable")]
    for start in range(0, len(masked), TRAINED):
        net.train(ids, masked[start : start + TRAINED])
    return len(masked)


def _averaged(table: pa.Table) -> pa.Table:
    """The mean of copies of one chunk, weighted by the places they saw; one copy is in memory at a time."""
    table = table.sort_by("task")
    total = np.array(table.column("places").to_pylist())
    mean = 0.0
    for share, numbers in zip(total / total.sum(), table.column("numbers")):
        mean = mean + share * np.frombuffer(numbers.as_py(), "<f4").astype(np.float64)
    return pa.table(
        [table.column("task").slice(0, 1), table.column("chunk").slice(0, 1), pa.array([float(total.sum())]), pa.array([mean.astype("<f4").tobytes()])],
        names=_COPY.names,
    )


def fit(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> tuple[dict[bytes, int], np.ndarray]:
    """The vocabulary and the network's numbers, learnt from all documents."""
    known = vocabulary(docs, text)
    flat = Network().flat
    for round_ in range(rounds):
        copies = docs.select(text).mapInArrow(_training(flat, known, round_), _COPY)
        some = cut_lineage(copies.groupBy("chunk", F.pmod("task", F.lit(64)).alias("part")).applyInArrow(_averaged, _COPY), "copies")
        mean = some.groupBy("chunk").applyInArrow(_averaged, _COPY).collect()
        if mean:
            flat = np.concatenate([np.frombuffer(r["numbers"], "<f4") for r in sorted(mean, key=lambda r: r["chunk"])])
    return known, flat


def score(docs: DataFrame, text: str = "text", names: tuple[str, str, str] = ("n_tokens", "log_likelihood", "mean_log_likelihood")) -> DataFrame:
    """`docs` with the number of tokens, the sum of their conditional log probabilities and its mean, in columns `names`
    (which replace columns of these names).

    Null, empty and wordless texts have no tokens, sum 0 and no mean. The network is trained on all of `docs` first.
    """
    known, flat = fit(docs, text)
    clean = docs.drop(*[n for n in docs.columns if n in names])
    kinds = (T.LongType(), T.DoubleType(), T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(flat)
        for part in slices(batches, 32):
            texts = [ids_of(words_of(t), known) for t in raw_texts(part.column(text))]
            ids, places = joined(texts)
            sizes = np.array([len(t) for t in texts])
            owner = np.repeat(np.arange(len(texts)), sizes)
            sums = np.round(np.bincount(owner, net.log_probability(ids, places), len(texts)), 4)
            means = [round(s / n, 6) if n else None for s, n in zip(sums.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(sizes, pa.int64()), pa.array(sums), pa.array(means, pa.float64())], names=[*part.schema.names, *names]
            )

    return clean.mapInArrow(run, T.StructType([*clean.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]]))
