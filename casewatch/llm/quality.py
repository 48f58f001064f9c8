"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Two generative models give the chance that a document with words holds an n-gram of a hash bucket: one of the target
(labelled documents of good quality that are not toxic), one of all raw text. A document's log weight is the sum of the
log ratios of its n-grams: single words, shapes of single words and pairs of shapes; each counts once for a document, so
that long and repetitive texts do not outweigh what they hold. Every bucket has a ratio, smoothed and then shrunk by its
counts: the target is a small sample of raw text, and the chance that a bucket's two counts differ by accident, among
all buckets with differences as large, says how much of its ratio is left. So rare words weigh nearly nothing, and
without any size floor more of them do as the sample grows.

Each log weight, divided by `TEMPERATURE`, gets Gumbel noise made from a hash of the text, and the k largest stay. k is
the number of documents above the weight that separates labelled documents best, so the share kept follows the corpus.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch.llm.batches import by_value, fresh, raw_texts, slices
from casewatch.plans.lineage import cut_lineage

by_value(__name__)

# Labelled documents used, those of the smallest id hashes. One of `FOLDS` shares of the good ones is left out of the
# target model and, with those that are not good, finds the cut.
MAX_LABELLED = 20_000
FOLDS = 5
# Documents added to both counts of a bucket, and the power of the chance that its difference is none by accident.
SMOOTH = 0.5
SHRINK = 8
TEMPERATURE = 0.25
SEED = 7

# Bits of the hash buckets of words, shapes, and pairs of shapes.
_BITS = (17, 12, 16)
_OFFSETS = tuple(int(x) for x in np.cumsum([0, *[1 << b for b in _BITS]]))
BUCKETS = _OFFSETS[-1]

_FACTOR, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHAPE = bytes(
    65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else 32 if c in b"\t\n\v\f\r " else c
    for c in range(256)
)
_RUN = re.compile(rb"(.)\1+")
_EDGES = b".,;:!?\"'()*#%&$|"
# Words that follow themselves have their run length as shape, up to this.
_LONGEST_RUN = 8


def buckets(text: bytes | None) -> np.ndarray:
    """The distinct buckets of a text's n-grams; empty for null, empty and wordless texts."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    word = np.array([zlib.crc32(w.strip(_EDGES)) for w in words], np.uint64)
    shape = np.array([zlib.crc32(s) for s in _RUN.sub(rb"\1", text.translate(_SHAPE)).split()], np.uint64)
    same = np.r_[False, word[1:] == word[:-1]]
    place = np.arange(len(same))
    run = place - np.maximum.accumulate(np.where(same, 0, place))
    shape[same] = np.minimum(run[same], _LONGEST_RUN).astype(np.uint64) + np.uint64(1 << 40)
    pair = (shape[:-1] * _FACTOR + shape[1:]) * _OTHER
    found = [
        ((x >> np.uint64(64 - bits)).astype(np.int64) + start)
        for x, bits, start in zip((word * _FACTOR, shape * _FACTOR, pair), _BITS, _OFFSETS)
    ]
    return np.unique(np.concatenate(found))


def _counts(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, and documents with words in all. The counts are added up in every task, then by bucket;
    what reaches the driver has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, rows = np.zeros(BUCKETS + 1, np.int64), 0
        for part in slices(batches):
            for t in raw_texts(part.column(0)):
                mine = buckets(t)
                count[mine] += 1
                rows += len(mine) > 0
        count[BUCKETS] = rows
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held])], names=["bucket", "n"])

    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])
    found = docs.select(text).mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(BUCKETS + 1, np.int64)
    count[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return count[:BUCKETS], int(count[BUCKETS])


def _by_accident(target: int, targets: int, raw: int, raws: int) -> float:
    """How likely a sample of `targets` of `raws` documents holds a bucket at least this unusually often or seldom
    (from the signed root of the deviance)."""
    share, rest = targets / raws, raw - target
    inside = target * math.log(target / (raw * share)) if target else 0.0
    outside = rest * math.log(rest / (raw * (1 - share))) if rest and share < 1 else 0.0
    return math.erfc(math.sqrt(max(inside + outside, 0.0)))


def log_ratios(target: np.ndarray, targets: int, raw: np.ndarray, raws: int) -> np.ndarray:
    """Log ratio of the two models for each bucket, smoothed and shrunk. Target documents are raw ones too."""
    held = np.flatnonzero(raw)
    ratios = np.zeros(len(raw))
    if not len(held) or not targets:
        return ratios
    pairs, which = np.unique(np.stack([target[held], raw[held]], axis=1), axis=0, return_inverse=True)
    chance = np.array([_by_accident(t, targets, r, raws) for t, r in pairs.tolist()])[which.ravel()]
    # The share of accidents among the buckets whose chance is no larger.
    order = np.argsort(chance, kind="stable")
    accidents = np.minimum.accumulate((chance[order] * len(held) / np.arange(1, len(held) + 1))[::-1])[::-1]
    kept = np.empty(len(held))
    kept[order] = (1 - np.minimum(accidents, 1)) ** SHRINK
    expected = raw[held] * (targets / raws)
    ratios[held] = np.log((target[held] + SMOOTH) / (expected + SMOOTH)) * kept
    return ratios


def _with_weights(docs: DataFrame, text: str, ratios: np.ndarray, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            held = [buckets(t) for t in raw_texts(part.column(text))]
            weight = [float(ratios[mine].sum()) if len(mine) else -np.inf for mine in held]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.round(weight, 9), pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight at or below which documents are rejected, so that the mean of the shares of good documents kept and
    of others rejected is largest; of equal ones the lowest. Nothing is rejected where one of the classes is missing."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    weights, good = weights[order], good[order]
    caught = np.r_[0, np.cumsum(~good) / (~good).sum()] - np.r_[0, np.cumsum(good) / good.sum()]
    ends = np.r_[True, weights[1:] != weights[:-1], True]  # only between different weights
    at = int(np.argmax(np.where(ends, caught, -2)))
    return -np.inf if at == 0 else float(weights[at - 1])


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, good, held_out) of at most `MAX_LABELLED` labelled documents. Several labels of a document count as the
    worst of them; labels without a verdict (null, and nothing else says no) are left out."""
    verdict = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), False).when(
        (F.col("quality") == 1) & (F.col("toxic") == 0), True
    )
    each = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(verdict).alias("good")).where("good IS NOT NULL")
    sample = each.orderBy(F.xxhash64(key), key).limit(MAX_LABELLED)
    held_out = (F.pmod(F.xxhash64(F.lit("fold"), key), F.lit(FOLDS)) == 0).alias("held_out")
    return docs.select(key, F.col(text).alias("text")).join(F.broadcast(sample), key).select("text", "good", held_out)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    """The log ratios and the cut. The raw model is counted over all documents; the target model and the cut come from
    the bounded sample. Without labelled documents of both kinds nothing is rejected."""
    raw, raws = _counts(docs, text)
    sample = cut_lineage(labelled(docs, labels, key, text), "labelled")
    target, targets = _counts(sample.where("good AND NOT held_out"), "text")
    ratios = log_ratios(target, targets, raw, raws)
    judged = _with_weights(sample.where("held_out OR NOT good"), "text", ratios, "weight").where(F.col("weight") > float("-inf"))
    weighed = judged.select("weight", "good").toArrow()
    return ratios, best_cut(weighed.column("weight").to_numpy(), weighed.column("good").to_numpy(zero_copy_only=False).astype(bool))


def gumbel(text: str) -> Column:
    """Gumbel noise made from a text; equal texts have the same."""
    whole = F.xxhash64(F.lit(SEED), F.coalesce(F.col(text), F.lit(""))).cast("double")
    share = (whole + F.lit(2.0**63) + F.lit(0.5)) / F.lit(2.0**64 * (1 + 2**-40))
    return -F.log(-F.log(F.greatest(share, F.lit(2.0**-64))))


def kth_largest(values: DataFrame, name: str, k: int, buffer: int = 4_096) -> float:
    """The exact k-th largest number of a column, by histograms of the range that still holds it."""
    low, high = values.agg(F.min(name), F.max(name)).first()
    inside, above = values, 0
    while low < high:
        width = (high - low) / buffer
        inside = inside.where((F.col(name) >= low) & (F.col(name) <= high))
        place = F.least(F.floor((F.col(name) - low) / width), F.lit(buffer - 1)).alias("place")
        cells = inside.groupBy(place).agg(F.count("*").alias("n"), F.min(name).alias("low"), F.max(name).alias("high"))
        for cell in sorted(cells.collect(), key=lambda c: -c["place"]):
            if above + cell["n"] >= k:
                low, high = cell["low"], cell["high"]
                break
            above += cell["n"]
    return low


def weigh(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", names=("log_weight", "perturbed", "selected")) -> DataFrame:
    """`docs` with log weight, perturbed log weight and whether it is among the k largest, in columns `names`.

    Null, empty and wordless texts have weight minus infinity: they are selected only where all documents are, that is
    where no labelled document is good or none is not. Documents that tie with the k-th stay too. The rows are written
    once to the shared folder.
    """
    ratios, cut = fit(docs, labels, key, text)
    clean = docs.drop(*[n for n in docs.columns if n in names])
    rows = _with_weights(clean, text, ratios, names[0]).withColumn(names[1], F.round(F.col(names[0]) / TEMPERATURE + gumbel(text), 9))
    rows = cut_lineage(rows, "weighed")
    total, k = rows.agg(F.count("*"), F.count(F.when(F.col(names[0]) > cut, 1))).first()
    if k == total or cut == -np.inf:
        return rows.withColumn(names[2], F.lit(True))
    if k == 0:
        return rows.withColumn(names[2], F.lit(False))
    finite = rows.select(names[1]).where(F.col(names[1]) > float("-inf"))
    return rows.withColumn(names[2], F.col(names[1]) >= kth_largest(finite, names[1], k))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The selected rows of `docs`, with its columns."""
    names = tuple(fresh(docs.columns, "weight", "perturbed", "selected"))
    return weigh(docs, labels, key, text, names).where(names[2]).select(*docs.columns)
