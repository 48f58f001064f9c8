"""URL rules by a cascade of Bloom filters: exact membership for all keys of the corpus, without a join.

A URL's keys are the suffixes of its host, each with those beginnings of its path that are as long as some rule's path.
The first filter holds the listed keys; the second the keys of the corpus that the first lets through by mistake; the
third the listed keys that the second lets through, and so on until a level has no mistakes. A key is listed if the
first filter that does not hold it is an even one (counted from one), or none is left and their number is odd. Over the
keys of the corpus, which the levels were made from, that is exact.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch.llm.batches import by_value, slices

by_value(__name__)

# Rules of one cascade; longer lists take several, each with its own filters, in the same job.
BLOCK_RULES = 1_000_000
ROWS = 2_048
ALLOW, BLOCK = "allow", "block"

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(_LOWER), slash + path


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of `x`, so that no two levels share their mistakes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bloom:
    """A Bloom filter over 128-bit hashes, two of 64 bits to a key."""

    def __init__(self, keys: np.ndarray, chance: float, salt: int):
        count = max(1, len(keys))
        self.hashes = max(1, round(-math.log2(chance)))
        self.bits = max(64, math.ceil(count * self.hashes / math.log(2)))
        self.salt = np.uint64(salt)
        self.words = np.zeros(-(-self.bits // 8), np.uint8)
        for place in self._places(keys):
            np.bitwise_or.at(self.words, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        a, b = _mixed(keys[:, 0] + (self.salt + np.uint64(1)) * keys[:, 1]), keys[:, 1] | np.uint64(1)
        for n in range(self.hashes):
            yield (_mixed(a + np.uint64(n) * b) % np.uint64(self.bits)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        inside = np.ones(len(keys), bool)
        for place in self._places(keys):
            inside &= (self.words[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return inside


def hashed(keys: list[str]) -> np.ndarray:
    """Two unsigned numbers for each key."""
    whole = b"".join([xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")) for k in keys])
    return np.frombuffer(whole, "<u8").reshape(-1, 2)


@dataclass
class Cascade:
    levels: list[Bloom]

    def lists(self, keys: np.ndarray) -> np.ndarray:
        """Which keys are listed; exact for listed keys and the keys the cascade was made over."""
        listed = np.full(len(keys), len(self.levels) % 2 == 1)
        left = np.arange(len(keys))
        for n, level in enumerate(self.levels):
            inside = level.holds(keys[left])
            listed[left[~inside]] = n % 2 == 1
            left = left[inside]
        return listed


def build(listed: np.ndarray, mistakes: np.ndarray, first: Bloom) -> Cascade:
    """The levels behind `first`, which holds `listed` and lets through `mistakes`: alternately of either set."""
    levels, inside, outside = [first], mistakes, listed
    while len(inside):
        levels.append(Bloom(inside, 0.5 if len(levels) > 1 else 0.25, len(levels)))
        inside, outside = outside[levels[-1].holds(outside)], inside
    return Cascade(levels)


@dataclass(frozen=True)
class Shapes:
    """What keys of a set of rules can look like."""

    labels: int
    lengths: tuple[int, ...]

    @staticmethod
    def of(rules: list[tuple[str, str]]) -> Shapes:
        return Shapes(max((h.count(".") + 1 for h, _ in rules), default=0), tuple(sorted({len(p) for _, p in rules})))

    def keys(self, host: str, path: str) -> list[str]:
        hosts, at = [host], len(host)
        for _ in range(self.labels):
            at = host.rfind(".", 0, at)
            if at < 0:
                break
            hosts.append(host[at + 1 :])
        return [h + path[:n] for h in hosts for n in self.lengths if n <= len(path)]


def _passing(url: str, shapes: Shapes, first: Bloom):
    """Keys of URLs that a first filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ROWS):
            keys = list({k for u in part.column(url).to_pylist() for k in shapes.keys(*host_and_path(u))})
            if keys:
                inside = first.holds(hashed(keys))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, i in zip(keys, inside) if i], pa.string())], names=["key"])

    return run


def _judging(url: str, shapes: Shapes, cascades: list[tuple[str, Cascade]], names: tuple, again: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ROWS):
            split = [host_and_path(u) for u in part.column(url).to_pylist()]
            keys = [shapes.keys(*x) for x in split]
            flat = hashed([k for own in keys for k in own])
            listed = [(action, cascade.lists(flat).tolist()) for action, cascade in cascades]
            rule: list[str | None] = part.column(names[2]).to_pylist() if again else [None] * len(keys)
            verdict = part.column(names[3]).to_pylist() if again else [ALLOW] * len(keys)
            at = 0
            for i, own in enumerate(keys):
                for k in own:
                    for action, inside in listed:
                        if inside[at] and (rule[i] is None or len(k) >= len(rule[i])):
                            rule[i], verdict[i] = k, action
                    at += 1
            kept = [(n, c) for n, c in zip(part.schema.names, part.columns) if n not in names]
            new = [[h for h, _ in split], [p for _, p in split], rule, verdict]
            yield pa.RecordBatch.from_arrays(
                [*(c for _, c in kept), *(pa.array(x, pa.string()) for x in new)], names=[*(n for n, _ in kept), *names]
            )

    return run


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    names: tuple[str, str, str, str] = ("host", "path", "rule", "verdict"),
    block_rules: int | None = None,
) -> DataFrame:
    """`pages` with host, path, the longest rule that fits (null if none) and its verdict, in columns `names`.

    `rules` has `rule` (a host, then a path from its slash on, if any) and `action` (allow or block). A rule fits its
    host and all subdomains where the path starts with the rule's. A rule with both actions blocks; null rules are left
    out. Without a fitting rule the cascade says that no key is listed, and the page is allowed. A null url has empty
    host and path. No job but the count of the URLs and the search for mistakes runs before the result does; rules reach
    tasks as filters of a bounded block, and mistakes are about as many as rules, however many pages there are.
    """
    limit = BLOCK_RULES if block_rules is None else block_rules
    known = rules.where("rule IS NOT NULL").select("rule", (F.col("action") == BLOCK).alias("block")).groupBy("rule").agg(F.max("block").alias("block"))
    blocks = 1 + known.count() // limit
    urls = pages.count()
    out = pages.drop(*[n for n in pages.columns if n in names])
    schema = T.StructType([*out.schema.fields, *[T.StructField(n, T.StringType()) for n in names]])
    for block in range(blocks):
        mine = known.where(F.pmod(F.xxhash64("rule"), F.lit(blocks)) == block).collect()
        split = [(*split_rule(r["rule"]), r["block"]) for r in mine]
        shapes = Shapes.of([(h, p) for h, p, _ in split])
        cascades = []
        for action, wanted in ((ALLOW, False), (BLOCK, True)):
            own = sorted({h + p for h, p, b in split if b == wanted})
            if not own:
                continue
            # Few enough mistakes for a second level of the size of the first, whatever the number of keys.
            universe = max(1, urls) * max(1, shapes.labels + 1) * max(1, len(shapes.lengths))
            first = Bloom(hashed(own), min(0.5, len(own) / (math.sqrt(2) * universe)), 0)
            passing = pages.select(url).mapInArrow(_passing(url, shapes, first), "key string").distinct().toArrow()
            mistakes = sorted(set(passing.column("key").to_pylist()) - set(own))
            cascades.append((action, build(hashed(own), hashed(mistakes), first)))
        out = out.mapInArrow(_judging(url, shapes, cascades, names, block > 0), schema)
    return out
