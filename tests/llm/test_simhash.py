import random

import numpy as np
import pytest
import xxhash

from casewatch.llm import simhash
from casewatch.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, bits):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    r = random.Random(1)
    for _ in range(60):
        text = "".join(r.choices(["A", "b", "é", " ", "\t", "\n", "\x0b", " ", "."], k=r.randint(0, 80)))
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \t") == 0


def test_pairs_are_those_of_a_full_comparison():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(12)]))
    block = np.zeros(len(values), np.int64)
    got = {tuple(sorted((int(a), int(b)))) for i, j in simhash.linked_pairs(block, values, 4, simhash.pivots()) for a, b in zip(i, j)}
    want = {(i, j) for j in range(len(values)) for i in range(j) if bin(int(values[i] ^ values[j])).count("1") <= 4}
    assert got == want and want


@pytest.mark.parametrize("tile", [None, 5])
def test_groups_of_near_fingerprints(spark, tile):
    r = random.Random(2)
    values = []
    for _ in range(12):
        v = r.getrandbits(64)
        values.append(v)
        for _ in range(r.randint(0, 6)):  # chains, so that some are reached over others only
            v ^= 1 << r.randint(0, 63) | 1 << r.randint(0, 63) | 1 << r.randint(0, 63)
            values.append(v)
    near = r.getrandbits(64)
    values = list(dict.fromkeys([*values, 0, *[near ^ (1 << b) for b in range(40)]]))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), 4, tile)
    found = {r["node"]: r["root"] for r in components(links).collect()}
    want = groups(values, 4)
    first = {}
    for v, w in zip(signed, want):
        first[w] = min(first.get(w, v), v)
    assert {v: found.get(v, v) for v in signed} == {v: first[w] for v, w in zip(signed, want)}


def test_documents(spark):
    texts = ["a b c d e f", "A B c d e f", None, "", "  ", "other words are in here", "a b c d e f", "solo"]
    ids = [5, 3, 9, 8, 10, 1, 5, None]
    rows = [(i, t, 7, "x") for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int, root string")
    values = [plain_fingerprint(t) for t in texts]
    want = []
    for i, v, g in zip(ids, values, groups(values, 4)):
        own = [x for x, h in zip(ids, groups(values, 4)) if h == g and x is not None]
        want.append((i, v - (1 << 64) if v >> 63 else v, min(own, default=None)))
    got = [tuple(r) for r in simhash.simhash_groups(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted({w[2] or -1 for w in want})


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


def test_registered_query(spark, data):
    from casewatch.llm.queries import QUERIES

    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    values = [plain_fingerprint(r["text"]) for r in rows]
    want = groups(values, 4)
    least = {}
    for r, g in zip(rows, want):
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op2_simhash"](spark, data).collect()}
    assert got == {(r["doc_id"], f"{v:016x}", least[g]) for r, v, g in zip(rows, values, want)}
