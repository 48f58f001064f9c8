import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewatch.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    counted = [(key, Counter(terms(text))) for key, text in docs if terms(text)]
    number, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for key, c in counted:
            m = 50 + 50 * sum(c.values()) * number // total
            score = sum(
                math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                for t in wanted
                if t in c
            )
            if score > 0:
                scored.append((-score, key is None, key))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, n + 1, key, -score) for n, (score, _, key) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Été", "été", "it's", "İx", "naïve", "ab cd", "12"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 3, 8, 30, 200])))) for i in range(150)]
    docs += [(200 + i, "w1 w2 w3 w1") for i in range(40)]
    docs += [(7, docs[7][1]), (None, "w1 w2 w3 w1"), (None, "w9"), (300, None), (301, ""), (302, " .-! ")]
    items = [(f"q{i}", " ".join(rng.choices(words, k=rng.choice([1, 4, 12])))) for i in range(25)]
    items += [("q1", "W3 w3 w5"), (None, "w2 w4"), ("none", None), ("odd", "nowhere"), ("blank", "--")]
    return docs, items


@pytest.mark.parametrize("postings, block_items", [(None, None), (60, 4)])
def test_same_as_scoring_every_document(spark, texts, monkeypatch, postings, block_items):
    docs, items = texts
    if postings:
        monkeypatch.setattr(ranked_search, "PART_TERMS", 700)
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, score string, rank int").repartition(3)
    asked = spark.createDataFrame([(*i, 5) for i in items], "item_id string, text string, doc_id long")
    index = ranked_search.build_index(table, block_postings=postings)
    assert index.blocks.where("term IS NULL").select(F.sum(F.size("ids"))).first()[0] == index.documents
    found = ranked_search.search(index, asked, 6, block_items=block_items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(docs, items, 6)


def test_empty_tables(spark, texts):
    docs = spark.createDataFrame(texts[0], "doc_id long, text string")
    items = spark.createDataFrame(texts[1], "item_id string, text string")
    assert ranked_search.rank_documents(docs.limit(0), items).count() == 0
    assert ranked_search.rank_documents(docs, items.limit(0)).count() == 0
    assert ranked_search.rank_documents(docs.where("doc_id > 299"), items).count() == 0


def test_strata_that_cannot_qualify_are_not_visited():
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(50, 90, 4_000)).astype(np.int64)
    counts = [rng.random(4_000) < share for share in (0.5, 0.02, 0.3)]
    places, tfs, cuts = [], [], [0]
    for held in counts:
        mine = np.flatnonzero(held)
        tf = rng.integers(1, 4, len(mine))
        order = np.lexsort((-tf, lengths[mine]))
        places.append(mine[order])
        tfs.append(tf[order])
        cuts.append(cuts[-1] + len(mine))
    weights = np.array([700, 5_000, 1_200])
    block = ranked_search.Block(lengths, np.array(cuts), np.concatenate(places), np.concatenate(tfs), weights)
    every = np.zeros(4_000, np.int64)
    for held, tf, weight in zip(places, tfs, weights):
        every[held] += weight * ((1_000_000_000 * tf) // (1_000 * tf + 20 * lengths[held]))
    found, scores, visited = block.best(np.arange(3), 10, np.arange(4_000))
    want = np.lexsort((np.arange(4_000), -every))[:10]
    assert found.tolist() == want.tolist() and scores.tolist() == every[want].tolist()
    assert visited < len(np.unique(lengths))
