import random
import re

import numpy as np
import pytest

from casewatch.llm import decontaminate as d
from casewatch.llm.fm_index import FMIndex, suffix_array

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(texts, items, window):
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for name, item in items:
            p = words(item)
            size = min(window, len(p))
            for i in range(len(p) - size + 1 if p else 0):
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == p[i : i + size]:
                        hit.update(range(j, j + size))
                        found.add("" if name is None else str(name))
        out.append((len(w), sorted(hit), sorted(found)))
    return out


def case(seed):
    r = random.Random(seed)
    pick = lambda n: " ".join(r.choices(["a", "B", "cé", "d1", "ı", "E.", "-"], k=n))
    items = [(i, pick(r.randint(0, 8))) for i in range(9)] + [(3, "a a b d1"), (None, "d1 d1 a b"), (77, None), (78, "...")]
    texts = [pick(r.randint(0, 60)) for _ in range(40)] + [None, "", "zz " * 30 + items[0][1] + " zz"]
    return texts, items


@pytest.mark.parametrize("block_bytes, window", [(None, 4), (30, 4), (None, 10)])
def test_same_as_plain_search(spark, block_bytes, window):
    texts, items = case(window)
    docs = spark.createDataFrame([(i, t, 1, ["x"]) for i, t in enumerate(texts)], "doc_id int, text string, n_words int, hit_items array<string>").repartition(2)
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    got = d.mark_contamination(docs, benchmark, window=window, block_bytes=block_bytes).sort("doc_id").collect()
    for row, (n, hit, found) in zip(got, plain(texts, items, window), strict=True):
        spans = [(s["start"], s["end"]) for s in row["hit_spans"]]
        assert (row["n_words"], [i for a, b in spans for i in range(a, b)], row["hit_items"]) == (n, hit, found)


def test_small_shards(spark, monkeypatch):
    texts, items = case(9)
    monkeypatch.setattr(d, "SHARD_WORDS", 10)
    phrases = d.Phrases([(str(i), (t or "").encode()) for i, t in items], 4)
    shard = d.Shard(phrases)
    for t in texts:
        shard.add((t or "").encode())
    assert {k: v[1] for k, v in shard.hits().items()} == {
        i: f for i, (_, _, f) in enumerate(plain(texts, [(str(i), t) for i, t in items], 4)) if f
    }


def test_removal(spark):
    docs = spark.createDataFrame([(1, "Before, one TWO three four. After", 33), (2, None, None), (3, "clean", 5)], "doc_id int, text string, n_chars long")
    benchmark = spark.createDataFrame([(1, "one two three four")], "item_id int, text string")
    got = d.remove_contamination(docs, benchmark).sort("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "Before, . After", 15), (2, None, None), (3, "clean", 5)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    none = spark.createDataFrame([], "item_id int, text string")
    assert d.mark_contamination(docs, none).first()["n_words"] == 3
    assert d.mark_contamination(docs.limit(0), none).count() == 0


def test_index_finds_and_locates_all():
    r = random.Random(4)
    runs = [[r.randint(1, 5) for _ in range(r.randint(1, 40))] for _ in range(30)]
    text = np.array([x for run in runs for x in [*run, 0]], np.int32)
    order = suffix_array(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    index = FMIndex(text, 5)
    phrases = np.array([[a, b, c] for a in range(1, 6) for b in range(1, 6) for c in range(1, 6)])
    low, high = index.search(phrases, np.full(len(phrases), 3))
    for p, a, b in zip(phrases.tolist(), low.tolist(), high.tolist()):
        want = [i for i in range(len(text) - 2) if text[i : i + 3].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
