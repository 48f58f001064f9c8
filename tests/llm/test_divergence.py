import random
import re
from collections import Counter

import numpy as np
import pytest

from casewatch.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, min_docs, k):
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(LOWER)))) for lang, source, text in docs]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for d in docs if d[0] == lang for t in d[2])
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        counts = {}
        for mine, source, found in docs:
            if mine == lang:
                counts.setdefault(source, Counter()).update({t: n for t, n in found.items() if held[t] >= min_docs})
        whole = sum(counts.values(), Counter())

        def share(c):
            total = sum(c.values())
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        shares, usual = {s: share(c) for s, c in counts.items()}, share(whole)

        def apart(p, q):
            return (p - q) * (p - q) // (p + q)

        for source, p in shares.items():
            pairs = [(o, sum(apart(p[t], q[t]) for t in kept)) for o, q in shares.items() if o != source]
            named = [(t, apart(p[t], usual[t])) for t in kept if counts[source][t] and p[t] > usual[t]]
            for part, items, limit in (("pair", pairs, None), ("term", named, k)):
                ranked = sorted(items, key=lambda i: (-i[1], i[0].encode()))[:limit]
                out += [(lang, source, part, item, value, n + 1) for n, (item, value) in enumerate(ranked)]
    return sorted(out)


def made(rng, rows):
    words = ["the", "The", "the,", "a-b", "b", "x1y", "Éa", "éa", "w w", "don't", "日本", *[f"{a}{b}" for a in "klmn" for b in "opqr"]]
    docs = []
    for _ in range(rows):
        mine = rng.choice(["en", "en", "fr", None, ""])
        source = rng.choice(["s1", "s1", "s1", "s2", None, "ü", "z"])
        text = rng.choice([" ", "\n", "\t ", " ; "]).join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.choice([0, 1, 5, 40])))
        docs.append((mine, source, rng.choice([text, text, text, None if rng.random() < 0.1 else text])))
    return docs + [("de", "only", "ein Wort"), ("it", "p", ""), ("it", "q", None)] + docs[:5]


@pytest.mark.parametrize("small", [False, True])
def test_same_as_counting_every_document(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(divergence, "BLOCK_PAIRS", 30)
        monkeypatch.setattr(divergence, "TASK_BITS", 0)
        monkeypatch.setattr(divergence, "ROWS", 7)
        monkeypatch.setattr(divergence, "MERGED", 11)
    docs = made(random.Random(3), 160)
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, source string, text string, rank int, part string").repartition(4)
    found = divergence.divergence(table, min_docs=4, k=3)
    assert sorted(map(tuple, found.collect())) == plain(docs, 4, 3)
    assert dict(found.dtypes)["rank"] == "int"


def test_empty_tables_and_no_terms(spark):
    schema = "lang string, source string, text string"
    assert divergence.divergence(spark.createDataFrame([], schema)).count() == 0
    docs = [("en", "a", None), ("en", "b", "1 2 3"), ("en", None, "rare")]
    found = divergence.divergence(spark.createDataFrame(docs, schema))
    assert sorted(map(tuple, found.collect())) == plain(docs, 10, 10)


def test_payloads_and_large_counts():
    rng = np.random.default_rng(1)
    group = np.sort(rng.integers(0, 1 << 30, 50))
    kept = {}
    for _ in range(400):
        kept[int(rng.integers(0, 60)), int(rng.integers(0, 50))] = int(rng.choice([1, 2, 0x7FFF, 0x8000, 100_000]))
    for c in range(60):
        kept.setdefault((c, 3), 1)
    chunk, doc = (np.array(x) for x in zip(*kept))
    words, ends = divergence._payloads(chunk, doc, np.array(list(kept.values())), group)
    rows, groups, docs, counts = divergence._pairs(words, np.diff(np.concatenate([[0], ends])))
    again = Counter()
    for row, g, d, n in zip(rows.tolist(), groups.tolist(), docs.tolist(), counts.tolist()):
        assert group[d] == g
        again[row, d] += n
    assert again == kept


def test_very_long_texts(spark):
    long = "word Other-" * 40_000
    docs = [("en", "a", long), ("en", "b", "y" * 300_000), ("en", "b", long), ("en", "a", "z" * 300_000)]
    found = divergence.divergence(spark.createDataFrame(docs, "lang string, source string, text string"), min_docs=2)
    assert sorted(map(tuple, found.collect())) == plain(docs, 2, 10)
