import hashlib
import random

import pytest

from casewatch.llm.suffix_dedup import Naming, remove_repeats, repeated_windows


def plain(texts, window):
    count = {}
    for t in texts:
        for i in range(len(t) - window + 1):
            count[t[i : i + window]] = count.get(t[i : i + window], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts_of(seed, window):
    r = random.Random(seed)
    base = ["".join(r.choices("ab cdé", k=r.randint(0, 3 * window))) for _ in range(8)]
    texts = [None, "", "ab" * window, base[0], base[0]]
    for _ in range(45):
        if r.random() < 0.2:
            texts.append("xy" * r.randint(0, window))
            continue
        parts = []
        for _ in range(r.randint(0, 3)):
            fresh = "".join(r.choices("efghij ", k=r.randint(0, 2 * window)))
            parts.append(r.choice(base)[r.randint(0, window) :] if r.random() < 0.6 else fresh)
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("window, gram, limit", [(20, 5, None), (20, 5, 40), (200, 40, None)])
def test_same_as_plain_search(spark, window, gram, limit):
    texts = texts_of(window, window)
    rows = [(i if i != 7 else None, t, "kept", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string, k1 int").repartition(3)
    got = sorted(tuple(r) for r in remove_repeats(docs, window=window, gram=gram, limit=limit).fillna(7, ["doc_id"]).collect())
    assert got == [(i, *x) for i, x in enumerate(plain([(t or "").encode() for t in texts], window))]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(docs).count() == 0


def test_long_text_in_parts(monkeypatch):
    r = random.Random(3)
    text = bytes(r.choices(b"ab", k=5_000))
    whole = Naming(200, 40).runs(text)
    monkeypatch.setattr("casewatch.llm.suffix_dedup.PART", 700)
    parts = Naming(200, 40).runs(text)

    def names(runs):
        return [int(n) for _, c, n in zip(*runs) for _ in range(c)]

    assert names(whole) == names(parts) and len(names(whole)) == 4_801


@pytest.mark.parametrize("window", [1, 3, 8, 13, 40])
def test_bucket_refinement(window):
    r = random.Random(window)
    stretches = [bytes(r.choices(b"ab", k=r.randint(0, 90))) for _ in range(40)]
    seen = {}
    for s in stretches:
        for i in range(len(s) - window + 1):
            seen[s[i : i + window]] = seen.get(s[i : i + window], 0) + 1
    want = [len(s) - i >= window and seen[s[i : i + window]] > 1 for s in stretches for i in range(len(s))]
    assert repeated_windows(stretches, window).tolist() == want
