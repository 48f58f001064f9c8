import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewatch.llm import quality as q
from casewatch.llm.queries import QUERIES


def test_equal_texts_and_words_have_equal_buckets():
    assert q.buckets(None).tolist() == q.buckets(b"").tolist() == q.buckets(b" \n").tolist() == []
    assert len(q.buckets(b"word")) == 2 and len(q.buckets(b"one Two")) == 5
    assert set(q.buckets(b"idiot")) & set(q.buckets(b"an Idiot! said"))
    many = q.buckets("x ".encode() * 100_000)
    assert len(many) < 30


@pytest.mark.parametrize("seed", range(4))
def test_best_cut_is_the_best(seed):
    r = random.Random(seed)
    weights = np.array([r.choice([-9.0, -5.0, -2.0, -1.0, 0.0]) for _ in range(60)])
    good = np.array([w + r.gauss(0, 3) > -3 for w in weights])

    def value(cut):
        return (weights[good] > cut).mean() + (weights[~good] <= cut).mean()

    best = max(value(c) for c in [-math.inf, *weights])
    assert abs(value(q.best_cut(weights, good)) - best) < 1e-12
    assert q.best_cut(weights, np.ones(60, bool)) == q.best_cut(np.empty(0), np.empty(0, bool)) == -math.inf


def test_kth_largest(spark):
    r = random.Random(1)
    values = [r.choice([r.gauss(0, 1), -500.0, 0.25]) for _ in range(400)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 57, 200, 399, 400):
        assert q.kth_largest(rows, "v", k, buffer=4) == sorted(values, reverse=True)[k - 1]


def corpus():
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = [r.choice(words) for _ in range(r.randint(20, 60))]
        kind = i % 6
        if kind == 0:
            for _ in range(4):
                text[r.randrange(len(text))] = r.choice(["idiot", "moron", "scum"])
        if kind == 1:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text), "src", 1.0))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(kind != 1), int(kind == 0)))
    return rows, labels


def test_bad_documents_go_and_good_ones_stay(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, log_weight double").repartition(3)
    told = spark.createDataFrame([*labels, (None, 0, 0), (2, None, None), (2, 1, None)], "doc_id long, quality int, toxic int")
    kept = q.keep_good(docs, told)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    good = [i for i in range(600) if i % 6 > 1]
    assert sum(i in ids for i in good) >= 0.98 * len(good)
    assert sum(i in ids for i in range(600) if i % 6 <= 1) <= 0.02 * 200


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (1, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = q.weigh(docs, none).collect()
    assert sorted(r["log_weight"] for r in rows) == [-math.inf] * 3 + [0.0] and all(r["selected"] for r in rows)
    assert q.weigh(docs.limit(0), none).count() == 0


def plain_ratios(held, sample):
    """Log ratios bucket by bucket, from sets of buckets of all documents with words and of the target's."""
    raw, target = Counter(b for h in held for b in h), Counter(b for h in sample for b in h)
    share = len(sample) / len(held)
    chance = {}
    for b, n in raw.items():
        t = target[b]
        deviance = (t * math.log(t / n / share) if t else 0) + ((n - t) * math.log((n - t) / n / (1 - share)) if n > t else 0)
        chance[b] = math.erfc(math.sqrt(max(deviance, 0)))
    ordered, least, kept = sorted(chance, key=chance.get), 1.0, {}
    for place in range(len(ordered), 0, -1):
        least = min(least, chance[ordered[place - 1]] * len(ordered) / place)
        kept[ordered[place - 1]] = (1 - least) ** 8
    return {b: math.log((target[b] + 0.5) / (n * share + 0.5)) * kept[b] for b, n in raw.items()}


def test_ratios_are_the_plain_ones_and_planted_words_weigh():
    rows, labels = corpus()
    held = [set(q.buckets(t.encode()).tolist()) for _, t, _, _ in rows]
    sample = [held[i] for i, quality, toxic in labels if quality == 1 and toxic == 0]
    raw, target = np.zeros(q.BUCKETS, np.int64), np.zeros(q.BUCKETS, np.int64)
    for counts, sets in ((raw, held), (target, sample)):
        for h in sets:
            counts[list(h)] += 1
    found, want = q.log_ratios(target, len(sample), raw, len(held)), plain_ratios(held, sample)
    assert set(np.flatnonzero(found).tolist()) <= set(want)
    assert max(abs(found[b] - w) for b, w in want.items()) < 1e-9
    assert all(found[q.buckets(w)[0]] < -1 for w in (b"idiot", b"moron", b"scum")) and (found > 0.01).any()


def test_empty_texts_go_first(spark):
    rows, labels = corpus()
    more = [(1000, None, "", 0.0), (1001, "", "", 0.0), (1002, " \n", "", 0.0), (1002, " \n", "", 0.0)]
    docs = spark.createDataFrame([*rows, *more], "doc_id long, text string, weight string, _weight double")
    told = spark.createDataFrame([*labels, (1001, 1, 0)], "doc_id long, quality int, toxic int")
    kept = q.keep_good(docs, told)
    assert kept.columns == docs.columns and kept.where("doc_id >= 1000").count() == 0 and kept.where("weight = 'src'").count() > 300


def test_registered_query_is_the_plain_one(spark, data):
    """Weights from counts over all rows, the cut from held-out labels, and the k largest perturbed weights."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    held = {r["doc_id"]: set(q.buckets((r["text"] or "").encode()).tolist()) for r in docs.collect()}
    ratios, cut = q.fit(docs, labels)
    sample = q.labelled(docs.withColumn("text", F.col("doc_id").cast("string")), labels).collect()
    target = [held[int(r["text"])] for r in sample if r["good"] and not r["held_out"]]
    want = plain_ratios([h for h in held.values() if h], [h for h in target if h])
    assert max(abs(ratios[b] - w) for b, w in want.items()) < 1e-9
    found = QUERIES["op5_quality"](spark, data).collect()
    for r in found:
        assert not held[r["doc_id"]] or abs(r["log_weight"] - sum(want[b] for b in held[r["doc_id"]])) < 1e-6
    assert len({round(r["log_weight"], 3) for r in found}) > 20
    k = sum(r["log_weight"] > cut for r in found)
    assert {r["doc_id"] for r in found if r["selected"]} == {r["doc_id"] for r in sorted(found, key=lambda r: -r["perturbed"])[:k]}


def test_held_out_labels(spark):
    """On the middle tables: bad documents, none of which is in the target model, go and good ones stay."""
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("test tables are not here")
    found = QUERIES["op5_quality"](spark, str(folder)).join(spark.read.parquet(str(folder / "labels.parquet")), "doc_id")
    good = found.where("quality = 1 AND toxic = 0").agg(F.avg(F.col("selected").cast("int"))).first()[0]
    junk = found.where("quality = 0").agg(F.avg(F.col("selected").cast("int"))).first()[0]
    toxic = found.where("toxic = 1").agg(F.avg(F.col("selected").cast("int"))).first()[0]
    assert good >= 0.95 and junk <= 0.2 and toxic <= 0.35, (good, junk, toxic)
