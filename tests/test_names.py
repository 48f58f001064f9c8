import random
import re
from collections import Counter

import pytest

from casewatch.operators import names
from casewatch.plans import sizing, skew
from tests.conftest import rows


@pytest.mark.parametrize("small", [True, False])
def test_mentions_are_whole_words_of_any_length(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(skew, "MAX_KEY_PRODUCT", 1)
    texts = spark.createDataFrame(
        [
            (1, "Aspirin, aspirin and  VITAMIN-D 3 daily."),
            (2, "No aspirins; codeine phosphate/paracetamol tablet here"),
            (3, None),
            (4, ""),
            (5, "aspirin " * 50),
        ],
        "doc_id bigint, text string",
    )
    known = spark.createDataFrame(
        [("aspirin",), ("Vitamin D 3",), ("vitamin d",), ("codeine phosphate paracetamol tablet",), (None,), ("--",)],
        "drug_name string",
    )
    assert sorted(rows(names.extract_mentions(texts, known))) == [
        (1, "Vitamin D 3", 1),
        (1, "aspirin", 2),
        (1, "vitamin d", 1),
        (2, "codeine phosphate paracetamol tablet", 1),
        (5, "aspirin", 50),
    ]


def test_an_empty_dictionary_finds_nothing(spark):
    texts = spark.createDataFrame([(1, "aspirin")], "doc_id bigint, text string")
    assert rows(names.extract_mentions(texts, spark.createDataFrame([], "drug_name string"))) == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("limit", [1, 2])
def test_fuzzy_finds_every_name_within_the_distance(spark, limit):
    rng = random.Random(limit)
    known = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(60)})
    asked = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(30)} | {"x", "ä€b"})
    found = rows(
        names.normalize_names_fuzzy(
            spark.createDataFrame([(f" {a.upper()} ",) for a in asked] + [(None,)], "name string"),
            spark.createDataFrame([(k,) for k in known] + [(None,), ("",)], "drug_name string"),
            k=3,
            max_distance=limit,
        )
    )
    expected = []
    for a in asked:
        near = sorted((edits(a, k), k) for k in known if edits(a, k) <= limit)[:3]
        expected += [(a, place, k, d) for place, (d, k) in enumerate(near, 1)]
    assert sorted(found) == sorted(expected)


@pytest.mark.parametrize("block", [2_048, 4])
def test_fuzzy_finds_the_closest_names_however_far(spark, block, monkeypatch):
    monkeypatch.setattr(names, "BLOCK", block)
    rng = random.Random(7)
    known = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(40)} | {"y" * 300})
    asked = ["abc", known[3], known[9] + "x", "zzzzzzzzzz", "crimson dish", "y" * 290, ""]
    found = rows(
        names.normalize_names_fuzzy(
            spark.createDataFrame([(a,) for a in asked] + [(None,)], "name string"),
            spark.createDataFrame([(k,) for k in known], "drug_name string"),
            k=4,
        )
    )
    expected = []
    for a in asked:
        closest = sorted((edits(a, k), k) for k in known)[:4]
        expected += [(a, place, k, d) for place, (d, k) in enumerate(closest, 1)]
    assert sorted(found) == sorted(expected)
    few = spark.createDataFrame([("one",), ("two",)], "drug_name string")
    assert len(rows(names.normalize_names_fuzzy(spark.createDataFrame([("a",)], "name string"), few, k=4))) == 2
    assert rows(names.normalize_names_fuzzy(spark.createDataFrame([("a",)], "name string"), few.limit(0), k=4)) == []


def spans_of(tokens, name):
    return sum(tokens[i : i + len(name)] == name for i in range(len(tokens) - len(name) + 1))


@pytest.mark.parametrize("small", [True, False])
def test_anchored_mentions_are_those_of_a_plain_loop(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(skew, "MAX_KEY_PRODUCT", 20)
    rng = random.Random(3)
    vocabulary = ["a", "b", "ab", "acid", "salt", "x1", "été"]
    made = [" ".join(rng.choices(vocabulary, k=n)) for n in (1, 1, 2, 2, 3, 5, 8, 8, 60)]
    dictionary = [*made, "a a", "a a a", "Acid  Salt", "never there", "", " - ", None]
    texts = [(i, rng.choice([" ", ", ", "-"]).join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 80])))) for i in range(60)]
    texts += [(i, f"x {made[8]} y {made[5]}") for i in range(3)] + [(100, None), (101, ""), (None, "a a a a")]
    given = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = names.extract_mentions_anchored(given, spark.createDataFrame([(n,) for n in dictionary], "drug_name string"))
    want = Counter()
    for key, text in texts:
        tokens = re.findall(r"[^\W_]+", (text or "").lower())
        for name in {n for n in dictionary if n}:
            if (wanted := re.findall(r"[^\W_]+", name.lower())) and (n := spans_of(tokens, wanted)):
                want[key, name] += n
    assert {(r["doc_id"], r["drug_name"]): r["mention_count"] for r in found.collect()} == want


@pytest.mark.parametrize("at_once", [1, 7, 500_000])
@pytest.mark.parametrize("extract", [names.extract_mentions, names.extract_mentions_anchored])
def test_texts_are_looked_through_where_they_are_read(spark, monkeypatch, extract, at_once):
    monkeypatch.setattr(names, "WORDS_AT_ONCE", at_once)
    dictionary = ["a", "A", "a b", "b a b", "b b b b", "c a", "never", None, ""]
    texts = [(1, "a b a b"), (1, "b a"), (2, "b b b b b"), (3, "c"), (4, "a"), (None, "c a"), (5, None), (6, "- -")]
    given = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    found = extract(given, spark.createDataFrame([(n,) for n in dictionary], "drug_name string"))
    want = Counter()
    for key, text in texts:
        tokens = re.findall(r"[^\W_]+", (text or "").lower())
        for name in {n for n in dictionary if n}:
            if n := spans_of(tokens, name.lower().split()):
                want[key, name] += n
    assert {(r["doc_id"], r["drug_name"]): r["mention_count"] for r in found.collect()} == want
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "Generate" not in text and "collect_list" not in text
