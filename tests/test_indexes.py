import random

import numpy as np
import pytest

from casewatch.operators import answers, name_index, vector_index, vectors
from casewatch.plans import sizing, skew
from tests.conftest import rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def dictionary():
    rng = random.Random(4)
    names = {"".join(rng.choices("abcde", k=rng.choice([1, 2, 5, 9, 14, 30]))) for _ in range(120)}
    names |= {"aaaaaaaaaa", "aaaaaaaaaaaa", "long " + "xyz" * 98, "long " + "xyz" * 97 + "xya", "Ärzte", "é́"}
    return sorted(names)


@pytest.fixture(scope="module")
def asked(dictionary):
    rng = random.Random(6)
    made = {"", "q", "aaaaaaaaaaa", "long " + "xyz" * 97}
    for name in rng.sample(dictionary, 40):
        letters = list(name)
        for _ in range(rng.choice([0, 1, 2, 3])):
            letters[rng.randrange(len(letters)) if letters else 0 : rng.randrange(len(letters) + 1)] = rng.choice(["", "x", "ab"])
        made.add("".join(letters).strip().lower())
    return sorted(made)


def stored(spark, names, folder):
    given = [*names, names[0].upper(), f"  {names[1]} ", None, "", " "]
    name_index.write_name_index(spark.createDataFrame([(n,) for n in given], "drug_name string"), folder)
    return name_index.read_name_index(spark, folder)


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("k, radius", [(3, None), (None, 3), (2, 5)])
def test_closest_names(spark, tmp_path, dictionary, asked, small, k, radius, monkeypatch):
    if not small:
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(skew, "MAX_KEY_PRODUCT", 40)
    index = stored(spark, dictionary, str(tmp_path / "names"))
    table = spark.createDataFrame([(n,) for n in [*asked, None, f" {asked[3]} "]], "name string")
    found = name_index.normalize_names_indexed(table, index, k, radius)
    known = {n.strip().lower() for n in dictionary}
    want = []
    for name in asked:
        near = sorted((d, n) for n in known if (d := distance(name, n)) <= (radius if radius is not None else 1_000))
        want += [(name, place, n, d) for place, (d, n) in enumerate(near[:k], 1)]
    assert sorted(rows(found)) == sorted(want)


def test_empty_dictionary(spark, tmp_path):
    none = spark.createDataFrame([], "drug_name string")
    name_index.write_name_index(none, str(tmp_path / "names"))
    index = name_index.read_name_index(spark, str(tmp_path / "names"))
    assert name_index.normalize_names_indexed(spark.createDataFrame([("a",)], "name string"), index).count() == 0


def test_rare_pieces_prune(spark, tmp_path):
    """Of names that all share common pieces only those with a rare one in common are compared."""
    rng = random.Random(8)
    names = ["hydrochloride " + "".join(rng.choices("abcdefghijklmnop", k=12)) for _ in range(300)]
    index = stored(spark, names, str(tmp_path / "names"))
    name = spark.createDataFrame([(names[7][:-1] + "z",)], "name string")
    asked = name_index._by_rarity(name_index._exploded(name, "name"), index.counts, "name")
    first = asked.where("rarity <= 7").join(index.entries.where("rarity <= 7").drop("rarity", "length", "place"), "piece")
    assert 0 < first.select("drug_name").distinct().count() < 30
    assert rows(name_index.normalize_names_indexed(name, index, 1)) == [(names[7][:-1] + "z", 1, names[7], 1)]


SCHEMA = "vec_id bigint, embedding array<float>"


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(700, 24))
    data[400:500] = data[0]
    made = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame([*made, (900, None), (901, [])], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def index(spark, points, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    vector_index.write_index(points, folder, cells=8, parts=5)
    return vector_index.read_index(spark, folder)


def test_every_vector_is_indexed_and_nothing_is_learnt_again(spark, points, index, monkeypatch):
    assert {r[0] for r in index.vectors.select("id").collect()} == set(range(700))
    monkeypatch.setattr(vector_index, "_groups", None)
    found = vector_index.search_index(index, points.where("vec_id < 30"), 5, probes=8, rerank=700)
    assert found.count() == 150


@pytest.mark.parametrize("blocks", [False, True])
def test_with_all_cells_and_candidates_it_is_exact(points, index, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(vector_index, "QUERY_BLOCK", 7)
        monkeypatch.setattr(vector_index, "VECTOR_BLOCK", 20)
        monkeypatch.setattr(vector_index, "STEP", 3)
    asked = points.where("vec_id % 7 = 0")
    found = vector_index.search_index(index, asked, 6, probes=8, rerank=1_000, other_id_only=True)
    assert sorted(rows(found)) == sorted(rows(vectors.nearest_names_exact(asked, points, 6, other_id_only=True)))


def test_recall_on_few_vectors_read(points, index):
    asked = points.where("vec_id % 5 = 1 AND vec_id < 400")
    report = vector_index.index_recall(index, asked, 10, probes=7, rerank=120, other_id_only=True).first()
    assert report["recall"] >= 0.9 and report["read_share"] <= 0.25
    found = vector_index.search_index(index, asked, 10, probes=7, rerank=120, other_id_only=True)
    exact = vectors.nearest_names_exact(asked, points, 10, other_id_only=True)
    shares = [r["recall"] for r in answers.retrieval_recall_at_k(found, exact).collect()]
    assert abs(sum(shares) / len(shares) - report["recall"]) < 1e-9


def test_empty_index(spark, tmp_path, points):
    vector_index.write_index(points.limit(0), str(tmp_path / "none"))
    none = vector_index.read_index(spark, str(tmp_path / "none"))
    assert vector_index.search_index(none, points).count() == 0
