import numpy as np
import pytest

from casewatch.operators import answers, vectors
from tests.conftest import rows

SCHEMA = "vec_id bigint, embedding array<float>, cell int"


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(150, 6))
    data[100:] = data[0]  # a third of the vectors are copies
    made = [(i, [float(x) for x in v], 0 if i >= 50 else i % 3) for i, v in enumerate(data)]
    return spark.createDataFrame([*made, (900, None, 0), (901, [], 1)], SCHEMA)


def brute_force(points, k, same_cell=False):
    given = [(r["vec_id"], np.array(r["embedding"], dtype=float), r["cell"]) for r in points.collect() if r["embedding"]]
    result = []
    for q, x, c in given:
        scored = [
            (-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6) + 0.0, i)
            for i, y, d in given
            if i != q and (not same_cell or c == d)
        ]
        result += [(q, place, i) for place, (_, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(result)


@pytest.fixture(params=["broadcast", "blocks"])
def way(request, monkeypatch):
    if request.param == "blocks":
        monkeypatch.setattr(vectors, "MAX_BROADCAST_VALUES", 0)
        monkeypatch.setattr(vectors, "QUERY_BLOCK", 40)
        monkeypatch.setattr(vectors, "VECTOR_BLOCK", 30)
    monkeypatch.setattr(vectors, "SLICE", 16)


def test_exact(points, way):
    found = rows(vectors.nearest_names_exact(points, points, 5, other_id_only=True).drop("similarity"))
    assert sorted(found) == brute_force(points, 5)


def test_given_cells(points, way):
    found = rows(vectors.nearest_names_in_cells(points, points, 4, other_id_only=True).drop("similarity"))
    assert sorted(found) == brute_force(points, 4, same_cell=True)


def test_approximate_recall_and_share(points):
    exact = vectors.nearest_names_exact(points, points, 5)
    approx = vectors.nearest_names_approx(points, points, 5, cells=4, probes=2)
    recall = [r["recall"] for r in answers.retrieval_recall_at_k(approx, exact).collect()]
    assert len(recall) == 150 and sum(recall) / len(recall) > 0.7
    everything = vectors.nearest_names_approx(points, points, 5, cells=4, probes=4)
    assert sorted(rows(everything)) == sorted(rows(exact))
    [(candidates, possible, share)] = rows(vectors.candidate_share(*vectors.assign_cells(points, points, 4, 2)))
    assert possible == 300 * 150 and 0 < share == candidates / possible


def test_no_queries(spark, points):
    assert rows(vectors.nearest_names_exact(spark.createDataFrame([], SCHEMA), points, 5)) == []


def test_task_code_needs_no_package_on_executors(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "code").write_bytes(cloudpickle.dumps(vectors._Best))
    text = "import pickle; best = pickle.load(open('code', 'rb')); import numpy as np; print(best(np.arange(1), np.ones((1, 1)), 1, False).k)"
    done = subprocess.run([sys.executable, "-c", text], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == "1", done.stderr


@pytest.mark.parametrize("step", [1, 7, 512])
def test_scores_held_at_a_time_do_not_grow_with_the_queries(points, monkeypatch, step):
    monkeypatch.setattr(vectors, "QUERY_STEP", step)
    monkeypatch.setattr(vectors, "SLICE", 16)
    largest = []
    plain = np.round
    monkeypatch.setattr(vectors.np, "round", lambda x, digits: largest.append(x.size) or plain(x, digits))
    given = [(r["vec_id"], r["embedding"]) for r in points.collect() if r["embedding"]]
    ids, matrix = np.array([i for i, _ in given]), np.array([v for _, v in given])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    best = vectors._Best(ids, matrix, 5, True)
    best.add(ids, matrix)
    assert max(largest) <= step * 16
    place = np.arange(len(best.rows)) % 5 + 1
    assert sorted(zip(best.query_ids[best.rows].tolist(), place.tolist(), best.ids.tolist())) == brute_force(points, 5)
