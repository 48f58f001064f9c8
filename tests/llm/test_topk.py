import numpy as np
import pytest
from pyspark.sql import functions as F

from casewatch.llm import topk


def plain(rows, k):
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, qv in sorted({(i, tuple(v)) for i, v in whole if i % 5 == 0}):
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in whole if i != q and len(v) == len(qv))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("query_values", [None, 20])
def test_same_as_full_comparison(spark, monkeypatch, query_values):
    rng = np.random.default_rng(3)
    rows = [(i, np.round(rng.normal(0, 0.2, 6), 1).tolist()) for i in range(90)]
    rows += [(90, None), (95, [1.0, None]), (100, [float("nan")] * 6), (101, [float("inf")] * 6), (None, [0.1] * 6), (105, []), (106, []), (110, [0.5]), (115, [0.0] * 6)]
    rows += [(7, rows[7][1]), (10, rows[10][1])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    found = topk.exact_top_k(vectors, F.col("vec_id") % 5 == 0, 4, query_values=query_values)
    want = plain([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows], 4)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert topk.exact_top_k(vectors.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_reading_stops_early_with_whole_results():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-300, 300, (900, 5)) * rng.integers(1, 8, (900, 1))
    ids = np.arange(900)
    lists = topk.Lists(ids, vectors)
    resolved = 0
    for i, found, scores in lists.top(ids[:60], vectors[:60], 5):
        every = vectors @ vectors[i]
        want = sorted((-every[j], j) for j in range(900) if j != i)[:5]
        assert sorted(zip((-scores).tolist(), found.tolist()))[:5] == want
        resolved += len(found)
    assert resolved < 60 * 300
