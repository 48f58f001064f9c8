import numpy as np

from casewatch.llm import lm_score as lm


def test_chances_add_up_and_slopes_are_right():
    net = lm.Network()
    ids, places = lm.joined([np.array([5, 6, 7, 8], np.int32)])
    total = sum(np.exp(net.log_probability(np.r_[ids[:3], v, ids[4:]].astype(np.int32), places[1:2]))[0] for v in range(lm.SIZE))
    assert abs(total - 1) < 1e-4


def test_training_learns_order():
    rng = np.random.default_rng(0)
    texts = [np.array([1 + (a + i) % 7 for i in range(60)], np.int32) for a in rng.integers(0, 7, 60)]
    net = lm.Network()
    ids, places = lm.joined(texts)
    before = net.log_probability(ids, places).mean()
    for round_ in range(8):
        lm._fit(net, texts, round_)
    after = net.log_probability(ids, places).mean()
    mixed_ids, mixed_places = lm.joined([rng.permutation(t) for t in texts])
    assert after > before + 3 and after > net.log_probability(mixed_ids, mixed_places).mean() + 0.5


def test_documents(spark):
    texts = [None, "", " \n", "the cat sat on the mat " * 30, "the cat sat on the mat", "mat mat the the sat on cat", "word " * 9_000]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, "the cat", 1)], "doc_id int, text string, n_tokens int").repartition(2)
    rows = {r["doc_id"]: r for r in lm.score(docs).collect()}
    assert len(rows) == 8
    for i, t in enumerate(texts):
        n = len((t or "").split())
        assert rows[i]["n_tokens"] == n
        assert (rows[i]["log_likelihood"] < 0) == (n > 0) and (rows[i]["mean_log_likelihood"] is None) == (n == 0)
    assert lm.score(docs.limit(0)).count() == 0


def test_vocabulary_is_that_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "COUNTED", 2)
    docs = spark.createDataFrame([("b a a",), ("a c B",), (None,)], "text string").repartition(3)
    assert lm.vocabulary(docs) == {b"a": 1, b"b": 2, b"c": 3}
