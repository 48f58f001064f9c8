import pytest

from casewatch.operators import answers, batch, reports
from casewatch.plans import sizing, skew
from casewatch.streaming import requests as streaming
from tests.conftest import rows
from tests.small_cases import tables

REQUESTS = [
    ("r1", "top", " Aspirin", None, None, None),
    ("r2", "top", "aspirin", None, "ignored", None),
    ("r3", "pair", "warfarin", "aspirin", None, None),
    ("r4", "segment", "aspirin", None, "Adult", "F"),
    ("r5", "segment", "aspirin", None, None, "F"),
    ("r6", "segment", "aspirin", None, "Adult", None),
    ("r7", "segment", "aspirin", None, None, None),
    ("r8", "severe", "aspirin", None, None, None),
    ("r9", "top", None, None, None, None),
    ("r10", "top", "unknown", None, None, None),
    ("r11", "pair", "aspirin", None, None, None),
    *[(f"many{i}", "top", "warfarin", None, None, None) for i in range(40)],
]


@pytest.fixture(scope="module")
def t(spark):
    return tables(spark)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(REQUESTS, streaming.REQUEST_SCHEMA)


def expected(t):
    trimmed = {"k": 3, "trim": True}
    one = lambda df: [tuple(r) for r in df.collect()]
    top = one(reports.top_side_effects(t.drug, t.reac, "aspirin", **trimmed))
    segment = lambda age, sex: one(
        reports.side_effect_by_demographics(t.drug, t.reac, t.demographics, "aspirin", age, sex, **trimmed)
    )
    wanted = {
        ("r1", "top"): top,
        ("r2", "top"): top,
        ("r3", "pair"): one(reports.drug_pair_interactions(t.drug, t.reac, "warfarin", "aspirin", **trimmed)),
        ("r4", "segment"): segment("Adult", "F"),
        ("r5", "segment"): segment(None, "F"),
        ("r6", "segment"): segment("Adult", None),
        ("r7", "segment"): segment(None, None),
        **{(f"many{i}", "top"): [("Bleeding", 1)] for i in range(40)},
    }
    found = [(r, kind, place, effect, None, n) for (r, kind), best in wanted.items() for place, (effect, n) in enumerate(best, 1)]
    severe = one(reports.severe_side_effects(t.drug, t.reac, t.outcome, "aspirin", **trimmed))
    found += [("r8", "severe", place, effect, code, n) for place, (effect, code, n) in enumerate(severe, 1)]
    return sorted(found, key=repr)


def test_requests(t, asked, monkeypatch):
    wanted = expected(t)
    found = rows(answers.answer_requests(t.drug, t.reac, t.outcome, t.demographics, asked, k=3))
    assert sorted(found, key=repr) == wanted
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "MAX_KEY_PRODUCT", 3)
    found = rows(answers.answer_requests(t.drug, t.reac, t.outcome, t.demographics, asked, k=3))
    assert sorted(found, key=repr) == wanted


@pytest.mark.parametrize("small", [True, False])
def test_stream_of_requests(spark, t, asked, tmp_path, small, monkeypatch):
    if not small:
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
    base = str(tmp_path)
    table = answers.answer_table(t.drug, t.reac, t.outcome, t.demographics, asked, k=3)
    assert table.columns == list(answers.ANSWER_COLUMNS)
    table.write.parquet(f"{base}/answers")
    stored = spark.read.parquet(f"{base}/answers")
    streaming.split_requests(asked.filter("request_id not like 'many%'"), f"{base}/inbox", 3)
    for late in (False, True):  # the second run only sees the files that came later
        if late:
            streaming.split_requests(asked.filter("request_id like 'many%'"), f"{base}/inbox", 2)
        stream = streaming.read_request_stream(spark, f"{base}/inbox", files_per_batch=2)
        answered = streaming.answer_requests_stream(stream, stored)
        streaming.start_answers(answered, f"{base}/outbox", f"{base}/state").awaitTermination()
    assert sorted(rows(spark.read.parquet(f"{base}/outbox")), key=repr) == expected(t)


def test_last_turn_and_system_turn(spark):
    talk = spark.createDataFrame(
        [(1, 0, "user", "hi", []), (1, 1, "assistant", "", ["f"]), (2, 0, "user", "yo", None), (2, 1, "assistant", "ok", [])],
        "conv_id bigint, turn bigint, role string, text string, tool_calls array<string>",
    )
    assert sorted(rows(answers.last_turn(talk))) == [(1, 1, "assistant", "", True), (2, 1, "assistant", "ok", False)]
    with_system = answers.with_system_turn(talk, "be brief")
    assert with_system.count() == 6
    assert sorted(rows(with_system.filter("turn < 0"))) == [(1, -1, "system", "be brief"), (2, -1, "system", "be brief")]


def test_fact_recall(spark):
    wanted = spark.createDataFrame(
        [("q1", ["Dyspnoea", "Pain", "pain"]), ("q2", ["Rash"]), ("q3", ["Diarrhea", "Nausea"])],
        "question_id string, expected_facts array<string>",
    )
    given = spark.createDataFrame(
        [("q1", "Reports of DYSPNOEA"), ("q1", "nothing else"), ("q1", "more"), ("q3", "diarrhoea and nausea")],
        "question_id string, answer string",
    )
    assert sorted(rows(answers.expected_fact_recall(given, wanted))) == [("q1", 2, 1, 0.5), ("q2", 1, 0, 0.0), ("q3", 2, 1, 0.5)]
    spelled = spark.createDataFrame([("diarrhea", "Diarrhoea")], "fact string, synonym string")
    assert ("q3", 2, 2, 1.0) in rows(answers.expected_fact_recall(given, wanted, synonyms=spelled))


def test_fact_recall_keeps_every_question(spark):
    wanted = spark.createDataFrame(
        [("q1", ["Pain", None]), ("q1", ["pain", "Rash"]), ("q2", []), ("q3", None), ("q4", [None])],
        "question_id string, expected_facts array<string>",
    )
    given = spark.createDataFrame([("q1", "pain"), ("q2", "rash")], "question_id string, answer string")
    assert sorted(rows(answers.expected_fact_recall(given, wanted))) == [
        ("q1", 2, 1, 0.5),
        ("q2", 0, 0, None),
        ("q3", 0, 0, None),
        ("q4", 0, 0, None),
    ]


def test_every_question_of_the_evaluation_kind_has_a_report(t):
    """Five most reported, pairs, one sex, comparison of drugs and one reaction are parameters, not code."""
    assert len(rows(reports.top_side_effects(t.drug, t.reac, "aspirin", k=5))) == 5
    assert rows(batch.top_side_effects_by_drug(t.drug, t.reac, 1))
