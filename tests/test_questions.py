import pytest

from casewatch.operators import questions, severity
from tests import small_cases
from tests.conftest import rows
from tests.small_cases import best, joined_counts, skewed, tables

DRUGS = ["aspirin", "Warfarin", "insulin", "insulin glargine", "ibuprofen"]
EFFECTS = ["Nausea", "Pain", "Term 01", None]
ASKED = {
    "1": "What are the top 5 side effects of ASPIRIN?",
    "2": "Is there an interaction between aspirin and warfarin?",
    "3": "Serious outcomes of aspirin in elderly patients",
    "4": "Common side effects of aspirin in females",
    "5": "Which of aspirin, ibuprofen and warfarin has the most serious events?",
    "6": "side effects of aspirn",
    "7": "Should I stop aspirin because of nausea",
    "8": "severe effects of insulin glargine with aspirin above the age of 70",
    "9": "Hello there",
    "10": "aspirin, warfarin, ibuprofen?",
    "11": "insulin?",
    "12": None,
    "13": "",
    "14": "men over 30 taking aspirin",
}
SLOTS = {
    "1": ("top", ["aspirin"], None, None, None, 5),
    "2": ("pair", ["aspirin", "warfarin"], None, None, None, 10),
    "3": ("severe", ["aspirin"], None, 65.0, None, 10),
    "4": ("segment", ["aspirin"], None, None, "F", 10),
    "5": ("compare", ["aspirin", "ibuprofen", "warfarin"], None, None, None, 10),
    "6": ("top", ["aspirin"], None, None, None, 10),
    "7": ("profile", ["aspirin"], "Nausea", None, None, 10),
    "8": ("severe_pair", ["aspirin", "insulin glargine"], None, 70.0, None, 10),
    "9": (None, [], None, None, None, 10),
    "10": (None, ["aspirin", "ibuprofen", "warfarin"], None, None, None, 10),
    "11": ("top", ["insulin"], None, None, None, 10),
    "12": (None, [], None, None, None, 10),
    "13": (None, [], None, None, None, 10),
    "14": ("segment", ["aspirin"], None, 30.0, "M", 10),
}


@pytest.fixture(scope="module")
def slots(spark):
    asked = spark.createDataFrame(list(ASKED.items()), "request_id string, text string")
    names = [spark.createDataFrame([(n,) for n in given], "name string") for given in (DRUGS, EFFECTS)]
    return questions.question_slots(asked, *names).cache()


def test_slots(slots):
    found = {r["request_id"]: tuple(r)[1:] for r in slots.collect()}
    assert found == SLOTS


def test_every_request_has_rows_or_a_status(spark, slots):
    t = tables(spark)
    found = questions.answer_slots(t.drug, t.reac, t.outcome, t.demographics, slots)
    answers = {}
    for row in sorted(found.collect(), key=lambda r: r["rank"]):
        answers.setdefault(row["request_id"], []).append(row)
    assert [(r["side_effect"], r["report_count"]) for r in answers["1"]][:2] == [("Nausea", 4), ("Pain", 2)]
    assert len(answers["1"]) == 5 and len(answers["6"]) == 10
    assert {r["drug2"] for r in answers["2"]} == {"warfarin"}
    assert [(r["drug"], r["report_count"]) for r in answers["5"]] == [("aspirin", 3), ("ibuprofen", 1), ("warfarin", 0)]
    (profile,) = answers["7"]
    assert (profile["rank"], profile["report_count"]) == (1, 4) and 0 < profile["share"] < 1
    status = {r["request_id"]: r["status"] for r in questions.question_status(slots, found).collect()}
    assert set(status) == set(ASKED)
    assert {k for k, s in status.items() if s == "answered"} == set(answers)
    assert status["9"] == status["12"] == status["13"] == "no_drug" and status["10"] == "too_many_drugs"
    assert status["8"] == status["11"] == "no_reports"


def test_segments_of_a_table_are_those_asked_one_by_one(spark):
    drug, reac, outcome, _ = skewed(9)
    people = [(c, "A", s, a, "YR") for c in {d[0] for d in drug} for s, a in (("F", "70"), ("M", "20"), ("F", "x"))]
    t = tables(spark, drug, reac, outcome, people)
    wanted = [(" D0", 30, "F"), ("d1", None, "M"), ("d1", 10, None), ("d2", None, None), (None, 10, None), ("d0", 30, "F")]
    asked = spark.createDataFrame(wanted, "drug string, age_over int, sex string")
    found = severity.effects_by_segments(t.drug, t.reac, t.demographics, asked, 4, t.outcome)
    for name, age, sex in set(wanted[1:5]) | {("d0", 30, "F")}:
        if name is None:
            continue
        mine = [r for r in found.collect() if (r["drug"], r["age_over"], r["sex"]) == (name, age, sex)]
        if age is not None:
            one = severity.severe_by_segment(t.drug, t.reac, t.outcome, t.demographics, name, age, sex, 4)
            want = [tuple(r) for r in one.collect()]
        else:
            fits = [p for p in people if sex is None or p[2] == sex]
            extra = [[o for o in outcome if o[1] != "OT"], *([[(p[0],) for p in fits]] if sex else [])]
            counts = joined_counts(drug, [r[:2] for r in reac], extra)
            counts = {(d, term, code): n for (d, code, term), n in counts.items() if d == name}
            want = [row[2:] for row in best(counts, 4)]
        got = [(r["side_effect"], r["outcome_code"], r["report_count"]) for r in sorted(mine, key=lambda r: r["rank"])]
        assert got == want, (name, age, sex)


def test_severe_pairs_of_a_table(spark):
    t = tables(spark)
    wanted = [("aspirin", "warfarin", 60, None), ("warfarin", "ASPIRIN ", None, "F"), ("aspirin", "nobody", None, None)]
    asked = spark.createDataFrame(wanted, "drug1 string, drug2 string, age_over int, sex string")
    found = severity.severe_pairs_by_segments(t.drug, t.reac, t.outcome, t.demographics, asked)
    one = severity.severe_pair_by_segment(t.drug, t.reac, t.outcome, t.demographics, "aspirin", "warfarin", 60)
    mine = [(r["side_effect"], r["outcome_code"], r["report_count"]) for r in found.where("age_over = 60").orderBy("rank").collect()]
    assert mine == rows(one) and mine
    assert {r["drug1"] for r in found.where("sex = 'F'").collect()} == {"warfarin"}
    assert small_cases.DRUG
