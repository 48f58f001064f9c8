import pytest

from casewatch.operators import answers, batch, questions, severity
from casewatch.operators.counts import by_outcome, hot_cases
from casewatch.plans import skew
from tests.conftest import rows
from tests.small_cases import skewed, tables


def everyone(drug):
    """Cases with two age groups, one twice, with unknown values, and with none."""
    cases = sorted({d[0] for d in drug})
    people = [(c, "A", "F", "70", "YR") for c in cases[::2]] + [(c, "B", None, "20", "YR") for c in cases[::3]]
    return people + people[:5] + [(cases[0], None, "M", "x", "YR")]


@pytest.fixture(scope="module")
def t(spark):
    drug, reac, outcome, _ = skewed(11)
    return tables(spark, drug, reac, outcome, everyone(drug))


def some(df, *columns):
    return sorted(rows(df.select(*columns)), key=repr)


@pytest.mark.parametrize("most", [3, 10_000_000])
def test_one_join_gives_the_counts_of_three_reports(t, monkeypatch, most):
    drugs = t.drug.select("drugname").selectExpr("drugname AS drug").distinct()
    monkeypatch.setattr(skew, "MAX_KEY_PRODUCT", most)
    hot = hot_cases(t.drug, t.reac, demographics=t.demographics)
    assert (hot.keys is not None) == (most == 3)
    counted = batch.report_counts(t.drug, t.reac, t.outcome, t.demographics, drugs, hot).cache()
    monkeypatch.undo()
    overall = counted.groupBy("drug", "side_effect").sum("report_count", "DE", "LT", "HO", "DS").toDF("drug", "side_effect", "report_count", "DE", "LT", "HO", "DS")
    names = ("drug", "side_effect", "report_count")
    assert some(overall, *names) == some(batch.top_side_effects_by_drug(t.drug, t.reac, None, drugs), *names)
    names = ("drug", "side_effect", "outcome_code", "report_count")
    severe = batch.severe_side_effects_by_drug(t.drug, t.reac, t.outcome, None, drugs)
    assert some(by_outcome(overall), *names) == some(severe, *names) != []
    names = ("drug", "age_grp", "sex", "side_effect", "report_count")
    inside = counted.where("in_segment > 0").drop("report_count").withColumnRenamed("in_segment", "report_count")
    assert some(inside, *names) == some(batch.side_effects_by_segment(t.drug, t.reac, t.demographics, None, drugs), *names) != []


def test_pair_counts_are_those_of_both_pair_reports(spark, t):
    pairs = [("d0", "d1", None, None), ("d1", "d0", 30.0, None), ("d0", "d2", None, "F"), ("d0", "d2", None, None)]
    asked = spark.createDataFrame(pairs, "drug1 string, drug2 string, age_over double, sex string")
    counted = severity.pair_segment_counts(t.drug, t.reac, t.outcome, t.demographics, asked)
    plain = batch.pair_interactions_for(t.drug, t.reac, asked.where("age_over IS NULL AND sex IS NULL"), None)
    plain = plain.withColumnsRenamed({"shared_side_effect": "side_effect", "shared_report_count": "report_count"})
    names = ("drug1", "drug2", "side_effect", "report_count")
    assert some(counted.where("age_over IS NULL AND sex IS NULL"), *names) == some(plain, *names) != []
    one = severity.severe_pair_by_segment(t.drug, t.reac, t.outcome, t.demographics, "d1", "d0", 30)
    mine = severity.best_of_segments(counted.where("age_over = 30"), ["drug1", "drug2"], 10, True).orderBy("rank")
    assert rows(mine.select("side_effect", "outcome_code", "report_count")) == rows(one) != []


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_finished_answers_are_read_not_made_again(spark, t):
    requests = [("a", "top", "d0", None, None, None), ("b", "segment", "d0", None, "A", None), ("c", "pair", "d0", "d1", None, None)]
    asked = spark.createDataFrame(requests, "request_id string, kind string, drug string, drug2 string, age_group string, sex string")
    table = answers.answer_table(t.drug, t.reac, t.outcome, t.demographics, asked)
    assert joins(table) == 0 and table.count() > 0
    # The request for one age group is not answered for others.
    assert {(r["any_age"], r["age_group"], r["any_sex"]) for r in table.where("kind = 'segment'").collect()} == {(False, "A", True)}
    slots = spark.createDataFrame([("a", "top", ["d0"], None, None, None, 5)], "request_id string, kind string, drugs array<string>, effect string, age_over double, sex string, k int")
    found = questions.answer_slots(t.drug, t.reac, t.outcome, t.demographics, slots)
    assert joins(found) == 0 and found.count() > 0
