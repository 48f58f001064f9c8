import re

import pytest

from casewatch.operators import answers, batch
from casewatch.operators.counts import cases_with_both, hot_cases
from casewatch.plans import sizing, skew
from tests.conftest import rows
from tests.small_cases import best, pair_counts, skewed, tables


@pytest.fixture(scope="module")
def t(spark):
    return tables(spark, *skewed())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tiny_tasks(monkeypatch):
    monkeypatch.setattr(skew, "TASK_JOINED", 1)
    monkeypatch.setattr(skew, "task_parts", lambda spark, rows: 3)


REPORTS = {
    "b1_distinct_cases": lambda t: batch.top_side_effects_by_drug(t.drug, t.reac, distinct_cases=True),
    "b2": lambda t: batch.pair_interactions_all(t.drug, t.reac),
    "b2_min_cases": lambda t: batch.pair_interactions_all(t.drug, t.reac, 3, 3),
    "b3": lambda t: batch.side_effects_by_segment(t.drug, t.reac, t.demographics),
    "b4": lambda t: batch.severe_side_effects_by_drug(t.drug, t.reac, t.outcome),
    "a3": lambda t: answers.segment_answers(t.drug, t.reac, t.demographics, 5),
}


@pytest.mark.parametrize("name", REPORTS)
def test_joins_and_counts_take_parts_by_the_rows_they_make(t, name, monkeypatch):
    plain = sorted(rows(REPORTS[name](t)), key=repr)
    monkeypatch.setattr(skew, "TASK_JOINED", 1)
    monkeypatch.setattr(skew, "task_parts", lambda spark, rows: 3)
    dealt = REPORTS[name](t)
    assert plan(dealt).count("REPARTITION_BY_NUM") >= 3
    assert sorted(rows(dealt), key=repr) == plain


def test_check_counts_what_every_join_makes(spark):
    drug = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "k string, drug string")
    reac = spark.createDataFrame([("a", "p"), ("a", "q"), ("a", "r"), ("b", "p")], "k string, side_effect string")
    sides = [skew.Side(drug, ("drug",)), skew.Side(reac, ("side_effect",))]
    found = skew.hot_keys(sides, "k")
    assert found.rows(sides) == 2 * 3 + 1 and found.rows(sides[:1]) == 3


def test_rare_pairs_leave_before_they_meet_reactions(t):
    text = plan(batch.pair_interactions_all(t.drug, t.reac, 3, 3))
    # The kept pairs are used once below the ranking (semi) and never shuffle what is ranked by pair.
    assert "LeftSemi" in text and text.index("WindowGroupLimit") < text.index("LeftSemi")


def test_levels_of_segments_copy_no_rows(t, tiny_tasks):
    assert "Expand" not in plan(answers.segment_answers(t.drug, t.reac, t.demographics, 5))


def test_drugs_of_a_case_move_once_for_all_requests(spark, t):
    named = spark.createDataFrame([("d0", 1, "d0", "d1"), ("d1", 2, "d0", "d1")], "drug string, place int, drug1 string, drug2 string")
    cases = cases_with_both(t.drug, named, ["drug1", "drug2"], hot_cases(t.drug, t.reac))
    assert plan(cases).count("Exchange hashpartitioning(primaryid") == 1


def test_pairs_with_reactions_are_counted_where_they_are_made(t, tiny_tasks):
    text = plan(batch.pair_interactions_all(t.drug, t.reac, 3, 3))
    assert not re.search(r"hashpartitioning\(drug1#\d+, drug2#\d+, side_effect#", text)
    assert re.search(r"hashpartitioning\(side_effect#", text)


@pytest.mark.parametrize("cut, coded, hot", [(True, True, True), (False, False, False)])
def test_pairs_are_those_of_a_plain_loop(t, tiny_tasks, cut, coded, hot, monkeypatch):
    drug, reac = skewed()[:2]
    monkeypatch.setattr(skew, "HEAVY_TASKS", 5 if cut else 10**9)
    if not coded:
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
    if hot:
        monkeypatch.setattr(skew, "MAX_KEY_PRODUCT", 4_000)
    counts, cases = pair_counts(drug, reac)
    enough = {key: n for key, n in counts.items() if cases[key[:2]] >= 2}
    given = batch.pair_interactions_all(t.drug, t.reac, 4, 2)
    assert sorted(rows(given), key=repr) == best(enough, 4, keys=2)


def test_only_values_of_many_rows_are_cut(spark):
    weights = spark.createDataFrame([("a", 5.0), (None, 81.0), ("b", 80.0), ("c", 1e9)], "side_effect string, weight double")
    heavy = skew.heavy_values(weights, ["side_effect"], 10)
    assert sorted(rows(heavy), key=repr) == [("c", skew.MAX_PARTS), (None, 9)]
    assert skew.heavy_values(weights.filter("weight < 50"), ["side_effect"], 10) is None
    given = spark.createDataFrame([(None, ["x", "y", "z"]), ("a", ["x", "y"])], "side_effect string, drugs array<string>")
    dealt = skew.by_value(given, "side_effect", given["drugs"], heavy, 3)
    met = dealt.selectExpr("side_effect", "_cell", "_cells", "explode(drugs) drug").filter(skew.in_cell("drug"))
    assert sorted(rows(met.select("side_effect", "drug")), key=repr) == [("a", "x"), ("a", "y"), (None, "x"), (None, "y"), (None, "z")]
