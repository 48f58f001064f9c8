import pytest

from casewatch.operators import batch, reports
from casewatch.operators.counts import hot_cases
from casewatch.plans import sizing, skew
from tests.conftest import rows
from tests.small_cases import SEVERE, best, joined_counts, pair_counts, skewed, tables


@pytest.fixture(scope="module")
def raw():
    return skewed()


@pytest.fixture(scope="module")
def t(spark, raw):
    return tables(spark, *raw)


@pytest.fixture(params=["one hot case", "all hot"])
def heat(request, monkeypatch):
    """The hottest case or every case treated apart, and cut into many parts."""
    limits = {"one hot case": 2_000, "all hot": -1}
    monkeypatch.setattr(skew, "MAX_KEY_PRODUCT", limits[request.param])
    monkeypatch.setattr(batch, "PAIR_PART_ROWS", 3)
    monkeypatch.setattr(skew.Side.__init__, "__defaults__", ((), None, False, None, 5, 7))
    return request.param


def test_the_check_finds_the_hot_case(t, heat):
    found = hot_cases(t.drug, t.reac).keys
    if heat == "one hot case":
        assert rows(found) == [("c0",)]


def test_no_hot_case(t):
    assert hot_cases(t.drug, t.reac).keys is None


@pytest.mark.parametrize("distinct", [False, True])
def test_by_drug(t, raw, heat, distinct):
    drug, reac, _, _ = raw
    found = rows(batch.top_side_effects_by_drug(t.drug, t.reac, 4, distinct_cases=distinct))
    assert sorted(found, key=repr) == best(joined_counts(drug, reac, distinct=distinct), 4)


@pytest.mark.parametrize("distinct", [False, True])
def test_by_segment(t, raw, heat, distinct):
    drug, reac, _, demographics = raw
    segments = [(case, age, sex) for case, age, sex, *_ in demographics]
    found = rows(batch.side_effects_by_segment(t.drug, t.reac, t.demographics, 3, distinct_cases=distinct))
    assert sorted(found, key=repr) == best(joined_counts(drug, reac, [segments], distinct), 3, keys=3)


@pytest.mark.parametrize("distinct", [False, True])
def test_severe(t, raw, heat, distinct):
    drug, reac, outcome, _ = raw
    severe = [(case, code) for case, code in outcome if code in SEVERE]
    counts = joined_counts(drug, reac, [severe], distinct)
    by_term = {(name, term, code): n for (name, code, term), n in counts.items()}
    found = rows(batch.severe_side_effects_by_drug(t.drug, t.reac, t.outcome, 5, distinct_cases=distinct))
    assert sorted(found, key=repr) == best(by_term, 5)


@pytest.mark.parametrize("min_cases, small", [(1, True), (3, True), (3, False)])
def test_pairs(t, raw, heat, min_cases, small, monkeypatch):
    if not small:
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
    drug, reac, _, _ = raw
    counts, cases = pair_counts(drug, reac)
    expected = [r for r in best(counts, 3, keys=2) if cases[r[:2]] >= min_cases]
    found = rows(batch.pair_interactions_all(t.drug, t.reac, 3, min_cases))
    assert sorted(found, key=repr) == expected


@pytest.mark.parametrize("small", [True, False])
def test_requested_pairs(spark, t, small, monkeypatch):
    if not small:
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(skew, "MAX_KEY_PRODUCT", 30)
    wanted = [("d0", "d1"), ("d2", "d0"), ("d3", "d3"), ("d1", "none"), (None, "d1")]
    pairs = spark.createDataFrame(wanted, "drug1 string, drug2 string")
    found = rows(batch.pair_interactions_for(t.drug, t.reac, pairs, 5))
    for first, second in wanted:
        one = rows(reports.drug_pair_interactions(t.drug, t.reac, first, second, 5))
        assert [r[3:] for r in sorted(found, key=repr) if r[:2] == (first, second)] == one


@pytest.mark.parametrize("small", [True, False])
def test_request_table_gives_the_rows_of_the_full_report(spark, t, small, monkeypatch):
    if not small:
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
    wanted = spark.createDataFrame([("d0",), ("d5",), ("unknown",), (None,)], "drug string")
    full = [r for r in rows(batch.top_side_effects_by_drug(t.drug, t.reac)) if r[0] in ("d0", "d5")]
    assert sorted(rows(batch.top_side_effects_by_drug(t.drug, t.reac, drugs=wanted))) == sorted(full)


def test_batch_rows_of_one_drug_are_its_report(t):
    full = rows(batch.top_side_effects_by_drug(t.drug, t.reac))
    for name in ("d0", "d7"):
        assert [r[2:] for r in sorted(full) if r[0] == name] == rows(reports.top_side_effects(t.drug, t.reac, name))


def test_one_check_serves_several_reports(t, monkeypatch):
    monkeypatch.setattr(skew, "MAX_KEY_PRODUCT", 2_000)
    hot = hot_cases(t.drug, t.reac, t.outcome, t.demographics)
    for run in (
        lambda **more: batch.top_side_effects_by_drug(t.drug, t.reac, **more),
        lambda **more: batch.side_effects_by_segment(t.drug, t.reac, t.demographics, **more),
        lambda **more: batch.severe_side_effects_by_drug(t.drug, t.reac, t.outcome, **more),
    ):
        assert sorted(rows(run(hot=hot)), key=repr) == sorted(rows(run()), key=repr)


def test_asked_names_are_compared_like_stored_ones(t):
    drug = t.drug.select("drugname").filter("drugname is not null").distinct()
    typed = drug.selectExpr("concat(' ', upper(drugname), '  ') as drug")
    plain = sorted(rows(batch.top_side_effects_by_drug(t.drug, t.reac, 2)))
    assert sorted(rows(batch.top_side_effects_by_drug(t.drug, t.reac, 2, typed))) == plain
    pairs = drug.selectExpr("drugname as drug1", "'aspirin' as drug2")
    asked = drug.selectExpr("concat(upper(drugname), ' ') as drug1", "' Aspirin' as drug2")
    assert sorted(rows(batch.pair_interactions_for(t.drug, t.reac, asked))) == sorted(rows(batch.pair_interactions_for(t.drug, t.reac, pairs)))
