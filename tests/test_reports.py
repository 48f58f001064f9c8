import pytest

from casewatch.functions.columns import with_name_keys
from casewatch.operators import reports
from casewatch.plans import sizing
from tests.conftest import rows
from tests.small_cases import tables


@pytest.fixture(scope="module")
def t(spark):
    return tables(spark)


@pytest.fixture(params=["broadcast", "shuffle"])
def way(request, monkeypatch):
    """Run a test with the counted sides small, and with them too large to broadcast."""
    if request.param == "shuffle":
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
    return request.param


def test_counts_join_rows(t, way):
    top = rows(reports.top_side_effects(t.drug, t.reac, "aspirin", k=3))
    # Case 1 lists the drug twice, cases 2 and 8 once.
    assert top == [("Nausea", 4), ("Pain", 2), ("Term 00", 1)]


def test_distinct_cases(t, way):
    top = rows(reports.top_side_effects(t.drug, t.reac, "ASPIRIN", k=2, distinct_cases=True))
    assert top == [("Nausea", 3), ("Pain", 1)]


def test_ties_are_ordered_and_null_is_a_group_at_the_end(t):
    top = rows(reports.top_side_effects(t.drug, t.reac, "aspirin"))
    assert len(top) == 10 and top[-1] == ("Term 07", 1)
    everything = rows(reports.top_side_effects(t.drug, t.reac, "aspirin", k=50))
    assert everything[-1] == (None, 1)


def test_null_and_unknown_names_match_nothing(t):
    assert rows(reports.top_side_effects(t.drug, t.reac, None)) == []
    assert rows(reports.top_side_effects(t.drug, t.reac, "nothing")) == []


def test_trim_is_optional(t):
    assert "Fever" not in [r[0] for r in rows(reports.top_side_effects(t.drug, t.reac, "aspirin", k=50))]
    assert "Fever" in [r[0] for r in rows(reports.top_side_effects(t.drug, t.reac, " aspirin", k=50, trim=True))]


def test_stored_name_keys_give_the_same(t):
    keyed = with_name_keys(t.drug)
    for trim in (False, True):
        plain = rows(reports.top_side_effects(t.drug, t.reac, "Aspirin", trim=trim))
        assert rows(reports.top_side_effects(keyed, t.reac, "Aspirin", trim=trim)) == plain


def test_pair_counts_cases_in_any_role(t, way):
    found = rows(reports.drug_pair_interactions(t.drug, t.reac, "Warfarin", "aspirin"))
    assert found == [("Nausea", 2), ("Pain", 1), (None, 1)]


def test_pair_of_one_drug_gives_its_own_reactions(t):
    found = dict(rows(reports.drug_pair_interactions(t.drug, t.reac, "aspirin", "aspirin", k=50)))
    assert found["Rash"] == 1 and found["Nausea"] == 3


def test_segment_is_case_sensitive(t, way):
    assert rows(reports.side_effect_by_demographics(t.drug, t.reac, t.demographics, "aspirin", "adult", "F")) == []
    found = rows(reports.side_effect_by_demographics(t.drug, t.reac, t.demographics, "aspirin", "Adult", "F", k=2))
    assert found == [("Nausea", 3), ("Pain", 2)]


def test_segment_none_means_any_and_keeps_double_rows(t, way):
    found = rows(reports.side_effect_by_demographics(t.drug, t.reac, t.demographics, "aspirin", k=1))
    assert found == [("Nausea", 5)]  # case 8 has two demographics rows


def test_severe_outcomes_multiply(t, way):
    found = rows(reports.severe_side_effects(t.drug, t.reac, t.outcome, "aspirin", k=4))
    assert found == [("Nausea", "HO", 4), ("Nausea", "DE", 2), ("Pain", "DE", 2), ("Pain", "HO", 2)]


def test_curated_names_are_dense_and_sorted(t):
    assert sorted(rows(reports.curated_drug_names(t.drug))) == [(0, "aspirin"), (1, "ibuprofen"), (2, "warfarin")]


def test_curated_names_over_many_ranges(spark):
    names = spark.range(500).selectExpr("concat('Drug ', id % 250) AS drugname")
    found = sorted(rows(reports.curated_drug_names(names)))
    assert [i for i, _ in found] == list(range(250))
    assert [n for _, n in found] == sorted(n for _, n in found)
