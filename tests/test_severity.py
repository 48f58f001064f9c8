import pytest

from casewatch.operators import severity
from casewatch.plans import skew
from tests.conftest import rows
from tests.small_cases import SEVERE, joined_counts, skewed, tables


@pytest.fixture(scope="module")
def t(spark):
    return tables(spark)


def test_summary_and_rank(t):
    found = {r["drug"]: r.asDict() for r in severity.severity_summary(t.drug, t.outcome, weights={"DE": 10, "HO": 2}).collect()}
    # Cases of aspirin: 1 (DE, HO, OT), 2 (HO twice), 4 (none), 7 (none), 8 (DS).
    assert found["aspirin"] == {
        "drug": "aspirin",
        "case_count": 5,
        "death_cases": 1,
        "serious_cases": 3,
        "severity_score": 14.0,
        "severity_rank": 1,
    }
    assert found["ibuprofen"]["severity_rank"] == 2 and found["warfarin"]["serious_cases"] == 0


def test_age_conditions(t):
    # Over 65 with a known age: case 1 (70 YR) and case 2 (9 decades).
    found = rows(severity.severe_by_segment(t.drug, t.reac, t.outcome, t.demographics, "aspirin", 65, k=9))
    assert found[0] == ("Nausea", "HO", 4) and ("Pain", "DE", 2) in found and len(found) == 5
    women = rows(severity.severe_by_segment(t.drug, t.reac, t.outcome, t.demographics, "aspirin", 65, "F"))
    assert women == [("Nausea", "DE", 2), ("Nausea", "HO", 2), ("Pain", "DE", 2), ("Pain", "HO", 2)]


def test_pair_over_an_age(t):
    found = rows(
        severity.severe_pair_by_segment(t.drug, t.reac, t.outcome, t.demographics, "aspirin", "warfarin", 65, k=2)
    )
    assert found == [("Nausea", "HO", 2), ("Nausea", "DE", 1)]


def test_unusable_ages_are_counted(t):
    assert sorted(rows(severity.age_summary(t.demographics))) == [
        ("known", 4),
        ("missing", 1),
        ("not_a_number", 1),
        ("unknown_unit", 1),
    ]


@pytest.fixture(params=[None, 2_000])
def skewed_tables(request, spark, monkeypatch):
    if request.param is not None:
        monkeypatch.setattr(skew, "MAX_KEY_PRODUCT", 50)
        monkeypatch.setattr(skew.Side.__init__, "__defaults__", ((), None, False, None, 5, 7))
    raw = skewed(seed=5)
    return raw, tables(spark, *raw)


def test_matrix_and_profile(skewed_tables):
    (drug, reac, outcome, _), t = skewed_tables
    totals = joined_counts(drug, reac)
    coded = joined_counts(drug, reac, [outcome])
    found = severity.frequency_severity_matrix(t.drug, t.reac, t.outcome).collect()
    assert len(found) == len(totals)
    for r in found:
        key = (r["drug"], r["side_effect"])
        assert r["report_count"] == totals[key]
        by_code = {code: coded[(key[0], code, key[1])] for code in (*SEVERE, "OT")}
        assert [r[f"n_{c.lower()}"] for c in SEVERE] == [by_code[c] for c in SEVERE]
        assert r["n_other"] == by_code["OT"] and r["severe_count"] == sum(by_code[c] for c in SEVERE)
    for r in severity.effect_profile(t.drug, t.reac, ["r0", "r3"]).collect():
        own = {term: n for (name, term), n in totals.items() if name == r["drug"]}
        assert r["report_count"] == own[r["side_effect"]] and r["total_count"] == sum(own.values())
        assert r["effect_rank"] == 1 + sum(n > r["report_count"] for n in own.values())
        assert r["share"] == pytest.approx(r["report_count"] / r["total_count"])
