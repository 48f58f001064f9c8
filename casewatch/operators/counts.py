"""The case tables as (case, value) rows, and counting their joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.functions.columns import NAME_KEY, drug_key, is_severe, is_suspect
from casewatch.plans.lineage import cut_lineage
from casewatch.plans.sizing import dealt
from casewatch.plans.skew import HotKeys, Side, dealt_groups, hot_keys, product_join
from casewatch.schemas import CASE, SEVERE_OUTCOMES
from casewatch.sources.star_schema import CaseTables


def suspect_drugs(drug: DataFrame) -> DataFrame:
    """(case, drug) of primary suspects."""
    return all_drugs(drug.filter(is_suspect()))


def all_drugs(drug: DataFrame) -> DataFrame:
    return drug.select(CASE, drug_key(drug).alias("drug")).filter(F.col("drug").isNotNull())


def reactions(reac: DataFrame) -> DataFrame:
    """(case, side_effect)."""
    return reac.select(CASE, F.col("pt").alias("side_effect"))


def severe_outcomes(outcome: DataFrame) -> DataFrame:
    """(case, outcome_code) of the severe outcomes."""
    return outcome.filter(is_severe()).select(CASE, F.col("outc_cod").alias("outcome_code"))


def segments(demographics: DataFrame) -> DataFrame:
    """(case, age_grp, sex)."""
    return demographics.select(CASE, "age_grp", "sex")


def drug_side(drugs: DataFrame) -> Side:
    return Side(drugs, ("drug",))


def reaction_side(reac: DataFrame) -> Side:
    return Side(reactions(reac), ("side_effect",))


def segment_side(demographics: DataFrame) -> Side:
    return Side(segments(demographics), ("age_grp", "sex"))


def outcome_side(outcome: DataFrame) -> Side:
    return Side(severe_outcomes(outcome), ("outcome_code",))


def severe_counts(outcome: DataFrame) -> DataFrame:
    """(case, a column per severe outcome): how often each case has it; cases without any are left out."""
    codes = [F.count_if(F.col("outc_cod") == code).alias(code) for code in SEVERE_OUTCOMES]
    return outcome.filter(is_severe() & F.col(CASE).isNotNull()).groupBy(CASE).agg(*codes)


def by_outcome(counted: DataFrame) -> DataFrame:
    """Rows with a count per severe outcome as one row for each outcome that occurs, its count as report_count."""
    each = F.array(*[F.struct(F.lit(code).alias("outcome_code"), F.col(code).alias("report_count")) for code in SEVERE_OUTCOMES])
    kept = [c for c in counted.columns if c not in (*SEVERE_OUTCOMES, "report_count")]
    return counted.select(*kept, F.inline(each)).filter("report_count > 0")


def stored_cases(drug: DataFrame, reac: DataFrame, outcome: DataFrame, demographics: DataFrame, *person: str) -> CaseTables:
    """The columns and rows that reports read, written once for several reports; `person` are those of demographics."""
    known = F.col(CASE).isNotNull()
    named = drug.select(CASE, "role_cod", drug_key(drug).alias(NAME_KEY)).filter(known & F.col(NAME_KEY).isNotNull())
    return CaseTables(
        cut_lineage(named, "drug"),
        cut_lineage(reac.select(CASE, "pt").filter(known), "reac"),
        cut_lineage(outcome.select(CASE, "outc_cod").filter(known & is_severe()), "outcome"),
        cut_lineage(demographics.select(CASE, *person).filter(known), "demographics"),
    )


def hot_cases(
    drug: DataFrame, reac: DataFrame, outcome: DataFrame | None = None, demographics: DataFrame | None = None
) -> HotKeys:
    """One check of the case tables, to be passed to several reports over them."""
    sides = [drug_side(all_drugs(drug)), reaction_side(reac)]
    if outcome is not None:
        sides.append(outcome_side(outcome))
    if demographics is not None:
        sides.append(segment_side(demographics))
    return hot_keys(sides, CASE)


def effect_counts(
    sides: list[Side],
    by: list[str],
    distinct_cases: bool = False,
    hot: HotKeys | None = None,
    together: list[str] | None = None,
    levels: int = 1,
) -> DataFrame:
    """Join the sides on the case; report_count per `by`: joined rows, or distinct cases.

    Where rows are dealt to bounded tasks, those with equal `together` (some of `by`) stay in one; `levels` says how
    often the counts are grouped by these again.
    """
    hot = hot or hot_keys(sides, CASE)
    joined = dealt_groups(product_join(sides, CASE, distinct_cases, hot), sides, hot, together or by, levels)
    return joined.groupBy(*by).agg(F.sum("n").alias("report_count"))


def cases_with_both(drug: DataFrame, named: DataFrame, keys: list[str], hot: HotKeys | None = None) -> DataFrame:
    """(case, *keys) of the cases that have the drugs of both places of a request.

    `named` is small: (drug, place, *keys), a row for each place. A case's drugs are brought together once; they meet
    the requests there, where each gives a case two rows at most.
    """
    asked = all_drugs(drug).join(F.broadcast(named.select("drug").distinct()), "drug", "left_semi")
    rows = asked.count() if hot is None else hot.rows([drug_side(drug)])
    hits = dealt(asked.filter(F.col(CASE).isNotNull()), rows, CASE).distinct().join(F.broadcast(named), "drug")
    has = [F.max(F.col("place") == n).alias(f"has{n}") for n in (1, 2)]
    return hits.groupBy(CASE, *keys).agg(*has).filter("has1 and has2").select(CASE, *keys)
