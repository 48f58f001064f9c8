"""Severity of drugs and of their reactions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch.functions.columns import AGE_UNITS, age_status, age_years, is_death, is_severe, name_key
from casewatch.operators.batch import only_drugs
from casewatch.operators.counts import all_drugs, by_outcome, cases_with_both, drug_side, effect_counts, reaction_side, severe_counts, suspect_drugs
from casewatch.operators.reports import older_than, pair_cases, suspect_cases, top_severe, with_severe
from casewatch.plans.lineage import cut_lineage
from casewatch.plans.ranking import best_first, rank_by, top_k_per_key
from casewatch.plans.sizing import broadcast_if_small, dealt, is_small
from casewatch.plans.skew import HotKeys, Side, dealt_groups, hot_keys, product_join
from casewatch.schemas import CASE, SEVERE_OUTCOMES

# Weight of each severe outcome in the score, one unless the caller gives others.
DEFAULT_WEIGHTS: dict[str, float] = {code: 1.0 for code in SEVERE_OUTCOMES}


def _flag(condition: Column) -> Column:
    return F.max(F.when(condition, 1).otherwise(0))


def severity_summary(
    drug: DataFrame,
    outcome: DataFrame,
    drugs: DataFrame | None = None,
    weights: Mapping[str, float] = DEFAULT_WEIGHTS,
) -> DataFrame:
    """Per drug: cases, cases with a death, cases with a severe outcome, score, and rank by severe cases.

    The score adds, over the cases, the weights of the different outcome codes of the case.
    """
    weight = reduce(
        Column.__add__,
        [F.max(F.when(F.col("outc_cod") == code, float(w)).otherwise(0.0)) for code, w in weights.items()],
    )
    per_case = outcome.groupBy(CASE).agg(
        _flag(is_death()).alias("death"), _flag(is_severe()).alias("serious"), weight.alias("weight")
    )
    asked = only_drugs(drug, drugs)
    sides = [drug_side(suspect_drugs(asked.rows)), Side(per_case, optional=True)]
    summary = (
        product_join(sides, CASE, distinct=True)
        .groupBy("drug")
        .agg(
            F.count(F.lit(1)).alias("case_count"),
            F.coalesce(F.sum("death"), F.lit(0)).alias("death_cases"),
            F.coalesce(F.sum("serious"), F.lit(0)).alias("serious_cases"),
            F.coalesce(F.sum("weight"), F.lit(0.0)).alias("severity_score"),
        )
    )
    return rank_by(asked.cut(summary), "serious_cases", "severity_rank")


def frequency_severity_matrix(
    drug: DataFrame, reac: DataFrame, outcome: DataFrame, drugs: DataFrame | None = None, k: int | None = None
) -> DataFrame:
    """Per drug and reaction: reports in all, and reports per outcome code (fixed columns).

    report_count does not need an outcome; the outcome columns count joined rows as the severe report
    does. With `k`, only the most frequent reactions of each drug.
    """
    codes = {f"n_{code.lower()}": F.col("outc_cod") == code for code in SEVERE_OUTCOMES}
    codes["n_other"] = ~is_severe()
    per_case = outcome.groupBy(CASE).agg(*[F.count_if(test).alias(name) for name, test in codes.items()])
    asked = only_drugs(drug, drugs)
    sides = [drug_side(suspect_drugs(asked.rows)), reaction_side(reac), Side(per_case, optional=True)]
    matrix = (
        product_join(sides, CASE)
        .groupBy("drug", "side_effect")
        .agg(
            F.sum("n").alias("report_count"),
            *[F.sum(F.col("n") * F.coalesce(name, F.lit(0))).alias(name) for name in codes],
        )
        .withColumn("severe_count", reduce(Column.__add__, [F.col(f"n_{code.lower()}") for code in SEVERE_OUTCOMES]))
    )
    matrix = asked.cut(matrix)
    if k is None:
        return matrix
    return top_k_per_key(matrix, ["drug"], k, best_first("report_count", "side_effect"))


def severe_by_segment(
    drug: DataFrame,
    reac: DataFrame,
    outcome: DataFrame,
    demographics: DataFrame,
    name: str | None,
    age_over: float,
    sex: str | None = None,
    k: int = 10,
    trim: bool = False,
    distinct_cases: bool = False,
) -> DataFrame:
    """The severe report within patients older than `age_over` years (and one sex)."""
    cases = suspect_cases(drug, name, trim).having(older_than(demographics, age_over, sex), "n_demo")
    return top_severe(with_severe(cases, outcome).reactions(reac), k, distinct_cases)


def severe_pair_by_segment(
    drug: DataFrame,
    reac: DataFrame,
    outcome: DataFrame,
    demographics: DataFrame,
    drug1: str | None,
    drug2: str | None,
    age_over: float,
    sex: str | None = None,
    k: int = 10,
    trim: bool = False,
) -> DataFrame:
    """Severe reactions by distinct cases listing both drugs, patients older than `age_over` years."""
    cases = pair_cases(drug, drug1, drug2, trim).having(older_than(demographics, age_over, sex), "n_demo")
    return top_severe(with_severe(cases, outcome).reactions(reac), k, distinct_cases=True)


SEGMENT = ["age_over", "sex"]


def _asked_segments(requests: DataFrame, *drugs: str) -> DataFrame:
    """Different (drugs, age_over, sex) of a request table, names as `name_key`; a NULL age or sex means any."""
    names = [name_key(d).alias(d) for d in drugs]
    asked = requests.select(*names, F.col("age_over").cast("double").alias("age_over"), F.col("sex").alias("asked_sex"))
    return asked.dropna(subset=list(drugs)).distinct()


def _in_segment(cases: DataFrame, demographics: DataFrame) -> DataFrame:
    """Cases with `n` and an asked segment, `n` times the rows of demographics that fit it; those without one stay."""
    limited = F.col("age_over").isNotNull() | F.col("asked_sex").isNotNull()
    people = demographics.select(CASE, age_years().alias("age_years"), "sex")
    fits = (F.col("age_over").isNull() | (F.col("age_years") > F.col("age_over"))) & (
        F.col("asked_sex").isNull() | (F.col("sex") == F.col("asked_sex"))
    )
    inside = cases.where(limited).join(people, CASE).where(fits).groupBy(*[c for c in cases.columns if c != "n"]).agg(F.sum("n").alias("n"))
    return cases.where(~limited).unionByName(inside).withColumnRenamed("asked_sex", "sex")


def _segment_counts(
    cases: DataFrame, reac: DataFrame, outcome: DataFrame | None, names: list[str], distinct_cases: bool, hot: HotKeys | None
) -> DataFrame:
    """(names, age_over, sex, side_effect, report_count) of cases in asked segments, with `outcome` also a column per
    severe outcome: joined rows (a case counts `case_n` times), or distinct cases. Outcomes are counted before the join."""
    codes = [] if outcome is None else list(SEVERE_OUTCOMES)
    if outcome is not None:
        cases = cases.join(severe_counts(outcome), CASE, "left")
    weight = "case_n" if "case_n" in cases.columns else None
    sides = [Side(cases, (*names, *SEGMENT), weight=weight), reaction_side(reac)]
    hot = hot or hot_keys(sides, CASE)
    by = [*names, *SEGMENT, "side_effect"]
    joined = dealt_groups(product_join(sides, CASE, distinct_cases, hot), sides, hot, by)
    times = {code: F.coalesce(F.col(code), F.lit(0)) for code in codes}
    if distinct_cases:
        times = {code: F.least(n, F.lit(1)) for code, n in times.items()}
    return joined.groupBy(*by).agg(F.sum("n").alias("report_count"), *[F.sum(F.col("n") * n).alias(c) for c, n in times.items()])


def asked_of(counted: DataFrame, requests: DataFrame, *names: str) -> DataFrame:
    """The counts of the segments that the requests name."""
    keys = [*names, *SEGMENT]
    asked = broadcast_if_small(_asked_segments(requests, *names).withColumnRenamed("asked_sex", "sex")).alias("w")
    return counted.alias("f").join(asked, [F.col(f"f.{c}").eqNullSafe(F.col(f"w.{c}")) for c in keys], "left_semi")


def best_of_segments(counted: DataFrame, names: list[str], k: int | None, severe: bool) -> DataFrame:
    """(names, age_over, sex, rank, side_effect, outcome_code, report_count): the top reactions, or the severe ones."""
    keys = [*names, *SEGMENT]
    rows = by_outcome(counted) if severe else counted.withColumn("outcome_code", F.lit(None).cast("string"))
    ranked = top_k_per_key(rows, keys, k, best_first("report_count", "side_effect", *(["outcome_code"] if severe else [])))
    return ranked.select(*keys, "rank", "side_effect", "outcome_code", "report_count")


def asked_segment_counts(
    drug: DataFrame,
    reac: DataFrame,
    demographics: DataFrame,
    requests: DataFrame,
    outcome: DataFrame | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Uncut counts for every (drug, age_over, sex) of a request table: all reports, with `outcome` also a column per
    severe outcome."""
    asked = broadcast_if_small(_asked_segments(requests, "drug"))
    suspects = suspect_drugs(drug).filter(F.col(CASE).isNotNull())
    if hot is not None:
        suspects = dealt(suspects, hot.rows([drug_side(suspects)]), CASE)  # brought together before the requests multiply them
    cases = suspects.join(asked, "drug").groupBy(CASE, "drug", "age_over", "asked_sex").agg(F.count(F.lit(1)).alias("n"))
    inside = _in_segment(cases, demographics).withColumnRenamed("n", "case_n")
    return _segment_counts(inside, reac, outcome, ["drug"], False, hot)


def effects_by_segments(
    drug: DataFrame,
    reac: DataFrame,
    demographics: DataFrame,
    requests: DataFrame,
    k: int | None = 10,
    outcome: DataFrame | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """(drug, age_over, sex, rank, side_effect, outcome_code, report_count) for every (drug, age_over, sex) of a request
    table, in one job: the top reactions, or with `outcome` the severe ones, of patients older than that and of that
    sex. NULL means any. One request gives what `severe_by_segment` does."""
    counted = asked_segment_counts(drug, reac, demographics, requests, outcome, hot)
    return best_of_segments(counted, ["drug"], k, outcome is not None)


def pair_segment_counts(
    drug: DataFrame,
    reac: DataFrame,
    outcome: DataFrame,
    demographics: DataFrame,
    requests: DataFrame,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Uncut counts of distinct cases for every (drug1, drug2, age_over, sex) of a request table: all cases with both
    drugs, and a column per severe outcome."""
    asked = _asked_segments(requests, "drug1", "drug2")
    pair = ["drug1", "drug2"]
    places = F.array(F.struct(F.col("drug1").alias("drug"), F.lit(1).alias("place")), F.struct(F.col("drug2").alias("drug"), F.lit(2).alias("place")))
    named = asked.select(*pair).distinct().select("*", F.inline(places))
    if is_small(named):
        both = cases_with_both(drug, named, pair, hot)
    else:
        hits = all_drugs(drug).join(named, "drug").groupBy(CASE, *pair).agg(_flag(F.col("place") == 1).alias("has1"), _flag(F.col("place") == 2).alias("has2"))
        both = hits.where("has1 = 1 AND has2 = 1").select(CASE, *pair)
    # A pair's segments multiply only the cases that have both drugs.
    both = both.join(broadcast_if_small(asked), pair).withColumn("n", F.lit(1).cast("bigint"))
    inside = _in_segment(both, demographics).drop("n")
    return _segment_counts(inside, reac, outcome, ["drug1", "drug2"], True, hot)


def severe_pairs_by_segments(
    drug: DataFrame,
    reac: DataFrame,
    outcome: DataFrame,
    demographics: DataFrame,
    requests: DataFrame,
    k: int | None = 10,
    hot: HotKeys | None = None,
) -> DataFrame:
    """(drug1, drug2, age_over, sex, rank, side_effect, outcome_code, report_count) for every request, as
    `severe_pair_by_segment` gives for one."""
    counted = pair_segment_counts(drug, reac, outcome, demographics, requests, hot)
    return best_of_segments(counted, ["drug1", "drug2"], k, True)


def age_summary(demographics: DataFrame, units: Mapping[str, float] = AGE_UNITS) -> DataFrame:
    """How many rows the age conditions can and cannot judge: (age_status, row_count)."""
    return demographics.groupBy(age_status(units).alias("age_status")).agg(F.count(F.lit(1)).alias("row_count"))


def effect_profile(
    drug: DataFrame, reac: DataFrame, effects: Sequence[str], drugs: DataFrame | None = None
) -> DataFrame:
    """How often each of the given reactions is reported for a drug: count, share of all, rank.

    One row per drug and reaction reported for it. Rank and total come from one aggregation over the
    drug's counts, not from a sort of them.
    """
    asked = only_drugs(drug, drugs)
    sides = [drug_side(suspect_drugs(asked.rows)), reaction_side(reac)]
    counted = cut_lineage(asked.cut(effect_counts(sides, ["drug", "side_effect"])))  # read twice below
    wanted = counted.filter(F.col("side_effect").isin(*effects)).select(
        "drug", F.col("side_effect").alias("wanted"), F.col("report_count").alias("wanted_count")
    )
    profile = (
        counted.join(wanted, "drug")
        .groupBy("drug", "wanted", "wanted_count")
        .agg(
            F.sum("report_count").alias("total_count"),
            (F.count_if(F.col("report_count") > F.col("wanted_count")) + 1).alias("effect_rank"),
        )
    )
    return profile.select(
        "drug",
        F.col("wanted").alias("side_effect"),
        F.col("wanted_count").alias("report_count"),
        "total_count",
        (F.col("wanted_count") / F.col("total_count")).alias("share"),
        "effect_rank",
    )
