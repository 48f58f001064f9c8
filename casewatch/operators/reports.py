"""One-drug and one-pair reports, and the name dictionary."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch.functions.columns import age_years, is_severe, is_suspect, name_is, name_key
from casewatch.operators.counts import reaction_side, reactions
from casewatch.plans.ranking import best_first, dense_ids, top_k
from casewatch.plans.sizing import is_small
from casewatch.plans.skew import Side, product_join
from casewatch.schemas import CASE


@dataclass(frozen=True)
class Cases:
    """One row per case with n_drug, and whether there are few enough to broadcast (counted)."""

    rows: DataFrame
    small: bool

    def having(self, table: DataFrame, count: str, keys: dict[str, str] | None = None) -> Cases:
        """Add `count`, the rows of `table` per case and key; cases without any leave.

        Small: `table` is read in place and never shuffled whole. Otherwise it is counted per case
        before the join. A key may have a few values per case only.
        """
        named = [F.col(source).alias(name) for name, source in (keys or {}).items()]
        number = F.count(F.lit(1)).alias(count)
        if self.small:
            hits = table.select(CASE, *named).join(F.broadcast(self.rows), CASE)
            return Cases(hits.groupBy(*self.rows.columns, *(keys or {})).agg(number), True)
        return Cases(table.groupBy(CASE, *named).agg(number).join(self.rows, CASE), False)

    def reactions(self, reac: DataFrame) -> DataFrame:
        """(case columns, side_effect), with hot cases split unless `rows` is broadcast.

        The n_ counts of the case are multiplied into n, the rows one row stands for.
        """
        weight = reduce(Column.__mul__, [F.col(c) for c in self.rows.columns if c.startswith("n_")])
        cases = self.rows.withColumn("weight", weight)
        cases = cases.drop(*[c for c in self.rows.columns if c.startswith("n_")])
        if self.small:
            return reactions(reac).join(F.broadcast(cases), CASE).withColumnRenamed("weight", "n")
        return product_join([Side(cases, weight="weight"), reaction_side(reac)], CASE)


def suspect_cases(drug: DataFrame, name: str | None, trim: bool = False) -> Cases:
    """Cases with the drug as primary suspect, and how often they list it."""
    rows = drug.filter(is_suspect() & name_is(drug, name, trim)).select(CASE)
    return Cases(rows.groupBy(CASE).agg(F.count(F.lit(1)).alias("n_drug")), is_small(rows))


def pair_cases(drug: DataFrame, drug1: str | None, drug2: str | None, trim: bool = False) -> Cases:
    """Cases listing both drugs in any role, from one pass and no self-join."""
    first, second = name_is(drug, drug1, trim), name_is(drug, drug2, trim)
    rows = drug.filter(first | second).select(CASE, first.alias("is1"), second.alias("is2"))
    both = (
        rows.groupBy(CASE)
        .agg(F.max("is1").alias("has1"), F.max("is2").alias("has2"))
        .filter("has1 and has2")
        .select(CASE, F.lit(1).cast("bigint").alias("n_drug"))
    )
    return Cases(both, is_small(rows))


def count_rows(joined: DataFrame, keys: list[str], distinct_cases: bool = False) -> DataFrame:
    """report_count per `keys`: joined rows, or distinct cases."""
    count = F.count_distinct(CASE) if distinct_cases else F.sum("n")
    return joined.groupBy(*keys).agg(count.alias("report_count"))


def top_side_effects(
    drug: DataFrame, reac: DataFrame, name: str | None, k: int = 10, trim: bool = False, distinct_cases: bool = False
) -> DataFrame:
    """The `k` most reported reactions of a primary-suspect drug.

    report_count counts joined rows: a case listing the drug or the reaction twice counts twice.
    `distinct_cases` counts each case once.
    """
    joined = suspect_cases(drug, name, trim).reactions(reac)
    counted = count_rows(joined, ["side_effect"], distinct_cases)
    return top_k(counted, k, best_first("report_count", "side_effect"))


def drug_pair_interactions(
    drug: DataFrame, reac: DataFrame, drug1: str | None, drug2: str | None, k: int = 10, trim: bool = False
) -> DataFrame:
    """The `k` reactions with most distinct cases listing both drugs, in any role."""
    joined = pair_cases(drug, drug1, drug2, trim).reactions(reac)
    counted = joined.groupBy(F.col("side_effect").alias("shared_side_effect")).agg(
        F.count_distinct(CASE).alias("shared_report_count")
    )
    return top_k(counted, k, best_first("shared_report_count", "shared_side_effect"))


def in_segment(demographics: DataFrame, age_group: str | None, sex: str | None) -> DataFrame:
    """Exact (case-sensitive) match on the parts that are given; None means any."""
    for column, value in (("age_grp", age_group), ("sex", sex)):
        if value is not None:
            demographics = demographics.filter(F.col(column) == value)
    return demographics


def older_than(demographics: DataFrame, age_over: float, sex: str | None = None) -> DataFrame:
    """Known age above `age_over` years, and the sex when given."""
    return in_segment(demographics, None, sex).filter(age_years() > F.lit(float(age_over)))


def side_effect_by_demographics(
    drug: DataFrame,
    reac: DataFrame,
    demographics: DataFrame,
    name: str | None,
    age_group: str | None = None,
    sex: str | None = None,
    k: int = 10,
    trim: bool = False,
    distinct_cases: bool = False,
) -> DataFrame:
    """`top_side_effects` within one age group and sex; None means any."""
    cases = suspect_cases(drug, name, trim).having(in_segment(demographics, age_group, sex), "n_demo")
    counted = count_rows(cases.reactions(reac), ["side_effect"], distinct_cases)
    return top_k(counted, k, best_first("report_count", "side_effect"))


def with_severe(cases: Cases, outcome: DataFrame) -> Cases:
    """Each case once per severe outcome code it has (at most four)."""
    return cases.having(outcome.filter(is_severe()), "n_outcome", {"outcome_code": "outc_cod"})


def top_severe(joined: DataFrame, k: int, distinct_cases: bool) -> DataFrame:
    counted = count_rows(joined, ["side_effect", "outcome_code"], distinct_cases)
    return top_k(counted, k, best_first("report_count", "side_effect", "outcome_code"))


def severe_side_effects(
    drug: DataFrame,
    reac: DataFrame,
    outcome: DataFrame,
    name: str | None,
    k: int = 10,
    trim: bool = False,
    distinct_cases: bool = False,
) -> DataFrame:
    """The `k` most reported (reaction, severe outcome) combinations of a primary-suspect drug."""
    joined = with_severe(suspect_cases(drug, name, trim), outcome).reactions(reac)
    return top_severe(joined, k, distinct_cases)


def curated_drug_names(drug: DataFrame, column: str = "drugname") -> DataFrame:
    """(id, drug_name): distinct lower-cased, trimmed names, numbered in name order.

    `column` may also be prod_ai, for a dictionary of active ingredients.
    """
    names = drug.select(name_key(column).alias("drug_name")).filter("drug_name <> ''").distinct()
    return dense_ids(names, "drug_name")
