"""The reports for every drug, pair or segment in one job."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewatch.functions.columns import drug_key, name_key
from casewatch.operators.counts import (
    all_drugs,
    cases_with_both,
    drug_side,
    effect_counts,
    outcome_side,
    reaction_side,
    reactions,
    segment_side,
    segments,
    severe_counts,
    suspect_drugs,
)
from casewatch.plans.lineage import cut_lineage
from casewatch.plans.ranking import best_first, coded, decoded, name_codes, top_k_per_key
from casewatch.plans.sizing import broadcast_if_small, dealt, is_small
from casewatch.plans import skew
from casewatch.plans.skew import (
    CELL,
    CELLS,
    HotKeys,
    Side,
    by_value,
    cool_join,
    cool_rows,
    dealt_groups,
    heavy_values,
    hot_join,
    hot_keys,
    in_cell,
    joined_parts,
    product_join,
    task_parts,
)
from casewatch.schemas import CASE, SEVERE_OUTCOMES

PAIR = ["drug1", "drug2"]
# A part of a hot case pairs with every other part: keep parts short.
PAIR_PART_ROWS = 512


@dataclass(frozen=True)
class Requested:
    """Drug rows for a request table: cut before the join when it is small, else the result is cut."""

    rows: DataFrame
    later: DataFrame | None = None

    def cut(self, result: DataFrame) -> DataFrame:
        return result if self.later is None else result.join(self.later, "drug", "left_semi")


def only_drugs(drug: DataFrame, drugs: DataFrame | None) -> Requested:
    """Keep the drugs in the `drug` column of a request table, if there is one; case and outer spaces do not count."""
    if drugs is None:
        return Requested(drug)
    keys = drugs.select(name_key("drug").alias("drug")).filter("drug is not null").distinct()
    if not is_small(keys):
        return Requested(drug, keys)
    keyed = drug.withColumn("drug", drug_key(drug))
    return Requested(keyed.join(F.broadcast(keys), "drug", "left_semi").select(*drug.columns))


def _ranked(counted: DataFrame, keys: list[str], k: int | None, ties: list[str], count: str) -> DataFrame:
    ranked = top_k_per_key(counted, keys, k, best_first(count, *ties))
    return ranked.select(*keys, "rank", *ties, count)


def top_side_effects_by_drug(
    drug: DataFrame,
    reac: DataFrame,
    k: int | None = 10,
    drugs: DataFrame | None = None,
    distinct_cases: bool = False,
    hot: HotKeys | None = None,
) -> DataFrame:
    """(drug, rank, side_effect, report_count) for every drug, or those of `drugs`."""
    asked = only_drugs(drug, drugs)
    sides = [drug_side(suspect_drugs(asked.rows)), reaction_side(reac)]
    counted = effect_counts(sides, ["drug", "side_effect"], distinct_cases, hot)
    return _ranked(asked.cut(counted), ["drug"], k, ["side_effect"], "report_count")


def segment_effect_counts(
    drug: DataFrame,
    reac: DataFrame,
    demographics: DataFrame,
    drugs: DataFrame | None = None,
    distinct_cases: bool = False,
    hot: HotKeys | None = None,
    together: list[str] | None = None,
    levels: int = 1,
) -> DataFrame:
    """Uncut report_count per (drug, age_grp, sex, side_effect); `together` and `levels` as in `effect_counts`."""
    asked = only_drugs(drug, drugs)
    sides = [drug_side(suspect_drugs(asked.rows)), reaction_side(reac), segment_side(demographics)]
    return asked.cut(effect_counts(sides, ["drug", "age_grp", "sex", "side_effect"], distinct_cases, hot, together, levels))


def report_counts(
    drug: DataFrame, reac: DataFrame, outcome: DataFrame, demographics: DataFrame, drugs: DataFrame, hot: HotKeys
) -> DataFrame:
    """(drug, age_grp, sex, side_effect, report_count, in_segment, a column per severe outcome) for the asked drugs.

    One join serves three reports, as a case's outcomes and segments are counted before it. Added up over age_grp and
    sex, `report_count` has all reports and the outcome columns those of the severe report; `in_segment` has the reports
    of the segment, none where a case has no demographics.
    """
    asked = only_drugs(drug, drugs)
    parts = task_parts(drug.sparkSession, hot.rows([drug_side(drug), reaction_side(reac)]))

    def together(rows: DataFrame) -> DataFrame:
        return rows.repartition(CASE) if parts is None else rows.repartition(parts, CASE)

    suspects = together(suspect_drugs(asked.rows).filter(F.col(CASE).isNotNull()))
    suspects = suspects.groupBy(CASE, "drug").agg(F.count(F.lit(1)).alias("drug_n"))
    people = together(segments(demographics).filter(F.col(CASE).isNotNull()))
    people = people.groupBy(CASE, "age_grp", "sex").agg(F.count(F.lit(1)).alias("in_segment"))
    # What a case has but once goes to one of its segments.
    place = F.row_number().over(Window.partitionBy(CASE).orderBy(F.asc("age_grp"), F.asc("sex")))
    people = people.withColumn("once", F.when(place == 1, 1).otherwise(0).cast("bigint"))
    severe = together(severe_counts(outcome))
    persons = Side(people, ("age_grp", "sex"), optional=True)
    cases = product_join([Side(suspects, ("drug",), weight="drug_n"), persons], CASE, hot=hot)
    cases = cases.withColumn("once", F.coalesce("once", F.lit(1).cast("bigint")))
    cases = cases.withColumn("in_segment", F.coalesce("in_segment", F.lit(0).cast("bigint")))
    cases = cases.join(severe, CASE, "left").withColumnRenamed("n", "case_n")
    sides = [Side(cases, ("drug", "age_grp", "sex"), weight="case_n"), reaction_side(reac)]
    joined = dealt_groups(product_join(sides, CASE, hot=hot), sides, hot, ["drug", "side_effect"], 4)
    n, once = F.col("n"), F.col("once")
    counted = joined.groupBy("drug", "age_grp", "sex", "side_effect").agg(
        F.sum(n * once).alias("report_count"),
        F.sum(n * F.col("in_segment")).alias("in_segment"),
        *[F.sum(n * once * F.coalesce(code, F.lit(0))).alias(code) for code in SEVERE_OUTCOMES],
    )
    return asked.cut(counted)


def side_effects_by_segment(
    drug: DataFrame,
    reac: DataFrame,
    demographics: DataFrame,
    k: int | None = 10,
    drugs: DataFrame | None = None,
    distinct_cases: bool = False,
    hot: HotKeys | None = None,
) -> DataFrame:
    """(drug, age_grp, sex, rank, side_effect, report_count) for every segment."""
    counted = segment_effect_counts(drug, reac, demographics, drugs, distinct_cases, hot)
    return _ranked(counted, ["drug", "age_grp", "sex"], k, ["side_effect"], "report_count")


def severe_side_effects_by_drug(
    drug: DataFrame,
    reac: DataFrame,
    outcome: DataFrame,
    k: int | None = 10,
    drugs: DataFrame | None = None,
    distinct_cases: bool = False,
    hot: HotKeys | None = None,
) -> DataFrame:
    """(drug, rank, side_effect, outcome_code, report_count) for every drug."""
    asked = only_drugs(drug, drugs)
    sides = [drug_side(suspect_drugs(asked.rows)), reaction_side(reac), outcome_side(outcome)]
    counted = effect_counts(sides, ["drug", "side_effect", "outcome_code"], distinct_cases, hot)
    return _ranked(asked.cut(counted), ["drug"], k, ["side_effect", "outcome_code"], "report_count")


def pair_interactions_all(drug: DataFrame, reac: DataFrame, k: int | None = 10, min_cases: int = 1) -> DataFrame:
    """(drug1, drug2, rank, shared_side_effect, shared_report_count) for every pair drug1 < drug2.

    Only pairs with at least `min_cases` distinct cases are kept. A drug with fewer cases is in no such
    pair; when the other drugs are few enough to broadcast, it leaves before the join. Pairs are counted
    before they meet reactions, and where those kept are few enough the others do not. Where the pairs of all
    cases with their reactions are many, they are made where a reaction's rows are, and do not move (see
    `_counted_by_reaction`). A case with very many drugs is cut into a grid of parts, and its pairs do not meet its
    reactions one by one (see `_with_hot_cases`).
    """
    # Written once, as they are checked, counted and joined.
    known = F.col(CASE).isNotNull()
    in_case = cut_lineage(all_drugs(drug).filter(known), "drugs")
    effects = Side(cut_lineage(reactions(reac).filter(known), "reactions"), ("side_effect",))
    if min_cases > 1:
        once = dealt(in_case, in_case.count(), CASE).distinct()
        frequent = once.groupBy("drug").agg(F.count(CASE).alias("n")).filter(F.col("n") >= min_cases)
        frequent = cut_lineage(frequent.select("drug"))
        if is_small(frequent):
            in_case = in_case.join(F.broadcast(frequent), "drug", "left_semi")
    pair = [
        Side(in_case.withColumnRenamed("drug", "drug1"), ("drug1",), rows_per_part=PAIR_PART_ROWS),
        Side(in_case.withColumnRenamed("drug", "drug2"), ("drug2",), rows_per_part=PAIR_PART_ROWS, twin=0),
    ]
    sides = [*pair, effects]
    hot = hot_keys(sides, CASE)
    few = None
    if min_cases > 1:
        pairs = product_join(pair, CASE, True, hot).filter("drug1 < drug2")
        enough = pairs.groupBy(*PAIR).agg(F.sum("n").alias("cases")).filter(F.col("cases") >= min_cases)
        enough = cut_lineage(enough.select(*PAIR))
        few = enough if is_small(enough) else None
    found = [*PAIR, "side_effect"]
    parts = joined_parts(sides, hot)
    if parts is not None and (hot.keys is None or k is not None):
        counted = _counted_by_reaction(sides, hot, parts, few)
    else:
        join = cool_join if k is not None else product_join
        triples = _of_pairs(join(sides, CASE, hot=hot, distinct=True).filter("drug1 < drug2"), few)
        counted = dealt_groups(triples, sides, hot, found).groupBy(*found).agg(F.sum("n").alias("n"))
    if hot.keys is not None and k is not None:
        counted = _with_hot_cases(counted, pair, effects, hot, k)
    counted = counted.select(
        *PAIR, F.col("side_effect").alias("shared_side_effect"), F.col("n").alias("shared_report_count")
    )
    ranked = _ranked(counted, PAIR, k, ["shared_side_effect"], "shared_report_count")
    if min_cases > 1:
        # No semi-join: that would be made before ranking, on the rows of every pair.
        ranked = ranked.join(enough, PAIR).select(*ranked.columns)
    return ranked


def _of_pairs(rows: DataFrame, pairs: DataFrame | None) -> DataFrame:
    return rows if pairs is None else rows.join(F.broadcast(pairs), PAIR, "left_semi")


def _counted_by_reaction(sides: list[Side], hot: HotKeys, parts: int, pairs: DataFrame | None) -> DataFrame:
    """(drug1, drug2, side_effect, n) over the cases that are not hot, of all pairs or those of a small table.

    A row for each case and reaction moves, with the drugs of the case. The pairs are made where the rows of a reaction
    are, and are counted there: their number, and that of their groups, changes nothing of what is shuffled. A reaction
    of very many rows is cut by the first drugs of its pairs.
    """
    drugs, _, effects = sides
    # Names move as numbers in their order, where these are few enough to be sent to every task.
    drug_codes = name_codes(drugs.df, "drug1")
    effect_codes = name_codes(effects.df, "side_effect")
    drugs = replace(drugs, df=coded(drugs.df, "drug1", drug_codes))
    effects = replace(effects, df=coded(effects.df, "side_effect", effect_codes))
    # About: as if the cases of all reactions were alike.
    made = hot.rows(sides) / 2 / max(hot.rows([effects]), 1)
    weights = effects.df.groupBy("side_effect").agg((F.count(F.lit(1)) * made).alias("weight"))
    heavy = heavy_values(weights, ["side_effect"], skew.TASK_JOINED)

    in_case = cool_rows(drugs, CASE, hot.keys, True, parts).groupBy(CASE)
    in_case = in_case.agg(F.sort_array(F.collect_list("drug1")).alias("drugs")).filter(F.size("drugs") > 1)
    met = cool_rows(effects, CASE, hot.keys, True, parts).join(in_case, CASE).select("side_effect", "drugs")
    met = by_value(met, "side_effect", F.col("drugs"), heavy, parts)
    first = met.select("side_effect", CELL, CELLS, "drugs", F.posexplode("drugs").alias("place", "drug1"))
    first = first.filter((F.col("place") < F.size("drugs") - 1) & in_cell("drug1"))
    later = F.slice("drugs", F.col("place") + 2, F.size("drugs"))
    both = first.select("side_effect", CELL, "drug1", F.explode(later).alias("drug2"))
    if pairs is not None:
        for name in PAIR:
            pairs = coded(pairs, name, drug_codes)
    counted = _of_pairs(both, pairs).groupBy(*PAIR, "side_effect", CELL).agg(F.count(F.lit(1)).alias("n"))
    counted = decoded(counted.select(*PAIR, "side_effect", "n"), "side_effect", effect_codes)
    return decoded(decoded(counted, "drug1", drug_codes), "drug2", drug_codes)


def _with_hot_cases(counted: DataFrame, pair: list[Side], reactions: Side, hot: HotKeys, k: int) -> DataFrame:
    """Counts per pair and reaction including hot cases, complete for the best `k` reactions of every pair.

    `counted` has the counts of the other cases. Pairs that occur in the same hot cases get the same
    addition, so it is made once per such set of cases, not once per pair. Reactions counted elsewhere
    get theirs added. Of the reactions a pair has from hot cases only, the best k of its set are enough:
    each of those has at least the count of any other.
    """
    pairs = hot_join(pair, CASE, hot, distinct=True).filter("drug1 < drug2")
    pairs = cut_lineage(pairs.groupBy(*PAIR).agg(F.sort_array(F.collect_list(CASE)).alias("cases")))
    found = cut_lineage(reactions.df.join(F.broadcast(hot.keys), CASE, "left_semi").distinct())

    sets = pairs.select("cases").distinct().withColumn(CASE, F.explode("cases"))
    added = hot_join([Side(sets, ("cases",)), Side(found, ("side_effect",))], CASE, hot, distinct=True)
    added = added.groupBy("cases", "side_effect").agg(F.sum("n").alias("n"))
    order = best_first("n", "side_effect")
    best = cut_lineage(top_k_per_key(added, ["cases"], k, order).select("cases", "side_effect", F.col("n").alias("more")))
    only_hot = product_join([Side(pairs, tuple(PAIR)), Side(best)], "cases")
    only_hot = only_hot.select(*PAIR, "side_effect", F.col("more").alias("n"))

    hits = counted.join(pairs, PAIR, "left").withColumn(CASE, F.explode_outer("cases"))
    marks = found.select(F.col(CASE).alias("hot_case"), F.col("side_effect").alias("hot_effect"), F.lit(1).alias("hit"))
    same = (F.col(CASE) == F.col("hot_case")) & F.col("side_effect").eqNullSafe(F.col("hot_effect"))
    both = (
        hits.join(broadcast_if_small(marks), same, "left")
        .groupBy(*PAIR, "side_effect", "n")
        .agg(F.count("hit").alias("more"))
    )
    both = both.select(*PAIR, "side_effect", (F.col("n") + F.col("more")).alias("n"))
    return both.unionByName(only_hot).groupBy(*PAIR, "side_effect").agg(F.max("n").alias("n"))


def pair_interactions_for(
    drug: DataFrame, reac: DataFrame, pairs: DataFrame, k: int | None = 10, hot: HotKeys | None = None
) -> DataFrame:
    """The pair report for each (drug1, drug2) of a request table, without a self-join.

    Every drug of a case is matched with the requests naming it; the case belongs to a request when both
    places are filled. A drug paired with itself gives its own reactions. Names are asked and given as `name_key`.
    """
    wanted = pairs.select(name_key("drug1").alias("drug1"), name_key("drug2").alias("drug2")).distinct()
    places = F.array(
        F.struct(F.col("drug1").alias("drug"), F.lit(1).alias("place")),
        F.struct(F.col("drug2").alias("drug"), F.lit(2).alias("place")),
    )
    named = wanted.select("drug1", "drug2", F.inline(places))
    if is_small(named):
        cases = cases_with_both(drug, named, PAIR, hot)
    else:
        hits = product_join([Side(all_drugs(drug), (CASE,)), Side(named)], "drug")
        has = [F.max(F.col("place") == n).alias(f"has{n}") for n in (1, 2)]
        cases = hits.groupBy(CASE, *PAIR).agg(*has).filter("has1 and has2").select(CASE, *PAIR)
    if hot is None:
        cases = cut_lineage(cases)  # written once, then counted and joined
    counted = effect_counts([Side(cases, ("drug1", "drug2")), reaction_side(reac)], [*PAIR, "side_effect"], True, hot)
    counted = counted.withColumnsRenamed({"side_effect": "shared_side_effect", "report_count": "shared_report_count"})
    return _ranked(counted, ["drug1", "drug2"], k, ["shared_side_effect"], "shared_report_count")
