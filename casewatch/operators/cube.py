"""A stored table of counts that reports read in place of the case tables.

Each row counts a drug (as primary suspect) with a reaction at one level: of all reports (`effect`), of one severe
outcome (`outcome`), or of one age group and sex (`segment`). A case has all its rows in one part (a quarter, say), so
counts of different parts add up: a new part is written beside the others, and a part that is written again replaces
only its own rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.functions.columns import name_key
from casewatch.operators.answers import PAIR, SEGMENT, SEVERE, TOP, answer_rows, asked_drugs, request_keys
from casewatch.operators.case_sets import pair_interactions_from_sets
from casewatch.operators.counts import reactions, segments, severe_outcomes, suspect_drugs
from casewatch.plans.lineage import cut_lineage
from casewatch.plans.ranking import best_first, coded, decoded, name_codes, top_k_per_key
from casewatch.plans.sizing import broadcast_if_small
from casewatch.plans.skew import heavy_values
from casewatch.schemas import CASE

EFFECT, OUTCOME, BY_SEGMENT = "effect", "outcome", "segment"
KEYS = ["drug", "side_effect", "outcome_code", "age_grp", "sex"]
SCHEMA = ", ".join([*[f"{c} string" for c in KEYS], "report_count bigint", "case_count bigint", "part string", "level string"])
# Drug and reaction pairs of one case that a task makes; the drugs of a case with more are dealt over tasks.
MAX_CASE_PAIRS = 1_000_000
# Rows of all levels that a task counts at a time, about.
TASK_LEVELS = 4_000_000

_DRUG, _REACTION, _OUTCOME, _SEGMENT = range(4)


def _of_kind(rows: DataFrame, kind: int, a: str, b: str | None = None) -> DataFrame:
    second = F.lit(None).cast("string") if b is None else F.col(b)
    return rows.select(CASE, F.lit(kind).alias("kind"), F.col(a).alias("a"), second.alias("b"))


def case_rows(drug: DataFrame, reac: DataFrame, outcome: DataFrame, demographics: DataFrame) -> DataFrame:
    """One row per case with its different suspect drugs, reactions, severe outcomes and segments, each with its count.

    All four tables move once, by case, and meet there. Equal values of a case are counted apart first, so a case holds
    no more than its different values. Cases without suspect drug or reaction are left out.
    """
    rows = [
        _of_kind(suspect_drugs(drug), _DRUG, "drug"),
        _of_kind(reactions(reac), _REACTION, "side_effect"),
        _of_kind(severe_outcomes(outcome), _OUTCOME, "outcome_code"),
        _of_kind(segments(demographics), _SEGMENT, "age_grp", "sex"),
    ]
    together = reduce(DataFrame.union, rows).where(F.col(CASE).isNotNull())
    # By number: joined to fewer by their stored size, tasks would hold very many rows.
    by_case = together.repartition(int(together.sparkSession.conf.get("spark.sql.shuffle.partitions")), CASE)
    counted = by_case.groupBy(CASE, "kind", "a", "b").agg(F.count(F.lit(1)).alias("n"))

    def held(kind: int, *names: tuple[str, str]) -> Column:
        value = F.struct(*[F.col(c).alias(name) for c, name in names], F.col("n"))
        return F.collect_list(F.when(F.col("kind") == kind, value))

    cases = counted.groupBy(CASE).agg(
        held(_DRUG, ("a", "drug")).alias("drugs"),
        held(_REACTION, ("a", "side_effect")).alias("effects"),
        held(_OUTCOME, ("a", "outcome_code")).alias("outcomes"),
        held(_SEGMENT, ("a", "age_grp"), ("b", "sex")).alias("segments"),
    )
    return cases.where((F.size("drugs") > 0) & (F.size("effects") > 0))


_LEVELS = "array<struct<level:string,outcome_code:string,age_grp:string,sex:string,times:bigint>>"


def _level(level: str, n: Column, **values: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(level), *[values.get(c, none) for c in ("outcome_code", "age_grp", "sex")], n)


def _case_levels() -> Column:
    """The levels that a case counts at, in one order whatever the order of its values."""
    return F.concat(
        F.array(_level(EFFECT, F.lit(1).cast("bigint"))).cast(_LEVELS),
        F.transform(F.sort_array("outcomes"), lambda o: _level(OUTCOME, o["n"], outcome_code=o["outcome_code"])).cast(_LEVELS),
        F.transform(F.sort_array("segments"), lambda s: _level(BY_SEGMENT, s["n"], age_grp=s["age_grp"], sex=s["sex"])).cast(_LEVELS),
    )


def _pairs(cases: DataFrame, heavy: bool) -> DataFrame:
    """(drug, side_effect, n, levels), a row for each drug and reaction of a case; `heavy` where cases may have very many:
    their drugs are dealt over tasks."""
    pairs = F.size("drugs").cast("bigint") * F.size("effects")
    given = cases.select(CASE, pairs.alias("pairs"), "effects", "levels", F.inline("drugs").alias("drug", "drug_n"))
    if heavy:
        many = given.where(F.col("pairs") > MAX_CASE_PAIRS).repartition(CASE, "drug")
        given = given.where(F.col("pairs") <= MAX_CASE_PAIRS).unionByName(many)
    each = given.select("drug", "drug_n", F.inline("effects").alias("side_effect", "effect_n"), "levels")
    return each.select("drug", "side_effect", (F.col("drug_n") * F.col("effect_n")).alias("n"), "levels")


def _counted(pairs: DataFrame) -> DataFrame:
    """Rows of `_pairs` to rows of the cube; rows that are dealt by drug and reaction do not move."""
    each = pairs.select("drug", "side_effect", "n", F.inline("levels"))
    return each.groupBy("level", *KEYS).agg(
        F.sum(F.col("n") * F.col("times")).alias("report_count"), F.count(F.lit(1)).alias("case_count")
    )


def _heavy_pairs(pairs: DataFrame) -> DataFrame | None:
    """The drugs with a reaction that count the levels of very many tasks, or None; few."""
    sizes = pairs.select("drug", "side_effect", F.size("levels").alias("weight"))
    effects = heavy_values(sizes.groupBy("side_effect").agg(F.sum("weight").alias("weight")), ["side_effect"], TASK_LEVELS)
    if effects is None:
        return None
    same = F.col("side_effect").eqNullSafe(F.col("_heavy"))
    met = sizes.join(F.broadcast(effects.select(F.col("side_effect").alias("_heavy"))), same, "left_semi")
    found = met.groupBy("drug", "side_effect").agg(F.sum("weight").alias("weight"))
    heavy = heavy_values(found, ["drug", "side_effect"], TASK_LEVELS)
    return None if heavy is None else heavy.select(F.col("drug").alias("_drug"), F.col("side_effect").alias("_effect"))


def count_cube(drug: DataFrame, reac: DataFrame, outcome: DataFrame, demographics: DataFrame) -> DataFrame:
    """(level, drug, side_effect, outcome_code, age_grp, sex, report_count, case_count) over all cases.

    `report_count` counts joined rows and `case_count` distinct cases, as the reports do. Where the rows of all levels
    are many they do not move: a row for each drug and reaction of a case does, in numbers, and the levels are made and
    counted where all rows of a drug and a reaction are. Those of very many rows are counted before their shuffle.
    """
    rows = case_rows(drug, reac, outcome, demographics)
    cases = cut_lineage(rows.select(CASE, "drugs", "effects", _case_levels().alias("levels")), "cases")
    pairs = F.size("drugs").cast("bigint") * F.size("effects")
    most, rows = cases.agg(F.coalesce(F.max(pairs), F.lit(0)), F.coalesce(F.sum(pairs * F.size("levels")), F.lit(0))).first()
    each = _pairs(cases, most > MAX_CASE_PAIRS)
    # What a file split of cases makes grows with the file; the counts of a task must not.
    parts = -(-rows // TASK_LEVELS)
    if parts <= max(cases.sparkSession.sparkContext.defaultParallelism, 1):
        return _counted(each)
    names = {"drug": F.inline("drugs").alias("drug", "n"), "side_effect": F.inline("effects").alias("side_effect", "n")}
    codes = {c: name_codes(cases.select(values), c) for c, values in names.items()}
    profiles = name_codes(cases, "levels")
    heavy = _heavy_pairs(each)
    light = _pairs(coded(cases, "levels", profiles), most > MAX_CASE_PAIRS)
    if heavy is not None:
        same = F.col("drug").eqNullSafe(F.col("_drug")) & F.col("side_effect").eqNullSafe(F.col("_effect"))
        light = light.join(F.broadcast(heavy), same, "left_anti")
    for name in codes:
        light = coded(light, name, codes[name])
    counted = _counted(decoded(light.repartition(parts, "drug", "side_effect"), "levels", profiles))
    for name in codes:
        counted = decoded(counted, name, codes[name])
    return counted if heavy is None else counted.unionByName(_counted(each.join(F.broadcast(heavy), same, "left_semi")))


def write_cube(cube: DataFrame, folder: str, part: str) -> None:
    """Write the counts of one part; only the folders of that part are touched.

    Rows stay in the tasks that counted them, so a frequent drug fills no task; files are sorted by drug.
    """
    rows = cube.withColumn("part", F.lit(part))
    writer = rows.sortWithinPartitions("level", "drug").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("part", "level").parquet(folder)


def read_cube(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of all parts that are there; what reads them adds them up."""
    return spark.read.schema(SCHEMA).parquet(folder)


def _level_counts(cube: DataFrame, level: str, keys: list[str], drugs: DataFrame | None, distinct_cases: bool) -> DataFrame:
    rows = cube.where(F.col("level") == level)
    if drugs is not None:
        named = drugs.select(name_key("drug").alias("drug")).where("drug IS NOT NULL").distinct()
        rows = rows.join(broadcast_if_small(named), "drug", "left_semi")
    return rows.groupBy(*keys).agg(F.sum("case_count" if distinct_cases else "report_count").alias("report_count"))


def _ranked(counted: DataFrame, keys: list[str], k: int | None, ties: list[str]) -> DataFrame:
    return top_k_per_key(counted, keys, k, best_first("report_count", *ties)).select(*keys, "rank", *ties, "report_count")


def top_from_cube(cube: DataFrame, k: int | None = 10, drugs: DataFrame | None = None, distinct_cases: bool = False) -> DataFrame:
    """As `top_side_effects_by_drug`."""
    return _ranked(_level_counts(cube, EFFECT, ["drug", "side_effect"], drugs, distinct_cases), ["drug"], k, ["side_effect"])


def severe_from_cube(cube: DataFrame, k: int | None = 10, drugs: DataFrame | None = None, distinct_cases: bool = False) -> DataFrame:
    """As `severe_side_effects_by_drug`."""
    ties = ["side_effect", "outcome_code"]
    return _ranked(_level_counts(cube, OUTCOME, ["drug", *ties], drugs, distinct_cases), ["drug"], k, ties)


def segments_from_cube(cube: DataFrame, k: int | None = 10, drugs: DataFrame | None = None, distinct_cases: bool = False) -> DataFrame:
    """As `side_effects_by_segment`."""
    keys = ["drug", "age_grp", "sex"]
    return _ranked(_level_counts(cube, BY_SEGMENT, [*keys, "side_effect"], drugs, distinct_cases), keys, k, ["side_effect"])


def asked_segments_from_cube(cube: DataFrame, asked: DataFrame, k: int | None = 10) -> DataFrame:
    """Top reactions for each (drug, any_age, age_group, any_sex, sex) of `asked`: only the widths that are asked for
    are added up."""
    keys = ["drug", "any_age", "age_group", "any_sex", "sex"]
    wanted = broadcast_if_small(asked.select(*keys).distinct().withColumnRenamed("sex", "asked_sex"))
    rows = cube.where(F.col("level") == BY_SEGMENT).drop("level", "part", "outcome_code")
    fits = (F.col("any_age") | (F.col("age_grp") == F.col("age_group"))) & (F.col("any_sex") | (F.col("sex") == F.col("asked_sex")))
    hits = rows.join(wanted, "drug").where(fits).drop("sex").withColumnRenamed("asked_sex", "sex")
    counted = hits.groupBy(*keys, "side_effect").agg(F.sum("report_count").alias("report_count"))
    return top_k_per_key(counted, keys, k, best_first("report_count", "side_effect"))


def answer_table_from_cube(cube: DataFrame, sets: DataFrame, requests: DataFrame, k: int = 10) -> DataFrame:
    """As `answer_table`, from a stored cube and stored sets of cases: no case table is read."""
    keys = cut_lineage(request_keys(requests).drop("request_id").distinct(), "questions")
    top = top_from_cube(cube, k, asked_drugs(keys, TOP))
    severe = severe_from_cube(cube, k, asked_drugs(keys, SEVERE))
    segment = asked_segments_from_cube(cube, asked_drugs(keys, SEGMENT), k)
    pairs = asked_drugs(keys, PAIR).select(F.col("drug").alias("drug1"), F.col("drug2"))
    pair = pair_interactions_from_sets(sets, k, pairs=pairs).select(
        F.col("drug1").alias("drug"),
        "drug2",
        "rank",
        F.col("shared_side_effect").alias("side_effect"),
        F.col("shared_report_count").alias("report_count"),
    )
    return (
        answer_rows(top, TOP)
        .unionByName(answer_rows(severe, SEVERE, "outcome_code"))
        .unionByName(answer_rows(segment, SEGMENT, "any_age", "age_group", "any_sex", "sex"))
        .unionByName(answer_rows(pair, PAIR, "drug2"))
    )
