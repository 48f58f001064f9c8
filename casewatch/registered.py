"""Every operator as a query over the star-schema tables of one folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.functions.columns import with_name_keys
from casewatch.functions.table_functions import register_table_functions
from casewatch.operators import answers, batch, case_sets, cube, name_index, names, questions, reports, severity, vector_index, vectors
from casewatch.operators.counts import all_drugs, drug_side, effect_counts, reaction_side
from casewatch.plans.lineage import cut_lineage, new_dir
from casewatch.plans.ranking import best_first, top_k_per_key
from casewatch.schemas import SCHEMAS
from casewatch.sources import case_files, tables
from casewatch.sources.star_schema import CaseTables, case_tables, read
from casewatch.streaming import intake
from casewatch.streaming import requests as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Sample arguments.
DRUG, OTHER_DRUG = "red plate", "small widget"
AGE_GROUP, SEX, AGE_OVER = "1-URGENT", "F", 65
EFFECT = "Supplier#000000007"
# Ages that are put in place of others; only the last is one.
BAD_AGES = {"1": "NaN", "2": "Infinity", "3": "70d", "4": "-5", "5": "1e3", "6": " 90.5 "}
WEIGHTS = {"DE": 10.0, "LT": 5.0, "HO": 2.0, "DS": 3.0}
SYSTEM_TEXT = "Answer from the report counts only."


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def over_cases(function: Callable[[CaseTables], DataFrame]) -> Query:
    """Register a query that needs the case tables only."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(case_tables(spark, folder))

    run.__name__ = function.__name__
    return query(run)


# One drug, one pair


@over_cases
def q1(t):
    return reports.top_side_effects(t.drug, t.reac, "Red Plate")


@over_cases
def q1_distinct_cases(t):
    return reports.top_side_effects(t.drug, t.reac, " Red Plate ", k=5, trim=True, distinct_cases=True)


@over_cases
def q2(t):
    return reports.drug_pair_interactions(t.drug, t.reac, DRUG, OTHER_DRUG)


@over_cases
def q2_same_drug(t):
    return reports.drug_pair_interactions(t.drug, t.reac, DRUG, DRUG)


@over_cases
def q3(t):
    return reports.side_effect_by_demographics(t.drug, t.reac, t.demographics, DRUG, AGE_GROUP, SEX)


@over_cases
def q3_any_age(t):
    return reports.side_effect_by_demographics(t.drug, t.reac, t.demographics, DRUG, None, SEX)


@over_cases
def q4(t):
    return reports.severe_side_effects(t.drug, t.reac, t.outcome, DRUG)


@over_cases
def q4_stored_key(t):
    return reports.severe_side_effects(with_name_keys(t.drug), t.reac, t.outcome, DRUG, trim=True)


@over_cases
def q5(t):
    return reports.curated_drug_names(t.drug)


@over_cases
def q5_ingredients(t):
    return reports.curated_drug_names(t.drug, "prod_ai")


# All drugs, pairs and segments


@over_cases
def b1(t):
    return batch.top_side_effects_by_drug(t.drug, t.reac)


@over_cases
def b1_distinct_cases(t):
    return batch.top_side_effects_by_drug(t.drug, t.reac, distinct_cases=True)


def _asked(name: str | Column) -> Column:
    """A name as people type it."""
    return F.concat(F.lit(" "), F.initcap(name), F.lit("  "))


@query
def b1_requested(spark, folder):
    t = case_tables(spark, folder)
    wanted = read(spark, folder, "part").filter("p_name like 'red %'").select(_asked("p_name").alias("drug"))
    return batch.top_side_effects_by_drug(t.drug, t.reac, 3, wanted)


@over_cases
def b2(t):
    return batch.pair_interactions_all(t.drug, t.reac)


@over_cases
def b2_min_cases(t):
    return batch.pair_interactions_all(t.drug, t.reac, k=3, min_cases=64)


@query
def b2_requested(spark, folder):
    t = case_tables(spark, folder)
    first = read(spark, folder, "part").select(_asked("p_name").alias("drug1")).distinct()
    return batch.pair_interactions_for(t.drug, t.reac, first.withColumn("drug2", _asked(F.lit(OTHER_DRUG))))


def _sets(t: CaseTables) -> DataFrame:
    return cut_lineage(case_sets.drug_and_reaction_sets(t.drug, t.reac), "sets")


@over_cases
def b2_bitmap(t):
    return case_sets.pair_interactions_from_sets(_sets(t))


@over_cases
def b2_bitmap_min_cases(t):
    return case_sets.pair_interactions_from_sets(_sets(t), k=3, min_cases=64)


@query
def b2_bitmap_requested(spark, folder):
    t = case_tables(spark, folder)
    first = read(spark, folder, "part").select(_asked("p_name").alias("drug1")).distinct()
    return case_sets.pair_interactions_from_sets(_sets(t), pairs=first.withColumn("drug2", _asked(F.lit(OTHER_DRUG))))


@over_cases
def case_counts(t):
    """Distinct cases of every drug, from the sets of two overlapping halves."""
    rows = all_drugs(t.drug)
    numbers = case_sets.case_numbers(rows)
    halves = [case_sets.case_sets(rows.filter(F.col("primaryid") % 3 != n), ["drug"], numbers) for n in (0, 1)]
    return case_sets.set_sizes(case_sets.merge_sets(*[cut_lineage(half, "sets") for half in halves]))


@over_cases
def b3(t):
    return batch.side_effects_by_segment(t.drug, t.reac, t.demographics)


def _cube(spark: SparkSession, t: CaseTables, parts: int = 1) -> DataFrame:
    """A stored cube, its cases dealt over `parts` parts; the first part is written again at the end."""
    folder = new_dir(spark, "cube")
    for n in [*range(parts), *([0] if parts > 1 else [])]:
        mine = (df.filter(F.pmod("primaryid", F.lit(parts)) == n) for df in (t.drug, t.reac, t.outcome, t.demographics))
        cube.write_cube(cube.count_cube(*(mine if parts > 1 else (t.drug, t.reac, t.outcome, t.demographics))), folder, f"q{n}")
    return cube.read_cube(spark, folder)


@query
def b1_cube(spark, folder):
    return cube.top_from_cube(_cube(spark, case_tables(spark, folder)), distinct_cases=True)


@query
def b3_cube(spark, folder):
    return cube.segments_from_cube(_cube(spark, case_tables(spark, folder), 2))


@query
def b4_cube(spark, folder):
    return cube.severe_from_cube(_cube(spark, case_tables(spark, folder)))


@over_cases
def b4(t):
    return batch.severe_side_effects_by_drug(t.drug, t.reac, t.outcome)


@over_cases
def b5(t):
    return severity.severity_summary(t.drug, t.outcome)


@over_cases
def b5_weighted(t):
    return severity.severity_summary(t.drug, t.outcome, weights=WEIGHTS)


@over_cases
def b6(t):
    return severity.frequency_severity_matrix(t.drug, t.reac, t.outcome)


@over_cases
def b7(t):
    return severity.severe_by_segment(t.drug, t.reac, t.outcome, t.demographics, DRUG, AGE_OVER)


@over_cases
def b7_one_sex(t):
    return severity.severe_by_segment(t.drug, t.reac, t.outcome, t.demographics, DRUG, AGE_OVER, SEX)


@over_cases
def b7_ages(t):
    mixed = t.demographics.withColumn("age_cod", F.when(F.col("age") == "1", "XX").otherwise(F.col("age_cod")))
    return severity.age_summary(mixed)


@over_cases
def b7_bad_ages(t):
    age = F.col("age")
    for number, text in BAD_AGES.items():
        age = F.when(F.col("age") == number, text).otherwise(age)
    return severity.severe_by_segment(t.drug, t.reac, t.outcome, t.demographics.withColumn("age", age), DRUG, AGE_OVER)


@over_cases
def b8(t):
    return severity.severe_pair_by_segment(
        t.drug, t.reac, t.outcome, t.demographics, DRUG, OTHER_DRUG, AGE_OVER
    )


@over_cases
def b9(t):
    return severity.effect_profile(t.drug, t.reac, [EFFECT])


# Names


def _phrase_dictionary(spark, folder, length):
    tokens = read(spark, folder, "benchmark").select(names.words("text", "[^a-z]+").alias("tokens"))
    return tokens.select(F.explode(names.phrases("tokens", length)).alias("drug_name")).distinct()


@query
def n1(spark, folder):
    return names.extract_mentions(read(spark, folder, "documents"), _phrase_dictionary(spark, folder, 1), gap="[^a-z]+")


@query
def n1_phrases(spark, folder):
    wanted = reduce(DataFrame.unionByName, [_phrase_dictionary(spark, folder, n) for n in (1, 2, 3)])
    return names.extract_mentions(read(spark, folder, "documents"), wanted, gap="[^a-z]+")


@query
def n1_anchored(spark, folder):
    wanted = reduce(DataFrame.unionByName, [_phrase_dictionary(spark, folder, n) for n in (1, 2, 3)])
    return names.extract_mentions_anchored(read(spark, folder, "documents"), wanted, gap="[^a-z]+")


def _misspelled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Names without their third letter, and the names as they are."""
    known = read(spark, folder, "part").select(F.col("p_name").alias("drug_name"))
    rest = F.col("drug_name").substr(F.lit(4), F.length("drug_name"))
    return known.select(F.concat(F.substring("drug_name", 1, 2), rest).alias("name")), known


@query
def n2(spark, folder):
    return names.normalize_names_fuzzy(*_misspelled(spark, folder), k=3)


@query
def n2_index(spark, folder):
    misspelled, known = _misspelled(spark, folder)
    base = new_dir(spark, "names")
    name_index.write_name_index(known, base)
    return name_index.normalize_names_indexed(misspelled, name_index.read_name_index(spark, base), k=3)


@query
def n3(spark, folder):
    points = read(spark, folder, "embeddings")
    return vectors.nearest_names_exact(points, points, other_id_only=True)


def _labelled(spark, folder):
    return read(spark, folder, "embeddings").withColumn("cell", F.col("label"))


@query
def n4(spark, folder):
    points = read(spark, folder, "embeddings")
    return vectors.nearest_names_approx(points, points, cells=8, probes=6, other_id_only=True)


@query
def n4_all_probes(spark, folder):
    points = read(spark, folder, "embeddings")
    return vectors.nearest_names_approx(points, points, cells=8, probes=8, other_id_only=True)


def _index(spark: SparkSession, folder: str) -> vector_index.Index:
    """An index written and read again."""
    base = new_dir(spark, "vectors")
    vector_index.write_index(read(spark, folder, "embeddings"), base)
    return vector_index.read_index(spark, base)


@query
def n4_index(spark, folder):
    asked = read(spark, folder, "embeddings").filter("vec_id % 20 = 0")
    return vector_index.search_index(_index(spark, folder), asked, probes=12, other_id_only=True)


@query
def n4_index_recall(spark, folder):
    asked = read(spark, folder, "embeddings").filter("vec_id % 20 = 0")
    return vector_index.index_recall(_index(spark, folder), asked, probes=12, other_id_only=True)


@query
def n4_given_cells(spark, folder):
    points = _labelled(spark, folder)
    return vectors.nearest_names_in_cells(points, points, other_id_only=True)


@query
def n4_candidates(spark, folder):
    points = _labelled(spark, folder)
    return vectors.candidate_share(points, points)


# Conversations, requests, scores


@query
def a1(spark, folder):
    return answers.last_turn(read(spark, folder, "conversations"), F.col("role") == "user")


@query
def a2(spark, folder):
    return answers.with_system_turn(read(spark, folder, "conversations"), SYSTEM_TEXT)


def sample_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every drug name in every kind of request."""
    drugs = read(spark, folder, "part").select(F.col("p_name").alias("drug")).distinct()
    kinds = [
        ("top", answers.TOP, None, None, None),
        ("severe", answers.SEVERE, None, None, None),
        ("pair", answers.PAIR, OTHER_DRUG, None, None),
        ("segment", answers.SEGMENT, None, AGE_GROUP, SEX),
        ("age", answers.SEGMENT, None, AGE_GROUP, None),
        ("sex", answers.SEGMENT, None, None, SEX),
        ("anyone", answers.SEGMENT, None, None, None),
    ]
    return reduce(
        DataFrame.unionByName,
        [
            drugs.select(
                F.concat(F.lit(f"{label}:"), "drug").alias("request_id"),
                F.lit(kind).alias("kind"),
                "drug",
                F.lit(drug2).cast("string").alias("drug2"),
                F.lit(age).cast("string").alias("age_group"),
                F.lit(sex).cast("string").alias("sex"),
            )
            for label, kind, drug2, age, sex in kinds
        ],
    )


@query
def a3(spark, folder):
    t = case_tables(spark, folder)
    return answers.answer_requests(t.drug, t.reac, t.outcome, t.demographics, sample_requests(spark, folder))


def _odd_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests for three rows each, some of which cannot be answered."""
    asked = sample_requests(spark, folder).withColumn("k", F.lit(3))
    top = asked.filter(F.col("request_id").startswith("top:"))
    odd = {
        "drugless": top.withColumn("drug", F.lit(None).cast("string")),
        "unheard": top.withColumn("drug", F.concat("drug", F.lit(" forte"))),
        "strange": top.withColumn("kind", F.lit("horoscope")),
        "half": top.withColumn("kind", F.lit(answers.PAIR)),
    }
    named = [df.withColumn("request_id", F.concat(F.lit(f"{name}:"), "request_id")) for name, df in odd.items()]
    return reduce(DataFrame.unionByName, named, asked)


@query
def a3_status(spark, folder):
    t, asked = case_tables(spark, folder), _odd_requests(spark, folder)
    return answers.lookup_all(asked, answers.answer_table(t.drug, t.reac, t.outcome, t.demographics, asked, 5))


@query
def a3_cube(spark, folder):
    t, asked = case_tables(spark, folder), sample_requests(spark, folder)
    return answers.lookup_answers(asked, cube.answer_table_from_cube(_cube(spark, t), _sets(t), asked))


@over_cases
def a4(t):
    counted = effect_counts([drug_side(all_drugs(t.drug)), reaction_side(t.reac)], ["drug", "side_effect"])
    best = top_k_per_key(counted, ["drug"], 5, best_first("report_count", "side_effect"))
    expectations = best.groupBy(F.col("drug").alias("question_id")).agg(
        F.collect_list("side_effect").alias("expected_facts")  # five per drug
    )
    given = batch.top_side_effects_by_drug(t.drug, t.reac)
    texts = given.select(F.col("drug").alias("question_id"), F.upper("side_effect").alias("answer"))
    return answers.expected_fact_recall(texts, expectations)


# Question texts as people write them, with {drug}, {other}, {third}, {wrong} (the name without its third letter).
QUESTIONS = {
    "top": "What are the top 5 side effects of {drug}?",
    "pair": "Is there an interaction between {drug} and {other}?",
    "severe": "What serious outcomes are reported for {drug} in elderly patients?",
    "females": "Tell me common side effects of {drug} in females.",
    "compare": "Which of {other}, {drug} and {third} has the most serious adverse events?",
    "wrong": "side effects for {wrong}",
    "profile": "Should I stop taking {drug} because of Supplier#000000007?",
    "severe_pair": "Serious effects of {drug} with {other}, over 65",
    "many": "Do {drug}, {other} and {third} go together?",
    "none": "Tell me a joke about supplier {number}.",
}
THIRD_DRUG = "hot rod"


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    drug = F.initcap("p_name")
    wrong = F.concat(F.substring("p_name", 1, 2), F.col("p_name").substr(F.lit(4), F.length("p_name")))
    values = {"drug": drug, "other": F.upper(F.lit(OTHER_DRUG)), "third": F.lit(THIRD_DRUG), "wrong": wrong, "number": F.lit("one")}
    parts = read(spark, folder, "part").select("p_name").distinct().where(~F.col("p_name").isin(OTHER_DRUG, THIRD_DRUG))
    asked = []
    for label, text in QUESTIONS.items():
        said = F.lit(text)
        for name, value in values.items():
            said = F.replace(said, F.lit("{" + name + "}"), value)
        asked.append(F.struct(F.concat(F.lit(f"{label}:"), "p_name").alias("request_id"), said.alias("text")))
    return parts.select(F.inline(F.array(*asked)))


def _slots(spark: SparkSession, folder: str) -> DataFrame:
    drugs = read(spark, folder, "part").select(F.col("p_name").alias("name"))
    effects = read(spark, folder, "supplier").select(F.col("s_name").alias("name"))
    return questions.question_slots(_questions(spark, folder), drugs, effects)


@query
def a7(spark, folder):
    t = case_tables(spark, folder)
    return questions.answer_slots(t.drug, t.reac, t.outcome, t.demographics, _slots(spark, folder))


@query
def a7_status(spark, folder):
    t, slots = case_tables(spark, folder), cut_lineage(_slots(spark, folder), "slots")
    return questions.question_status(slots, questions.answer_slots(t.drug, t.reac, t.outcome, t.demographics, slots))


@query
def b7_requested(spark, folder):
    t = case_tables(spark, folder)
    drugs = read(spark, folder, "part").select(_asked("p_name").alias("drug"))
    segments = [(AGE_OVER, F.lit(SEX)), (30, F.lit(None).cast("string"))]
    wanted = F.array(*[F.struct(F.lit(age).alias("age_over"), sex.alias("sex")) for age, sex in segments])
    wanted = drugs.select("drug", F.inline(wanted))
    return severity.effects_by_segments(t.drug, t.reac, t.demographics, wanted, outcome=t.outcome)


@query
def a5(spark, folder):
    t = case_tables(spark, folder)
    asked = sample_requests(spark, folder)
    base = new_dir(spark, "requests")
    table = answers.answer_table(t.drug, t.reac, t.outcome, t.demographics, asked)
    table.write.parquet(f"{base}/answers")
    streaming.split_requests(asked, f"{base}/inbox")
    stream = streaming.read_request_stream(spark, f"{base}/inbox", files_per_batch=2)
    answered = streaming.answer_requests_stream(stream, spark.read.parquet(f"{base}/answers"))
    streaming.start_answers(answered, f"{base}/outbox", f"{base}/state").awaitTermination()
    return spark.read.schema(answered.schema).parquet(f"{base}/outbox")


@query
def a6(spark, folder):
    points = _labelled(spark, folder)
    approx = vectors.nearest_names_in_cells(points, points, other_id_only=True)
    return answers.retrieval_recall_at_k(approx, vectors.nearest_names_exact(points, points, other_id_only=True))


# Sources and sinks


def _text_columns(df: DataFrame, table: str) -> DataFrame:
    """All columns of a table's schema as text, those that are not there as NULL."""
    columns = [(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in SCHEMAS[table].fieldNames()]
    return df.select(*columns)


def _as_text(df: DataFrame, table: str, spark: SparkSession, base: str) -> str:
    """Write a table as a file family; returns its pattern."""
    pattern = case_files.family_path(base, table)
    case_files.write_case_files(_text_columns(df, table), pattern.replace("*", "25Q1"))
    return pattern


def _database(spark: SparkSession) -> str:
    folder = new_dir(spark, "tables")
    name = "cases_" + folder.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}'")
    return name


@query
def s1(spark, folder):
    base = new_dir(spark, "files")
    _as_text(case_tables(spark, folder).drug, "drug", spark, base)
    return case_files.read_family(spark, base, "drug").select("primaryid", "drug_seq", "role_cod", "drugname", "prod_ai")


@query
def s2(spark, folder):
    base = new_dir(spark, "files")
    pattern = _as_text(case_tables(spark, folder).outcome, "outcome", spark, base)
    headers = case_files.check_headers(spark, pattern, SCHEMAS["outcome"])
    rows = case_files.read_family(spark, base, "outcome", strict=True)
    per_file = rows.groupBy(F.col("_metadata.file_path").alias("file_path"), "outc_cod").count()
    joined = per_file.join(headers, "file_path").groupBy("outc_cod", "header", "matches")
    return joined.agg(F.sum("count").alias("row_count"))


@query
def s3(spark, folder):
    base = new_dir(spark, "files")
    t = case_tables(spark, folder)
    parts = []
    for table, df in (("drug", t.drug), ("reac", t.reac), ("outcome", t.outcome), ("demographics", t.demographics)):
        pattern = _as_text(df, table, spark, base)
        files = case_files.file_manifest(case_files.read_family(spark, base, table), pattern)
        parts.append(files.agg(F.sum("row_count").alias("row_count")).withColumn("family", F.lit(table)))
    return reduce(DataFrame.unionByName, parts)


@query
def s4(spark, folder):
    name = f"{_database(spark)}.drug"
    written = tables.write_table(with_name_keys(case_tables(spark, folder).drug), name, sort_by=["drugname_key"])
    stored = tables.read_table(spark, name)
    return stored.groupBy("drugname_key").agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "written", F.lit(written).cast("bigint")
    )


@query
def s5(spark, folder):
    database = _database(spark)
    tables.create_tables(spark, database)
    tables.insert_table(case_tables(spark, folder).outcome, f"{database}.outcome")
    return tables.read_table(spark, f"{database}.outcome").select("primaryid", "outc_cod")


@query
def s6(spark, folder):
    database = _database(spark)
    t = case_tables(spark, folder)
    tables.write_table(t.drug, f"{database}.drug", bucket_by="primaryid", buckets=8)
    tables.write_table(t.outcome, f"{database}.outcome", bucket_by="primaryid", buckets=8)
    drug = tables.read_table(spark, f"{database}.drug", "d")
    outcome = tables.read_table(spark, f"{database}.outcome", "o")
    joined = drug.join(outcome, F.col("d.primaryid") == F.col("o.primaryid"))
    return joined.groupBy("d.role_cod", "o.outc_cod").agg(F.count(F.lit(1)).alias("row_count"))


@query
def s7(spark, folder):
    name = f"{_database(spark)}.curated_drug_names"
    tables.create_table_as(spark, name, reports.curated_drug_names(case_tables(spark, folder).drug))
    return tables.read_table(spark, name)


@query
def s7_replaced(spark, folder):
    """A table that is replaced by another query."""
    t, base, name = case_tables(spark, folder), new_dir(spark, "versions"), f"{_database(spark)}.names"
    for df in (reports.curated_drug_names(t.drug, "prod_ai"), reports.curated_drug_names(t.drug)):
        tables.replace_table(spark, name, df, base)
    return tables.read_table(spark, name)


@query
def s4_clustered(spark, folder):
    t, name = case_tables(spark, folder), f"{_database(spark)}.drug"
    tables.write_clustered(with_name_keys(t.drug), name, "drugname_key")
    return reports.severe_side_effects(tables.read_table(spark, name), t.reac, t.outcome, DRUG, trim=True)


def _intake(spark: SparkSession, inbox: str, store: str, table: str) -> None:
    intake.start_intake(spark, inbox, store, table, files_per_batch=2).awaitTermination()


@query
def s10(spark, folder):
    """Files of two quarters, taken in one after the other, then again with nothing new."""
    inbox, store = new_dir(spark, "inbox"), new_dir(spark, "store")
    outcome = case_tables(spark, folder).outcome
    for quarter in (0, 1, None):
        if quarter is not None:
            rows = outcome.filter(F.pmod("primaryid", F.lit(2)) == quarter)
            case_files.write_case_files(_text_columns(rows, "outcome").coalesce(1), f"{inbox}/OUTC25Q{quarter + 1}.txt")
        _intake(spark, f"{inbox}", store, "outcome")
    stored = intake.read_store(spark, store, "outcome").groupBy(intake.FILE, "outc_cod").agg(F.count(F.lit(1)).alias("n"))
    files = intake.read_ledger(spark, store, "outcome").select(intake.FILE, "row_count")
    return stored.join(files, intake.FILE).groupBy("outc_cod").agg(F.sum("n").alias("row_count"), F.sum("row_count").alias("in_files"))


@over_cases
def s10_versions(t):
    """Each customer's orders as versions of one case, the ones of the last version, and their reactions."""
    people = t.demographics.withColumn("caseversion", F.pmod("primaryid", F.lit(100)).cast("string"))
    latest = intake.latest_versions(people)
    return intake.of_reports(t.reac, latest).groupBy("pt").agg(F.count(F.lit(1)).alias("row_count"))


@query
def s8(spark, folder):
    t = case_tables(spark, folder)
    named = {"drug": t.drug, "reac": t.reac, "outcome": t.outcome, "demographics": t.demographics}
    counts = [(name, tables.row_count(df)) for name, df in named.items()]
    return spark.createDataFrame(counts, "table_name string, row_count bigint")


@over_cases
def s9(t):
    return tables.preview(t.drug, 20, ["primaryid", "drug_seq", "drugname", "role_cod", "prod_ai"])


@over_cases
def typed(t):
    text = t.demographics.withColumn("event_dt", F.date_format("event_dt", "yyyyMMdd"))
    months = tables.typed_demographics(text).groupBy(F.date_format("event_date", "yyyy-MM").alias("month"), "age_status")
    return months.agg(F.count(F.lit(1)).alias("row_count"), F.sum("age_years").alias("years"))


# SQL table functions


def _with_functions(spark: SparkSession, folder: str) -> None:
    t = case_tables(spark, folder)
    views = {name: f"cases_{name}" for name in ("drug", "reac", "outcome", "demographics")}
    for name, view in views.items():
        getattr(t, name).createOrReplaceTempView(view)
    register_table_functions(spark, views)


def _function_query(name: str, sql: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        _with_functions(spark, folder)
        return spark.sql(sql)

    QUERIES[name] = run


_function_query("f1", "SELECT * FROM get_top_side_effects('Red Plate')")
_function_query("f2", f"SELECT * FROM get_drug_pair_interactions('{DRUG}', '{OTHER_DRUG}')")
_function_query("f3", f"SELECT * FROM get_side_effect_by_demographics('{DRUG}', '{AGE_GROUP}', '{SEX}')")
_function_query("f4", f"SELECT * FROM get_severe_side_effects(drug => '{DRUG}')")
_function_query(
    "f1_lateral",
    "SELECT p.name AS drug, f.side_effect, f.report_count FROM "
    "(SELECT DISTINCT drugname AS name FROM cases_drug) p, LATERAL get_top_side_effects(p.name) f",
)
