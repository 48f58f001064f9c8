"""Conversations, tables of requests and the scoring of answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch.functions.columns import name_key
from casewatch.operators.batch import pair_interactions_for, report_counts, segment_effect_counts
from casewatch.operators.counts import by_outcome, hot_cases, stored_cases
from casewatch.plans.lineage import cut_lineage
from casewatch.plans.ranking import best_first, top_k_per_key
from casewatch.plans.sizing import broadcast_if_small
from casewatch.plans.skew import HotKeys, Side, product_join
from casewatch.schemas import SEVERE_OUTCOMES

# Kinds of request, one per report.
TOP, PAIR, SEGMENT, SEVERE = "top", "pair", "segment", "severe"
ANSWER_COLUMNS = ("kind", "drug", "drug2", "any_age", "age_group", "any_sex", "sex", "rank", "side_effect", "outcome_code", "report_count")


def last_turn(conversations: DataFrame, asks_tool: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, text, asks_tool): the last message of every conversation.

    A message still asks for a tool when its `tool_calls` array has entries; tables without that column
    pass their own condition. Each task first keeps one message per conversation.
    """
    if asks_tool is None:
        asks_tool = F.size("tool_calls") > 0 if "tool_calls" in conversations.columns else F.lit(False)
    message = F.struct("turn", "role", "text", F.coalesce(asks_tool, F.lit(False)).alias("asks_tool"))
    return conversations.groupBy("conv_id").agg(F.max(message).alias("last")).select("conv_id", "last.*")


def with_system_turn(conversations: DataFrame, text: str) -> DataFrame:
    """All messages, and for every conversation a system message before them (turn -1)."""
    messages = conversations.select("conv_id", "turn", "role", "text")
    first = messages.select("conv_id").distinct().select(
        "conv_id", F.lit(-1).cast(messages.schema["turn"].dataType).alias("turn"), F.lit("system").alias("role"), F.lit(text).alias("text")
    )
    return messages.unionByName(first)


def request_keys(requests: DataFrame, *more: str) -> DataFrame:
    """Requests with the keys of the answer table, and other columns of theirs."""
    return requests.select(
        *more,
        "request_id",
        "kind",
        name_key("drug").alias("drug"),
        name_key("drug2").alias("drug2"),
        F.col("age_group").isNull().alias("any_age"),
        "age_group",
        F.col("sex").isNull().alias("any_sex"),
        "sex",
    )


def asked_drugs(keys: DataFrame, kind: str | Column) -> DataFrame:
    """The questions of one kind that name a drug."""
    return keys.filter(F.col("kind") == kind).filter("drug is not null")


def answer_rows(df: DataFrame, kind: str, *given: str) -> DataFrame:
    """Ranked rows of a report as `ANSWER_COLUMNS`; the columns `given` are its own, the others of a question are open."""
    own = {"drug", "rank", "side_effect", "report_count", *given}
    other = {"kind": F.lit(kind), "any_age": F.lit(True), "any_sex": F.lit(True)}
    return df.select(
        *[F.col(c) if c in own else other.get(c, F.lit(None).cast("string")).alias(c) for c in ANSWER_COLUMNS]
    )


def segment_answers(
    drug: DataFrame,
    reac: DataFrame,
    demographics: DataFrame,
    k: int,
    drugs: DataFrame | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Top reactions per drug within every age group and sex, every age group, every sex, and overall.

    The wider segments add up the counts of the narrow ones, so the join runs once.
    """
    counted = segment_effect_counts(drug, reac, demographics, drugs, hot=hot, together=["drug", "side_effect"], levels=4)
    keys = ["drug", "any_age", "age_grp", "any_sex", "sex"]
    return top_k_per_key(_segment_levels(counted), keys, k, best_first("report_count", "side_effect"))


def _segment_levels(counted: DataFrame) -> DataFrame:
    """Counts of segments, added up to every age group, every sex, and overall."""

    def level(any_age: bool, any_sex: bool) -> DataFrame:
        kept = ["drug", *([] if any_age else ["age_grp"]), *([] if any_sex else ["sex"]), "side_effect"]
        rows = counted.groupBy(*kept).agg(F.sum("report_count").alias("report_count"))
        open_columns = {"any_age": F.lit(any_age), "any_sex": F.lit(any_sex)}
        return rows.select(
            "drug",
            *[F.col(c) if c in kept else F.lit(None).cast("string").alias(c) for c in ("age_grp", "sex")],
            "side_effect",
            "report_count",
            *[value.alias(c) for c, value in open_columns.items()],
        )

    # One shuffle of the joined rows serves all levels; grouping sets would copy every row before theirs.
    levels = [level(any_age, any_sex) for any_age in (False, True) for any_sex in (False, True)]
    return reduce(DataFrame.unionByName, levels)


def _asked_values(demographics: DataFrame, keys: DataFrame) -> DataFrame:
    """Demographics whose age groups and sexes that no question names are NULL, to be counted together."""
    for column, name in (("age_grp", "age_group"), ("sex", "sex")):
        asked = asked_drugs(keys, SEGMENT).select(F.col(name).alias("asked")).dropna().distinct()
        met = demographics.join(broadcast_if_small(asked), F.col(column) == F.col("asked"), "left")
        demographics = met.withColumn(column, F.col("asked")).drop("asked")
    return demographics


def _ranked_questions(counted: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """The top k of the top, severe and segment questions, as `ANSWER_COLUMNS`, from `report_counts`."""
    overall = counted.groupBy("drug", "side_effect").agg(*[F.sum(c).alias(c) for c in ("report_count", *SEVERE_OUTCOMES)])
    inside = counted.filter("in_segment > 0").select("drug", "age_grp", "sex", "side_effect", F.col("in_segment").alias("report_count"))
    found = [
        answer_rows(overall.withColumn("rank", F.lit(0)), TOP),
        answer_rows(by_outcome(overall).withColumn("rank", F.lit(0)), SEVERE, "outcome_code"),
        answer_rows(
            _segment_levels(inside).withColumnRenamed("age_grp", "age_group").withColumn("rank", F.lit(0)),
            SEGMENT,
            "any_age",
            "age_group",
            "any_sex",
            "sex",
        ),
    ]
    question = ["kind", "drug", "any_age", "age_group", "any_sex", "sex"]
    open_or = {"any_age": F.lit(True), "any_sex": F.lit(True)}
    segment = F.col("kind") == SEGMENT
    asked = asked_drugs(keys.filter(F.col("kind").isin(TOP, SEVERE, SEGMENT)), F.col("kind")).select(
        "kind", "drug", *[F.when(segment, F.col(c)).otherwise(open_or.get(c, F.lit(None))).alias(c) for c in question[2:]]
    )
    rows, wanted = reduce(DataFrame.unionByName, found).alias("f"), broadcast_if_small(asked.distinct()).alias("w")
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"w.{c}")) for c in question]
    best = rows.join(wanted, same, "left_semi").drop("rank")
    return top_k_per_key(best, question, k, best_first("report_count", "side_effect", "outcome_code"))


def answer_table(
    drug: DataFrame, reac: DataFrame, outcome: DataFrame, demographics: DataFrame, requests: DataFrame, k: int = 10
) -> DataFrame:
    """The answers to all different requests of a table, keyed as `ANSWER_COLUMNS`; written, to be looked up often.

    The case tables are written once as the reports read them, then one join counts all that is asked about single drugs
    and another what is asked about pairs. Segments that no request names have no rows.
    """
    # Each different question once; written, as every kind reads it and counts it first.
    keys = cut_lineage(request_keys(requests).drop("request_id").distinct())
    t = stored_cases(drug, reac, outcome, demographics, "age_grp", "sex")
    hot = hot_cases(t.drug, t.reac, demographics=t.demographics)
    named = keys.filter(F.col("kind").isin(TOP, SEVERE, SEGMENT)).select("drug")
    # Written: the counts are read once for each width.
    counted = cut_lineage(report_counts(t.drug, t.reac, t.outcome, _asked_values(t.demographics, keys), named, hot), "counts")
    asked_pairs = asked_drugs(keys, PAIR).select(F.col("drug").alias("drug1"), F.col("drug2").alias("drug2"))
    pair = pair_interactions_for(t.drug, t.reac, asked_pairs, k, hot).select(
        F.col("drug1").alias("drug"),
        "drug2",
        "rank",
        F.col("shared_side_effect").alias("side_effect"),
        F.col("shared_report_count").alias("report_count"),
    )
    single = _ranked_questions(counted, keys, k).select(*ANSWER_COLUMNS)
    return cut_lineage(single.unionByName(answer_rows(pair, PAIR, "drug2")), "answers")


def request_key(kind: str | Column = "kind") -> Column:
    """One text per different question, equal in a request and in its answers."""

    def part(column: str, unused: Column) -> Column:
        given = F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("?"))
        return F.when(unused, F.lit("*")).otherwise(given)

    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.concat_ws(
        "\u0001",
        kind,
        F.col("drug"),
        part("drug2", kind != PAIR),
        part("age_group", (kind != SEGMENT) | F.col("any_age")),
        part("sex", (kind != SEGMENT) | F.col("any_sex")),
    )


ANSWERED, NO_DRUG, UNKNOWN_KIND, NO_REPORTS = "answered", "no_drug", "unknown_kind", "no_reports"
GIVEN = ("rank", "side_effect", "outcome_code", "report_count")


def request_status() -> Column:
    """Whether a request, joined to its answers, has any, and if not, why."""
    drugless = F.col("drug").isNull() | ((F.col("kind") == PAIR) & F.col("drug2").isNull())
    return (
        F.when(F.col("rank").isNotNull(), ANSWERED)
        .when(~F.coalesce(F.col("kind").isin(TOP, PAIR, SEGMENT, SEVERE), F.lit(False)), UNKNOWN_KIND)
        .when(drugless, NO_DRUG)
        .otherwise(NO_REPORTS)
    )


def asked_questions(requests: DataFrame) -> DataFrame:
    """Requests with the text of their question, NULL without a drug, and `most`, the rows wanted (column `k`, if any)."""
    keys = request_keys(requests) if "k" not in requests.columns else request_keys(requests, "k")
    question = F.when(F.col("drug").isNotNull(), request_key())
    most = F.col("k") if "k" in requests.columns else F.lit(None).cast("int")
    return keys.select("request_id", "kind", "drug", "drug2", most.alias("most"), question.alias("question"))


def lookup_answers(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """(request_id, kind, rank, side_effect, outcome_code, report_count) from a finished answer table.

    A request with a `k` gets at most that many rows, and no more than the table has. A question asked very often is
    split; its few answer rows are copied to the parts.
    """
    return lookup_all(requests, answers).filter(F.col("status") == ANSWERED).drop("status")


def lookup_all(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """As `lookup_answers`, with `status`, and one row for every request that has no answers."""
    asked = asked_questions(requests)
    given = answers.select(request_key().alias("question"), *GIVEN)
    found = product_join([Side(asked, ("request_id",)), Side(given, optional=True)], "question")
    wanted = found.filter(F.col("most").isNull() | F.col("rank").isNull() | (F.col("rank") <= F.col("most")))
    return wanted.select("request_id", "kind", *GIVEN, request_status().alias("status"))


def answer_requests(
    drug: DataFrame, reac: DataFrame, outcome: DataFrame, demographics: DataFrame, requests: DataFrame, k: int = 10
) -> DataFrame:
    """Answer a table (request_id, kind, drug, drug2, age_group, sex) in one go; see `answer_table`."""
    return lookup_answers(requests, answer_table(drug, reac, outcome, demographics, requests, k))


def expected_fact_recall(
    answers: DataFrame, expectations: DataFrame, key: str = "question_id", synonyms: DataFrame | None = None
) -> DataFrame:
    """(key, fact_count, found_count, recall): how many expected facts the answers to a question contain.

    `answers` has (key, answer) with one or more texts per question, `expectations` one array
    `expected_facts` per question, `synonyms` optional (fact, synonym) rows. Texts compare lower-cased.
    A question without answers has recall 0, one without facts a fact count of 0 and recall NULL. NULL facts do not
    count, and a fact named on several rows of a question counts once.
    """
    listed = expectations.select(key, F.explode_outer("expected_facts").alias("fact"))
    facts = cut_lineage(listed.select(key, F.lower("fact").alias("fact")).distinct())  # read twice below
    spellings = facts.withColumn("spelling", F.col("fact"))
    if synonyms is not None:
        others = synonyms.select(F.lower("fact").alias("fact"), F.lower("synonym").alias("spelling"))
        spellings = spellings.unionByName(facts.join(others, "fact").select(key, "fact", "spelling")).distinct()
    texts = answers.select(key, F.lower("answer").alias("answer")).distinct()
    # A question has few facts. Both sides shuffle straight into the join, so adaptive execution can
    # split a question with very many answers.
    found = (
        texts.join(spellings, key)
        .filter(F.contains("answer", "spelling"))
        .select(key, "fact")
        .distinct()
        .withColumn("found", F.lit(1))
    )
    return (
        facts.join(found, [key, "fact"], "left")
        .groupBy(key)
        .agg(F.count("fact").alias("fact_count"), F.count("found").alias("found_count"))
        .withColumn("recall", F.try_divide("found_count", "fact_count"))
    )


def retrieval_recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, expected_count, found_count, recall) of retrieved (query_id, id) rows against exact ones."""
    found = approx.select("query_id", "id").distinct().withColumn("found", F.lit(1))
    return (
        exact.select("query_id", "id")
        .join(found, ["query_id", "id"], "left")
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("expected_count"), F.count("found").alias("found_count"))
        .withColumn("recall", F.col("found_count") / F.col("expected_count"))
    )
