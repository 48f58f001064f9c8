"""Questions as text: what they ask for, and their answers, for all questions in one job.

Names of drugs and reactions are looked up in dictionaries, numbers and groups are found by word rules, and cue words
decide between the kinds of report. Every question gets rows or a status that says why it has none.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewatch.functions.columns import name_key
from casewatch.operators.answers import ANSWERED, NO_DRUG, NO_REPORTS, PAIR, SEGMENT, SEVERE, TOP, UNKNOWN_KIND
from casewatch.operators.counts import hot_cases, stored_cases
from casewatch.operators.names import extract_mentions, normalize_names_fuzzy, phrases, words
from casewatch.operators.severity import asked_of, asked_segment_counts, best_of_segments, pair_segment_counts, severity_summary
from casewatch.plans.lineage import cut_lineage

# Kinds beyond those of request tables.
SEVERE_PAIR, COMPARE, PROFILE = "severe_pair", "compare", "profile"
KINDS = (TOP, PAIR, SEGMENT, SEVERE, SEVERE_PAIR, COMPARE, PROFILE)
TOO_MANY = "too_many_drugs"

# Cue words (lower-case); callers give their own for other languages and code tables.
SEVERE_CUES = ("serious", "severe", "fatal", "death", "deaths", "dangerous", "hospitalization", "hospitalisation")
COMPARE_CUES = ("most", "compare", "versus", "which", "worst")
SEXES: dict[str, str] = {**dict.fromkeys(("female", "females", "woman", "women"), "F"), **dict.fromkeys(("male", "males", "man", "men"), "M")}
AGE_WORDS: dict[str, float] = {"elderly": 65.0, "seniors": 65.0}
AGE_OVER = r"(?:over|above|older than|past)\s+(?:the\s+)?(?:age\s+)?(?:of\s+)?([0-9]{1,3})\b"
TOP_K = r"\btop\s+([0-9]{1,4})\b"
# Letters of the shortest phrase that is looked up as a misspelled name, and edits allowed.
MISSPELLED_LENGTH, MISSPELLED_EDITS = 5, 1


def _whole(mentions: Column) -> Column:
    """Sorted names that are not part of a longer one."""

    def inside(name: Column, other: Column) -> Column:
        return (other != name) & F.contains(F.concat(F.lit(" "), other, F.lit(" ")), F.concat(F.lit(" "), name, F.lit(" ")))

    return F.array_sort(F.filter(mentions, lambda name: ~F.exists(mentions, lambda other: inside(name, other))))


def _mentioned(texts: DataFrame, dictionary: DataFrame, result: str) -> DataFrame:
    found = extract_mentions(texts, dictionary, "request_id", "text", "name")
    return found.groupBy("request_id").agg(_whole(F.collect_set("name")).alias(result))


def _misspelled(texts: DataFrame, names: DataFrame, longest: int) -> DataFrame:
    """Names within `MISSPELLED_EDITS` edits of a run of words; of one question the closest."""
    tokens = texts.select("request_id", words("text").alias("tokens"))
    runs = F.flatten(F.array(*[phrases("tokens", n) for n in range(1, longest + 1)]))
    said = tokens.select("request_id", F.explode(F.array_distinct(runs)).alias("phrase"))
    said = said.where(F.length("phrase") >= MISSPELLED_LENGTH)
    near = normalize_names_fuzzy(said.select(F.col("phrase").alias("name")), names, 1, MISSPELLED_EDITS, "name", "name")
    near = near.select(F.col("name").alias("phrase"), "drug_name", "distance")
    best = F.min(F.struct("distance", "drug_name"))["drug_name"]
    return said.join(near, "phrase").groupBy("request_id").agg(F.array(best).alias("guessed"))


def _looked_up(tokens: Column, values: Mapping[str, object], kind: str) -> Column:
    """The value of the first word that has one."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.get(F.filter(F.transform(tokens, lambda w: F.try_element_at(table, w)), lambda v: v.isNotNull()), F.lit(0)).cast(kind)


def question_slots(
    questions: DataFrame,
    drug_names: DataFrame,
    effect_names: DataFrame,
    k: int = 10,
    sexes: Mapping[str, str] = SEXES,
    age_words: Mapping[str, float] = AGE_WORDS,
    severe_cues: Sequence[str] = SEVERE_CUES,
    compare_cues: Sequence[str] = COMPARE_CUES,
    longest_misspelled: int = 3,
) -> DataFrame:
    """(request_id, kind, drugs, effect, age_over, sex, k) of (request_id, text) rows with different ids.

    `drug_names` and `effect_names` have a column `name`. Names are found as whole words, longer before shorter; a
    question without any is searched for one with a letter wrong. `kind` is NULL where no drug is named or more than a
    report takes.
    """
    texts = cut_lineage(questions.select("request_id", "text"), "questions")
    drugs = drug_names.select(name_key("name").alias("name")).where("name <> ''").distinct()
    named = cut_lineage(_mentioned(texts, drugs, "named"), "named")
    guessed = _misspelled(texts.join(named, "request_id", "left_anti"), drugs, longest_misspelled)
    effects = _mentioned(texts, effect_names.where("name IS NOT NULL").distinct(), "effects")
    text, tokens = F.lower("text"), words("text")
    over, top = F.regexp_extract(text, AGE_OVER, 1), F.regexp_extract(text, TOP_K, 1)

    def cued(cues: Sequence[str]) -> Column:
        return F.coalesce(F.arrays_overlap(tokens, F.array(*[F.lit(c) for c in cues])), F.lit(False))

    rows = texts.join(named, "request_id", "left").join(guessed, "request_id", "left").join(effects, "request_id", "left")
    rows = rows.select(
        "request_id",
        F.coalesce("named", "guessed", F.array().cast("array<string>")).alias("drugs"),
        F.get("effects", F.lit(0)).alias("effect"),
        F.coalesce(F.when(over != "", over).cast("double"), _looked_up(tokens, age_words, "double")).alias("age_over"),
        _looked_up(tokens, sexes, "string").alias("sex"),
        F.coalesce(F.when(top != "", top).cast("int"), F.lit(k)).alias("k"),
        cued(severe_cues).alias("severe"),
        cued(compare_cues).alias("compares"),
    )
    count = F.size("drugs")
    kind = (
        F.when(count == 0, None)
        .when((count >= 2) & F.col("compares"), COMPARE)
        .when((count == 2) & F.col("severe"), SEVERE_PAIR)
        .when(count == 2, PAIR)
        .when(count > 2, None)
        .when(F.col("effect").isNotNull(), PROFILE)
        .when(F.col("severe"), SEVERE)
        .when(F.col("age_over").isNotNull() | F.col("sex").isNotNull(), SEGMENT)
        .otherwise(TOP)
    )
    return rows.select("request_id", kind.alias("kind"), "drugs", "effect", "age_over", "sex", "k")


def _rows(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = {"drug": "string", "drug2": "string", "side_effect": "string", "outcome_code": "string", "share": "double"}
    return df.select(
        "request_id",
        "kind",
        F.col("rank").cast("bigint").alias("rank"),
        *[columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()],
        F.col("report_count").cast("bigint").alias("report_count"),
    )


def answer_slots(drug: DataFrame, reac: DataFrame, outcome: DataFrame, demographics: DataFrame, slots: DataFrame) -> DataFrame:
    """(request_id, kind, rank, drug, drug2, side_effect, outcome_code, share, report_count) for rows of `question_slots`.

    All kinds about one drug are counted in one join over the different things asked for, those about pairs in another,
    whatever the number of questions; the case tables and the answers are written once. A comparison ranks its
    drugs by cases with a severe outcome (`report_count`); a profile gives the rank of its reaction among all of the
    drug, and its share of the drug's reports. Each request has its own `k`.
    """
    slots = cut_lineage(slots, "slots")
    t = stored_cases(drug, reac, outcome, demographics, "age", "age_cod", "sex")
    hot = hot_cases(t.drug, t.reac)
    most = slots.agg(F.max("k")).first()[0] or 0
    first, second = F.get("drugs", F.lit(0)), F.get("drugs", F.lit(1))

    def of(*kinds: str) -> DataFrame:
        return slots.where(F.col("kind").isin(*kinds)).select("*", first.alias("drug"), second.alias("drug2"))

    def joined(asked: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"f.{c}")) for c in keys]
        pairs = asked.alias("a").join(found.alias("f"), same).where("f.rank <= a.k")
        return pairs.select("a.request_id", "a.kind", "f.*")

    effect, code = F.col("side_effect"), F.col("outcome_code")
    plain, severe, asked = of(TOP, SEGMENT), of(SEVERE), of(PROFILE)
    # A profile is about all reports of its drug.
    whole = asked.withColumns({"age_over": F.lit(None).cast("double"), "sex": F.lit(None).cast("string")})
    single = reduce(DataFrame.unionByName, [df.select("drug", F.col("age_over").cast("double"), "sex") for df in (plain, severe, whole)])
    # Written: three reports read the counts.
    counted = cut_lineage(asked_segment_counts(t.drug, t.reac, t.demographics, single, t.outcome, hot), "counts")
    top = best_of_segments(asked_of(counted, plain, "drug"), ["drug"], most, False)
    parts = [_rows(joined(plain, top, "drug", "age_over", "sex"), drug=F.col("drug"), side_effect=effect)]
    found = best_of_segments(asked_of(counted, severe, "drug"), ["drug"], most, True)
    parts.append(_rows(joined(severe, found, "drug", "age_over", "sex"), drug=F.col("drug"), side_effect=effect, outcome_code=code))

    # A plain pair is about all of its cases.
    pair = of(PAIR).withColumnsRenamed({"drug": "drug1"})
    all_cases = pair.withColumns({"age_over": F.lit(None).cast("double"), "sex": F.lit(None).cast("string")})
    severe_pair = of(SEVERE_PAIR).withColumnsRenamed({"drug": "drug1"})
    pairs = reduce(DataFrame.unionByName, [df.select("drug1", "drug2", F.col("age_over").cast("double"), "sex") for df in (all_cases, severe_pair)])
    counted_pairs = cut_lineage(pair_segment_counts(t.drug, t.reac, t.outcome, t.demographics, pairs, hot), "pairs")
    found = best_of_segments(asked_of(counted_pairs, all_cases, "drug1", "drug2"), ["drug1", "drug2"], most, False)
    both = {"drug": F.col("drug1"), "drug2": F.col("drug2"), "side_effect": effect}
    parts.append(_rows(joined(pair, found, "drug1", "drug2"), **both))
    found = best_of_segments(asked_of(counted_pairs, severe_pair, "drug1", "drug2"), ["drug1", "drug2"], most, True)
    parts.append(_rows(joined(severe_pair, found, "drug1", "drug2", "age_over", "sex"), **both, outcome_code=code))

    each = of(COMPARE).select("request_id", "kind", "k", F.explode("drugs").alias("drug"))
    summary = severity_summary(t.drug, t.outcome, each.select("drug")).select("drug", F.col("serious_cases").alias("report_count"))
    order = Window.partitionBy("request_id").orderBy(F.desc("report_count"), "drug")
    compared = each.join(summary, "drug").withColumn("rank", F.row_number().over(order)).where("rank <= k")
    parts.append(_rows(compared, drug=F.col("drug")))

    counted = asked_of(counted, whole, "drug").select("drug", "side_effect", "report_count")
    place = F.rank().over(Window.partitionBy("drug").orderBy(F.desc("report_count")))
    counted = counted.withColumn("share", F.col("report_count") / F.sum("report_count").over(Window.partitionBy("drug"))).withColumn("rank", place)
    profile = asked.select("request_id", "kind", "drug", F.col("effect").alias("side_effect")).join(counted, ["drug", "side_effect"])
    parts.append(_rows(profile, drug=F.col("drug"), side_effect=effect, share=F.col("share")))
    return cut_lineage(reduce(DataFrame.unionByName, parts), "answers")


def question_status(slots: DataFrame, answers: DataFrame) -> DataFrame:
    """(request_id, kind, status) of every request: answered, or why not."""
    answered = answers.select("request_id", F.lit(True).alias("answered")).distinct()
    status = (
        F.when(F.col("answered"), ANSWERED)
        .when(F.size("drugs") == 0, NO_DRUG)
        .when(F.col("kind").isNull(), TOO_MANY)
        .when(~F.col("kind").isin(*KINDS), UNKNOWN_KIND)
        .otherwise(NO_REPORTS)
    )
    return slots.join(answered, "request_id", "left").select("request_id", "kind", status.alias("status"))
