"""The reports as SQL table functions: SELECT * FROM get_top_side_effects('aspirin').

They also take a column of another table through LATERAL, which Spark turns into joins.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from casewatch.schemas import PRIMARY_SUSPECT, SEVERE_OUTCOMES

DEFAULT_TABLES = {"drug": "drug", "reac": "reac", "outcome": "outcome", "demographics": "demographics"}
_CODES = ", ".join(f"'{code}'" for code in SEVERE_OUTCOMES)

# Name -> (parameters, result columns, body). A row per case and drug is counted before it meets the reactions.
_SUSPECT = (
    "(SELECT primaryid, COUNT(*) AS listed FROM {drug} "
    f"WHERE role_cod = '{PRIMARY_SUSPECT}' AND LOWER(drugname) = LOWER({{function}}.drug) GROUP BY primaryid)"
)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "get_top_side_effects": (
        "drug STRING",
        "side_effect STRING, report_count BIGINT",
        "SELECT pt, SUM(listed) AS n FROM " + _SUSPECT + " JOIN {reac} USING (primaryid) "
        "GROUP BY pt ORDER BY n DESC, pt ASC NULLS LAST LIMIT {k}",
    ),
    "get_drug_pair_interactions": (
        "drug1 STRING, drug2 STRING",
        "shared_side_effect STRING, shared_report_count BIGINT",
        "SELECT pt, COUNT(DISTINCT primaryid) AS n FROM "
        "(SELECT DISTINCT primaryid FROM {drug} WHERE LOWER(drugname) = LOWER({function}.drug1)) "
        "JOIN (SELECT DISTINCT primaryid FROM {drug} WHERE LOWER(drugname) = LOWER({function}.drug2)) USING (primaryid) "
        "JOIN {reac} USING (primaryid) GROUP BY pt ORDER BY n DESC, pt ASC NULLS LAST LIMIT {k}",
    ),
    "get_side_effect_by_demographics": (
        "drug STRING, age_group STRING, sex_code STRING",
        "side_effect STRING, report_count BIGINT",
        "SELECT pt, SUM(listed * persons) AS n FROM " + _SUSPECT + " JOIN "
        "(SELECT primaryid, COUNT(*) AS persons FROM {demographics} WHERE age_grp = {function}.age_group "
        "AND sex = {function}.sex_code GROUP BY primaryid) USING (primaryid) "
        "JOIN {reac} USING (primaryid) GROUP BY pt ORDER BY n DESC, pt ASC NULLS LAST LIMIT {k}",
    ),
    "get_severe_side_effects": (
        "drug STRING",
        "side_effect STRING, outcome_code STRING, report_count BIGINT",
        "SELECT pt, outc_cod, SUM(listed * outcomes) AS n FROM " + _SUSPECT + " JOIN "
        f"(SELECT primaryid, outc_cod, COUNT(*) AS outcomes FROM {{outcome}} WHERE outc_cod IN ({_CODES}) "
        "GROUP BY primaryid, outc_cod) USING (primaryid) JOIN {reac} USING (primaryid) "
        "GROUP BY pt, outc_cod ORDER BY n DESC, pt ASC NULLS LAST, outc_cod LIMIT {k}",
    ),
}


def function_sql(name: str, tables: Mapping[str, str] = DEFAULT_TABLES, k: int = 10, temporary: bool = True) -> str:
    parameters, columns, body = FUNCTIONS[name]
    kind = "TEMPORARY FUNCTION" if temporary else "FUNCTION"
    text = body.format(function=name, k=int(k), **{**DEFAULT_TABLES, **tables})
    return f"CREATE OR REPLACE {kind} {name}({parameters}) RETURNS TABLE({columns}) RETURN {text}"


def register_table_functions(
    spark: SparkSession, tables: Mapping[str, str] = DEFAULT_TABLES, k: int = 10, temporary: bool = True
) -> list[str]:
    """Create all table functions over the named tables; returns their names.

    Persistent functions go into the current database and need catalog tables; temporary ones also
    accept temporary views.
    """
    for name in FUNCTIONS:
        spark.sql(function_sql(name, tables, k, temporary))
    return list(FUNCTIONS)


def list_table_functions(spark: SparkSession) -> list[str]:
    """The report functions the session knows, by bare name."""
    known = {row["function"].split(".")[-1] for row in spark.sql("SHOW USER FUNCTIONS").collect()}
    return [name for name in FUNCTIONS if name in known]
