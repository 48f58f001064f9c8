"""The case-report tables as views over an order/line-item star schema, for tests and benchmarks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.schemas import CASE

ROLE_OF_FLAG = {"R": "PS", "A": "SS", "N": "C"}
OUTCOME_OF_LINE = {1: "DE", 2: "LT", 3: "HO", 4: "DS"}


@dataclass(frozen=True)
class CaseTables:
    drug: DataFrame
    reac: DataFrame
    outcome: DataFrame
    demographics: DataFrame


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _code(column: str, codes: dict, other: str | None = None):
    value = F.lit(other)
    for key, code in codes.items():
        value = F.when(F.col(column) == key, code).otherwise(value)
    return value


def drug(lines: DataFrame, parts: DataFrame) -> DataFrame:
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias(CASE),
        F.col("l_linenumber").alias("drug_seq"),
        _code("l_returnflag", ROLE_OF_FLAG).alias("role_cod"),
        F.col("p_name").alias("drugname"),
        F.col("p_type").alias("prod_ai"),
    )


def reac(lines: DataFrame, suppliers: DataFrame) -> DataFrame:
    return lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).select(
        F.col("l_orderkey").alias(CASE), F.col("s_name").alias("pt")
    )


def outcome(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("l_orderkey").alias(CASE), _code("l_linenumber", OUTCOME_OF_LINE, "OT").alias("outc_cod"))


def demographics(orders: DataFrame, customers: DataFrame, nations: DataFrame) -> DataFrame:
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .join(nations, customers.c_nationkey == nations.n_nationkey)
        .select(
            F.col("o_orderkey").alias(CASE),
            F.col("o_custkey").alias("caseid"),
            F.col("o_orderpriority").alias("age_grp"),
            F.col("o_orderstatus").alias("sex"),
            F.col("o_orderdate").alias("event_dt"),
            (F.col("o_custkey") % 100).cast("string").alias("age"),
            F.lit("YR").alias("age_cod"),
            F.col("n_name").alias("occr_country"),
        )
    )


def case_tables(spark: SparkSession, folder: str) -> CaseTables:
    names = ("lineitem", "part", "supplier", "orders", "customer", "nation")
    lines, parts, suppliers, orders, customers, nations = (read(spark, folder, name) for name in names)
    return CaseTables(
        drug(lines, parts), reac(lines, suppliers), outcome(lines), demographics(orders, customers, nations)
    )
