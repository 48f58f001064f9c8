"""Top k overall, top k per key, and dense ids without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewatch.plans.lineage import cut_lineage
from casewatch.plans.sizing import is_small


def best_first(count: str, *ties: str) -> list[Column]:
    """Largest count first, then the tie columns ascending with NULL last."""
    return [F.desc(count), *[F.asc_nulls_last(tie) for tie in ties]]


def top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_key(df: DataFrame, keys: list[str], k: int | None, order: list[Column]) -> DataFrame:
    """Rank within `keys` from 1; with `k`, each task first cuts to its own best k before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = df.withColumn("rank", rank)
    if k is not None:
        ranked = ranked.filter(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def dense_ids(df: DataFrame, key: str, id_column: str = "id") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order of the unique column `key`.

    Rows are range partitioned and written once with their partition number, so both uses below see
    the same ranges. The offsets have one row per partition.
    """
    ranged = cut_lineage(df.repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    within = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return (
        ranged.withColumn("_place", within)
        .join(F.broadcast(offsets), "_range")
        .withColumn(id_column, F.col("_offset") + F.col("_place") - 1)
        .select(id_column, *df.columns)
    )


def name_codes(df: DataFrame, column: str) -> DataFrame | None:
    """(_name, _code): whole numbers in the order of the names of a column, to be broadcast; None where these are too
    many for that."""
    names = cut_lineage(df.select(F.col(column).alias("_name")).filter("_name is not null").distinct(), "names")
    if not is_small(names):
        return None
    numbered = dense_ids(names, "_name", "_code")
    return cut_lineage(numbered.select("_name", F.col("_code").cast("int").alias("_code")), "codes")


def coded(df: DataFrame, column: str, codes: DataFrame | None) -> DataFrame:
    """The codes of names in place of them, where there are any; NULL stays."""
    if codes is None:
        return df
    # Counted in `name_codes`.
    met = df.join(F.broadcast(codes), F.col(column) == F.col("_name"), "left")
    return met.withColumn(column, F.col("_code")).select(df.columns)


def decoded(df: DataFrame, column: str, codes: DataFrame | None) -> DataFrame:
    """The names again in place of their codes."""
    if codes is None:
        return df
    met = df.join(F.broadcast(codes), F.col(column) == F.col("_code"), "left")
    return met.withColumn(column, F.col("_name")).select(df.columns)


def rank_by(df: DataFrame, column: str, rank_column: str) -> DataFrame:
    """SQL rank() of every row by `column` descending, over the whole of `df`.

    Only the distinct values of `column` are ordered in one task. For counts these are few: m distinct
    counts need at least m(m-1)/2 counted rows.
    """
    stored = cut_lineage(df)
    above = Window.orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, -1)
    places = (
        stored.groupBy(column)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(column, (F.coalesce(F.sum("_rows").over(above), F.lit(0)) + 1).alias(rank_column))
    )
    return stored.join(places, column).select(*df.columns, rank_column)
