"""Catalog tables: declare, write, read, count, look at."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casewatch.functions.columns import AGE_UNITS, age_status, age_years, date_of
from casewatch.schemas import CASE, SCHEMAS, TABLE_COMMENTS


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_table_sql(name: str, schema: StructType, comment: str) -> str:
    columns = ",\n  ".join(
        f"{field.name} {field.dataType.simpleString().upper()} COMMENT {_quoted(field.metadata.get('comment', ''))}"
        for field in schema.fields
    )
    return f"CREATE TABLE IF NOT EXISTS {name} (\n  {columns})\nUSING parquet\nCOMMENT {_quoted(comment)}"


def create_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Declare the four tables with their comments; returns their names."""
    prefix = f"{database}." if database else ""
    names = []
    for table, schema in SCHEMAS.items():
        spark.sql(create_table_sql(prefix + table, schema, TABLE_COMMENTS[table]))
        names.append(prefix + table)
    return names


def with_comments(df: DataFrame, schema: StructType) -> DataFrame:
    """Carry the column comments of `schema` into a write."""
    comments = {field.name: field.metadata for field in schema.fields}
    return df.select(*[F.col(c).alias(c, metadata=comments[c]) if comments.get(c) else F.col(c) for c in df.columns])


def write_table(
    df: DataFrame,
    name: str,
    sort_by: list[str] | None = None,
    bucket_by: str | None = None,
    buckets: int = 0,
    path: str | None = None,
) -> int:
    """Replace a table and return its row count, taken during the write instead of by a second scan.

    `sort_by` orders rows within each file, which narrows the Parquet statistics of a lookup column.
    `bucket_by` stores the table hashed by a column, so later joins on it need no shuffle; use it only
    where no single key holds a large part of the table, as a bucket is read by one task.
    """
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if sort_by and not bucket_by:
        rows = rows.sortWithinPartitions(*sort_by)
    writer = rows.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(*(sort_by or [bucket_by]))
    writer.saveAsTable(name)
    return seen.get["rows"]


def write_clustered(
    df: DataFrame, name: str, key: str, spread_by: str = CASE, files: int | None = None, distinct_keys: int = 100_000, path: str | None = None
) -> int:
    """Replace a table laid out for lookups by `key`, and return its row count.

    Rows are ranged over files by the key and then by a hash of `spread_by`, so a frequent key fills several files and
    no task, and are sorted by the key in each. File and row group statistics then exclude what lies outside a range,
    and Parquet Bloom filters (sized for `distinct_keys` in a file) keys that are not there.
    """
    seen = Observation()
    by = [F.col(key), F.xxhash64(spread_by)]
    ranged = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    # Counted after the ranges: finding them reads the rows once more.
    rows = ranged.sortWithinPartitions(key).observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = rows.write.mode("overwrite").format("parquet")
    writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer = writer.option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct_keys))
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return seen.get["rows"]


def insert_table(df: DataFrame, name: str) -> None:
    """Replace the rows of a declared table and keep its declaration; columns match by name."""
    spark = df.sparkSession
    target = spark.table(name).schema
    columns = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.fields
    ]
    df.select(*columns).write.insertInto(name, overwrite=True)


def create_table_as(spark: SparkSession, name: str, query: str | DataFrame) -> None:
    """Create or replace a table from a query."""
    df = spark.sql(query) if isinstance(query, str) else query
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def replace_table(spark: SparkSession, name: str, query: str | DataFrame, folder: str) -> str:
    """Create or replace a table in one step: readers see the old rows or the new ones, never none.

    The rows go to a new folder below `folder`; then the view `name` is turned to it. A query that fails leaves the view
    as it was, and queries that already read the old folder finish. Returns the new folder; see `drop_versions`.
    """
    df = spark.sql(query) if isinstance(query, str) else query
    version = f"{folder.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.write.parquet(version)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{version}`")
    return version


def drop_versions(spark: SparkSession, folder: str, keep: str) -> list[str]:
    """Delete the versions below `folder` but `keep`, when nothing reads them any more; returns their names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    home = path(folder)
    files = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [f.getPath() for f in files.listStatus(home) if f.getPath().getName().startswith("version-")]
    old = [p for p in old if p.getName() != path(keep).getName()]
    for one in old:
        files.delete(one, True)
    return sorted(p.getName() for p in old)


def typed_demographics(
    demographics: DataFrame, date_format: str = "yyyyMMdd", units: Mapping[str, float] = AGE_UNITS
) -> DataFrame:
    """The raw table with age_years, age_status and event_date; text that does not fit gives NULL, never an error."""
    return demographics.withColumns(
        {
            "age_years": age_years(units),
            "age_status": age_status(units),
            "event_date": date_of("event_dt", date_format),
        }
    )


def read_table(spark: SparkSession, name: str, alias: str | None = None) -> DataFrame:
    df = spark.table(name)
    return df.alias(alias) if alias else df


def row_count(df: DataFrame) -> int:
    return df.count()


def preview(df: DataFrame, n: int = 20, order_by: list[str] | None = None) -> DataFrame:
    """The first `n` rows, in a given order or as they come."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)
