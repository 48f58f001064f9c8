"""Reading the `$`-separated text files of a case-report release."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from casewatch.schemas import FILE_PATTERNS, SCHEMAS

SEPARATOR = "$"
CORRUPT = "_corrupt"


def family_path(folder: str, table: str) -> str:
    """The file pattern of a table's family below `folder`."""
    return f"{folder.rstrip('/')}/{FILE_PATTERNS[table]}"


def read_case_files(
    spark: SparkSession,
    path: str,
    schema: StructType,
    strict: bool = False,
    keep_corrupt: bool = False,
    quote: str | None = '"',
    multi_line: bool = False,
    separator: str = SEPARATOR,
) -> DataFrame:
    """All files matching `path` as nullable strings.

    Columns bind by position; `strict` makes a header that differs from the schema fail the read.
    `keep_corrupt` adds a `_corrupt` column with the whole text of rows that are too short or too long.
    `quote` None reads quote characters as text. The scan splits large files unless `multi_line`.
    """
    if keep_corrupt:
        schema = StructType([*schema.fields]).add(CORRUPT, StringType())
    reader = (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", separator)
        .option("quote", "" if quote is None else quote)
        .option("multiLine", multi_line)
        .option("enforceSchema", not strict)
        .option("mode", "PERMISSIVE")
    )
    if keep_corrupt:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.csv(path)


def read_family(spark: SparkSession, folder: str, table: str, **options) -> DataFrame:
    """One of the four tables from its file family; a header that differs from the schema fails unless `strict=False`."""
    return read_case_files(spark, family_path(folder, table), SCHEMAS[table], **{"strict": True, **options})


def check_headers(spark: SparkSession, path: str, schema: StructType, separator: str = SEPARATOR) -> DataFrame:
    """(file_path, header, matches) for every file: is its first line the header of the schema?

    The first line is found by its position in the file; only one line per file leaves the scan.
    """
    expected = separator.join(schema.fieldNames())
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("header"),
        F.monotonically_increasing_id().alias("line"),
    )
    first = lines.filter("block = 0").groupBy("file_path").agg(F.min_by("header", "line").alias("header"))
    clean = F.regexp_replace("header", "\r$", "")
    return first.select("file_path", clean.alias("header"), (clean == expected).alias("matches"))


def file_manifest(df: DataFrame, path: str | None = None) -> DataFrame:
    """(file_path, file_name, file_size, row_count) of the files a file-based DataFrame reads.

    With the `path` the table was read from, files without rows are listed too, with a count of 0.
    """
    columns = ["file_path", "file_name", "file_size"]
    meta = df.select(*[F.col(f"_metadata.{column}").alias(column) for column in columns])
    counted = meta.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count"))
    if path is None:
        return counted
    # The content is not selected, so no file is opened for the listing.
    listed = df.sparkSession.read.format("binaryFile").load(path)
    listed = listed.select(*[F.col(f"_metadata.{column}").alias(column) for column in columns])
    return listed.join(counted.select("file_path", "row_count"), "file_path", "left").na.fill(0, ["row_count"])


def write_case_files(df: DataFrame, path: str, separator: str = SEPARATOR) -> None:
    """Write a table as `$`-separated text with a header, one file per task."""
    df.write.mode("overwrite").option("header", True).option("sep", separator).option("emptyValue", "").csv(path)
