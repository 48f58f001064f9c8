"""Taking new case files into a store as they arrive.

A run reads the files of a family that no earlier run has read and stops. Rows are stored in one folder per file, which
a batch replaces as a whole: a batch that is run again after a failure changes nothing. A ledger has a row per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from casewatch.schemas import CASE, SCHEMAS
from casewatch.sources.case_files import SEPARATOR, family_path

FILE = "file_name"
LEDGER = StructType([StructField("file_size", LongType()), StructField("row_count", LongType()), StructField(FILE, StringType())])


def stored_schema(table: str) -> StructType:
    return StructType([*SCHEMAS[table].fields, StructField(FILE, StringType())])


def _folder(store: str, table: str) -> str:
    return f"{store.rstrip('/')}/{table}"


def _ledger(store: str, table: str) -> str:
    return f"{store.rstrip('/')}/_ledger/{table}"


def _replace(df: DataFrame, folder: str) -> None:
    """Write the folders of the files that `df` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FILE).parquet(folder)


def start_intake(
    spark: SparkSession, inbox: str, store: str, table: str, files_per_batch: int = 100, separator: str = SEPARATOR
) -> StreamingQuery:
    """Take in the new files of a family below `inbox` and stop; `awaitTermination` on what comes back.

    A file whose header differs from the schema fails the run; files of earlier batches stay stored, and the run can be
    started again when the file has been taken away. Files are known by their names: a file without rows leaves no row
    in the ledger, one that is changed later is not read again.
    """
    reader = spark.readStream.schema(SCHEMAS[table]).option("header", True).option("sep", separator)
    reader = reader.option("enforceSchema", False).option("maxFilesPerTrigger", files_per_batch)
    rows = reader.csv(family_path(inbox, table)).select("*", F.col(f"_metadata.{FILE}").alias(FILE), F.col("_metadata.file_size").alias("file_size"))

    def take(batch: DataFrame, number: int) -> None:
        _replace(batch.drop("file_size"), _folder(store, table))
        _replace(batch.groupBy(FILE, "file_size").agg(F.count(F.lit(1)).alias("row_count")).select("file_size", "row_count", FILE), _ledger(store, table))

    return (
        rows.writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{store.rstrip('/')}/_checkpoints/{table}")
        .trigger(availableNow=True)
        .start()
    )


def read_store(spark: SparkSession, store: str, table: str) -> DataFrame:
    """All rows that have been taken in, with the name of their file."""
    return spark.read.schema(stored_schema(table)).parquet(_folder(store, table))


def read_ledger(spark: SparkSession, store: str, table: str) -> DataFrame:
    """(file_name, file_size, row_count) of every file that has been taken in."""
    return spark.read.schema(LEDGER).parquet(_ledger(store, table)).select(FILE, "file_size", "row_count")


def latest_versions(demographics: DataFrame) -> DataFrame:
    """The reports with the highest version of their case: later versions replace earlier ones.

    Versions compare as numbers, text that is none comes before all; of equal ones the largest report id stays. Reports
    without a case id stand for themselves. Only ids and versions are aggregated, and the rows are then looked up.
    """
    version = F.struct(F.coalesce(F.col("caseversion").try_cast("double"), F.lit(float("-inf"))), F.col(CASE))
    last = demographics.where("caseid IS NOT NULL").groupBy("caseid").agg(F.max(version).alias("last"))
    kept = last.select(F.col("last")[CASE].alias("kept"), F.col("caseid").alias("of_case"))
    same = F.col(CASE).eqNullSafe(F.col("kept")) & (F.col("caseid") == F.col("of_case"))
    return demographics.join(kept, same, "left_semi").unionByName(demographics.where("caseid IS NULL"))


def of_reports(rows: DataFrame, demographics: DataFrame) -> DataFrame:
    """The rows of another table that belong to these reports."""
    return rows.join(demographics.select(CASE).distinct(), CASE, "left_semi")
