"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings that can be changed on a running session.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session given there."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("casewatch")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.showConsoleProgress", "false")
        # Small inputs are one row group, so one map task; reading by map output would stay in one task.
        .config("spark.sql.adaptive.localShuffleReader.enabled", "false")
    )
    for name, value in {**SQL_SETTINGS, **conf}.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the runtime settings on an existing (cluster) session."""
    for name, value in SQL_SETTINGS.items():
        spark.conf.set(name, value)
    return spark
