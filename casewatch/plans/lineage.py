"""Where intermediate tables go, and cutting lineage reliably."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by the session; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(CHECKPOINT_SETTING)
    folder = folder or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="casewatch-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back, so that later uses read the same rows again.

    The columns stay prunable and lost executors cost nothing that was written. The files stay until
    `delete_written` or until the folder is cleaned.
    """
    session = df.sparkSession
    folder = new_dir(session, name)
    df.write.parquet(folder)
    return session.read.schema(df.schema).parquet(folder)


def delete_written(df: DataFrame) -> None:
    """Delete the folders below the shared one that `df` reads; only for results that are no longer needed."""
    session = df.sparkSession
    base = shared_dir(session).rstrip("/")
    hadoop = session.sparkContext._jvm.org.apache.hadoop.fs.Path
    home = hadoop(base)
    files = home.getFileSystem(session.sparkContext._jsc.hadoopConfiguration())
    top = files.makeQualified(home).toString() + "/"
    for folder in {hadoop(f).getParent().toString() for f in df.inputFiles()}:
        path = files.makeQualified(hadoop(folder))
        if path.toString().startswith(top):
            files.delete(path, True)
