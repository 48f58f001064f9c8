"""Answering a stream of requests from finished answer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casewatch.operators.answers import ANSWERED, GIVEN, asked_questions, request_key, request_status
from casewatch.plans.sizing import is_small

REQUEST_SCHEMA = "request_id string, kind string, drug string, drug2 string, age_group string, sex string"


def read_request_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New request files of a folder as a stream."""
    return spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


# Parts a much-asked question is divided into when the answers are too many to broadcast.
PARTS = 16


def answer_requests_stream(requests: DataFrame, answers: DataFrame, all_requests: bool = False) -> DataFrame:
    """Join streamed requests with a written answer table; stateless, rows as `lookup_answers` gives.

    `all_requests` gives rows as `lookup_all` does: what cannot be answered has a row with the reason. `answers` should
    be read from files (see `answer_table`): every micro-batch uses them again. A counted small table is broadcast. A
    larger one is copied to `PARTS` parts of every question, so a question that fills a micro-batch is answered by
    several tasks.
    """
    asked = asked_questions(requests)
    given = answers.select(request_key().alias("question"), *GIVEN)
    if is_small(given):
        joined = asked.join(F.broadcast(given), "question", "left")
    else:
        asked = asked.withColumn("part", F.pmod(F.xxhash64("request_id"), F.lit(PARTS)))
        given = given.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
        joined = asked.join(given, ["question", "part"], "left")
    rows = joined.select("request_id", "kind", *GIVEN, request_status().alias("status"))
    return rows if all_requests else rows.filter(F.col("status") == ANSWERED).drop("status")


def start_answers(answered: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Append answers to Parquet files, working off what is there and then stopping."""
    return (
        answered.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def split_requests(requests: DataFrame, folder: str, files: int = 4) -> None:
    """Write requests as files of the stream's schema, the key deciding the file."""
    names = [field.split(" ")[0] for field in REQUEST_SCHEMA.split(", ")]
    requests.select(*[F.col(n).cast("string") for n in names]).repartition(files, "request_id").write.mode(
        "append"
    ).parquet(folder)
