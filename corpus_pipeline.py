"""From raw documents to packed training sequences, in five stages.

`run` applies the stages one after another; each is written as Parquet in the shared folder and read again as the next
one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from casewatch.llm import decontaminate, packing, pii, quality, simhash
from casewatch.plans.lineage import cut_lineage, delete_written


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; the others go."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id."""
    return simhash.drop_near_duplicates(docs, words=4, max_bits=4)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; every document stays."""
    return decontaminate.remove_contamination(docs, _table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return pii.redact_personal_data(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("personal_data", redact),
    ("packing", pack),
]

# The model-based and iterative stages are tested against plain loops instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
        if written is not None:
            delete_written(written)
        written = docs
    return docs
