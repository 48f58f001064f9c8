"""Token ids of documents in coded files, and back.

Documents are put in order of their keys (range partitions, sorted inside), tokenised, and written in segments: rows of
Parquet files, so that Spark commits them as a whole on whatever storage the folder is. A segment holds its partition
and number, how many ids its partition has before it, the number of ids of each document with the keys, and the ids as a
stream of independently coded, checksummed blocks (`range_coder`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from casewatch.llm.batches import bounded, by_value, slices
from casewatch.llm.range_coder import BLOCK, LANES, decode, encode
from casewatch.llm.tokens import END, encoder
from casewatch.plans.lineage import new_dir

by_value(__name__)

# Ids of a segment: as many blocks as are coded at a time. A document is never split over segments.
SEGMENT = BLOCK * LANES
# Texts tokenised at a time, and their bytes, at most (a longer text goes alone).
TEXTS, TEXT_BYTES = 256, 1 << 20

_LONG = T.LongType()


def _segment_type(key: T.StructField) -> T.StructType:
    return T.StructType(
        [
            T.StructField("part", _LONG),
            T.StructField("segment", _LONG),
            T.StructField("before", _LONG),
            T.StructField("n_ids", _LONG),
            T.StructField("keys", T.ArrayType(key.dataType)),
            T.StructField("lengths", T.ArrayType(_LONG)),
            T.StructField("stream", T.BinaryType()),
        ]
    )


def _writing(tokenizer: str, key: str, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = encoder(tokenizer), TaskContext.get().partitionId()
        keys: list[pa.Array] = []
        held: list[np.ndarray] = []
        lengths: list[int] = []
        number = before = size = 0

        def out() -> pa.RecordBatch:
            names = pa.concat_arrays(keys)
            return pa.RecordBatch.from_arrays(
                [
                    *(pa.array([n], pa.int64()) for n in (part, number, before, size)),
                    pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([encode(np.concatenate(held))], pa.binary()),
                ],
                names=["part", "segment", "before", "n_ids", "keys", "lengths", "stream"],
            )

        for batch in bounded(batches, "text", TEXTS, TEXT_BYTES):
            for found in ids_of.encode(batch.column("text").to_pylist()):
                held.append(np.append(found.astype(np.uint32), np.uint32(END)))
                lengths.append(len(held[-1]))
                size += lengths[-1]
            keys.append(batch.column(key))
            if size >= segment:
                yield out()
                keys, held, lengths = [], [], []
                number, before, size = number + 1, before + size, 0
        if held:
            yield out()

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", segment: int | None = None) -> None:
    """Write the ids of all documents (null text: none) and an end id each, by ascending key, null keys first; rows of
    the same key in the order of their text hashes."""
    rows = docs.select(F.col(key), F.col(text).alias("text"), F.xxhash64(text).alias("_order"))
    order = [F.asc_nulls_first(key), F.asc("_order")]
    kind = _segment_type(docs.schema[key])
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(key, "text")
    dealt.mapInArrow(_writing(tokenizer, key, SEGMENT if segment is None else segment), kind).write.option("compression", "uncompressed").parquet(folder)


def read_token_files(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """One row for each document of the files: (`key`, start: ids of all documents before it, n_tokens, ids).

    A damaged block is an error.
    """
    files = spark.read.parquet(folder)
    # As many rows as range partitions.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    first = parts.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("first"))
    kind = files.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField("part", _LONG), T.StructField(key, kind), T.StructField("start", _LONG), T.StructField("n_tokens", _LONG), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in slices(batches, 1):
            lengths = row.column("lengths").values.to_numpy()
            offset = row.column("lengths").offsets
            lengths = lengths[offset[0].as_py() : offset[1].as_py()]
            keys = row.column("keys").flatten()
            ids = decode(row.column("stream")[0].as_py())
            ends = np.cumsum(lengths)
            starts = ends - lengths
            before, part = row.column("before")[0].as_py(), row.column("part")[0].as_py()
            for at in range(0, len(lengths), 1_024):
                cut = slice(at, at + 1_024)
                own = [ids[a:b].tobytes() for a, b in zip(starts[cut].tolist(), ends[cut].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(own), pa.int64()), keys[cut], pa.array(before + starts[cut]), pa.array(lengths[cut]), pa.array(own, pa.binary())],
                    names=["part", key, "start", "n_tokens", "ids"],
                )

    rows = files.mapInArrow(run, schema).join(F.broadcast(first), "part")
    return rows.select(key, (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids")


def token_file_digest(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", segment: int | None = None) -> DataFrame:
    """Write files to the shared folder and read them back: (`key`, start, n_tokens, ids_crc32) of every document."""
    spark = docs.sparkSession
    folder = new_dir(spark, "token-files")
    write_token_files(docs, folder, tokenizer, key, text, segment)
    # Spark's crc32 is that of the bytes: the ids as little-endian numbers of 32 bits.
    return read_token_files(spark, folder, key).select(key, "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
