"""Token ids as ORC files: one row a document, in ascending order of document ids.

Ids are an integer list column, which ORC keeps run-length encoded in stripes; each stripe has a
row index and a Bloom filter on ``doc_id``, so a look-up by id opens only the stripes that may hold
it, and stripes are read in parallel. Columns: part (number of the file), start_in_part (ids in the
file before the document), n_tokens, doc_id, ids.

Texts are dealt by ranges of ids first and encoded after, so ranges are found without encoding
twice and each text is encoded once. Where a document starts among all ids is its file's offset, a
sum over files, plus start_in_part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendlake.llm.encoding import ENCODERS, encoder
from lendlake.llm.shared import spread

SCHEMA = "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids array<int>"
ROWS_AT_ONCE = 500
# What a worker holds must not grow with the corpus up to what the encoder would remember by itself.
REMEMBERED_WORDS = 700_000


def id_lists(encoded: list[bytes]) -> pa.ListArray:
    """Little-endian 32-bit ids of several texts as one list array, without a Python integer."""
    ends = np.cumsum([0, *(len(x) // 4 for x in encoded)]).astype(np.int32)
    values = np.frombuffer(b"".join(encoded), dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int,
                      id_col: str = "doc_id", text_col: str = "text", files: int | None = None,
                      bloom_fpp: float = 0.01, index_stride: int = 10_000) -> None:
    """Encode every text, append ``end_id`` and write the files.

    A null or empty text is the end id alone. Rows that repeat an id all stay, in the order of
    their texts' checksums; a null id comes first. Other columns are left out. An empty table
    writes a folder without rows.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                found = [x + end for x in encoder(vocabulary, remembered=REMEMBERED_WORDS).encode(
                    batch.column(1).to_pylist())]
                counts = np.array([len(x) // 4 for x in found], dtype=np.int64)
                starts = start + np.cumsum(counts) - counts
                start += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(found), part, dtype=np.int32)),
                     pa.array(starts), pa.array(counts), id_lists(found)],
                    ["doc_id", "part", "start_in_part", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    (rows.repartitionByRange(files or spread(docs), "doc_id")
     .sortWithinPartitions(F.col("doc_id"), F.crc32("text"), F.length("text"))
     .mapInArrow(encoded, SCHEMA)
     .write.option("orc.create.index", "true").option("orc.row.index.stride", index_stride)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", bloom_fpp)
     .option("compression", "zstd").orc(folder))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids."""
    rows = spark.read.schema(SCHEMA).orc(folder)
    # One row for each file; only two narrow columns of it are read.
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("ids_in_part"))
    before = sums.select("part", F.coalesce(F.sum("ids_in_part").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("ids_before"))
    return rows.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("ids_before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (unsigned, over the ids as little-endian unsigned
    32-bit integers) of rows with ids."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ENCODERS.clear()  # the worker that encoded is used again, and needs its memory no more
        for batch in batches:
            ids = batch.column(3)
            ends = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(crc, type=pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        summed, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
