"""Token ids as Parquet list columns (operator 3).

``write_tokens`` range-partitions the documents by doc_id (ties: by their
place in the input, so rows of one id, or none, spread over many files), encodes each partition in order and writes one file per partition, so
file order is document order. Columns: doc_id, n_tokens, file_start (ids of
the file before the document) and ids (list<int>, the end id included). Token
ids are dictionary-encoded, the ascending metadata columns delta-encoded
(Parquet 2 pages); row groups and pages have a set size, and Parquet's page
index lets a reader fetch some documents only. Metadata reads never touch ids.

``read_tokens`` gives every document with its place in the whole corpus: file
totals (one row a file) are summed up in file order.

Null text: empty, the end id only. Null doc_id: sorts first. Repeated rows
are written once each. An empty table gives an empty table.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom.llm.common import at_most, pick, ship, slices
from ledgerloom.llm.tokens import pieces

ship(__name__)

ROW_GROUP_BYTES = 64 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
BROADCAST_FILES = 100_000

SCHEMA = "doc_id bigint, n_tokens bigint, file_start bigint, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int,
                 row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Write ``docs`` (doc_id, text) as token files in ascending doc_id order."""
    docs = pick(docs, "doc_id", "text").withColumn("place", F.monotonically_increasing_id())

    def encode(batches):
        p, before = pieces(tokenizer), 0
        kind, end = np.dtype("<u2" if p.width == 2 else "<u4"), np.array([end_id])
        for b in slices(batches, 256):
            parts, sizes = [], []
            for raw in p.encode(b.column(1).to_pylist()):
                parts += [np.frombuffer(raw, kind), end]
                sizes.append(len(raw) // p.width + 1)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            values = np.concatenate(parts).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(sizes, np.int64)), pa.array(before + offsets[:-1].astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))],
                ["doc_id", "n_tokens", "file_start", "ids"])
            before += int(offsets[-1])

    (docs.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
     .mapInArrow(encode, SCHEMA).write
     .option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
     .option("parquet.page.row.count.limit", page_rows)
     .option("parquet.enable.dictionary", "true")
     .option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#n_tokens", "false")
     .option("parquet.enable.dictionary#file_start", "false")
     .parquet(path))


def _files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their file's number, and (file, before): the ids of all files before each one.

    ``before`` has a row a file and is broadcast up to BROADCAST_FILES of
    them, so the ids are not shuffled for it.
    """
    rows = spark.read.schema(SCHEMA).parquet(path).select(
        "*", F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("bigint").alias("file"))
    totals = rows.groupBy("file").agg(F.max(F.col("file_start") + F.col("n_tokens")).alias("total"))
    before = totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("before"))
    few = at_most(before, BROADCAST_FILES)
    if few is not None:
        before = F.broadcast(spark.createDataFrame(few, before.schema))
    return rows, before


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document; unused columns are not read."""
    rows, before = _files(spark, path)
    return rows.join(before, "file").select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def read_crc(spark: SparkSession, path: str) -> DataFrame:
    """The same with, for ids, the unsigned crc32 of them as little-endian unsigned 32-bit integers."""
    def crc(batches):
        for b in batches:
            ids = b.column(4)
            at = ids.offsets.to_numpy()
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            sums = [zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sums, pa.int64())], ["doc_id", "file_start", "n_tokens", "file", "ids_crc32"])

    rows, before = _files(spark, path)
    summed = rows.select("doc_id", "file_start", "n_tokens", "file", "ids").mapInArrow(
        crc, "doc_id bigint, file_start bigint, n_tokens bigint, file bigint, ids_crc32 bigint")
    return summed.join(before, "file").select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


assert sys.byteorder == "little"  # ids go through native buffers
