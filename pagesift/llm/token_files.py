"""Token-id files: Parquet list columns in ascending document order.

Layout: documents are range-partitioned by ``doc_id``; every task writes files
whose rows ascend by ``doc_id``. Each row holds the document's ids as a list
column (dictionary pages, bit-packed) beside small metadata columns, with small
row groups and page indexes. A reader that needs few documents or only counts
touches few pages: the ids column is skipped or read by row range.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesift.llm.arrays import raw_bytes
from pagesift.llm.common import fresh_path, prepare, table
from pagesift.llm.token_ids import tokenizer_for, with_end_id

# Parquet layout: bytes of a row group, of a page, and rows of a page at most
ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 1000

FILE_SCHEMA = "doc_id long, part long, seq long, n_tokens long, before long, ids array<int>"


def token_rows(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Documents in ascending order of ``doc_id`` with their ids.

    ``part`` numbers the range partitions, ``seq`` the rows in one, ``before``
    counts the ids in earlier rows of the same part."""

    def run(batches):
        from pyspark import TaskContext
        tok, part = tokenizer_for(tokenizer_path, "space_prefix"), TaskContext.get().partitionId()
        seq = before = 0
        for batch in batches:
            ids, off = with_end_id(*tok.encode(batch.column(1)), end_id)
            n = np.diff(off)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "part": pa.array(np.full(len(n), part), pa.int64()),
                "seq": pa.array(seq + np.arange(len(n)), pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                "before": pa.array(before + off[:-1], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))})
            seq, before = seq + len(n), before + int(off[-1])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # rows with one doc_id could be many: a hash of the text splits such a key
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    tie = F.xxhash64("text")
    return (docs.repartitionByRange(int(parts), "doc_id", tie)
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
            .mapInArrow(run, FILE_SCHEMA))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Write the token files of ``docs`` below ``path``."""
    (token_rows(docs, tokenizer_path, end_id).write
     .option("compression", "zstd").option("parquet.enable.dictionary", "true")
     .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
     .option("parquet.page.row.count.limit", PAGE_ROWS)
     .option("parquet.dictionary.page.size", 1 << 20)
     .parquet(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """All rows of token files plus ``start``, the ids of all documents before.

    The offsets need only the two count columns: one sum per part, then a
    running sum over parts (a table as long as the write had tasks)."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    return (rows.join(F.broadcast(base), "part")  # one row per part
            .withColumn("start", F.col("base") + F.col("before")).drop("base"))


def ids_digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, all from the ids as read."""

    def run(batches):
        for batch in batches:
            ids = batch.column(2)
            off = ids.offsets.to_numpy(zero_copy_only=False)
            view = raw_bytes(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))
            crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "start": batch.column(1),
                "n_tokens": pa.array(np.diff(off), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return rows.select("doc_id", "start", "ids").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark, sf_dir):
    """Encode, write, read back: one digest row per document.

    Null text: only the end id. Rows with one doc_id follow each other in order
    of their text's hash; null doc_ids come first; an empty table has no rows."""
    import public_tokenizers
    prepare(spark)
    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path,
                      public_tokenizers.path("byte_bpe_50k.json"))
    return ids_digest(read_token_files(spark, path))
