"""Token-id files: ORC stripes with integer run-length encoding (operator 5).

``write_token_ids`` range-partitions documents by id, encodes whole texts and
writes one ORC file per range, in ascending id order.  ORC stores the ids with
its integer run-length encoding, keeps row indexes per stripe and, here, Bloom
filters on ``doc_id``; a reader can take stripes in parallel and skip those
whose metadata exclude an id.  ``read_token_ids`` reads such files.

Defined results: a null text is an empty text; it holds only the end id.  Null
ids come first.  Rows that repeat an id are all kept, next to each other.  An
empty table gives files without rows.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loftline.llm.kernels import text_blocks, utf8_view
from loftline.llm.store import attach, lean, new_path
from loftline.llm.tokens import DEFAULT_TOKENIZER, encode_block

END_ID = 2
#: ``shard`` numbers the ranges in ascending order; ``shard_start`` counts the ids before a document in its range.
FILE_SCHEMA = "doc_id long, shard int, shard_start long, ids array<int>"


def write_token_ids(docs: DataFrame, path: str, end_id: int = END_ID, tokenizer: str = DEFAULT_TOKENIZER, stripe_bytes: int = 16 << 20, row_stride: int = 2000) -> None:
    """Encode ``docs`` (doc_id, text) into ORC files under ``path``."""
    attach(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        for block in text_blocks(batches, "text"):
            ids, rows = encode_block(*utf8_view(block["text"]), end_id, tokenizer)
            lists = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids.astype(np.int32)))
            n = block.num_rows
            out = pa.RecordBatch.from_arrays(
                [block["doc_id"].combine_chunks(), pa.array(np.full(n, shard, np.int32)), pa.array(before + rows[:-1]), lists],
                ["doc_id", "shard", "shard_start", "ids"],
            )
            before += int(rows[-1])
            for at in range(0, n, 1000):
                yield out.slice(at, 1000)

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
        .mapInArrow(lean(encode), FILE_SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.row.index.stride", str(row_stride))
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of files that ``write_token_ids`` wrote."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def token_digests(files: DataFrame) -> DataFrame:
    """Per document its place in the whole id stream, its length and checksum.

    Only one row per range meets in a single place: the ranges' totals.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            edges = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
            data = memoryview(np.frombuffer(lists.values.buffers()[1], np.uint8)[4 * lists.values.offset :]) if len(lists.values) else memoryview(b"")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("shard"), batch.column("shard_start"), pa.array(np.diff(edges).astype(np.int64)), pa.array(sums, pa.int64())],
                ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"],
            )

    per_doc = files.mapInArrow(lean(digest), "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    totals = files.groupBy("shard").agg(F.max(F.col("shard_start") + F.size("ids")).alias("n"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    return per_doc.join(bases, "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, end_id: int = END_ID, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Write ``docs`` to fresh files in the shared folder, and read them back."""
    path = new_path(docs.sparkSession, "token-ids")
    write_token_ids(docs, path, end_id, tokenizer)
    return read_token_ids(docs.sparkSession, path)
