"""Packing of documents into training sequences (operator 4).

Texts are encoded where they are read.  Windows' worth of ids are cut off a
document from its start; what is left, under a window, is packed by best-fit
decreasing: longest first, each into the open window with the least room that
still holds it.  The tightest window is found with a segment tree indexed by
remaining capacity.  Only lengths are shuffled, never ids: remainders are dealt
into shards of bounded size, each packed by one task.

Defined results: a null text is an empty text and holds only the end id.  Rows
that repeat an id are packed each on its own.  Equal lengths are placed in the
order of ``doc_id``, nulls first.  An empty table gives no pieces.  Extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loftline.llm.kernels import text_blocks, utf8_view
from loftline.llm.store import attach, lean, written
from loftline.llm.tokens import DEFAULT_TOKENIZER, encode_block

END_ID = 1
WINDOW = 2048
#: Remainders that one task packs; padding falls with it, memory rises.
SHARD_PIECES = 40_000
PIECES = "doc_id long, row_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str = DEFAULT_TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` ids of each document; all but a document's last are full.

    ``with_ids`` adds the ids themselves as ``ids array<int>``.
    """
    attach(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            ids, rows = encode_block(*utf8_view(block["text"]), end_id, tokenizer)
            total = np.diff(rows)
            count = -(-total // window)
            row = np.repeat(np.arange(len(total)), count)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * window
            length = np.minimum(window, total[row] - start)
            at = rows[:-1][row] + start
            data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            take = pa.array(row)
            columns = [block["doc_id"].combine_chunks().take(take), block["row_id"].combine_chunks().take(take), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(total[row])]
            names = ["doc_id", "row_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, at[-1:] + length[-1:]), pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(cut), PIECES + (", ids array<int>" if with_ids else ""))


class OpenWindows:
    """Open windows by remaining room, in a segment tree over the room."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _count(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.tree[node] += by
            node >>= 1

    def add(self, room: int, window: int) -> None:
        self.at[room].append(window)
        self._count(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window with the least room of at least ``need``."""
        tree, node = self.tree, self.leaves + need
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not tree[node]:
                    node += 1
        room = node - self.leaves
        self._count(room, -1)
        return room, self.at[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each length, which must come in descending order."""
    into, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, opened = OpenWindows(window), 0
    for k, n in enumerate(lengths.tolist()):
        room, where = tree.tightest(n) or (window, opened)
        opened += where == opened
        into[k], offset[k] = where, window - room
        if room > n:
            tree.add(room - n, where)
    return into, offset, opened


def pack(pieces: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the pieces of ``cut_documents``.

    ``pieces`` is read twice, so it should be a written table.
    """
    spark = pieces.sparkSession
    attach(spark)
    shards = max(1, -(-pieces.where(F.col("length") < window).count() // shard_pieces))
    full = F.col("length") >= window
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row_id", "start"), F.lit(shards)).cast("int"))
    fields = [f for f in pieces.columns if f != "row_id"]

    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "row_id"], ascending=[False, True, True], kind="stable", na_position="first")
        frame["local"], frame["offset"], _ = best_fit_decreasing(frame["length"].to_numpy(), window)
        return frame[[*fields, "shard", "local", "offset"]]

    schema = ", ".join(f"{n} {t}" for n, t in dealt.drop("row_id").dtypes) + ", local long, offset long"
    part = written(dealt.where(~full).groupBy("shard").applyInPandas(fill, schema), "packed")
    sizes = part.groupBy("shard").agg((F.max("local") + 1).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    packed = part.join(bases, "shard").select(*fields, (F.col("base") + F.col("local")).alias("sequence_id"), "offset")
    # Windows that one piece fills are numbered apart, from 2**60 up.
    whole = pieces.where(full).select(*fields, (F.lit(1 << 60) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their sequence and offset."""
    return pack(written(cut_documents(docs, window, end_id, tokenizer), "pieces"), window)
