"""Removal of repeated word runs with fixed-block anchors (operator 11).

Every word covered by a window of ``WINDOW`` words that also starts earlier
(in a document of smaller id, or earlier in the same one) is removed, and all
windows are judged on the input.

The reference blocks are each document's successive, non-overlapping runs of
``BLOCK`` words.  A window of at least 2 * BLOCK - 1 words holds a whole
reference block, wherever it starts, so a window that repeats an earlier one
repeats a block of the earlier document.  Every rolling window of ``BLOCK`` words
probes the index of blocks.  A hit is extended word by word as far as its
neighbours hit as well; what is long enough becomes candidate windows, which are
settled by the hash of the whole window: its earliest place stays, the others
go.  Candidate windows that follow one another make up a maximal exact repeat.

Both the index and the windows are dealt by ranges of their hashes into shards
of bounded size.  A task sends a shard the different hashes of its block of text,
so that a passage that a third of all documents hold costs one entry a block, and
gets back which of them count.  No pair of places is ever listed.

Defined results: a null text has no words, and nothing is removed.  Shorter
documents than a window neither lose words nor cause a loss.  A null id counts as
smaller than all others.  Rows that repeat an id are documents of their own; the
one read first counts as earlier.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loftline.llm.kernels import _Powers, mix64, runs, span_hashes, text_blocks, utf8_view, word_spans
from loftline.llm.store import attach, lean, written

WINDOW = 20
BLOCK = 10
#: Bytes of text whose hashes share a shard, and of text in a packed block.
SHARD_BYTES = 12 << 20
_PACK = 4 << 20
_FIRST = -(2**63)
_LEVEL = 6
_PACKED = "block long, doc_ids array<long>, n_bytes long, sizes array<int>, texts binary"


def packed(docs: DataFrame) -> DataFrame:
    """Written blocks of whole documents, ascending by id within a block, with their texts compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, zstd = TaskContext.get().partitionId() << 32, pa.Codec("zstd", _LEVEL)
        for seq, block in enumerate(text_blocks(batches, "text", _PACK)):
            block = block.take(pc.sort_indices(block, [("doc_id", "ascending")], null_placement="at_start"))
            buf, offs = utf8_view(block["text"])
            one = lambda x, t: pa.array([x], t)
            yield pa.RecordBatch.from_arrays(
                [
                    one(part | seq, pa.int64()),
                    one(block["doc_id"].to_pylist(), pa.list_(pa.int64())),
                    one(len(buf), pa.int64()),
                    one(np.diff(offs), pa.list_(pa.int32())),
                    one(zstd.compress(pa.py_buffer(np.ascontiguousarray(buf)), asbytes=True), pa.binary()),
                ],
                [x.split()[0] for x in _PACKED.split(", ")],
            )

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(pack), _PACKED), "packed-texts")


class _Block:
    """One packed row: its documents' bytes and words."""

    def __init__(self, batch: pa.RecordBatch, k: int) -> None:
        self.number = batch.column("block")[k].as_py()
        self.ids = batch.column("doc_ids")[k].values
        sizes = batch.column("sizes")[k].values.to_numpy()
        self.offs = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        packed_bytes, n = batch.column("texts")[k].as_buffer(), batch.column("n_bytes")[k].as_py()
        self.buf = np.frombuffer(pa.decompress(packed_bytes, n, "zstd"), np.uint8) if n else np.zeros(0, np.uint8)

    def hashed(self) -> _Block:
        starts, ends, self.first = word_spans(self.buf, self.offs)
        self.n = len(starts)
        up, self.down = _Powers.upto(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(span_hashes(self.buf, starts, ends) * up[: self.n], out=self.sums[1:])
        self.left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(self.n)
        return self

    def rolling(self, size: int, starts: np.ndarray) -> np.ndarray:
        """Hashes of the ``size`` words from each of ``starts`` on."""
        with np.errstate(over="ignore"):
            return mix64((self.sums[starts + size] - self.sums[starts]) * self.down[starts] + np.uint64(size))

    def probes(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all windows of ``size`` words, the different hashes, each start's place among them, and whether a reference block begins there."""
        starts = np.flatnonzero(self.left >= size)
        hashes, which = np.unique(self.rolling(size, starts), return_inverse=True)
        in_doc = starts - np.repeat(self.first[:-1], np.diff(self.first))[starts]
        return starts, hashes, which, in_doc % size == 0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, pa.RecordBatch, int]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield _Block(batch, k), batch, k


def _dealt(hashes: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Shards and their slices of ascending ``hashes``."""
    shard = ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.diff(shard, prepend=-1))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(shard)]):
        yield int(shard[a]), slice(a, b)


def _bytes(values: np.ndarray) -> bytes:
    return pa.compress(pa.py_buffer(np.ascontiguousarray(values)), "zstd", asbytes=True)


def _values(buffer: pa.Buffer, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(buffer, n * np.dtype(kind).itemsize, "zstd"), kind) if n else np.zeros(0, kind)


def _hits(table: pa.Table) -> pa.Table:
    """Which of a shard's probes occur more than once and meet a reference block; by block the places of its hashes."""
    grams = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["grams"]]
    sizes = [len(x) for x in grams]
    every = np.concatenate(grams)
    order = np.argsort(every, kind="stable")
    sorted_values = every[order] >> np.uint32(2)
    head = np.flatnonzero(np.diff(sorted_values, prepend=np.uint32(0xFFFFFFFF)))
    flags = np.bitwise_or.reduceat((every & np.uint32(3))[order], head)
    count = np.diff(np.append(head, len(every)))
    hit = np.zeros(len(every), bool)
    hit[order] = np.repeat(((count > 1) | (flags >= 2)) & (flags & np.uint32(1) > 0), count)
    blocks, places, at = [], [], 0
    for block, base, size in zip(table["block"].to_pylist(), table["base"].to_pylist(), sizes):
        found = np.flatnonzero(hit[at : at + size])
        at += size
        if len(found):
            blocks.append(block)
            places.append((found + base).astype(np.uint32).tobytes())
    return pa.table([pa.array(blocks, pa.int64()), pa.array(places, pa.binary())], ["block", "places"])


def _later(table: pa.Table) -> pa.Table:
    """Word places, by block, of a shard's windows that have an earlier equal one."""
    sizes = table["n"].to_numpy()
    one = lambda name, kind: np.concatenate([_values(x.as_buffer(), n, kind) for x, n in zip(table[name], sizes.tolist())])
    window = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table["windows"]])
    doc, place = one("docs", np.int64), one("at", np.uint32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    blocks = table["block"].to_numpy()
    order = np.lexsort((blocks[row], doc, window))
    later = np.zeros(len(window), bool)
    later[order[1:]] = window[order[1:]] == window[order[:-1]]
    out_blocks, found_n, places = [], [], []
    ends = np.cumsum(sizes)
    for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
        found = place[a:b][later[a:b]]
        if len(found):
            out_blocks.append(int(blocks[k]))
            found_n.append(len(found))
            places.append(_bytes(np.sort(found)))
    for block, n, within in zip(blocks.tolist(), table["n_within"].to_pylist(), table["within"].to_pylist()):
        if n:
            out_blocks.append(block)
            found_n.append(n)
            places.append(within)
    return pa.table([pa.array(out_blocks, pa.int64()), pa.array(found_n, pa.int32()), pa.array(places, pa.binary())], ["block", "n", "at"])


def _repeat_starts(table: DataFrame, window: int, block: int) -> DataFrame:
    """By packed block, places of words where a window starts that has an earlier equal one."""
    size = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))
    fields = "shard int, block long, n int, windows binary, docs binary, at binary, n_within int, within binary"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, _ in _blocks(batches):
            _, hashes, which, reference = b.hashed().probes(block)
            again = np.bincount(which, minlength=len(hashes)) > 1
            anchored = np.zeros(len(hashes), bool)
            anchored[which[reference]] = True
            grams = (hashes.astype(np.uint32) << np.uint32(2)) | (again.astype(np.uint32) << np.uint32(1)) | anchored.astype(np.uint32)
            rows = [(s, b.number, part.start, grams[part].tobytes()) for s, part in _dealt(hashes, shards)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["shard", "block", "base", "grams"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in fields.split(", ")]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
        for b, batch, k in _blocks(batches):
            starts, hashes, which, _ = b.hashed().probes(block)
            hit = np.zeros(len(hashes), bool)
            for places in batch.column("places")[k].values or ():
                hit[np.frombuffer(places.as_buffer(), np.uint32)] = True
            # Windows that some hit reaches when it is extended on either side.
            at = starts[hit[which]]
            edge = np.bincount(np.maximum(at - (window - block), 0), minlength=b.n + 1) - np.bincount(at + 1, minlength=b.n + 1)
            candidate = np.flatnonzero((np.cumsum(edge)[: b.n] > 0) & (b.left >= window))
            windows, first = np.unique(b.rolling(window, candidate), return_index=True)
            places = candidate[first].astype(np.uint32)
            row = np.searchsorted(b.first, candidate[first], "right") - 1
            ids = pc.fill_null(b.ids, _FIRST).to_numpy()[row]
            local = np.ones(len(candidate), bool)
            local[first] = False
            # Places that an earlier one in the block settles travel with the block's first shard.
            rows = [[s, b.number, part.stop - part.start, windows[part].tobytes(), _bytes(ids[part]), _bytes(places[part]), 0, None] for s, part in _dealt(windows, shards)]
            if local.any():
                rows[0][-2:] = [int(local.sum()), _bytes(candidate[local].astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 8, kinds)], names)

    hits = table.mapInArrow(lean(probe), "shard int, block long, base int, grams binary").groupBy("shard").applyInArrow(_hits, "block long, places binary")
    hits = hits.groupBy("block").agg(F.collect_list("places").alias("places"))
    extended = table.select("block", "doc_ids", "n_bytes", "sizes", "texts").join(hits, "block").mapInArrow(lean(extend), fields)
    return extended.groupBy("shard").applyInArrow(_later, "block long, n int, at binary")


def _stripped(docs: DataFrame, window: int, block: int, fields: str, rows_of: Callable) -> DataFrame:
    """``rows_of(ids, raw, offs, first, gone)`` of every block, from its words that repeated windows cover."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole reference block wherever it starts: 2 * block - 1 words or more")
    attach(docs.sparkSession)
    table = packed(docs)
    found = _repeat_starts(table, window, block).groupBy("block").agg(F.collect_list(F.struct("n", "at")).alias("found"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in fields.split(", ")]
        for b, batch, k in _blocks(batches):
            starts, _, first = word_spans(b.buf, b.offs)
            edge = np.zeros(len(starts) + window + 1, np.int32)
            for x in batch.column("found")[k].values or ():
                at = _values(x["at"].as_buffer(), x["n"].as_py(), np.uint32)
                edge[at] += 1
                edge[at.astype(np.int64) + window] -= 1
            gone = np.cumsum(edge)[: len(starts)] > 0
            yield pa.RecordBatch.from_arrays(rows_of(b, starts, first, gone), names)

    return table.join(found, "block", "left").mapInArrow(lean(strip), fields)


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by one space); ``with_text`` adds them as ``kept``."""
    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * with_text

    def rows(b: _Block, starts: np.ndarray, first: np.ndarray, gone: np.ndarray) -> list[pa.Array]:
        raw, stay, kept = b.buf.tobytes(), ~gone, []
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
        for lo, hi, a, z, n in zip(b.offs[:-1].tolist(), b.offs[1:].tolist(), first[:-1].tolist(), first[1:].tolist(), removed.tolist()):
            words = raw[lo:hi].split()
            kept.append(b" ".join(compress(words, stay[a:z].tolist()) if n else words))
        sha = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
        return [b.ids, pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), sha, *([pa.array(kept, pa.binary())] if with_text else [])]

    return _stripped(docs, window, block, fields, rows)


def maximal_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, first and past-last word, and the text of every maximal run of words that repeated windows cover."""

    def rows(b: _Block, starts: np.ndarray, first: np.ndarray, gone: np.ndarray) -> list[pa.Array]:
        # A run never joins two documents: the place before a document's first word ends it.
        marks = np.insert(gone, first[1:-1], False)
        lo, hi = runs(marks)
        row = np.searchsorted(first[1:-1] + np.arange(len(first) - 2), lo, "right")
        lo, hi = lo - row - first[row], hi - row - first[row]
        raw = b.buf.tobytes()
        text = [b" ".join(raw[b.offs[r] : b.offs[r + 1]].split()[a:z]).decode() for r, a, z in zip(row.tolist(), lo.tolist(), hi.tolist())]
        return [b.ids.take(pa.array(row)), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(text, pa.string())]

    return _stripped(docs, window, block, "doc_id long, start long, end long, words string", rows)
