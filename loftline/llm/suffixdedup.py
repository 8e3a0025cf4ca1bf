"""Removal of repeated byte strings with suffix arrays (operator 9).

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere is
removed, and all strings are judged on the input.  Passages too short for that,
from ``PASSAGE`` bytes on, are counted and stay.

A string's anchor is the least of the ``GRAM``-byte fingerprints in its first
``PASSAGE`` bytes, so that equal strings have equal anchors at equal places.
Starts that follow one another and share an anchor form a unit: the bytes their
strings cover.  A unit's key adds what all its strings surely contain beside the
anchor (more than half of ``PASSAGE``), and equal strings always have equal keys.
Only units whose key occurs more than once can hold a repeat; equal units are
counted, and one stands for all.  Where a key has equal units only, all their
starts repeat.  The other units are dealt by key into shards of bounded size.
Each shard's suffix array is built by prefix doubling; permuted common prefixes of
the starts in it then show which share their bytes with another.  Keys with very many
different units are cut into tiles, each pair of tiles its own shard.

Defined results: a null text is empty: nothing is removed.  Texts shorter than
``PASSAGE`` neither lose bytes nor cause a loss.  Rows that repeat an id are
documents of their own.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loftline.llm.kernels import _BYTE_CODE, _Powers, mix64, runs, text_blocks, utf8_view
from loftline.llm.store import attach, discard, lean, written
from loftline.llm.suffixes import common_prefixes, suffix_array

LENGTH = 400
#: Fifty words at five bytes, their blanks included.
PASSAGE = 250
GRAM = 32
#: Bytes of units in a shard, and different units of one key that meet in a task.
SHARD_BYTES = 256 << 10
TILE = 1500
_BLOCK = 4 << 20
_UNIT = "doc long, doc_id long, n_bytes long, sha string, key long, content long, first int, starts int, span int"


def _doc_key(doc_id: int | None, sha: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{doc_id}:{sha}".encode(), digest_size=8).digest(), "little", signed=True)


class _Prefix:
    """Hashes of any spans of a block."""

    def __init__(self, buf: np.ndarray) -> None:
        up, self.down = _Powers.upto(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE_CODE[buf] * up[: len(buf)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def each(self, size: int) -> np.ndarray:
        """Hashes of the spans of ``size`` bytes from every place."""
        n = len(self.sums) - size
        with np.errstate(over="ignore"):
            return mix64((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size))


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` successive values."""
    n = len(values) - width + 1
    pad = -len(values) % width
    rows = np.concatenate([values, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def units_of(buf: np.ndarray, offs: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, ...]:
    """Row, key, content hash, first start (in its row), number of starts and bytes of every unit.

    Starts have ``length`` bytes in their row; the unit goes on to ``reach`` bytes from its last start, or to its row's end.
    """
    none = np.zeros(0, np.int64)
    sizes = np.diff(offs)
    if len(buf) < length or not (sizes >= length).any():
        return none, none, none, none, none, none
    prefix, n = _Prefix(buf), len(buf)
    # The place breaks ties to the left; blocks are smaller than 2**32.
    ranked = prefix.each(GRAM)
    ranked &= ~np.uint64(0xFFFFFFFF)
    ranked |= np.arange(n - GRAM + 1, dtype=np.uint64)
    anchor_at = _window_least(ranked, length - GRAM + 1).astype(np.uint32)
    good = np.zeros(n + 1, np.int32)
    rows = np.flatnonzero(sizes >= length)
    np.add.at(good, offs[:-1][rows], 1)
    np.add.at(good, offs[1:][rows] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(good[:n]) > 0)
    anchor = anchor_at[start].astype(np.int64)
    # Strings with the anchor in their later half surely contain what precedes it; the others what follows.
    half = (length - GRAM) // 2
    late = anchor - start >= half
    row = np.repeat(rows, sizes[rows] - length + 1)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (late[1:] != late[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(start)))
    first, anchor, late, row = start[head], anchor[head], late[head], row[head]
    core = prefix.hash(np.where(late, anchor - half, anchor), np.where(late, anchor + GRAM, anchor + length - half + 1))
    with np.errstate(over="ignore"):
        key = mix64(core * np.uint64(0x9E3779B97F4A7C15) + late.astype(np.uint64))
        last = np.minimum(first + count - 1 + reach, offs[row + 1])
        content = mix64(prefix.hash(first, last) * np.uint64(0xBF58476D1CE4E5B9) + (anchor - first).astype(np.uint64))
    return row, key.view(np.int64), content.view(np.int64), first - offs[row], count, last - first


def _repeated(table: pa.Table, lengths: tuple[int, ...]) -> pa.Table:
    """Starts of a shard's units that share so many bytes with another start, for each of the ascending ``lengths``."""
    contents = [np.frombuffer(x, np.uint8) for x in table["bytes"].to_pylist()]
    times, starts = table["n"].to_numpy(), table["starts"].to_numpy()
    sizes = np.array([len(c) for c in contents])
    # Symbols: 0 ends the shard, 1 a unit; bytes follow.
    text = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.int16)
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    unit = np.zeros(len(text), np.int32)
    is_start = np.zeros(len(text), bool)
    for k, c in enumerate(contents):
        text[first[k] : first[k] + sizes[k]] = c
        text[first[k] : first[k] + sizes[k]] += 2
        text[first[k] + sizes[k]] = 1
        is_start[first[k] : first[k] + starts[k]] = True
        unit[first[k] : first[k] + sizes[k] + 1] = k
    order = suffix_array(text)
    order = order[is_start[order]]
    between = common_prefixes(text, order, lengths[-1])[1:]
    room = np.append(first + sizes, len(text))[unit] - np.arange(len(text))
    out = []
    for length in lengths:
        hit = np.zeros(len(order), bool)
        hit[:-1] |= between >= length
        hit[1:] |= between >= length
        mark = np.zeros(len(text), bool)
        mark[order[hit]] = True
        # A unit that occurs several times repeats itself from start to end.
        mark |= is_start & (times > 1)[unit]
        # What is shared beyond a unit's own bytes doesn't count.
        mark &= room >= length
        # Runs never join units: a unit's starts are followed by bytes that are none.
        lo, hi = runs(mark)
        k = unit[lo]
        take = pa.array(k)
        out.append(pa.table([table["key"].combine_chunks().take(take), table["content"].combine_chunks().take(take), pa.array(np.full(len(lo), length, np.int32)), pa.array(lo - first[k]), pa.array(hi - first[k])], ["key", "content", "length", "lo", "hi"]))
    return pa.concat_tables(out)


def repeated_ranges(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: documents (doc, doc_id, n_bytes, sha), texts that hold repeats (doc, text), and their repeated starts (doc, length, lo, hi)."""
    spark = docs.sparkSession
    attach(spark)
    lengths = (min(passage, length), length)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _UNIT.split(", ")]
        for block in text_blocks(batches, "text", _BLOCK):
            buf, offs = utf8_view(block["text"])
            raw, n = memoryview(np.ascontiguousarray(buf)), block.num_rows
            ids = block["doc_id"].to_pylist()
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            doc = np.array([_doc_key(i, s) for i, s in zip(ids, sha)], np.int64)
            row, *unit = units_of(buf, offs, *lengths)
            nothing = lambda t, m: pa.nulls(m, t)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(doc), block["doc_id"].combine_chunks(), pa.array(np.diff(offs)), pa.array(sha), *[nothing(t, n) for t in kinds]], names)
            for at in range(0, len(row), 1 << 16):
                some = slice(at, at + (1 << 16))
                m = len(row[some])
                yield pa.RecordBatch.from_arrays([pa.array(doc[row[some]]), *[nothing(t, m) for t in (pa.int64(), pa.int64(), pa.string())], *[pa.array(x[some], t) for x, t in zip(unit, kinds)]], names)

    scanned = written(docs.mapInArrow(lean(cut), _UNIT), "units")
    rows = written(scanned.where("sha IS NOT NULL").select("doc", "doc_id", "n_bytes", "sha"), "repeat-rows")
    units = scanned.where("key IS NOT NULL").select("doc", "key", "content", "first", "starts", "span")
    # A key's occurrences are counted in each task before they are shuffled.  Counts are written
    # before they are joined, so that a key with very many units can be split there.
    often = written(units.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key"), "repeat-keys")
    held = written(units.join(often, "key"), "held-units")
    discard(scanned, often)
    contents = written(held.groupBy("key", "content").agg(F.count("*").alias("n"), F.min(F.struct("doc", "first")).alias("at"), F.min("starts").alias("starts"), F.min("span").alias("span")), "unit-contents")
    kinds = written(contents.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), "unit-kinds")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            doc = [_doc_key(i, hashlib.sha256(t).hexdigest()) for i, t in zip(batch.column("doc_id").to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(texts, pa.binary())], ["doc", "text"])

    wanted = held.select("doc").distinct()
    ids = rows.join(wanted, "doc", "left_semi").select(F.col("doc_id").alias("wanted")).distinct()
    some = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").mapInArrow(named, "doc long, text binary")
    texts = written(some.dropDuplicates(["doc"]), "repeat-texts")

    # One kind of unit under a key: all its starts repeat, as far as they have the bytes.
    alone = contents.join(kinds, "key", "left_anti").select("key", "content", F.explode(F.array(*[F.struct(F.lit(n).alias("length"), F.least("starts", F.col("span") - n + 1).cast("long").alias("hi")) for n in lengths])).alias("r"))
    alone = alone.select("key", "content", "r.length", F.lit(0).cast("long").alias("lo"), "r.hi").where("hi > 0")
    per_doc = contents.join(kinds.select("key"), "key").groupBy("at.doc").agg(F.collect_list(F.struct("key", "content", "n", F.col("at.first").alias("first"), "starts", "span")).alias("units"))
    # Unit lists are bounded by their document; only documents that stand for a unit are joined.
    sliced = texts.join(per_doc, "doc").select("text", F.explode("units").alias("u")).select("u.key", "u.content", "u.n", "u.starts", F.expr("substring(text, u.first + 1, u.span)").alias("bytes"))
    sliced = written(sliced, "unit-bytes")
    size = sliced.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    shards = max(1, int(size / SHARD_BYTES))
    many = kinds.where(F.col("kinds") > TILE).select("key", F.ceil(F.col("kinds") / TILE).cast("int").alias("tiles"))
    fixed = F.when(F.col("tiles").isNull(), F.pmod(F.xxhash64("key"), F.lit(shards)))
    at = F.pmod(F.xxhash64("content"), F.col("tiles")).cast("int")
    other = F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = sliced.join(many, "key", "left").withColumn("at", F.coalesce(at, F.lit(0))).withColumn("other", other)
    hot = F.when(F.col("tiles").isNotNull(), F.col("key"))
    dealt = dealt.select(fixed.alias("shard"), hot.alias("hot"), F.least("at", "other").alias("t0"), F.greatest("at", "other").alias("t1"), "key", "content", "n", "starts", "bytes")
    found = dealt.groupBy("shard", "hot", "t0", "t1").applyInArrow(lambda table: _repeated(table, lengths), "key long, content long, length int, lo long, hi long")
    found = written(found.unionByName(alone), "repeats")
    discard(sliced, contents, kinds)
    ranges = held.join(found, ["key", "content"]).select("doc", "length", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))
    return rows, texts, ranges


def remove_repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passages of each document.

    ``n_passages`` counts the maximal runs covered by strings of ``passage`` bytes that
    also start elsewhere.  ``with_text`` adds ``kept``, the remaining bytes, null where
    the text holds no repeat.
    """
    rows, texts, ranges = repeated_ranges(docs, length, passage)
    per_doc = ranges.distinct().groupBy("doc").agg(F.collect_list(F.struct("length", "lo", "hi")).alias("ranges"))
    fields = "doc long, n_removed long, n_spans long, kept_sha256 string, n_passages long" + ", kept binary" * with_text

    def covered(n: int, size: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi - 1 + size, -1)
        return np.cumsum(edge)[:-1] > 0

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            every = batch.column("ranges").flatten()
            sizes, los, his = (every.field(k).to_numpy() for k in range(3))
            stops = np.cumsum(pc.list_value_length(batch.column("ranges")).to_numpy())
            for text, a, b in zip(batch.column("text"), [0, *stops.tolist()], stops.tolist()):
                raw, size, lo, hi = np.frombuffer(text.as_buffer(), np.uint8), sizes[a:b], los[a:b], his[a:b]
                gone = covered(len(raw), length, lo[size == length], hi[size == length])
                left = raw[~gone].tobytes()
                short = covered(len(raw), int(size.min()), lo[size < length], hi[size < length]) if size.min() < length else gone
                out.append((int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(left).hexdigest(), len(runs(short)[0]), left if with_text else None))
            cols = list(zip(*out)) or [()] * 5
            columns = [batch.column("doc"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64()))]]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(cols[4], pa.binary())] * with_text, [f.split()[0] for f in fields.split(", ")])

    stripped = texts.join(per_doc, "doc").mapInArrow(lean(strip), fields)
    out = rows.join(stripped, "doc", "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_bytes", count("n_removed"), count("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), count("n_passages"), *(["kept"] if with_text else []))
