"""Alignment of two tokenizers' tokens by the bytes they cover (operator 12).

A byte-level tokenizer (A) and a piece tokenizer (B) encode the same text, with a
space before it.  Both tile its bytes, so a token is an interval.  Each task loads
a stretch's intervals into DuckDB: an as-of join finds the B token that holds an A
token's first byte, a range join those that begin inside it, and a window's running
count of the ends that both share numbers the groups.  Pairs are counted there for the
stretch's block of texts; the partial counts are merged in Spark, and only a
block's own different pairs come back to it.

Texts are cut for B before each space that follows another byte.  None of its
pieces holds a space after anything else, so no merge crosses such a place; equal
cuts are encoded once.  A stretch ends where both tokenizers end a token, so a very
long text is several stretches, and DuckDB's memory is bounded by the stretch
unless the two share no end for longer.

Defined results: a text that is null, empty or isn't given back by both tokenizers
byte for byte (such as one with U+2581) has no tokens: zeros and no hash.  Rows
that repeat an id are texts of their own.  An empty table gives no rows.  Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loftline.llm.kernels import ragged, text_blocks, utf8_view
from loftline.llm.store import attach, lean, written
from loftline.llm.tokens import _BYTE_CHARS, DEFAULT_TOKENIZER, _Seen, encode_block, load, pieces_encoded

PIECES = "piece_bpe_32k.model"
#: Bytes of text in a block and of a stretch that DuckDB joins at a time.
BLOCK_BYTES = 1 << 20
STRETCH = 512 << 10
#: Pieces of text whose ids a worker remembers for each tokenizer.
REMEMBER = 1 << 18
_NO_ID = 0xFFFFFFFF
_BLOCKS = "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, links binary, a array<int>, b array<int>, n array<long>"

_OVERLAPS = """
SELECT a.at, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.lo >= b.lo
UNION ALL
SELECT a.at, a.id AS a, b.id AS b FROM (SELECT * FROM b ANTI JOIN a USING (lo)) b JOIN a ON b.lo > a.lo AND b.lo < a.hi
"""
_GROUPS = """
SELECT a.at AS last_a, b.at AS last_b, count(*) OVER (ORDER BY a.hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g
FROM a JOIN b USING (hi) ORDER BY g
"""


@cache
def _byte_table(tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of A's entries end to end, where each begins, and its length."""
    plain = load(tokenizer, special=False)[0]
    value = {c: k for k, c in enumerate(_BYTE_CHARS)}
    words = [b""] * (max(plain.get_vocab().values()) + 1)
    for token, k in plain.get_vocab().items():
        words[k] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
    return _joined(words)


@cache
def _piece_model(pieces: str) -> tuple:
    """B's library object, and bytes, beginnings and lengths of its pieces."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pieces if "/" in pieces else public_tokenizers.path(pieces))
    words = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        words.append(bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode())
    return model, *_joined(words)


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes


def _pieces_encoder(pieces: str):  # noqa: ANN202
    model = _piece_model(pieces)[0]
    lone = model.piece_to_id("▁")

    def encode(cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # The library adds the first space itself.
        found = model.encode([c[1:] for c in cuts], num_threads=1) if cuts else []
        found = [ids or [lone] for ids in found]
        count = np.array([len(ids) for ids in found], np.int64)
        return np.fromiter((x for ids in found for x in ids), np.uint32), np.stack([np.cumsum(count) - count, count])

    return encode


def encode_pieces(buf: np.ndarray, offs: np.ndarray, pieces: str = PIECES) -> tuple[np.ndarray, np.ndarray]:
    """B's ids of texts that each begin with a space, end to end, and each text's offset in them."""
    begins = np.zeros(len(buf), bool)
    begins[1:] = (buf[1:] == 0x20) & (buf[:-1] != 0x20)
    begins[offs[:-1]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(buf))
    seen = _Seen.by_name.setdefault((pieces, False), _Seen(REMEMBER))
    every, at, count, which = pieces_encoded(buf, starts, ends, seen, _pieces_encoder(pieces))
    upto = np.concatenate([[0], np.cumsum(count[which])])
    return ragged(every, at[which], count[which]), upto[np.searchsorted(starts, offs)]


def _given_back(ids: np.ndarray, rows: np.ndarray, table: tuple, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text's tokens have its very bytes."""
    data, at, size = table
    lengths = np.concatenate([[0], np.cumsum(size[ids])])[rows]
    good = np.diff(lengths) == np.diff(offs)
    some = np.repeat(good, np.diff(rows))
    joined = ragged(data, at[ids[some]], size[ids[some]])
    want = buf[np.repeat(good, np.diff(offs))]
    bad = np.concatenate([[0], np.cumsum(joined != want)])[np.concatenate([[0], np.cumsum(np.diff(offs)[good])])]
    good[good] = np.diff(bad) == 0
    return good


class _Side:
    """One tokenizer's tokens of the texts that count: ids, intervals and texts."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, good: np.ndarray, size: np.ndarray) -> None:
        held = np.repeat(good, np.diff(rows))
        self.id, self.doc = ids[held].astype(np.int32), np.repeat(np.arange(len(good)), np.diff(rows))[held]
        self.hi = np.cumsum(size[self.id])
        self.lo = self.hi - size[self.id]
        self.group = np.zeros(len(self.id), np.int64)

    def table(self, part: slice) -> pa.Table:
        base = self.lo[part.start]
        columns = {"at": np.arange(part.stop - part.start), "id": self.id[part], "lo": self.lo[part] - base, "hi": self.hi[part] - base}
        return pa.table({k: v.astype(np.int32) for k, v in columns.items()})


def _stretches(a: _Side, b: _Side, size: int) -> Iterator[tuple[slice, slice]]:
    """Slices of tokens between ends that both share, about ``size`` bytes each."""
    place = np.minimum(np.searchsorted(b.hi, a.hi), len(b.hi) - 1)
    shared = a.hi[b.hi[place] == a.hi] if len(b.hi) else a.hi[:0]
    last_a = last_b = 0
    while last_a < len(a.id):
        end = shared[min(np.searchsorted(shared, (a.lo[last_a] + size)), len(shared) - 1)]
        next_a, next_b = int(np.searchsorted(a.hi, end, "right")), int(np.searchsorted(b.hi, end, "right"))
        yield slice(last_a, next_a), slice(last_b, next_b)
        last_a, last_b = next_a, next_b


def _texts_of_groups(a: _Side, b: _Side, n_docs: int) -> list[str]:
    """By text, the hash of its groups' ids as a1,a2|b1;a3|b2,b3."""
    groups = int(a.group[-1]) + 1 if len(a.group) else 0
    count_a, count_b = np.bincount(a.group, minlength=groups), np.bincount(b.group, minlength=groups)
    before_a, before_b = np.cumsum(count_a), np.cumsum(count_b) - count_b
    # A group's tokens of A come first, then those of B.
    slot_a, slot_b = np.arange(len(a.id)) + before_b[a.group], np.arange(len(b.id)) + before_a[b.group]
    total = len(a.id) + len(b.id)
    ids, mark, doc = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
    for side, slot, head in ((a, slot_a, 1), (b, slot_b, 2)):
        new = np.diff(side.group, prepend=-1) > 0
        ids[slot], mark[slot], doc[slot] = side.id, np.where(new, head, 0), side.doc
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    mark[first] = 3
    ids = ids * 4 + mark
    names = np.flatnonzero(np.bincount(ids)) if total else ids
    which = np.zeros(int(names[-1]) + 1 if total else 0, np.int64)
    which[names] = np.arange(len(names))
    which = which[ids]
    data, at, size = _joined([(",", ";", "|", "")[k & 3].encode() + str(k >> 2).encode() for k in names.tolist()])
    raw = ragged(data, at[which], size[which]).tobytes()
    edge = np.concatenate([[0], np.cumsum(size[which])])[np.append(first, total)]
    out = [""] * n_docs
    for d, lo, hi in zip(doc[first].tolist(), edge[:-1].tolist(), edge[1:].tolist()):
        out[d] = hashlib.sha256(raw[lo:hi]).hexdigest()
    return out


def _aligned_block(con, texts: pa.ChunkedArray, tokenizer: str, pieces: str) -> tuple[list, bytes, list]:  # noqa: ANN001
    """Counts and hash by text, the texts' links as places among the block's pairs, and the pairs with their counts."""
    buf, offs = utf8_view(texts)
    n = len(offs) - 1
    filled = np.flatnonzero(np.diff(offs))
    spaced = np.insert(buf, offs[filled], 0x20)
    spaced_offs = np.concatenate([[0], np.cumsum(np.diff(offs)[filled] + 1)])
    ids_a, rows_a = encode_block(spaced, spaced_offs, _NO_ID, tokenizer, special=False, remember=REMEMBER)
    ids_a, rows_a = ids_a[ids_a != _NO_ID], rows_a - np.arange(len(rows_a))
    ids_b, rows_b = encode_pieces(spaced, spaced_offs, pieces)
    table_a, table_b = _byte_table(tokenizer), _piece_model(pieces)[1:]
    good = _given_back(ids_a, rows_a, table_a, spaced, spaced_offs) & _given_back(ids_b, rows_b, table_b, spaced, spaced_offs)
    a, b = _Side(ids_a, rows_a, good, table_a[2]), _Side(ids_b, rows_b, good, table_b[2])
    links, base = [], 0
    for part_a, part_b in _stretches(a, b, STRETCH):
        con.register("a", a.table(part_a))
        con.register("b", b.table(part_b))
        found = con.execute(_OVERLAPS).fetchnumpy()
        links.append((part_a.start + found["at"].astype(np.int64), found["a"].astype(np.int64) << 32 | found["b"].astype(np.int64)))
        # A group ends with a token of each side, at an end that both share.
        numbered = con.execute(_GROUPS).fetchnumpy()
        for side, part, last in ((a, part_a, "last_a"), (b, part_b, "last_b")):
            side.group[part] = np.repeat(base + numbered["g"], np.diff(numbered[last].astype(np.int64), prepend=-1))
        base = int(a.group[part_a.stop - 1]) + 1
    at, key = (np.concatenate(x) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
    doc = a.doc[at]
    # Numbers of 16 bits are sorted by radix.
    order = np.argsort(doc.astype(np.uint16) if len(filled) <= 1 << 16 else doc, kind="stable")
    con.register("links", pa.table({"k": key}))
    pairs = con.execute("SELECT k, count(*) AS n FROM links GROUP BY k ORDER BY k").fetchnumpy()
    place = np.searchsorted(pairs["k"], key[order]).astype(np.uint32)
    # A group is a text's own: its number rises by one at each shared end.
    head = np.flatnonzero(np.diff(a.group, prepend=-1))
    counts = [np.bincount(x, minlength=len(filled)) for x in (a.doc, b.doc, a.doc[head], doc)]
    spread = np.zeros((4, n), np.int64)
    spread[:, filled] = counts
    sha = np.full(n, "", object)
    sha[filled] = _texts_of_groups(a, b, len(filled))
    blob = pa.compress(pa.py_buffer(place), "zstd", asbytes=True) if len(place) else b""
    return [*spread, sha], blob, [(pairs["k"] >> 32).astype(np.int32), (pairs["k"] & 0xFFFFFFFF).astype(np.int32), pairs["n"]]


def _blocks(docs: DataFrame, tokenizer: str, pieces: str) -> DataFrame:
    """Written blocks: counts and links of their texts, and their pairs with partial counts."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        with duckdb.connect(config={"threads": 1, "allocator_flush_threshold": "1MB", "memory_limit": "1GB"}) as con:
            for seq, block in enumerate(text_blocks(batches, "text", BLOCK_BYTES)):
                per_text, blob, pairs = _aligned_block(con, block["text"], tokenizer, pieces)
                longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
                values = [part | seq, block["doc_id"].to_pylist(), *per_text[:4], per_text[4].tolist(), blob, *pairs]
                kinds = [pa.int64(), longs, longs, longs, longs, longs, pa.list_(pa.string()), pa.binary(), ints, ints, longs]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], [x.split()[0] for x in _BLOCKS.split(", ")])

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(align), _BLOCKS), "aligned")


def _pairs(blocks: DataFrame) -> DataFrame:
    """block, place, a, b and n of each different pair of a block."""
    return blocks.select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("place", "p")).select("block", "place", "p.a", "p.b", "p.n")


def pair_counts(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, pieces: str = PIECES) -> DataFrame:
    """a, b, n (links) and best (the highest of its b) of every pair of ids that share bytes anywhere."""
    attach(docs.sparkSession)
    return _merged(_blocks(docs, tokenizer, pieces))


def _merged(blocks: DataFrame) -> DataFrame:
    counts = written(_pairs(blocks).groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return counts.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, pieces: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every text."""
    attach(docs.sparkSession)
    blocks = _blocks(docs, tokenizer, pieces)
    known = written(_merged(blocks), "pairs")
    back = _pairs(blocks).select(F.col("block").alias("owner"), "place", "a", "b").join(known, ["a", "b"]).select("owner", "place", "n", "best")
    fields = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def settle(own: pa.Table, pairs: pa.Table) -> pa.Table:
        at = pairs["place"].to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = pairs["n"].to_numpy(), pairs["best"].to_numpy(zero_copy_only=False)
        lists = [own[x].combine_chunks().values for x in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "sha")]
        n_links = lists[4].to_numpy()
        total, blob = int(n_links.sum()), own["links"][0].as_buffer()
        place = np.frombuffer(pa.decompress(blob, 4 * total, "zstd"), np.uint32) if total else np.zeros(0, np.uint32)
        edge = np.concatenate([[0], np.cumsum(n_links)])
        n_best, sums = (np.diff(np.concatenate([[0], np.cumsum(x[place])])[edge]) for x in (best, count))
        return pa.table([*lists[:5], pa.array(n_best), pa.array(sums), lists[5]], [x.split()[0] for x in fields.split(", ")])

    rest = blocks.select("block", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "sha", "links")
    return rest.groupBy("block").cogroup(back.groupBy("owner")).applyInArrow(settle, fields)

