"""MinHash near-duplicate detection with odd sketches (operator 10).

A document is the set of its distinct word shingles.  Two documents are linked
when the sets' Jaccard similarity is at least ``threshold``; a group is a
connected component of links, named by its smallest ``doc_id``.

1. Documents with equal sets form a class; one of them stands for it.
2. Classes get ``PERMUTATIONS`` MinHash samples, cut into bands.  Classes that
   agree in a band share a bucket.  Pairs at the threshold miss every band with a
   probability below one in ten million.
3. Each class also folds its samples into an odd sketch: a bitmap in which every
   sample flips one bit.  The population count of the XOR of two sketches
   estimates how similar the sets are; pairs estimated far below the threshold
   (six standard errors) are not looked at further.
4. In each bucket a class is tied to the likeliest earlier class of every tree it
   joins; that makes clusters which hold every link.  These likely pairs are
   confirmed on the full sets.  Clusters that this leaves in several components
   are then searched whole, in tiles of bounded size, and only links that join
   components come out.

Defined results: a null text, or one without words, has the empty set and is
linked with nothing.  A text of fewer words than a shingle is one shingle.  Rows
that repeat an id are kept apart unless their sets link them.  Null ids are
ordinary rows; a component's name is its smallest id that isn't null.  Extra
columns are ignored by ``near_duplicates`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loftline.llm.components import connected_components
from loftline.llm.kernels import mix64, span_hashes, text_blocks, utf8_view, word_spans
from loftline.llm.store import attach, lean, written

#: All samples go into the sketch; the first ``BANDS`` times ``BAND_ROWS`` are banded.
PERMUTATIONS, BANDS, BAND_ROWS = 256, 32, 4
SKETCH_BITS = 1024
#: Pairs estimated below threshold minus this are left out: six standard errors.
MARGIN = 0.16
#: Classes, and shingles, of which a tile holds about so many; two tiles meet in one task.
TILE, TILE_SHINGLES = 1000, 1_000_000

_rng = np.random.default_rng(20260102)
_A = _rng.integers(1, 2**63, (PERMUTATIONS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, (PERMUTATIONS, 1), dtype=np.uint64)
_SALT = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, first = word_spans(buf, offs)
    h = span_hashes(buf, starts, ends, lower=True)
    with np.errstate(over="ignore"):
        run = h.copy()
        for k in range(1, words):
            run[: len(h) - k] = run[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
        run = mix64(run)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                yield np.unique(run[a : b - words + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for x in h[a:b]:
                    whole = whole * np.uint64(0xBF58476D1CE4E5B9) + x
                yield mix64(np.array([whole], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    out = np.full(PERMUTATIONS, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            np.minimum(out, (shingles[at : at + 2048] * _A + _B).min(1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=np.uint64)
        for column in rows.T:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        bit = mix64(samples * _SALT) >> np.uint64(64 - (SKETCH_BITS - 1).bit_length())
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketches, given as rows of 64-bit words."""
    differ = np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)
    return 1 + SKETCH_BITS / (4 * PERMUTATIONS) * np.log(np.maximum(1 - 2 * differ / SKETCH_BITS, 1e-9))


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _class_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Written table: row_id, doc_id, n, cid (class, null for the empty set), bands, sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text", 4 << 20):
            n, cid, bands, sketch = [], [], [], []
            for s in shingle_sets(*utf8_view(block["text"]), words):
                samples = minhash(s) if len(s) else None
                n.append(len(s))
                cid.append(_class_id(s) if len(s) else None)
                bands.append(band_keys(samples) if len(s) else None)
                sketch.append(odd_sketch(samples) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [block["row_id"].combine_chunks(), block["doc_id"].combine_chunks(), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["row_id", "doc_id", "n", "cid", "bands", "sketch"],
            )

    return written(docs.select("row_id", "doc_id", "text").mapInArrow(lean(sign), "row_id long, doc_id long, n long, cid binary, bands array<long>, sketch binary"), "signatures")


def full_sets(docs: DataFrame, need: DataFrame, words: int) -> DataFrame:
    """Written table of cid and its whole set, for the classes of ``need`` (cid, doc_id)."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text", 4 << 20):
            sets = list(shingle_sets(*utf8_view(block["text"]), words))
            yield pa.RecordBatch.from_arrays([pa.array([_class_id(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "shingles"])

    ids = need.select(F.col("doc_id").alias("needed")).distinct()
    # Ids grow with the documents: they are dealt by key at every size, never broadcast.
    some = docs.select("doc_id", "text").join(ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("needed")), "left_semi").select("text")
    return written(some.mapInArrow(lean(fill), "cid binary, shingles binary"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                every = np.concatenate([p, q])
                every.sort()
                both = int(np.count_nonzero(every[1:] == every[:-1]))
                keep.append(100 * both >= percent * (len(every) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Both joins deal rows by class; no class has more rows than pairs it is in.
    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(lean(check), "a binary, b binary").distinct()


def _tiled(df: DataFrame, tiles: Column) -> DataFrame:
    """Deal rows into pairs of tiles (t0, t1): every two rows meet in one of them.

    ``side`` tells the first tile's rows (0) from the second's (1).
    """
    at = F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int")
    dealt = df.withColumn("tiles", tiles.cast("int")).withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.withColumns({"t0": F.least("at", "other"), "t1": F.greatest("at", "other"), "side": F.when(F.col("at") <= F.col("other"), 0).otherwise(1)}).drop("at", "other", "tiles")


def _edges(cid: list[bytes], pairs: list[tuple[int, int]]) -> pa.Table:
    ends = [sorted((cid[i], cid[j])) for i, j in pairs]
    return pa.table({"a": pa.array([e[0] for e in ends], pa.binary()), "b": pa.array([e[1] for e in ends], pa.binary())})


def _earlier(k: int, side: np.ndarray, within: bool) -> np.ndarray:
    """Rows that row ``k`` is held against: those before it, in the other tile if there are two."""
    return np.arange(k) if within else np.flatnonzero(side[:k] != side[k])


def _forest(least: float, percent: int):
    """Of a tile of a bucket: for each class the likeliest earlier one of every tree it joins."""

    def candidates(key: tuple, table: pa.Table) -> pa.Table:
        cid, n, side = table["cid"].to_pylist(), table["n"].to_numpy(), table["side"].to_numpy()
        sketch, tree, out = _words(table["sketch"].combine_chunks()), np.arange(len(cid)), []
        within = key[1].as_py() == key[2].as_py()
        for k in range(1, len(cid)):
            others = _earlier(k, side, within)
            others = others[100 * np.minimum(n[others], n[k]) >= percent * np.maximum(n[others], n[k])]
            est = estimated(sketch[others], sketch[k])
            others, est = others[est >= least], est[est >= least]
            order = np.lexsort((-est, tree[others]))
            others = others[order]
            best = others[np.flatnonzero(np.diff(tree[others], prepend=-1))]
            out += [(k, j) for j in best.tolist()]
            tree[np.isin(tree, np.append(tree[best], tree[k]))] = tree[k]
        return _edges(cid, out)

    return candidates


def _links(least: float, percent: int):
    """Of a tile of a cluster: confirmed links between components, as many as join them."""

    def link(key: tuple, table: pa.Table) -> pa.Table:
        cid, n, side = table["cid"].to_pylist(), table["n"].to_numpy(), table["side"].to_numpy()
        tree = np.unique(table["component"].to_pylist(), return_inverse=True)[1]
        sketch, out = _words(table["sketch"].combine_chunks()), []
        within = key[1].as_py() == key[2].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        kinds, number = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(kinds), bool)
        for k in range(1, len(cid)):
            others = _earlier(k, side, within)
            others = others[(tree[others] != tree[k]) & (100 * np.minimum(n[others], n[k]) >= percent * np.maximum(n[others], n[k]))]
            others = others[estimated(sketch[others], sketch[k]) >= least]
            if not len(others):
                continue
            # The whole set of this class against the whole sets of all others at once.
            mine = number[at[k] : at[k + 1]]
            mark[mine] = True
            both = np.add.reduceat(mark[number], at[:-1], dtype=np.int64)[others]
            mark[mine] = False
            others = others[100 * both >= percent * (n[others] + n[k] - both)]
            best = others[np.unique(tree[others], return_index=True)[1]]
            out += [(k, j) for j in best.tolist()]
            if len(best):
                tree[np.isin(tree, np.append(tree[best], tree[k]))] = tree[k]
        return _edges(cid, out)

    return link


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str | None = None) -> DataFrame:
    """row_id, doc_id, n_shingles, component_id and ``first`` (the row that stands for its group).

    ``docs`` has doc_id and text; ``key`` names a column of distinct integers that becomes row_id, if the caller has one.
    """
    spark = docs.sparkSession
    attach(spark)
    row_id = F.col(key) if key else F.monotonically_increasing_id()
    docs = docs.select(row_id.alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = signatures(docs, words)
    least = percent / 100 - MARGIN

    reps = signed.where("n > 0").groupBy("cid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row_id")).alias("r")).select("cid", "r.doc_id", "r.row_id")
    classes = signed.select("row_id", "n", "bands", "sketch").join(reps, "row_id")
    rows = written(classes.select("cid", "doc_id", "n", "sketch", "bands"), "classes")
    banded = rows.select(F.explode("bands").alias("key"), "cid")
    # Buckets with the same members say the same; one of them stays.
    shape = banded.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("sum"), F.min("cid").alias("low"), F.max("cid").alias("top")).where("size > 1")
    buckets = shape.groupBy("size", "sum", "low", "top").agg(F.min("key").alias("key")).select("key", "size")
    members = banded.join(buckets.hint("merge"), "key").join(rows.select("cid", "n", "sketch"), "cid")
    tiled = _tiled(members, F.ceil(F.col("size") / TILE)).groupBy("key", "t0", "t1")
    likely = written(tiled.applyInArrow(_forest(least, percent), "a binary, b binary").distinct(), "likely")
    clusters = written(connected_components(likely), "clusters")

    whole = clusters.select(F.col("node").alias("cid"), F.col("component").alias("cluster")).join(rows.select("cid", "doc_id", "n", "sketch"), "cid")
    whole = written(whole, "clustered")
    sets = full_sets(docs, whole.select("cid", "doc_id"), words)
    links = written(confirmed(likely, sets, percent), "links")
    comps = connected_components(links)

    # What the likeliest pairs leave in several components is searched pair by pair.
    now = whole.join(comps.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    mixed = now.groupBy("cluster").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("shingles")).where("lo != hi")
    tiles = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("total") / TILE_SHINGLES))
    apart = now.join(mixed.select("cluster", "size", F.col("shingles").alias("total")), "cluster").join(sets, "cid")
    more = _tiled(apart, tiles).groupBy("cluster", "t0", "t1").applyInArrow(_links(least, percent), "a binary, b binary")
    comps = connected_components(links.unionByName(written(more.distinct(), "links")))

    named = signed.join(comps.select(F.col("node").alias("cid"), "component"), "cid", "left").select("row_id", "doc_id", "n", F.coalesce("component", "cid").alias("label"))
    empty = named.where("label IS NULL").select("row_id", "doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    full = named.where("label IS NOT NULL")
    firsts = full.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row_id")).alias("r")).select("label", "component_id", F.col("r.row_id").alias("first_row"))
    grouped = full.join(firsts, "label").select("row_id", "doc_id", "n", "component_id", (F.col("row_id") == F.col("first_row")).alias("first"))
    return grouped.unionByName(empty).withColumnRenamed("n", "n_shingles")


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with its own columns: the one with the smallest id."""
    names = docs.columns
    rows = written(docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]).withColumn("row_id", F.monotonically_increasing_id()), "neardup")
    at = {c: f"c{k}" for k, c in enumerate(names)}
    found = near_duplicates(rows.select("row_id", F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text")), words, percent, "row_id")
    return rows.join(found.where("first").select("row_id"), "row_id", "left_semi").select(*[F.col(at[c]).alias(c) for c in names])
