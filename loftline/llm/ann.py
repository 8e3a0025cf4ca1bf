"""Approximate nearest neighbours by multi-index hashing (operator 8).

Vectors become binary codes by a learned rotation (iterative quantisation,
fitted on a bounded sample).  A code is split into byte-long substrings, each
indexed on its own.  Two codes within Hamming radius r agree in some substring
to within r // substrings bits, so probing the buckets that near retrieves every
code within r.  What is retrieved is ranked by the cosine of the original
vectors in double precision.  The radius is chosen from the sample, so that it
holds ``RECALL`` of the true neighbours there.

All rows are indexed once, in shards of bounded size: a shard is one row of a
written table, with its codes, the order of its buckets and its vectors.  Queries
are packed into blocks of bounded size likewise.  Each shard meets each block in a
group of its own, so nothing passes through the driver, and a group's size depends
on neither table; ``k`` results a query come back from it.

Defined results: every row of ``queries`` is a query, rows that repeat an id too.
Vectors that are null, zero, of another length than most or
hold a null, NaN or infinite component take no part.  Rows with the query's own
``vec_id`` are never its neighbours.  Ties go to the smaller ``vec_id``.  A query
with fewer candidates than ``k`` gets them all.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loftline.llm.kernels import ragged
from loftline.llm.store import attach, written

SUBSTRING_BITS = 8
SAMPLE = 4096
RECALL = 0.985
#: Rows of a shard, and queries of a block.
SHARD_ROWS, QUERY_BLOCK = 8192, 4096
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass
class CodeModel:
    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A row of bytes for each vector."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.packbits((unit - self.mean) @ self.rotation > 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _POPCOUNT[a ^ b].sum(-1, dtype=np.int32)


def fit_codes(x: np.ndarray, k: int = 5, recall: float = RECALL, rounds: int = 30, seed: int = 7) -> CodeModel:
    """Learn the rotation and the radius from a sample of vectors."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    bits = -(-dim // SUBSTRING_BITS) * SUBSTRING_BITS
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = unit.mean(0)
    centred = unit - mean
    axes = np.linalg.svd(centred, full_matrices=False)[2][: min(dim, len(x))]
    spread = np.zeros((dim, bits))
    spread[:, : len(axes)] = axes.T
    spread[:, len(axes) :] = rng.normal(size=(dim, bits - len(axes))) / np.sqrt(dim)
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    flat = centred @ spread
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(flat @ turn).T @ flat)
        turn = (u @ vt).T
    model = CodeModel(mean, spread @ turn, bits)
    codes, probe = model.codes(x), rng.permutation(len(x))[:256]
    far = []
    for q in probe:
        near = unit @ unit[q]
        near[q] = -np.inf
        far.append(hamming(codes[np.argsort(-near)[: min(k, len(x) - 1)]], codes[q]))
    model.radius = int(np.quantile(np.concatenate(far), recall)) if len(x) > 1 else bits
    return model


class Substrings:
    """For each substring of the codes, the rows in each of its buckets.

    ``order`` are the rows by each substring, where they have been sorted before.
    """

    def __init__(self, codes: np.ndarray, radius: int, order: np.ndarray | None = None) -> None:
        self.codes, self.radius = codes, radius
        self.order = np.argsort(codes.T, axis=1, kind="stable") if order is None else order
        self.edges = [np.searchsorted(c[o], np.arange(257)) for c, o in zip(codes.T, self.order)]
        slack = radius // codes.shape[1]
        self.near = [np.flatnonzero(_POPCOUNT[np.arange(256) ^ v] <= slack) for v in range(256)]

    def within(self, code: np.ndarray) -> np.ndarray:
        """Every row whose code is within the radius, in ascending order."""
        seen = np.zeros(len(self.codes), bool)
        for order, edges, v in zip(self.order, self.edges, code.tolist()):
            buckets = self.near[v]
            seen[ragged(order, edges[buckets], edges[buckets + 1] - edges[buckets])] = True
        rows = np.flatnonzero(seen)
        return rows[hamming(self.codes[rows], code) <= self.radius]


def usable(vector: Column) -> Column:
    """Neither null nor zero, with finite components only."""
    wide = vector.cast("array<double>")
    finite = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite & F.exists(wide, lambda c: c != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(column), -1)


_INDEX = "shard int, ids binary, vectors binary, codes binary, buckets binary"
_ASKED = "block int, keys binary, ids binary, vectors binary"
_FOUND = "key long, query_id long, vec_id long, score double"


def _one_row(schema: str, *values: object) -> pa.Table:
    names = [f.split()[0] for f in schema.split(", ")]
    return pa.table([pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], pa.binary() if isinstance(v, np.ndarray) else pa.int32()) for v in values], names)


def _read(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(table[column][0].as_buffer(), kind)


def _search(index: pa.Table, asked: pa.Table, model: CodeModel, dim: int, k: int) -> pa.Table:
    """The ``k`` nearest rows of a shard to each query of a block."""
    own, x = _read(index, "ids", "<i8"), _read(index, "vectors", "<f8").reshape(-1, dim)
    codes = _read(index, "codes", "u1").reshape(len(x), -1)
    buckets = Substrings(codes, model.radius, _read(index, "buckets", "<i4").reshape(-1, len(x)))
    keys, ids, q = _read(asked, "keys", "<i8"), _read(asked, "ids", "<i8"), _read(asked, "vectors", "<f8").reshape(-1, dim)
    norm, size, probes = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1), model.codes(q)
    out = []
    for j in range(len(ids)):
        rows = buckets.within(probes[j])
        rows = rows[own[rows] != ids[j]]
        if len(rows) < k:
            rows = np.flatnonzero(own != ids[j])
        # Row by row in one order, so that equal vectors score exactly the same.
        score = (x[rows] * q[j]).sum(1) / (norm[rows] * size[j])
        if len(rows) > 4 * k:
            tight = score >= np.partition(score, -k)[-k]
            rows, score = rows[tight], score[tight]
        first = np.lexsort((own[rows], -score))[:k]
        out.append((np.full(len(first), keys[j]), np.full(len(first), ids[j]), own[rows[first]], score[first]))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], [f.split()[0] for f in _FOUND.split(", ")])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` nearest of ``vectors`` to each of ``queries`` (both vec_id, embedding)."""
    spark = vectors.sparkSession
    attach(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    number = F.monotonically_increasing_id()
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), number.alias("key")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    base, asked = clean(vectors), clean(queries)
    lengths = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return empty
    dim, total = lengths[0]["dim"], lengths[0]["count"]
    base, asked = base.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    n_asked = asked.count()
    if not n_asked:
        return empty
    limit = int(min(1.0, sample / total) * (1 << 30))
    drawn = base.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) <= limit).select("v").limit(2 * sample)
    model = spark.sparkContext.broadcast(fit_codes(np.array([r["v"] for r in drawn.collect()] or [[1.0] * dim]), k))
    shards, blocks = -(-total // shard_rows), -(-n_asked // query_block)

    def index(key: tuple, table: pa.Table) -> pa.Table:
        x = _matrix(table["v"])
        codes = model.value.codes(x)
        return _one_row(_INDEX, key[0].as_py(), table["vec_id"].to_numpy(), x, codes, np.argsort(codes.T, axis=1, kind="stable").astype("<i4"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        return _one_row(_ASKED, key[0].as_py(), table["key"].to_numpy(), table["vec_id"].to_numpy(), _matrix(table["v"]))

    dealt = lambda n: F.pmod(F.xxhash64("key", F.lit(1)), F.lit(n)).cast("int")
    indexed = written(base.withColumn("shard", dealt(shards)).groupBy("shard").applyInArrow(index, _INDEX), "ann-index")
    packed = written(asked.withColumn("block", dealt(blocks)).groupBy("block").applyInArrow(pack, _ASKED), "ann-queries")
    left = indexed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("shard", "block")
    right = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).groupBy("shard", "block")

    def search(some: pa.Table, them: pa.Table) -> pa.Table:
        if not some.num_rows or not them.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], [f.split()[0] for f in _FOUND.split(", ")])
        return _search(some, them, model.value, dim, k)

    found = left.cogroup(right).applyInArrow(search, _FOUND)
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
