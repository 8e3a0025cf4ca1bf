"""Centroid clustering of integer vectors, exact, with a float32 screen (operator 13).

Components are turned into integers, floor(scale * x).  Each round assigns every
vector to its nearest centroid by squared distance and replaces a centroid by its
vectors' componentwise floor(sum / count); what is reported comes from one more
assignment.

A block of vectors meets all centroids in one float32 matrix product.  Its result
is off by at most gamma * |x| |c|, whatever the order of summation, so every
centroid gets an interval that surely holds its score.  Centroids whose interval
begins beyond another's end are out.  Vectors that one centroid is left for are
decided; for the others the distances to what is left are recomputed in integers,
and the smallest number wins a tie.  Products that overflow float32 leave every
centroid in.

Only the centroids, of fixed size, pass through the driver.  Sums are exact at any
size: tasks send them in limbs, one row for each centroid and component.

Defined results: vectors null, of another length, or with a component null, not
finite or beyond double once scaled take no part.  Rows that repeat an id are
vectors of their own; a null id never starts a centroid.  With fewer vectors than
centroids there are as many centroids as vectors; without any, no rows.  A
distance or inertia that doesn't fit a long is null.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loftline.llm.store import attach, lean, written

COMPONENTS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
#: Up to here, squared differences of as many components sum within 63 bits.
_NARROW = 1 << 27
_LIMB = 40
_UNIT = 2.0**-24


def kept_vectors(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """The rows (vec_id, embedding) that take part."""
    limit = F.lit(float("inf"))
    fine = (F.size("embedding") == components) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < limit))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("embedding").isNotNull() & fine)


def _scaled(lists: pa.Array, components: int, scale: int) -> np.ndarray:
    """Integer-valued doubles; a power of two as ``scale`` keeps them exact."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).reshape(-1, components)


def _exact(values: np.ndarray) -> np.ndarray:
    """As 64-bit integers where their squares fit, else as Python's."""
    if not values.size or np.abs(values).max() <= _NARROW:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values.tolist()], object).reshape(values.shape)


class Screen:
    """Nearest centroids of blocks of vectors."""

    def __init__(self, centroids: list[list[int]]) -> None:
        wide = any(abs(x) > _NARROW for c in centroids for x in c)
        self.exact = np.array(centroids, object if wide else np.int64)
        squares = [sum(x * x for x in c) for c in centroids]
        self.squares = np.array([float(s) if s < 1 << 1000 else np.inf for s in squares])
        self.norms = np.sqrt(self.squares) * (1 + 2.0**-40)
        with np.errstate(over="ignore"):
            self.single = self.exact.astype(np.float64).astype(np.float32)
        n = self.exact.shape[1] + 2
        # Inputs are rounded once each, then n products are summed in any order.
        self.gamma = n * _UNIT / (1 - n * _UNIT)

    def shortlist(self, values: np.ndarray) -> np.ndarray:
        """Which centroids may be the nearest, by rigorous intervals around float32 scores |c|^2 - 2 x.c."""
        with np.errstate(over="ignore", invalid="ignore"):
            product = (values.astype(np.float32) @ self.single.T).astype(np.float64)
            reach = np.sqrt(np.einsum("ij,ij->i", values, values))[:, None] * (1 + 2.0**-40) * self.norms
            score = self.squares - 2 * product
            slack = 2 * self.gamma * (1 + 2.0**-20) * reach + 2.0**-48 * (self.squares + 2 * reach)
            slack[~np.isfinite(product)] = np.inf
            # Comparisons with what isn't a number are false, so such centroids stay.
            return ~(score - slack > (score + slack).min(axis=1, keepdims=True))

    def nearest(self, values: np.ndarray) -> tuple[np.ndarray, int]:
        """Centroid of each vector, and how many vectors had to be recomputed."""
        left = self.shortlist(values)
        out = left.argmax(axis=1)
        open_rows = np.flatnonzero(left.sum(axis=1) > 1)
        if len(open_rows):
            row, centroid = np.nonzero(left[open_rows])
            apart = self.distances(values[open_rows][row], centroid)
            table = np.full((len(open_rows), left.shape[1]), None if apart.dtype == object else np.iinfo(np.int64).max, apart.dtype)
            table[row, centroid] = apart
            if apart.dtype == object:
                table[table == None] = max(apart) + 1  # noqa: E711
            out[open_rows] = [min(range(len(x)), key=x.__getitem__) for x in table.tolist()] if apart.dtype == object else table.argmin(axis=1)
        return out, len(open_rows)

    def distances(self, values: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        """Exact squared distances of vectors to the given centroids."""
        exact = _exact(values)
        if exact.dtype == object or self.exact.dtype == object:
            exact, centres = exact.astype(object), self.exact.astype(object)[centroid]
            return ((exact - centres) ** 2).sum(axis=1) if len(exact) else np.zeros(0, object)
        gap = exact - self.exact[centroid]
        return np.einsum("ij,ij->i", gap, gap)


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """Digits of a sum to the base 2**40, all of its sign."""
    sign, rest, k = (-1, -total, 0) if total < 0 else (1, total, 0)
    while rest:
        yield k, sign * (rest & ((1 << _LIMB) - 1))
        rest, k = rest >> _LIMB, k + 1


def _moved(kept: DataFrame, centroids: list[list[int]], components: int, scale: int) -> list[list[int]]:
    """Centroids after one round."""
    screen = Screen(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), components + 1), object)
        for batch in batches:
            values = _scaled(batch.column("embedding"), components, scale)
            cluster, _ = screen.nearest(values)
            exact = _exact(values)
            for k in np.unique(cluster).tolist():
                mine = cluster == k
                total[k, :-1] += exact[mine].sum(axis=0).astype(object)
                total[k, -1] += int(mine.sum())
        rows = [(k, i, limb, x) for k, row in enumerate(total.tolist()) for i, t in enumerate(row) for limb, x in _limbs(int(t))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "component", "limb", "part"])

    parts = kept.select("embedding").mapInArrow(lean(sums), "cluster int, component int, limb int, part long")
    found = {(k, i): 0 for k in range(len(centroids)) for i in range(components + 1)}
    for k, i, limb, part in parts.groupBy("cluster", "component", "limb").agg(F.sum(F.col("part").cast("decimal(20,0)"))).collect():
        found[k, i] += int(part) << (_LIMB * limb)
    return [[found[k, i] // found[k, components] for i in range(components)] if found[k, components] else c for k, c in enumerate(centroids)]


def fit(kept: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> list[list[int]]:
    """Centroids after ``rounds``, begun from the ``k`` vectors whose ids hash lowest."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id IS NOT NULL").select(mark.alias("mark"), "embedding").orderBy("mark", "embedding").limit(k).collect()
    centroids = [[int(np.floor(float(x) * scale)) for x in r["embedding"]] for r in first]
    for _ in range(rounds if centroids else 0):
        centroids = _moved(kept, centroids, components, scale)
    return centroids


def assign(kept: DataFrame, centroids: list[list[int]], components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, and whether integers had to decide (``recomputed``) for every vector."""
    screen = Screen(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _scaled(batch.column("embedding"), components, scale)
            cluster, _ = screen.nearest(values)
            apart = screen.distances(values, cluster)
            if apart.dtype == object:
                apart = pa.array([x if x < 1 << 63 else None for x in apart.tolist()], pa.int64())
            again = screen.shortlist(values).sum(axis=1) > 1
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(apart, pa.int64()), pa.array(again)], ["vec_id", "cluster", "distance", "recomputed"])

    return kept.mapInArrow(lean(place), "vec_id long, cluster int, distance long, recomputed boolean")


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and recomputed of every vector that takes part."""
    spark = vectors.sparkSession
    attach(spark)
    kept = written(kept_vectors(vectors, components, scale), "vectors")
    centroids = fit(kept, k, rounds, components, scale, seed)
    if not centroids:
        return kept.where("false").selectExpr("vec_id", "CAST(0 AS int) AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256", "false AS recomputed")
    placed = written(assign(kept, centroids, components, scale), "assigned")
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(20,0)")))
    sums = placed.groupBy("cluster").agg(total.alias("d")).collect()  # a row for each centroid
    fits = lambda d: None if d is None or d >= 1 << 63 else int(d)
    whole = None if any(r["d"] is None for r in sums) else sum(r["d"] for r in sums)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    model = spark.createDataFrame([(r["cluster"], fits(r["d"]), fits(whole), digests[r["cluster"]]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(model), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "recomputed")
