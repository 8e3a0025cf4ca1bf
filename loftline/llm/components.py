"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loftline.llm.store import discard, written


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, with their number and a sum of hashes, seen as they are written."""
    seen = Observation()
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
    return out, (seen.get["n"], seen.get["sum"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for the nodes of undirected ``edges`` (a, b).

    Each round ties every node to the least of its neighbours; the rounds grow
    with the logarithm of the longest path.  Tables are written between rounds.
    """
    now, mark = _kept(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        before, (new, mark) = mark, _kept(tied.unionByName(lower.select("a", F.col("m").alias("b"))).distinct())
        discard(now)
        now = new
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
