"""Tournament ranking in batches, and insertion into an existing ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loftline.operators import ranks
from loftline.sources.lineage import stored

#: Adds ``batch_rank`` to rows with a ``batch``; all else stays.  A judge may name the columns that it reads in ``reads``; other judges get all.
Judge = Callable[[DataFrame], DataFrame]


def score_judge(score: str) -> Judge:
    def judge(df: DataFrame) -> DataFrame:
        return ranks.judge_by_score(df, score)

    judge.reads = (score,)
    return judge


def judged_columns(df: DataFrame, judge: Judge, *more: str) -> DataFrame:
    """What a tournament has to carry through its exchanges: the key, what the judge reads and ``more``."""
    reads = getattr(judge, "reads", None)
    return df if reads is None else df.select(*dict.fromkeys(("zpid", *reads, *more)))


def tournament(df: DataFrame, judge: Judge, batch_size: int = 30, passes: int = 2, seed: str = "s") -> DataFrame:
    """zpid and rank after ``passes``: the first in hash order, later ones dealt by the ranks so far.

    Every row is ranked in every pass; the final order is by the sum of ranks, ties
    in hash order.
    """
    df = judged_columns(df, judge)
    rows = ranks.shuffled(df, "zpid", seed, "start").withColumn("sum_rank", F.lit(0).cast("long"))
    n_batches = max(1, -(-rows.count() // batch_size))
    for k in range(passes):
        if k:
            seated = ranks.round_robin(ranks.ordinal(rows, "sum_rank", ["start"], "pos"), n_batches)
        else:
            seated = ranks.batches(rows.withColumn("pos", F.col("start")), batch_size)
        ranked = ranks.tier_ranks(judge(seated), f"{seed}{k + 1}")
        rows = ranked.select(*df.columns, "start", (F.col("sum_rank") + F.col("rank")).alias("sum_rank"))
    return ranks.ordinal(rows.select("zpid", "start", "sum_rank"), "sum_rank", ["start"], "rank").select("zpid", "rank")


def incremental(ranked: DataFrame, new: DataFrame, judge: Judge, attributes: DataFrame, n_refs: int = 30, batch_size: int = 30, passes: int = 2, seed: str = "s") -> DataFrame:
    """Insert new rows by a tournament among them and references spaced along the ranking."""
    refs = stored(ranks.spaced_sample(ranked, n_refs))
    field = judged_columns(attributes, judge).join(refs.select("zpid").unionByName(new.select("zpid")), "zpid", "left_semi")
    mini = stored(tournament(stored(field), judge, batch_size, passes, seed).withColumnRenamed("rank", "mini"))
    marks = mini.join(refs.select("zpid", F.col("rank").alias("global_rank")), "zpid").select("mini", "global_rank")
    placed = ranks.mapped_ranks(mini.join(new.select("zpid"), "zpid", "left_semi"), marks, ranked.count())
    return ranks.merged_ranks(ranked, stored(placed.select("zpid", "rank")))


def refreshed(listings: DataFrame, ranked: DataFrame, judge: Judge, full: bool = False, **options: object) -> DataFrame:
    """Rank what there is: all of it, only what is new, or just close the gaps."""
    kept = ranked.join(listings.select("zpid"), "zpid", "left_semi")
    new = listings.join(ranked, "zpid", "left_anti")
    if full or not kept.take(1):
        return tournament(listings, judge, **options)
    kept = stored(ranks.compacted(ranked, listings))
    return incremental(kept, new, judge, listings, **options) if new.take(1) else kept


def rank_report(ranked: DataFrame) -> DataFrame:
    """One row: span of the ranks and their number."""
    return ranked.agg(F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"), F.count("*").alias("n_ranked"))
