"""The ranking job with the options of its command line."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loftline.operators import ranks
from loftline.plans.tournament import Judge, judged_columns, refreshed
from loftline.sources import tables
from loftline.sources.schema import SCHEMAS


@dataclass(frozen=True)
class RankingOptions:
    batch_size: int = 30
    passes: int = 2
    no_filter: bool = False
    dry_run: bool = False
    full: bool = False
    table: str = "ai_rankings"

    def __post_init__(self) -> None:
        if self.batch_size < 1 or self.passes < 1:
            raise ValueError("batches hold a row at least, and there is a pass at least")

    @classmethod
    def parsed(cls, arguments: Sequence[str]) -> RankingOptions:
        """From a command line."""
        own = cls()
        parser = argparse.ArgumentParser(description="Rank listings by a judge of small batches")
        parser.add_argument("--batch-size", type=int, default=own.batch_size, help="listings a batch")
        parser.add_argument("--passes", type=int, default=own.passes, help="tournament passes")
        parser.add_argument("--no-filter", action="store_true", help="keep the bottom third by the quick score")
        parser.add_argument("--dry-run", action="store_true", help="rank without saving")
        parser.add_argument("--full", action="store_true", help="rank everything anew")
        parser.add_argument("--table", default=own.table, help="table of the ranks")
        return cls(**vars(parser.parse_args(list(arguments))))


def rank_listings(listings: DataFrame, ranked: DataFrame, judge: Judge, options: RankingOptions = RankingOptions()) -> DataFrame:
    """zpid and rank of what the quick cut leaves: anew, or by insertion into the ranks that there are."""
    field = listings if options.no_filter else ranks.quick_cut(judged_columns(listings, judge, *ranks.QUICK_READS))
    return refreshed(field, ranked, judge, options.full, batch_size=options.batch_size, passes=options.passes)


def run_ranking(spark: SparkSession, listings: DataFrame, judge: Judge, arguments: Sequence[str] = ()) -> DataFrame:
    """The job as its command line asks for it; the ranks are saved with the time unless it is a dry run."""
    options = RankingOptions.parsed(arguments)
    known = tables.optional_table(spark, options.table, SCHEMAS["ai_rankings"]).select("zpid", F.col("ai_rank").alias("rank"))
    found = rank_listings(listings, known, judge, options)
    if not options.dry_run:
        tables.replace_table(found.withColumnRenamed("rank", "ai_rank"), options.table, "ranked_at")
    return found
