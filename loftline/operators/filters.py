"""Row filters of a listing view."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses of listings that aren't active.
INACTIVE = (
    "Active w/contingency", "Auction", "Bumpablebuyer", "Closed", "Contingent", "House for rent", "Off market", "Pending",
    "Pending inspection", "Pending short sale", "Sold", "Under contract",
)


def by_financing(df: DataFrame, wanted: Sequence[str], column: str = "financing_eligibility") -> DataFrame:
    """Keep eligible, not_eligible or unknown rows; other tokens are ignored, and without a known one all stay."""
    c = F.col(column)
    tests = {"eligible": c, "not_eligible": ~c, "unknown": c.isNull()}
    chosen = [F.coalesce(tests[w], F.lit(False)) for w in wanted if w in tests]
    return df.where(reduce(or_, chosen)) if chosen else df


def is_inactive(status: Column) -> Column:
    clean = F.coalesce(F.trim(status), F.lit(""))
    return clean.isin(*INACTIVE) | clean.startswith("Sold for ")


def by_status(df: DataFrame, wanted: Sequence[str], column: str = "status") -> DataFrame:
    """Keep Active or Inactive listings; nothing wanted keeps all, an unknown token adds none."""
    if not wanted:
        return df
    gone = is_inactive(F.col(column))
    tests = {"Active": ~gone, "Inactive": gone}
    return df.where(reduce(or_, [tests[w] for w in wanted if w in tests], F.lit(False)))


def by_rating(df: DataFrame, wanted: Sequence[str], column: str = "rating") -> DataFrame:
    """Keep ratings in ``wanted``; 'blank' stands for none."""
    return df.where(F.coalesce(F.col(column), F.lit("")).isin(*["" if w == "blank" else w for w in wanted]))


def by_threshold(df: DataFrame, mode: str, threshold: float) -> DataFrame:
    """Keep the best: by AI rank, or by score, where rated rows always stay."""
    if threshold <= 0:
        return df
    if mode == "ai":
        return df.where(F.col("ai_rank") <= threshold)
    return df.where((F.coalesce(F.col("rating"), F.lit("")) != "") | F.coalesce(F.col("total_score") >= threshold, F.lit(False)))


def located(df: DataFrame) -> DataFrame:
    return df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def stale_active(df: DataFrame, before: Column) -> DataFrame:
    """Seemingly active listings not updated since ``before``, longest ago first."""
    loud = F.upper(F.col("status"))
    gone = loud.like("%SOLD%") | loud.like("%OFF%MARKET%") | loud.like("%PENDING%")
    old = F.col("last_updated").isNull() | (F.col("last_updated") < before)
    return df.where(~F.coalesce(gone, F.lit(False)) & old).orderBy(F.asc_nulls_first("last_updated"))


def says_inactive(status: Column) -> Column:
    return F.coalesce(F.lower(status).rlike("sold|off market|pending"), F.lit(False))


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """Rows of one key; the test reaches the Parquet scan."""
    return df.where(F.col(key) == F.lit(value))


def statuses(df: DataFrame, column: str = "status") -> DataFrame:
    """Distinct statuses that aren't blank, in order."""
    return df.where(F.trim(column) != "").select(column).distinct().orderBy(column)
