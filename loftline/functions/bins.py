"""Bins, colours and icons of listing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GREY = "#999999"
#: From best to worst.
PALETTE = ("#006400", "#228B22", "#000000", "#FF8C00", "#DC143C")
RISK_ICONS = ("😇", "😊", "😐", "😰", "💀")
CRIME_ICONS = ("😱", "😬", "😐", "😊", "😇")
MARKERS = {"yes": "#48bb78", "maybe": "#ed8936", "no": "#f56565"}
NO_MARKER = "#cbd5e0"


def _chain(value: Column, tests: Sequence[tuple[Column, object]], last: object) -> Column:
    out = F.when(value.isNull(), F.lit(None))
    for test, result in tests:
        out = out.when(test, F.lit(result))
    return out.otherwise(F.lit(last))


def drive_time_colour(minutes: Column) -> Column:
    tests = [(minutes < cut, colour) for cut, colour in zip((5, 10, 20, 40), PALETTE)]
    return F.coalesce(_chain(minutes, tests, PALETTE[-1]), F.lit(GREY))


def school_colour(rating: Column) -> Column:
    tests = [(rating >= cut, colour) for cut, colour in zip((8.5, 7.0, 5.5, 4.0), PALETTE)]
    return F.coalesce(_chain(rating, tests, PALETTE[-1]), F.lit(GREY))


def icon(level: Column, icons: Sequence[str]) -> Column:
    """The icon of a level, rounded half to even and held to the scale."""
    at = F.least(F.greatest(F.bround(level.cast("double"), 0), F.lit(0.0)), F.lit(float(len(icons) - 1))).cast("int")
    return F.when(level.isNull(), F.lit("❓")).otherwise(F.element_at(F.array(*[F.lit(i) for i in icons]), at + 1))


def crime_level_by_range(rate: Column, low: Column, high: Column) -> Column:
    """4 for the least crime in the data to 0 for the most; 2 where all are equal."""
    share = (rate - low) / F.nullif(high - low, F.lit(0.0)) * 5.0
    return F.when(rate.isNull(), F.lit(None)).when(high == low, F.lit(2)).otherwise(4 - F.least(F.lit(4), F.floor(share).cast("int")))


def crime_level_fixed(rate: Column) -> Column:
    return _chain(rate, [(rate <= cut, level) for cut, level in ((1000, 4), (2000, 3), (3000, 2), (4000, 1))], 0)


def with_crime_levels(df: DataFrame, rate: str = "avg_crime_severity_raw") -> DataFrame:
    """Add ``crime_icon_level`` by the range of ``rate`` over all of ``df``."""
    ends = df.agg(F.min(rate).alias("_lo"), F.max(rate).alias("_hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn("crime_icon_level", crime_level_by_range(F.col(rate), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def marker_colour(rating: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair])
    return F.coalesce(table[rating], F.lit(NO_MARKER))


def with_hue(df: DataFrame, metric: str, inverted: bool = False) -> DataFrame:
    """Add ``hue`` (0 to 120) of unrated rows by the range of their metric; null where none applies."""
    blank = F.coalesce(F.col("rating"), F.lit("")) == ""
    value = F.when(blank, F.col(metric).cast("double"))
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    share = F.least(F.greatest((value - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    share = 1.0 - share if inverted else share
    hue = F.when(value.isNull(), F.lit(None)).when(F.col("_hi") <= F.col("_lo"), F.lit(120)).otherwise(F.floor(share * 120.0 + 0.5).cast("int"))
    return df.crossJoin(F.broadcast(ends)).withColumn("hue", hue).drop("_lo", "_hi")


def rank_sort_key(rank: Column) -> Column:
    return F.coalesce(rank, F.lit(99999))
