"""The scored listing view, from base tables to records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loftline.functions import bins
from loftline.functions.scoring import composites, scored
from loftline.functions.text import display_city
from loftline.operators import filters, joins, ranks
from loftline.spec import QuerySpec


def threshold_ranges(df: DataFrame) -> DataFrame:
    """One row: least and most of score and AI rank sliders; 0 to 100 and 1 to 100 where there is nothing."""
    return df.agg(
        F.lit(0.0).alias("score_min"),
        F.coalesce(F.max(F.col("total_score").cast("double")), F.lit(100.0)).alias("score_max"),
        F.lit(1).alias("rank_min"),
        F.coalesce(F.max(F.col("ai_rank")), F.lit(100)).alias("rank_max"),
    )


def display_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "display_city": display_city(F.col("full_address")),
            "drive_time_color": bins.drive_time_colour(F.col("drive_time")),
            "school_rating_color": bins.school_colour(F.col("avg_school_rating")),
            "risk_emoji": bins.icon(F.col("avg_risk_severity"), bins.RISK_ICONS),
        }
    )


def listing_view(base: DataFrame, ratings: DataFrame, notes: DataFrame, spec: QuerySpec, allowed: bool = True) -> tuple[DataFrame, DataFrame]:
    """The view's rows in order, and its slider ranges.

    The order of steps matters: prices are ranged before any filter, crime levels
    after the financing and place filters, slider ranges before the threshold.
    """
    view = scored(base, spec.weights, spec.params)
    view = filters.by_financing(view, spec.financing).withColumns(composites(spec.params))
    view = filters.located(view) if spec.geo_only else view
    view = bins.with_crime_levels(display_columns(joins.with_user_data(view, ratings, notes, allowed)))
    view = view.withColumn("crime_emoji", bins.icon(F.col("crime_icon_level"), bins.CRIME_ICONS))
    view = filters.by_status(filters.by_rating(view, spec.ratings), spec.statuses)
    ranges = threshold_ranges(view)
    threshold = spec.ai_rank_threshold if spec.mode == "ai" else spec.score_threshold
    view = filters.by_threshold(view, spec.mode, threshold)
    return (ranks.by_ai_rank(view) if spec.mode == "ai" else ranks.by_score(view)), ranges


def map_centre(df: DataFrame) -> DataFrame:
    """One row: centre and bounds of the places; null and 0 coordinates don't count, bounds of several are padded by a tenth."""
    ok = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (F.col("latitude") != 0) & (F.col("longitude") != 0)
    one = df.where(ok).agg(
        *[f(c).alias(f"{n}_{c[:3]}") for c in ("latitude", "longitude") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))], F.count("*").alias("n_points")
    )
    pad = lambda c: F.when(F.col("n_points") > 1, (F.col(f"max_{c}") - F.col(f"min_{c}")) * 0.1).otherwise(0.0)
    return one.select(
        "n_points", F.col("avg_lat").alias("center_lat"), F.col("avg_lon").alias("center_lon"),
        (F.col("min_lat") - pad("lat")).alias("south"), (F.col("max_lat") + pad("lat")).alias("north"),
        (F.col("min_lon") - pad("lon")).alias("west"), (F.col("max_lon") + pad("lon")).alias("east"),
    )
