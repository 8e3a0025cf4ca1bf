"""Sub-scores and total of a listing, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loftline.functions.quantiles import exact_quantiles
from loftline.spec import DEFAULT_WEIGHTS, ScoringParams, normalised_weights

RISKS = [f"{r}_risk_severity" for r in ("flood", "fire", "wind", "heat", "air")]
SCHOOLS = ("elementary", "middle", "high")
#: Features scored from 1 to 5, with what a missing one counts as.
ORDINALS = {
    "kitchen_quality": 3, "bathroom_quality": 3, "general_interior_quality": 3, "general_exterior_quality": 3, "house_style": 3, "privacy_level": 3,
    "view_rating": 3, "land_usability": 3, "waterfront_quality": 1, "road_exposure": 3, "vegetation_density": 3, "positive_features_score": 3,
}
#: Shown crime rates where there is none; not tied to the scoring parameters.
SHOWN_VIOLENT, SHOWN_PROPERTY = 360.0, 2763.0


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _or(name: str, value: float) -> Column:
    return F.coalesce(_d(name), F.lit(float(value)))


def steps(value: Column, levels: Mapping[int, float], otherwise: float) -> Column:
    """The value of the highest level reached."""
    out = F.lit(None)
    first, *rest = sorted(levels, reverse=True)
    out = F.when(value >= first, F.lit(float(levels[first])))
    for level in rest:
        out = out.when(value >= level, F.lit(float(levels[level])))
    return out.otherwise(F.lit(float(otherwise)))


def price_score(price: Column, floor: Column, ceiling: Column) -> Column:
    """0 at the ceiling, 100 at the floor; a missing price scores 100."""
    held = F.least(F.greatest(price.cast("double"), floor), ceiling)
    return (1.0 - (held - floor) / F.nullif(ceiling - floor, F.lit(0.0))) * 100.0


def school_distance(p: ScoringParams) -> Column:
    return reduce(add, [_or(f"{s}_school_distance_miles", p.school_dist_zero_points_miles) for s in SCHOOLS]) / 3.0


def risk() -> Column:
    return reduce(add, [_or(r, 5) for r in RISKS]) / 5.0


def school_rating() -> Column:
    return reduce(add, [_or(f"{s}_school_rating", 5) for s in SCHOOLS]) / 3.0


def sub_scores(p: ScoringParams) -> dict[str, Column]:
    """Column of each ``<feature>_score``; price needs ``price_floor`` and ``price_ceiling``."""
    size, distance = _d("home_size_sqft"), school_distance(p)
    t1, t2 = p.home_size_tier1_sqft, p.home_size_tier2_sqft
    full, zero = p.school_dist_full_points_miles, p.school_dist_zero_points_miles
    crime = {k: (1.0 - _or(f"{k}_100k", top / 2) / top) * 100.0 for k, top in (("violent", p.max_violent_crime_100k), ("property", p.max_property_crime_100k))}
    usable = steps(F.col("land_usability"), {5: 1.0, 4: 0.85, 3: 0.60, 2: 0.20, 1: 0.0}, 0.35)
    out = {
        "price": price_score(F.col("price"), F.col("price_floor"), F.col("price_ceiling")),
        # A missing number of rooms scores 100, as the least of what is there.
        "beds": F.least(_d("beds"), F.lit(5.0)) / 5.0 * 100.0,
        "baths": F.least(_d("baths"), F.lit(4.0)) / 4.0 * 100.0,
        "home_size_sqft": F.when(size >= t2, F.lit(100.0)).when(size > t1, 80.0 + (size - t1) / (t2 - t1) * 20.0).otherwise(F.coalesce(size, F.lit(0.0)) / t1 * 80.0),
        "lot_size_acres": F.least(_or("lot_size_acres", 0) / p.lot_size_cap_acres, F.lit(1.0)) * 100.0 * usable,
        **{name: (_or(name, missing) - 1.0) * 25.0 for name, missing in ORDINALS.items()},
        "negative_features_severity": steps(F.col("negative_features_severity"), {5: 100, 4: 80, 3: 55, 2: 15, 1: 0}, 55),
        "dedicated_office": F.col("dedicated_office").cast("int") * 100.0,
        "drive_time": (1.0 - _or("drive_time", p.drive_time_max_minutes) / p.drive_time_max_minutes) * 100.0,
        "avg_risk_severity": (1.0 - (risk() - 1.0) / 9.0) * 100.0,
        "avg_school_rating": school_rating() * 10.0,
        "avg_school_distance": F.when(distance <= full, F.lit(100.0)).when(distance >= zero, F.lit(0.0)).otherwise((1.0 - (distance - full) / (zero - full)) * 100.0),
        "violent_crime": crime["violent"],
        "property_crime": crime["property"],
        "avg_crime_severity": (crime["violent"] + crime["property"]) / 2.0,
    }
    return {f"{k}_score": c for k, c in out.items()}


def composites(p: ScoringParams) -> dict[str, Column]:
    """Means and rates that are shown, beside the scores."""
    violent, prop = _d("violent_100k"), _d("property_100k")
    shown_v, shown_p = F.coalesce(violent, F.lit(SHOWN_VIOLENT)), F.coalesce(prop, F.lit(SHOWN_PROPERTY))
    return {
        "avg_risk_severity": risk(),
        "avg_school_rating": school_rating(),
        "avg_school_distance": school_distance(p),
        "violent_100k": shown_v,
        "property_100k": shown_p,
        "violent_100k_raw": violent,
        "property_100k_raw": prop,
        "avg_crime_severity_raw": (2.0 * violent + prop) / 3.0,
        "avg_crime_severity": (2.0 * shown_v + shown_p) / 3.0,
    }


def total_score(weights: Mapping[str, float]) -> Column:
    """Rewards less penalties; null if any addend is.

    Rewards are weights times scores, penalties weights times the lost share (0 to 1).
    """
    gain = [F.col(f"{k}_score") * float(w) for k, w in weights.items() if w > 0]
    loss = [(100.0 - F.col(f"{k}_score")) / 100.0 * float(-w) for k, w in weights.items() if w < 0]
    return (reduce(add, gain) if gain else F.lit(0.0)) - (reduce(add, loss) if loss else F.lit(0.0))


def price_stats(prices: DataFrame, p: ScoringParams) -> tuple[float | None, float | None]:
    """Exact quantiles of the prices that there are: floor and ceiling."""
    floor, ceiling = exact_quantiles(prices, F.col("price"), [p.price_floor_quantile, p.price_ceiling_quantile])
    return floor, ceiling


def scored(listings: DataFrame, weights: Mapping[str, float] | None = None, p: ScoringParams = ScoringParams(), prices: DataFrame | None = None) -> DataFrame:
    """``listings`` with all sub-scores and ``total_score``.

    ``prices`` holds the prices of the same listings, where they can be read without
    the joins that made ``listings``.
    """
    floor, ceiling = price_stats(listings if prices is None else prices, p)
    number = lambda x: F.lit(x).cast("double")
    with_stats = listings.withColumns({"price_floor": number(floor), "price_ceiling": number(ceiling)})
    return with_stats.withColumns(sub_scores(p)).withColumn("total_score", total_score(normalised_weights(weights or DEFAULT_WEIGHTS))).drop("price_floor", "price_ceiling")
