"""Edge rows of the sub-scores, filters and bins, with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from loftline.functions import bins, scoring
from loftline.operators import filters
from loftline.sources.schema import FEATURE_KINDS, SCHEMAS, ensure_columns
from loftline.spec import DEFAULT_WEIGHTS, QuerySpec, ScoringParams, as_count, normalised_weights, weight_parameters

P = ScoringParams()


def listing(spark, **values):
    base = spark.range(1).select(F.lit(1).alias("zpid"), F.lit(None).cast("int").alias("price"))
    df = ensure_columns(ensure_columns(base, SCHEMAS["property_features"]), SCHEMAS["crime"]).withColumn("drive_time", F.lit(None).cast("int"))
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def score(spark, name, **values):
    df = listing(spark, **values).withColumns({"price_floor": F.lit(100.0), "price_ceiling": F.lit(300.0)})
    return df.select(scoring.sub_scores(P)[f"{name}_score"].alias("s")).first()["s"]


@pytest.mark.parametrize(
    ("name", "values", "expected"),
    [
        ("price", {}, 100),
        ("price", {"price": 300}, 0),
        ("beds", {}, 100),
        ("beds", {"beds": 4}, 80),
        ("beds", {"beds": 9}, 100),
        ("baths", {}, 100),
        *[("home_size_sqft", {"home_size_sqft": x}, y) for x, y in ((3000, 100), (2500, 90), (2000, 80), (1000, 40))],
        ("home_size_sqft", {}, 0),
        *[("lot_size_acres", {"lot_size_acres": 8.0, "land_usability": u}, y) for u, y in ((5, 100), (4, 85), (3, 60), (2, 20), (1, 0))],
        ("lot_size_acres", {"lot_size_acres": 8.0}, 35),
        ("lot_size_acres", {"land_usability": 5}, 0),
        ("kitchen_quality", {}, 50),
        ("kitchen_quality", {"kitchen_quality": 5}, 100),
        ("waterfront_quality", {}, 0),
        *[("negative_features_severity", {"negative_features_severity": x}, y) for x, y in ((5, 100), (4, 80), (3, 55), (2, 15), (1, 0))],
        ("negative_features_severity", {}, 55),
        ("dedicated_office", {"dedicated_office": True}, 100),
        ("dedicated_office", {}, None),
        *[("drive_time", {"drive_time": x}, y) for x, y in ((0, 100), (30, 50), (60, 0), (90, -50))],
        ("drive_time", {}, 0),
        ("avg_risk_severity", {r: 1 for r in scoring.RISKS}, 100),
        ("avg_risk_severity", {r: 10 for r in scoring.RISKS}, 0),
        ("avg_risk_severity", {}, 500 / 9),
        ("avg_school_rating", {}, 50),
        ("avg_school_distance", {}, 0),
        ("avg_school_distance", {f"{s}_school_distance_miles": 10.5 for s in scoring.SCHOOLS}, 50),
        ("avg_crime_severity", {}, 50),
        ("avg_crime_severity", {"violent_100k": 1440.0, "property_100k": 5526.0}, -50),
    ],
)
def test_sub_scores(spark, name, values, expected):
    got = score(spark, name, **values)
    assert got is None if expected is None else got == pytest.approx(expected)


def test_equal_quantiles_give_no_price_score(spark):
    got = scoring.scored(listing(spark, price=5)).first()
    assert got["price_score"] is None and got["total_score"] is None


def test_crime_composites(spark):
    got = listing(spark, property_100k=3000.0).withColumns(scoring.composites(P)).first()
    assert got["avg_crime_severity_raw"] is None and got["avg_crime_severity"] == pytest.approx(1240)


def test_weights():
    assert normalised_weights({"a": 3, "b": 1, "c": -2}) == {"a": 0.75, "b": 0.25, "c": -0.5}
    assert normalised_weights({"a": -1}) == {"a": -1}
    assert sum(DEFAULT_WEIGHTS.values()) == 141 and len(DEFAULT_WEIGHTS) == 24
    assert weight_parameters({"beds": 3, "baths": 2.5}) == "weight_beds=3.00&weight_baths=2.50"
    assert len(FEATURE_KINDS) == 38


def test_only_penalties_score_below_zero(spark):
    df = spark.range(1).select(F.lit(40.0).alias("beds_score"))
    assert df.select(scoring.total_score({"beds": -2}).alias("t")).first()["t"] == pytest.approx(-1.2)


def test_requests():
    spec = QuerySpec.from_request({"weight_price": "0", "weight_beds": "x", "weight_baths": "", "ranking_mode": "odd", "optimizer_aggressiveness": 7, "min_score_threshold": "-3.7", "ai_rank_threshold": "-2", "rating_filter": []})
    assert (spec.weights["price"], spec.weights["beds"], spec.weights["baths"]) == (0.0, 3, 2)
    assert (spec.mode, spec.aggressiveness, spec.score_threshold, spec.ai_rank_threshold, spec.ratings) == ("score", 0.9, -3.7, 0, ("yes", "maybe", "blank"))
    assert (as_count("12.9", 5), as_count(None, 5), as_count("nan", 5)) == (12, 5, 5)
    with pytest.raises(ValueError):
        QuerySpec(mode="odd")


def rows(spark, name, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def test_status_filter(spark):
    df = rows(spark, "status", [" Sold ", "Sold for $1", "sold", None])
    assert [r[0] for r in filters.by_status(df, ["Active"]).collect()] == ["sold", None]
    assert filters.by_status(df, []).count() == 4 and filters.by_status(df, ["Odd"]).count() == 0
    assert filters.by_status(df, ["Inactive"]).count() == 2


def test_thresholds(spark):
    df = spark.createDataFrame([("yes", 10.0), ("", 60.0), ("", 40.0), ("", None)], "rating string, total_score double")
    assert {r["total_score"] for r in filters.by_threshold(df, "score", 50).collect()} == {10.0, 60.0}
    assert filters.by_threshold(df, "score", 0).count() == 4


def test_stale_and_inactive_differ(spark):
    df = spark.createDataFrame([("Off the market",), ("Active",), (None,)], "status string").withColumn("last_updated", F.lit(None).cast("timestamp"))
    assert {r["status"] for r in filters.stale_active(df, F.current_timestamp()).collect()} == {"Active", None}
    assert not df.where(filters.says_inactive(F.col("status"))).count()


def test_bins(spark):
    df = rows(spark, "x", [0.5, 1.5, 2.5, 9.0, None], "double")
    icons = [r[0] for r in df.select(bins.icon(F.col("x"), bins.RISK_ICONS)).collect()]
    assert icons == [bins.RISK_ICONS[k] for k in (0, 2, 2, 4)] + ["❓"]
    levels = bins.with_crime_levels(rows(spark, "avg_crime_severity_raw", [float(x) for x in range(0, 101, 10)], "double")).orderBy("avg_crime_severity_raw")
    assert [r["crime_icon_level"] for r in levels.collect()] == [4, 4, 3, 3, 2, 2, 1, 1, 0, 0, 0]
    assert {r["crime_icon_level"] for r in bins.with_crime_levels(rows(spark, "avg_crime_severity_raw", [7.0, 7.0], "double")).collect()} == {2}
    fixed = rows(spark, "x", [1000.0, 1000.1, 4000.0, 4000.1, None], "double").select(bins.crime_level_fixed(F.col("x")).alias("v"))
    assert [r["v"] for r in fixed.collect()] == [4, 3, 1, 0, None]
    hues = bins.with_hue(spark.createDataFrame([("", 5.0), ("yes", 9.0)], "rating string, m double"), "m").collect()
    assert {r["hue"] for r in hues} == {120, None}
