"""Table schemas, built from one description of the features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "integer": T.IntegerType(), "number": T.FloatType(), "boolean": T.BooleanType()}

#: The features of a listing and their kinds, in the order of their table's columns.
FEATURE_KINDS = {
    "full_address": "string",
    "city": "string",
    "county": "string",
    "beds": "integer",
    "baths": "number",
    "home_size_sqft": "integer",
    "lot_size_acres": "number",
    "financing_eligibility": "boolean",
    "financing_eligibility_explanation": "string",
    "elementary_school_distance_miles": "number",
    "elementary_school_rating": "integer",
    "middle_school_distance_miles": "number",
    "middle_school_rating": "integer",
    "high_school_distance_miles": "number",
    "high_school_rating": "integer",
    "privacy_level": "integer",
    "view_rating": "integer",
    "view_type": "string",
    "waterfront_quality": "integer",
    "land_usability": "integer",
    "vegetation_density": "integer",
    "road_exposure": "integer",
    "negative_features_severity": "integer",
    "negative_features_list": "string",
    "positive_features_score": "integer",
    "positive_features_list": "string",
    "flood_risk_severity": "integer",
    "fire_risk_severity": "integer",
    "wind_risk_severity": "integer",
    "heat_risk_severity": "integer",
    "air_risk_severity": "integer",
    "dedicated_office": "boolean",
    "kitchen_quality": "integer",
    "bathroom_quality": "integer",
    "general_interior_quality": "integer",
    "general_exterior_quality": "integer",
    "house_style": "integer",
    "general_assessment": "string",
}


def struct_of(kinds: dict[str, str], key: str | None = None) -> T.StructType:
    """A schema from a name-to-kind mapping; unknown kinds are text."""
    head = [T.StructField(key, T.IntegerType(), False)] if key else []
    return T.StructType(head + [T.StructField(n, _KINDS.get(k, T.StringType())) for n, k in kinds.items()])


_TYPES = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "timestamp": T.TimestampType()}


def _struct(fields: str) -> T.StructType:
    """A schema from 'name type, ...'; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in map(str.split, fields.split(", "))])


SCHEMAS = {
    "properties": _struct("zpid int, source_url string, price int, status string, last_updated timestamp"),
    "property_features": struct_of(FEATURE_KINDS, "zpid"),
    "crime": _struct("zpid int, violent_100k double, property_100k double"),
    "grocery": _struct("zpid int, name string, drive_time int, address string, rating double, user_ratings_total int"),
    "location": _struct("zpid int, latitude double, longitude double"),
    "ai_rankings": _struct("zpid int, ai_rank int, ranked_at timestamp"),
    "manual_inspection": _struct("zpid int, listing_url string, reason string, time timestamp"),
    "rating": _struct("zpid int, rating string, updated_at timestamp"),
    "notes": _struct("zpid int, note string, updated_at timestamp"),
    "for_review": _struct("zpid int, zillow_url string, added_at timestamp"),
}


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks, as nulls; others stay."""
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in have])
