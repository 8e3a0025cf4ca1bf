"""Enrichment jobs: crime rates by place, nearest store, page fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loftline.functions import text
from loftline.operators import joins


def city_rates(city_sheet: DataFrame) -> DataFrame:
    """Crime per 100,000 of each city; sheet columns as normalised headers."""
    s = text.normalised_columns(city_sheet).where(F.col("city").isNotNull())
    return s.select(
        text.state(F.col("state")).alias("state"), text.city(F.col("city")).alias("city"),
        text.rate_per_100k(F.col("violent crime"), F.col("population")).alias("violent_100k"),
        text.rate_per_100k(F.col("property crime"), F.col("population")).alias("property_100k"),
    ).distinct()


def county_population(*sheets: DataFrame) -> DataFrame:
    """Population by county and state of one sheet per state (county_state, population)."""
    every = sheets[0].select("county_state", "population")
    for s in sheets[1:]:
        every = every.unionByName(s.select("county_state", "population"))
    name, place = text.county_and_state(F.col("county_state"))
    out = every.select(text.county(name).alias("county"), text.state(place).alias("state"), text.number(F.col("population")).alias("population"))
    return out.na.drop()


def county_rates(county_sheet: DataFrame, population: DataFrame) -> DataFrame:
    s = text.normalised_columns(county_sheet).where(F.col("county").isNotNull())
    s = s.select(text.state(F.col("state")).alias("state"), text.county(F.col("county")).alias("county"), F.col("violent crime").alias("v"), F.col("property crime").alias("p"))
    both = s.join(population, ["county", "state"])
    return both.select("state", "county", text.rate_per_100k(F.col("v"), F.col("population")).alias("violent_100k"), text.rate_per_100k(F.col("p"), F.col("population")).alias("property_100k")).distinct()


def with_fallback(places: DataFrame, first: DataFrame, first_keys: list[str], second: DataFrame, second_keys: list[str], metrics: list[str]) -> DataFrame:
    """Each metric from the finer table, or else from the coarser one."""
    a = first.select(*first_keys, *[F.col(m).alias(f"{m}_fine") for m in metrics])
    b = second.select(*second_keys, *[F.col(m).alias(f"{m}_coarse") for m in metrics])
    joined = places.join(a, first_keys, "left").join(b, second_keys, "left")
    return joined.select(*places.columns, *[F.coalesce(f"{m}_fine", f"{m}_coarse").alias(m) for m in metrics])


def property_addresses(properties: DataFrame, features: DataFrame) -> DataFrame:
    """zpid, full_address and county of the listings that are in both tables."""
    return properties.select("zpid").join(features.select("zpid", "full_address", "county"), "zpid")


def crime_table(addresses: DataFrame, cities: DataFrame, counties: DataFrame, unique: bool = True) -> DataFrame:
    """zpid, violent_100k, property_100k: of the city, or else of the county; one row a listing if ``unique``.

    ``addresses`` has zpid, full_address and county.
    """
    city, state = text.city_state(F.col("full_address"))
    places = addresses.select("zpid", city.alias("city"), state.alias("state"), text.county(F.col("county")).alias("county")).distinct()
    metrics = ["violent_100k", "property_100k"]
    found = with_fallback(places, cities, ["city", "state"], counties, ["county", "state"], metrics)
    if not unique:
        return found.select("zpid", *metrics)
    return joins.one_per_key(found.select("zpid", *metrics), "zpid", [F.col(m).isNull() for m in metrics] + metrics)


def nearest_store(origins: DataFrame, stores: DataFrame, details: DataFrame, drives: DataFrame, least_reviews: int = 200) -> DataFrame:
    """The nearest store that is a chain or has enough reviews, with its drive in minutes.

    ``stores``: zpid, store_id, distance; ``details``: store_id, name, address, rating,
    user_ratings_total; ``drives``: zpid, store_id, seconds.  Misses drop the row.
    """
    known = joins.looked_up(origins.select("zpid").join(stores, "zpid"), details, "store_id")
    good = (F.coalesce(F.col("user_ratings_total"), F.lit(0)) >= least_reviews) | text.is_chain(F.col("name"))
    best = joins.first_qualifying(known, "zpid", "distance", good, "store_id")
    return best.join(drives, ["zpid", "store_id"]).select("zpid", "name", text.drive_minutes(F.col("seconds")).alias("drive_time"), "address", "rating", "user_ratings_total")
