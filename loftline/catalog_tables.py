"""Registered queries over stored tables: keyed by bucket, written under rules, read from workbooks, followed as streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import loftline.catalog_more  # noqa: F401  (its SQL is used here)
from loftline.catalog import _FIELD_PASS, _QUICK, BASE_SQL, ORACLE, SCORED_SQL, TOTAL_SQL, _base, _changes, _prices, _rounded, _scored, _total_sql, register
from loftline.functions import scoring, text
from loftline.operators import joins, merge, ranks
from loftline.plans import enrichment, learning, listings
from loftline.plans import ranking_job as job
from loftline.plans.tournament import score_judge
from loftline.sources import rules, tables, workbooks
from loftline.sources.keyed import keyed
from loftline.sources.lineage import shared_root
from loftline.sources.schema import SCHEMAS, ensure_columns
from loftline.sources.tables import table
from loftline.spec import DEFAULT_WEIGHTS, QuerySpec, normalised_weights
from loftline.streaming import queue


def _keyed_sides(spark: SparkSession, d: str) -> list[DataFrame]:
    """The listing and its five optional tables, each in buckets of the key."""
    sides = [
        table(spark, d, "orders").selectExpr("o_orderkey AS zpid", "o_totalprice AS price"),
        table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("zpid")).agg(F.count("*").cast("int").alias("beds")),
        table(spark, d, "part").selectExpr("p_partkey AS zpid", "p_retailprice AS violent_100k", "cast(p_size as double) AS property_100k"),
        table(spark, d, "supplier").selectExpr("s_suppkey AS zpid", "s_nationkey AS drive_time", "s_name AS name", "s_acctbal AS rating", "cast(s_suppkey * 3 as int) AS user_ratings_total"),
        table(spark, d, "customer").selectExpr("c_custkey AS zpid", "c_nationkey + 0.5D AS latitude", "c_acctbal AS longitude"),
        table(spark, d, "part").selectExpr("p_partkey AS zpid", "p_size AS ai_rank"),
    ]
    return [keyed(side, "zpid") for side in sides]


@register(ORACLE["listing_base"])
def listing_base_keyed(spark: SparkSession, d: str) -> DataFrame:
    """The five-table join over tables in buckets of the key: rows meet where they are stored."""
    return joins.listing_base(*_keyed_sides(spark, d))


@register(ORACLE["lww_upsert"])
def lww_upsert_keyed(spark: SparkSession, d: str) -> DataFrame:
    """Last write wins on a keyed table; only the changes are exchanged, and the outcome is a keyed table again."""
    old = keyed(table(spark, d, "supplier").select(F.col("s_suppkey").alias("zpid"), F.lit("no").alias("rating")), "zpid")
    return keyed(merge.upsert(old, _changes(spark, d), "zpid", "rating", ["updated_at", "event_id"], ("yes", "no", "maybe")), "zpid", dealt=True)


@register(
    "WITH rows AS (SELECT user_id AS zpid, case event_type when 'purchase' then 'yes' when 'view' then 'no' when 'click' then 'maybe' when 'refund' then NULL else 'bogus' end AS rating FROM events)"
    " SELECT 'rating not null' AS rule, count(*) FILTER (rating IS NULL) AS breaches FROM rows UNION ALL SELECT 'check rating', count(*) FILTER (rating NOT IN ('yes', 'no', 'maybe')) FROM rows"
    " UNION ALL SELECT 'key zpid not null', count(*) FILTER (zpid IS NULL) FROM rows UNION ALL SELECT 'key zpid unique', count(zpid) - count(DISTINCT zpid) FROM rows"
)
def rule_report(spark: SparkSession, d: str) -> DataFrame:
    """What a table of ratings breaks, counted as it is written and refused."""
    rating = F.when(F.col("event_type") == "purchase", "yes").when(F.col("event_type") == "view", "no").when(F.col("event_type") == "click", "maybe").when(F.col("event_type") != "refund", "bogus")
    rows = table(spark, d, "events").select(F.col("user_id").alias("zpid"), rating.alias("rating"))
    return rules.report(rules.checked(rows, rules.breaches_of("rating"), "zpid")[1], spark)


# --- workbooks -------------------------------------------------------------------------------


def _books(rows: DataFrame, by: str, sheet: str, titles: int, heads: list[str | None], footnote: str) -> DataFrame:
    """A workbook for each value of ``by``: title rows, headers, the other columns' rows in order and a footnote, as exports have them."""

    def book(frame: pd.DataFrame) -> pd.DataFrame:
        lines = [[None if pd.isna(v) else v for v in r] for r in frame.drop(columns=by).sort_values(frame.columns[1]).itertuples(index=False)]
        whole = [["An exported table"], *[None] * (titles - 1), heads, *lines, [footnote]]
        return pd.DataFrame({"path": [f"{frame[by].iloc[0]}.xlsx"], "content": [workbooks.workbook({"Notes": [["see next sheet"]], sheet: whole})]})

    return rows.groupBy(by).applyInPandas(book, "path string, content binary")


@register(ORACLE["county_rates"])
def county_rates_workbook(spark: SparkSession, d: str) -> DataFrame:
    """The county rates from workbooks: a crime sheet under four titles, and a population sheet a state, whose first row is the state's own."""
    region, every = table(spark, d, "region"), table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    crimes = every.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "r_regionkey").agg(F.count("*").alias("v"), F.sum("s_suppkey").alias("p"))
    state = lambda even, odd: F.when(F.col("r_regionkey") % 2 == 0, even).otherwise(odd)
    crime_rows = crimes.select(F.lit("county").alias("book"), F.concat("r_name", F.lit(" County ")).alias("county"), state("Ore.", "wash").alias("state"), "v", "p")
    crime_files = _books(crime_rows, "book", "Table 10", 4, ["County", "State", "Violent\ncrime", "Property-crime"], "")
    label = F.concat(F.lit("."), "r_name", F.lit(" County, "), state("Oregon", "Washington"))
    own = region.select(state("or", "wa").alias("book"), label.alias("label"), ((F.col("r_regionkey") + 1) * 1000).alias("n"))
    # Each state's sheet begins with the state itself, which is skipped.
    whole = own.select("book", F.lit(".").alias("label"), F.lit(1).cast("long").alias("n")).distinct()
    people_files = _books(own.unionByName(whole), "book", "Estimates", 3, [None, "2023"], "Note: no label")
    counties = workbooks.sheet_rows(crime_files, {"State": "state", "County": "county", "Violent crime": "violent crime", "Property crime": "property crime"}, header=4, sheet="Table 10", key="County")
    people = workbooks.sheet_rows(people_files, {"county_state": 0, "population": 1}, header=3, sheet="Estimates", skip=1)
    return _rounded(enrichment.county_rates(counties.drop("file", "sheet", "row"), enrichment.county_population(people)), ["state", "county"], ["violent_100k", "property_100k"])


# --- streams ---------------------------------------------------------------------------------


@register(ORACLE["queue_insert"])
def queue_stream(spark: SparkSession, d: str) -> DataFrame:
    """The queue's inserts as a stream: what was queued or known before, then the events in two batches, the first of which comes twice."""
    root = f"{shared_root(spark)}/queue-{uuid.uuid4().hex}"
    at = F.timestamp_seconds(F.col("since") + 86_400)  # a stream begins after the epoch
    asked = lambda df, key, since: df.select(F.col(key).cast("long").alias("zpid"), F.lit("ask").alias("kind"), since.cast("long").alias("since"))
    known = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("long").alias("zpid"), F.lit("known").alias("kind"), F.lit(0).cast("long").alias("since"))
    before = asked(table(spark, d, "supplier"), "s_suppkey", F.lit(0)).unionByName(known)
    events = asked(table(spark, d, "events"), "user_id", F.col("event_id"))
    half = events.agg((F.max("since") / 2).cast("long")).first()[0] or 0
    for batch in (before, events.where(F.col("since") <= half), events.where(F.col("since") <= half), events.where(F.col("since") > half)):
        batch.withColumn("at", at).write.mode("append").parquet(f"{root}/in")
        messages = spark.readStream.schema("zpid long, kind string, since long, at timestamp").parquet(f"{root}/in")
        queue.follow_queue(messages, f"{root}/log", f"{root}/state", late="30 days").awaitTermination()
    return queue.queued(spark, f"{root}/log")


# --- parameters, sinks and small scans -------------------------------------------------------

_ASKED = {"price": "30", "beds": "0", "home_size_sqft": "-4.5", "drive_time": "12.5", "kitchen_quality": "abc"}
_GIVEN = DEFAULT_WEIGHTS | {"price": 30.0, "beds": 0.0, "home_size_sqft": -4.5, "drive_time": 12.5}


@register(f"WITH {SCORED_SQL} SELECT zpid, round({_total_sql(normalised_weights(_GIVEN))}, 6) AS total_score FROM scored")
def request_weights(spark: SparkSession, d: str) -> DataFrame:
    """Totals under the weights of a request, valid ones of either sign and a malformed one."""
    spec = QuerySpec.from_request({f"weight_{k}": v for k, v in _ASKED.items()})
    return _rounded(scoring.scored(_base(spark, d), spec.weights, spec.params, prices=_prices(spark, d)), ["zpid"], ["total_score"])


@register(f"WITH {TOTAL_SQL} SELECT 0e0 AS score_min, round(max(total_score), 6) AS score_max, cast(1 as int) AS rank_min, max(ai_rank) AS rank_max FROM totals")
def slider_ends(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(listings.threshold_ranges(_scored(spark, d)), ["score_min", "rank_min", "rank_max"], ["score_max"])


@register("SELECT s_suppkey AS zpid, concat_ws('&', printf('weight_price=%.2f', s_acctbal), case when s_nationkey > 5 then printf('weight_beds=%.2f', s_nationkey + 0.5e0) end) AS parameters FROM supplier")
def weight_urls(spark: SparkSession, d: str) -> DataFrame:
    weights = {"price": F.col("s_acctbal"), "beds": F.when(F.col("s_nationkey") > 5, F.col("s_nationkey") + 0.5)}
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("zpid"), text.weight_parameters(weights).alias("parameters"))


@register(f"WITH {SCORED_SQL} SELECT zpid, round(coalesce(price_score, 50e0), 6) AS price, round(coalesce(dedicated_office_score, 50e0), 6) AS dedicated_office, round(coalesce(positive_features_score_score, 50e0), 6) AS positive_features_score FROM scored")
def feature_scores(spark: SparkSession, d: str) -> DataFrame:
    """The learner's features of each listing, those that are missing at 50."""
    scored = _scored(spark, d)
    names, columns = learning.feature_matrix(scored)
    held = scored.select("zpid", *columns)
    return _rounded(held, ["zpid"], ["price", "dedicated_office", "positive_features_score"]) if len(names) == len(DEFAULT_WEIGHTS) else held


@register("SELECT o_orderkey AS zpid, '1 A St, Bend, OR ' || c_custkey AS full_address, c_name AS county FROM orders JOIN customer ON o_orderkey = c_custkey")
def property_addresses(spark: SparkSession, d: str) -> DataFrame:
    features = table(spark, d, "customer").selectExpr("c_custkey AS zpid", "concat('1 A St, Bend, OR ', c_custkey) AS full_address", "c_name AS county")
    return enrichment.property_addresses(table(spark, d, "orders").selectExpr("o_orderkey AS zpid", "o_totalprice AS price"), features)


@register("SELECT o_orderkey AS zpid, coalesce(case when s_suppkey IS NOT NULL then 'yes' end, '') AS rating, '' AS note FROM orders LEFT JOIN supplier ON o_orderkey = s_suppkey")
def unread_notes(spark: SparkSession, d: str) -> DataFrame:
    """User data where the notes can't be read: they count as none."""
    o = table(spark, d, "orders").selectExpr("o_orderkey AS zpid")
    ratings = table(spark, d, "supplier").select(F.col("s_suppkey").alias("zpid"), F.lit("yes").alias("rating"))
    return joins.with_user_data(o, ratings, tables.table_or_empty(spark, f"{d}/no_such_notes.parquet", SCHEMAS["notes"]))


@register("SELECT zillow_url, cast(row_number() OVER (ORDER BY added_at ASC NULLS LAST, zillow_url) as int) AS place FROM (SELECT 'https://h/' || c_custkey AS zillow_url, case when c_nationkey > 2 then c_nationkey end AS added_at FROM customer)")
def queue_order(spark: SparkSession, d: str) -> DataFrame:
    """The work queue's links with their places, oldest first."""
    queued = table(spark, d, "customer").selectExpr("concat('https://h/', c_custkey) AS zillow_url", "case when c_nationkey > 2 then c_nationkey end AS added_at")
    return ranks.ordinal(queued, "added_at", ["zillow_url"], "place").select("zillow_url", "place")


@register("SELECT s_suppkey AS zpid, s_acctbal AS violent_100k, cast(NULL as double) AS property_100k, 'kept' AS more FROM supplier")
def evolved_columns(spark: SparkSession, d: str) -> DataFrame:
    """A table that lacks a column of its schema gets it, empty; what else it has stays."""
    held = table(spark, d, "supplier").select(F.col("s_suppkey").alias("zpid"), F.col("s_acctbal").alias("violent_100k"), F.lit("kept").alias("more"))
    return ensure_columns(held, SCHEMAS["crime"])


def _scratch(spark: SparkSession) -> str:
    """A catalogue of its own in the shared folder."""
    name = f"loftline_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_root(spark)}/{name}'")
    return name


@register(
    "SELECT 'replaced' AS held, s_suppkey AS zpid, s_acctbal AS amount, true AS stamped FROM supplier WHERE s_nationkey % 2 = 1 UNION ALL SELECT 'appended', s_suppkey, s_acctbal, NULL FROM supplier WHERE s_nationkey % 2 = 0"
    " UNION ALL SELECT 'appended', s_suppkey, s_acctbal, NULL FROM supplier WHERE s_nationkey % 2 = 1 UNION ALL SELECT 'missing', NULL, NULL, NULL FROM region WHERE r_regionkey < 0"
)
def sinks(spark: SparkSession, d: str) -> DataFrame:
    """Tables written whole twice with their time, and in two appends, and read back; a table that isn't there reads as empty."""
    own, where = table(spark, d, "supplier").select(F.col("s_suppkey").alias("zpid"), F.col("s_acctbal").alias("amount"), "s_nationkey"), _scratch(spark)
    even, odd = (own.where(F.col("s_nationkey") % 2 == k).drop("s_nationkey") for k in (0, 1))
    for part in (even, odd):
        tables.replace_table(part, f"{where}.crime", "stamped_at")
        tables.append_rows(part, f"{where}.grocery")
    replaced = spark.table(f"{where}.crime").select(F.lit("replaced").alias("held"), "zpid", "amount", F.col("stamped_at").isNotNull().alias("stamped"))
    nothing = F.lit(None).cast("boolean").alias("stamped")
    appended = tables.optional_table(spark, f"{where}.grocery").select(F.lit("appended").alias("held"), "zpid", "amount", nothing)
    missing = tables.optional_table(spark, f"{where}.location", appended.select("zpid", "amount").schema).select(F.lit("missing").alias("held"), "zpid", "amount", nothing)
    return replaced.unionByName(appended).unionByName(missing)


@register(f"""WITH {BASE_SQL}, ends AS (SELECT min(price) AS lo, max(price) AS hi FROM base), qs AS (SELECT zpid, price, {_QUICK} AS quick_score FROM base CROSS JOIN ends), cut AS (SELECT quantile_cont(quick_score, 1e0 / 3e0) AS c FROM qs),
q1 AS (SELECT zpid, price AS score, row_number() OVER (ORDER BY md5(zpid || 's'), zpid) AS start, 0 AS sum_rank FROM qs CROSS JOIN cut WHERE quick_score >= c),
{_FIELD_PASS(1, "cast(floor((pos - 1) / 20e0) as int)")}, {_FIELD_PASS(2, "(pos - 1) % (SELECT ceil(count(*) / 20e0)::bigint FROM q1)")}, {_FIELD_PASS(3, "(pos - 1) % (SELECT ceil(count(*) / 20e0)::bigint FROM q1)")}
SELECT zpid, cast(row_number() OVER (ORDER BY sum_rank, start) as int) AS rank FROM q4""")
def ranking_job(spark: SparkSession, d: str) -> DataFrame:
    """The job from its command line: quick cut, three passes in batches of 20, nothing saved."""
    return job.run_ranking(spark, _base(spark, d), score_judge("price"), ["--batch-size", "20", "--passes", "3", "--dry-run", "--full", "--table", f"none_{uuid.uuid4().hex}"])
