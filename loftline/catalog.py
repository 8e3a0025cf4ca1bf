"""Registered queries over the driver's tables, and the same in DuckDB SQL.

Orders stand for listings and their lines for features; parts, suppliers,
customers, nations, events and pages stand for the other tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import functions as F
from pyspark.sql import DataFrame, SparkSession

from loftline.functions import bins, html, scoring, text
from loftline.operators import filters, joins, merge, pairs, ranks
from loftline.plans import enrichment, learning, listings, tournament
from loftline.sources.tables import table
from loftline.spec import DEFAULT_WEIGHTS, QuerySpec, ScoringParams, normalised_weights

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# --- stand-in tables -------------------------------------------------------------------------

#: Stand-in features of an order, from its lines; the same text is valid in both engines.
FEATURE_SQL = {
    "beds": "cast(count(*) as int)",
    "baths": "cast(count(distinct l_suppkey) as double) / cast(2 as double)",
    "home_size_sqft": "cast(sum(l_quantity) * 20 as int)",
    "lot_size_acres": "max(l_discount) * 100",
    "financing_eligibility": "case when max(l_returnflag) = 'R' then true when max(l_returnflag) = 'N' then false end",
    "dedicated_office": "case when min(l_linestatus) = 'O' then true when count(*) > 1 then false end",
    **{n: f"cast(nullif((sum(l_linenumber) + {k}) % 6, 0) as int)" for k, n in enumerate((*scoring.ORDINALS, "negative_features_severity"))},
    **{n: f"cast(nullif((sum(l_linenumber) + max(l_suppkey) + {k}) % 11, 0) as int)" for k, n in enumerate((*scoring.RISKS, *(f"{s}_school_rating" for s in scoring.SCHOOLS)))},
    **{f"{s}_school_distance_miles": f"case when (count(*) + {k}) % 4 > 0 then min(l_quantity) / cast({k + 2} as double) end" for k, s in enumerate(scoring.SCHOOLS)},
    "drive_time": "cast(nullif(max(l_linenumber) * 12, 36) as int)",
    "violent_100k": "case when count(*) % 5 > 0 then cast(sum(l_linenumber) * 37 as double) end",
    "property_100k": "case when count(*) % 7 > 0 then cast(sum(l_linenumber) * 211 as double) end",
}
_FEATURES = ", ".join(f"{e} AS {n}" for n, e in FEATURE_SQL.items())
#: Rating and AI rank of an order: blank for half of them, none for most.
RATING_SQL = "case substr(o_orderpriority, 1, 1) when '1' then 'yes' when '2' then 'maybe' when '3' then 'no' else '' end"
RANK_SQL = "case when o_orderkey % 3 = 0 then cast(o_orderkey % 1000 + 1 as int) end"
LATITUDE_SQL, LONGITUDE_SQL = "case when o_orderkey % 10 > 0 then cast(o_custkey % 90 as double) end", "case when o_orderkey % 11 > 0 then cast(o_custkey % 180 as double) end"

BASE_SQL = f"""
feats AS (SELECT l_orderkey AS zpid, {_FEATURES} FROM lineitem GROUP BY l_orderkey),
base AS (
  SELECT o.o_orderkey AS zpid, o.o_totalprice AS price,
         case o.o_orderstatus when 'F' then 'Sold' when 'P' then ' Pending ' else 'Active' end AS status,
         {RATING_SQL} AS rating, {RANK_SQL} AS ai_rank, {LATITUDE_SQL} AS latitude, {LONGITUDE_SQL} AS longitude,
         o.o_orderdate AS last_updated, f.* EXCLUDE (zpid)
  FROM orders o LEFT JOIN feats f ON o.o_orderkey = f.zpid)"""


def _base(spark: SparkSession, d: str) -> DataFrame:
    """Orders as listings, with their lines as features."""
    feats = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("zpid")).agg(*[F.expr(e).alias(n) for n, e in FEATURE_SQL.items()])
    status = F.when(F.col("o_orderstatus") == "F", "Sold").when(F.col("o_orderstatus") == "P", " Pending ").otherwise("Active")
    own = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("zpid"), F.col("o_totalprice").alias("price"), status.alias("status"), F.expr(RATING_SQL).alias("rating"),
        F.expr(RANK_SQL).alias("ai_rank"), F.expr(LATITUDE_SQL).alias("latitude"), F.expr(LONGITUDE_SQL).alias("longitude"), F.col("o_orderdate").alias("last_updated"),
    )
    return own.join(feats, "zpid", "left")


_P = ScoringParams()
_X = {k: f"{v!r}e0" for k, v in asdict(_P).items()}


def _q(name: str) -> str:
    return f"cast({name} as double)"


def _ladder(name: str, levels: dict[int, float], other: float) -> str:
    return "case " + " ".join(f"when {name} >= {k} then {float(v)!r}e0" for k, v in sorted(levels.items(), reverse=True)) + f" else {float(other)!r}e0 end"


_DIST = "(" + " + ".join(f"coalesce({s}_school_distance_miles, {_X['school_dist_zero_points_miles']})" for s in scoring.SCHOOLS) + ") / 3e0"
_RISK = "(" + " + ".join(f"coalesce({_q(r)}, 5e0)" for r in scoring.RISKS) + ") / 5e0"
_SCHOOL = "(" + " + ".join(f"coalesce({_q(s + '_school_rating')}, 5e0)" for s in scoring.SCHOOLS) + ") / 3e0"
_CRIME = {k: f"(1e0 - coalesce({k}_100k, {top} / 2e0) / {top}) * 100e0" for k, top in (("violent", _X["max_violent_crime_100k"]), ("property", _X["max_property_crime_100k"]))}
SCORE_SQL = {
    "price": "(1e0 - (least(greatest(price, price_floor), price_ceiling) - price_floor) / nullif(price_ceiling - price_floor, 0)) * 100e0",
    "beds": f"least({_q('beds')}, 5e0) / 5e0 * 100e0",
    "baths": "least(baths, 4e0) / 4e0 * 100e0",
    "home_size_sqft": f"case when home_size_sqft >= 3000 then 100e0 when home_size_sqft > 2000 then 80e0 + ({_q('home_size_sqft')} - 2000e0) / (3000e0 - 2000e0) * 20e0 else coalesce({_q('home_size_sqft')}, 0e0) / 2000e0 * 80e0 end",
    "lot_size_acres": f"least(coalesce(lot_size_acres, 0e0) / 8e0, 1e0) * 100e0 * {_ladder('land_usability', {5: 1.0, 4: 0.85, 3: 0.6, 2: 0.2, 1: 0.0}, 0.35)}",
    **{n: f"(coalesce({_q(n)}, {m}e0) - 1e0) * 25e0" for n, m in scoring.ORDINALS.items()},
    "negative_features_severity": _ladder("negative_features_severity", {5: 100, 4: 80, 3: 55, 2: 15, 1: 0}, 55),
    "dedicated_office": "cast(dedicated_office as int) * 100e0",
    "drive_time": f"(1e0 - coalesce({_q('drive_time')}, 60e0) / 60e0) * 100e0",
    "avg_risk_severity": f"(1e0 - ({_RISK} - 1e0) / 9e0) * 100e0",
    "avg_school_rating": f"{_SCHOOL} * 10e0",
    "avg_school_distance": f"case when {_DIST} <= 1e0 then 100e0 when {_DIST} >= 20e0 then 0e0 else (1e0 - ({_DIST} - 1e0) / (20e0 - 1e0)) * 100e0 end",
    "violent_crime": _CRIME["violent"],
    "property_crime": _CRIME["property"],
    "avg_crime_severity": f"({_CRIME['violent']} + {_CRIME['property']}) / 2e0",
}
#: Composites whose names are also raw columns carry their own suffix here.
COMPOSITE_SQL = {
    "avg_risk_severity": _RISK, "avg_school_rating": _SCHOOL, "avg_school_distance": _DIST,
    "violent_100k": "coalesce(violent_100k, 360e0)", "property_100k": "coalesce(property_100k, 2763e0)",
    "violent_100k_raw": "violent_100k", "property_100k_raw": "property_100k",
    "avg_crime_severity_raw": "(2e0 * violent_100k + property_100k) / 3e0",
    "avg_crime_severity": "(2e0 * coalesce(violent_100k, 360e0) + coalesce(property_100k, 2763e0)) / 3e0",
}
_SCORES = ", ".join(f"{e} AS {n}_score" for n, e in SCORE_SQL.items())
STATS_SQL = """
stats AS (SELECT quantile_cont(price, 0.01) AS price_floor, quantile_cont(price, 0.95) AS price_ceiling FROM base WHERE price IS NOT NULL)"""
SCORED_SQL = f"{BASE_SQL},{STATS_SQL},\nscored AS (SELECT base.*, {_SCORES} FROM base CROSS JOIN stats)"


def _total_sql(weights: dict[str, float]) -> str:
    gain = " + ".join(f"{k}_score * {float(w)!r}e0" if "e" not in repr(float(w)) else f"{k}_score * {float(w)!r}" for k, w in weights.items() if w > 0)
    loss = " + ".join(f"(100e0 - {k}_score) / 100e0 * {float(-w)!r}e0" for k, w in weights.items() if w < 0)
    return f"({gain or '0e0'}) - ({loss or '0e0'})"


def _rounded(df: DataFrame, keep: list[str], doubles: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *[F.round(F.col(c), digits).alias(c) for c in doubles])


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.scored(_base(spark, d), prices=_prices(spark, d))


def _prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_totalprice").alias("price"))


TOTAL_SQL = f"{SCORED_SQL},\ntotals AS (SELECT *, {_total_sql(normalised_weights(DEFAULT_WEIGHTS))} AS total_score FROM scored)"

# --- base join and scores --------------------------------------------------------------------


@register("SELECT o.o_orderkey AS zpid, o.o_totalprice AS price, c.c_name AS grocery_name, n.n_name AS county, x.n_lines, coalesce(s.s_name, '') AS note FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) x ON o.o_orderkey = x.l_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN supplier s ON o.o_orderkey = s.s_suppkey")
def base_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("zpid"), F.col("o_totalprice").alias("price"), "o_custkey")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("zpid")).agg(F.count("*").alias("n_lines"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("grocery_name"), "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("county"))
    notes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("zpid"), F.col("s_name").alias("note"))
    out = o.join(lines, "zpid", "left").join(c, "o_custkey", "left").join(n, "c_nationkey", "left").join(notes, "zpid", "left")
    return out.select("zpid", "price", "grocery_name", "county", "n_lines", F.coalesce("note", F.lit("")).alias("note"))


_MAIN = [f"{n}_score" for n in ("price", "beds", "baths", "home_size_sqft", "lot_size_acres")]


@register(f"WITH {TOTAL_SQL} SELECT zpid, {_r('total_score', *_MAIN)} FROM totals")
def score_total(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ranks.by_score(_scored(spark, d)), ["zpid"], ["total_score", *_MAIN])


_ORD = [f"{n}_score" for n in (*scoring.ORDINALS, "negative_features_severity", "dedicated_office")]


@register(f"WITH {SCORED_SQL} SELECT zpid, {_r(*_ORD)} FROM scored")
def score_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scored(spark, d), ["zpid"], _ORD)


_COMP = [f"{n}_score" for n in ("drive_time", "avg_risk_severity", "avg_school_rating", "avg_school_distance", "violent_crime", "property_crime", "avg_crime_severity")]


@register(f"WITH {SCORED_SQL} SELECT zpid, {_r(*_COMP)}, {', '.join(f'round({e}, 6) AS {n}' for n, e in COMPOSITE_SQL.items())} FROM scored")
def score_composites(spark: SparkSession, d: str) -> DataFrame:
    df = _scored(spark, d).withColumns(scoring.composites(_P))
    return _rounded(df, ["zpid"], [*_COMP, *COMPOSITE_SQL])


_SIGNED = {"price": 20, "beds": -3, "baths": 0, "home_size_sqft": 7, "drive_time": -5}


@register(f"WITH {SCORED_SQL} SELECT zpid, round({_total_sql(normalised_weights(_SIGNED))}, 6) AS total_score FROM scored")
def penalty_weights(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.scored(_base(spark, d), _SIGNED, prices=_prices(spark, d)), ["zpid"], ["total_score"])


@register(f"WITH {SCORED_SQL} SELECT ns.zpid, round(ns.price_score, 6) AS price_score, bf.rating FROM scored ns JOIN base bf ON ns.zpid = bf.zpid")
def rejoin_scores(spark: SparkSession, d: str) -> DataFrame:
    base = _base(spark, d)
    return scoring.scored(base).select("zpid", F.round("price_score", 6).alias("price_score")).join(base.select("zpid", "rating"), "zpid")


# --- filters ---------------------------------------------------------------------------------


@register(f"WITH {BASE_SQL} SELECT zpid, financing_eligibility FROM base WHERE financing_eligibility = TRUE OR financing_eligibility IS NULL")
def filter_financing(spark: SparkSession, d: str) -> DataFrame:
    return filters.by_financing(_base(spark, d), ["eligible", "unknown", "other"]).select("zpid", "financing_eligibility")


@register(f"WITH {BASE_SQL} SELECT zpid, status FROM base WHERE NOT (trim(coalesce(status, '')) IN ({', '.join(repr(s) for s in filters.INACTIVE)}) OR starts_with(trim(coalesce(status, '')), 'Sold for '))")
def filter_status(spark: SparkSession, d: str) -> DataFrame:
    return filters.by_status(_base(spark, d), ["Active"]).select("zpid", "status")


@register("SELECT d.doc_id AS zpid, case when l.quality = 1 then 'yes' when l.quality = 0 then 'no' else '' end AS rating FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.quality = 1")
def filter_rating(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select(F.col("doc_id").alias("zpid")), table(spark, d, "labels")
    rating = labels.select(F.col("doc_id").alias("zpid"), F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no").alias("rating"))
    return filters.by_rating(docs.join(rating, "zpid", "left").withColumn("rating", F.coalesce("rating", F.lit(""))), ["yes", "blank"])


@register(f"WITH {TOTAL_SQL} SELECT zpid, rating, round(total_score, 6) AS total_score FROM totals WHERE rating <> '' OR total_score >= 50")
def filter_threshold_score(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(filters.by_threshold(_scored(spark, d), "score", 50), ["zpid", "rating"], ["total_score"])


@register(f"WITH {BASE_SQL} SELECT zpid, ai_rank FROM base WHERE ai_rank <= 200")
def filter_threshold_ai(spark: SparkSession, d: str) -> DataFrame:
    return filters.by_threshold(_base(spark, d), "ai", 200).select("zpid", "ai_rank")


@register(f"WITH {BASE_SQL} SELECT zpid, latitude, longitude FROM base WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def filter_geo(spark: SparkSession, d: str) -> DataFrame:
    return filters.located(_base(spark, d)).select("zpid", "latitude", "longitude")


_CUTOFF = "1997-06-01 00:00:00"


@register(f"WITH {BASE_SQL} SELECT zpid, last_updated, regexp_matches(lower(status), 'sold|off market|pending') AS says_inactive FROM base WHERE (status IS NULL OR NOT (upper(status) LIKE '%SOLD%' OR upper(status) LIKE '%OFF%MARKET%' OR upper(status) LIKE '%PENDING%')) AND (last_updated IS NULL OR last_updated < TIMESTAMP '{_CUTOFF}')")
def stale_active(spark: SparkSession, d: str) -> DataFrame:
    old = filters.stale_active(_base(spark, d), F.lit(_CUTOFF).cast("timestamp_ntz"))
    return old.select("zpid", "last_updated", filters.says_inactive(F.col("status")).alias("says_inactive"))


@register("SELECT o.o_orderkey, o.o_totalprice, c.c_name, n.n_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderkey = 7")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    one = filters.lookup(table(spark, d, "orders"), "o_orderkey", 7)
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return one.join(c, one.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").select("o_orderkey", "o_totalprice", "c_name", "n_name")


@register(f"WITH {BASE_SQL} SELECT DISTINCT status FROM base WHERE trim(status) <> ''")
def distinct_statuses(spark: SparkSession, d: str) -> DataFrame:
    return filters.statuses(_base(spark, d))


# --- order, cuts and ranges ------------------------------------------------------------------


@register(f"WITH {TOTAL_SQL} SELECT zpid, row_number() OVER (ORDER BY floor(total_score * 1000e0) DESC NULLS LAST, zpid) AS pos FROM totals")
def rank_score(spark: SparkSession, d: str) -> DataFrame:
    df = _scored(spark, d).select("zpid", (-F.floor(F.col("total_score") * 1000.0)).alias("_s"))
    return ranks.ordinal(df, "_s", ["zpid"], "pos").select("zpid", F.col("pos").cast("long").alias("pos"))


@register(f"WITH {TOTAL_SQL} SELECT zpid, row_number() OVER (ORDER BY ai_rank ASC NULLS LAST, floor(total_score * 1000e0) DESC NULLS LAST, zpid) AS pos FROM totals")
def rank_ai(spark: SparkSession, d: str) -> DataFrame:
    df = _scored(spark, d).select("zpid", "ai_rank", (-F.floor(F.col("total_score") * 1000.0)).alias("_s"))
    return ranks.ordinal(df, "ai_rank", ["zpid"], "pos", second="_s").select("zpid", F.col("pos").cast("long").alias("pos"))


_QUICK = " + ".join(
    ["case when hi > lo then (1e0 - (coalesce(price, hi) - lo) / (hi - lo)) * 20e0 else 0e0 end"]
    + [f"coalesce({_q(n)}, 3e0) * {float(w)!r}e0" for n, w in ranks.QUICK_WEIGHTS.items()]
    + ["least(coalesce(lot_size_acres, 0e0), 8e0) / 8e0 * 40e0", f"least(coalesce({_q('home_size_sqft')}, 0e0), 3000e0) / 3000e0 * 35e0", "cast(coalesce(dedicated_office, false) as int) * 50e0"]
)


@register(f"WITH {BASE_SQL}, ends AS (SELECT min(price) AS lo, max(price) AS hi FROM base), q AS (SELECT zpid, {_QUICK} AS quick_score FROM base CROSS JOIN ends), cut AS (SELECT quantile_cont(quick_score, 1e0 / 3e0) AS c FROM q) SELECT zpid, round(quick_score, 6) AS quick_score FROM q CROSS JOIN cut WHERE quick_score >= c")
def quick_cut(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ranks.quick_cut(_base(spark, d)), ["zpid"], ["quick_score"])


@register(f"WITH {TOTAL_SQL} SELECT zpid, round(total_score, 6) AS total_score FROM totals ORDER BY total_score DESC NULLS LAST, zpid LIMIT 20")
def topn(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ranks.top(_scored(spark, d), 20, F.desc_nulls_last("total_score"), "zpid"), ["zpid"], ["total_score"])


@register(f"WITH {TOTAL_SQL} SELECT 0e0 AS score_min, round(coalesce(max(total_score), 100e0), 6) AS score_max, 1 AS rank_min, coalesce(max(ai_rank), 100) AS rank_max, sum(cast(status <> 'Active' as int)) AS n_excluded, count(*) AS n_rows FROM totals")
def range_summary(spark: SparkSession, d: str) -> DataFrame:
    df = _scored(spark, d)
    more = df.agg(F.count_if(filters.is_inactive(F.col("status"))).alias("n_excluded"), F.count("*").alias("n_rows"))
    return listings.threshold_ranges(df).crossJoin(more).withColumn("score_max", F.round("score_max", 6))


@register("SELECT cast(100 as double) AS score_max, 100 AS rank_max, 0::bigint AS n_rows")
def range_summary_empty(spark: SparkSession, d: str) -> DataFrame:
    none = _scored(spark, d).where("false")
    return listings.threshold_ranges(none).crossJoin(none.agg(F.count("*").alias("n_rows"))).select("score_max", "rank_max", "n_rows")


# --- joins -----------------------------------------------------------------------------------


@register("SELECT o_orderkey AS zpid FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def backlog_anti(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("zpid"), F.col("o_orderpriority").alias("full_address"))
    return joins.backlog(orders, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("zpid"))).select("zpid")


@register("SELECT o_orderkey AS zpid FROM orders WHERE NOT (o_orderkey IN (SELECT c_custkey FROM customer) AND o_orderkey IN (SELECT l_orderkey FROM lineitem))")
def fully_processed(spark: SparkSession, d: str) -> DataFrame:
    key = lambda name, c: table(spark, d, name).select(F.col(c).alias("zpid"))
    return joins.unprocessed(key("orders", "o_orderkey"), key("customer", "c_custkey"), key("lineitem", "l_orderkey"))


@register("SELECT zpid, 'missing' AS side FROM (SELECT p_partkey AS zpid FROM part) a WHERE zpid NOT IN (SELECT s_suppkey * 30 FROM supplier) UNION ALL SELECT s_suppkey * 30, 'extra' FROM supplier WHERE s_suppkey * 30 NOT IN (SELECT p_partkey FROM part)")
def id_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    batch = table(spark, d, "part").select(F.col("p_partkey").alias("zpid"))
    missing, extra = joins.reconciled(batch, table(spark, d, "supplier").select((F.col("s_suppkey") * 30).alias("zpid")))
    return missing.withColumn("side", F.lit("missing")).unionByName(extra.withColumn("side", F.lit("extra")))


@register("WITH inner_first AS (SELECT o.o_orderkey, o.o_custkey FROM orders o JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON o.o_orderkey = l.l_orderkey) SELECT i.o_orderkey AS zpid, c.c_name, s.s_name FROM inner_first i LEFT JOIN customer c ON i.o_custkey = c.c_custkey LEFT JOIN supplier s ON i.o_orderkey = s.s_suppkey")
def ranker_scan(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(have, "o_orderkey", "left_semi")
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(s, o.o_orderkey == s.s_suppkey, "left").select(F.col("o_orderkey").alias("zpid"), "c_name", "s_name")


_RATED_SQL = "rated AS (SELECT s_suppkey AS pos, cast(s_suppkey % 3 as int) AS value FROM supplier)"


@register(f"WITH {_RATED_SQL} SELECT a.pos AS i, b.pos AS j, a.value - b.value AS diff FROM rated a JOIN rated b ON a.pos < b.pos AND a.value <> b.value")
def theta_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.preference_pairs(_rated(spark, d), "pos", "value")


def _rated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), (F.col("s_suppkey") % 3).cast("int").alias("value"))


_LEARN = {"price": 2.0, "beds": -1.0, "drive_time": 1.5}


@register(f"WITH {_RATED_SQL}, sc AS (SELECT s_suppkey AS pos, coalesce(s_acctbal / 100e0, 50e0) * 2e0 + (100e0 - s_nationkey * 4e0) * 1e0 + (100e0 - (s_suppkey % 50)) * 1.5e0 AS score FROM supplier) SELECT round(sum(greatest(0e0, -(a.value - b.value) * (x.score - y.score) + 1.12e0)), 4) AS loss, count(*) AS n_pairs FROM rated a JOIN rated b ON a.pos < b.pos AND a.value <> b.value JOIN sc x ON x.pos = a.pos JOIN sc y ON y.pos = b.pos")
def hinge_loss(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("pos"), (F.col("s_acctbal") / 100.0).alias("price_score"), (F.col("s_nationkey") * 4.0).alias("beds_score"), (F.col("s_suppkey") % 50).cast("double").alias("drive_time_score")
    ).select("pos", pairs.learner_score(_LEARN).alias("score"))
    rated = _rated(spark, d).select("pos", "value").join(s, "pos")
    return pairs.summed_hinge(rated, "value", learning.LearnParams.of(0.4).margin).withColumn("loss", F.round("loss", 4))


_ASOF = "new AS (SELECT p_partkey AS zpid, p_partkey AS mini FROM part WHERE p_partkey % 7 <> 3), refs AS (SELECT p_partkey AS mini, cast(p_partkey * 3 + p_size as int) AS global_rank FROM part WHERE p_partkey % 7 = 3)"


def _minis(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    new = p.where("p_partkey % 7 <> 3").select(F.col("p_partkey").alias("zpid"), F.col("p_partkey").alias("mini"))
    return new, p.where("p_partkey % 7 = 3").select(F.col("p_partkey").alias("mini"), (F.col("p_partkey") * 3 + F.col("p_size")).cast("int").alias("global_rank"))


@register(f"WITH {_ASOF} SELECT n.zpid, b.mini AS below_at, b.global_rank AS below FROM new n ASOF LEFT JOIN refs b ON n.mini >= b.mini")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    new, refs = _minis(spark, d)
    return joins.asof(new, refs, "mini", "global_rank").select("zpid", "below_at", "below")


@register(f"WITH {_ASOF}, x AS (SELECT n.zpid, n.mini, b.mini AS bm, b.global_rank AS bg, a.mini AS am, a.global_rank AS ag FROM new n ASOF LEFT JOIN refs b ON n.mini >= b.mini ASOF LEFT JOIN refs a ON n.mini < a.mini) SELECT zpid, cast(case when bm IS NULL then greatest(1, ag - 1) when am IS NULL then bg + 1 else greatest(1, cast(round_even(bg + (mini - bm) / cast(am - bm as double) * (ag - bg), 0) as int)) end as int) AS rank FROM x")
def asof_interp(spark: SparkSession, d: str) -> DataFrame:
    return ranks.mapped_ranks(*_minis(spark, d), total=0).select("zpid", "rank")


# --- rankings --------------------------------------------------------------------------------

_RANKED_ALL = "ranked AS (SELECT p_partkey AS zpid, cast(p_size * 40 + p_partkey % 37 as int) AS rank FROM part)"


def _ranked_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("zpid"), (F.col("p_size") * 40 + F.col("p_partkey") % 37).cast("int").alias("rank"))


_RANKED = "ranked AS (SELECT p_partkey AS zpid, cast(p_size * 40 + p_partkey % 37 as int) AS rank FROM part WHERE p_partkey % 4 <> 0), fresh AS (SELECT p_partkey AS zpid, cast(p_size * 37 as int) AS rank FROM part WHERE p_partkey % 4 = 0)"


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    ranked = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("zpid"), (F.col("p_size") * 40 + F.col("p_partkey") % 37).cast("int").alias("rank"))
    return ranked, p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("zpid"), (F.col("p_size") * 37).cast("int").alias("rank"))


@register(f"WITH {_RANKED}, b AS (SELECT zpid, rank, 0 AS is_new FROM ranked UNION ALL SELECT zpid, rank, 1 FROM fresh) SELECT zpid, cast(row_number() OVER (ORDER BY rank, is_new, zpid) as int) AS rank FROM b")
def merge_ranks(spark: SparkSession, d: str) -> DataFrame:
    return ranks.merged_ranks(*_ranked(spark, d))


@register(f"WITH {_RANKED_ALL} SELECT zpid, cast(row_number() OVER (ORDER BY rank, zpid) as int) AS rank FROM ranked WHERE zpid IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def prune_compact(spark: SparkSession, d: str) -> DataFrame:
    valid = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("zpid"))
    return ranks.compacted(_ranked_all(spark, d), valid)


@register(f"WITH {_RANKED_ALL}, o AS (SELECT zpid, rank, row_number() OVER (ORDER BY rank, zpid) - 1 AS i, count(*) OVER () AS n FROM ranked) SELECT zpid, rank FROM o WHERE n <= 30 OR i IN (SELECT cast(floor(k * n / 30e0) as bigint) FROM (SELECT unnest(range(30)) AS k) CROSS JOIN (SELECT count(*) AS n FROM ranked))")
def spaced_sample(spark: SparkSession, d: str) -> DataFrame:
    return ranks.spaced_sample(_ranked_all(spark, d), 30)


_ITEMS = "items AS (SELECT p_partkey AS zpid, p_retailprice AS score FROM part)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("zpid"), F.col("p_retailprice").alias("score"))


_PASS1 = f"""{_ITEMS},
p1 AS (SELECT *, row_number() OVER (ORDER BY md5(zpid || 's'), zpid) AS start FROM items),
b1 AS (SELECT *, cast(floor((start - 1) / 30e0) as int) AS batch FROM p1),
j1 AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY score DESC NULLS LAST, zpid) AS batch_rank FROM b1),
r1 AS (SELECT zpid, score, start, batch_rank, row_number() OVER (ORDER BY batch_rank, md5(zpid || 's1'), zpid) AS rank1 FROM j1)"""


@register(f"WITH {_PASS1} SELECT zpid, cast(batch as int) AS batch, cast(start as int) AS pos FROM b1")
def batches(spark: SparkSession, d: str) -> DataFrame:
    return ranks.batches(ranks.shuffled(_items(spark, d), "zpid", "s"), 30).select("zpid", "batch", "pos")


@register(f"WITH {_PASS1} SELECT zpid, cast(batch_rank as int) AS batch_rank, cast(rank1 as int) AS rank FROM r1")
def tier_ranks(spark: SparkSession, d: str) -> DataFrame:
    seated = ranks.batches(ranks.shuffled(_items(spark, d), "zpid", "s"), 30)
    return ranks.tier_ranks(ranks.judge_by_score(seated, "score"), "s1").select("zpid", "batch_rank", "rank")


@register(f"""WITH {_PASS1},
s2 AS (SELECT *, row_number() OVER (ORDER BY rank1, start) AS pos FROM r1),
j2 AS (SELECT *, row_number() OVER (PARTITION BY (pos - 1) % (SELECT ceil(count(*) / 30e0)::bigint FROM items) ORDER BY score DESC NULLS LAST, zpid) AS br2 FROM s2),
r2 AS (SELECT *, row_number() OVER (ORDER BY br2, md5(zpid || 's2'), zpid) AS rank2 FROM j2)
SELECT zpid, cast(row_number() OVER (ORDER BY rank1 + rank2, start) as int) AS rank FROM r2""")
def tournament_rank(spark: SparkSession, d: str) -> DataFrame:
    return tournament.tournament(_items(spark, d), tournament.score_judge("score"))


_FIELD_PASS = lambda k, deal: f"""s{k} AS (SELECT *, row_number() OVER (ORDER BY {'sum_rank, start' if k > 1 else 'start'}) AS pos FROM q{k}),
j{k} AS (SELECT *, row_number() OVER (PARTITION BY {deal} ORDER BY score DESC NULLS LAST, zpid) AS br FROM s{k}),
q{k + 1} AS (SELECT zpid, score, start, sum_rank + row_number() OVER (ORDER BY br, md5(zpid || 's{k}'), zpid) AS sum_rank FROM j{k})"""  # noqa: E731


@register(f"""WITH {_ITEMS}, kept AS (SELECT zpid, row_number() OVER (ORDER BY score DESC NULLS LAST, zpid) AS rank FROM items WHERE zpid % 5 <> 0), fresh AS (SELECT zpid FROM items WHERE zpid % 5 = 0),
refs AS (SELECT zpid, rank FROM kept WHERE (SELECT count(*) FROM kept) <= 30 OR rank - 1 IN (SELECT cast(floor(k * n / 30e0) as bigint) FROM (SELECT unnest(range(30)) AS k) CROSS JOIN (SELECT count(*) AS n FROM kept))),
q1 AS (SELECT zpid, score, row_number() OVER (ORDER BY md5(zpid || 's'), zpid) AS start, 0 AS sum_rank FROM items WHERE zpid IN (SELECT zpid FROM refs UNION ALL SELECT zpid FROM fresh)),
{_FIELD_PASS(1, "cast(floor((pos - 1) / 30e0) as int)")}, {_FIELD_PASS(2, "(pos - 1) % (SELECT ceil(count(*) / 30e0)::bigint FROM q1)")},
minis AS (SELECT zpid, row_number() OVER (ORDER BY sum_rank, start) AS mini FROM q3), marks AS (SELECT mini, rank FROM minis JOIN refs USING (zpid)),
x AS (SELECT n.zpid, n.mini, b.mini AS bm, b.rank AS bg, a.mini AS am, a.rank AS ag FROM (SELECT * FROM minis WHERE zpid IN (SELECT zpid FROM fresh)) n ASOF LEFT JOIN marks b ON n.mini >= b.mini ASOF LEFT JOIN marks a ON n.mini < a.mini),
put AS (SELECT zpid, case when bm IS NULL then greatest(1, ag - 1) when am IS NULL then bg + 1 else greatest(1, cast(round_even(bg + (mini - bm) / cast(am - bm as double) * (ag - bg), 0) as int)) end AS rank, 1 AS is_new FROM x)
SELECT zpid, cast(row_number() OVER (ORDER BY rank, is_new, zpid) as int) AS rank FROM (SELECT zpid, rank, 0 AS is_new FROM kept UNION ALL SELECT zpid, rank, is_new FROM put)""")
def incremental_rank(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    ranked = ranks.ordinal(items.where("zpid % 5 <> 0").withColumn("_s", -F.col("score")), "_s", ["zpid"], "rank").select("zpid", "rank")
    return tournament.refreshed(items, ranked, tournament.score_judge("score"))


@register(f"WITH {_RANKED_ALL} SELECT min(rank) AS first_rank, max(rank) AS last_rank, count(*) AS n_ranked FROM ranked")
def rank_report(spark: SparkSession, d: str) -> DataFrame:
    return tournament.rank_report(_ranked_all(spark, d))


@register("SELECT count(*) AS n FROM events")
def row_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.count("*").alias("n"))


@register("WITH c AS (SELECT l_orderkey AS zpid, p_name AS name, l_shipdate AS d, l_linenumber AS n, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT zpid, name, n FROM (SELECT *, row_number() OVER (PARTITION BY zpid ORDER BY d, n) AS k FROM c WHERE l_quantity >= 40 OR regexp_matches(lower(name), '\\btarget\\b|\\biga\\b')) WHERE k = 1")
def first_qualifying(spark: SparkSession, d: str) -> DataFrame:
    """What the date and the number leave open is settled by the place in the table's files: the one met first, as a scan in order has it."""
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    found = lines.select(F.col("l_orderkey").alias("zpid"), "l_partkey", F.col("l_shipdate").alias("d"), F.col("l_linenumber").alias("n"), "l_quantity", *place).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joins.first_qualifying(found, "zpid", "d", (F.col("l_quantity") >= 40) | text.is_chain(F.col("name")), "n", "file", "row").select("zpid", "name", "n")


# --- enrichment and text ---------------------------------------------------------------------


@register("WITH nat AS (SELECT s_nationkey AS city, sum(cast(s_acctbal * 100 as bigint)) / cast(nullif(count(*), 0) as double) * 100000e0 AS v FROM supplier GROUP BY 1), reg AS (SELECT n_regionkey AS county, sum(cast(s_acctbal * 100 as bigint)) / cast(count(*) as double) * 100000e0 AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) SELECT c.c_custkey AS zpid, round(coalesce(case when nat.city % 3 > 0 then nat.v end, reg.v), 3) AS violent_100k FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN nat ON nat.city = c.c_nationkey LEFT JOIN reg ON reg.county = n.n_regionkey")
def rates_fallback(spark: SparkSession, d: str) -> DataFrame:
    s, n, c = (table(spark, d, t) for t in ("supplier", "nation", "customer"))
    cents = F.sum(F.round(F.col("s_acctbal") * 100, 0).cast("long"))
    rate = lambda: text.rate_per_100k(cents, F.count("*"))
    fine = s.groupBy(F.col("s_nationkey").alias("city")).agg(rate().alias("violent_100k")).withColumn("violent_100k", F.when(F.col("city") % 3 > 0, F.col("violent_100k")))
    coarse = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("county")).agg(rate().alias("violent_100k"))
    places = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("zpid"), F.col("c_nationkey").alias("city"), F.col("n_regionkey").alias("county"))
    out = enrichment.with_fallback(places, fine, ["city"], coarse, ["county"], ["violent_100k"])
    return out.select("zpid", F.round("violent_100k", 3).alias("violent_100k"))


_ADDRESS = "c_custkey || ' ' || c_mktsegment || ' Rd, ' || lower(n_name) || '_town, ' || case c_custkey % 4 when 0 then 'OR 97' when 1 then 'Wash. 98' when 2 then 'wa' else 'CA 90' end || c_custkey"
_ADDR = f"a AS (SELECT c_custkey AS zpid, {_ADDRESS} AS address FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("zpid"), F.expr(_ADDRESS).alias("address"))


_STATE = "case when t IN ('OR', 'ORE', 'OREGON') then 'OREGON' when t IN ('WA', 'WASH', 'WASHINGTON') then 'WASHINGTON' end"


@register(f"WITH {_ADDR}, p AS (SELECT zpid, trim(string_split(address, ',')[2]) AS c, upper(regexp_replace(string_split(trim(string_split(address, ',')[3]), ' ')[1], '[^A-Za-z]', '', 'g')) AS t FROM a), s AS (SELECT zpid, c, {_STATE} AS state FROM p) SELECT zpid, case when state IS NOT NULL then array_to_string(list_transform(string_split(replace(c, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') end AS city, state FROM s")
def address_parse(spark: SparkSession, d: str) -> DataFrame:
    city, state = text.city_state(F.col("address"))
    return _addresses(spark, d).select("zpid", city.alias("city"), state.alias("state"))


@register(f"WITH {_ADDR}, p AS (SELECT zpid, trim(string_split(address, ',')[2]) AS c, string_split(trim(string_split(address, ',')[3]), ' ')[1] AS t FROM a) SELECT zpid, c || ', ' || upper(regexp_replace(t, '[^A-Za-z]', '', 'g')[1:2]) AS shown FROM p")
def address_display(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select("zpid", text.display_city(F.col("address")).alias("shown"))


@register("SELECT n_nationkey, nullif(regexp_extract('.' || n_name || ' County, Oregon', '\\.(.+) County, (.+)', 1), '') AS county, 'OREGON' AS state FROM nation")
def county_extract(spark: SparkSession, d: str) -> DataFrame:
    county, state = text.county_and_state(F.concat(F.lit("."), F.col("n_name"), F.lit(" County, Oregon")))
    return table(spark, d, "nation").select("n_nationkey", text.county(county).alias("county"), text.state(state).alias("state"))


@register("SELECT page_id, case when regexp_matches(html, '(?is)<title>.*?</title>') then regexp_extract(html, '(?is)<title>(.*?)</title>', 1) else 'N/A' end AS title FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html.title(F.col("html")).alias("title"))


_TAGS = "html"
for _t in html.DROPPED_TAGS:
    _TAGS = f"regexp_replace({_TAGS}, '(?is)<{_t}\\b[^>]*>.*?</{_t}\\s*>', chr(10), 'g')"
_TAGS = f"regexp_replace(regexp_replace({_TAGS}, '(?s)<!--.*?-->|<![^>]*>', chr(10), 'g'), '(?s)<[^>]+>', chr(10), 'g')"
for _m, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TAGS = f"replace({_TAGS}, '{_m}', '{_c}')"


@register(f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({_TAGS}, chr(10)), lambda s: trim(s)), lambda s: s <> ''), chr(10)) AS body FROM pages")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html.text_lines(F.col("html")).alias("body"))


@register("SELECT DISTINCT case when starts_with(url, 'http') then url else 'https://h' || url end AS url FROM (SELECT '/homedetails/' || (page_id % 100) || '/' || (page_id % 50) || '_zpid/' AS url FROM pages UNION ALL SELECT url || '/zpid/' FROM pages) x WHERE contains(url, '/homedetails/') OR contains(url, '/zpid/')")
def url_norm(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    own = p.select(F.concat(F.lit("/homedetails/"), (F.col("page_id") % 100).cast("string"), F.lit("/"), (F.col("page_id") % 50).cast("string"), F.lit("_zpid/")).alias("href"))
    return html.listing_links(own.unionByName(p.select(F.concat(F.col("url"), F.lit("/zpid/")).alias("href"))), "https://h")


@register("SELECT page_id, page_id % 50 AS zpid FROM pages WHERE page_id % 3 > 0")
def url_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    url = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("https://h/x/"), (F.col("page_id") % 50).cast("string"), F.lit("_zpid/"))).otherwise(F.lit("https://h/"))
    return p.select("page_id", text.id_of_url(url).alias("zpid")).where("zpid IS NOT NULL")


_LINES = "list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> ''), lambda s: length(s) > 15 AND len(regexp_split_to_array(s, '\\s+')) > 2)"


@register(f"WITH l AS (SELECT doc_id, {_LINES} AS lines FROM documents), g AS (SELECT doc_id, lines, list_filter(lines, lambda s: NOT (regexp_matches(lower(s), 'cookie|privacy|terms|consent|do not sell') AND length(s) < 120)) AS good FROM l) SELECT doc_id, array_to_string((case when len(good) > 0 then good else lines end)[1:200], chr(10)) AS kept FROM g")
def line_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.kept_lines(F.col("text")).alias("kept"))


@register("WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, case when length(t) <= 220 then t else t[1:220] || '...' end AS shown FROM f")
def line_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.preview(F.col("text")).alias("shown"))


@register("SELECT event_id, cast(json_extract_string(props, '$.k') as bigint) AS k FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@register("SELECT conv_id, array_to_string(list(role || ': ' || text ORDER BY turn), chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS prompt FROM conversations GROUP BY conv_id")
def summary_text(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(": ", "role", "text").alias("summary"))
    return text.prompt(c, ["conv_id"], "turn")


@register("SELECT p_partkey, case when p_retailprice = 0 then 'no data' else format('{:,}', cast(round(p_retailprice * 1000, 0) as bigint)) end AS shown, p_size || '' AS size FROM part")
def number_formats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.shown_number(F.round(F.col("p_retailprice") * 1000, 0)).alias("shown"), F.col("p_size").cast("string").alias("size"))


#: Texts of a listing that the driver's tables don't have; the same in both engines.
_SAID = {
    "full_address": "case when zpid % 5 > 0 then concat('1 A St, Bend, OR ', zpid) when zpid % 2 = 0 then '' end",
    "financing_eligibility_explanation": "case when zpid % 3 > 0 then concat('no well ', zpid) end",
    "view_type": "case when zpid % 4 > 0 then 'hills' end",
    "negative_features_list": "case zpid % 3 when 0 then 'None identified' when 1 then 'road noise; slope' end",
    "positive_features_list": "case zpid % 3 when 1 then 'Standard features only' when 2 then 'barn' end",
    "grocery_name": "case zpid % 3 when 0 then 'Safeway' when 1 then '' end",
    "general_assessment": "case when zpid % 7 > 0 then concat('Listing ', zpid, ' is sound.') end",
}


def _list_sql(pairs: dict[str, str]) -> str:
    return "concat_ws(', ', " + ", ".join(f"'{label}=' || {c}" for c, label in pairs.items()) + ")"


def _line_sql(label: str, value: str) -> str:
    return f"'{label}' || nullif({value}, '')"


_TRUTH = lambda c: f"case when {c} then 'True' when not {c} then 'False' end"
_SCHOOLS_SQL = ", ".join(
    f"case when {s}_school_rating IS NOT NULL OR {s}_school_distance_miles IS NOT NULL then concat_ws(' ', '{s.capitalize()}:', 'rating=' || {s}_school_rating, format('dist={{:.1f}}mi', floor({s}_school_distance_miles * 10 + 0.5) / 10)) end" for s in scoring.SCHOOLS
)
_SUMMARY_LINES = [
    "'ZPID: ' || zpid",
    _line_sql("Address: ", "full_address"),
    "'Price: ' || coalesce('$' || format('{:,}', cast(round_even(price, 0) as bigint)), 'N/A')",
    "'Beds: ' || coalesce(cast(beds as varchar), '?') || ' | Baths: ' || coalesce(cast(baths as varchar), '?')",
    "case when home_size_sqft <> 0 then 'Home size: ' || format('{:,}', home_size_sqft) || ' sqft' end",
    "case when lot_size_acres <> 0 then format('Lot: {:.1f} acres', lot_size_acres) end",
    _line_sql("Financing eligible: ", _TRUTH("financing_eligibility")),
    "case when not financing_eligibility then " + _line_sql("  Reason: ", "financing_eligibility_explanation") + " end",
    _line_sql("Quality: ", _list_sql({"kitchen_quality": "Kitchen", "bathroom_quality": "Bathroom", "general_interior_quality": "Interior", "general_exterior_quality": "Exterior", "house_style": "Style"})),
    _line_sql("Characteristics: ", _list_sql({"privacy_level": "Privacy", "road_exposure": "Road exposure", "view_rating": "View", "view_type": "View type", "land_usability": "Land usability", "waterfront_quality": "Waterfront", "vegetation_density": "Vegetation"})),
    _line_sql("Dedicated office: ", _TRUTH("dedicated_office")),
    "'Negative features severity: ' || negative_features_severity || '/5'",
    "case when negative_features_list <> 'None identified' then " + _line_sql("  Negatives: ", "negative_features_list") + " end",
    "'Positive features score: ' || positive_features_score || '/5'",
    "case when positive_features_list <> 'Standard features only' then " + _line_sql("  Positives: ", "positive_features_list") + " end",
    _line_sql("Climate risks (1-10): ", _list_sql({r: r.split("_")[0].capitalize() for r in scoring.RISKS})),
    _line_sql("Schools: ", f"concat_ws(', ', {_SCHOOLS_SQL})"),
    _line_sql("Crime per 100k: ", "concat_ws(' ', format('violent={:.0f}', round_even(violent_100k, 0)), format('property={:.0f}', round_even(property_100k, 0)))"),
    "case when coalesce(grocery_name, '') <> '' then 'Grocery: ' || grocery_name || ' (' || drive_time || ' min drive)' else 'Grocery drive time: ' || drive_time || ' min' end",
    _line_sql("Assessment: ", "general_assessment"),
]


@register(f"WITH {BASE_SQL}, told AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _SAID.items())} FROM base) SELECT zpid, concat_ws(chr(10), {', '.join(_SUMMARY_LINES)}) AS summary FROM told")
def listing_summaries(spark: SparkSession, d: str) -> DataFrame:
    return _base(spark, d).withColumns({n: F.expr(e) for n, e in _SAID.items()}).select("zpid", text.listing_summary().alias("summary"))


# --- bins ------------------------------------------------------------------------------------


def _case(name: str, tests: list[tuple[str, object]], other: object, null: object) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"case when {name} IS NULL then {lit(null)} " + " ".join(f"when {name} {t} then {lit(v)}" for t, v in tests) + f" else {lit(other)} end"


_PAL = bins.PALETTE
_DRIVE = _case("drive_time", [(f"< {c}", v) for c, v in zip((5, 10, 20, 40), _PAL)], _PAL[4], bins.GREY)
_SCOL = _case("school", [(f">= {c}", v) for c, v in zip((8.5, 7.0, 5.5, 4.0), _PAL)], _PAL[4], bins.GREY)
_ICON = "list_value(" + ", ".join(f"'{i}'" for i in bins.RISK_ICONS) + ")[cast(least(greatest(round_even(risk, 0), 0), 4) as int) + 1]"
_FIXED = _case("raw", [("<= 1000", 4), ("<= 2000", 3), ("<= 3000", 2), ("<= 4000", 1)], 0, "NULL").replace("'NULL'", "NULL")


@register(f"WITH {BASE_SQL}, x AS (SELECT zpid, drive_time, rating, ai_rank, elementary_school_rating AS school, cast(flood_risk_severity as double) / 2e0 AS risk, {COMPOSITE_SQL['avg_crime_severity_raw']} AS raw FROM base) SELECT zpid, {_DRIVE} AS drive_color, {_SCOL} AS school_color, case when risk IS NULL then '❓' else {_ICON} end AS risk_icon, {_FIXED} AS crime_level, case rating when 'yes' then '#48bb78' when 'maybe' then '#ed8936' when 'no' then '#f56565' else '#cbd5e0' end AS marker, coalesce(ai_rank, 99999) AS sort_rank FROM x")
def bins_fixed(spark: SparkSession, d: str) -> DataFrame:
    raw = scoring.composites(_P)["avg_crime_severity_raw"]
    return _base(spark, d).select(
        "zpid", bins.drive_time_colour(F.col("drive_time")).alias("drive_color"), bins.school_colour(F.col("elementary_school_rating")).alias("school_color"),
        bins.icon(F.col("flood_risk_severity") / 2.0, bins.RISK_ICONS).alias("risk_icon"), bins.crime_level_fixed(raw).alias("crime_level"),
        bins.marker_colour(F.col("rating")).alias("marker"), bins.rank_sort_key(F.col("ai_rank")).alias("sort_rank"),
    )


@register(f"WITH {BASE_SQL}, x AS (SELECT zpid, {COMPOSITE_SQL['avg_crime_severity_raw']} AS raw FROM base), e AS (SELECT min(raw) AS lo, max(raw) AS hi FROM x) SELECT zpid, cast(case when raw IS NULL then NULL when hi = lo then 2 else 4 - least(4, floor((raw - lo) / (hi - lo) * 5e0)) end as int) AS crime_icon_level FROM x CROSS JOIN e")
def bins_range(spark: SparkSession, d: str) -> DataFrame:
    df = _base(spark, d).select("zpid", scoring.composites(_P)["avg_crime_severity_raw"].alias("avg_crime_severity_raw"))
    return bins.with_crime_levels(df).select("zpid", "crime_icon_level")


@register(f"WITH {BASE_SQL}, e AS (SELECT min(price) AS lo, max(price) AS hi FROM base WHERE rating = '') SELECT zpid, cast(case when rating <> '' OR price IS NULL then NULL when hi <= lo then 120 else floor(least(greatest((price - lo) / (hi - lo), 0e0), 1e0) * 120e0 + 0.5e0) end as int) AS hue FROM base CROSS JOIN e")
def bins_hue(spark: SparkSession, d: str) -> DataFrame:
    return bins.with_hue(_base(spark, d), "price").select("zpid", "hue")


@register("WITH p AS (SELECT cast(embedding[1] as double) AS la, cast(embedding[2] as double) AS lo FROM embeddings), a AS (SELECT count(*) AS n, avg(la) AS cla, avg(lo) AS clo, min(la) AS s, max(la) AS n2, min(lo) AS w, max(lo) AS e FROM p WHERE la <> 0 AND lo <> 0) SELECT n AS n_points, round(cla, 6) AS center_lat, round(clo, 6) AS center_lon, round(s - (n2 - s) * 0.1e0, 6) AS south, round(n2 + (n2 - s) * 0.1e0, 6) AS north, round(w - (e - w) * 0.1e0, 6) AS west, round(e + (e - w) * 0.1e0, 6) AS east FROM a")
def map_center(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("latitude"), F.col("embedding")[1].cast("double").alias("longitude"))
    return _rounded(listings.map_centre(places), ["n_points"], ["center_lat", "center_lon", "south", "north", "west", "east"])


# --- merges ----------------------------------------------------------------------------------


def _changes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    rating = F.when(kind == "purchase", "yes").when(kind == "view", "no").when(kind == "click", "maybe").when(kind == "refund", "").otherwise("bogus")
    return table(spark, d, "events").select(F.col("user_id").alias("zpid"), rating.alias("rating"), F.col("ts").alias("updated_at"), "event_id")


_CHANGES = "changes AS (SELECT user_id AS zpid, case event_type when 'purchase' then 'yes' when 'view' then 'no' when 'click' then 'maybe' when 'refund' then '' else 'bogus' end AS rating, ts AS updated_at, event_id FROM events)"


@register(f"WITH {_CHANGES}, old AS (SELECT s_suppkey AS zpid, 'no' AS rating FROM supplier), v AS (SELECT *, row_number() OVER (PARTITION BY zpid ORDER BY updated_at DESC, event_id DESC) AS k FROM changes WHERE rating IN ('yes', 'no', 'maybe', '')), l AS (SELECT * FROM v WHERE k = 1) SELECT zpid, rating FROM old WHERE zpid NOT IN (SELECT zpid FROM l) UNION ALL SELECT zpid, rating FROM l WHERE rating <> ''")
def lww_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("zpid"), F.lit("no").alias("rating"))
    return merge.upsert(old, _changes(spark, d), "zpid", "rating", ["updated_at", "event_id"], ("yes", "no", "maybe"))


@register("WITH rows AS (SELECT s_suppkey AS o_orderkey, s_acctbal AS o_totalprice FROM supplier) SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM rows) UNION ALL SELECT o_orderkey, o_totalprice, NULL FROM rows")
def full_replace(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("o_orderkey"), F.col("s_acctbal").alias("o_totalprice"))
    return merge.replace_rows(base, rows, "o_orderkey")


_NOW = "2020-01-01 00:00:00"


@register(f"SELECT o_orderkey, case when s_suppkey % 2 = 0 AND s_suppkey IS NOT NULL then s_acctbal else o_totalprice end AS o_totalprice, coalesce(case when s_suppkey % 3 = 0 then 'S' end, o_orderstatus) AS o_orderstatus, case when s_suppkey IS NULL then o_orderdate else TIMESTAMP '{_NOW}' end AS o_orderdate FROM orders LEFT JOIN supplier ON o_orderkey = s_suppkey")
def partial_update(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    k = F.col("s_suppkey")
    changes = table(spark, d, "supplier").select(k.alias("o_orderkey"), F.when(k % 2 == 0, F.col("s_acctbal")).alias("o_totalprice"), F.when(k % 3 == 0, "S").alias("o_orderstatus"))
    return merge.partial_update(base, changes, "o_orderkey", ["o_totalprice", "o_orderstatus"], "o_orderdate", F.lit(_NOW).cast("timestamp_ntz"))


@register("WITH q AS (SELECT s_suppkey AS zpid, 0::bigint AS since FROM supplier), asked AS (SELECT user_id AS zpid, min(event_id) AS since FROM events GROUP BY 1) SELECT zpid, since FROM q UNION ALL SELECT zpid, since FROM asked WHERE zpid NOT IN (SELECT zpid FROM q) AND zpid NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def queue_insert(spark: SparkSession, d: str) -> DataFrame:
    queue = table(spark, d, "supplier").select(F.col("s_suppkey").alias("zpid"), F.lit(0).cast("long").alias("since"))
    asked = table(spark, d, "events").select(F.col("user_id").alias("zpid"), F.col("event_id").alias("since"))
    known = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("zpid"))
    return merge.enqueue(queue, asked, known, "zpid", ["since"])


@register("SELECT c_custkey AS zpid FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def queue_remove(spark: SparkSession, d: str) -> DataFrame:
    return merge.dequeue(table(spark, d, "customer").select(F.col("c_custkey").alias("zpid")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("zpid")), "zpid")


@register("SELECT zpid, sum(rank) AS rank_sum FROM (SELECT p_partkey AS zpid, p_size AS rank FROM part UNION ALL SELECT l_partkey, l_linenumber FROM lineitem) GROUP BY zpid")
def rank_sums(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").select(F.col("p_partkey").alias("zpid"), F.col("p_size").cast("int").alias("rank"))
    b = table(spark, d, "lineitem").select(F.col("l_partkey").alias("zpid"), F.col("l_linenumber").cast("int").alias("rank"))
    return a.unionByName(b).groupBy("zpid").agg(F.sum("rank").alias("rank_sum"))


def _learned(spark: SparkSession, d: str) -> tuple[dict[str, float], dict[str, object]]:
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    scored = s.select(k.alias("zpid"), ((F.col("s_acctbal") + 1000) / 110.0).alias("price_score"), (F.col("s_nationkey") * 4.0).alias("beds_score"), (k % 50 * 2).cast("double").alias("drive_time_score"))
    rated = s.select(k.alias("zpid"), F.when(F.col("s_acctbal") > 6000, "yes").when(F.col("s_acctbal") > 2000, "maybe").otherwise("no").alias("rating"))
    return learning.learned_weights(scored, rated)


@register()
def learn_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights learned from the suppliers' ratings; checked by properties, not by SQL."""
    weights, _ = _learned(spark, d)
    return spark.createDataFrame(sorted((k, float(w)) for k, w in weights.items()), "feature string, weight double")


_OWN_SCORES = "learnt AS (SELECT s_suppkey AS zpid, (s_acctbal + 1000) / 110e0 AS price, s_nationkey * 4e0 AS beds, cast(s_suppkey % 50 * 2 as double) AS drive, case when s_acctbal > 6000 then 2 when s_acctbal > 2000 then 1 else 0 end AS v FROM supplier)"


@register(
    f"WITH {_OWN_SCORES}, s AS (SELECT v, price * {float(DEFAULT_WEIGHTS['price'])!r}e0 + beds * {float(DEFAULT_WEIGHTS['beds'])!r}e0 + (100e0 - drive) * {float(DEFAULT_WEIGHTS['drive_time'])!r}e0 AS s FROM learnt)"
    " SELECT count(*) AS n_pairs, (SELECT count(*) FROM learnt) AS n_rated, round(sum(greatest(0e0, 1.12e0 - (a.v - b.v) * (a.s - b.s))), 4) AS loss_before, true AS no_higher, true AS held FROM s a JOIN s b ON a.v > b.v"
)
def learn_report(spark: SparkSession, d: str) -> DataFrame:
    """What learning from the suppliers' ratings starts from, and that it doesn't raise the loss and keeps the box."""
    weights, told = _learned(spark, d)
    row = (told["n_pairs"], told["n_rated"], round(told["loss_before"], 4), told["loss_after"] <= told["loss_before"], all(abs(w) <= learning.MAX_WEIGHT for w in weights.values()))
    return spark.createDataFrame([row], "n_pairs long, n_rated long, loss_before double, no_higher boolean, held boolean")


@register(f"WITH {TOTAL_SQL}, ends AS (SELECT min({COMPOSITE_SQL['avg_crime_severity_raw']}) AS lo, max({COMPOSITE_SQL['avg_crime_severity_raw']}) AS hi FROM totals WHERE financing_eligibility), x AS (SELECT *, {COMPOSITE_SQL['avg_crime_severity_raw']} AS raw FROM totals WHERE financing_eligibility) SELECT zpid, rating, status, round(total_score, 6) AS total_score, cast(case when raw IS NULL then NULL else 4 - least(4, floor((raw - lo) / (hi - lo) * 5e0)) end as int) AS crime_icon_level FROM x CROSS JOIN ends WHERE rating IN ('yes', 'maybe', '') AND status = 'Active' AND (rating <> '' OR total_score >= 40)")
def listing_view(spark: SparkSession, d: str) -> DataFrame:
    """The whole view: scores, filters, display and threshold in their order."""
    base = _base(spark, d).withColumns({"full_address": F.lit("1 A St, Bend, OR 97701")})
    ratings = base.select("zpid", F.nullif("rating", F.lit("")).alias("rating"))
    notes = base.select("zpid", F.lit("n").alias("note")).where("zpid % 2 = 0")
    rows, _ = listings.listing_view(base.drop("rating"), ratings, notes, QuerySpec(statuses=("Active",), score_threshold=40))
    return _rounded(rows, ["zpid", "rating", "status", "crime_icon_level"], ["total_score"])


@register(f"""WITH {TOTAL_SQL} SELECT '{{"zpid":' || zpid || ',"status":' || coalesce(cast(to_json(status) as varchar), 'null') || ',"total_score":' || coalesce(cast(round(total_score, 6) as varchar), 'null') || '}}' AS record FROM totals""")
def listing_records(spark: SparkSession, d: str) -> DataFrame:
    from loftline.sources.tables import records

    return records(_rounded(_scored(spark, d), ["zpid", "status"], ["total_score"]))
