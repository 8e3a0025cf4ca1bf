"""More registered queries: page fields, links, enrichment jobs, requests, records and merges.

Pages, sheets and requests are built from the driver's tables by one list of parts,
which reads as a Column here and as SQL there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loftline.catalog import ORACLE, _base, _rounded, register
from loftline.functions import html, text
from loftline.operators import joins, merge, ranks
from loftline.plans import enrichment, listings
from loftline.sources import tables
from loftline.sources.tables import table
from loftline.spec import QuerySpec

#: A string is text; a tuple holds an expression that both engines read alike.
Parts = list[str | tuple[str]]


def _built(parts: Parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.expr(p[0]).cast("string") for p in parts])


def _sql(parts: Parts) -> str:
    return " || ".join("'" + p.replace("'", "''") + "'" if isinstance(p, str) else f"cast({p[0]} as varchar)" for p in parts)


# --- joins of the base -----------------------------------------------------------------------


@register(
    "SELECT p.zpid, p.price, f.beds, c.violent_100k, c.property_100k, g.drive_time, g.grocery_name, g.grocery_rating, g.grocery_ratings_count, l.latitude, l.longitude, r.ai_rank FROM (SELECT o_orderkey AS zpid, o_totalprice AS price FROM orders) p"
    " LEFT JOIN (SELECT l_orderkey AS zpid, cast(count(*) as int) AS beds FROM lineitem GROUP BY 1) f USING (zpid)"
    " LEFT JOIN (SELECT p_partkey AS zpid, p_retailprice AS violent_100k, cast(p_size as double) AS property_100k FROM part) c USING (zpid)"
    " LEFT JOIN (SELECT s_suppkey AS zpid, s_nationkey AS drive_time, s_name AS grocery_name, s_acctbal AS grocery_rating, cast(s_suppkey * 3 as int) AS grocery_ratings_count FROM supplier) g USING (zpid)"
    " LEFT JOIN (SELECT c_custkey AS zpid, c_nationkey + 0.5e0 AS latitude, c_acctbal AS longitude FROM customer) l USING (zpid)"
    " LEFT JOIN (SELECT p_partkey AS zpid, p_size AS ai_rank FROM part) r USING (zpid)"
)
def listing_base(spark: SparkSession, d: str) -> DataFrame:
    return joins.listing_base(
        table(spark, d, "orders").selectExpr("o_orderkey AS zpid", "o_totalprice AS price"),
        table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("zpid")).agg(F.count("*").cast("int").alias("beds")),
        table(spark, d, "part").selectExpr("p_partkey AS zpid", "p_retailprice AS violent_100k", "cast(p_size as double) AS property_100k"),
        table(spark, d, "supplier").selectExpr("s_suppkey AS zpid", "s_nationkey AS drive_time", "s_name AS name", "s_acctbal AS rating", "cast(s_suppkey * 3 as int) AS user_ratings_total"),
        table(spark, d, "customer").selectExpr("c_custkey AS zpid", "c_nationkey + 0.5D AS latitude", "c_acctbal AS longitude"),
        table(spark, d, "part").selectExpr("p_partkey AS zpid", "p_size AS ai_rank"),
    )


@register("SELECT o_orderkey AS zpid, '' AS rating, '' AS note FROM orders")
def hidden_user_data(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").selectExpr("o_orderkey AS zpid")
    return joins.with_user_data(o, o.withColumn("rating", F.lit("yes")), o.withColumn("note", F.lit("n")), allowed=False)


@register("SELECT 'https://x/' || s_suppkey AS url, cast(0 as int) AS part, s_suppkey AS pos FROM supplier UNION ALL SELECT 'https://x/' || c_custkey, 1, c_custkey FROM customer")
def queue_heads(spark: SparkSession, d: str) -> DataFrame:
    queued = table(spark, d, "supplier").selectExpr("'https://x/' || s_suppkey AS url", "s_suppkey AS pos")
    found = table(spark, d, "customer").selectExpr("'https://x/' || c_custkey AS url", "c_custkey AS pos")
    return joins.queue_heads(queued, found, page=1).select("url", "part", "pos")


@register("SELECT o_orderkey AS zpid, case when c.c_acctbal > 0 then round(c.c_acctbal) else o_totalprice end AS price, o_orderstatus AS status FROM orders LEFT JOIN customer c ON o_orderkey = c.c_custkey")
def update_price(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "orders").selectExpr("o_orderkey AS zpid", "o_totalprice AS price", "o_orderstatus AS status")
    changes = table(spark, d, "customer").selectExpr("c_custkey AS zpid", "case when c_acctbal > 0 then round(c_acctbal) end AS price")
    return merge.update_price(base, changes, "zpid")


# --- pages -----------------------------------------------------------------------------------

_DESCRIPTION: Parts = [
    '<html><head><meta name="description" content="This home, located at ', ("c_custkey",), " Main St, Bend, OR 97701 has ", ("c_custkey % 60",), " photos, ", ("c_nationkey % 6",), " beds, ", ("c_custkey % 4",), ".5 baths, ",
    ("c_custkey % 9 + 1",), ",", ("c_custkey % 900 + 100",), " square feet built in ", ("1900 + c_nationkey",), " for $", ("c_custkey % 800 + 100",), ',500 now"></head>',
]
_JSON: Parts = [
    '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"gdpClientCache":"{\\"k\\":{\\"property\\":{\\"zpid\\":', ("c_custkey",), ',\\"homeType\\":\\"HOUSE\\",\\"homeStatus\\":\\" FOR_SALE \\",\\"daysOnZillow\\":', ("c_nationkey",),
    ',\\"latitude\\":', ("c_nationkey",), '.25,\\"address\\":{\\"zipcode\\":\\"97', ("c_custkey % 900 + 100",), '\\",\\"county\\":\\"Lane\\"},\\"lotSize\\":', ("c_custkey * 100",), '}}}"}}}</script>',
]
_PILL: Parts = ['<div class="x GalleryStatus__y"><b>  Pending ', ("c_nationkey",), "</b></div></html>"]
#: The property is the second entry and in another order, its days aren't a number, and there are fields that nobody asks for.
_JSON_ODD: Parts = [
    '<script id="__NEXT_DATA__" type="application/json">{"more":[1],"props":{"pageProps":{"gdpClientCache":"{\\"j\\":7,\\"i\\":{\\"property\\":null},\\"k\\":{\\"property\\":{\\"lotSize\\":', ("c_custkey * 100",), ',\\"daysOnZillow\\":\\"soon\\",\\"address\\":{\\"county\\":\\"Lane\\",\\"x\\":[],\\"zipcode\\":\\"97',
    ("c_custkey % 900 + 100",), '\\"},\\"homeStatus\\":\\"SOLD\\",\\"latitude\\":', ("c_nationkey",), '.25,\\"homeType\\":\\"HOUSE\\",\\"zpid\\":', ("c_custkey",), '}}}"}}}</script>',
]
#: Cut off.
_JSON_BAD: Parts = ['<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"gdpClientCache":"{\\"k\\":{\\"property\\":{\\"zpid\\":', ("c_custkey",), "</script>"]
_JSONS = {"c_nationkey < 16": _JSON, "c_nationkey < 20": _JSON_ODD, "c_nationkey < 22": _JSON_BAD}
_PAGE_SQL = f"pages_ AS (SELECT c_custkey AS page, {_sql(_DESCRIPTION)} || case {' '.join(f'when {c} then {_sql(p)}' for c, p in _JSONS.items())} else '' end || {_sql(_PILL)} AS html FROM customer)"


def _found(pattern: str, group: int = 1) -> str:
    return "nullif(regexp_extract(html, '" + pattern.replace("'", "''") + f"', {group}), '')"


_SCRIPT = _found('<script id="__NEXT_DATA__" type="application/json">(.+?)</script>')
_CACHE = f"json_extract_string(case when json_valid({_SCRIPT}) then {_SCRIPT} end, '$.props.pageProps.gdpClientCache')"
_OF = lambda path: f"json_extract_string({_CACHE}, '$.k.property.{path}')"


@register(
    f"WITH {_PAGE_SQL} SELECT page, {_found('content=.([^>]+).>')} AS description, cast({_found(r'has (\d+) photos')} as int) AS photo_count, cast(replace({_found(r'\$(\d+(?:,\d+)*)')}, ',', '') as int) AS price,"
    f" cast({_found(r'(\d+) beds?')} as int) AS beds, cast({_found(r'beds?, (\d+\.\d+) baths')} as double) AS baths, cast(replace({_found(r'(\d+(?:,\d+)*) square feet')}, ',', '') as int) AS home_size_sqft,"
    f" nullif(regexp_extract({_found('content="([^"]+)"')}, 'located at (.+),', 1), '') AS before_last_comma, cast({_found(r'built in (\d+)')} as int) AS year_built, cast({_OF('zpid')} as bigint) AS zpid, {_OF('homeType')} AS home_type,"
    f" coalesce(trim({_OF('homeStatus')}), trim({_found('<b>([^<]+)</b>')})) AS status, try_cast({_OF('daysOnZillow')} as int) AS days_listed, cast({_OF('latitude')} as double) AS latitude, {_OF('address.zipcode')} AS zip_code, {_OF('address.county')} AS county,"
    f" cast({_OF('lotSize')} as double) AS lot_size_sqft, round(cast({_OF('lotSize')} as double) / 43560e0, 6) AS lot_size_acres FROM pages_"
)
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    script = reduce(lambda c, p: c.when(F.expr(p[0]), _built(p[1])), _JSONS.items(), F).otherwise("")
    page = F.concat(_built(_DESCRIPTION), script, _built(_PILL))
    got = html.listing_fields(table(spark, d, "customer").select(F.col("c_custkey").alias("page"), page.alias("html")))
    kept = ["page", "description", "photo_count", "price", "beds", "baths", "home_size_sqft", "year_built", "zpid", "home_type", "status", "days_listed", "latitude", "zip_code", "county", "lot_size_sqft"]
    # The stated address runs to the end of the sentence; what follows its last comma is cut for the comparison.
    return got.select(*kept, F.regexp_extract("full_address", "^(.*),", 1).alias("before_last_comma"), F.round("lot_size_acres", 6).alias("lot_size_acres"))


_CARDS: Parts = [
    '<ul><article class="a" data-test="property-card"><a href="/x/', ("c_custkey",), '_zpid/">go</a><span data-test="property-card-price" class="p">Est. $', ("c_custkey % 900 + 100",), ",", ("c_nationkey + 100",), '</span></article>\n<article data-test="property-card"><a href="/x/',
    ("c_custkey + 1",), '_zpid/"></a><span data-test="property-card-price">no price</span></article><article data-test="other"><a href="/x/7_zpid/"></a></article></ul>',
]


@register("SELECT c_custkey AS page, c_custkey AS zpid, cast((c_custkey % 900 + 100) * 1000 + c_nationkey + 100 as int) AS price FROM customer")
def card_prices(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "customer").select(F.col("c_custkey").alias("page"), F.explode(html.card_prices(_built(_CARDS))).alias("c"))
    return cards.select("page", "c.zpid", "c.price")


@register(
    "SELECT p_partkey AS zpid, 'https://img.host/' || p_partkey || '_1536.jpg|https://img.host/' || p_size || '_p_f.webp' AS urls FROM part"
)
def image_urls(spark: SparkSession, d: str) -> DataFrame:
    own = ["'https://img.host/' || p_partkey || '_1536.jpg?x=1'", "'https://img.host/' || p_partkey || '_1536.jpg'", "'https://img.host/' || p_partkey || '_64.jpg'", "'https://else/' || p_partkey || '_1536.jpg'", "'https://img.host/' || p_size || '_p_f.webp?a=b?c'"]
    urls = html.image_urls(F.array(*[F.expr(u) for u in own]), "img.host")
    return table(spark, d, "part").select(F.col("p_partkey").alias("zpid"), F.array_join(urls, "|").alias("urls"))


_HREF = "case c_nationkey % 4 when 0 then '/homedetails/' || c_nationkey when 1 then 'https://h.org/zpid/' || c_nationkey when 2 then '#' end"


@register(f"SELECT DISTINCT case when h like 'http%' then h else 'https://h.org' || h end AS url FROM (SELECT {_HREF} AS h FROM customer) WHERE contains(h, '/homedetails/') OR contains(h, '/zpid/')")
def listing_links(spark: SparkSession, d: str) -> DataFrame:
    return html.listing_links(table(spark, d, "customer").select(F.expr(_HREF).alias("href")), "https://h.org")


@register(f"SELECT zpid, case when h like 'http%' then h else 'https://h.org' || h end AS url FROM (SELECT c_custkey AS zpid, {_HREF} AS h, c_mktsegment AS m FROM customer) WHERE h IS NOT NULL AND h <> '#' AND m <> 'BUILDING'")
def next_pages(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "customer").select(F.col("c_custkey").alias("zpid"), F.expr(_HREF).alias("href"), F.when(F.col("c_mktsegment") == "BUILDING", "true").alias("aria_disabled"))
    return html.next_page(links, "https://h.org").select("zpid", "url")


@register("SELECT l_orderkey AS zpid, l_linenumber AS line, coalesce(l_quantity > 0 AND l_linenumber * 8 < least(l_quantity, 40) - 2, false) AS short FROM lineitem")
def short_of_photos(spark: SparkSession, d: str) -> DataFrame:
    short = html.short_of_photos(F.col("l_quantity"), F.col("l_linenumber") * 8, 40)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("zpid"), F.col("l_linenumber").alias("line"), short.alias("short"))


_CHALLENGE = "case c_nationkey % 5 when 0 then '<title>Access to this page has been DENIED</title>' when 1 then '<title>x</title><p>Please Press & Hold here</p>' when 2 then '<p>captcha</p>' else '<title>a home</title><script>captcha</script>' end"


_TITLE = "coalesce(regexp_extract(h, '<title>([^<]*)</title>', 1), '')"
_SHOWN = "regexp_replace(regexp_replace(h, '<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', chr(10), 'gi'), '<[^>]+>', chr(10), 'g')"


@register(f"SELECT page, regexp_matches(lower({_TITLE} || chr(10) || {_SHOWN}), '{'|'.join(html.CHALLENGES).replace(chr(39), chr(39) * 2)}') AS challenge FROM (SELECT c_custkey AS page, {_CHALLENGE} AS h FROM customer)")
def challenge_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("page"), html.is_challenge(F.expr(_CHALLENGE)).alias("challenge"))


# --- sheets ----------------------------------------------------------------------------------


@register("SELECT s_suppkey AS key, s_name AS name, s_acctbal AS amount FROM supplier")
def header_names(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "supplier").selectExpr("s_suppkey AS `Supp\nKey `", "s_name AS `  FULL-Name`", "s_acctbal AS `Amount   (net)`")
    return text.normalised_columns(raw).selectExpr("`supp key` AS key", "`full name` AS name", "`amount (net)` AS amount")


_COUNTY = """pop AS (SELECT r_name AS county, case r_regionkey % 2 when 0 then 'OREGON' else 'WASHINGTON' end AS state, cast((r_regionkey + 1) * 1000 as double) AS population FROM region),
crimes AS (SELECT r_name AS county, case r_regionkey % 2 when 0 then 'OREGON' else 'WASHINGTON' end AS state, cast(count(*) as double) AS v, cast(sum(s_suppkey) as double) AS p FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey)"""


def _county_rates(spark: SparkSession, d: str) -> DataFrame:
    """Sheets as exported: a title row, odd headers, labels like '.X County, Oregon', one sheet a state."""
    region = table(spark, d, "region")

    def population(which: int, state: str) -> DataFrame:
        rows = region.where(F.col("r_regionkey") % 2 == which).select(F.concat(F.lit("."), "r_name", F.lit(f" County, {state}")).alias("a"), ((F.col("r_regionkey") + 1) * 1000).cast("string").alias("b"))
        return tables.positional(rows.unionByName(spark.createDataFrame([(None, "no label")], "a string, b string")), {0: "county_state", 1: "population"})

    every = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    crimes = every.groupBy("r_name", "r_regionkey").agg(F.count("*").alias("v"), F.sum("s_suppkey").alias("p"))
    names = crimes.select(F.when(F.col("r_regionkey") % 2 == 0, "Ore.").otherwise("wash").alias("State"), F.concat("r_name", F.lit(" County ")).alias("County"), F.col("v").cast("string").alias("Violent\ncrime"), F.col("p").cast("string").alias("Property-crime"))
    note = names.limit(1).select(*[F.lit("footnote" if c == "State" else None).cast("string").alias(c) for c in names.columns])
    return enrichment.county_rates(tables.sheet(names.unionByName(note), "County"), enrichment.county_population(population(0, "Oregon"), population(1, "Washington")))


@register(f"WITH {_COUNTY} SELECT state, county, round(v / population * 100000, 6) AS violent_100k, round(p / population * 100000, 6) AS property_100k FROM crimes JOIN pop USING (county, state)")
def county_rates(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_county_rates(spark, d), ["state", "county"], ["violent_100k", "property_100k"])


_CITY = """city AS (SELECT case n_nationkey % 2 when 0 then 'OREGON' else 'WASHINGTON' end AS state, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS city, n_nationkey * 7 / nullif(n_nationkey * 100, 0)::double * 100000 AS v, n_nationkey * 9 / nullif(n_nationkey * 100, 0)::double * 100000 AS p FROM nation WHERE n_name NOT LIKE '% %')"""
_PLACES = """places AS (SELECT c_custkey AS zpid, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS city, case n_nationkey % 2 when 0 then 'OREGON' else 'WASHINGTON' end AS state, r_name AS county FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_name NOT LIKE '% %')"""
_CRIME_SQL = f"WITH {_COUNTY}, {_CITY}, {_PLACES}, county AS (SELECT state, county, v / population * 100000 AS v, p / population * 100000 AS p FROM crimes JOIN pop USING (county, state)) SELECT zpid, round(coalesce(city.v, county.v), 6) AS violent_100k, round(coalesce(city.p, county.p), 6) AS property_100k FROM places LEFT JOIN city USING (city, state) LEFT JOIN county ON county.county = places.county AND county.state = places.state"


def _crime_table(spark: SparkSession, d: str, unique: bool, twice: str = "false") -> DataFrame:
    nation, region = table(spark, d, "nation").where(~F.col("n_name").contains(" ")), table(spark, d, "region")
    state = F.when(F.col("n_nationkey") % 2 == 0, "OR").otherwise("Wash.")
    sheet = nation.select(state.alias("State"), F.lower("n_name").alias("City"), (F.col("n_nationkey") * 7).cast("string").alias("Violent crime"), (F.col("n_nationkey") * 9).cast("string").alias("Property crime"), (F.col("n_nationkey") * 100).cast("string").alias("Population"))
    again = nation.where(twice).select(state.alias("State"), F.lower("n_name").alias("City"), (F.col("n_nationkey") * 5).cast("string").alias("Violent crime"), (F.col("n_nationkey") * 9).cast("string").alias("Property crime"), F.lit("1000").alias("Population"))
    sheet = sheet.unionByName(again)
    place = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    addresses = place.select(F.col("c_custkey").alias("zpid"), F.concat(F.lit("1 A St, "), F.lower("n_name"), F.lit(", "), state, F.lit(" 97701")).alias("full_address"), F.concat("r_name", F.lit(" County")).alias("county"))
    out = enrichment.crime_table(addresses, enrichment.city_rates(sheet), _county_rates(spark, d), unique)
    return _rounded(out, ["zpid"], ["violent_100k", "property_100k"])


@register(_CRIME_SQL)
def crime_rates(spark: SparkSession, d: str) -> DataFrame:
    return _crime_table(spark, d, True)


#: Cities that the sheet has twice, with other figures.
_TWICE = "n_nationkey % 4 = 1"
_CRIME_ALL_SQL = _CRIME_SQL.replace("FROM nation WHERE n_name NOT LIKE '% %')", f"FROM nation WHERE n_name NOT LIKE '% %' UNION ALL SELECT 'WASHINGTON', upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)), n_nationkey * 5 / 1000e0 * 100000, n_nationkey * 9 / 1000e0 * 100000 FROM nation WHERE n_name NOT LIKE '% %' AND {_TWICE})", 1)


@register(_CRIME_ALL_SQL)
def crime_rates_all(spark: SparkSession, d: str) -> DataFrame:
    """A listing in a city that the sheet has twice has a row for each of its figures."""
    return _crime_table(spark, d, False, _TWICE)


@register(f"SELECT zpid, m.v AS violent_100k, m.p AS property_100k FROM (SELECT zpid, min(struct_pack(v := violent_100k, p := property_100k)) AS m FROM ({_CRIME_ALL_SQL}) GROUP BY zpid)")
def crime_rates_first(spark: SparkSession, d: str) -> DataFrame:
    """The same sheet, a row a listing."""
    return _crime_table(spark, d, True, _TWICE)


@register(
    "WITH s AS (SELECT l_orderkey AS zpid, l_partkey AS store, l_linenumber AS n FROM lineitem), good AS (SELECT zpid, store, n, p_name, p_size FROM s JOIN part ON store = p_partkey WHERE p_size * 10 >= 200), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zpid ORDER BY n, store) AS k FROM good) WHERE k = 1)"
    " SELECT zpid, p_name AS name, cast(round_even(cast(store as double) * 13 / 60e0, 0) as int) AS drive_time, p_size * 10 AS user_ratings_total FROM best"
)
def nearest_stores(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    stores = lines.selectExpr("l_orderkey AS zpid", "l_partkey AS store_id", "l_linenumber AS distance")
    details = table(spark, d, "part").selectExpr("p_partkey AS store_id", "p_name AS name", "p_brand AS address", "p_retailprice AS rating", "p_size * 10 AS user_ratings_total")
    drives = stores.select("zpid", "store_id", (F.col("store_id") * 13).alias("seconds")).distinct()
    return enrichment.nearest_store(table(spark, d, "orders").selectExpr("o_orderkey AS zpid"), stores, details, drives).select("zpid", "name", "drive_time", "user_ratings_total")


# --- requests, judges, records ---------------------------------------------------------------


@register(ORACLE["listing_view"])
def request_view(spark: SparkSession, d: str) -> DataFrame:
    """The listing view as a request asks for it; what is malformed there takes its default."""
    asked = {"status_filter": ["Active"], "min_score_threshold": "40", "ranking_mode": "nonsense", "ai_rank_threshold": "-5", "weight_price": "abc", "optimizer_aggressiveness": "7", "rating_filter": []}
    base = _base(spark, d).withColumn("full_address", F.lit("1 A St, Bend, OR 97701"))
    notes = base.select("zpid", F.lit("n").alias("note")).where("zpid % 2 = 0")
    rows, _ = listings.listing_view(base.drop("rating"), base.select("zpid", F.nullif("rating", F.lit("")).alias("rating")), notes, QuerySpec.from_request(asked))
    return _rounded(rows, ["zpid", "rating", "status", "crime_icon_level"], ["total_score"])


@register("SELECT zpid, cast(row_number() OVER (PARTITION BY batch ORDER BY zpid % 2, case when zpid % 2 = 0 then -score end, zpid) as int) AS batch_rank, batch FROM (SELECT p_partkey AS zpid, p_retailprice AS score, p_size AS batch FROM part)")
def outside_judge(spark: SparkSession, d: str) -> DataFrame:
    """A judge that ranks even ids only, and names one that isn't in the batch."""
    items = table(spark, d, "part").selectExpr("p_partkey AS zpid", "p_retailprice AS score", "p_size AS batch")

    def judge(frame):  # noqa: ANN001, ANN202
        even = frame[frame["zpid"] % 2 == 0].sort_values(["score", "zpid"], ascending=[False, True])
        return [-1, *even["zpid"].tolist()]

    return ranks.judge(items, judge).select("zpid", "batch_rank", "batch")


@register("SELECT '{\"zpid\":' || c_custkey || ',\"name\":\"' || c_name || '\",\"half\":' || case when c_nationkey < 9 then 'null' else (c_nationkey || '.5') end || ',\"none\":null}' AS record FROM customer")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    half = F.when(F.col("c_nationkey") < 9, F.lit(float("nan"))).otherwise(F.col("c_nationkey") + 0.5)
    return tables.records(table(spark, d, "customer").select(F.col("c_custkey").alias("zpid"), F.col("c_name").alias("name"), half.alias("half"), F.lit(None).cast("string").alias("none")))


_FEATURES: Parts = ['{"beds": ', ("s_nationkey",), ', "baths": ', ("s_nationkey",), '.5, "view_type": "', ("s_name",), '", "dedicated_office": true, "kitchen_quality": null, "unknown": 1}']
#: In another order, with a list where a whole number should be, and cut off.
_FEATURES_ODD: Parts = ['{"more": {"beds": 1}, "view_type": "', ("s_name",), '", "kitchen_quality": [3], "dedicated_office": true, "baths": ', ("s_nationkey",), '.5, "beds": ', ("s_nationkey",), "}"]
_FEATURES_BAD: Parts = ['{"beds": ', ("s_nationkey",), ', "baths": ']


@register("SELECT cast(s_suppkey as int) AS zpid, case when ok then s_nationkey end AS beds, case when ok then s_nationkey + 0.5e0 end AS baths, case when ok then s_name end AS view_type, case when ok then true end AS dedicated_office, cast(null as int) AS kitchen_quality FROM (SELECT *, s_suppkey % 3 < 2 AS ok FROM supplier)")
def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("zpid"), F.when(k == 0, _built(_FEATURES)).when(k == 1, _built(_FEATURES_ODD)).otherwise(_built(_FEATURES_BAD)).alias("arguments"))
    return tables.feature_rows(rows).select("zpid", "beds", F.col("baths").cast("double").alias("baths"), "view_type", "dedicated_office", "kitchen_quality")


@register("SELECT page, pos FROM (SELECT o_orderkey AS page, l_linenumber AS pos FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE page > 100 OR page = 100 AND pos >= 2")
def resumed_links(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "lineitem").selectExpr("l_orderkey AS page", "l_linenumber AS pos")
    return tables.resumed(links, 100, 2)
