import pytest
from pyspark.sql import functions as F

from loftline.functions import html, text


def apply(spark, values, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r["y"] for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_states_and_counties(spark):
    assert apply(spark, ["Ore.", "wash", "CA", None], text.state) == ["OREGON", "WASHINGTON", None, None]
    assert apply(spark, ["Lane County ", " county", "", None], text.county) == ["Lane", "county", None, None]
    assert apply(spark, [".Lane County, Oregon", "x"], lambda c: F.concat_ws("/", *text.county_and_state(c))) == ["Lane/Oregon", ""]


def test_addresses(spark):
    given = ["939 Buckhorn Rd, Roseburg, OR 97470 MLS #16017", "1100 Cantrall Rd, Medford, OR, 97530", "a, b", "OR x, b, c", None, ""]
    df = lambda c: F.concat_ws("/", *text.city_state(c))
    assert apply(spark, given, df) == ["Roseburg/OREGON", "Medford/OREGON", "", "", "", ""]
    shown = ["1 A St, Bend, OR 97701", "x, Bend", None, "nan", "x", "a,, b, , c9d e"]
    assert apply(spark, shown, text.display_city) == ["Bend, OR", "Bend", "", "", "", "b, CD"]


def test_chains_and_minutes(spark):
    names = ["TRADER JOE’S #5", "Sam's Wholesale Club", "Targeted Foods", "", None, "Whole Natural Foods Market"]
    assert apply(spark, names, text.is_chain) == [True, True, False, False, False, True]
    assert apply(spark, ["150", "90", "210"], lambda c: text.drive_minutes(c.cast("int"))) == [2, 2, 4]


def test_lines(spark):
    long = "word " * 26 + "privacy"
    given = ["a line of words x\nshort", "privacy of words x", f"privacy of the line\n{long}", None, ""]
    assert apply(spark, given, text.kept_lines) == ["a line of words x", "privacy of words x", long.strip(), None, ""]
    assert apply(spark, ["a  b\n c", "x" * 221, None], text.preview) == ["a b c", "x" * 220 + "...", ""]


def test_header_names(spark):
    df = spark.createDataFrame([(1, 2)], "`Violent\ncrime` int, `Non-negligent   Homicide ` int")
    assert text.normalised_columns(df).columns == ["violent crime", "non negligent homicide"]


PAGE = """<html><meta name="description" content="This home has 12 photos, is priced at $1,250,000 and is located at 1 A St, Bend, OR. 3 beds, 2.5 baths, 1,800 Square Feet, built in 1999">
<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"gdpClientCache": {"a": {"x": 1}, "b": {"property": {"zpid": 7, "homeStatus": " SOLD ", "latitude": 44.5, "address": {"zipcode": "97701"}, "lotSize": 87120}}}}}}</script></html>"""


def test_listing_fields(spark):
    pages = spark.createDataFrame(
        [(1, PAGE), (2, '<script id="__NEXT_DATA__" type="application/json">{bad</script>'), (3, '<div class="StyledGalleryStatusContainer"><span>Off market</span></div>'), (4, None)], "k int, html string"
    )
    a, b, c, d = html.listing_fields(pages).orderBy("k").collect()
    assert (a["photo_count"], a["price"], a["beds"], a["baths"], a["home_size_sqft"], a["year_built"]) == (12, 1250000, 3, 2.5, 1800, 1999)
    assert (a["zpid"], a["status"], a["zip_code"], a["lot_size_acres"]) == (7, "SOLD", "97701", pytest.approx(2.0))
    assert b["zpid"] is None and c["status"] == "Off market" and d["price"] is None


def test_page_text_and_links(spark):
    assert apply(spark, ["<title>A\nB</title>", "none"], html.title) == ["A\nB", "N/A"]
    assert apply(spark, ["<nav>x</nav><p>One &amp; two</p><script>y()</script><b>three</b>"], html.text_lines) == ["One & two\nthree"]
    links = spark.createDataFrame([("/homedetails/1_zpid/",), ("https://h/zpid/2",), ("/other",), ("/homedetails/1_zpid/",)], "href string")
    assert [r["url"] for r in html.listing_links(links, "https://h").collect()] == ["https://h/homedetails/1_zpid/", "https://h/zpid/2"]
    paging = spark.createDataFrame([("/2", None), ("#", None), ("/3", "true")], "href string, aria_disabled string")
    assert [r["url"] for r in html.next_page(paging, "https://h").collect()] == ["https://h/2"]
    assert apply(spark, ["https://h/homedetails/x/123_zpid/", "https://h/"], text.id_of_url) == [123, None]
    card = '<article data-test="property-card"><a href="/x/5_zpid/"></a><span data-test="property-card-price">$1,200</span></article>'
    assert apply(spark, [card], html.card_prices)[0][0].asDict() == {"zpid": 5, "price": 1200}
