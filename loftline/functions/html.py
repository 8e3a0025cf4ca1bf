"""Fields of listing pages that were fetched elsewhere."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loftline.functions.text import listing_status

DROPPED_TAGS = ("script", "style", "nav", "header", "footer")
#: What image addresses of a listing contain.
IMAGE_SIZES = ("_1536", "_1024", "cc_ft_", "uncropped_scaled_within", "p_f")
SQFT_PER_ACRE = 43560.0
#: Phrases of pages that hold a challenge and no listing.
CHALLENGES = ("access to this page has been denied", "verify you're a human", "press & hold", "unusual traffic", "captcha", "perimeterx")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _whole(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("int")


def title(html: Column) -> Column:
    return F.when(html.rlike("(?is)<title>.*?</title>"), F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1)).otherwise("N/A")


def description_fields(html: Column) -> dict[str, Column]:
    """Fields of the meta description; each is null where it isn't stated."""
    text = _found(html, '<meta name="description" content="([^"]+)"')
    rooms = r"(\d+) beds?, (\d+(?:\.\d+)?) baths?"
    return {
        "description": text,
        "photo_count": _found(text, r"has (\d+) photos").try_cast("int"),
        "price": _whole(_found(text, r"\$(\d+(?:,\d+)*)")),
        "beds": _found(text, rooms, 1).try_cast("int"),
        "baths": _found(text, rooms, 2).try_cast("double"),
        "home_size_sqft": _whole(_found(text, r"(?i)(\d+(?:,\d+)*)\s+(?:square\s+)?feet")),
        "full_address": F.trim(_found(text, r"located at ([^,]+(?:,[^,]+)*)")),
        "year_built": _found(text, r"built in (\d{4})").try_cast("int"),
    }


#: Wanted fields of the embedded property, by their paths, with their types.
_PROPERTY = {
    "zpid": ("$.zpid", "bigint"),
    "home_type": ("$.homeType", "string"),
    "property_type": ("$.propertyType", "string"),
    "status": ("$.homeStatus", "string"),
    "days_listed": ("$.daysOnZillow", "int"),
    "latitude": ("$.latitude", "double"),
    "longitude": ("$.longitude", "double"),
    "zip_code": ("$.address.zipcode", "string"),
    "county": ("$.address.county", "string"),
    "lot_size_sqft": ("$.lotSize", "double"),
}


def embedded_property(html: Column) -> Column:
    """The property of the first cached entry that has one, as a variant; null where the page's JSON is missing or malformed.

    Entries that hold something else, and fields of another type, don't spoil the rest.
    """
    raw = _found(html, '(?s)<script id="__NEXT_DATA__" type="application/json">(.+?)</script>')
    cache = F.try_variant_get(F.try_parse_json(raw), "$.props.pageProps.gdpClientCache", "string")
    entries = F.map_values(F.try_variant_get(F.try_parse_json(cache), "$", "map<string,variant>"))
    found = F.transform(entries, lambda e: F.try_variant_get(e, "$.property", "variant"))
    return F.try_element_at(F.filter(found, lambda p: p.isNotNull() & ~F.is_variant_null(p) & F.schema_of_variant(p).startswith("OBJECT")), F.lit(1))


def status_pill(html: Column) -> Column:
    """Text, under 50 characters, of the first element whose class names the gallery status."""
    texts = F.transform(F.regexp_extract_all(html, F.lit(r'(?s)class="[^"]*GalleryStatus[^"]*"[^>]*>(.*?)</'), F.lit(1)), lambda t: F.trim(F.regexp_replace(t, "<[^>]*>", "")))
    return F.try_element_at(F.filter(texts, lambda t: (t != "") & (F.length(t) < 50)), F.lit(1))


def listing_fields(pages: DataFrame) -> DataFrame:
    """All fields of each page (``html``), as columns beside what is there."""
    html = F.col("html")
    held = pages.withColumn("_property", embedded_property(html))
    got = {n: F.try_variant_get("_property", path, kind) for n, (path, kind) in _PROPERTY.items()}
    fields = description_fields(html) | got | {
        "status": F.coalesce(listing_status(got["status"]), listing_status(status_pill(html))),
        "lot_size_acres": got["lot_size_sqft"] / SQFT_PER_ACRE,
    }
    return held.withColumns(fields).drop("_property")


def text_lines(html: Column) -> Column:
    """Visible text, a line for each run between tags; boilerplate elements dropped."""
    body = html
    for tag in DROPPED_TAGS:
        body = F.regexp_replace(body, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "\n")
    body = F.regexp_replace(F.regexp_replace(body, "(?s)<!--.*?-->|<![^>]*>", "\n"), "(?s)<[^>]+>", "\n")
    for mark, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(mark), F.lit(char))
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.array_join(lines, "\n")


def is_challenge(html: Column) -> Column:
    """Whether the title or the visible text has a phrase of a challenge page, which has no listing to parse."""
    shown = F.lower(F.concat_ws("\n", title(html), text_lines(html)))
    return F.coalesce(shown.rlike("|".join(map(re.escape, CHALLENGES)).replace(r"\ ", " ")), F.lit(False))


def image_urls(urls: Column, host: str) -> Column:
    """Distinct addresses of listing images, without their query strings."""
    sizes = "|".join(map(re.escape, IMAGE_SIZES))
    return F.array_distinct(F.transform(F.filter(urls, lambda u: u.contains(host) & u.rlike(sizes)), lambda u: F.element_at(F.split(u, "[?]"), 1)))


def absolute(href: Column, host: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(host), href))


def listing_links(links: DataFrame, host: str) -> DataFrame:
    """Distinct listing links (``href``), absolute, in order."""
    wanted = links.where(F.col("href").contains("/homedetails/") | F.col("href").contains("/zpid/"))
    return wanted.select(absolute(F.col("href"), host).alias("url")).distinct().orderBy("url")


def next_page(links: DataFrame, host: str) -> DataFrame:
    """Where paging goes on: links that are neither disabled nor empty, with ``url`` beside what is there."""
    live = (F.coalesce(F.col("aria_disabled"), F.lit("")) != "true") & F.col("href").isNotNull() & ~F.col("href").isin("", "#")
    return links.where(live).withColumn("url", absolute(F.col("href"), host))


def card_prices(html: Column) -> Column:
    """Of a result page: array of (zpid, price) of its cards."""
    cards = F.regexp_extract_all(html, F.lit(r'(?s)(<article[^>]*data-test="property-card".*?</article>)'), F.lit(1))
    each = F.transform(
        cards,
        lambda c: F.struct(
            F.regexp_extract(c, r"/(\d+)_zpid/", 1).try_cast("long").alias("zpid"),
            _whole(F.regexp_extract(c, r'(?s)data-test="property-card-price"[^>]*>[^<]*?\$([\d,]+)', 1)).alias("price"),
        ),
    )
    return F.filter(each, lambda p: p["zpid"].isNotNull() & p["price"].isNotNull())


def short_of_photos(stated: Column, found: Column, most: int = 80) -> Column:
    """Whether clearly fewer photos were found than the page states."""
    return F.coalesce((stated > 0) & (found < F.least(stated, F.lit(most)) - 2), F.lit(False))
