"""Text, address and number functions, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of the states that are told apart.
STATES = {"OREGON": ("OR", "ORE", "OREGON"), "WASHINGTON": ("WA", "WASH", "WASHINGTON")}

#: Chains accepted whatever their number of reviews.
CHAINS = (
    "Albertsons", "Safeway", "Fred Meyer", "QFC", "WinCo Foods", "Walmart", "Costco", "Target", "Sam's Club", "Trader Joe's", "Whole Foods Market",
    "Grocery Outlet", "New Seasons Market", "Market of Choice", "PCC Community Markets", "Haggen", "Yoke's Fresh Market", "Rosauers", "Bi-Mart",
    "Sprouts Farmers Market", "Natural Grocers", "Raley's", "Uwajimaya", "99 Ranch Market", "H Mart", "IGA",
)

#: Short lines with one of these are boilerplate.
BLOCKED = ("cookie", "privacy", "terms", "consent", "do not sell")


def normalised_columns(df: DataFrame) -> DataFrame:
    """Header names: breaks and hyphens to spaces, runs squeezed, trimmed, lower case."""
    return df.toDF(*[re.sub(r"\s+", " ", re.sub(r"[\n-]", " ", c)).strip().lower() for c in df.columns])


def _or_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def state(value: Column) -> Column:
    token = F.upper(F.regexp_replace(value, "[^A-Za-z]", ""))
    out = F.lit(None).cast("string")
    for name, spellings in STATES.items():
        out = F.when(token.isin(*spellings), F.lit(name)).otherwise(out)
    return out


def city(value: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(value, "_", " "), r"\s+", " ")))


def county(value: Column) -> Column:
    return _or_null(F.trim(F.regexp_replace(F.trim(value), r"(?i)\s+county\s*$", "")))


def _parts(address: Column) -> Column:
    return F.transform(F.split(address, ","), lambda p: F.trim(p))


def _first_token(part: Column) -> Column:
    return F.element_at(F.split(part, r"\s+"), 1)


def city_state(address: Column) -> tuple[Column, Column]:
    """City and state: the first part, but not the very first, that opens with a known state, and the part before it."""
    parts = _parts(address)
    states = F.transform(parts, lambda p: state(_first_token(p)))
    hit = F.filter(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.element_at(states, i + 1).isNotNull())
    at = F.when(F.size(parts) >= 3, F.try_element_at(hit, F.lit(1)))
    return city(F.try_element_at(parts, at)), F.try_element_at(states, at + 1)


def display_city(address: Column) -> Column:
    """'City, ST' of an address, empty parts dropped; the second part alone where there are two; else ''."""
    parts = F.filter(_parts(address), lambda p: p != "")
    token = _first_token(F.try_element_at(parts, F.lit(3)))
    letters = F.regexp_replace(token, r"[^\p{L}]", "")
    short = F.upper(F.substring(F.when(letters != "", letters).otherwise(token), 1, 2))
    shown = F.when(F.size(parts) >= 3, F.concat(F.element_at(parts, 2), F.lit(", "), short)).when(F.size(parts) == 2, F.element_at(parts, 2)).otherwise("")
    return F.when(address.isNull() | (F.lower(F.trim(address)) == "nan"), "").otherwise(shown)


def county_and_state(label: Column) -> tuple[Column, Column]:
    """Of labels like '.Lane County, Oregon'."""
    pattern = r"\.(.+) County, (.+)"
    return _or_null(F.regexp_extract(label, pattern, 1)), _or_null(F.regexp_extract(label, pattern, 2))


def number(value: Column) -> Column:
    return value.try_cast("double")


def rate_per_100k(count: Column, population: Column) -> Column:
    """Null where the population is 0."""
    return F.try_divide(number(count), number(population)) * 100_000.0


def is_chain(name: Column) -> Column:
    """Whether a store's name, without marks, holds the words of a known chain in order."""
    clean = F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", "")
    words = [re.sub(r"[^\w\s]", "", c.lower()).split() for c in CHAINS]
    pattern = "|".join(r"\b" + r"\b.*?\b".join(w) + r"\b" for w in words)
    return F.coalesce(clean.rlike(f"(?U)(?:{pattern})"), F.lit(False))


def drive_minutes(seconds: Column) -> Column:
    """Minutes, half to even."""
    return F.bround(seconds.cast("double") / 60.0, 0).cast("int")


def listing_status(value: Column) -> Column:
    return _or_null(F.trim(value))


def id_of_url(url: Column) -> Column:
    return _or_null(F.regexp_extract(url, r"/(\d+)_zpid/", 1)).cast("long")


def kept_lines(text: Column, most: int = 200) -> Column:
    """Lines of over 15 characters and two words, without short boilerplate; all such lines if that leaves none."""
    # Lines of over 15 characters after trimming, three words at least, found in one pass over the text.
    long = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^\n]{16,}"), F.lit(0)), lambda s: F.trim(s)), lambda s: (F.length(s) > 15) & s.rlike(r"\s\S+\s"))
    blocked = "|".join(map(re.escape, BLOCKED)).replace(r"\ ", " ")

    def kept(own: Column) -> Column:
        good = F.filter(own, lambda s: (F.length(s) >= 120) | ~s.rlike(f"(?i)(?:{blocked})"))
        return F.element_at(F.transform(F.array(good), lambda g: F.when(F.size(g) > 0, g).otherwise(own)), 1)

    return F.array_join(F.slice(F.element_at(F.transform(F.array(long), kept), 1), 1, most), "\n")


def preview(text: Column, most: int = 220) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most), F.lit("...")))


def shown_number(value: Column, digits: int = 0) -> Column:
    """Thousands separated; null and 0 read 'no data'."""
    return F.when(value.isNull() | (value == 0), "no data").otherwise(F.format_number(value, digits))


def _labelled(pairs: Mapping[str, str]) -> Column:
    """'Label=value' of the fields that there are."""
    return F.concat_ws(", ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}="), F.col(c).cast("string"))) for c, label in pairs.items()])


def _line(label: str, value: Column) -> Column:
    """A line, or null where its value is null or empty."""
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(label), value))


def listing_summary() -> Column:
    """A listing in a few labelled lines; what is missing is left out."""
    whole = lambda c: F.format_number(F.col(c), 0)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    truth = lambda c: F.initcap(F.col(c).cast("string"))
    text = lambda c: F.col(c).cast("string")
    schools = F.concat_ws(
        ", ",
        *[
            F.when(
                F.col(f"{s}_school_rating").isNotNull() | F.col(f"{s}_school_distance_miles").isNotNull(),
                F.concat_ws(" ", F.lit(f"{s.capitalize()}:"), _line("rating=", text(f"{s}_school_rating")), F.when(F.col(f"{s}_school_distance_miles").isNotNull(), F.format_string("dist=%.1fmi", F.col(f"{s}_school_distance_miles").cast("double")))),
            )
            for s in ("elementary", "middle", "high")
        ],
    )
    crime = F.concat_ws(
        " ", *[F.when(F.col(c).isNotNull(), F.format_string(f"{label}=%.0f", F.bround(F.col(c).cast("double"), 0))) for c, label in (("violent_100k", "violent"), ("property_100k", "property"))]
    )
    grocery = F.when(F.coalesce(F.col("grocery_name"), F.lit("")) != "", F.concat(F.lit("Grocery: "), F.col("grocery_name"), F.lit(" ("), text("drive_time"), F.lit(" min drive)"))).otherwise(F.concat(F.lit("Grocery drive time: "), text("drive_time"), F.lit(" min")))
    lines = [
        F.concat(F.lit("ZPID: "), text("zpid")),
        _line("Address: ", text("full_address")),
        F.concat(F.lit("Price: "), F.coalesce(F.concat(F.lit("$"), whole("price")), F.lit("N/A"))),
        F.concat(F.lit("Beds: "), shown("beds"), F.lit(" | Baths: "), shown("baths")),
        F.when(F.col("home_size_sqft") != 0, F.concat(F.lit("Home size: "), whole("home_size_sqft"), F.lit(" sqft"))),
        F.when(F.col("lot_size_acres") != 0, F.concat(F.lit("Lot: "), F.format_string("%.1f", F.col("lot_size_acres").cast("double")), F.lit(" acres"))),
        _line("Financing eligible: ", truth("financing_eligibility")),
        F.when(~F.col("financing_eligibility"), _line("  Reason: ", text("financing_eligibility_explanation"))),
        _line("Quality: ", _labelled({"kitchen_quality": "Kitchen", "bathroom_quality": "Bathroom", "general_interior_quality": "Interior", "general_exterior_quality": "Exterior", "house_style": "Style"})),
        _line(
            "Characteristics: ",
            _labelled({"privacy_level": "Privacy", "road_exposure": "Road exposure", "view_rating": "View", "view_type": "View type", "land_usability": "Land usability", "waterfront_quality": "Waterfront", "vegetation_density": "Vegetation"}),
        ),
        _line("Dedicated office: ", truth("dedicated_office")),
        F.concat(F.lit("Negative features severity: "), text("negative_features_severity"), F.lit("/5")),
        F.when(F.col("negative_features_list") != "None identified", _line("  Negatives: ", text("negative_features_list"))),
        F.concat(F.lit("Positive features score: "), text("positive_features_score"), F.lit("/5")),
        F.when(F.col("positive_features_list") != "Standard features only", _line("  Positives: ", text("positive_features_list"))),
        _line("Climate risks (1-10): ", _labelled({f"{r}_risk_severity": r.capitalize() for r in ("flood", "fire", "wind", "heat", "air")})),
        _line("Schools: ", schools),
        _line("Crime per 100k: ", crime),
        grocery,
        _line("Assessment: ", text("general_assessment")),
    ]
    return F.concat_ws("\n", *lines)


def prompt(summaries: DataFrame, group: Sequence[str], order: str, text: str = "summary") -> DataFrame:
    """Texts of each group in order, set apart by a rule."""
    listed = F.sort_array(F.collect_list(F.struct(order, text)))
    return summaries.groupBy(*group).agg(F.array_join(F.transform(listed, lambda s: s[text]), "\n\n---\n\n").alias("prompt"))


def weight_parameters(weights: Mapping[str, Column]) -> Column:
    """Each row's ``weight_<feature>=<two decimals>``, joined by &; weights that a row lacks are left out."""
    return F.concat_ws("&", *[F.when(c.isNotNull(), F.format_string(f"weight_{k}=%.2f", c.cast("double"))) for k, c in weights.items()])
