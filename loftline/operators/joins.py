"""Joins of listings with what is known about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a stated order, by an aggregate that combines before it shuffles."""
    rest = [c for c in df.columns if c != key]
    lead = [F.col(o) if isinstance(o, str) else o for o in order]
    packed = F.min(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(lead)], F.struct(*rest).alias("_row")))
    return df.groupBy(key).agg(packed.alias("_m")).select(key, *[F.col(f"_m._row.{c}").alias(c) for c in rest])


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``, failing at run time where a key has several rows."""
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if twice.take(1):
        raise ValueError(f"{key} isn't unique")
    return df


def listing_base(properties: DataFrame, features: DataFrame, crime: DataFrame, grocery: DataFrame, location: DataFrame, ranks: DataFrame, key: str = "zpid") -> DataFrame:
    """Listings with their five optional tables, each with a row per key at most.

    No side is forced to be broadcast: all sides share the key, so one exchange of
    each suffices, and small sides are broadcast by size.
    """
    store = grocery.select(key, "drive_time", F.col("name").alias("grocery_name"), F.col("rating").alias("grocery_rating"), F.col("user_ratings_total").alias("grocery_ratings_count"))
    out = properties
    for side in (features, crime.select(key, "violent_100k", "property_100k"), store, location.select(key, "latitude", "longitude"), ranks.select(key, "ai_rank")):
        out = out.join(side, key, "left")
    return out


def with_user_data(listings: DataFrame, ratings: DataFrame, notes: DataFrame, allowed: bool = True, key: str = "zpid") -> DataFrame:
    """Add rating and note, '' where there is none or the user may not see them.

    A listing with several ratings or notes has the latest (by ``updated_at``, where there is one).
    """
    if not allowed:
        return listings.withColumns({"rating": F.lit(""), "note": F.lit("")})
    last = lambda df, c: df.groupBy(key).agg(F.max(F.struct(*[t for t in ("updated_at",) if t in df.columns], c))[c].alias(c))
    out = listings.join(last(ratings, "rating"), key, "left").join(last(notes, "note"), key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("rating", "note")})


def backlog(listings: DataFrame, done: DataFrame, key: str = "zpid", need: str = "full_address") -> DataFrame:
    """Listings with an address that an enrichment hasn't reached."""
    return listings.where(F.col(need).isNotNull()).join(done, key, "left_anti")


def unprocessed(links: DataFrame, properties: DataFrame, features: DataFrame, key: str = "zpid") -> DataFrame:
    """Links that aren't in both tables yet."""
    return links.join(properties.join(features, key, "left_semi").select(key), key, "left_anti")


def looked_up(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """External answers as a table: the first hit of a key; a miss drops the row."""
    return df.join(table, key, "inner")


def first_qualifying(candidates: DataFrame, key: str, distance: str, qualifies: Column, *ties: str) -> DataFrame:
    """Nearest candidate of each key that qualifies; of equally near ones the first by ``ties``; nulls come last."""
    return one_per_key(candidates.where(qualifies), key, [o for c in (distance, *ties) for o in (F.col(c).isNull(), c)])


def queue_heads(queued: DataFrame, found: DataFrame, page: int) -> DataFrame:
    """Links of a page, the queue's first, on the first page only; repeats stay."""
    own = found.select("url", F.lit(1).alias("part"), "pos")
    if page != 1:
        return own.orderBy("pos")
    return queued.select("url", F.lit(0).alias("part"), "pos").unionByName(own).orderBy("part", "pos")


def reconciled(batch: DataFrame, returned: DataFrame, key: str = "zpid") -> tuple[DataFrame, DataFrame]:
    """Ids asked for but not returned, and ids returned unasked."""
    return batch.select(key).join(returned, key, "left_anti"), returned.select(key).join(batch, key, "left_anti")


def cut_points(df: DataFrame, key: str, parts: int | None = None) -> list[float]:
    """At most ``parts`` - 1 ascending values that cut ``key`` into about even ranges; as many as shuffles have, 64 at least."""
    parts = parts or min(2000, max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    row = df.agg(F.percentile_approx(F.col(key).cast("double"), [i / parts for i in range(1, parts)], 32 * parts).alias("q")).first()
    return sorted(set(row["q"] or []))


def range_of(key: Column, cuts: Sequence[float]) -> Column:
    """Number of the range a key is in; nulls are in the last."""
    if not cuts:
        return F.lit(0)
    value = key.cast("double")

    def within(lo: int, hi: int) -> Column:
        """How many of the cuts are below the value, as a search by halves."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value > F.lit(float(cuts[mid])), within(mid + 1, hi)).otherwise(within(lo, mid))

    return F.when(key.isNull(), F.lit(len(cuts))).otherwise(within(0, len(cuts)))


def asof(points: DataFrame, refs: DataFrame, key: str, value: str, cuts: Sequence[float] | None = None) -> DataFrame:
    """Add to each point the nearest reference at or below its key, and the nearest above.

    ``refs`` holds ``key`` and ``value``, one row per key.  Both sides meet in ranges
    of the key, so no task sees all rows; what precedes or follows a range comes
    from a row per range.
    """
    cuts = cut_points(points.select(key).unionByName(refs.select(key)), key) if cuts is None else cuts
    names = points.columns
    ref = F.struct(F.col(key).alias("at"), F.col(value).alias("value"))
    mine = points.select(F.struct(*names).alias("_p"), F.col(key).alias("_k"), F.lit(None).cast(refs.select(ref.alias("r")).schema["r"].dataType).alias("_r"), F.lit(1).alias("_side"))
    marks = refs.select(F.lit(None).cast(mine.schema["_p"].dataType).alias("_p"), F.col(key).alias("_k"), ref.alias("_r"), F.lit(0).alias("_side"))
    both = mine.unionByName(marks).withColumn("_part", range_of(F.col("_k"), cuts))
    upto = Window.partitionBy("_part").orderBy("_k", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.partitionBy("_part").orderBy("_k", "_side").rowsBetween(1, Window.unboundedFollowing)
    near = both.withColumns({"_below": F.last("_r", True).over(upto), "_above": F.first("_r", True).over(onward)}).where("_side = 1")
    ends = refs.withColumn("_part", range_of(F.col(key), cuts)).groupBy("_part").agg(F.max(ref).alias("hi"), F.min(ref).alias("lo"))
    # A row per range: its neighbours' references, for points with none in their own range.
    spans = refs.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_part")).join(F.broadcast(ends), "_part", "left")
    order = Window.orderBy("_part")
    carried = spans.select("_part", F.last("hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("lo", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    out = near.join(F.broadcast(carried), "_part")
    below, above = F.coalesce("_below", "_before"), F.coalesce("_above", "_after")
    return out.select("_p.*", below["at"].alias("below_at"), below["value"].alias("below"), above["at"].alias("above_at"), above["value"].alias("above"))
