"""Orders, ordinals, tiers and samples along a ranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loftline.functions.quantiles import exact_quantiles
from loftline.operators.joins import asof
from loftline.sources.lineage import stored

#: What the quick cut weighs.
QUICK_WEIGHTS = {
    "kitchen_quality": 6, "bathroom_quality": 5, "general_interior_quality": 5, "privacy_level": 7, "road_exposure": 8, "land_usability": 4,
    "view_rating": 3, "positive_features_score": 2, "house_style": 3, "general_exterior_quality": 5,
}
#: All that it reads.
QUICK_READS = ("price", *QUICK_WEIGHTS, "lot_size_acres", "home_size_sqft", "dedicated_office")


def by_score(df: DataFrame, key: str = "zpid") -> DataFrame:
    return df.orderBy(F.desc_nulls_last("total_score"), key)


def by_ai_rank(df: DataFrame, key: str = "zpid") -> DataFrame:
    return df.orderBy(F.asc_nulls_last("ai_rank"), F.desc_nulls_last("total_score"), key)


def ordinal(df: DataFrame, lead: str, then: Sequence[Column | str], name: str, second: str | None = None) -> DataFrame:
    """Number rows from 1 by ``lead`` (ascending, nulls last), ``second`` (likewise, if given) and ``then``.

    Rows are exchanged once, into ranges of the whole order, sorted and counted off within
    each, and written.  A range starts after those before it; only a row per range meets
    in one place.  Ties and nulls of ``lead`` are dealt to many ranges by what follows.
    """
    order = [F.asc_nulls_last(lead), *([F.asc_nulls_last(second)] if second else []), *then]
    counted = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    held = stored(counted)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return held.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_base") + F.col("_at") + 1).cast("int")).drop("_part", "_at", "_base")


def hash_order(key: str, seed: str) -> Column:
    """A fixed shuffling order that other engines can compute too."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))


def shuffled(df: DataFrame, key: str, seed: str, name: str = "pos") -> DataFrame:
    """Number rows from 1 in hash order."""
    return ordinal(df.withColumn("_h", hash_order(key, seed)), "_h", [key], name).drop("_h")


def batches(df: DataFrame, size: int, pos: str = "pos", name: str = "batch") -> DataFrame:
    """Consecutive chunks of ``size`` along ``pos`` (from 1)."""
    return df.withColumn(name, F.floor((F.col(pos) - 1) / size).cast("int"))


def round_robin(df: DataFrame, n_batches: int, pos: str = "pos", name: str = "batch") -> DataFrame:
    """Deal rows along ``pos`` over the batches in turn; every row gets a place."""
    return df.withColumn(name, F.pmod(F.col(pos) - 1, F.lit(n_batches)).cast("int"))


def judge_by_score(df: DataFrame, score: str, key: str = "zpid") -> DataFrame:
    """Rank within each batch by a score, best first."""
    order = Window.partitionBy("batch").orderBy(F.desc_nulls_last(score), key)
    return df.withColumn("batch_rank", F.row_number().over(order))


def judge(df: DataFrame, oracle: Callable[[pd.DataFrame], Sequence[int]], key: str = "zpid") -> DataFrame:
    """Rank within each batch by an outside judge, which sees one bounded batch at a time.

    Ids it returns count if they are in the batch; those it leaves out follow, ascending.
    """

    def ranked(frame: pd.DataFrame) -> pd.DataFrame:
        own = set(frame[key])
        given = [z for z in oracle(frame) if z in own]
        order = given + sorted(own.difference(given))
        place = {z: k for k, z in enumerate(order, 1)}
        return frame.assign(batch_rank=frame[key].map(place).astype("int32"))

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", batch_rank int"
    return df.groupBy("batch").applyInPandas(ranked, schema)


def tier_ranks(df: DataFrame, seed: str, key: str = "zpid", name: str = "rank") -> DataFrame:
    """Global ranks 1..N: first of all batches, then second, ...; hash order within a tier."""
    return ordinal(df, "batch_rank", [hash_order(key, seed), key], name)


def quick_score(low: Column, high: Column) -> Column:
    """Score of the quick cut, given the least and the highest price."""
    price = F.coalesce(F.col("price").cast("double"), high)
    value = F.when(high > low, (1.0 - (price - low) / F.nullif(high - low, F.lit(0.0))) * 20.0).otherwise(F.lit(0.0))
    for name, weight in QUICK_WEIGHTS.items():
        value = value + F.coalesce(F.col(name).cast("double"), F.lit(3.0)) * float(weight)
    value = value + F.least(F.coalesce(F.col("lot_size_acres").cast("double"), F.lit(0.0)), F.lit(8.0)) / 8.0 * 40.0
    value = value + F.least(F.coalesce(F.col("home_size_sqft").cast("double"), F.lit(0.0)), F.lit(3000.0)) / 3000.0 * 35.0
    return value + F.coalesce(F.col("dedicated_office"), F.lit(False)).cast("int") * 50.0


def quick_cut(df: DataFrame) -> DataFrame:
    """Drop the bottom third by quick score; three rows or fewer all stay."""
    ends = df.agg(F.min(F.col("price").cast("double")).alias("_lo"), F.max(F.col("price").cast("double")).alias("_hi"), F.count("*").alias("_n"))
    rated = df.crossJoin(F.broadcast(ends)).withColumn("quick_score", quick_score(F.col("_lo"), F.col("_hi"))).withColumn("quick_score", F.coalesce("quick_score", F.lit(0.0)))
    rated = stored(rated)
    [cut] = exact_quantiles(rated, F.col("quick_score"), [1.0 / 3.0])
    return rated.where((F.col("_n") <= 3) | (F.col("quick_score") >= F.lit(cut))).drop("_lo", "_hi", "_n")


def mapped_ranks(new: DataFrame, refs: DataFrame, total: int) -> DataFrame:
    """Global rank of new rows from their mini-ranks and the references' (``mini``, ``global_rank``).

    Above all references: one less than the best, at least 1; below all: one more
    than the worst; between two: interpolated, half to even, at least 1.  Without
    references new rows follow the ``total`` ranked ones.
    """
    if not refs.take(1):
        return ordinal(new, "mini", ["zpid"], "_i").select("zpid", "mini", (F.lit(total) + F.col("_i")).cast("int").alias("rank"))
    found = asof(new.select("zpid", "mini"), refs.select("mini", "global_rank"), "mini", "global_rank")
    share = (F.col("mini") - F.col("below_at")) / F.nullif((F.col("above_at") - F.col("below_at")).cast("double"), F.lit(0.0))
    between = F.greatest(F.lit(1), F.bround(F.col("below") + share * (F.col("above") - F.col("below")), 0).cast("int"))
    rank = F.when(F.col("below").isNull(), F.greatest(F.lit(1), F.col("above") - 1)).when(F.col("above").isNull(), F.col("below") + 1).otherwise(between)
    return found.select("zpid", "mini", rank.cast("int").alias("rank"))


def merged_ranks(ranked: DataFrame, new: DataFrame) -> DataFrame:
    """Renumber ranked rows and new ones (zpid, rank) together; at equal ranks ranked rows come first."""
    both = ranked.select("zpid", "rank", F.lit(0).alias("is_new")).unionByName(new.select("zpid", "rank", F.lit(1).alias("is_new")))
    return ordinal(both, "rank", ["is_new", "zpid"], "new_rank").select("zpid", F.col("new_rank").alias("rank"))


def compacted(ranked: DataFrame, valid: DataFrame) -> DataFrame:
    """Ranks 1..N of the rows that are still valid."""
    kept = ranked.join(valid.select("zpid"), "zpid", "left_semi")
    return ordinal(kept, "rank", ["zpid"], "new_rank").select("zpid", F.col("new_rank").alias("rank"))


def spaced_sample(ranked: DataFrame, k: int) -> DataFrame:
    """``k`` rows evenly spaced along the ranking; all rows where there are no more."""
    numbered = ordinal(ranked, "rank", ["zpid"], "_pos")
    size = numbered.agg(F.count("*").alias("_n"))
    i = F.ceil((F.col("_pos") - 1) * F.lit(k) / F.col("_n"))
    hit = (F.col("_n") <= k) | ((i < k) & (F.floor(i * F.col("_n") / F.lit(k)) == F.col("_pos") - 1))
    return numbered.crossJoin(F.broadcast(size)).where(hit).drop("_pos", "_n")


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)
