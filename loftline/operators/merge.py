"""Merges on plain tables: (base, changes) to a new base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loftline.operators.joins import one_per_key


def last_writes(changes: DataFrame, key: str, stamps: Sequence[str]) -> DataFrame:
    """Each key's last change, by ``stamps``."""
    rest = [c for c in changes.columns if c != key]
    packed = F.max(F.struct(*[F.col(s).alias(f"_o{i}") for i, s in enumerate(stamps)], F.struct(*rest).alias("_row")))
    return changes.groupBy(key).agg(packed.alias("_m")).select(key, *[F.col(f"_m._row.{c}").alias(c) for c in rest])


def upsert(base: DataFrame, changes: DataFrame, key: str, value: str, stamps: Sequence[str], valid: Sequence[str] | None = None) -> DataFrame:
    """Last write wins; a null or blank value deletes; values outside ``valid`` are ignored."""
    blank = F.coalesce(F.col(value), F.lit("")) == ""
    allowed = changes if valid is None else changes.where(blank | F.col(value).isin(*valid))
    last = last_writes(allowed, key, stamps)
    kept = base.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(F.coalesce(F.col(value), F.lit("")) != "").select(*base.columns))


def replace_rows(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Whole rows replaced by key; what the new row lacks becomes null."""
    return base.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True).select(*base.columns)


def partial_update(base: DataFrame, changes: DataFrame, key: str, fields: Sequence[str], stamp: str, now: Column) -> DataFrame:
    """Set ``fields`` where the change has a value, and stamp every changed row."""
    new = changes.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_hit"))
    joined = base.join(new, key, "left")
    sets = {f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields} | {stamp: F.when(F.col("_hit"), now).otherwise(F.col(stamp))}
    return joined.withColumns(sets).select(*base.columns)


def update_price(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Prices that differ are taken over; nothing else changes."""
    joined = base.join(changes.select(key, F.col("price").alias("_price")), key, "left")
    return joined.withColumn("price", F.when(F.col("_price").isNotNull() & ~F.col("_price").eqNullSafe(F.col("price")), F.col("_price")).otherwise(F.col("price"))).select(*base.columns)


def enqueue(queue: DataFrame, asked: DataFrame, known: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The queue with what is neither known nor queued yet; the first of repeated requests counts."""
    fresh = one_per_key(asked, key, order).join(known, key, "left_anti").join(queue, key, "left_anti")
    return queue.unionByName(fresh.select(*queue.columns))


def dequeue(queue: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return queue.join(done, key, "left_anti")
