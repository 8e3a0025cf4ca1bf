"""Rules of a table, counted while it is written; a table that breaks one is refused."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from loftline.sources.lineage import shared_root

#: Rules that the listing tables state: columns that can't be null, keys, and conditions that must not be false.
NOT_NULL = {"ai_rankings": ("ai_rank",), "for_review": ("zillow_url",), "rating": ("rating",), "manual_inspection": ("listing_url",)}
KEYS = {"properties": "zpid", "property_features": "zpid", "ai_rankings": "zpid", "rating": "zpid", "notes": "zpid", "for_review": "zpid", "manual_inspection": "zpid"}
CHECKS = {"rating": {"rating": "rating IN ('yes', 'no', 'maybe')"}}


class RuleBroken(ValueError):
    """What a refused table broke: the number of rows by rule."""

    def __init__(self, table: str, breaches: Mapping[str, int]) -> None:
        super().__init__(f"{table}: " + ", ".join(f"{n} rows break {rule}" for rule, n in breaches.items() if n))
        self.breaches = dict(breaches)


def breaches_of(table: str) -> dict[str, Column]:
    """Conditions, by rule, that are true of a row that breaks it; the key's rule needs ``_again``."""
    out = {f"{c} not null": F.col(c).isNull() for c in NOT_NULL.get(table, ())}
    # As in SQL, a condition that isn't known doesn't break its rule.
    out |= {f"check {n}": ~F.coalesce(F.expr(e), F.lit(True)) for n, e in CHECKS.get(table, {}).items()}
    if table in KEYS:
        out |= {f"key {KEYS[table]} not null": F.col(KEYS[table]).isNull(), f"key {KEYS[table]} unique": F.col("_again")}
    return out


def checked(df: DataFrame, rules: Mapping[str, Column], key: str | None = None) -> tuple[str, dict[str, int]]:
    """Where ``df`` was written, with nothing there if a rule is broken, and the number of rows that break each rule.

    Rows are counted as they are written, so nothing is read twice.  With a ``key``, rows of a
    key meet in one exchange, where all but the first count as repeats.
    """
    spark, seen, names = df.sparkSession, Observation(), list(rules)
    rows = df
    if key:
        own = Window.partitionBy(key).orderBy(key)
        rows = df.withColumn("_again", F.col(key).isNotNull() & (F.row_number().over(own) > 1))
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(f"r{k}") for k, c in enumerate(rules.values())])
    path = f"{shared_root(spark)}/checked-{uuid.uuid4().hex}"
    counted.select(*df.columns).write.parquet(path)
    found = {rule: seen.get[f"r{k}"] for k, rule in enumerate(names)}
    if any(found.values()):
        # What was written is given back: an empty table takes its place.
        spark.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(path)
    return path, found


def write_checked(df: DataFrame, table: str, name: str | None = None) -> dict[str, int]:
    """Replace catalogue table ``name`` (``table`` itself) by ``df`` under the rules of ``table``; returns the counts by rule.

    On a breach the table stays as it was, and ``RuleBroken`` tells the counts.
    """
    spark, name = df.sparkSession, name or table
    path, found = checked(df, breaches_of(table), KEYS.get(table))
    if any(found.values()):
        raise RuleBroken(table, found)
    publish(spark, name, path)
    return found


def publish(spark: SparkSession, name: str, path: str) -> None:
    """Point catalogue table ``name`` to the files at ``path``."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.catalog.createTable(name, path=path, source="parquet")


def report(found: Mapping[str, int], spark: SparkSession) -> DataFrame:
    """A row for each rule: ``rule`` and ``breaches``."""
    return spark.createDataFrame(list(found.items()), "rule string, breaches long")
