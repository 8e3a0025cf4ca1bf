"""Keyed tables and tables under rules."""

import random

import pytest
from pyspark.sql import functions as F

from loftline.operators import joins, merge
from loftline.sources import rules
from loftline.sources.keyed import keyed


@pytest.fixture
def shuffled_only(spark):
    """No broadcast joins, and no re-planning that would hide an exchange from the plan."""
    asked = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _sides(spark, n=400):
    rng = random.Random(1)
    own = lambda share, make, schema: spark.createDataFrame([make(k) for k in range(n) if rng.random() < share], schema)
    return [
        own(1, lambda k: (k, k * 10), "zpid int, price int"),
        own(0.9, lambda k: (k, k % 5), "zpid int, beds int"),
        own(0.5, lambda k: (k, float(k), 1.0), "zpid int, violent_100k double, property_100k double"),
        own(0.5, lambda k: (k, "s", 3, "a", 4.5, 7), "zpid int, name string, drive_time int, address string, rating double, user_ratings_total int"),
        own(0.7, lambda k: (k, 44.0, -121.0), "zpid int, latitude double, longitude double"),
        own(0.3, lambda k: (k, k), "zpid int, ai_rank int"),
    ]


def test_listing_base_without_an_exchange(spark, shuffled_only):
    sides = _sides(spark)
    got = joins.listing_base(*[keyed(s, "zpid") for s in sides])
    assert "Exchange" not in plan_of(got) and "SortMergeJoin" in plan_of(got)
    assert sorted(got.collect()) == sorted(joins.listing_base(*sides).collect())


def test_merges_exchange_only_the_changes(spark, shuffled_only):
    base = spark.createDataFrame([(k, "no", k) for k in range(300)], "zpid int, rating string, at int")
    changes = spark.createDataFrame([(k % 120, ("yes", "", "maybe", "bogus")[k % 4], k) for k in range(500)], "zpid int, rating string, at int")
    stored = keyed(base, "zpid")
    merged = merge.upsert(stored, changes, "zpid", "rating", ["at"], ("yes", "no", "maybe"))
    assert plan_of(merged).count("Exchange") == plan_of(merge.last_writes(changes, "zpid", ["at"])).count("Exchange") * 2
    again = keyed(merged, "zpid", dealt=True)
    assert sorted(again.collect()) == sorted(merge.upsert(base, changes, "zpid", "rating", ["at"], ("yes", "no", "maybe")).collect())
    # The outcome is in buckets again: another merge, replacement and partial update need no exchange of it.
    rows = keyed(changes.groupBy("zpid").agg(F.max("rating").alias("rating"), F.max("at").alias("at")), "zpid")
    for out in (merge.replace_rows(again, rows, "zpid"), merge.partial_update(again, rows, "zpid", ["rating"], "at", F.lit(0))):
        assert "Exchange" not in plan_of(out)


def test_keyed_tables_keep_the_first_row_of_a_key(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (None, "c", 1), (2, "d", 1)], "zpid int, note string, at int")
    out = keyed(df, "zpid", 3, order=["at"])
    assert sorted((r["zpid"] or 0, r["note"]) for r in out.collect()) == [(0, "c"), (1, "b"), (2, "d")]
    assert keyed(df.limit(0), "zpid", 3).collect() == [] and not [t for t in spark.catalog.listTables() if t.name.startswith("keyed_")]


def test_a_table_that_breaks_a_rule_is_refused(spark):
    fine = spark.createDataFrame([(1, "yes"), (2, "no")], "zpid int, rating string")
    assert set(rules.write_checked(fine, "rating", "ratings_held").values()) == {0}
    bad = spark.createDataFrame([(1, "bogus"), (1, "yes"), (1, "no"), (3, None), (None, "maybe")], "zpid int, rating string")
    with pytest.raises(rules.RuleBroken) as told:
        rules.write_checked(bad, "rating", "ratings_held")
    assert told.value.breaches == {"rating not null": 1, "check rating": 1, "key zpid not null": 1, "key zpid unique": 2}
    # The table stays as it was, and a later one that is fine takes its place.
    assert sorted(map(tuple, spark.table("ratings_held").collect())) == [(1, "yes"), (2, "no")]
    rules.write_checked(fine.limit(1), "rating", "ratings_held")
    assert spark.table("ratings_held").count() == 1
    spark.sql("DROP TABLE ratings_held")


def test_rules_are_counted_in_the_pass_that_writes(spark):
    looked = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            looked.add(b.num_rows)
            yield b

    df = spark.range(100).select(F.col("id").cast("int").alias("zpid"), F.lit("yes").alias("rating")).mapInArrow(look, "zpid int, rating string")
    rules.checked(df, rules.breaches_of("rating"), "zpid")
    assert looked.value == 100
