import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loftline.operators import joins, merge, pairs, ranks
from loftline.plans import enrichment, learning, tournament
from loftline.sources import tables


def as_dict(df, key="zpid", value="rank"):
    return {r[key]: r[value] for r in df.collect()}


def test_mapped_ranks(spark):
    refs = spark.createDataFrame([(2, 10), (6, 20)], "mini int, global_rank int")
    new = spark.createDataFrame([(1, 1), (2, 4), (3, 7)], "zpid int, mini int")
    assert as_dict(ranks.mapped_ranks(new, refs, 0)) == {1: 9, 2: 15, 3: 21}
    assert as_dict(ranks.mapped_ranks(new, refs.limit(0), 5)) == {1: 6, 2: 7, 3: 8}


def test_merge_prune_sample(spark):
    old = spark.createDataFrame([(1, 1), (2, 2)], "zpid int, rank int")
    new = spark.createDataFrame([(3, 1)], "zpid int, rank int")
    assert as_dict(ranks.merged_ranks(old, new)) == {1: 1, 3: 2, 2: 3}
    ranked = spark.createDataFrame([(1, 5), (2, 2), (3, 9)], "zpid int, rank int")
    assert as_dict(ranks.compacted(ranked, spark.createDataFrame([(1,), (3,)], "zpid int"))) == {1: 1, 3: 2}
    seven = spark.createDataFrame([(k, k) for k in range(1, 8)], "zpid int, rank int")
    assert {r["zpid"] for r in ranks.spaced_sample(seven, 3).collect()} == {1, 3, 5}
    assert ranks.spaced_sample(seven, 9).count() == 7


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(points=st.lists(st.integers(0, 40), min_size=1, max_size=15), refs=st.sets(st.integers(0, 40), max_size=6))
def test_asof_equals_brute_force(spark, points, refs):
    p = spark.createDataFrame(list(enumerate(points)), "zpid int, k int")
    r = spark.createDataFrame([(x, x * 2) for x in refs], "k int, v int")
    for row in joins.asof(p, r, "k", "v", cuts=[10.0, 20.0, 30.0]).collect():
        below, above = [x for x in refs if x <= row["k"]], [x for x in refs if x > row["k"]]
        assert (row["below_at"], row["above_at"]) == (max(below, default=None), min(above, default=None))


def test_tournament_ranks_every_item(spark):
    items = spark.createDataFrame([(k, float(k)) for k in range(31)], "zpid int, score double")
    got = as_dict(tournament.tournament(items, tournament.score_judge("score")))
    assert sorted(got.values()) == list(range(1, 32))
    again = as_dict(tournament.tournament(items.repartition(7), tournament.score_judge("score")))
    assert got == again


def test_outside_judge(spark):
    df = spark.createDataFrame([(k, 0) for k in range(4)], "zpid int, batch int")
    got = ranks.judge(df, lambda frame: [3, 99, 1])
    assert as_dict(got, value="batch_rank") == {3: 1, 1: 2, 0: 3, 2: 4}


def test_refresh_modes(spark):
    judge = tournament.score_judge("score")
    items = spark.createDataFrame([(k, float(k)) for k in range(12)], "zpid int, score double")
    ranked = spark.createDataFrame([(k, 13 - k) for k in range(2, 12)], "zpid int, rank int")
    assert sorted(as_dict(tournament.refreshed(items, ranked, judge)).values()) == list(range(1, 13))
    assert sorted(as_dict(tournament.refreshed(items.where("zpid > 4"), ranked, judge)).values()) == list(range(1, 8))
    assert len(as_dict(tournament.refreshed(items, ranked.limit(0), judge))) == 12


def test_upsert_deletes_and_ignores(spark):
    base = spark.createDataFrame([(1, "no"), (2, "yes")], "zpid int, rating string")
    log = spark.createDataFrame([(3, "yes", 1), (3, "bogus", 2), (1, "", 3), (2, "maybe", 4)], "zpid int, rating string, ts int")
    got = merge.upsert(base, log, "zpid", "rating", ["ts"], ("yes", "no", "maybe"))
    assert as_dict(got, value="rating") == {3: "yes", 2: "maybe"}
    assert as_dict(merge.upsert(got, log, "zpid", "rating", ["ts"], ("yes", "no", "maybe")), value="rating") == {3: "yes", 2: "maybe"}


def test_partial_update_and_queue(spark):
    base = spark.createDataFrame([(1, 10, "A", 0), (2, 20, "B", 0)], "zpid int, price int, status string, at int")
    got = merge.partial_update(base, spark.createDataFrame([(1, None, "Sold")], "zpid int, price int, status string"), "zpid", ["price", "status"], "at", F.lit(9))
    assert sorted(map(tuple, got.collect())) == [(1, 10, "Sold", 9), (2, 20, "B", 0)]
    priced = merge.update_price(base, spark.createDataFrame([(1, 11), (2, None)], "zpid int, price int"), "zpid")
    assert as_dict(priced, value="price") == {1: 11, 2: 20}
    queue = spark.createDataFrame([("a", 1)], "url string, at int")
    asked = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4), ("c", 5)], "url string, at int")
    known = spark.createDataFrame([("c",)], "url string")
    assert as_dict(merge.enqueue(queue, asked, known, "url", ["at"]), "url", "at") == {"a": 1, "b": 3}


def test_pairs_and_learning(spark):
    ratings = ["yes"] * 4 + ["maybe"] * 3 + ["no"] * 3
    rated = spark.createDataFrame([(k, pairs.RATING_VALUES[r]) for k, r in enumerate(ratings)], "pos int, value int")
    assert pairs.preference_pairs(rated, "pos", "value").count() == 33
    rng = random.Random(3)
    scored = spark.createDataFrame([(k, rng.random() * 100, 90.0 - 8 * k) for k in range(10)], "zpid int, beds_score double, price_score double")
    named = spark.createDataFrame(list(enumerate(ratings)), "zpid int, rating string")
    weights, info = learning.learned_weights(scored, named)
    assert info["n_pairs"] == 33 and info["loss_after"] <= info["loss_before"] and all(abs(w) <= 50 for w in weights.values())
    with pytest.raises(ValueError):
        learning.learned_weights(scored, named.limit(9))
    p = learning.LearnParams.of(0.4)
    assert (p.l2, p.rate, p.margin) == (pytest.approx(0.25), pytest.approx(0.66), pytest.approx(1.12))
    assert learning.LearnParams.of(0.05) == learning.LearnParams.of(0.1)
    assert learning.scaled_weights({"a": 1, "b": 3, "c": 0, "d": -1, "e": -2}) == {"a": 0.1, "b": 50.0, "c": 0.0, "d": -50.0, "e": -0.1}


def test_crime_table(spark):
    city = spark.createDataFrame([("Oregon", "BEND", "100", "2", "x"), ("Oregon", None, "1", "1", "1")], "State string, City string, Population string, `Violent\ncrime` string, `Property\ncrime` string")
    county = spark.createDataFrame([("OREGON", "Deschutes County", "4", "8")], "State string, County string, `Violent crime` string, `Property crime` string")
    people = enrichment.county_population(spark.createDataFrame([(".Deschutes County, Oregon", "200"), ("note", None)], "county_state string, population string"))
    addresses = spark.createDataFrame([(1, "1 A, Bend, OR 97", "Deschutes"), (2, "1 A, Sisters, OR 97", "Deschutes County"), (3, "x", None)], "zpid int, full_address string, county string")
    got = {r["zpid"]: (r["violent_100k"], r["property_100k"]) for r in enrichment.crime_table(addresses, enrichment.city_rates(city), enrichment.county_rates(county, people)).collect()}
    assert got == {1: (2000.0, 4000.0), 2: (2000.0, 4000.0), 3: (None, None)}


def test_nearest_store(spark):
    origins = spark.createDataFrame([(1,)], "zpid int")
    stores = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "c", 3.0)], "zpid int, store_id string, distance double")
    details = spark.createDataFrame([("a", "Corner", "x", 4.0, 10), ("b", "Safeway", "y", 4.0, 3), ("c", "Big", "z", 5.0, 900)], "store_id string, name string, address string, rating double, user_ratings_total int")
    drives = spark.createDataFrame([(1, "b", 150), (1, "c", 60)], "zpid int, store_id string, seconds int")
    got = enrichment.nearest_store(origins, stores, details, drives).first()
    assert (got["name"], got["drive_time"]) == ("Safeway", 2)


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), None)], "a int, b double, c string")
    assert tables.records(df).first()[0] == '{"a":1,"b":null,"c":null}'
    assert tables.optional_table(spark, "notes").count() == 0
    tables.save_checkpoint(spark, f"{tmp_path}/c", 3, 4)
    assert tables.load_checkpoint(spark, f"{tmp_path}/c") == (3, 4) and tables.load_checkpoint(spark, f"{tmp_path}/none") is None
    links = spark.createDataFrame([(2, 9), (3, 3), (3, 4), (4, 0)], "page int, pos int")
    assert tables.resumed(links, 3, 4).count() == 2
    sheet = spark.createDataFrame([("a", 1, "t"), ("b", None, "t"), ("c", 3, "t"), ("d", 4, "t")], "x string, y int, z string").coalesce(1)
    assert [tuple(r) for r in tables.positional(sheet, {0: "place", 1: "people"}, skip=1).collect()] == [("c", 3), ("d", 4)]
    assert tables.sheet(sheet, "y").count() == 3
    with pytest.raises(ValueError):
        joins.assert_unique(links, "page")


def test_user_data_needs_permission(spark):
    base = spark.createDataFrame([(1,), (2,)], "zpid int")
    ratings, notes = spark.createDataFrame([(1, "yes")], "zpid int, rating string"), spark.createDataFrame([(2, "n")], "zpid int, note string")
    assert as_dict(joins.with_user_data(base, ratings, notes), value="rating") == {1: "yes", 2: ""}
    assert as_dict(joins.with_user_data(base, ratings, notes, allowed=False), value="note") == {1: "", 2: ""}


def test_learned_view(spark):
    from loftline.sources.schema import SCHEMAS, ensure_columns
    from loftline.spec import QuerySpec

    base = spark.createDataFrame([(k, 100 * k, "Active", k % 5 + 1, True, True, 44.0, -121.0, 1) for k in range(1, 21)], "zpid int, price int, status string, beds int, financing_eligibility boolean, dedicated_office boolean, latitude double, longitude double, ai_rank int")
    base = ensure_columns(ensure_columns(base, SCHEMAS["property_features"]), SCHEMAS["crime"]).withColumn("drive_time", F.lit(10))
    ratings = spark.createDataFrame([(k, ("yes", "maybe", "no")[k % 3]) for k in range(1, 13)], "zpid int, rating string")
    notes = spark.createDataFrame([], "zpid int, note string")
    rows, weights, info = learning.learned_view(base, ratings, notes, QuerySpec())
    got = rows.collect()
    assert info["n_pairs"] == 48 and len(weights) == 24 and len(got) == 20 - 4
    assert [r["total_score"] for r in got] == sorted((r["total_score"] for r in got), reverse=True)
