"""The ranking job's options, sliders, and reads that may fail."""

import pytest
from pyspark.sql import functions as F

from loftline.functions import html
from loftline.operators import joins
from loftline.plans import ranking_job as job
from loftline.plans.tournament import score_judge
from loftline.sources import tables
from loftline.sources.schema import FEATURE_KINDS, SCHEMAS, ensure_columns
from loftline.spec import DEFAULT_WEIGHTS, SLIDER_ENDS, on_sliders


def listings(spark, n):
    rows = spark.range(1, n + 1).select(F.col("id").cast("int").alias("zpid"), (F.col("id") * 1000).cast("int").alias("price"), (F.col("id") % 5 + 1).cast("int").alias("kitchen_quality"))
    return ensure_columns(ensure_columns(rows, SCHEMAS["property_features"]), SCHEMAS["crime"])


def test_options():
    assert job.RankingOptions.parsed([]) == job.RankingOptions()
    asked = job.RankingOptions.parsed(["--batch-size", "7", "--passes", "3", "--no-filter", "--dry-run", "--full", "--table", "t"])
    assert asked == job.RankingOptions(7, 3, True, True, True, "t")
    with pytest.raises(ValueError):
        job.RankingOptions(batch_size=0)


def test_the_job_saves_inserts_and_ranks_anew(spark):
    name = "job_ranks"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    judge, few, more = score_judge("price"), listings(spark, 9), listings(spark, 12)
    dry = job.run_ranking(spark, few, judge, ["--table", name, "--dry-run"])
    assert dry.count() == 6 and not spark.catalog.tableExists(name)
    job.run_ranking(spark, few, judge, ["--table", name, "--no-filter"])
    saved = {r["zpid"]: r["ai_rank"] for r in spark.table(name).collect()}
    assert sorted(saved.values()) == list(range(1, 10)) and spark.table(name).where("ranked_at IS NULL").count() == 0
    inserted = job.run_ranking(spark, more, judge, ["--table", name, "--no-filter", "--dry-run"]).collect()
    assert sorted(r["rank"] for r in inserted) == list(range(1, 13))
    # What was ranked keeps its order among itself.
    order = [r["zpid"] for r in sorted(inserted, key=lambda r: r["rank"]) if r["zpid"] in saved]
    assert order == sorted(saved, key=saved.get)
    spark.sql(f"DROP TABLE {name}")


def test_the_job_stores_only_what_its_judge_reads(spark, monkeypatch):
    from loftline.operators import ranks
    from loftline.plans import tournament

    held, rows = [], listings(spark, 40)
    for module in (ranks, tournament):
        monkeypatch.setattr(module, "stored", lambda df, store=module.stored: held.append(df.columns) or store(df))
    by_score = job.run_ranking(spark, rows, score_judge("price"), ["--dry-run", "--full", "--batch-size", "4"]).collect()
    assert max(map(len, held)) <= len(ranks.QUICK_READS) + 5 and max(map(len, held[1:])) < 12
    held.clear()
    # A judge that doesn't say what it reads gets all columns, and the ranks are the same.
    seen = lambda df: ranks.judge_by_score(df, "price")
    assert sorted(job.run_ranking(spark, rows, seen, ["--dry-run", "--full", "--batch-size", "4"]).collect()) == sorted(by_score)
    assert max(map(len, held)) > len(rows.columns)


def test_sliders():
    assert list(SLIDER_ENDS) != [] and set(SLIDER_ENDS) == set(DEFAULT_WEIGHTS)
    assert on_sliders({"price": 61.0, "beds": -2.0, "baths": 3.24, "drive_time": 3.26, "view_rating": 0.25}) == {"price": 50, "beds": 0.0, "baths": 3.0, "drive_time": 3.5, "view_rating": 0.0}


def test_failed_reads_give_empty_tables(spark, tmp_path):
    assert tables.table_or_empty(spark, f"{tmp_path}/none", SCHEMAS["notes"]).collect() == []
    spark.createDataFrame([(1,)], "zpid int").write.parquet(f"{tmp_path}/other")
    assert tables.table_or_empty(spark, f"{tmp_path}/other", SCHEMAS["notes"]).schema == SCHEMAS["notes"]
    spark.createDataFrame([(1, "n", None)], SCHEMAS["notes"]).write.parquet(f"{tmp_path}/notes")
    assert tables.table_or_empty(spark, f"{tmp_path}/notes", SCHEMAS["notes"]).count() == 1


def test_repeated_ratings_and_notes_dont_multiply_listings(spark):
    base = spark.createDataFrame([(1,), (2,)], "zpid int")
    ratings = spark.createDataFrame([(1, "yes", "2024-01-02"), (1, "no", "2024-01-01")], "zpid int, rating string, updated_at string")
    notes = spark.createDataFrame([(1, "a"), (1, "b")], "zpid int, note string")
    assert sorted(map(tuple, joins.with_user_data(base, ratings, notes).collect())) == [(1, "yes", "b"), (2, "", "")]


def test_feature_records_field_by_field(spark):
    texts = ['{"beds": "3", "baths": [1], "more": {}, "city": "Bend", "house_style": 2.0}', "{not json", None, '{"beds": null}', "[1]"]
    got = tables.feature_rows(spark.createDataFrame(list(enumerate(texts)), "zpid int, arguments string")).orderBy("zpid").collect()
    assert [(r["beds"], r["baths"], r["city"], r["house_style"]) for r in got] == [(3, None, "Bend", 2), *[(None,) * 4] * 4]
    assert list(FEATURE_KINDS) == got[0].__fields__[1:]


def test_pages_with_odd_json(spark):
    page = '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"gdpClientCache":%s}}}</script>'
    caches = ['"{\\"a\\":1,\\"b\\":{\\"property\\":null},\\"c\\":{\\"property\\":{\\"zpid\\":\\"x\\",\\"homeType\\":\\"CONDO\\",\\"daysOnZillow\\":4}}}"', '"{oops"', "7", '"[]"', '"{\\"a\\":{\\"property\\":[1]}}"']
    df = spark.createDataFrame([(k, page % c) for k, c in enumerate(caches)], "k int, html string")
    got = html.listing_fields(df).orderBy("k").collect()
    assert (got[0]["zpid"], got[0]["home_type"], got[0]["days_listed"]) == (None, "CONDO", 4)
    assert all(r["home_type"] is None for r in got[1:])
