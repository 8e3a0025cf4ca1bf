"""Registered queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from loftline import catalog, catalog_more, catalog_tables  # noqa: F401

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    found = duck.execute(catalog.ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    rows = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == rows


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0


def test_first_qualifying_takes_the_row_met_first(spark, tmp_path):
    """Lines of the same date and number: the SQL leaves them open, a scan in order meets one first."""
    lines = [(1, 9, 2, 50.0, "1995-08-16"), (1, 5, 2, 45.0, "1995-08-16"), (1, 4, 2, 3.0, "1995-08-16"), (2, 5, 1, 41.0, "1996-09-17"), (2, 9, 1, 49.0, "1996-09-17")]
    held = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_shipdate string").coalesce(1)
    held.withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(4, "old rod"), (5, "blue rod"), (9, "hot rod")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(map(tuple, catalog.QUERIES["first_qualifying"](spark, str(tmp_path)).collect())) == [(1, "hot rod", 2), (2, "blue rod", 1)]


def test_first_qualifying_takes_nulls_last(spark, tmp_path):
    """A line without a date or number isn't the nearest, unless its order has no other; the SQL says so too."""
    lines = [(1, 9, 2, 50.0, None), (1, 5, 2, 45.0, "1995-08-16"), (2, 5, None, 41.0, "1996-09-17"), (2, 9, 4, 49.0, "1996-09-17"), (3, 4, None, 44.0, None), (3, 9, 1, 44.0, None)]
    held = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_shipdate string").coalesce(1)
    held.withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(4, "old rod"), (5, "blue rod"), (9, "hot rod")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = sorted(con.execute(catalog.ORACLE["first_qualifying"]).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["first_qualifying"](spark, str(tmp_path)).collect())) == want == [(1, "blue rod", 2), (2, "hot rod", 4), (3, "hot rod", 1)]
