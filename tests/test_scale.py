"""Plans for large tables, forced on small ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loftline.functions import quantiles
from loftline.operators import pairs, ranks
from loftline.plans import learning
from loftline.sources import tables


@pytest.mark.parametrize("small", [1 << 20, 40, 3])
def test_exact_quantiles(spark, small, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", small)
    rng = random.Random(1)
    shares = [0.0, 0.01, 1 / 3, 0.5, 0.95, 1.0]
    for values in ([rng.random() for _ in range(700)], [1.0] * 300, [1.0] * 150 + [2.0] * 150, [float(rng.randint(0, 3)) for _ in range(500)], [5.0], [3.0, None, 1.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        want = np.quantile([v for v in values if v is not None], shares)
        assert quantiles.exact_quantiles(df, F.col("x"), shares) == pytest.approx(list(want), abs=1e-12)
    assert quantiles.exact_quantiles(spark.createDataFrame([], "x double"), F.col("x"), [0.5]) == [None]


def test_quantiles_take_two_passes_whatever_their_number(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "_placed", None)
    df = spark.range(30_000).select((F.col("id") * 7919 % 30_011).cast("double").alias("x"))
    want = np.quantile([k * 7919 % 30_011 for k in range(30_000)], np.linspace(0, 1, 41))
    assert quantiles.exact_quantiles(df, F.col("x"), np.linspace(0, 1, 41).tolist()) == pytest.approx(want.tolist(), abs=1e-9)
    # A half of all values alike, infinities, and values that aren't numbers.
    odd = spark.createDataFrame([(v,) for v in [0.0] * 500 + [float("-inf")] * 3 + list(map(float, range(1, 490))) + [float("inf")] * 2 + [None] * 9], "x double")
    assert quantiles.exact_quantiles(odd, F.col("x"), [0.1, 0.502, 0.503, 0.6]) == pytest.approx([0.0, 0.0, 0.0, 93.8], abs=0.5)


def test_not_a_number_is_the_greatest(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0, float("nan")]], "x double")
    low, high = quantiles.exact_quantiles(df, F.col("x"), [1 / 3, 1.0])
    assert low == 2.0 and high != high
    assert all(q != q for q in quantiles.exact_quantiles(df.where("isnan(x)"), F.col("x"), [0.0, 1.0]))


def test_ordinal_exchanges_rows_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(ranks, "stored", lambda df: kept.append(df) or df)
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("a"))
    ranks.ordinal(df, "a", ["id"], "pos")
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange") == 1 and "CASE" not in plan


def test_ordinal_cuts_ties_and_nulls_by_the_second_key(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 2, None, None]), rng.choice([None, *map(float, range(50))])) for i in range(600)]
    df = spark.createDataFrame(rows, "zpid int, a int, b double")
    got = {r["zpid"]: r["pos"] for r in ranks.ordinal(df, "a", ["zpid"], "pos", second="b").collect()}
    last = lambda x: (x is None, x or 0)
    order = sorted(rows, key=lambda r: (last(r[1]), last(r[2]), r[0]))
    assert [got[r[0]] for r in order] == list(range(1, 601))


def test_hinge_loss_from_sums_equals_that_of_pairs(spark):
    rng = random.Random(3)
    for n in (0, 1, 2, 60):
        rows = [(i, rng.randint(0, 2), float(rng.randint(0, 20)) / 4) for i in range(n)]
        df = spark.createDataFrame(rows, "pos int, value int, score double")
        loss = count = 0
        for i in range(n):
            for j in range(i):
                d = rows[i][1] - rows[j][1]
                if d:
                    loss += max(0.0, 0.8 - d * (rows[i][2] - rows[j][2]))
                    count += 1
        [r] = pairs.summed_hinge(df, "value", 0.8).collect()
        assert r["n_pairs"] == count and r["loss"] == pytest.approx(loss, abs=1e-9)


def test_learning_in_spark_equals_that_in_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(4)
    names, n = ["beds", "drive_time", "price"], 60
    x, y = np.round(rng.random((n, 3)) * 100, 1), rng.integers(0, 3, n)
    w0 = np.array([3.0, -2.0, 4.0])
    p = learning.LearnParams(0.0, 0.6, 40.0)
    table = spark.createDataFrame([(int(v), *map(float, r)) for v, r in zip(y, x)], "level int, " + ", ".join(f"{c} double" for c in names))
    here, there = learning.CollectedLoss(x, y, names, w0, p), learning.SpreadLoss(table, names, w0, p)
    for w in (w0, np.array([-1.0, 2.0, 0.5])):
        s = learning._scores(w, x, here.turned)
        slope = np.where(here.turned == (w > 0), 100 - x, x) * np.where(w < 0, -1.0, 1.0)
        loss, grad = 0.0, np.zeros(3)
        for i in range(n):
            for j in range(n):
                d = int(y[i] - y[j])
                if d > 0 and p.margin - d * (s[i] - s[j]) > 0:
                    loss += p.margin - d * (s[i] - s[j])
                    grad -= d * (slope[i] - slope[j])
        for value, g in (here(w), there(w)):
            assert value == pytest.approx(loss, rel=1e-9) and g == pytest.approx(grad, rel=1e-9)
    # The whole search, with tied rows and a missing score.
    scores = spark.createDataFrame([(k, None if k == 3 else float(k % 4) * 25, 90.0 - 5 * k) for k in range(14)], "zpid int, beds_score double, price_score double")
    ratings = spark.createDataFrame([(k, ["yes", "maybe", "no"][k % 3]) for k in range(14)], "zpid int, rating string")
    monkeypatch.setattr(learning, "minimise", lambda loss, w: w - 0.01 * np.sign(loss(w)[1]))
    few, told = learning.learned_weights(scores, ratings)
    monkeypatch.setattr(learning, "MAX_RATED", 12)
    many, also = learning.learned_weights(scores, ratings)
    assert many == pytest.approx(few) and also == pytest.approx(told) and also["n_rated"] == 14


def test_cleared_checkpoint(spark, tmp_path):
    tables.save_checkpoint(spark, f"{tmp_path}/c", 3, 4)
    assert tables.load_checkpoint(spark, f"{tmp_path}/c") == (3, 4)
    tables.clear_checkpoint(spark, f"{tmp_path}/c")
    assert tables.load_checkpoint(spark, f"{tmp_path}/c") is None
