"""The box minimiser, pair numbers and one-pass hinge sums."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loftline.operators import pairs
from loftline.plans import learning
from loftline.spec import DEFAULT_WEIGHTS


def subgradient(loss, w0, rounds=100):
    """The plain method that the minimiser has to match: projected steps, halved until one helps."""
    w, (value, grad), step = w0.copy(), loss(w0), 1.0
    for _ in range(rounds):
        for _ in range(30):
            new = np.clip(w - step * grad / np.linalg.norm(grad), -50, 50)
            new_value, new_grad = loss(new)
            if new_value < value - 1e-9 * abs(value):
                break
            step /= 2
        else:
            break
        done, w, value, grad, step = value - new_value < 1e-6 * abs(value), new, new_value, new_grad, step * 2
        if done:
            break
    return value


def rated(seed, n, names, noise):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(names))) * 100
    score = x @ rng.normal(size=len(names)) * 3 + rng.normal(size=n) * noise
    return x, np.digitize(score, np.quantile(score, [0.4, 0.7]))


@pytest.mark.parametrize(("seed", "n", "aggressiveness", "noise"), [(1, 40, 0.4, 5), (2, 300, 0.9, 40), (3, 3000, 0.1, 100), (4, 20, 0.9, 0), (5, 12, 0.4, 1000)])
def test_no_worse_than_subgradient_steps(seed, n, aggressiveness, noise):
    names = list(DEFAULT_WEIGHTS)
    w0 = np.array([float(DEFAULT_WEIGHTS[k]) for k in names])
    loss = learning.CollectedLoss(*rated(seed, n, names, noise), names, w0, learning.LearnParams.of(aggressiveness))
    passes, many = [], loss.many
    loss.many = lambda trials: passes.append(len(trials)) or many(trials)
    w = learning.minimise(loss, w0)
    assert len(passes) <= 30
    assert loss(w)[0] <= subgradient(loss, w0)
    assert (np.abs(w) <= 50).all()


def test_box_is_held_and_slopes_push_against_it():
    """Without a pull to the defaults, weights run into the box; there the slope points out of it."""
    x, y = rated(7, 200, ["beds", "baths", "drive_time"], 0)
    loss = learning.CollectedLoss(x, y, ["beds", "baths", "drive_time"], np.array([1.0, -1.0, 2.0]), learning.LearnParams(0.0, 1.0, 5000.0))
    w = learning.minimise(loss, loss.w0, -2.5, 3.0)
    slope = loss(w)[1]
    assert (w >= -2.5).all() and (w <= 3.0).all() and ((w == -2.5) | (w == 3.0)).any()
    assert (slope[w == 3.0] <= 0).all() and (slope[w == -2.5] >= 0).all()


def test_fifty_thousand_rows_in_spark_equal_numpy(spark):
    names = ["beds", "drive_time", "price"]
    x, y = rated(9, 50_000, names, 30)
    w0, p = np.array([2.0, 1.0, 3.0]), learning.LearnParams.of(0.4)
    table = spark.createDataFrame(pd.DataFrame({"level": y.astype("int32"), **{n: x[:, k] for k, n in enumerate(names)}})).repartition(4).cache()
    here, there = learning.CollectedLoss(x, y, names, w0, p), learning.SpreadLoss(table, names, w0, p)
    for a, b in zip(here.many([w0, -w0]), there.many([w0, -w0])):
        assert b[0] == pytest.approx(a[0], rel=1e-9) and b[1] == pytest.approx(a[1], rel=1e-6)
    one, other = learning.minimise(here, w0, passes=4), learning.minimise(there, w0, passes=4)
    assert here(other)[0] == pytest.approx(here(one)[0], rel=1e-6) and other == pytest.approx(one, abs=1e-4)
    passes, many = [], here.many
    here.many = lambda trials: passes.append(len(trials)) or many(trials)
    assert here(learning.minimise(here, w0))[0] <= here(one)[0] and len(passes) <= 33
    table.unpersist()


def test_scores_that_are_all_alike(spark):
    rows = [(k % 3, 5.0) for k in range(90)]
    df = spark.createDataFrame(rows, "value int, score double")
    [r] = pairs.summed_hinge(df, "value", 1.0).collect()
    assert (r["loss"], r["n_pairs"]) == (pytest.approx(3 * 900), 2700)
    # One row a mark and pair reaches the windows, however often a score repeats.
    run = pairs._against_all(df, "value", 1.0, [F.col("score")], pairs.Ranges([np.array([5.0])], 8), [], (0, 1, 2))
    # Steps of one share their low mark's place and width; each pair has two marks.
    assert run.count() == 6 and run.agg(F.sum("times")).first()[0] == 180


def plain_pairs(rows):
    return {(i, j, a - b) for (i, a), (j, b) in itertools.combinations(sorted(rows), 2) if a != b}


@pytest.mark.parametrize(("n", "shares"), [(0, (1, 1, 1)), (1, (1, 1, 1)), (50, (1, 1, 1)), (70, (1, 0, 9)), (40, (0, 1, 0)), (60, (30, 1, 1))])
def test_numbered_pairs(spark, n, shares):
    rng = random.Random(n)
    rows = [(p, rng.choices((0, 1, 2), shares)[0]) for p in rng.sample(range(-500, 500), n)]
    df = spark.createDataFrame(rows, "pos long, value int")
    want = plain_pairs(rows)
    assert {tuple(r) for r in pairs.preference_pairs(df, "pos", "value").collect()} == want
    # Any stripes make up the whole, without an overlap, and are of even size.
    made = [[tuple(r) for r in pairs.preference_pairs(df, "pos", "value", first=k * len(want) // 4, stop=(k + 1) * len(want) // 4).collect()] for k in range(4)]
    assert sorted(itertools.chain(*made)) == sorted(want)
    assert max(map(len, made)) - min(map(len, made)) <= 1


def test_pairs_have_no_join_and_even_tasks(spark):
    df = spark.range(3000).select(F.col("id").alias("pos"), (F.col("id") % 3).cast("int").alias("value"))
    found = pairs.preference_pairs(df, "pos", "value")
    assert "Join" not in found._jdf.queryExecution().toString()
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 * 2000 // 2 * 1 and max(sizes) - min(sizes) <= 1


def test_pairs_of_nulls_other_levels_and_too_many_rows(spark, monkeypatch):
    rows = [(1, 0), (2, 2), (3, None), (None, 1), (4, 7), (5, 1)]
    df = spark.createDataFrame(rows, "pos int, value int")
    want = plain_pairs([(1, 0), (2, 2), (5, 1)])
    assert {tuple(r) for r in pairs.preference_pairs(df, "pos", "value").collect()} == want
    monkeypatch.setattr(pairs, "MAX_SENT", 2)
    assert {tuple(r) for r in pairs.preference_pairs(df, "pos", "value").collect()} == want
    with pytest.raises(ValueError):
        pairs.preference_pairs(df, "pos", "value", first=1)


def test_pairs_come_in_tiles_of_few_positions(spark, monkeypatch):
    """A stretch of the result names few positions, and the tiles make up the whole."""
    rng = random.Random(8)
    rows = [(p, rng.randrange(3)) for p in rng.sample(range(5000), 700)]
    monkeypatch.setattr(pairs, "BLOCK", 64)
    known = pairs.Unranking(*(np.array(c, np.int64) for c in zip(*rows)))
    i, j, diff = (np.concatenate(c) for c in zip(*(known.pairs(np.arange(a, min(a + 999, known.total))) for a in range(0, known.total, 999))))
    assert set(zip(i.tolist(), j.tolist(), diff.tolist())) == plain_pairs(rows) and len(i) == known.total
    assert max(len(np.unique(c[a : a + 2000])) for c in (i, j) for a in range(0, known.total, 2000)) <= 4 * 64


@pytest.mark.parametrize(("n", "shares"), [(0, (1,)), (40, (0, 1)), (9, (1, 1, 1)), (61, (5, 4, 3)), (70, (1, 0, 9)), (90, (1, 2, 3, 4, 5, 6, 7))])
def test_pairs_are_numbered_in_columns(spark, monkeypatch, n, shares):
    """No pair passes through Python or is marked for nulls; Columns and arrays number alike, whatever the widths of the strips."""
    monkeypatch.setattr(pairs, "BLOCK", 4)
    rng, levels = random.Random(n), range(len(shares))
    rows = [(p, rng.choices(levels, shares)[0]) for p in rng.sample(range(-500, 500), n)]
    found = pairs.preference_pairs(spark.createDataFrame(rows, "pos int, value int"), "pos", "value", levels)
    assert not re.search("Arrow|Python|Join", found._jdf.queryExecution().executedPlan().toString())
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in found.schema] == [("i", "int", False), ("j", "int", False), ("diff", "int", False)]
    made = [tuple(r) for r in found.collect()]
    assert sorted(made) == sorted(plain_pairs(rows))
    known = pairs.Unranking(*np.array(rows, np.int64).reshape(-1, 2).T)
    assert made == list(zip(*(c.tolist() for c in known.pairs(np.arange(known.total)))))
