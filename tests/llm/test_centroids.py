"""Centroids against plain integers."""

import hashlib
import math
import random

import numpy as np

from loftline.llm import centroids
from loftline.llm.centroids import Screen


def plain(rows, k=8, rounds=10, dim=64, scale=1024):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    mids = [v for _, v in first]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    place = lambda v: min(range(len(mids)), key=lambda j: (apart(v, mids[j]), j))
    for _ in range(rounds):
        own = [[] for _ in mids]
        for _, v in kept:
            own[place(v)].append(v)
        mids = [[sum(col) // len(vs) for col in zip(*vs)] if vs else c for c, vs in zip(mids, own)]
    out = [(i, place(v), apart(v, mids[place(v)])) for i, v in kept]
    each = {j: sum(d for _, c, d in out if c == j) for j in range(len(mids))}
    fits = lambda d: d if d < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in mids]
    return sorted(((i is not None, i or 0), c, fits(d) or 0, fits(each[c]), fits(sum(each.values())), sha[c]) for i, c, d in out)


def answer(df):
    return sorted(((r["vec_id"] is not None, r["vec_id"] or 0), r["cluster"], r["distance"] or 0, r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_against_plain_integers(spark):
    rng = random.Random(3)
    spots = [[rng.gauss(0, 2) for _ in range(64)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in rng.choice(spots)]) for i in range(300)]
    rows += [(300 + i, list(rows[i % 3][1])) for i in range(150)]  # copies of a few vectors in a third of all rows
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [float("nan")] * 64), (905, [float("inf")] + [0.0] * 63), (906, [0.0] * 64), (7, [0.5] * 64), (None, [0.25] * 64)]
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(5)
    assert answer(centroids.clustered(vectors)) == plain(rows)


def test_ties_few_rows_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    same = [(i, [0.5] * 64) for i in range(30)]
    assert answer(centroids.clustered(spark.createDataFrame(same, kind))) == plain(same)
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert answer(centroids.clustered(spark.createDataFrame(few, kind))) == plain(few)
    out = centroids.clustered(spark.createDataFrame([(1, None), (2, [1.0])], kind))
    assert out.collect() == [] and out.columns == centroids.clustered(spark.createDataFrame(few, kind)).columns


def test_huge_components(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1, 1]) * 10 ** rng.randint(0, top) * rng.random() for _ in range(64)]) for i in range(24) for top in [(3, 9, 38, 250)[i % 4]]]
    rows.append((99, [1e308] * 64))  # beyond double once scaled
    assert answer(centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == plain(rows)


def test_intervals_are_rigorous():
    rng = np.random.default_rng(5)
    for spread in (1, 50, 10_000, 2**26):
        mids = [[int(x) for x in c] for c in rng.integers(-spread, spread + 1, (8, 64))]
        mids[3], mids[5] = list(mids[1]), [x + (k == 0) for k, x in enumerate(mids[1])]
        values = np.concatenate([rng.integers(-spread, spread + 1, (400, 64)), np.array(mids) + rng.integers(0, 2, (8, 64)), np.array(mids)]).astype(np.float64)
        screen, exact = Screen(mids), values.astype(object)
        table = np.array([[((x - np.array(c, object)) ** 2).sum() for c in mids] for x in exact])
        want = [int(min(range(8), key=lambda j: (row[j], j))) for row in table]
        left = screen.shortlist(values)
        assert all(left[i, j] for i, row in enumerate(table) for j in range(8) if row[j] == min(row))
        found, again = screen.nearest(values)
        assert found.tolist() == want
        # Vectors at the three all but equal centroids are recomputed; of the others few are.
        assert again >= 6 and (spread < 50 or left[:400].sum() < 700)
