"""Learning weights from ratings: pairwise hinge loss, bounded."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loftline.functions.scoring import scored
from loftline.operators import filters
from loftline.operators.pairs import RATING_VALUES, SHAPE_ROWS, TURNED, Ranges, even_parts, hinge_pulls
from loftline.plans.listings import listing_view
from loftline.sources.lineage import stored
from loftline.spec import DEFAULT_WEIGHTS, QuerySpec

MAX_WEIGHT, MIN_RATINGS = 50.0, 10
#: Rated rows up to which the loss is minimised in the driver; more of them stay in Spark.
MAX_RATED = 20_000


@dataclass(frozen=True)
class LearnParams:
    l2: float
    rate: float
    margin: float

    @classmethod
    def of(cls, aggressiveness: float) -> LearnParams:
        a = min(0.9, max(0.1, aggressiveness))
        return cls(max(0.01, 0.1 / a), min(0.9, 0.5 + 0.4 * a), 0.8 + 0.8 * a)


def _scores(w: np.ndarray, x: np.ndarray, turned: np.ndarray) -> np.ndarray:
    flip = turned == (w > 0)
    return np.where(flip, 100.0 - x, x) @ np.abs(w)


class PairLoss:
    """Loss and subgradient over all pairs of different rating, without listing the pairs."""

    def __init__(self, names: list[str], sizes: Mapping[int, int], w0: np.ndarray, p: LearnParams) -> None:
        self.names, self.w0, self.p = names, w0, p
        self.turned = np.array([n in TURNED for n in names])
        levels = sorted(RATING_VALUES.values())
        self.n_pairs = sum(sizes.get(a, 0) * sizes.get(b, 0) for a in levels for b in levels if b < a)

    def pulls(self, trials: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray, float]]:
        """For each trial the summed loss, and the sums of the features and of 1 over rows times the slope by their score."""
        raise NotImplementedError

    def many(self, trials: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        """Loss and subgradient at each of ``trials``, in one pass over the rows."""
        out = []
        for w, (loss, by_feature, by_one) in zip(trials, self.pulls(trials)):
            slope = np.where(self.turned == (w > 0), 100.0 * by_one - by_feature, by_feature) * np.where(w < 0, -1.0, 1.0)
            pull = self.p.l2 * self.n_pairs
            out.append((loss + pull * float(((w - self.w0) ** 2).sum()), slope + 2 * pull * (w - self.w0)))
        return out

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        return self.many([w])[0]


class CollectedLoss(PairLoss):
    """Of rows in the driver."""

    def __init__(self, x: np.ndarray, y: np.ndarray, names: list[str], w0: np.ndarray, p: LearnParams) -> None:
        super().__init__(names, Counter(y.tolist()), w0, p)
        self.x, self.y = x, y

    def pulls(self, trials: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray, float]]:
        return [self._pull(w) for w in trials]

    def _pull(self, w: np.ndarray) -> tuple[float, np.ndarray, float]:
        s = _scores(w, self.x, self.turned)
        coef, loss = np.zeros(len(s)), 0.0
        for a in range(3):
            for b in range(a):
                up, down, step = np.flatnonzero(self.y == a), np.flatnonzero(self.y == b), a - b
                at, low = s[up] - self.p.margin / step, np.sort(s[down])
                first = np.searchsorted(low, at, "right")
                beyond = np.append(np.cumsum(low[::-1])[::-1], 0.0)[first]
                loss += float((step * (beyond - (len(low) - first) * at)).sum())
                coef[up] -= step * (len(low) - first)
                coef[down] += step * np.searchsorted(np.sort(at), s[down], "left")
        return loss, coef @ self.x, float(coef.sum())


class SpreadLoss(PairLoss):
    """Of a table: every call is one aggregate over it, of which a row for each trial comes back.

    ``rows`` has the features by name and ``level``; they are read at every call.  Some of
    them, kept in the driver, shape the ranges of the trials' scores.
    """

    def __init__(self, rows: DataFrame, names: list[str], w0: np.ndarray, p: LearnParams) -> None:
        super().__init__(names, {r["level"]: r["count"] for r in rows.groupBy("level").count().collect()}, w0, p)
        self.rows = rows.withColumn("_one", F.lit(1.0))
        self.shape = np.array([tuple(r) for r in rows.select(*names).limit(SHAPE_ROWS).collect()], float).reshape(-1, len(names))

    def pulls(self, trials: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray, float]]:
        scores = []
        for w in trials:
            flip = self.turned == (w > 0)
            scores.append(reduce(add, [((100.0 - F.col(n)) if f else F.col(n)) * float(abs(v)) for n, f, v in zip(self.names, flip, w)]))
        ranges = Ranges([_scores(w, self.shape, self.turned) for w in trials], even_parts(self.rows))
        found = {r["trial"]: r for r in hinge_pulls(self.rows, "level", self.p.margin, scores, ranges, [*self.names, "_one"]).collect()}
        none = (0.0, np.zeros(len(self.names)), 0.0)
        return [(found[k]["loss"], np.array([found[k][n] for n in self.names]), found[k]["_one"]) if k in found else none for k in range(len(trials))]


class Curvature:
    """The inverse of a loss's curvature, as told by its last few steps and changes of slope."""

    def __init__(self, memory: int = 8) -> None:
        self.memory, self.steps = memory, []

    def add(self, step: np.ndarray, change: np.ndarray) -> None:
        bend = float(step @ change)
        if bend > 1e-10 * float(np.linalg.norm(step) * np.linalg.norm(change)):
            self.steps = [*self.steps[1 - self.memory :], (step, change)]

    def descent(self, slope: np.ndarray, free: np.ndarray) -> np.ndarray:
        """The quasi-Newton step down ``slope`` among the free coordinates."""
        q, used = np.where(free, slope, 0.0), []
        steps = [(np.where(free, s, 0.0), np.where(free, y, 0.0)) for s, y in self.steps]
        steps = [(s, y) for s, y in steps if s @ y > 0]
        for s, y in reversed(steps):
            used.append((s @ q) / (s @ y))
            q = q - used[-1] * y
        if steps:
            s, y = steps[-1]
            q = q * (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(used)):
            q = q + (a - (y @ q) / (s @ y)) * s
        return -q


#: Lengths of a step that are tried in one pass, and passes over the rows at most.
LENGTHS = (3.0, 1.0, 0.4, 0.15, 0.05, 0.01)
PASSES = 30


def minimise(loss: PairLoss, w0: np.ndarray, low: float = -MAX_WEIGHT, high: float = MAX_WEIGHT, passes: int = PASSES, tolerance: float = 1e-6) -> np.ndarray:
    """Least loss on a box by limited-memory curvature and projected steps; every pass over the rows tries several lengths.

    Coordinates held at a bound by their slope don't move.  Where no length helps, the
    curvature is forgotten for the plain slope, and then the lengths shrink.  It ends when
    a step along the plain slope gains less than ``tolerance`` of the loss, or with the passes.
    """
    w = np.clip(w0, low, high)
    [(value, slope)] = loss.many([w])
    known, reach = Curvature(), 1.0
    for _ in range(passes - 1):
        free = ~((w <= low) & (slope > 0) | (w >= high) & (slope < 0))
        plain = not known.steps
        move = known.descent(slope, free)
        if not plain and move @ slope >= 0:
            known, plain, move = Curvature(), True, np.where(free, -slope, 0.0)
        size = float(np.linalg.norm(move))
        if size < 1e-12:
            break
        if plain:
            move = move * (reach / size)
        trials = [np.clip(w + t * move, low, high) for t in LENGTHS]
        found = loss.many(trials)
        best = min(range(len(trials)), key=lambda k: found[k][0])
        gain = value - found[best][0]
        if gain > 0:
            known.add(trials[best] - w, found[best][1] - slope)
            if plain:
                reach *= LENGTHS[best]
            w, (value, slope) = trials[best], found[best]
        if gain <= tolerance * max(abs(value), 1.0):
            if plain and gain > 0:
                break
            if plain:
                reach *= LENGTHS[-1]
                if reach < 1e-9:
                    break
            known = Curvature()
    return w


def feature_matrix(scores: DataFrame, defaults: Mapping[str, float] = DEFAULT_WEIGHTS) -> tuple[list[str], list[Column]]:
    """Features of a scored table, and their scores as columns of these names; a score that is missing or no number counts 50.

    A feature is a column that ends in ``_score`` and whose name without every ``_score`` is a weight.
    """
    columns = {c.replace("_score", ""): c for c in scores.columns if c.endswith("_score")}
    names = [n for n in defaults if n in columns or f"{n}_score" in scores.columns]
    of = lambda n: F.col(columns.get(n, f"{n}_score"))
    return names, [F.coalesce(F.nanvl(of(n).cast("double"), F.lit(50.0)), F.lit(50.0)).alias(n) for n in names]


def learned_weights(scores: DataFrame, ratings: DataFrame, aggressiveness: float = 0.4, defaults: Mapping[str, float] = DEFAULT_WEIGHTS) -> tuple[dict[str, float], dict[str, object]]:
    """Weights blended from the learned and the default ones, and a report.

    Every rated row counts.  Up to ``MAX_RATED`` of them are collected; more stay in a
    written table, and each step of the search is an aggregate over it.
    """
    names, columns = feature_matrix(scores, defaults)
    level = reduce(lambda c, r: c.when(F.col("rating") == r[0], r[1]), RATING_VALUES.items(), F).alias("level")
    rated = scores.join(ratings.where(F.col("rating").isin(*RATING_VALUES)).select("zpid", "rating"), "zpid").select("zpid", level, *columns)
    p, w0 = LearnParams.of(aggressiveness), np.array([float(defaults[n]) for n in names])
    rows = rated.orderBy("zpid").drop("zpid").limit(MAX_RATED + 1).collect()
    if len(rows) < MIN_RATINGS:
        raise ValueError(f"at least {MIN_RATINGS} ratings are needed, not {len(rows)}")
    if len(rows) <= MAX_RATED:
        loss: PairLoss = CollectedLoss(np.array([r[1:] for r in rows], float), np.array([r["level"] for r in rows]), names, w0, p)
        n_rated = len(rows)
    else:
        table = stored(rated.drop("zpid"))
        loss, n_rated = SpreadLoss(table, names, w0, p), table.count()
    if not loss.n_pairs:
        return dict(defaults), {"success": False, "n_pairs": 0}
    w = minimise(loss, w0)
    blended = p.rate * w + (1 - p.rate) * w0
    info = {"success": True, "n_pairs": loss.n_pairs, "n_rated": n_rated, "loss_before": loss(w0)[0], "loss_after": loss(w)[0]}
    return {**defaults, **dict(zip(names, map(float, blended)))}, info


def learned_view(base: DataFrame, ratings: DataFrame, notes: DataFrame, spec: QuerySpec) -> tuple[DataFrame, dict[str, float], dict[str, object]]:
    """The listing view under weights learned from ratings of the listings that its filters leave.

    Returns the view's rows by score, the weights and the learner's report.
    """
    known = filters.by_status(filters.by_financing(scored(base, spec.weights, spec.params), spec.financing), spec.statuses)
    mine = ratings.where(F.col("rating").isin(*RATING_VALUES)).join(known.select("zpid"), "zpid", "left_semi")
    weights, info = learned_weights(known, mine, spec.aggressiveness)
    rows, _ = listing_view(base, mine, notes, replace(spec, weights=weights, mode="score", geo_only=False))
    return rows, weights, info


def scaled_weights(weights: Mapping[str, float], low: float = 0.1, high: float = MAX_WEIGHT) -> dict[str, float]:
    """Each sign's weights brought to a range of sizes, in ascending order of value; zeros stay.

    Among negative weights the most negative thus gets the smallest size.  Equal
    weights of a sign all get half of the range's end.
    """
    out = {k: 0.0 for k in weights}
    for sign in (1.0, -1.0):
        some = {k: w for k, w in weights.items() if w * sign > 0}
        least, span = min(some.values(), default=0.0), max(some.values(), default=0.0) - min(some.values(), default=0.0)
        out |= {k: sign * (low + (w - least) / span * (high - low) if span else high / 2) for k, w in some.items()}
    return out
