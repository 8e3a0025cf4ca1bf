"""Preference pairs and their loss."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATING_VALUES = {"yes": 2, "maybe": 1, "no": 0}
#: Features that the learner turns round, as their scores are already inverted.
TURNED = ("avg_risk_severity", "avg_crime_severity", "avg_school_distance", "drive_time")


#: Rated rows whose positions may be sent to every task; more of them are joined by level.
MAX_SENT = 1 << 22


#: Rows of a strip of partners; pairs come a row against a strip at a time.
BLOCK = 256


class Unranking:
    """Numbers all pairs of different value, and finds the rows of any of them.

    Rows stand in the order of their values, then positions, so the partners of lower value are
    those before the first row of a value.  These are cut into strips, and pairs are numbered
    strip by strip, row by row: a stretch of the result holds few different positions,
    which are stored as short numbers in runs that repeat.  All strips of a value but the last
    are alike, so a pair's rows come from whole divisions by a few constants.
    """

    def __init__(self, pos: np.ndarray, value: np.ndarray) -> None:
        order = np.lexsort((pos, value))
        self.pos, self.value = pos[order], value[order]
        starts = [*np.unique(self.value, return_index=True)[1].tolist(), len(pos)]
        # Like strips: their numbers, the first row and how many, the first partner and the strip's width.
        self.total, self.strips = 0, []
        for first, end in zip(starts[1:], starts[2:]):
            even = max(0, first // BLOCK - 1) * BLOCK
            for partner, width, partners in ((0, BLOCK, even), (even, first - even, first - even)):
                if partners:
                    self.strips.append((self.total, self.total + (end - first) * partners, first, end - first, partner, width))
                    self.total = self.strips[-1][1]

    def rows(self, number: Column | np.ndarray, div: Callable, choose: Callable) -> tuple:
        """Where both rows of the numbered pairs stand, that of higher value first.

        Columns and arrays differ in whole division and the choice among cases, so both are given.
        """
        own, other = [], []
        for start, stop, first, rows, partner, width in self.strips:
            at = number - start
            own.append((number < stop, div(at % (rows * width), width) + first))
            other.append((number < stop, div(at, rows * width) * width + at % width + partner))
        return choose(own), choose(other)

    def pairs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both positions and the difference of the values of the pairs with these numbers."""
        own, other = self.rows(numbers, np.floor_divide, lambda cases: np.select(*zip(*cases)) if cases else numbers[:0])
        i, j, diff = self.pos[own], self.pos[other], self.value[own] - self.value[other]
        return np.minimum(i, j), np.maximum(i, j), np.where(i < j, diff, -diff)

    def listed(self, numbers: DataFrame) -> DataFrame:
        """The same for numbers in a column ``id``: i, j, diff; the positions and values go with the tasks."""
        held = numbers.sparkSession.createDataFrame(pa.table({"pos": [self.pos.astype(np.int64)], "value": [self.value.astype(np.int32)]}))
        own, other = self.rows(F.col("id"), lambda x, y: F.call_function("div", x, F.lit(y)), lambda cases: reduce(lambda rest, case: F.when(*case).otherwise(rest), reversed(cases), F.lit(0)).cast("int"))
        # No place is beyond the end; said so, no column is nullable, and files need no marks of nulls.
        at = lambda name, row: F.coalesce(F.get(held.select(name).scalar(), F.col(row)), F.lit(0))
        found = numbers.select(own.alias("own"), other.alias("other")).select(
            at("pos", "own").alias("own"), at("pos", "other").alias("other"), (at("value", "own") - at("value", "other")).alias("diff")
        )
        return found.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") < F.col("other"), F.col("diff")).otherwise(-F.col("diff")).alias("diff"))


def preference_pairs(rated: DataFrame, pos: str, value: str, levels: Sequence[int] = (0, 1, 2), first: int = 0, stop: int | None = None) -> DataFrame:
    """Pairs i < j of different value: i, j, diff; of all of them, those numbered from ``first`` up to ``stop``.

    ``pos`` and ``value`` are whole numbers; a position occurs once.  Every task makes an
    even stretch of the pairs by their numbers, from the positions and values of up to
    ``MAX_SENT`` rows, which all tasks get.  Of more rows, whose pairs would fill a
    petabyte, each row asks for each other level in an equi-join; these pairs have no numbers.
    """
    own = rated.where(F.col(pos).isNotNull() & F.col(value).isin(list(levels))).select(F.col(pos).cast("long").alias("i"), F.col(value).cast("int").alias("v"))
    held = own.limit(MAX_SENT + 1).toArrow()
    if held.num_rows > MAX_SENT:
        if first or stop is not None:
            raise ValueError(f"pairs of more than {MAX_SENT} rows have no numbers")
        a = own.withColumn("want", F.explode(F.array(*[F.lit(v) for v in levels]))).where("want != v")
        b = own.select(F.col("i").alias("j"), F.col("v").alias("want"))
        return a.join(b, "want").where("i < j").select("i", "j", (F.col("v") - F.col("want")).alias("diff"))
    known = Unranking(held["i"].to_numpy(), held["v"].to_numpy())
    stop = known.total if stop is None else min(stop, known.total)
    n = stop - min(first, stop)
    # Tasks of a million pairs up to 256 of them, then larger ones up to 16 million, as each has a file to open and commit.
    numbers = rated.sparkSession.range(stop - n, stop, 1, max(1, min(10_000, max(min(256, n >> 20), n >> 24))))
    names = {f.name: f.dataType for f in rated.schema}
    return known.listed(numbers).select(F.col("i").cast(names[pos]).alias("i"), F.col("j").cast(names[pos]).alias("j"), "diff")


def learner_score(weights: Mapping[str, float]) -> Column:
    """The learner's own total; missing scores count 50."""
    terms = []
    for name, w in weights.items():
        s = F.coalesce(F.nanvl(F.col(f"{name}_score").cast("double"), F.lit(50.0)), F.lit(50.0))
        turned = (name in TURNED) == (w > 0)
        terms.append(((100.0 - s) if turned else s) * float(abs(w)))
    return reduce(add, terms)


def hinge_loss(pairs: DataFrame, scores: DataFrame, pos: str, margin: float) -> DataFrame:
    """One row: summed hinge loss and number of pairs."""
    a = scores.select(F.col(pos).alias("i"), F.col("score").alias("si"))
    b = scores.select(F.col(pos).alias("j"), F.col("score").alias("sj"))
    each = F.greatest(F.lit(0.0), -F.col("diff") * (F.col("si") - F.col("sj")) + F.lit(margin))
    return pairs.join(a, "i").join(b, "j").agg(F.coalesce(F.sum(each), F.lit(0.0)).alias("loss"), F.count("*").alias("n_pairs"))


#: Rows whose scores shape the ranges; they only decide how evenly tasks are loaded.
SHAPE_ROWS = 2000
_BINS = 4096


class Ranges:
    """Ranges of scores with about even numbers of rows, one set of them for each trial.

    ``shapes`` holds some scores of each trial.  A score's fine bin is computed, and the
    bin's range looked up, so a range's number never falls as the score rises.
    """

    def __init__(self, shapes: Sequence[np.ndarray], parts: int) -> None:
        self.ends, self.maps = [], []
        for scores in shapes:
            low, high = (float(scores.min()), float(scores.max())) if len(scores) else (0.0, 1.0)
            width = (high - low) / _BINS or 1.0
            upto = np.searchsorted(np.sort(scores), low + width * np.arange(_BINS))
            self.ends.append((low, width))
            self.maps.append((upto * parts // max(1, len(scores))).tolist())

    def of(self, score: Column, trial: Column) -> Column:
        # Written as text, a long list is one constant.
        listed = lambda values, kind: F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")
        low, width = (F.element_at(listed([e[k] for e in self.ends], "double"), trial + 1) for k in (0, 1))
        bin_ = F.least(F.greatest(F.floor((score - low) / width), F.lit(0)), F.lit(_BINS - 1)).cast("int")
        return F.element_at(F.element_at(F.array(*[listed(m, "int") for m in self.maps]), trial + 1), bin_ + 1)


def even_parts(df: DataFrame) -> int:
    return min(2000, max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _against_all(rows: DataFrame, value: str, margin: float, trials: Sequence[Column], ranges: Ranges, columns: Sequence[str], levels: Sequence[int]) -> DataFrame:
    """Marks of rows, each with what the rows of another level hold against it; no pair is listed.

    A row of a higher level loses to those of a lower level, d levels down, whose score
    is above its own less margin / d.  Its mark stands there, theirs at their score; each
    of ``trials`` is a score of its own.  Equal marks are summed before anything else, so
    scores that are all alike are one row.  Out come ``trial``, ``step`` (d), ``at``,
    ``is_low``, ``times`` (rows of the mark), the number ``n`` and sum ``s`` of low marks
    above it, the number ``under`` of high marks below it, and the sums of ``columns``.
    Running sums tell these, in ranges of the score, each continued from a row per range.
    """
    scored = rows.select(F.col(value).alias("_v"), *columns, F.posexplode(F.array(*trials)).alias("trial", "score"))
    sides = []
    for high in levels:
        for low in levels:
            if high > low:
                pair, step = F.lit(high * (max(levels) + 1) + low).alias("pair"), float(high - low)
                side = lambda at, is_low, pair=pair, step=step: F.struct(pair, F.lit(step).alias("step"), at.alias("at"), F.lit(is_low).alias("is_low"))
                sides.append(F.when(F.col("_v") == high, side(F.col("score") - margin / step, 0)).when(F.col("_v") == low, side(F.col("score"), 1)))
    marks = scored.select("trial", *columns, F.explode(F.array_compact(F.array(*sides))).alias("m"))
    every = marks.groupBy("trial", "m.pair", "m.step", "m.at", "m.is_low").agg(F.count(F.lit(1)).alias("times"), *[F.sum(c).alias(c) for c in columns])
    every = every.withColumn("part", ranges.of(F.col("at"), F.col("trial")))
    low_n, high_n = F.col("is_low") * F.col("times"), (1 - F.col("is_low")) * F.col("times")
    low_at = low_n * F.col("at")
    group = ("trial", "pair")
    totals = every.groupBy(*group, "part").agg(F.sum(low_n).alias("n"), F.sum(low_at).alias("s"), F.sum(high_n).alias("h"))
    beyond = Window.partitionBy(*group).orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    upto = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = totals.select(
        *group, "part", F.coalesce(F.sum("n").over(beyond), F.lit(0)).alias("more_n"), F.coalesce(F.sum("s").over(beyond), F.lit(0.0)).alias("more_s"), F.sum("h").over(upto).alias("upto_h")
    )
    # Of equal marks the high one stands above: neither counts the other.
    above = Window.partitionBy(*group, "part").orderBy(F.desc("at"), "is_low").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = every.withColumns({"n": F.sum(low_n).over(above), "s": F.sum(low_at).over(above), "h": F.sum(high_n).over(above)}).join(F.broadcast(carried), [*group, "part"])
    return run.select("trial", "step", "at", "is_low", "times", (F.col("n") + F.col("more_n")).alias("n"), (F.col("s") + F.col("more_s")).alias("s"), (F.col("upto_h") - F.col("h")).alias("under"), *columns)


def _loss() -> Column:
    total = F.sum(F.when(F.col("is_low") == 0, F.col("times") * F.col("step") * (F.col("s") - F.col("n") * F.col("at"))))
    return F.coalesce(total, F.lit(0.0)).alias("loss")


def summed_hinge(scores: DataFrame, value: str, margin: float, levels: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """One row: ``loss``, the hinge loss over all pairs of different levels, and ``n_pairs``; no pair is listed.

    ``scores`` has ``value`` and ``score``, and is read twice.
    """
    shape = scores.select(F.col("score").cast("double")).where("score IS NOT NULL").limit(SHAPE_ROWS).toArrow()["score"].to_numpy()
    run = _against_all(scores, value, margin, [F.col("score")], Ranges([shape], even_parts(scores)), [], levels)
    sizes = scores.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    n_all = sizes.where(F.col("v").isin(list(levels))).agg(((F.pow(F.sum("n"), 2) - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("n_pairs"))
    return run.agg(_loss()).crossJoin(F.broadcast(n_all)).select("loss", F.coalesce("n_pairs", F.lit(0).cast("long")).alias("n_pairs"))


def hinge_pulls(rows: DataFrame, value: str, margin: float, trials: Sequence[Column], ranges: Ranges, columns: Sequence[str], levels: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """A row for each of ``trials`` that has a pair: ``loss`` as in ``summed_hinge`` and, for each of ``columns``, its sum over rows times the loss's slope by their score.

    All trials are computed in one pass over ``rows``.
    """
    run = _against_all(rows, value, margin, trials, ranges, columns, levels)
    slope = F.col("step") * F.when(F.col("is_low") == 0, -F.col("n")).otherwise(F.col("under"))
    return run.groupBy("trial").agg(_loss(), *[F.coalesce(F.sum(slope * F.col(c)), F.lit(0.0)).alias(c) for c in columns])
