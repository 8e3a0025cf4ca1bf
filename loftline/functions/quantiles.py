"""Exact quantiles of a column of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loftline.operators.joins import cut_points, range_of

#: Values that one task may sort.
SMALL = 1 << 20
#: Size of the sketch, and how far, as a share of all values, a bracket reaches to each side: four times the sketch's error at 99 %.
SKETCH, SLACK = 16384, 0.001


def _placed(values: DataFrame, first: int, size: int) -> tuple[float, float]:
    """The values at the places ``first`` and ``first`` + 1 (or the last) of ``size`` ascending ones.

    What may hold them is narrowed, range by range, until one task can sort it.
    """
    while size > SMALL:
        cuts = cut_points(values, "v")
        parted = values.withColumn("part", range_of(F.col("v"), cuts))
        counts = sorted((r["part"], r["n"], r["lo"], r["hi"]) for r in parted.groupBy("part").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
        before = 0
        for k, (part, n, lo, hi) in enumerate(counts):
            if first < before + n:
                break
            before += n
        last = k if first + 1 < before + n or k + 1 == len(counts) else k + 1
        if lo == hi:
            # One value fills the whole range.
            return lo, lo if last == k else counts[last][2]
        if n == size:
            # Ties have kept the ranges from splitting: the greatest value goes by itself.
            parted = parted.withColumn("part", (F.col("v") == hi).cast("int"))
            n_low = parted.where("part = 0").count()
            part, last, k, n = (0, 0, 0, n_low) if first + 1 < n_low else (1, 1, 1, size - n_low)
            if part or first + 1 == n_low:
                return (hi, hi) if first >= n_low else (parted.where("part = 0").agg(F.max("v")).first()[0], hi)
            values, size = parted.where("part = 0").select("v"), n_low
            continue
        values = parted.where(F.col("part").between(part, counts[last][0])).select("v")
        first, size = first - before, n if last == k else n + counts[last][1]
    row = values.agg(F.sort_array(F.collect_list("v")).alias("v")).select(F.col("v")[first].alias("a"), F.col("v")[F.lit(min(first + 1, size - 1))].alias("b")).first()
    return row["a"], row["b"]


def _brackets(values: DataFrame, shares: Sequence[float]) -> tuple[int, list[tuple[float, float]]]:
    """How many values there are and, for each share, two of them that most surely enclose its place: one pass, by one sketch."""
    sketch = F.kll_sketch_agg_double(F.when(~F.isnan("v"), F.col("v")), SKETCH)
    sides = [min(1.0, max(0.0, s + d)) for s in shares for d in (-SLACK, SLACK)]
    row = values.agg(F.count("*").alias("n"), F.count_if(~F.isnan("v")).alias("told"), sketch.alias("k")).select("n", F.when(F.col("told") > 0, F.kll_sketch_get_quantile_double("k", F.array(*map(F.lit, sides)))).alias("q")).first()
    ends = row["q"] or [math.nan] * len(sides)
    return row["n"], list(zip(ends[::2], ends[1::2]))


def exact_quantiles(df: DataFrame, value: Column, shares: Sequence[float]) -> list[float | None]:
    """Interpolated quantiles of the values that there are; null if there are none.  Not a number counts as the greatest.

    Two passes whatever the number of shares: a sketch brackets each share's place, then the
    values below each bracket are counted and those inside sorted.  Where a bracket holds
    more than one task should sort, it is narrowed further, and should a sketch ever have
    missed, the search goes on without it; the result is exact in any case.
    """
    values = df.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    size, brackets = _brackets(values, shares)
    if not size:
        return [None] * len(shares)
    fits, found = 4 * SLACK * size <= SMALL, []
    v = F.col("v")
    for k, (lo, hi) in enumerate(brackets):
        inside = (v > lo) & (v < hi)
        kept = [F.sort_array(F.collect_list(F.when(inside, v)))] if fits else [F.array().cast("array<double>")]
        found += [c.alias(f"{n}{k}") for n, c in zip(_COUNTED, (F.count_if(v < lo), F.count_if(v == lo), F.count_if(inside), F.count_if(v == hi), F.min(F.when(v > hi, v)), *kept))]
    row, out = values.agg(*found).first(), []
    for k, (share, (lo, hi)) in enumerate(zip(shares, brackets)):
        first = int((size - 1) * share)
        a, b = _settled(values, first, size, lo, hi, *[row[f"{n}{k}"] for n in _COUNTED])
        rest = (size - 1) * share - first
        out.append(a + (b - a) * rest if b != a else a)
    return out


_COUNTED = ("below", "at_lo", "within", "at_hi", "beyond", "kept")


def _settled(values: DataFrame, first: int, size: int, lo: float, hi: float, below: int, at_lo: int, within: int, at_hi: int, beyond: float | None, kept: list[float]) -> tuple[float, float]:
    """The values at ``first`` and the place after it (or the last), from what the bracket [lo, hi] tells."""
    last, inner = min(first + 1, size - 1), below + at_lo
    end = inner + within + (at_hi if hi > lo else 0)
    if not below <= first < end or (last >= end and beyond is None):
        return _placed(values, first, size)
    start, kept_at = max(first, inner), None
    if within and not kept and inner <= last and start < inner + within:
        kept_at = _placed(values.where((F.col("v") > lo) & (F.col("v") < hi)), start - inner, within)

    def at(place: int) -> float:
        if place < inner:
            return lo
        if place < inner + within:
            return kept[place - inner] if kept else kept_at[place - start]
        return hi if place < end else beyond

    return at(first), at(last)
