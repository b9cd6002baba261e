"""Sample quantiles and piecewise-linear maps as Column expressions over sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_values(column: str | Column) -> Column:
    """Aggregate: the non-null values in order."""
    return F.array_sort(F.collect_list(column))


def quantiles(values: Column, taus: Column, kind: int = 7) -> Column:
    """Quantiles of a sorted array at an array of probabilities; empty input gives nulls.

    ``kind`` 7 places probability p at 1 + (n - 1) p, 6 at (n + 1) p and 4 at n p, held within 1..n.
    """
    n = F.size(values)

    def at(p: Column) -> Column:
        h = {7: (n - 1) * p, 6: (n + 1) * p - 1, 4: n * p - 1}[kind]
        h = F.greatest(F.lit(0.0), F.least(h.cast("double"), (n - 1).cast("double")))
        lo = F.get(values, F.floor(h).cast("int"))
        hi = F.get(values, F.ceil(h).cast("int"))
        return lo + (h - F.floor(h)) * (hi - lo)

    return F.transform(taus, at)


def literal(xs) -> Column:
    """An array of doubles."""
    return F.array(*[F.lit(float(x)) for x in xs])


def average_ties(xs: Column, ys: Column) -> Column:
    """ys with the values at equal xs replaced by their mean; both sorted by xs."""
    pairs = F.zip_with(xs, ys, lambda a, b: F.struct(a.alias("x"), b.alias("y")))

    def mean(x: Column) -> Column:
        same = F.transform(F.filter(pairs, lambda q: q["x"] == x), lambda q: q["y"])
        return F.aggregate(same, F.lit(0.0), lambda a, b: a + b) / F.size(same)

    return F.transform(xs, mean)


def interpolate(x: Column, xs: Column, ys: Column, outside: str = "clamp") -> Column:
    """Linear interpolation of ys over sorted xs (ties of ys already averaged).

    Outside the range: ``clamp`` gives the end value; ``offset`` adds the end's difference to x.
    """
    n, k = F.size(xs), F.size(F.filter(xs, lambda v: v <= x))
    x0, x1 = F.get(xs, k - 1), F.get(xs, k)
    y0, y1 = F.get(ys, k - 1), F.get(ys, k)
    first = F.get(ys, F.lit(0)) if outside == "clamp" else x + (F.get(ys, F.lit(0)) - F.get(xs, F.lit(0)))
    last = F.get(ys, n - 1) if outside == "clamp" else x + (F.get(ys, n - 1) - F.get(xs, n - 1))
    inner = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    beyond = x > F.get(xs, n - 1)
    return F.when(x.isNull() | (n <= 0), F.lit(None).cast("double")).when(k == 0, first).when(beyond, last).when(k == n, F.get(ys, n - 1)).otherwise(inner)


def cumulative_share(x: Column, values: Column) -> Column:
    """Share of values at or below x."""
    return F.size(F.filter(values, lambda v: v <= x)) / F.size(values)
