"""Column helpers shared by the raster and table operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however the projections are merged."""
    return F.transform(F.array(value), body)[0]


def r6(value: Column) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def variance(values: Column) -> Column:
    """Population variance of an array."""
    return let(mean(values), lambda m: mean(F.transform(values, lambda v: (v - m) * (v - m))))


def percentile(values: Column, p: float) -> Column:
    """Linearly interpolated percentile of an array, p in 0..100."""

    def of(s: Column) -> Column:
        at = F.lit(p / 100.0) * (F.size(s) - 1)
        low = F.floor(at).cast("int")
        a, b = F.get(s, low), F.coalesce(F.get(s, low + 1), F.get(s, low))
        return a + (b - a) * (at - low)

    return let(F.sort_array(values), of)


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear interpolation over rising xs, held at both ends."""

    def of(k: Column) -> Column:
        x0, x1, y0, y1 = F.get(xs, k), F.get(xs, k + 1), F.get(ys, k), F.get(ys, k + 1)
        inside = y0 + (y1 - y0) * (x - x0) / F.when(x1 > x0, x1 - x0).otherwise(F.lit(1.0))
        return F.when(k < 0, F.get(ys, F.lit(0))).when(k >= F.size(xs) - 1, F.get(ys, F.size(ys) - 1)).otherwise(inside)

    return let(F.size(F.filter(xs, lambda v: v <= x)) - 1, of)


def kept_distinct(name: str, key: str) -> Column:
    """A pseudo-random order key that is the same in any engine: md5 of key and name."""
    return F.md5(F.concat_ws(":", F.col(name).cast("string"), F.lit(key)))
