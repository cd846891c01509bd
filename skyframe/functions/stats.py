"""Per-tile statistics of pixel arrays, as Columns: no tile is exploded or shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound


def pixel_sum(pixels: Column | str) -> Column:
    return F.aggregate(pixels, F.lit(0.0), lambda acc, v: acc + v)


def mean(pixels: Column | str) -> Column:
    return F.try_divide(pixel_sum(pixels), F.size(pixels).cast("double"))


def spread(pixels: Column | str) -> Column:
    """Population standard deviation."""

    def around(p: Column) -> Column:
        squares = lambda m: F.aggregate(p, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m))
        return F.sqrt(F.try_divide(bound(mean(p), squares), F.size(p).cast("double")))

    return bound(pixels, around)


def percentile(pixels: Column | str, p: float) -> Column:
    """Linearly interpolated percentile; NULL of an empty array."""
    ordered = F.array_sort(pixels)

    def at(s: Column) -> Column:
        place = (F.size(s) - 1) * F.lit(p)
        low = F.floor(place).cast("int")
        first, second = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return first + (second - first) * (place - low)

    return bound(ordered, at)


def median(pixels: Column | str) -> Column:
    return percentile(pixels, 0.5)


def max_abs(pixels: Column | str) -> Column:
    return F.array_max(F.transform(pixels, F.abs))


def any_bad(pixels: Column | str) -> Column:
    """Whether a pixel is NULL, NaN or infinite."""
    return F.exists(pixels, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
