"""Geometry of row-major pixel arrays: pixel (y, x) of an h by w tile is element y * w + x (from 0).

h and w are Columns or numbers, so tiles of different sizes can share a table. No function explodes
a tile: each is one pass of `transform` over the target pixels.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | int


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _div(a: Column, b: Number) -> Column:
    return F.floor(a / _c(b)).cast("int")


def bound(value: Column | str, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once a row. Put straight into a lambda, the optimizer may compute it for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def pixel(pixels: Column | str, y: Column, x: Column, w: Number) -> Column:
    """Pixel (y, x), NULL outside the array."""
    pixels = F.col(pixels) if isinstance(pixels, str) else pixels
    return F.get(pixels, (y * _c(w) + x).cast("int"))


def remap(h: Number, w: Number, f: Callable[[Column, Column], Column]) -> Column:
    """A new h by w array of f(y, x)."""
    size = _c(h) * _c(w)
    places = F.when(size > 0, F.sequence(F.lit(0), (size - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: f(_div(i, w), i % _c(w)))


def vflip(pixels: Column | str, h: Number, w: Number) -> Column:
    return bound(pixels, lambda p: remap(h, w, lambda y, x: pixel(p, _c(h) - 1 - y, x, w)))


def hflip(pixels: Column | str, h: Number, w: Number) -> Column:
    return bound(pixels, lambda p: remap(h, w, lambda y, x: pixel(p, y, _c(w) - 1 - x, w)))


def crop_start(have: Number, want: Number) -> Column:
    """Start of a centred window: half the difference, rounded half to even; where the window is larger, the smaller half of it is before the tile."""
    half = (_c(have) - _c(want)) / 2.0
    return F.when(half < 0, F.ceil(half)).otherwise(F.rint(half)).cast("int")


def center_crop(pixels: Column | str, h: Number, w: Number, to_h: Number, to_w: Number) -> Column:
    """The centred to_h by to_w window; where it exceeds the tile, zeros."""
    y0, x0 = crop_start(h, to_h), crop_start(w, to_w)

    def value(p: Column, y: Column, x: Column) -> Column:
        sy, sx = y + y0, x + x0
        inside = sy.between(0, _c(h) - 1) & sx.between(0, _c(w) - 1)
        return F.when(inside, pixel(p, sy, sx, w)).otherwise(0.0)

    return bound(pixels, lambda p: remap(to_h, to_w, lambda y, x: value(p, y, x)))


def reflected(i: Column, n: Number) -> Column:
    """Index i reflected into 0..n-1 without repeating the edge; needs -n < i < 2 n - 1."""
    return F.when(i < 0, -i).when(i >= _c(n), (_c(n) - 1) * 2 - i).otherwise(i)


def reflect_pad(pixels: Column | str, h: Number, w: Number, p: int) -> Column:
    """p more pixels on each side by reflection; p must be below h and w, else the array is NULL."""
    padded = bound(pixels, lambda a: remap(_c(h) + 2 * p, _c(w) + 2 * p, lambda y, x: pixel(a, reflected(y - p, h), reflected(x - p, w), w)))
    return F.when((_c(h) > p) & (_c(w) > p), padded)


def decimate(pixels: Column | str, h: Number, w: Number, factor: int) -> Column:
    """Every factor-th row and column, from the first."""
    rows, columns = (F.ceil(_c(n) / factor).cast("int") for n in (h, w))
    return bound(pixels, lambda p: remap(rows, columns, lambda y, x: pixel(p, y * factor, x * factor, w)))


def resize_nearest(pixels: Column | str, h: Number, w: Number, to_h: int, to_w: int) -> Column:
    return bound(pixels, lambda p: remap(to_h, to_w, lambda y, x: pixel(p, _div(y * _c(h), to_h), _div(x * _c(w), to_w), w)))


def resize_bilinear(pixels: Column | str, h: Number, w: Number, to_h: int, to_w: int) -> Column:
    """Four-tap interpolation with half-pixel centres; the edge is repeated."""

    def value(p: Column, y: Column, x: Column) -> Column:
        def taps(i: Column, have: Number, want: int) -> tuple[Column, Column, Column]:
            s = F.greatest((i + 0.5) * _c(have) / float(want) - 0.5, F.lit(0.0))
            low = F.least(F.floor(s).cast("int"), _c(have) - 1)
            return low, F.least(low + 1, _c(have) - 1), s - low

        y0, y1, fy = taps(y, h, to_h)
        x0, x1, fx = taps(x, w, to_w)
        top = pixel(p, y0, x0, w) * (1 - fx) + pixel(p, y0, x1, w) * fx
        low = pixel(p, y1, x0, w) * (1 - fx) + pixel(p, y1, x1, w) * fx
        return top * (1 - fy) + low * fy

    return bound(pixels, lambda p: remap(to_h, to_w, lambda y, x: value(p, y, x)))


def resize_area(pixels: Column | str, h: Number, w: Number, factor: int) -> Column:
    """Means of factor by factor blocks; rest rows and columns that don't fill a block are left out."""

    def value(p: Column, y: Column, x: Column) -> Column:
        parts = [pixel(p, y * factor + dy, x * factor + dx, w) for dy in range(factor) for dx in range(factor)]
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return total / float(factor * factor)

    return bound(pixels, lambda p: remap(_div(_c(h), factor), _div(_c(w), factor), lambda y, x: value(p, y, x)))


def resize(pixels: Column | str, h: int, w: int, dim: int, method: str = "nearest") -> Column:
    """To a dim by dim square: nearest, linear, or area (for whole factors)."""
    if method == "nearest":
        return resize_nearest(pixels, h, w, dim, dim)
    if method == "linear":
        return resize_bilinear(pixels, h, w, dim, dim)
    if method == "area":
        if h % dim or w % dim or h // dim != w // dim:
            raise ValueError("area needs a whole factor")
        return resize_area(pixels, h, w, h // dim)
    raise ValueError(f"unknown method: {method}")


def gaussian_taps(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def _boundary(i: Column, n: Number, mode: str) -> Column:
    if mode == "nearest":
        return F.least(F.greatest(i, F.lit(0)), _c(n) - 1)
    if mode == "symmetric":  # d c b a | a b c d | d c b a, as often as needed
        k = F.pmod(i, _c(n) * 2)
        return F.least(k, _c(n) * 2 - 1 - k)
    raise ValueError(f"unknown boundary: {mode}")


def gaussian_blur(pixels: Column | str, h: Number, w: Number, sigma: float, mode: str = "symmetric") -> Column:
    """Separable Gaussian: a pass along rows, then one along columns."""
    taps = gaussian_taps(sigma)
    radius = len(taps) // 2
    weights = F.array(*(F.struct(F.lit(i - radius).alias("d"), F.lit(t).alias("t")) for i, t in enumerate(taps)))

    def along(source: Column, vertical: bool) -> Column:
        def value(y: Column, x: Column) -> Column:
            def add(acc: Column, tap: Column) -> Column:
                at = pixel(source, _boundary(y + tap["d"], h, mode), x, w) if vertical else pixel(source, y, _boundary(x + tap["d"], w, mode), w)
                return acc + at * tap["t"]

            return F.aggregate(weights, F.lit(0.0), add)

        return remap(h, w, value)

    return bound(pixels, lambda p: bound(along(p, False), lambda rows: along(rows, True)))
