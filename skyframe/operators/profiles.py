"""Light profiles and shapes of single tiles: numpy on the arrays of Arrow batches, no tile is shuffled."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import with_tile_columns


@lru_cache(64)
def _rings(h: int, w: int, cy: float, cx: float) -> tuple[np.ndarray, np.ndarray]:
    """The distinct radii of an h by w tile's pixels from the centre, and each pixel's number among them."""
    y, x = np.mgrid[:h, :w]
    r, ring = np.unique(np.sqrt((y - cy) ** 2 + (x - cx) ** 2), return_inverse=True)
    return r, ring.ravel()


def growth_curve(tiles: DataFrame, cy: float, cx: float, pixels: str = "pixels") -> DataFrame:
    """tiles with `r`, the distinct radii in order, and `frac`, the share of a tile's light within each; frac is NULL if there is no light."""

    def curve(a: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        r, ring = _rings(*a.shape, cy, cx)
        light = np.cumsum(np.bincount(ring, a.ravel(), len(r)))
        return r, light / light[-1] if light[-1] else None

    return with_tile_columns(tiles, curve, "r array<double>, frac array<double>", pixels)


def curve_points(curves: DataFrame) -> DataFrame:
    """(idx, r, frac): a row per radius, for display."""
    return curves.select("idx", F.explode(F.arrays_zip("r", F.coalesce("frac", F.array_repeat(F.lit(None).cast("double"), F.size("r"))).alias("frac"))).alias("p")).select("idx", "p.*")


def light_radii(curves: DataFrame) -> DataFrame:
    """(idx, r25, r50, r75, c7525): the smallest radii that hold such shares, and the concentration r75 / r25."""
    first = lambda q: F.get("r", (F.array_position(F.transform("frac", lambda v: v >= q), True) - 1).cast("int"))
    radii = curves.select("idx", first(0.25).alias("r25"), first(0.5).alias("r50"), first(0.75).alias("r75"))
    return radii.withColumn("c7525", F.try_divide(F.col("r75"), F.col("r25")))


def encircled_energy_diff(measured: DataFrame, truth: DataFrame, radius: float) -> DataFrame:
    """(idx, diff): the relative difference of two growth curves at a radius."""
    at = lambda curves, name: curves.select("idx", F.get("frac", F.size(F.filter("r", lambda v: v <= radius)) - 1).alias(name))
    return at(measured, "m").join(at(truth, "t"), "idx").select("idx", F.try_divide(F.col("m") - F.col("t"), F.col("t")).alias("diff"))


def tile_moments(tiles: DataFrame, pixels: str = "pixels") -> DataFrame:
    """(idx, q, ux, uy): axis ratio and unit vector of the long axis from flux-weighted second moments.

    The formula is this library's choice. Tiles without positive light, and negative pixels, are left out.
    """

    def moments(a: np.ndarray) -> tuple[float | None, ...]:
        lit = np.where(a > 0, a, 0)
        s = lit.sum()
        if not s:
            return None, None, None
        y, x = np.arange(a.shape[0]), np.arange(a.shape[1])
        by_y, by_x = lit.sum(1), lit.sum(0)
        my, mx = by_y @ y / s, by_x @ x / s
        d, aa, b = by_y @ (y - my) ** 2 / s, by_x @ (x - mx) ** 2 / s, (y - my) @ lit @ (x - mx) / s
        root, mid, angle = np.hypot((aa - d) / 2, b), (aa + d) / 2, np.arctan2(2 * b, aa - d) / 2
        q = float(np.sqrt(max(mid - root, 0.0) / (mid + root))) if mid + root else None
        return q, float(np.cos(angle)), float(np.sin(angle))

    return with_tile_columns(tiles, moments, "q double, ux double, uy double", pixels).filter("ux is not null").select("idx", "q", "ux", "uy")
