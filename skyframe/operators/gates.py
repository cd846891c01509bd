"""Quality gates of tiles and pairs of tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import any_bad, pixel_sum


def log_sum_passes(total: Column, low: float = 2.0, high: float = 7.0) -> Column:
    """low < ln(total) < high, compared without a logarithm: sums that aren't positive, and NaN, fail."""
    return F.coalesce((total > math.exp(low)) & (total < math.exp(high)) & ~F.isnan(total), F.lit(False))


def filter_log_sum(tiles: DataFrame, pixels: str = "pixels", low: float = 2.0, high: float = 7.0) -> DataFrame:
    return tiles.filter(log_sum_passes(pixel_sum(pixels), low, high))


def accepted_pairs(low_tiles: DataFrame, high_tiles: DataFrame, name: str = "name", pixels: str = "pixels", low: float = 2.0, high: float = 7.0) -> DataFrame:
    """Names of the pairs whose high-resolution tile is within the log-sum limits; a tile without a partner is none."""
    return filter_log_sum(high_tiles, pixels, low, high).select(name).join(low_tiles.select(name), name, "left_semi").distinct()


def filter_finite(tiles: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with no NULL, NaN or infinite pixel in the named columns; others aren't examined."""
    for c in columns:
        tiles = tiles.filter(~any_bad(c))
    return tiles


def has_shape(pixels: str, h: int, w: int) -> Column:
    """Whether a tile has this shape on both axes, by its columns {pixels}_h and {pixels}_w, and as many pixels."""
    return F.coalesce((F.col(f"{pixels}_h") == h) & (F.col(f"{pixels}_w") == w) & (F.size(pixels) == h * w), F.lit(False))


def filter_shape(tiles: DataFrame, shapes: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows whose named columns have those (h, w); see has_shape."""
    for c, (h, w) in shapes.items():
        tiles = tiles.filter(has_shape(c, h, w))
    return tiles


def drop_corrupt(tiles: DataFrame, columns: list[str]) -> DataFrame:
    return tiles.dropna(how="any", subset=columns)


def quarantine(tiles: DataFrame, columns: list[str]) -> DataFrame:
    """What drop_corrupt drops."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return tiles.filter(missing)


def ratio_violations(pairs: DataFrame, ratio: int, hr: tuple[str, str], lr: tuple[str, str]) -> DataFrame:
    """Pairs whose high-resolution size isn't `ratio` times the low one on both axes; a NULL size isn't checked."""
    wrong = (F.col(hr[0]) != F.col(lr[0]) * ratio) | (F.col(hr[1]) != F.col(lr[1]) * ratio)
    return pairs.filter(F.coalesce(wrong, F.lit(False)))


def assert_ratio(pairs: DataFrame, ratio: int, hr: tuple[str, str], lr: tuple[str, str]) -> DataFrame:
    """pairs; a job that reads a violation fails."""
    right = (F.col(hr[0]) == F.col(lr[0]) * ratio) & (F.col(hr[1]) == F.col(lr[1]) * ratio)
    return pairs.filter(F.assert_true(F.coalesce(right, F.lit(True)), f"a high-resolution tile isn't {ratio} times the low one").isNull())


def reject_reason(hr: str, lr: str, others: list[str], shapes: dict[str, tuple[int, int]]) -> Column:
    """Why a row is dropped before batching, NULL for a good one. The checks are made in this order."""
    reason = F.when(F.greatest(*(F.col(c).isNull().cast("int") for c in (hr, lr, *others))) == 1, "corrupt")
    reason = reason.when(any_bad(hr) | any_bad(lr), "not finite")
    for c, (h, w) in shapes.items():
        reason = reason.when(~has_shape(c, h, w), "shape")
    return reason


def quality_report(tiles: DataFrame, reason: Column) -> DataFrame:
    return tiles.groupBy(F.coalesce(reason, F.lit("good")).alias("reason")).agg(F.count("*").alias("n"))
