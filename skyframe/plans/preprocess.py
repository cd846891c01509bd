"""Whole preparations: scaling of tiles, training samples, batches, and scoring with the user's model."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, scale, stats
from ..operators.batches import batched, flips, number_rows
from ..operators.detect import background_rms, clipped_rms, threshold_mask
from ..operators.gates import drop_corrupt, filter_finite, filter_shape

Step = Callable[[DataFrame], DataFrame]


def chained(tiles: DataFrame, *steps: Step) -> DataFrame:
    """The user's steps in order."""
    for step in steps:
        tiles = tiles.transform(step)
    return tiles


def clip_limits(pixels: Column | str, use_data: bool = False) -> tuple[Column, Column]:
    """(lo, hi): the high percentile, and 0 or the larger of the minimum and mean - 3 deviations."""
    hi = stats.percentile(pixels, scale.CLIP_PERCENTILE)
    if not use_data:
        return F.lit(0.0), hi
    return F.greatest(stats.mean(pixels) - stats.spread(pixels) * scale.SIGMA, F.array_min(pixels)), hi


def clipped(pixels: Column | str, use_data: bool = False, then: Callable[[Column], Column] = lambda v: v) -> Column:
    """Pixels between the clip limits, and a function of each."""

    def limited(p: Column) -> Column:
        lo, hi = clip_limits(p, use_data)
        return arrays.bound(F.struct(lo.alias("lo"), hi.alias("hi")), lambda t: F.transform(p, lambda v: then(scale.clamp(v, t["lo"], t["hi"]))))

    return arrays.bound(pixels, limited)


#: Column builders by name: (pixels, row statistics) -> scaled pixels. Statistics: lowest, highest, median, std of
#: the survey (dataset_stats) and hr_lowest of the high-resolution one.
SCALINGS: dict[str, Callable[[str], Column]] = {
    "sigmoid": lambda p: scale.on_pixels(p, scale.sigmoid_symmetric),
    "log_scale": lambda p: scale.on_pixels(p, lambda v: scale.log_scale(v, F.col("hr_lowest"))),
    "median_scale": lambda p: _median_scaled(p),
    "sigmoid_rms": lambda p: scale.on_pixels(p, lambda v: scale.sigmoid_rms(v, F.col("std"))),
    "global_median_scale": lambda p: scale.on_pixels(p, lambda v: scale.standardised(v, F.col("median"), F.col("std"))),
    "clip_min_max_norm": lambda p: scale.on_pixels(p, lambda v: scale.min_max(v, F.col("lowest"), F.col("highest"))),
    "hst_downscale": lambda p: F.col(p) if isinstance(p, str) else p,
    "paired_image_translation": lambda p: scale.on_pixels(p, lambda v: scale.min_max(v, F.col("lowest"), F.col("highest")) * 2.0 - 1.0),
    "ds9_scale": lambda p: scale.on_pixels(p, lambda v: scale.ds9_scale(v, offset=1.0)),
}


def _median_scaled(pixels: str) -> Column:
    """(x - median) over the deviation of what remains."""
    centred = arrays.bound(stats.median(pixels), lambda m: F.transform(pixels, lambda v: v - m))
    divided = lambda c: arrays.bound(stats.spread(c), lambda s: F.transform(c, lambda v: F.try_divide(v, s)))
    return arrays.bound(centred, divided)


def scale_tiles(tiles: DataFrame, kind: str, pixels: str = "pixels", out: str = "scaled") -> DataFrame:
    if kind not in SCALINGS:
        raise ValueError(f"unknown scaling: {kind}; known are {', '.join(SCALINGS)}")
    return tiles.withColumn(out, SCALINGS[kind](pixels))


def freq_split(pixels: Column | str, h: int, w: int, sigma: float = 5.0) -> Column:
    """Array of (low, high): the blurred tile rescaled to the tile's range, and the rest over its largest absolute value."""

    def split(p: Column) -> Column:
        def rescaled(b: Column) -> Column:
            range_ = F.struct(F.array_min(p).alias("lo"), F.array_max(p).alias("hi"), F.array_min(b).alias("bl"), F.array_max(b).alias("bh"))
            return arrays.bound(range_, lambda r: F.transform(b, lambda v: r["lo"] + F.try_divide(v - r["bl"], r["bh"] - r["bl"]) * (r["hi"] - r["lo"])))

        def rest(low: Column) -> Column:
            high = F.zip_with(p, low, lambda a, b: F.struct(b.alias("low"), (a - b).alias("high")))
            largest = lambda z: F.array_max(F.transform(z, lambda e: F.abs(e["high"])))
            return arrays.bound(high, lambda z: arrays.bound(largest(z), lambda m: F.transform(z, lambda e: F.struct(e["low"].alias("low"), F.try_divide(e["high"], m).alias("high")))))

        return arrays.bound(arrays.bound(arrays.gaussian_blur(p, h, w, sigma, "nearest"), rescaled), rest)

    return arrays.bound(pixels, split)


def flipped(pixels: str, h: int, w: int, vertical: Column, horizontal: Column) -> Column:
    rows = F.when(vertical, arrays.vflip(pixels, h, w)).otherwise(F.col(pixels))
    return arrays.bound(rows, lambda p: F.when(horizontal, arrays.hflip(p, h, w)).otherwise(p))


def preprocess_columns(pairs: DataFrame, hr: tuple[int, int, int], lr: tuple[int, int, int], k: float = 3.0, epoch: int | None = None, seed: int = 0, key: str = "idx") -> DataFrame:
    """preprocess() in built-in functions: interpreted for each pixel, and sorts every tile, so for small ones.

    hr and lr are (size, crop, pad). The order is fixed: flip (only with an epoch), crop, detect on the raw
    crop, clip and scale each survey, enlarge the scaled low-resolution tile, pad all four.
    """
    (hs, hc, hp), (ls, lc, lp) = hr, lr
    if epoch is not None:
        v, h = flips(key, epoch, seed)
        pairs = pairs.withColumn("hr", flipped("hr", hs, hs, v, h)).withColumn("lr", flipped("lr", ls, ls, v, h))
    out = pairs.withColumn("hr", arrays.center_crop("hr", hs, hs, hc, hc)).withColumn("lr", arrays.center_crop("lr", ls, ls, lc, lc))
    out = out.withColumn("mask", threshold_mask("hr", background_rms("hr"), k))
    for c in ("hr", "lr"):
        out = out.withColumn(c, clipped(c, then=lambda x: scale.ds9_scale(x, offset=1.0)))
    out = out.withColumn("lr_up", arrays.resize_nearest("lr", lc, lc, hc, hc))
    for c, n, p in (("hr", hc, hp), ("lr", lc, lp), ("lr_up", hc, hp), ("mask", hc, hp)):
        out = out.withColumn(c, arrays.reflect_pad(c, n, n, p)).withColumn(f"{c}_h", F.lit(n + 2 * p)).withColumn(f"{c}_w", F.lit(n + 2 * p))
    return out


def _crop(a: np.ndarray, size: int) -> np.ndarray:
    """The centred square; where it exceeds the tile, zeros."""
    out = np.zeros((size, size))
    (y, x), (h, w) = (int(np.rint((n - size) / 2)) if n >= size else -((size - n) // 2) for n in a.shape), a.shape
    out[max(-y, 0) : h - y, max(-x, 0) : w - x] = a[max(y, 0) : y + size, max(x, 0) : x + size]
    return out


def _percentile(a: np.ndarray, p: float) -> float:
    """By selection; NaNs are the largest values."""
    at = (a.size - 1) * p
    low = int(at)
    high = min(low + 1, a.size - 1)
    chosen = np.partition(a.ravel(), (low, high))
    return chosen[low] + (chosen[high] - chosen[low]) * (at - low)


def _scaled(a: np.ndarray) -> np.ndarray:
    """Clipped to 0 and the high percentile, then scale.ds9_scale; NaN in the place of NULL where that has none."""
    v = np.fmin(np.maximum(a, 0.0), _percentile(a, scale.CLIP_PERCENTILE)) * 1000.0 + 1.0
    return np.log10(v, out=np.full(v.shape, np.nan), where=(v > 0)) / math.log10(1001.0) - 1.0


def preprocess(pairs: DataFrame, hr: tuple[int, int, int], lr: tuple[int, int, int], k: float = 3.0, epoch: int | None = None, seed: int = 0, key: str = "idx") -> DataFrame:
    """Training samples of pairs (key, hr, lr arrays): hr, lr, lr_up and mask, padded, and their sizes as hr_h, hr_w and so on; one narrow pass in Arrow batches.

    hr and lr are (size, crop, pad). The order is fixed: flip (only with an epoch), crop, detect on the raw
    crop, clip and scale each survey, enlarge the scaled low-resolution tile, pad all four. Percentiles and medians are found by selection. A tile that is
    NULL or hasn't its size gives NULLs; a NULL pixel is taken as NaN, and a pixel without a logarithm is NULL.
    """
    (hs, hc, hp), (ls, lc, lp) = hr, lr
    if hp >= hc or lp >= lc:
        raise ValueError("a pad must be smaller than its crop")
    v, h = flips(key, epoch, seed) if epoch is not None else (F.lit(False), F.lit(False))
    made = ("hr", "lr", "lr_up", "mask")
    kept = [c for c in pairs.columns if c not in ("hr", "lr")]
    held = pairs.select(*(F.col(f"`{c}`") for c in kept), *(F.col(c).cast("array<double>").alias(c) for c in ("hr", "lr")), F.coalesce(v, F.lit(False)).alias("__v"), F.coalesce(h, F.lit(False)).alias("__h"))
    rows, columns = np.arange(hc) * lc // hc, np.arange(hc) * lc // hc

    def sample(a: np.ndarray, b: np.ndarray, vertical: bool, horizontal: bool) -> tuple[np.ndarray, ...]:
        turn = (slice(None, None, -1 if vertical else 1), slice(None, None, -1 if horizontal else 1))
        a, b = _crop(a.reshape(hs, hs)[turn], hc), _crop(b.reshape(ls, ls)[turn], lc)
        with np.errstate(invalid="ignore"):
            mask = (a > clipped_rms(a) * k).astype(np.int8)
            a, b = _scaled(a), _scaled(b)
        pads = ((a, hp), (b, lp), (b[rows][:, columns], hp), (mask, hp))
        return tuple(np.pad(x, p, "reflect") for x, p in pads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = []
            for c, n in (("hr", hs * hs), ("lr", ls * ls)):
                lists = batch.column(c)
                flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                views.append([flat[at[i] : at[i + 1]] if there and at[i + 1] - at[i] == n else None for i, there in enumerate(lists.is_valid().to_pylist())])
            found = [None if a is None or b is None else sample(a, b, v, h) for a, b, v, h in zip(*views, batch.column("__v").to_pylist(), batch.column("__h").to_pylist())]
            whole = np.array([x is not None for x in found], bool)
            arrays = []
            for i, size in enumerate((hc + 2 * hp, lc + 2 * lp, hc + 2 * hp, hc + 2 * hp)):
                kind = np.int8 if i == 3 else np.float64
                flat = np.concatenate([np.zeros(0, kind), *(x[i].ravel() for x in found if x is not None)])
                values = pa.array(flat) if i == 3 else pa.array(flat, mask=np.isnan(flat))
                arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(whole * size * size)], dtype=np.int32)), values, mask=pa.array(~whole)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], names=[*kept, *made])

    schema = T.StructType([*(pairs.schema[c] for c in kept), *T.StructType.fromDDL("hr array<double>, lr array<double>, lr_up array<double>, mask array<tinyint>")])
    out = held.mapInArrow(run, schema)
    for c, n in (("hr", hc + 2 * hp), ("lr", lc + 2 * lp), ("lr_up", hc + 2 * hp), ("mask", hc + 2 * hp)):
        out = out.withColumn(f"{c}_h", F.lit(n)).withColumn(f"{c}_w", F.lit(n))
    return out


def collate(samples: DataFrame, size: int, shapes: dict[str, tuple[int, int]], key: str = "idx", finite: tuple[str, str] = ("hr", "lr"), whole: tuple[str, ...] = ("hr", "lr", "lr_up", "mask"), refill: bool = False, hook: Step | None = None) -> DataFrame:
    """Good samples with batch_id. Without refill, batches are cut before bad rows are dropped.

    A hook takes the place of the checks: any function of the numbered samples that returns a DataFrame with batch_id.
    """
    keep: Step = hook or (lambda df: filter_shape(filter_finite(drop_corrupt(df, list(whole)), list(finite)), shapes))
    number: Step = lambda df: batched(number_rows(df, [key]), size)
    return chained(samples, *((keep, number) if refill else (number, keep)))


def score_tiles(tiles: DataFrame, make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]], h: int, w: int, pixels: str = "pixels", out: str = "predicted", batch_size: int = 64) -> DataFrame:
    """Adds what the user's model predicts from (n, h, w) batches, as flat arrays; NULL for a NULL tile.

    The model is made once a task. The result is a plain column, which array functions can take.
    A tile whose size isn't h * w gets NULL too.
    """
    names, size = tiles.columns, h * w
    place = names.index(pixels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = make_predict()
        for batch in batches:
            lists = batch.column(place)
            starts = lists.offsets.to_numpy()
            whole = lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(starts) == size)
            flat = lists.values.to_numpy(zero_copy_only=False)[np.repeat(whole, np.diff(starts))] if starts[0] == 0 and len(lists.values) == starts[-1] else np.concatenate([np.zeros(0), *(lists.values.to_numpy(zero_copy_only=False)[a:b] for a, b, k in zip(starts, starts[1:], whole) if k)])
            x = flat.astype(np.float32).reshape(-1, h, w)
            made = [predict(x[i : i + batch_size]).astype(np.float32).ravel() for i in range(0, len(x), batch_size)]
            values = np.concatenate([np.zeros(0, np.float32), *made])
            each = len(values) // max(len(x), 1)
            offsets = pa.array(np.cumsum([0, *np.where(whole, each, 0)], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(values), mask=pa.array(~whole))], names=[*names, out])

    return tiles.mapInArrow(run, T.StructType([*tiles.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def nearest_baseline(factor: int) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A model that repeats pixels: what a learned one must beat."""
    return lambda: lambda x: np.repeat(np.repeat(x, factor, axis=1), factor, axis=2)
