"""Source masks: clipped background noise, a threshold, and connected areas."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound
from ..functions.stats import median, spread
from .tiles import with_tile_columns


def background_rms(pixels: Column | str, passes: int = 3, sigmas: float = 3.0) -> Column:
    """Noise after a fixed number of clips around the median, as a Column: tiles aren't shuffled.

    Each pass keeps |v - median| <= sigmas * deviation; the deviation (population) of what is left is returned.
    """

    def clip(a: Column) -> Column:
        limits = F.struct(median(a).alias("m"), spread(a).alias("s"))
        return bound(limits, lambda t: F.filter(a, lambda v: F.abs(v - t["m"]) <= t["s"] * sigmas))

    def passed(a: Column, left: int) -> Column:
        return spread(a) if not left else bound(clip(a), lambda b: passed(b, left - 1))

    return bound(pixels, lambda a: passed(a, passes))


def threshold_mask(pixels: Column | str, rms: Column, k: float = 3.0) -> Column:
    """1 where a pixel exceeds k times the noise; the background level isn't subtracted."""
    return bound(rms, lambda s: F.transform(pixels, lambda v: (v > s * k).cast("tinyint")))


def binarised(labels: Column | str) -> Column:
    return F.transform(labels, lambda v: (v > 0).cast("tinyint"))


def label_areas(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the 8-connected areas of lit pixels, from 1 in the order of their first pixels (0 elsewhere), and the areas' sizes by label.

    Runs of lit pixels are linked with the runs of the next row that they touch, and merged to the smallest number by
    hooking and pointer jumping: a few passes over the runs, whatever the areas' extent.
    """
    h, w = mask.shape
    flat = np.zeros((h, w + 2), np.int8)
    flat[:, 1:-1] = mask > 0
    turns = np.diff(flat.ravel())
    first, end = np.flatnonzero(turns == 1) + 1, np.flatnonzero(turns == -1) + 1  # in rows of w + 2
    low, high = np.searchsorted(end, first + w + 2, "left"), np.searchsorted(first, end + w + 2, "right")
    many = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(first)), many)
    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + low[a]
    parent = np.arange(len(first))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]
    _, number = np.unique(parent, return_inverse=True)
    steps = np.zeros(h * (w + 2) + 1, np.int32)
    steps[first] = number + 1
    steps[end] = -(number + 1)
    size = np.bincount(number + 1, end - first, number.max(initial=-1) + 2).astype(np.int64)
    return np.cumsum(steps)[:-1].reshape(h, w + 2)[:, 1:-1].astype(np.int32), size


def keep_areas(mask: np.ndarray, least: int) -> np.ndarray:
    """0/1 mask without the 8-connected areas of fewer than `least` pixels."""
    labels, size = label_areas(mask)
    return ((size >= least) & (np.arange(len(size)) > 0)).astype(np.int8)[labels]


def clipped_rms(a: np.ndarray, passes: int = 3, sigmas: float = 3.0) -> float:
    """background_rms of one array; NaN if nothing is left, or if it holds a NaN."""
    v = a.ravel()
    for _ in range(passes):
        if not v.size:
            return float("nan")
        v = v[np.abs(v - np.median(v)) <= sigmas * v.std()]
    return float(v.std()) if v.size else float("nan")


def detect_sources(tiles: DataFrame, k: float = 3.0, min_area: int = 5, passes: int = 3, pixels: str = "pixels") -> DataFrame:
    """tiles with `mask` (array<tinyint>): pixels above k times the noise in 8-connected areas of min_area or more.

    Each tile is one row, so areas never cross rows; noise and areas are found in Arrow batches. A NULL tile, or
    one whose size isn't h * w, has a NULL mask; in one with a NaN nothing is found.
    """

    def mask(a: np.ndarray) -> tuple[np.ndarray]:
        lit = a > k * clipped_rms(a, passes)
        return (keep_areas(lit, min_area) if min_area > 1 else lit.astype(np.int8),)

    return with_tile_columns(tiles, mask, "mask array<tinyint>", pixels)


#: The usual 3 by 3 detection filter, over its sum.
FILTER = np.array([[1, 2, 1], [2, 4, 2], [1, 2, 1]]) / 16


def smoothed(a: np.ndarray, kernel: np.ndarray = FILTER) -> np.ndarray:
    """a filtered by a small kernel; nothing is outside."""
    ry, rx = (n // 2 for n in kernel.shape)
    wide = np.pad(a, ((ry, ry), (rx, rx)))
    return sum(k * wide[i : i + a.shape[0], j : j + a.shape[1]] for (i, j), k in np.ndenumerate(kernel))


def box_levels(a: np.ndarray, box: int, passes: int, sigmas: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """(level, deviation) of each box of a tile after a fixed number of clips around the median; boxes are even parts of the sides, as near to `box` as can be.

    The level is 2.5 medians less 1.5 means, or the mean where clipping changed the deviation by less than a fifth. Pixels that aren't finite
    don't count; NaN where none is left.
    """
    ys, xs = (np.linspace(0, n, max(1, round(n / box)) + 1).round().astype(int).tolist() for n in a.shape)
    level, spread_ = (np.full((len(ys) - 1, len(xs) - 1), np.nan) for _ in range(2))
    for i in range(len(ys) - 1):
        for j in range(len(xs) - 1):
            v = a[ys[i] : ys[i + 1], xs[j] : xs[j + 1]].ravel()
            v = v[np.isfinite(v)]
            if not v.size:
                continue
            before = v.std()
            for _ in range(passes):
                v = v[np.abs(v - np.median(v)) <= sigmas * v.std()]
            mean, after = v.mean(), v.std()
            level[i, j] = mean if before - after < 0.2 * before or not before else 2.5 * np.median(v) - 1.5 * mean
            spread_[i, j] = after
    return level, spread_


def _spread_out(mesh: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear values of a mesh of boxes at every pixel, carried on straight beyond the outer boxes' middles."""
    for axis in (0, 1):
        n = mesh.shape[axis]
        at = (np.arange(shape[axis]) + 0.5) * n / shape[axis] - 0.5
        k = np.clip(np.floor(at), 0, max(n - 2, 0)).astype(int)
        f = (at - k if n > 1 else np.zeros(len(at)))[(slice(None), None) if axis == 0 else (None, slice(None))]
        mesh = np.take(mesh, k, axis) * (1 - f) + np.take(mesh, np.minimum(k + 1, n - 1), axis) * f
    return mesh


def mesh_background(a: np.ndarray, box: int = 64, passes: int = 3, around: int = 3) -> tuple[np.ndarray, float]:
    """(background at every pixel, noise of the whole tile).

    Levels of clipped boxes, each the median of those around it, are interpolated between the boxes' middles; what is left is
    treated so once more, as a slope hides sources from clipping. The noise is the median of the boxes' deviations from that background, clipped
    again, so that a slope isn't noise.
    """
    back, r = np.zeros(a.shape), around // 2
    for _ in range(2):
        level, _ = box_levels(a - back, box, passes)
        if not np.isfinite(level).any():
            return np.full(a.shape, np.nan), float("nan")
        level[~np.isfinite(level)] = np.median(level[np.isfinite(level)])
        if min(level.shape) > around:  # a smaller mesh would lose its slope
            level = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(level, r, mode="reflect", reflect_type="odd"), (around, around)), axis=(2, 3))
        back = back + _spread_out(level, a.shape)
    _, noise = box_levels(a - back, box, passes)
    return back, float(np.median(noise[np.isfinite(noise)]))


def background_mesh(tiles: DataFrame, box: int = 64, passes: int = 3, around: int = 3, pixels: str = "pixels") -> DataFrame:
    """tiles with `background` (array<double>) and `rms`, from a mesh of clipped boxes; see mesh_background."""
    return with_tile_columns(tiles, lambda a: mesh_background(a, box, passes, around), "background array<double>, rms double", pixels)


def background_boxes(tiles: DataFrame, box: int = 64, passes: int = 3, pixels: str = "pixels") -> DataFrame:
    """tiles with `level` and `noise` (array<double>), those of each box of the mesh in row order."""
    return with_tile_columns(tiles, lambda a: box_levels(a, box, passes), "level array<double>, noise array<double>", pixels)


def deblended(a: np.ndarray, labels: np.ndarray, threshold: float, levels: int = 32, contrast: float = 0.005, least: int = 5) -> np.ndarray:
    """Labels with areas split into the sources that stand out in them, numbered from 1.

    Each area is cut at `levels` thresholds, even on a logarithmic scale from `threshold` to its peak: a tree of areas within areas.
    Where at least two branches have `least` pixels and more than `contrast` of the area's light above their own level, they are sources of
    their own. The other pixels go, from the brightest down, to the source that they touch first, that of the nearer brighter peak if they touch several.
    """
    out, next_ = np.zeros(labels.shape, np.int32), 1
    flat, number = labels.ravel(), labels.max(initial=0)
    order = np.argsort(flat, kind="stable")
    bounds = np.searchsorted(flat[order], np.arange(1, number + 2))
    for n in range(number):
        at = order[bounds[n] : bounds[n + 1]]
        y, x = np.unravel_index(at, labels.shape)
        y0, x0 = y.min(), x.min()
        part = np.zeros((y.max() - y0 + 1, x.max() - x0 + 1))
        part[y - y0, x - x0] = a[y, x]
        own = np.zeros(part.shape, bool)
        own[y - y0, x - x0] = True
        peak, light = part[own].max(), (part[own] - threshold).sum()
        seeds = []
        if peak > threshold > 0:
            cuts = threshold * (peak / threshold) ** (np.arange(1, levels) / levels)
            todo = [(own, 0)]
            while todo:
                inside, k = todo.pop()
                branches = []
                while k < len(cuts) and len(branches) < 2:
                    found, size = label_areas(inside & (part > cuts[k]))
                    branches = [found == i for i in range(1, len(size)) if size[i] >= least and (part[found == i] - cuts[k]).sum() > contrast * light]
                    k += 1
                if len(branches) > 1:
                    todo += [(b, k) for b in branches]
                else:
                    seeds.append(inside)
        if len(seeds) < 2:
            out[y, x] = next_
            next_ += 1
            continue
        seeds.sort(key=lambda s: int(np.flatnonzero(s)[0]))
        got = np.zeros((part.shape[0] + 2, part.shape[1] + 2), np.int32)
        tops = [(0, 0)]
        for i, s in enumerate(seeds, 1):
            got[1:-1, 1:-1][s] = i
            tops.append(np.unravel_index(np.where(s, part, -np.inf).argmax(), part.shape))
        rest = np.flatnonzero(own.ravel() & (got[1:-1, 1:-1].ravel() == 0))
        rest = rest[np.argsort(-part.ravel()[rest], kind="stable")].tolist()
        while rest:  # an area is connected, so every pass places some
            left = []
            for p in rest:
                i, j = divmod(p, part.shape[1])
                near = sorted(set(got[i : i + 3, j : j + 3].ravel().tolist()) - {0})
                if near:
                    got[i + 1, j + 1] = min(near, key=lambda s: (tops[s][0] - i) ** 2 + (tops[s][1] - j) ** 2)  # noqa: B023
                else:
                    left.append(p)
            rest = left
        out[y, x] = got[1:-1, 1:-1][y - y0, x - x0] + next_ - 1
        next_ += len(seeds)
    return out


def segment_sources(tiles: DataFrame, k: float = 3.0, min_area: int = 5, box: int = 64, levels: int = 32, contrast: float = 0.005, passes: int = 3, pixels: str = "pixels") -> DataFrame:
    """tiles with `segments` (array<int>, 0 or the number of a source), `n_sources`, and `rms`.

    The noise is that of the mesh background, whose level isn't subtracted; the tile is smoothed by a 3 by 3 filter, what exceeds k
    times the noise in 8-connected areas of min_area pixels or more is found, and areas with several sources are split (deblended). A NULL tile, or one whose
    size isn't h * w, has NULLs; pixels that aren't finite are taken as 0 and are in no source.
    """

    def segments(a: np.ndarray) -> tuple[np.ndarray, int, float]:
        _, rms = mesh_background(a, box, passes)
        fine = np.isfinite(a)
        flat = smoothed(np.where(fine, a, 0.0))
        limit = k * rms
        labels, size = label_areas((flat > limit) & fine)
        labels = np.where(size[labels] >= min_area, labels, 0)
        made = deblended(flat, label_areas(labels > 0)[0], limit, levels, contrast, min_area)
        return made, int(made.max(initial=0)), rms

    return with_tile_columns(tiles, segments, "segments array<int>, n_sources int, rms double", pixels)
