"""Widths of sources: a two-dimensional Gaussian on a constant background, fitted to each tile in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import with_tile_columns

FWHM = 2 * np.sqrt(2 * np.log(2))  # of a Gaussian of deviation 1
STEPS = 60
STACK = 1 << 15  # pixels that are fitted at once


def _starts(a: np.ndarray) -> np.ndarray:
    """Amplitude, centre, inverse covariance and background of each tile from its peak and the area above half of it."""
    n, h, w = a.shape
    base = np.median(np.concatenate([a[:, 0], a[:, -1], a[:, :, 0], a[:, :, -1]], 1), 1)
    at = a.reshape(n, -1).argmax(1)
    top = np.maximum(a.reshape(n, -1)[np.arange(n), at] - base, 1e-12)
    half = np.maximum((a - base[:, None, None] > top[:, None, None] / 2).sum((1, 2)), 1)
    s = np.maximum(np.sqrt(half / np.pi) * 2 / FWHM, 0.4)
    return np.stack([top, at % w, at // w, 1 / s**2, np.zeros(n), 1 / s**2, base], 1)


def _solved(normal: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of each system; NaN for singular ones."""
    try:
        return np.linalg.solve(normal, right[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        return np.full(right.shape, np.nan) if len(right) == 1 else np.concatenate([_solved(normal[k : k + 1], right[k : k + 1]) for k in range(len(right))])


def fit_gaussians(a: np.ndarray, steps: int = STEPS, tolerance: float = 1e-9) -> list[tuple[float, ...] | None]:
    """(fwhm, major, minor, amplitude, background) of the least-squares Gaussian of each tile of a stack (n, h, w), by damped Gauss-Newton steps; None where there is none.

    fwhm is the geometric mean of the full widths at half maximum along the long and the short axis. Tiles go on by themselves, and leave the
    stack when they are done: at a step that gains less than the tolerance, or when the error is that of rounding.
    """
    a = np.asarray(a, np.float64)
    out: list[tuple[float, ...] | None] = [None] * len(a)
    size = a[0].size if len(a) else 0
    sound = np.flatnonzero(np.isfinite(a).all((1, 2)) & (a.max((1, 2)) != a.min((1, 2)))) if size >= 7 else np.zeros(0, int)
    if not len(sound):
        return out
    yy, xx = (g.ravel().astype(np.float64) for g in np.mgrid[: a.shape[1], : a.shape[2]])
    v, p = a[sound].reshape(len(sound), -1), _starts(a[sound])
    damping, fitted = np.full(len(p), 1e-3), np.ones(len(p), bool)
    rounding = size * (4 * np.finfo(np.float64).eps * np.abs(v).max(1)) ** 2

    def model(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        top, x, y, xs, xy, ys, base = (c[:, None] for c in p.T)
        dx, dy = xx - x, yy - y
        e = np.exp(np.minimum(-(xs * dx * dx + 2 * xy * dx * dy + ys * dy * dy) / 2, 50))
        return top * e + base, e, dx, dy

    made, e, dx, dy = model(p)
    error = ((v - made) ** 2).sum(1)
    left = np.arange(len(p))  # the tiles that go on; made, e, dx and dy are theirs
    for _ in range(steps):
        pe = p[left, :1] * e
        xs, xy, ys = (p[left, k : k + 1] for k in (3, 4, 5))
        j = np.stack([e, pe * (xs * dx + xy * dy), pe * (xy * dx + ys * dy), -pe * dx * dx / 2, -pe * dx * dy, -pe * dy * dy / 2, np.ones_like(e)], 1)
        normal, right = j @ j.transpose(0, 2, 1), (j @ (v[left] - made)[:, :, None])[:, :, 0]
        diagonal = np.eye(7) * (np.diagonal(normal, axis1=1, axis2=2) + 1e-30)[:, :, None]
        open_, going = np.arange(len(left)), np.zeros(len(left), bool)
        for _ in range(12):
            of = left[open_]
            step = _solved(normal[open_] + damping[of, None, None] * diagonal[open_], right[open_])
            fitted[of[np.isnan(step).any(1)]] = False
            q = p[of] + step
            good = np.flatnonzero((q[:, 3] > 0) & (q[:, 5] > 0) & (q[:, 3] * q[:, 5] > q[:, 4] ** 2))
            new = model(q[good])
            found = ((v[of[good]] - new[0]) ** 2).sum(1)
            better = found <= error[of[good]]
            at, to = open_[good[better]], of[good[better]]
            for held, n in zip((made, e, dx, dy), new):
                held[at] = n[better]
            going[at] = (error[to] - found[better] > tolerance * error[to]) & (found[better] > rounding[to])
            p[to], error[to], damping[to] = q[good[better]], found[better], np.maximum(damping[to] / 6, 1e-12)
            open_ = open_[fitted[of] & ~np.isin(open_, at)]
            damping[left[open_]] *= 4
            if not len(open_):
                break
        if not going.any():
            break
        left, made, e, dx, dy = left[going], made[going], e[going], dx[going], dy[going]
    for k in np.flatnonzero(fitted):
        low, high = np.linalg.eigvalsh([[p[k, 3], p[k, 4]], [p[k, 4], p[k, 5]]])
        if low > 0 and p[k, 0] > 0:
            major, minor = FWHM / np.sqrt(low), FWHM / np.sqrt(high)
            out[sound[k]] = (float(np.sqrt(major * minor)), float(major), float(minor), float(p[k, 0]), float(p[k, 6]))
    return out


def _fit_all(tiles: list[np.ndarray]) -> list[tuple]:
    """Stacks of tiles of one shape, of about STACK pixels."""
    out: list[tuple] = [()] * len(tiles)
    for shape in {a.shape for a in tiles}:
        same = [k for k, a in enumerate(tiles) if a.shape == shape]
        many = max(1, STACK // math.prod(shape))
        for i in range(0, len(same), many):
            for k, made in zip(same[i : i + many], fit_gaussians(np.stack([tiles[k] for k in same[i : i + many]]))):
                out[k] = made or (None,) * 5
    return out


def source_widths(tiles: DataFrame, pixels: str = "pixels") -> DataFrame:
    """tiles with `fwhm`, `fwhm_major` and `fwhm_minor` in pixels, `amplitude` and `background` of their Gaussian.

    NULL where no Gaussian with a peak can be fitted: constant tiles, tiles with pixels that aren't finite, NULL tiles.
    """
    return with_tile_columns(tiles, _fit_all, "fwhm double, fwhm_major double, fwhm_minor double, amplitude double, background double", pixels, together=True)


def half_light_width(curves: DataFrame) -> DataFrame:
    """(idx, width): twice the radius that holds half of a tile's light, from profiles.growth_curve: a width without a fit, in built-in functions."""
    at = F.array_position(F.transform("frac", lambda v: v >= 0.5), True)
    return curves.select("idx", (F.get("r", (at - 1).cast("int")) * 2).alias("width"))
