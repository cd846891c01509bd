"""Intensity scalings. Each takes a pixel value and gives a Column; `on_pixels` applies one to an array.

None raises under ANSI: a division by zero and a logarithm of a non-positive number give NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float

SIGMA = 3.0
CLIP_PERCENTILE = 0.99999


def _c(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def on_pixels(pixels: Column | str, f: Callable[[Column], Column]) -> Column:
    return F.transform(pixels, lambda v: f(v))


def sigmoid(x: Value) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def sigmoid_symmetric(x: Value) -> Column:
    """A sigmoid stretched to [-1, 1]."""
    return 2.0 * (sigmoid(x) - 0.5)


def scale(x: Value, s: Value, kind: str) -> Column:
    """prod: s * x. div: s / x, the scale over the value."""
    if kind == "prod":
        return _c(s) * _c(x)
    if kind == "div":
        return F.try_divide(_c(s), _c(x))
    raise ValueError(f"unknown kind of scale: {kind}")


def sigmoid_rms(x: Value, std: Value, as_documented: bool = False) -> Column:
    """Sigmoid of std / x; of x / std if as_documented."""
    return sigmoid(scale(std, x, "div") if as_documented else scale(x, std, "div"))


def log10_or_null(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def log_scale(x: Value, lowest: Value, eps: float = 1e-6) -> Column:
    """log10(x + |lowest| + eps); NULL where that isn't positive."""
    return log10_or_null(_c(x) + F.abs(_c(lowest)) + eps)


def standardised(x: Value, center: Value, spread: Value) -> Column:
    return F.try_divide(_c(x) - _c(center), _c(spread))


def clamp(x: Value, lo: Value, hi: Value) -> Column:
    """The lower bound first, then the upper: where lo > hi, it is hi."""
    return F.least(F.greatest(_c(x), _c(lo)), _c(hi))


def min_max(x: Value, lo: Value, hi: Value) -> Column:
    return F.try_divide(clamp(x, lo, hi) - _c(lo), _c(hi) - _c(lo))


def min_max_inverse(x: Value, lo: Value, hi: Value) -> Column:
    return _c(x) * (_c(hi) - _c(lo)) + _c(lo)


def ds9_scale(x: Value, a: float = 1000.0, offset: float = 0.0) -> Column:
    """log10(a x + 1) / log10(a + 1) - offset; NULL below -1 / a."""
    return log10_or_null(_c(x) * a + 1.0) / math.log10(a + 1) - offset


def ds9_unscale(x: Value, a: float = 1000.0, offset: float = 0.0) -> Column:
    return (F.pow(F.lit(a + 1.0), _c(x) + offset) - 1.0) / a


def unit_range(x: Value) -> Column:
    return (_c(x) + 1.0) / 2.0


#: Means and deviations of the three colour channels that image networks expect.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


def rgb_normalised(pixels: Column | str) -> Column:
    """Three channels of the same pixels, from [-1, 1] to [0, 1], then standardised by channel."""
    return F.array(*(_channel(pixels, m, s) for m, s in zip(CHANNEL_MEAN, CHANNEL_STD)))


def _channel(pixels: Column | str, mean: float, std: float) -> Column:
    return F.transform(pixels, lambda v: (unit_range(v) - mean) / std)


def display_norm(x: Value, lo: Value, hi: Value, stretch: str = "linear") -> Column:
    """A value between limits as 0..1 for display, stretched: linear, sqrt, log or asinh."""
    u = min_max(x, lo, hi)
    stretches = {
        "linear": lambda: u,
        "sqrt": lambda: F.sqrt(u),
        "log": lambda: F.ln(u * 1000.0 + 1.0) / math.log(1001.0),
        "asinh": lambda: F.asinh(u / 0.1) / math.asinh(10.0),
    }
    if stretch not in stretches:
        raise ValueError(f"unknown stretch: {stretch}")
    return stretches[stretch]()


def bce_with_logits(x: Value, target: float) -> Column:
    """Binary cross entropy of a logit in its stable form."""
    x = _c(x)
    return F.greatest(x, F.lit(0.0)) - x * target + F.ln(1.0 + F.exp(-F.abs(x)))
