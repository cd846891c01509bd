"""Goldens by hand, round trips and edges of the column functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import arrays, scale, stats
from skyframe.functions.wcs import header, pix_to_sky, sky_to_pix
from skyframe.operators import gates
from skyframe.plans import preprocess


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_ds9_scale_goldens_and_inverse(spark):
    assert value(spark, scale.ds9_scale(0.0, offset=1.0)) == -1
    assert abs(value(spark, scale.ds9_scale(1.0, offset=1.0))) < 1e-12
    assert abs(value(spark, scale.ds9_scale(0.5)) - math.log10(501) / math.log10(1001)) < 1e-12
    assert value(spark, scale.ds9_scale(-1.0)) is None
    for x in (0.0, 0.3, 7.0):
        assert abs(value(spark, scale.ds9_unscale(scale.ds9_scale(x, offset=1.0), offset=1.0)) - x) < 1e-9


def test_min_max_inverse_and_zero_range(spark):
    assert abs(value(spark, scale.min_max_inverse(scale.min_max(0.4, -1.0, 2.0), -1.0, 2.0)) - 0.4) < 1e-12
    assert value(spark, scale.min_max(0.4, 1.0, 1.0)) is None
    assert value(spark, scale.clamp(5.0, 3.0, 1.0)) == 1


def test_scales_divide_as_documented(spark):
    assert value(spark, scale.scale(4.0, 2.0, "div")) == 0.5
    assert value(spark, scale.scale(4.0, 2.0, "prod")) == 8
    assert value(spark, scale.scale(0.0, 2.0, "div")) is None
    with pytest.raises(ValueError):
        scale.scale(1.0, 1.0, "sum")
    with pytest.raises(ValueError):
        scale.display_norm(1.0, 0.0, 1.0, "cube")


@pytest.mark.parametrize("total,kept", [(0.0, False), (-1.0, False), (math.exp(2), False), (math.exp(2) + 1e-6, True), (math.exp(7), False), (math.exp(7) - 1e-3, True), (math.nan, False), (math.inf, False)])
def test_log_sum_limits_are_strict(spark, total, kept):
    assert value(spark, gates.log_sum_passes(F.lit(total))) is kept


def tile(spark, a):
    a = np.asarray(a, float)
    return spark.createDataFrame([(0, *a.shape, a.ravel().tolist())], "idx long, h int, w int, pixels array<double>")


def array(df, column, *shape):
    return np.array(df.select(column.alias("v")).first().v, float).reshape(shape)


def test_geometry_matches_numpy(spark):
    a = np.random.default_rng(0).normal(size=(6, 4))
    t = tile(spark, a)
    assert (array(t, arrays.vflip("pixels", 6, 4), 6, 4) == a[::-1]).all()
    assert (array(t, arrays.hflip("pixels", 6, 4), 6, 4) == a[:, ::-1]).all()
    assert (array(t, arrays.center_crop("pixels", 6, 4, 3, 2), 3, 2) == a[2:5, 1:3]).all()
    assert (array(t, arrays.reflect_pad("pixels", 6, 4, 3), 12, 10) == np.pad(a, 3, "reflect")).all()
    assert array(t, arrays.center_crop("pixels", 6, 4, 8, 4), 8, 4)[1:7].tolist() == a.tolist()
    assert (array(t, arrays.decimate("pixels", 6, 4, 3), 2, 2) == a[::3, ::3]).all()
    up = arrays.resize_nearest("pixels", 6, 4, 12, 8)
    assert (array(t, up, 12, 8) == a.repeat(2, 0).repeat(2, 1)).all()
    assert (array(t, arrays.decimate(up, 12, 8, 2), 6, 4) == a).all()
    assert t.select(arrays.reflect_pad("pixels", 6, 4, 4).alias("v")).first().v is None


def test_flip_and_crop_of_pad_are_identities(spark):
    a = np.arange(25.0).reshape(5, 5)
    t = tile(spark, a)
    assert (array(t, arrays.vflip(arrays.vflip("pixels", 5, 5), 5, 5), 5, 5) == a).all()
    assert (array(t, arrays.center_crop(arrays.reflect_pad("pixels", 5, 5, 2), 9, 9, 5, 5), 5, 5) == a).all()


def test_blur_keeps_a_constant_and_the_sum(spark):
    assert np.allclose(array(tile(spark, np.full((7, 7), 3.0)), arrays.gaussian_blur("pixels", 7, 7, 1.0), 7, 7), 3)
    a = np.random.default_rng(1).random((7, 7))
    assert abs(array(tile(spark, a), arrays.gaussian_blur("pixels", 7, 7, 1.0), 7, 7).sum() - a.sum()) < 1e-9


def test_statistics_of_edges(spark):
    empty = spark.createDataFrame([([],)], "pixels array<double>")
    assert empty.select(stats.mean("pixels"), stats.median("pixels"), stats.spread("pixels")).first() == (None, None, None)
    t = tile(spark, [[1.0, 2.0], [3.0, 10.0]])
    assert t.select(stats.median("pixels").alias("v")).first().v == 2.5
    assert abs(t.select(stats.percentile("pixels", 0.99999).alias("v")).first().v - np.percentile([1, 2, 3, 10], 99.999)) < 1e-12
    bad = spark.createDataFrame([([1.0, None],), ([1.0, math.nan],), ([-math.inf],), ([1.0],)], "pixels array<double>")
    assert [r.v for r in bad.select(stats.any_bad("pixels").alias("v")).collect()] == [True, True, True, False]


def test_wcs_round_trip_and_tangent_point(spark):
    w = header(crpix1=10, crpix2=20, crval1=150.1, crval2=2.2, cd11=-1e-4, cd12=2e-6, cd21=1e-6, cd22=1e-4)
    ra, dec = pix_to_sky(F.lit(10.0), F.lit(20.0), w)
    assert value(spark, ra) == pytest.approx(150.1) and value(spark, dec) == pytest.approx(2.2)
    ra, dec = pix_to_sky(F.lit(123.4), F.lit(-56.7), w)
    x, y = sky_to_pix(ra, dec, w)
    assert value(spark, x) == pytest.approx(123.4) and value(spark, y) == pytest.approx(-56.7)


def test_unknown_scaling(spark):
    with pytest.raises(ValueError):
        preprocess.scale_tiles(tile(spark, [[1.0]]), "cube")


def test_constant_tile_has_no_median_scale(spark):
    t = preprocess.scale_tiles(tile(spark, np.ones((2, 2))), "median_scale")
    assert t.first().scaled == [None] * 4
