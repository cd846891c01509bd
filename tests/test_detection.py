"""Backgrounds, segments and widths against plain versions and known truths."""

import numpy as np
import pytest

from skyframe.operators import detect, widths


def star(shape, y, x, flux, s):
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    return flux * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * s * s))


def frame(spark, arrays):
    rows = [(i, *(a.shape if a is not None else (4, 4)), None if a is None else a.ravel().tolist()) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "idx int, h int, w int, pixels array<double>")


def flood(mask):
    """Labels by flood fill, in the order of first pixels."""
    out, n = np.zeros(mask.shape, int), 0
    for at in np.argwhere(mask):
        if out[tuple(at)]:
            continue
        n += 1
        todo = [tuple(at)]
        while todo:
            y, x = todo.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                out[y, x] = n
                todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out


def test_labels_match_flood_fill():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.2, 0.45, 0.7, 1.0):
        for shape in ((1, 1), (1, 17), (13, 1), (20, 31)):
            mask = rng.random(shape) < share
            labels, size = detect.label_areas(mask)
            assert np.array_equal(labels, flood(mask)) and size.tolist()[1:] == np.bincount(labels.ravel(), minlength=2)[1 : len(size)].tolist()[: len(size) - 1]


def test_smoothing_matches_a_loop():
    a = np.random.default_rng(1).normal(size=(5, 6))
    want = np.array([[sum(detect.FILTER[i + 1, j + 1] * a[y + i, x + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= y + i < 5 and 0 <= x + j < 6) for x in range(6)] for y in range(5)])
    assert np.allclose(detect.smoothed(a), want)


def test_sloped_background_has_the_noise_of_a_flat_one(spark):
    rng = np.random.default_rng(2)
    noise = rng.normal(0, 2, (256, 200))
    y, x = np.mgrid[:256, :200]
    flat, slope = noise + 5, noise + 0.3 * y - 0.2 * x + 40
    stars = sum(star(noise.shape, rng.uniform(0, 256), rng.uniform(0, 200), 300, 2) for _ in range(12))
    bad = slope.copy()
    bad[3, 4] = np.nan
    got = detect.background_mesh(frame(spark, [flat, slope, slope + stars, bad, np.full((70, 70), 3.0), None, np.full((4, 4), np.nan)])).orderBy("idx").collect()
    assert all(abs(r.rms - 2) < 0.06 for r in got[:4]) and abs(got[0].rms - got[1].rms) < 0.03
    assert slope.std() > 10  # what one deviation for the whole tile would give
    for r, truth in ((got[0], 0 * y + 5), (got[1], 0.3 * y - 0.2 * x + 40), (got[2], 0.3 * y - 0.2 * x + 40)):
        assert np.abs(np.reshape(r.background, noise.shape) - truth).max() < 1.5
    assert got[4].rms == 0 and set(got[4].background) == {3.0} and got[5].rms is None and np.isnan(got[6].rms)


def test_box_levels_match_a_loop(spark):
    a = np.random.default_rng(3).normal(size=(10, 7)) ** 3
    level, noise = detect.box_levels(a, 4, 2)
    assert level.shape == noise.shape == (2, 2)
    for i, rows in enumerate((slice(0, 5), slice(5, 10))):
        for j, columns in enumerate((slice(0, 4), slice(4, 7))):
            v = a[rows, columns].ravel()
            s0 = np.std(v)
            for _ in range(2):
                v = [t for t in v if abs(t - np.median(v)) <= 3 * np.std(v)]
            want = np.mean(v) if s0 - np.std(v) < 0.2 * s0 else 2.5 * np.median(v) - 1.5 * np.mean(v)
            assert np.isclose(level[i, j], want) and np.isclose(noise[i, j], np.std(v))


def test_overlapping_sources_are_split(spark):
    rng = np.random.default_rng(4)
    shape = (128, 128)
    noise = rng.normal(0, 1, shape)
    truth = [(30, 30, 200, 2.5), (30, 39, 120, 2.5), (80, 60, 90, 2), (87, 60, 150, 2), (82, 68, 100, 2), (100, 110, 60, 3)]
    tile = noise + sum(star(shape, *t) for t in truth)
    lone = noise + star(shape, 60, 60, 300, 3)
    got = detect.segment_sources(frame(spark, [tile, lone, noise, None])).orderBy("idx").collect()
    seg = np.reshape(got[0].segments, shape)
    assert got[0].n_sources == 6 and {seg[y, x] for y, x, *_ in truth} == set(range(1, 7))
    assert got[1].n_sources == 1 and got[2].n_sources == 0 and not any(got[2].segments) and got[3].segments is None
    # the binary mask is that of the areas before splitting, and segments are connected
    rms = detect.mesh_background(tile)[1]
    lit = detect.keep_areas(detect.smoothed(tile) > 3 * rms, 5)
    assert np.array_equal(seg > 0, lit == 1)
    assert all(detect.label_areas(seg == i)[1].tolist()[1:] == [(seg == i).sum()] for i in range(1, 7))
    assert detect.label_areas(lit)[0].max() < 6  # so some were split
    assert abs((seg == seg[30, 30]).sum() - (seg == seg[30, 39]).sum()) < 60


def test_contrast_decides(spark):
    shape = (64, 64)
    pair = star(shape, 30, 25, 1000, 3) + star(shape, 30, 38, 30, 2) + np.random.default_rng(5).normal(0, 0.5, shape)
    n = lambda c: detect.segment_sources(frame(spark, [pair]), contrast=c).first().n_sources
    assert n(0.0005) == 2 and n(0.2) == 1


@pytest.mark.parametrize("s", [(1.2, 1.2, 0.0), (3.0, 3.0, 0.0), (4.0, 2.0, 0.6), (6.5, 2.5, -1.2)])
def test_known_widths_within_one_percent(spark, s):
    major, minor, angle = s
    rng = np.random.default_rng(6)
    arrays = []
    for _ in range(5):
        yy, xx = np.mgrid[:61, :55].astype(float)
        dy, dx = yy - rng.uniform(27, 33), xx - rng.uniform(24, 30)
        u, v = dx * np.cos(angle) + dy * np.sin(angle), -dx * np.sin(angle) + dy * np.cos(angle)
        arrays.append(500 * np.exp(-(u**2 / major**2 + v**2 / minor**2) / 2) + 7 + rng.normal(0, 1, yy.shape))
    for r in widths.source_widths(frame(spark, arrays)).collect():
        assert abs(r.fwhm / (widths.FWHM * np.sqrt(major * minor)) - 1) < 0.01
        assert abs(r.fwhm_major / (widths.FWHM * major) - 1) < 0.015 and abs(r.fwhm_minor / (widths.FWHM * minor) - 1) < 0.015
        assert abs(r.background - 7) < 0.5


def test_widths_that_cannot_be(spark):
    nan = star((9, 9), 4, 4, 1, 1)
    nan[0, 0] = np.nan
    got = widths.source_widths(frame(spark, [np.zeros((9, 9)), nan, None, np.ones((1, 1))])).collect()
    assert [r.fwhm for r in got] == [None] * 4
