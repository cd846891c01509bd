"""Work on chunks against plain loops over the whole mosaic."""

import numpy as np
import pytest

from skyframe.functions.wcs import FIELDS
from skyframe.operators import chunks as C
from skyframe.operators import mosaic
from skyframe.plans import fixtures as X


def px_of(spark, a):
    return spark.createDataFrame([(y, x, float(v)) for (y, x), v in np.ndenumerate(a) if not np.isnan(v)], "y int, x int, v double")


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(11).normal(size=(37, 29)).round(6)


@pytest.mark.parametrize("size", [1, 5, 8, 19])
def test_cut_bordered_matches_slices(spark, image, size):
    """Windows within a chunk, over several, over more than two (19 on chunks of 8), at the edges, outside, and many in one place."""
    at = [(y, x) for y in range(-9, 47, 3) for x in range(-9, 40, 4)] + [(12, 12)] * 40
    centers = spark.createDataFrame([(i, y, x) for i, (y, x) in enumerate(at)], "idx int, y int, x int")
    bordered = C.with_border(C.chunks_of(px_of(spark, image), 8), 8, 0, size - 1)
    cut = C.cut_bordered(bordered, centers, size, 8, block_bytes=8 * size * size * 7)
    got = {r.idx: r for r in cut.collect()}
    assert cut.count() == len(got)
    for i, (cy, cx) in enumerate(at):
        y0, x0 = int(np.ceil(cy - size / 2)), int(np.ceil(cx - size / 2))
        want = image[max(y0, 0) : max(y0 + size, 0), max(x0, 0) : max(x0 + size, 0)]
        assert (i in got) == bool(want.size)
        if want.size:
            r = got[i]
            assert (r.y, r.x, r.h, r.w) == (max(y0, 0), max(x0, 0), *want.shape) and np.array_equal(np.reshape(r.pixels, want.shape), want)


def test_no_exchange_after_the_cut(spark, image):
    centers = spark.createDataFrame([(0, 3, 3)], "idx int, y int, x int")
    path = X.scratch(spark, "bordered")
    C.with_border(C.chunks_of(px_of(spark, image), 8), 8, 0, 4).write.parquet(path)
    plan = C.cut_bordered(spark.read.parquet(path), centers, 5, 8)._jdf.queryExecution().executedPlan().toString()
    top = plan.split("FlatMapCoGroups")[0]
    assert "FlatMapCoGroups" in plan and "Exchange" not in top


def test_gaps_and_missing_chunks(spark):
    a = np.arange(400.0).reshape(20, 20)
    a[3, 4] = np.nan
    a[8:16, 8:16] = np.nan  # a chunk that isn't there
    bordered = C.with_border(C.chunks_of(px_of(spark, a), 8), 8, 1, 3)
    rows = {(r.ty, r.tx): r for r in bordered.collect()}
    assert len(rows) == 8 and (1, 1) not in rows
    for (ty, tx), r in rows.items():
        whole = a[max(ty * 8 - 1, 0) : ty * 8 + 11, max(tx * 8 - 1, 0) : tx * 8 + 11]
        assert np.array_equal(np.reshape(r.pixels, (r.h, r.w)), whole[: r.h, : r.w], equal_nan=True)
    assert C.with_border(C.chunks_of(px_of(spark, a[:0]), 8), 8, 1, 3).count() == 0


def valid_places(mask, size):
    h = size // 2
    return [(y, x) for y in range(mask.shape[0]) for x in range(mask.shape[1]) if y >= h and x >= h and y + h <= mask.shape[0] and x + h <= mask.shape[1] and mask[y - h : y + h, x - h : x + h].all()]


@pytest.mark.parametrize("size", [1, 4, 6, 11])
def test_valid_bits_and_draws_match_loops(spark, size):
    mask = np.random.default_rng(5).random((37, 29)) > 0.03
    bits = C.valid_bits(C.with_border(C.chunks_of(px_of(spark, mask.astype(float)), 8), 8, size // 2, size // 2), 8, size).cache()
    want = valid_places(mask, size)
    assert {(r.y, r.x) for r in C.centers_of(bits, 8).collect()} == set(want)
    assert {r.ty * 1000 + r.tx: r.n for r in bits.collect()} == {ty * 1000 + tx: sum(y // 8 == ty and x // 8 == tx for y, x in want) for ty in range(5) for tx in range(4)}
    points = spark.createDataFrame([(y, x, y * 100 + x, "a") for y in range(-2, 40) for x in range(-2, 32)], "y int, x int, n int, row string")
    got = C.validate_points(points, bits, 8, many=50).collect()
    assert {(r.y, r.x) for r in got} == set(want) and len(got) == len(want) and all(r.n == r.y * 100 + r.x and r.row == "a" for r in got)
    order = sorted(want, key=lambda p: (p[0] // 8, p[1] // 8, *p))
    drawn = C.draw_locations(bits, 8, 4000, seed=2).collect()
    assert sorted(r.idx for r in drawn) == (list(range(4000)) if want else [])
    if want:
        share = np.bincount([order.index((r.y, r.x)) for r in drawn], minlength=len(order)) / 4000 * len(order)
        assert {(r.y, r.x) for r in drawn} <= set(want) and share.max() < 4
    once = [(r.y, r.x) for r in C.draw_locations(bits, 8, len(want) // 2, seed=2, replace=False).collect()]
    assert len(once) == len(set(once)) == len(want) // 2 and set(once) <= set(want)
    all_ = [(r.y, r.x) for r in C.draw_locations(bits, 8, len(want) + 5, seed=3, replace=False).collect()]
    assert sorted(all_) == sorted(want)
    bits.unpersist()


def test_permutation_is_one():
    for total in (1, 2, 3, 17, 1000, 4097):
        for seed in (0, 5):
            assert sorted(C._permuted(np.arange(total), total, seed)) == list(range(total))


def test_reprojection_matches_the_rows_form(spark):
    """A rotated, shifted grid of another scale, sources with gaps, targets beyond the source; chunks of other sizes on both sides."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(40, 33))
    a[rng.random(a.shape) < 0.02] = np.nan
    angle, step = 0.3, 0.1 / 3600
    ws = dict(zip(FIELDS, (17.0, 20.0, 150.1, 2.2, -step, 0.0, 0.0, step)))
    wt = dict(zip(FIELDS, (9.5, 11.0, 150.1, 2.2, -1.7 * step * np.cos(angle), 1.7 * step * np.sin(angle), 1.7 * step * np.sin(angle), 1.7 * step * np.cos(angle))))
    target = C.grid(spark, 23, 27, 7)
    got = C.reproject_chunks(C.chunks_of(px_of(spark, a), 16), target, ws, wt, 16, 7)
    made = np.full((23, 27), np.inf)
    for r in got.collect():
        made[r.ty * 7 : r.ty * 7 + r.h, r.tx * 7 : r.tx * 7 + r.w] = np.reshape(r.pixels, (r.h, r.w))
        assert [bool(c) for c in r.covered] == [not np.isnan(v) for v in r.pixels]
    from skyframe.functions.wcs import header

    want = np.full((23, 27), np.nan)
    for r in mosaic.reproject(px_of(spark, a), px_of(spark, np.zeros((23, 27))), header(**ws), header(**wt)).collect():
        if r.covered:
            want[r.y, r.x] = r.v
    assert np.isnan(want).any() and (~np.isnan(want)).any()
    assert np.allclose(made, want, atol=1e-9, equal_nan=True)
