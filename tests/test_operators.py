"""Operators that SQL on the given tables doesn't reach: files, streams, random draws, plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import arrays
from skyframe.operators import batches, catalog, detect, gates, losses, mosaic, profiles, tiles
from skyframe.operators.tiles import assemble_tiles, blur_tiles, explode_tiles
from skyframe.plans import preprocess
from skyframe.sources import images


def test_images_round_trip_and_bad_files(spark, tmp_path):
    a = np.random.default_rng(0).normal(size=(5, 7)).astype(np.float32)
    (tmp_path / "good.fits").write_bytes(images.encode(a, {"CRPIX1": 2.5}))
    (tmp_path / "bad.fits").write_bytes(b"not an image")
    (tmp_path / "short.fits").write_bytes(images.encode(a)[:3000])
    (tmp_path / "other.txt").write_bytes(b"x")
    assert {r.name for r in images.list_tiles(spark, str(tmp_path)).collect()} == {"good.fits", "bad.fits", "short.fits"}
    rows = {r.name: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert (np.array(rows["good.fits"].pixels, np.float32).reshape(5, 7) == a).all() and rows["good.fits"].header["CRPIX1"] == "2.5"
    assert rows["bad.fits"].error and rows["short.fits"].error and rows["bad.fits"].pixels is None


def test_mosaic_tiles_rebuild_the_image(spark, tmp_path):
    a = np.arange(35, dtype=np.float32).reshape(5, 7)
    (tmp_path / "m.fits").write_bytes(images.encode(a))
    px = images.mosaic_pixels(images.read_mosaic(spark, str(tmp_path), tile=3), 3).collect()
    assert len(px) == 35 and all(r.v == a[r.y, r.x] for r in px)


def test_mosaic_by_byte_ranges(spark, tmp_path):
    """Several tasks, ranges narrower than a row, an extension behind an image, integers, parts, and bad files."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(45, 70)).astype(np.float32), rng.normal(size=(9, 100)).astype(np.float32)
    (tmp_path / "a.fits").write_bytes(images.encode(b) + images.encode(a))
    (tmp_path / "b.fits").write_bytes(images.encode(a)[:5000])
    (tmp_path / "c.fits").write_bytes(b"x")
    read = lambda **k: images.read_mosaic(spark, str(tmp_path), tile=8, range_bytes=700, **k)
    made = read(hdu=1)
    assert made.rdd.getNumPartitions() > 10
    rows = made.collect()
    whole = np.zeros_like(a)
    for r in rows:
        if r.name == "a.fits":
            whole[r.ty * 8 : r.ty * 8 + r.h, r.tx * 8 : r.tx * 8 + r.w] = np.reshape(r.pixels, (r.h, r.w))
    assert np.array_equal(whole, a) and sum(r.name == "a.fits" for r in rows) == 6 * 9
    assert all(r.error and r.pixels is None for r in rows if r.name != "a.fits") and {r.name for r in rows} == {"a.fits", "b.fits", "c.fits"}
    assert {(r.ty, r.tx) for r in read(hdu=1, region=(7, 9, 20, 30)).collect() if r.name == "a.fits"} == {(y, x) for y in (0, 1) for x in (2, 3)}
    one = images.plan_ranges(spark, str(tmp_path), 1, 8, 8 * 8 * 4 * 3).filter("error is null")
    assert {(r.x0, r.x1) for r in one.collect()} == {(0, 24), (24, 48), (48, 70)}


def test_mosaic_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file of 2.6 GB; its last tile has the bytes that were written there."""
    side = 51_000
    head = images.encode(np.zeros((1, 1), np.float32))[:2880].replace(f"BITPIX  = {-32:>20}".encode(), f"BITPIX  = {8:>20}".encode())
    head = head.replace(f"NAXIS1  = {1:>20}".encode(), f"NAXIS1  = {side:>20}".encode()).replace(f"NAXIS2  = {1:>20}".encode(), f"NAXIS2  = {side:>20}".encode())
    with open(tmp_path / "m.fits", "wb") as f:
        f.write(head)
        f.seek(2880 + side * (side - 1) + side - 5)
        f.write(bytes([1, 2, 3, 4, 5]))
    assert (tmp_path / "m.fits").stat().st_size > 2**31
    assert images.plan_ranges(spark, str(tmp_path)).count() == 100  # 50 by 50 tiles, 32 a range: two to a row of tiles
    (r,) = images.read_mosaic(spark, str(tmp_path), region=(side - 1, side, side - 5, side)).collect()
    last = np.reshape(r.pixels, (r.h, r.w))
    assert (r.ty, r.tx) == (49, 49) and last[-1, -5:].tolist() == [1, 2, 3, 4, 5] and last.sum() == 15


def test_scaled_integer_image():
    raw = images.encode(np.zeros((1, 2), np.float32), {"BSCALE": 2, "BZERO": 10})
    body = raw[:2880].replace(b"BITPIX  =                  -32", b"BITPIX  =                   16") + np.array([3, -1], ">i2").tobytes()
    assert images.decode(body)[0].tolist() == [[16.0, 8.0]]


def mask_of(spark, valid):
    return spark.createDataFrame([(y, x, bool(v)) for (y, x), v in np.ndenumerate(valid)], "y int, x int, valid boolean")


def test_valid_centers_match_windows(spark):
    valid = np.random.default_rng(3).random((20, 15)) > 0.08
    for size in (2, 4, 5):
        h = size // 2
        want = {(y, x) for y in range(20) for x in range(15) if y >= h and x >= h and y + h <= 20 and x + h <= 15 and valid[y - h : y + h or None, x - h : x + h or None].all()}
        got = {(r.y, r.x) for r in mosaic.valid_centers(mask_of(spark, valid), size).collect()}
        assert got == want
    assert mosaic.valid_centers(mask_of(spark, valid), 1).count() == 300  # an empty window holds no invalid pixel


def test_sampling_is_over_valid_centers_only(spark):
    valid = np.zeros((12, 12))
    valid[2:9, 3:10] = 1
    mask = mask_of(spark, valid)
    centers = {(r.y, r.x) for r in mosaic.valid_centers(mask, 4).collect()}
    drawn = mosaic.sample_locations(mask, 600, 4, seed=1).collect()
    assert len(drawn) == 600 and {(r.y, r.x) for r in drawn} == centers
    assert sorted(r.idx for r in drawn) == list(range(600))
    assert mosaic.sample_locations(mask, 10, 10).count() == 0
    assert mosaic.sampling_bounds(10, 20, 4) == ((2, 8), (2, 18))


def test_cutouts_never_plan_a_cartesian_product(spark):
    m = spark.range(400).select((F.col("id") / 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"), F.col("id").cast("double").alias("v"))
    c = spark.createDataFrame([(0, 5, 5), (1, 0, 19), (2, 50, 50)], "idx long, y int, x int")
    cut = mosaic.extract_cutouts(m, c, 4, 8)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert {r.idx: r["count"] for r in cut.groupBy("idx").count().collect()} == {0: 16, 1: 2 * 3}
    assert [r.idx for r in mosaic.without_overlap(c, cut).collect()] == [2]


def test_sources_by_area(spark):
    a = np.zeros((8, 8))
    a[1:3, 1:4] = 50
    a[6, 6] = 50
    noise = np.random.default_rng(5).normal(size=(8, 8))
    t = spark.createDataFrame([(0, 8, 8, (a + noise).ravel().tolist()), (1, 8, 8, None)], "idx long, h int, w int, pixels array<double>")
    rows = {r.idx: r.mask for r in detect.detect_sources(t, 5.0, 5).collect()}
    assert (np.array(rows[0]).reshape(8, 8) == (a * (np.indices(a.shape)[0] < 5) > 0)).all() and rows[1] is None


def test_masked_loss_without_sources_is_null(spark):
    p = spark.createDataFrame([(0, [1.0, 2.0], [0.0, 0.0], [0, 0])], "idx long, real array<double>, fake array<double>, mask array<int>")
    r = losses.validate(p, ["idx"]).first()
    assert r.l1 == 1.5 and r.masked_l1 is None and r.masked_l2 is None and r.loss_ratio is None


def test_numbers_are_dense_in_any_layout(spark):
    df = spark.range(0, 997, 3).repartition(7).withColumn("k", F.col("id") % 5)
    rows = batches.number_rows(df, ["k", "id"]).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(len(rows))) and [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in rows)
    assert batches.number_rows(df.limit(0), ["k", "id"]).count() == 0


def test_split_and_flips_are_fair(spark):
    df = spark.range(20_000).withColumnRenamed("id", "name")
    share = batches.train_val_split(df, "name").filter("split = 'val'").count() / 20_000
    assert abs(share - 0.2) < 0.01
    v, h = batches.flips("name", 3)
    counts = [r["count"] for r in df.groupBy(v.alias("v"), h.alias("h")).count().collect()]
    assert len(counts) == 4 and min(counts) > 4500


def test_explode_and_assemble(spark):
    t = spark.createDataFrame([(7, 2, 3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "idx long, h int, w int, pixels array<double>")
    assert assemble_tiles(explode_tiles(t), ["idx"]).first() == t.first()


def test_growth_curve_of_a_point(spark):
    t = spark.createDataFrame([(0, 5, 5, [float(i == 12) for i in range(25)]), (1, 5, 5, None), (2, 5, 5, [0.0] * 25), (3, 4, 5, [1.0] * 25)], "idx long, h int, w int, pixels array<double>")
    curves = profiles.growth_curve(t, 2, 2)
    rows = {r.idx: (r.r25, r.r50, r.r75, r.c7525) for r in profiles.light_radii(curves).collect()}
    assert rows[0] == (0, 0, 0, None) and all(rows[i] == (None,) * 4 for i in (1, 2, 3))
    points = profiles.curve_points(curves).collect()
    assert {r.idx for r in points} == {0, 2} and all(r.frac is None for r in points if r.idx == 2)
    moments = {r.idx for r in profiles.tile_moments(t).collect()}
    assert moments == {0}


def test_profiles_shuffle_no_pixels(spark):
    t = spark.createDataFrame([(0, 5, 5, [1.0] * 25)], "idx long, h int, w int, pixels array<double>")
    for df in (profiles.growth_curve(t, 2, 2), profiles.light_radii(profiles.growth_curve(t, 2, 2)), profiles.tile_moments(t), blur_tiles(t, 1.0), detect.detect_sources(t)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan


def flood(mask, least):
    """Areas by flood fill, for comparison."""
    h, w = mask.shape
    out, seen = np.zeros((h, w), np.int8), np.zeros((h, w), bool)
    for start in zip(*np.nonzero(mask)):
        if seen[start]:
            continue
        area, open_ = [], [start]
        seen[start] = True
        while open_:
            y, x = open_.pop()
            area.append((y, x))
            for p in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if 0 <= p[0] < h and 0 <= p[1] < w and mask[p] and not seen[p]:
                    seen[p] = True
                    open_.append(p)
        if len(area) >= least:
            for p in area:
                out[p] = 1
    return out


def test_areas_match_a_flood_fill():
    rng = np.random.default_rng(4)
    for shape in ((1, 1), (1, 9), (9, 1), (17, 23), (40, 40)):
        for share in (0.0, 0.1, 0.35, 0.6, 1.0):
            mask = (rng.random(shape) < share).astype(np.int8)
            for least in (1, 2, 5):
                assert (detect.keep_areas(mask, least) == flood(mask, least)).all()
    spiral = np.zeros((61, 61), np.int8)
    for k in range(0, 30, 2):
        spiral[k, k : 61 - k] = spiral[60 - k, k : 61 - k] = spiral[k : 61 - k, k] = spiral[k : 61 - k, 60 - k] = 1
        spiral[k + 1, k], spiral[k + 1, k + 1] = 0, 1
    assert (detect.keep_areas(spiral, 100) == flood(spiral, 100)).all()


def test_blur_of_arrays_equals_that_of_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 5 + i, 7, rng.random((5 + i) * 7).tolist()) for i in range(4)] + [(9, 3, 3, None)]
    t = spark.createDataFrame(rows, "idx long, h int, w int, pixels array<double>")
    for mode in ("symmetric", "nearest"):
        a = {r.idx: r.pixels for r in blur_tiles(t, 0.6, mode).collect()}
        b = {r.idx: r.p for r in t.select("idx", arrays.gaussian_blur("pixels", F.col("h"), F.col("w"), 0.6, mode).alias("p")).collect()}
        assert a[9] is None and all(np.allclose(a[i], b[i]) for i in range(4))


def test_dataset_statistics_by_refinement(spark, monkeypatch):
    rng = np.random.default_rng(6)
    made = {1: rng.normal(5, 1, 4000), 2: rng.integers(0, 3, 3000).astype(float), 3: np.full(600, 7.5), 4: np.concatenate([[-1e6, 1e6], rng.normal(0, 1e-3, 801)])}
    rows = [(g, 1, len(p), p.tolist()) for g, v in made.items() for p in np.array_split(v, 7)]
    t = spark.createDataFrame(rows, "label int, h int, w int, pixels array<double>")
    for few in (100_000, 50):
        monkeypatch.setattr(tiles, "FEW_VALUES", few)
        for r in tiles.dataset_stats(t, ["label"]).collect():
            v = made[r.label]
            assert (r.lowest, r.highest) == (v.min(), v.max()) and np.isclose(r["std"], v.std(), rtol=1e-6, atol=1e-9)
            assert np.isclose(r["median"], np.median(v), rtol=1e-12, atol=1e-12), (few, r.label)
    near = {r.label: r["median"] for r in tiles.dataset_stats(t, ["label"], exact=False).collect()}
    assert all(abs(near[g] - np.median(v)) <= (v.max() - v.min()) / tiles.BINS for g, v in made.items())


def test_cutouts_of_chunks_match_slices(spark):
    """Inside a chunk, over two and four of them, over the edge, without overlap; and many centres in one chunk."""
    a = np.arange(50 * 70, dtype=float).reshape(50, 70)
    px = spark.createDataFrame([(y, x, float(a[y, x])) for y in range(50) for x in range(70)], "y int, x int, v double")
    rng = np.random.default_rng(7)
    centers = [(i, int(y), int(x)) for i, (y, x) in enumerate(zip(rng.integers(-8, 58, 120), rng.integers(-8, 78, 120)))]
    df = spark.createDataFrame(centers, "idx int, y int, x int")
    for size in (4, 7, 30):
        want = {}
        for i, y, x in centers:
            y0, x0 = int(np.ceil(y - size / 2)), int(np.ceil(x - size / 2))
            part = a[max(y0, 0) : max(y0 + size, 0), max(x0, 0) : max(x0 + size, 0)]
            if part.size:
                want[i] = (max(y0, 0), max(x0, 0), *part.shape, part.ravel().tolist())
        got = mosaic.cut_tiles(tiles.chunked(px, 16), df, size, 16, block_bytes=1000).collect()
        assert len(got) == len(want) and {r.idx: (r.y, r.x, r.h, r.w, r.pixels) for r in got} == want


def test_samples_hang_on_the_seed_alone(spark):
    mask = spark.createDataFrame([(y, x, (y * x) % 11 != 3) for y in range(20) for x in range(20)], "y int, x int, valid boolean")
    drawn = []
    for parts in ("3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        drawn.append(sorted(map(tuple, mosaic.sample_locations(mask, 50, 2, 9).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert drawn[0] == drawn[1] and len(drawn[0]) == 50


def test_ratio_assertion_fails_the_job(spark):
    ok = spark.createDataFrame([(12, 12, 2, 2), (12, 12, None, 2)], "h int, w int, lh int, lw int")
    assert gates.assert_ratio(ok, 6, ("h", "w"), ("lh", "lw")).count() == 2
    bad = ok.union(spark.createDataFrame([(12, 18, 2, 2)], ok.schema))
    with pytest.raises(Exception, match="6 times"):
        gates.assert_ratio(bad, 6, ("h", "w"), ("lh", "lw")).collect()


def test_standard_error_of_biases(spark):
    p = spark.createDataFrame([("a", "m", float(v)) for v in (1, 2, 3, 4)], "source string, mode string, bias double")
    r = catalog.bias_summary(p, ["source", "mode"], standard_error=True).first()
    assert np.isclose(r.spread, np.std([1, 2, 3, 4], ddof=1) / 2)


def test_scoring_keeps_null_tiles(spark):
    t = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0]), (1, None)], "idx long, pixels array<float>")
    rows = {r.idx: r.predicted for r in preprocess.score_tiles(t, preprocess.nearest_baseline(2), 2, 2).collect()}
    assert rows[0] == [1, 1, 2, 2, 1, 1, 2, 2, 3, 3, 4, 4, 3, 3, 4, 4] and rows[1] is None


def test_preprocess_kernel_matches_columns(spark):
    """Crops by odd differences and beyond the tile, flips, dark and constant tiles, NaNs; NULL and short tiles give NULLs."""
    rng = np.random.default_rng(12)
    made = [(rng.normal(0.2, 1, 81), rng.normal(0, 1, 25)) for _ in range(6)] + [(np.full(81, 2.0), np.full(25, 0.5)), (-np.ones(81), -np.ones(25)), (rng.normal(0, 1, 81), None), (rng.normal(0, 1, 80), rng.normal(0, 1, 25))]
    made[2][0][5] = np.nan
    t = spark.createDataFrame([(i, "k", *(None if a is None else a.tolist() for a in p)) for i, p in enumerate(made)], "idx int, other string, hr array<double>, lr array<double>")
    for hr, lr in (((9, 6, 2), (5, 3, 1)), ((9, 8, 0), (5, 4, 2)), ((9, 11, 3), (5, 6, 1))):
        for epoch in (None, 1, 2):
            a, b = ({r.idx: r for r in f(t, hr, lr, 1.0, epoch, seed=3).collect()} for f in (preprocess.preprocess, preprocess.preprocess_columns))
            assert set(a) == set(b) == set(range(10)) and a[0].other == "k"
            for i in range(10):
                for c, n in (("hr", hr), ("lr", lr), ("lr_up", hr), ("mask", hr)):
                    if i >= 8:
                        assert a[i][c] is None
                        continue
                    x, y = (np.array([np.nan if v is None else v for v in r[i][c]], float) for r in (a, b))
                    assert (a[i][f"{c}_h"], len(x)) == (b[i][f"{c}_h"], (n[1] + 2 * n[2]) ** 2)
                    assert np.allclose(x, y, atol=1e-12, equal_nan=True), (i, c)
    with pytest.raises(ValueError):
        preprocess.preprocess(t, (9, 3, 3), (5, 3, 1))


def test_numbers_of_equal_and_text_keys(spark):
    """A million equal first keys are spread over ranges; numbers are dense and in order, whatever the types."""
    hot = spark.range(1_000_000).select(F.lit("same").alias("k"), (F.col("id") % 7).alias("v"))
    parts = batches._ranges(hot, ["k"], 8).groupBy(F.shiftright("__at", 33)).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 200_000
    got = batches.number_rows(hot, ["k"], buckets=8)
    assert got.agg(F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal")).first() == (1_000_000, 0, 999_999)
    rows = [(t, d, i) for i, (t, d) in enumerate([("b", None), (None, 1.5), ("a", -2.0), ("b", 3.0), ("a", float("nan")), ("", 0.0), ("b", 3.0)])]
    df = spark.createDataFrame(rows, "t string, d double, i int")
    numbered = {r.i: r.n for r in batches.number_rows(df, ["t", F.desc("d"), "i"], "n", 3).collect()}
    assert [numbered[i] for i in (1, 5, 4, 2, 3, 6, 0)] == list(range(7))
    assert batches.number_rows(df.limit(0), ["t"]).count() == 0


def test_finite_pixels_count(spark, monkeypatch):
    """NaN, infinite and NULL pixels, groups without a finite one, and medians among very many equal values."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, 6, [1.0, nan, inf, -inf, 3.0, None]), (1, 2, 2, [5.0, 7.0, 9.0, nan]), (2, 1, 2, [nan, inf]), (3, 1, 3, [1.0, 2.0]), (4, 1, 200, [0.25] * 150 + [9.0] * 50), (5, 1, 2, [-1.7e308, 1.7e308])]
    t = spark.createDataFrame(rows, "g int, h int, w int, pixels array<double>")
    for few in (100_000, 2):
        monkeypatch.setattr(tiles, "FEW_VALUES", few)
        got = {r.g: tuple(r)[1:] for r in tiles.dataset_stats(t, ["g"]).collect()}
        v = np.array([1, 3, 5, 7, 9.0])
        assert got[1][:3] == (1, 9, 5) and np.isclose(got[1][3], v.std()) and got[1][4] == 5
        assert got[2] == (None, None, None, None, 2) and 3 not in got and got[4][:3] == (0.25, 9.0, 0.25) and got[5][2] == 0


def test_pairs_of_batches(spark):
    from skyframe.streaming import jobs

    at = lambda m: F.timestamp_seconds(F.lit(60 * m))
    row = lambda n, m, v: spark.range(1).select(F.lit(n).alias("name"), at(m).alias("ts"), v.alias("pixels"))
    ones, none = F.array(*[F.lit(5.0)] * 3), F.lit(None).cast("array<double>")
    low = row("a", 0, ones).union(row("b", 0, ones)).union(row("c", 0, none)).union(row("late", 0, ones)).union(row(None, 0, ones))
    high = row("a", 30, ones).union(row("b", 0, F.array(F.lit(0.1)))).union(row("c", 0, ones)).union(row("late", 61, ones)).union(row("d", 0, ones))
    got = sorted((str(r.name), r.status) for r in jobs.paired_gate(low, high).collect())
    assert got == sorted([("a", "accepted"), ("b", "rejected"), ("c", "rejected"), ("late", "unpaired"), ("late", "unpaired"), ("None", "unpaired"), ("d", "unpaired")])


def test_values_are_carried_over_ranges(spark):
    """One run of most rows, short and null runs, leading nulls, a value that must cross several ranges."""
    rng = np.random.default_rng(15)
    rows = [("hot" if i % 10 else ("a", "b", None)[i // 10 % 3], i, float(i) if (i < 900 and rng.random() < 0.05) else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "run string, step int, value double").repartition(5)
    got = {r.step: r.carried for r in batches.carry_last(df, "value", ["run"], ["step"], ranges=9).collect()}
    last = {}
    for run, step, value in rows:
        last[run] = value if value is not None else last.get(run)
        assert got[step] == last[run], (run, step)
    assert batches.carry_last(df.limit(0), "value", ["run"], ["step"]).count() == 0
