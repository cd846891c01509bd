"""Queries and operators on tables and plans as they are at larger sizes."""

import duckdb
import numpy as np

from skyframe.operators import mosaic, widths
from skyframe.plans.queries import ORACLES, QUERIES
from skyframe.sources import images, tables

D = "/root/testdata/sf0.001"


def test_streamed_pairs_over_many_hours(spark, tmp_path):
    """Tiles of more hours than the watermark waits, in more files: none comes too late, whichever file is the first to be whole."""
    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT * REPLACE (vec_id * 101 AS vec_id) FROM '{D}/embeddings.parquet') TO '{tmp_path}/embeddings.parquet'")
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "40")
    try:
        got = QUERIES["t1_stream_pairs"](spark, str(tmp_path)).select("name", "status", "has_low", "has_high").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted(map(tuple, got)) == sorted(duck.execute(ORACLES["t1_stream_pairs"]).fetchall())


def test_widths_are_fitted_by_many_tasks(spark):
    """A table of one small file is not one task's work."""
    assert QUERIES["e1_fwhm_bias"](spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == 10


def test_a_tile_is_fitted_as_if_alone():
    """Stacks of several shapes, with tiles that can't be fitted and tiles that take different numbers of steps."""
    rng = np.random.default_rng(7)
    tiles = []
    for k in range(40):
        yy, xx = np.mgrid[: 15 + k % 2, :17].astype(float)
        dy, dx = yy - rng.uniform(6, 9), xx - rng.uniform(7, 9)
        tiles.append(rng.uniform(50, 500) * np.exp(-(dx**2 / rng.uniform(1, 9) + dy**2 / rng.uniform(1, 9)) / 2) + 3 + rng.normal(0, k % 3, yy.shape))
    tiles[5], tiles[6][0, 0] = np.zeros((15, 17)), np.inf
    alone = [widths.fit_gaussians(a[None])[0] or (None,) * 5 for a in tiles]
    together = widths._fit_all(tiles)
    assert [a[0] is None for a in alone] == [k in (5, 6) for k in range(40)] == [a[0] is None for a in together]
    assert np.allclose([a for a in alone if a[0]], [a for a in together if a[0]], rtol=1e-9)


def test_small_ranges_share_tasks(spark, tmp_path):
    """Tasks follow the bytes, not the ranges; a bad file among them is a row of its own."""
    a = np.arange(20 * 48 * 50, dtype=np.float32).reshape(20, 48, 50)
    for k in range(20):
        (tmp_path / f"i{k}.fits").write_bytes(images.encode(a[k]) if k != 7 else b"no image")
    tiles = images.read_mosaic(spark, str(tmp_path), tile=16, range_bytes=2048)
    assert tiles.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert [r.name for r in tiles.filter("error is not null").collect()] == ["i7.fits"]
    got = {(r.name, r.y, r.x): r.v for r in images.mosaic_pixels(tiles, 16).collect()}
    assert got == {(f"i{k}.fits", y, x): a[k, y, x] for k in range(20) if k != 7 for y in range(48) for x in range(50)}


def test_surveys_are_written_without_a_sort(spark, tmp_path):
    """A task's tiles go to their folders one by one; the session is left as it was."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before, frame = spark.conf.get(name), spark.sql("SELECT id AS idx, IF(id % 3 = 0, 'lr', 'hr') AS survey, array(1.0D * id) AS pixels FROM range(0, 300, 1, 2)")
    tables.write_cutout_pairs(frame, str(tmp_path / "pairs"))
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [done.apply(k).physicalPlanDescription() for k in range(done.size())]
    plan = [p for p in plans if str(tmp_path / "pairs") in p][-1]
    assert "survey" in plan and "Sort" not in plan
    assert spark.conf.get(name) == before
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "pairs")).select("idx", "survey", "pixels").collect())) == sorted(map(tuple, frame.collect()))


def test_windows_of_several_chunks_are_put_together_in_blocks(spark):
    """Not one by one; two windows of one idx stay two, and centres without an idx are cut too."""
    a = np.arange(20 * 23, dtype=float).reshape(20, 23)
    chunks = spark.createDataFrame([(y // 8, x // 8, *a[y : y + 8, x : x + 8].shape, a[y : y + 8, x : x + 8].ravel().tolist()) for y in (0, 8, 16) for x in (0, 8, 16)], "ty int, tx int, h int, w int, pixels array<double>")
    at = [(None if y == x else f"i{y % 4}", y, x) for y in range(-2, 23) for x in range(-2, 26)]
    cut = mosaic.cut_tiles(chunks, spark.createDataFrame(at, "idx string, y int, x int"), 5, 8, block_bytes=8 * 25 * 7)
    assert "FlatMapGroupsInArrow [sy" in cut._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for idx, y, x in at:
        part = a[max(y - 2, 0) : max(y + 3, 0), max(x - 2, 0) : max(x + 3, 0)]
        if part.size:
            want.append((str(idx), max(y - 2, 0), max(x - 2, 0), *part.shape, part.ravel().tolist()))
    assert sorted((str(r.idx), r.y, r.x, r.h, r.w, r.pixels) for r in cut.collect()) == sorted(want)
