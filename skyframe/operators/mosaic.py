"""Mosaics: footprints, valid centres, sampling, cutouts and reprojection, as equi-joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.wcs import pix_to_sky, sky_to_pix
from .batches import stable_number
from .chunks import _lists


def sampling_bounds(h: int | Column, w: int | Column, size: int) -> tuple[tuple, tuple]:
    """Inclusive bounds of window centres on both axes, half a window from the edges. Sizes are numbers or Columns."""
    return (size // 2, h - size // 2), (size // 2, w - size // 2)


def valid_centers(mask: DataFrame, size: int) -> DataFrame:
    """(y, x) of all window centres whose pixels [y - size//2, y + size//2) by the same in x are all valid.

    Separable erosion: along rows, then along columns, with ranges, so that a gap counts as invalid. The
    cost is one window per axis over the mask, whatever the number of candidates. An odd size tests size - 1.
    """
    half = size // 2
    if half == 0:
        return mask.select("y", "x")  # an empty window has no invalid pixel
    along = Window.partitionBy("y").orderBy("x").rangeBetween(-half, half - 1)
    rows = mask.filter("valid").withColumn("n", F.count("*").over(along)).filter(F.col("n") == 2 * half).select("y", "x")
    down = Window.partitionBy("x").orderBy("y").rangeBetween(-half, half - 1)
    return rows.withColumn("n", F.count("*").over(down)).filter(F.col("n") == 2 * half).select("y", "x")


def validate_locations(candidates: DataFrame, mask: DataFrame, size: int) -> DataFrame:
    """The candidates (y, x) whose window is valid."""
    return candidates.join(valid_centers(mask, size), ["y", "x"], "left_semi")


def sample_locations(mask: DataFrame, n: int, size: int, seed: int = 0, replace: bool = True) -> DataFrame:
    """n locations, uniform over the valid centres; none if there is no valid centre.

    The centres are numbered in the order of a stable hash of seed, y and x, by ranges of it, as many as shuffle
    partitions; with replacement, draws 0..n-1 take the number that a stable hash gives them; without, the first n centres are
    taken. The result depends on the seed and the mask alone. The centres are counted by a job while the plan is built.
    """
    centers = valid_centers(mask, size).withColumn("h", stable_number(F.lit(seed), "y", "x"))
    if not replace:
        return centers.orderBy("h", "y", "x").limit(n).select("y", "x")
    parts = int(centers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = centers.withColumn("p", F.shiftright(F.col("h") * parts, 32))  # hashes have 32 bits
    counts = keyed.groupBy("p").agg(F.count("*").alias("c"))
    before = counts.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("skip"))  # at most `parts` rows
    numbered = keyed.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("h", "y", "x"))).join(F.broadcast(before), "p").select("y", "x", (F.col("skip") + F.col("r") - 1).cast("bigint").alias("k"))
    total = counts.agg(F.sum("c").alias("total")).first()["total"] or 0
    draws = centers.sparkSession.range(n if total else 0).withColumnRenamed("id", "idx")
    drawn = draws.withColumn("k", (stable_number(F.lit(seed), "idx") % max(total, 1)).cast("bigint"))
    return drawn.join(numbered, "k").select("idx", "y", "x")


def crossmatch_centers(centers: DataFrame, wcs_from: Column, wcs_to: Column, origin: int = 1) -> DataFrame:
    """Adds ra, dec and the position (x_to, y_to) in the other survey. Positions are pixel numbers from `origin`."""
    ra, dec = pix_to_sky(F.col("x").cast("double"), F.col("y").cast("double"), wcs_from, origin)
    at = centers.withColumn("ra", ra).withColumn("dec", dec)
    x, y = sky_to_pix(F.col("ra"), F.col("dec"), wcs_to, origin)
    return at.withColumn("x_to", x).withColumn("y_to", y)


def extract_cutouts(mosaic: DataFrame, centers: DataFrame, size: int, bin_size: int = 64) -> DataFrame:
    """Pixels (idx, y, x, v) of the square window of each centre (idx, y, x), trimmed at the mosaic's edge.

    For mosaics with gaps, whose pixels are rows; dense ones are cut by cut_tiles. The window starts at ceil(centre - size / 2). A window is joined on the bins that it touches, so the
    range condition is a residual of an equi-join; y and x count from the window's start.
    """
    start = lambda c: F.ceil(F.col(c) - size / 2.0).cast("int")
    bins = lambda c: F.explode(F.sequence(F.floor(F.col(c) / bin_size).cast("int"), F.floor((F.col(c) + size - 1) / bin_size).cast("int")))
    windows = centers.select("idx", start("y").alias("y0"), start("x").alias("x0"))
    windows = windows.withColumn("by", bins("y0")).withColumn("bx", bins("x0"))
    binned = mosaic.select("y", "x", "v", F.floor(F.col("y") / bin_size).cast("int").alias("by"), F.floor(F.col("x") / bin_size).cast("int").alias("bx"))
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + size) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + size)
    return binned.join(windows, ["by", "bx"]).filter(inside).select("idx", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "v")


def cut_tiles(chunks: DataFrame, centers: DataFrame, size: int, chunk: int, block_bytes: int = 64 << 20) -> DataFrame:
    """Tiles (idx, y, x, h, w, pixels) of the square window of each centre (idx, y, x), trimmed at the mosaic's edge.

    y and x are the place of the tile's first pixel in the mosaic. The mosaic is dense, in chunks (ty, tx, h, w, pixels) whose first pixel is (ty * chunk, tx * chunk). A window starts at
    ceil(centre - size / 2). Centres meet the one to four chunks that they touch in groups of one chunk and as many centres
    as make block_bytes of pixels, so that a chunk with very many centres is split; numpy slices all windows of a size at
    once, and windows of several chunks are put together, four pieces at most, in groups of those that start in one chunk. No pixel is a row of its own.
    """
    start = lambda c: F.ceil(F.col(c) - size / 2.0).cast("int")
    touched = lambda c: F.explode(F.sequence(F.floor(F.col(c) / chunk).cast("int"), F.floor((F.col(c) + size - 1) / chunk).cast("int")))
    many = max(1, block_bytes // (8 * size * size))
    kind = to_arrow_type(centers.schema["idx"].dataType)
    names, kinds = ["idx", "y", "x", "h", "w", "pixels"], [kind, *[pa.int32()] * 4, pa.list_(pa.float64())]

    schema = f"idx {centers.schema['idx'].dataType.simpleString()}, y int, x int, h int, w int, pixels array<double>"
    arrow = pa.schema(list(zip(names, kinds)))

    def classes(*columns: np.ndarray) -> list[tuple[np.ndarray, tuple[int, ...]]]:
        """The rows of each combination of small numbers, and the combination: at most as many as a window has places and sizes."""
        found, of = np.unique(np.stack(columns, 1), axis=0, return_inverse=True)
        return [(np.flatnonzero(of.ravel() == k), tuple(c.tolist())) for k, c in enumerate(found)]

    def made(idx: pa.Array, y: np.ndarray, x: np.ndarray, tiles: np.ndarray) -> pa.Table:
        n, h, w = tiles.shape
        return pa.table([idx, *(pa.array(c.astype(np.int32)) for c in (y, x, np.full(n, h), np.full(n, w))), _lists(tiles)], schema=arrow)

    def cut(of: pa.Table, held: pa.Table, more: list[str]) -> pa.Table:
        of, out = of.combine_chunks(), []
        y0, x0 = of["y0"].to_numpy(), of["x0"].to_numpy()
        for c in range(held.num_rows):
            h, w, ty, tx = (held[k][c].as_py() for k in ("h", "w", "ty", "tx"))
            a = held["pixels"][c].values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(h, w)
            top, left = np.maximum(y0 - ty * chunk, 0), np.maximum(x0 - tx * chunk, 0)
            high, wide = (np.minimum(end, n) - at for end, n, at in ((y0 + size - ty * chunk, h, top), (x0 + size - tx * chunk, w, left)))
            some = np.flatnonzero((high > 0) & (wide > 0))
            for rows, (ph, pw) in classes(high[some], wide[some]) if len(some) else ():
                at = some[rows]
                whose = of.take(pa.array(at))
                part = made(whose["idx"].combine_chunks(), ty * chunk + top[at], tx * chunk + left[at], sliding_window_view(a, (ph, pw))[top[at], left[at]])
                for k in more:
                    part = part.append_column(k, whose[k])
                out.append(part)
        return pa.concat_tables(out) if out else pa.schema([*arrow, *(of.schema.field(k) for k in more)]).empty_table()

    def put_together(pieces: pa.Table) -> pa.Table:
        """The windows of a block from their pieces: each class of pieces is laid into all of its windows at once."""
        pieces = pieces.combine_chunks()
        y0, x0, y, x, h, w = (pieces[k].to_numpy() for k in ("y0", "x0", "y", "x", "h", "w"))
        code = pieces["idx"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        _, first, of = np.unique(np.stack([code, y0, x0], 1), axis=0, return_index=True, return_inverse=True)
        of, n, lists = of.ravel(), len(first), pieces["pixels"].combine_chunks()
        flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        canvas, box = np.full((n, size, size), np.nan), np.tile([size, size, 0, 0], (n, 1))
        dy, dx = y - y0, x - x0
        for k, (c, f) in enumerate(((dy, np.minimum), (dx, np.minimum), (dy + h, np.maximum), (dx + w, np.maximum))):
            f.at(box[:, k], of, c)
        for rows, (top, left, ph, pw) in classes(dy, dx, h, w):
            canvas[of[rows], top : top + ph, left : left + pw] = flat[starts[rows][:, None] + np.arange(ph * pw)].reshape(-1, ph, pw)
        out = []
        for rows, (top, left, bottom, right) in classes(*box.T):
            at = first[rows]
            out.append(made(pieces["idx"].combine_chunks().take(pa.array(at)), y0[at] + top, x0[at] + left, np.ascontiguousarray(canvas[rows, top:bottom, left:right])))
        return pa.concat_tables(out)

    def pieces(windows: DataFrame, more: list[str]) -> DataFrame:
        windows = windows.withColumn("ty", touched("y0")).withColumn("tx", touched("x0"))
        blocks = windows.groupBy("ty", "tx").agg(F.ceil(F.count("*") / many).cast("int").alias("blocks"))
        dealt = windows.join(blocks, ["ty", "tx"]).withColumn("block", F.expr("int(pmod(xxhash64(idx), blocks))")).drop("blocks")
        copies = chunks.select("ty", "tx", "h", "w", "pixels").join(blocks, ["ty", "tx"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        cuts = ", ".join([schema, *(f"{k} int" for k in more)])
        return dealt.groupBy("ty", "tx", "block").cogroup(copies.toDF(*copies.columns).groupBy("ty", "tx", "block")).applyInArrow(lambda of, held: cut(of, held, more), cuts)

    windows = centers.select("idx", start("y").alias("y0"), start("x").alias("x0"))
    inside = lambda c: F.floor((F.col(c) + size - 1) / chunk) == F.floor(F.col(c) / chunk)
    alone = inside("y0") & inside("x0")
    over = windows.filter(~alone).withColumn("sy", F.floor(F.col("y0") / chunk).cast("int")).withColumn("sx", F.floor(F.col("x0") / chunk).cast("int"))
    parts = over.groupBy("sy", "sx").agg(F.ceil(F.count("*") / many).cast("int").alias("parts"))
    over = over.join(parts, ["sy", "sx"]).select("idx", "y0", "x0", F.expr("int(pmod(xxhash64(idx), parts))").alias("part"), "sy", "sx")
    return pieces(windows.filter(alone), []).unionByName(pieces(over, ["y0", "x0", "part", "sy", "sx"]).groupBy("sy", "sx", "part").applyInArrow(put_together, schema))


def without_overlap(centers: DataFrame, cutouts: DataFrame) -> DataFrame:
    """Centres whose window has no pixel at all."""
    return centers.join(cutouts.select("idx").distinct(), "idx", "left_anti")


def reproject(source: DataFrame, target: DataFrame, wcs_source: Column, wcs_target: Column, origin: int = 1) -> DataFrame:
    """(y, x, v, covered) on the target grid, bilinear; v is NULL unless all four neighbours with weight are there.

    Each target pixel asks for its four neighbours by an equi-join on integer positions.
    """
    moved = crossmatch_centers(target.select("y", "x"), wcs_target, wcs_source, origin)
    moved = moved.withColumn("sx", F.round("x_to", 9)).withColumn("sy", F.round("y_to", 9))
    moved = moved.withColumn("fx", F.col("sx") - F.floor("sx")).withColumn("fy", F.col("sy") - F.floor("sy"))
    corner = lambda dy, dx: F.struct(
        (F.floor("sy") + dy).cast("int").alias("ny"), (F.floor("sx") + dx).cast("int").alias("nx"), ((F.col("fy") if dy else 1 - F.col("fy")) * (F.col("fx") if dx else 1 - F.col("fx"))).alias("weight")
    )
    taps = moved.select("y", "x", F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).alias("t")).select("y", "x", "t.*").filter("weight > 0")
    found = taps.join(source.select(F.col("y").alias("ny"), F.col("x").alias("nx"), "v"), ["ny", "nx"], "left")
    summed = found.groupBy("y", "x").agg(F.sum(F.col("weight") * F.col("v")).alias("v"), F.count("v").alias("have"), F.count("*").alias("need"))
    covered = F.col("have") == F.col("need")
    return summed.select("y", "x", F.when(covered, F.col("v")).alias("v"), covered.alias("covered"))


def footprint(reprojected: DataFrame) -> DataFrame:
    """(y, x, valid): covered, and not zero."""
    return reprojected.select("y", "x", F.coalesce(F.col("covered") & (F.col("v") != 0), F.lit(False)).alias("valid"))
