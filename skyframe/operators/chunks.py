"""Dense mosaics as chunks (ty, tx, h, w, pixels) whose first pixel is (ty * chunk, tx * chunk): windows, masks, draws and reprojection.

Chunks that are stored with a border hold every window that starts in them, so that neither windows nor pixels
are shuffled afterwards. NaN is a pixel that isn't there. Work on chunks is numpy in grouped Arrow tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.wcs import move_pixels
from .batches import stable_long

CHUNK = "ty int, tx int, h int, w int, pixels array<double>"
PIECE = "ty int, tx int, y0 int, x0 int, h int, w int, pixels array<double>"
BITS = "ty int, tx int, h int, w int, n bigint, bits binary"
TASK_BYTES = 64 << 20


KINDS = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<tinyint>": pa.list_(pa.int8())}


def _arrow(schema: str | T.StructType) -> pa.Schema:
    """A schema in Arrow; text is read without a session, as tasks have none."""
    return pa.schema([(c, KINDS[k]) for c, k in (x.split(" ") for x in schema.split(", "))]) if isinstance(schema, str) else to_arrow_schema(schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _array(table: pa.Table | pa.RecordBatch, row: int, dtype: type = np.float64) -> np.ndarray:
    """The (h, w) array of a row's pixels, in place where it can be."""
    values = table.column("pixels")[row].values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return values.reshape(table.column("h")[row].as_py(), table.column("w")[row].as_py())


def _lists(arrays: np.ndarray) -> pa.ListArray:
    """One list for each array along the first axis, without a copy."""
    n, size = len(arrays), int(np.prod(arrays.shape[1:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(arrays.ravel()))


def chunks_of(pixels: DataFrame, chunk: int) -> DataFrame:
    """Pixel rows (y, x, v) of a mosaic that may have gaps as chunks, from each chunk's first place to its last pixel; gaps are NaN."""
    schema = _arrow(CHUNK)

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        ty, tx = (k.as_py() for k in key)
        y, x = rows.column("y").to_numpy() - ty * chunk, rows.column("x").to_numpy() - tx * chunk
        a = np.full((int(y.max()) + 1, int(x.max()) + 1), np.nan)
        a[y, x] = rows.column("v").to_numpy(zero_copy_only=False)
        return _table([(ty, tx, *a.shape, a.ravel())], schema)

    at = lambda c: F.floor(F.col(c) / chunk).cast("int").alias(f"t{c}")
    return pixels.select("y", "x", F.col("v").cast("double").alias("v"), at("y"), at("x")).groupBy("ty", "tx").applyInArrow(fill, CHUNK)


def with_border(chunks: DataFrame, chunk: int, before: int, after: int) -> DataFrame:
    """Chunks with `before` pixels more above and left, and `after` below and right, as far as the mosaic goes: (ty, tx, y0, x0, h, w, pixels).

    y0 and x0 are the place of the first pixel. Each chunk is shuffled once, with its edges to the neighbours that need
    them; write the result, which serves any number of cuts. Chunks that aren't there stay so, and are NaN in their neighbours' borders.
    """
    schema = _arrow(PIECE)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, ty, tx = _array(batch, r), batch.column("ty")[r].as_py(), batch.column("tx")[r].as_py()
                rows = []
                for to_y in range((ty * chunk - after) // chunk, (ty * chunk + chunk - 1 + before) // chunk + 1):
                    for to_x in range((tx * chunk - after) // chunk, (tx * chunk + chunk - 1 + before) // chunk + 1):
                        top, left = max(to_y * chunk - before - ty * chunk, 0), max(to_x * chunk - before - tx * chunk, 0)
                        part = a[top : max(to_y * chunk + chunk + after - ty * chunk, 0), left : max(to_x * chunk + chunk + after - tx * chunk, 0)]
                        if part.size:
                            rows.append((to_y, to_x, ty * chunk + top, tx * chunk + left, *part.shape, part.ravel()))
                yield from _table(rows, schema).to_batches()

    def join(key: tuple, pieces: pa.Table) -> pa.Table:
        ty, tx = (k.as_py() for k in key)
        y, x, h, w = (pieces.column(c).to_numpy() for c in ("y0", "x0", "h", "w"))
        if not ((y // chunk == ty) & (x // chunk == tx)).any():
            return schema.empty_table()  # only borders: there is no such chunk
        a = np.full((int((y + h).max() - y.min()), int((x + w).max() - x.min())), np.nan)
        for k in range(len(y)):
            a[y[k] - y.min() :, x[k] - x.min() :][: h[k], : w[k]] = _array(pieces, k)
        return _table([(ty, tx, int(y.min()), int(x.min()), *a.shape, a.ravel())], schema)

    return chunks.select("ty", "tx", "h", "w", "pixels").mapInArrow(share, PIECE).groupBy("ty", "tx").applyInArrow(join, PIECE)


def _meet(points: DataFrame, held: DataFrame, many: int, spread: list[str], work: Callable[[pa.Table, pa.Table], pa.Table], schema: str | T.StructType) -> DataFrame:
    """work(points, chunk) for each chunk of `held` and the points with its (ty, tx), about `many` at once: a chunk with very many points is dealt to several tasks by a hash of `spread`."""
    by = ("ty", "tx", "block")
    blocks = points.groupBy("ty", "tx").agg(F.ceil(F.count("*") / many).cast("int").alias("blocks"))
    dealt = points.join(blocks, ["ty", "tx"]).withColumn("block", F.pmod(F.xxhash64(*spread), F.col("blocks")).cast("int")).drop("blocks")
    copies = held.join(blocks, ["ty", "tx"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return dealt.groupBy(*by).cogroup(copies.toDF(*copies.columns).groupBy(*by)).applyInArrow(work, schema)


def cut_bordered(bordered: DataFrame, centers: DataFrame, size: int, chunk: int, block_bytes: int = TASK_BYTES) -> DataFrame:
    """Tiles (idx, y, x, h, w, pixels) of the square window of each centre (idx, y, x), trimmed at the mosaic's edge.

    bordered: with_border(chunks, chunk, 0, size - 1) or more, so a window lies in the chunk in which it starts; nothing is shuffled
    after the cut. A window starts at ceil(centre - size / 2); y and x are the place of the tile's first pixel. Windows without a pixel,
    and those that start in a chunk that isn't there, give no row.
    """
    kind = centers.schema["idx"].dataType
    schema = T.StructType([T.StructField("idx", kind), *T.StructType.fromDDL("y int, x int, h int, w int, pixels array<double>")])
    arrow = _arrow(schema)

    def work(of: pa.Table, held: pa.Table) -> pa.Table:
        if not held.num_rows:
            return arrow.empty_table()
        a, y0, x0 = _array(held, 0), held.column("y0")[0].as_py(), held.column("x0")[0].as_py()
        y, x, idx = of.column("y0").to_numpy() - y0, of.column("x0").to_numpy() - x0, of.column("idx")
        whole = (y >= 0) & (x >= 0) & (y + size <= a.shape[0]) & (x + size <= a.shape[1])
        made = []
        if whole.any():
            tiles = sliding_window_view(a, (size, size))[y[whole], x[whole]]
            n = len(tiles)
            made.append(pa.table([idx.filter(pa.array(whole)).combine_chunks(), pa.array((y[whole] + y0).astype(np.int32)), pa.array((x[whole] + x0).astype(np.int32)), *[pa.array(np.full(n, size, np.int32))] * 2, _lists(tiles)], schema=arrow))
        rows = []
        for k in np.flatnonzero(~whole).tolist():
            top, left = max(int(y[k]), 0), max(int(x[k]), 0)
            part = a[top : max(int(y[k]) + size, 0), left : max(int(x[k]) + size, 0)]
            if part.size:
                rows.append((idx[k].as_py(), y0 + top, x0 + left, *part.shape, part.ravel()))
        return pa.concat_tables([*made, _table(rows, arrow)])

    start = lambda c: F.ceil(F.col(c) - size / 2.0).cast("int")
    at = lambda c: F.floor(F.greatest(F.col(c), F.lit(0)) / chunk).cast("int")
    windows = centers.select("idx", start("y").alias("y0"), start("x").alias("x0")).withColumn("ty", at("y0")).withColumn("tx", at("x0"))
    return _meet(windows, bordered, max(1, block_bytes // (8 * size * size)), ["idx", "y0", "x0"], work, schema)


def valid_bits(bordered: DataFrame, chunk: int, size: int) -> DataFrame:
    """(ty, tx, h, w, n, bits): the positions of each chunk whose window [c - size // 2, c + size // 2) on both axes is all valid, as a bitmap, and their number.

    bordered: with_border(mask chunks, chunk, size // 2, size // 2) of 1 for valid pixels; 0 and NaN are invalid, and so is a window
    that leaves the mosaic. A summed-area table of the chunk answers each window by four look-ups.
    """
    half, schema = size // 2, _arrow(BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a = _array(batch, r)
                ty, tx, y0, x0 = (batch.column(c)[r].as_py() for c in ("ty", "tx", "y0", "x0"))
                sums = np.zeros((a.shape[0] + 1, a.shape[1] + 1), np.int64)
                sums[1:, 1:] = (a == 1).cumsum(0).cumsum(1)
                top, left = ty * chunk - y0, tx * chunk - x0
                h, w = min(chunk, a.shape[0] - top), min(chunk, a.shape[1] - left)
                ok = np.zeros((h, w), bool)
                y = np.arange(max(top, half), min(top + h, a.shape[0] - half + 1))
                x = np.arange(max(left, half), min(left + w, a.shape[1] - half + 1))
                if len(y) and len(x):
                    at = lambda dy, dx: sums[y[:, None] + dy, x[None] + dx]  # noqa: E731, B023
                    ok[y[0] - top : y[-1] + 1 - top, x[0] - left : x[-1] + 1 - left] = at(half, half) - at(-half, half) - at(half, -half) + at(-half, -half) == 4 * half * half
                yield from _table([(ty, tx, h, w, int(ok.sum()), np.packbits(ok.ravel()).tobytes())], schema).to_batches()

    return bordered.mapInArrow(run, BITS)


def _places(bits: bytes, h: int, w: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=h * w))


def centers_of(bits: DataFrame, chunk: int) -> DataFrame:
    """(y, x) of all set positions, in the order of a chunk's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ty, tx, h, w, bits in zip(*(batch.column(c).to_pylist() for c in ("ty", "tx", "h", "w", "bits"))):
                at = _places(bits, h, w)
                yield pa.RecordBatch.from_arrays([pa.array((ty * chunk + at // w).astype(np.int32)), pa.array((tx * chunk + at % w).astype(np.int32))], names=["y", "x"])

    return bits.filter("n > 0").mapInArrow(run, "y int, x int")


def validate_points(points: DataFrame, bits: DataFrame, chunk: int, many: int = 1 << 20) -> DataFrame:
    """The points (y, x and any other columns) whose position is set."""
    hashable = [f"row.`{f.name}`" for f in points.schema if "map<" not in f.dataType.simpleString()]
    held = points.select(F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("row"), F.floor(F.col("y") / chunk).cast("int").alias("ty"), F.floor(F.col("x") / chunk).cast("int").alias("tx"), F.col("y").cast("int").alias("py"), F.col("x").cast("int").alias("px"))
    schema = T.StructType([held.schema["row"]])
    arrow = _arrow(schema)

    def work(of: pa.Table, held: pa.Table) -> pa.Table:
        if not held.num_rows:
            return arrow.empty_table()
        ty, tx, h, w, bits = (held.column(c)[0].as_py() for c in ("ty", "tx", "h", "w", "bits"))
        y, x = of.column("py").to_numpy() - ty * chunk, of.column("px").to_numpy() - tx * chunk
        inside = (y < h) & (x < w)
        ok = np.zeros(len(y), bool)
        ok[inside] = np.unpackbits(np.frombuffer(bits, np.uint8), count=h * w)[y[inside] * w + x[inside]] == 1
        return of.select(["row"]).filter(pa.array(ok)).cast(arrow)

    return _meet(held, bits.filter("n > 0"), many, hashable, work, schema).select("row.*")


def _permuted(k: np.ndarray, total: int, seed: int) -> np.ndarray:
    """A permutation of 0..total-1 at k: a Feistel network on the least even number of bits, walked until it falls below total."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    mixed = lambda v, r: ((v + np.uint64(seed * 0x9E3779B9 + r * 0x85EBCA6B & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(29)) * np.uint64(0x94D049BB133111EB) >> np.uint64(31)
    out, open_ = k.astype(np.uint64), np.ones(len(k), bool)
    while open_.any():
        a, b = out[open_] >> np.uint64(half), out[open_] & mask
        for r in range(6):
            a, b = b, a ^ (mixed(b, r) & mask)
        out[open_] = a << np.uint64(half) | b
        open_ &= out >= total
    return out.astype(np.int64)


def draw_locations(bits: DataFrame, chunk: int, n: int, seed: int = 0, replace: bool = True) -> DataFrame:
    """(idx, y, x) of draws 0..n-1, uniform over the set positions; without replacement at most as many as there are, all different.

    A draw is a rank among the set positions in the order of chunks (ty, tx), then of rows: the chunk is found by prefix sums of the
    chunks' counts, the position by selecting in its bitmap. Work follows the draws and the chunks; no position is a row. The counts are
    summed by a job while the plan is built.
    """
    spark = bits.sparkSession
    lit = bits.filter("n > 0")
    total = lit.agg(F.sum("n").alias("n")).first()["n"] or 0
    draws = spark.range((n if replace else min(n, total)) if total else 0).withColumnRenamed("id", "idx")
    if replace:
        ranked = draws.withColumn("k", stable_long(F.lit(seed), "idx") % max(total, 1))
    else:

        def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_permuted(batch.column(0).to_numpy(), total, seed))], names=["idx", "k"])

        ranked = draws.mapInArrow(permute, "idx bigint, k bigint")
    rows = lit.groupBy("ty").agg(F.sum("n").alias("m"))
    above = rows.select("ty", (F.sum("m").over(Window.orderBy("ty")) - F.col("m")).alias("above"))  # a row a row of chunks
    starts = lit.select("ty", "tx", "n", (F.sum("n").over(Window.partitionBy("ty").orderBy("tx")) - F.col("n")).alias("left")).join(above, "ty").select("ty", "tx", "n", (F.col("above") + F.col("left")).alias("start"))
    span = chunk * chunk  # no chunk has more, so it touches two bins at most
    binned = starts.withColumn("bin", F.explode(F.sequence(F.expr(f"start div {span}"), F.expr(f"(start + n - 1) div {span}"))))
    schema = "idx bigint, ty int, tx int, r bigint"

    def find(of: pa.Table, starts: pa.Table) -> pa.Table:
        if not starts.num_rows:  # a bin always has chunks if it has draws, but cogroup also gives bins without draws
            return _arrow(schema).empty_table()
        start = starts.column("start").to_numpy()
        order = np.argsort(start)
        k = of.column("k").to_numpy()
        at = order[np.searchsorted(start[order], k, "right") - 1]
        return pa.table([of.column("idx"), *(pa.array(starts.column(c).to_numpy()[at]) for c in ("ty", "tx")), pa.array(k - start[at])], schema=_arrow(schema))

    placed = ranked.withColumn("bin", F.expr(f"k div {span}")).groupBy("bin").cogroup(binned.groupBy("bin")).applyInArrow(find, schema)

    def select(of: pa.Table, held: pa.Table) -> pa.Table:
        out = _arrow("idx bigint, y int, x int")
        if not held.num_rows or not of.num_rows:
            return out.empty_table()
        ty, tx, h, w, bits = (held.column(c)[0].as_py() for c in ("ty", "tx", "h", "w", "bits"))
        at = _places(bits, h, w)[of.column("r").to_numpy()]
        return pa.table([of.column("idx"), pa.array((ty * chunk + at // w).astype(np.int32)), pa.array((tx * chunk + at % w).astype(np.int32))], schema=out)

    return placed.groupBy("ty", "tx").cogroup(lit.groupBy("ty", "tx")).applyInArrow(select, "idx bigint, y int, x int")


def grid(spark: SparkSession, height: int, width: int, chunk: int) -> DataFrame:
    """(ty, tx, h, w) of the chunks of a mosaic, spread over tasks."""
    down, across = -(-height // chunk), -(-width // chunk)
    cells = spark.range(0, down * across, 1, max(1, min(down * across, 2 * spark.sparkContext.defaultParallelism)))
    ty, tx = F.expr(f"int(id div {across})"), F.expr(f"int(id % {across})")
    return cells.select(ty.alias("ty"), tx.alias("tx"), F.least(F.lit(chunk), F.lit(height) - ty * chunk).cast("int").alias("h"), F.least(F.lit(chunk), F.lit(width) - tx * chunk).cast("int").alias("w"))


def reproject_chunks(source: DataFrame, target: DataFrame, wcs_source: dict[str, float], wcs_target: dict[str, float], chunk: int, target_chunk: int | None = None, origin: int = 1) -> DataFrame:
    """Target chunks (ty, tx, h, w, pixels, covered): the source, bilinear, on the target's grid (ty, tx, h, w).

    A target chunk asks for the source chunks that its own pixels' places on the sky touch; of each, the part that it
    needs is shuffled to it, and numpy gathers from the parts. covered is 1 where all four neighbours with
    weight are there and aren't NaN; elsewhere the pixel is NaN. No pixel is a row.
    """
    side = target_chunk or chunk

    def places(ty: int, tx: int, h: int, w: int) -> tuple[np.ndarray, ...]:
        y, x = np.mgrid[ty * side : ty * side + h, tx * side : tx * side + w].astype(np.float64)
        sx, sy = (np.round(v, 9) for v in move_pixels(x, y, wcs_target, wcs_source, origin))
        return np.floor(sy), np.floor(sx), sy - np.floor(sy), sx - np.floor(sx)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow("ty int, tx int, h int, w int, sty int, stx int, y0 int, x0 int, y1 int, x1 int")
        for batch in batches:
            for ty, tx, h, w in zip(*(batch.column(c).to_pylist() for c in ("ty", "tx", "h", "w"))):
                y, x, fy, fx = places(ty, tx, h, w)
                box = [int(v) for v in (y.min(), x.min(), (y + (fy > 0)).max() + 1, (x + (fx > 0)).max() + 1)]
                cells = {(int(a), int(b)) for dy in (0, 1) for dx in (0, 1) for a, b in np.unique(np.stack([(y + dy).ravel() // chunk, (x + dx).ravel() // chunk], 1), axis=0)}
                yield from _table([(ty, tx, h, w, *c, *box) for c in sorted(cells)], schema).to_batches()

    piece = "ty int, tx int, h int, w int, y0 int, x0 int, ph int, pw int, pixels array<double>"

    def part(of: pa.Table, held: pa.Table) -> pa.Table:
        rows = []
        a = _array(held, 0) if held.num_rows else None
        for ty, tx, h, w, sty, stx, y0, x0, y1, x1 in zip(*(of.column(c).to_pylist() for c in ("ty", "tx", "h", "w", "sty", "stx", "y0", "x0", "y1", "x1"))):
            top, left = max(y0 - sty * chunk, 0), max(x0 - stx * chunk, 0)
            cut = np.zeros((0, 0)) if a is None else a[top : max(y1 - sty * chunk, 0), left : max(x1 - stx * chunk, 0)]
            rows.append((ty, tx, h, w, sty * chunk + top, stx * chunk + left, *cut.shape, cut.ravel()))  # an empty part keeps the target chunk in the result
        return _table(rows, _arrow(piece))

    out = "ty int, tx int, h int, w int, pixels array<double>, covered array<tinyint>"

    def gather(key: tuple, parts: pa.Table) -> pa.Table:
        ty, tx, h, w = (parts.column(c)[0].as_py() for c in ("ty", "tx", "h", "w"))
        y, x, fy, fx = places(ty, tx, h, w)
        top, left = int(y.min()), int(x.min())
        a = np.full((int(y.max()) + 2 - top, int(x.max()) + 2 - left), np.nan)
        for r in range(parts.num_rows):
            ph, pw = parts.column("ph")[r].as_py(), parts.column("pw")[r].as_py()
            if ph and pw:
                v = parts.column("pixels")[r].values.to_numpy(zero_copy_only=False).reshape(ph, pw)
                py, px = parts.column("y0")[r].as_py() - top, parts.column("x0")[r].as_py() - left
                a[py : py + ph, px : px + pw] = v[: a.shape[0] - py, : a.shape[1] - px]
        v = np.zeros((h, w))
        for dy in (0, 1):
            for dx in (0, 1):
                weight = (fy if dy else 1 - fy) * (fx if dx else 1 - fx)
                v += np.where(weight > 0, weight * a[(y - top).astype(int) + dy, (x - left).astype(int) + dx], 0)
        return _table([(ty, tx, h, w, v.ravel(), (~np.isnan(v)).astype(np.int8).ravel())], _arrow(out))

    parts = target.select("ty", "tx", "h", "w").mapInArrow(asked, "ty int, tx int, h int, w int, sty int, stx int, y0 int, x0 int, y1 int, x1 int")
    held = source.select(F.col("ty").alias("sty"), F.col("tx").alias("stx"), "h", "w", "pixels")
    return parts.groupBy("sty", "stx").cogroup(held.groupBy("sty", "stx")).applyInArrow(part, piece).groupBy("ty", "tx").applyInArrow(gather, out)


def footprint_chunks(reprojected: DataFrame) -> DataFrame:
    """Reprojected chunks with pixels 1 where they are covered and not zero, else 0."""
    lit = F.transform(F.arrays_zip(F.col("pixels").alias("v"), F.col("covered").alias("c")), lambda p: ((p["c"] == 1) & (p["v"] != 0)).cast("double"))
    return reprojected.withColumn("pixels", lit).drop("covered")
