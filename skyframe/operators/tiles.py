"""Tiles as rows: (idx, h, w, pixels array<double>), row-major; and as pixels: (idx, y, x, v)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.arrays import gaussian_taps

BINS = 4096
FEW_VALUES = 100_000


def with_tile_columns(tiles: DataFrame, compute: Callable, schema: str, pixels: str = "pixels", h: str = "h", w: str = "w", together: bool = False) -> DataFrame:
    """tiles with the columns of `schema`, which compute makes of each tile as an (h, w) array; a column of that name is replaced.

    compute gives a tuple; with together, it gets the tiles of an Arrow batch as a list, and gives a list of tuples.

    Numpy works on the pixels of an Arrow batch in place; tiles aren't shuffled. A NULL tile, or one whose size isn't h * w, gets NULLs.
    """
    added = T.StructType.fromDDL(schema)
    kept = [c for c in tiles.columns if c not in added.fieldNames()]
    names = [c for c in tiles.columns]
    kinds = [f.dataType for f in added]

    def column(values: list, kind: T.DataType) -> pa.Array:
        if not isinstance(kind, T.ArrayType):
            return pa.array(values, {"double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[kind.simpleString()])
        inner = {"double": np.float64, "tinyint": np.int8, "float": np.float32, "int": np.int32}[kind.elementType.simpleString()]
        sizes = [0 if v is None else v.size for v in values]
        flat = np.concatenate([np.zeros(0, inner), *(np.asarray(v, inner).ravel() for v in values if v is not None)])
        offsets = pa.array(np.cumsum([0, *sizes], dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array([v is None for v in values]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(names.index(pixels))
            flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            found = []
            for i, (hh, ww) in enumerate(zip(batch.column(names.index(h)).to_pylist(), batch.column(names.index(w)).to_pylist())):
                whole = there[i] and hh is not None and ww is not None and starts[i + 1] - starts[i] == hh * ww > 0
                found.append(flat[starts[i] : starts[i + 1]].reshape(hh, ww) if whole else None)
            made = iter(compute([a for a in found if a is not None]) if together else (compute(a) for a in found if a is not None))
            rows = [(None,) * len(kinds) if a is None else next(made) for a in found]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), *(column(list(c), k) for c, k in zip(columns, kinds))], names=[*kept, *added.fieldNames()])

    return tiles.mapInArrow(run, T.StructType([*(tiles.schema[c] for c in kept), *added]))


def blurred(a: np.ndarray, taps: list[float], mode: str) -> np.ndarray:
    """Separable filter, a pass along rows, then one along columns; the boundary is repeated (nearest) or mirrored with its edge (symmetric)."""
    pad = {"nearest": "edge", "symmetric": "symmetric"}[mode]
    radius = len(taps) // 2
    for axis in (1, 0):
        wide = np.pad(a, [(radius, radius) if k == axis else (0, 0) for k in (0, 1)], pad)
        n = a.shape[axis]
        a = sum(t * (wide[:, i : i + n] if axis else wide[i : i + n]) for i, t in enumerate(taps))
    return a


def blur_tiles(tiles: DataFrame, sigma: float, mode: str = "symmetric", pixels: str = "pixels") -> DataFrame:
    """tiles with Gaussian-blurred pixels: functions.arrays.gaussian_blur for tiles of any size, in numpy."""
    taps = gaussian_taps(sigma)
    return with_tile_columns(tiles, lambda a: (blurred(a, taps, mode),), f"{pixels} array<double>", pixels)


def freq_split_tiles(tiles: DataFrame, sigma: float = 5.0, pixels: str = "pixels") -> DataFrame:
    """tiles with `low`, the blurred tile rescaled to the tile's range, and `high`, the rest over its largest absolute value.

    NaN where a constant blur can't be rescaled, or where nothing is left.
    """
    taps = gaussian_taps(sigma)

    def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = blurred(a, taps, "nearest")
        with np.errstate(invalid="ignore", divide="ignore"):
            low = a.min() + (b - b.min()) / (b.max() - b.min()) * (a.max() - a.min())
            high = a - low
            return low, high / np.abs(high).max()

    return with_tile_columns(tiles, split, "low array<double>, high array<double>", pixels)


def tile_quantiles(tiles: DataFrame, shares: list[float], pixels: str = "pixels") -> DataFrame:
    """tiles with `quantiles`, linearly interpolated at the given shares: by selection, without sorting a tile. NaNs where a tile holds one."""
    return with_tile_columns(tiles, lambda a: (np.quantile(a, shares),), "quantiles array<double>", pixels)


def explode_tiles(tiles: DataFrame, pixels: str = "pixels", w: str = "w", value: str = "v") -> DataFrame:
    """One row per pixel. For joins between tiles and mosaics; maths stays on arrays."""
    others = [c for c in tiles.columns if c not in (pixels, "h", "w")]
    flat = tiles.select(*others, w, F.posexplode(pixels).alias("__i", value))
    return flat.select(*others, F.floor(F.col("__i") / F.col(w)).cast("int").alias("y"), (F.col("__i") % F.col(w)).cast("int").alias("x"), value)


def assemble_tiles(pixels: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Rows of pixels back to tiles; h and w are the extent of what is there."""
    at = F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).alias("v"))))
    extent = lambda c: (F.max(c) - F.min(c) + 1).cast("int")
    return pixels.groupBy(*by).agg(extent("y").alias("h"), extent("x").alias("w"), F.transform(at, lambda p: p["v"]).alias("pixels"))


def dataset_stats(tiles: DataFrame, by: list[str], pixels: str = "pixels", exact: bool = True) -> DataFrame:
    """lowest, highest, median and population deviation over all finite pixels of a group, and n_bad, the number of NaN, infinite and NULL ones.

    A group without a finite pixel has NULLs.     Tiles are summed up one by one, so pixels are never rows. The exact median takes a few passes: each counts the
    pixels of a group in BINS bins of the range that holds its middle ones, until FEW_VALUES are left in it (or all are
    equal), which are then ordered. With exact=False, a bin's middle is given after one pass: off by at most the
    group's range over BINS.
    """

    def summary(a: np.ndarray) -> tuple:
        v = a[np.isfinite(a)]
        if not v.size:
            return 0, int(a.size), None, None, None, None
        return int(v.size), int(a.size - v.size), float(v.mean()), float(((v - v.mean()) ** 2).sum()), float(v.min()), float(v.max())

    each = with_tile_columns(tiles.select(*by, "h", "w", pixels), summary, "n bigint, bad bigint, mean double, m2 double, lo double, hi double", pixels).drop(pixels)
    n = F.sum("n")
    around = F.sum("m2") + F.sum(F.col("n") * F.col("mean") ** 2) - n * F.try_divide(F.sum(F.col("n") * F.col("mean")), n) ** 2
    whole = each.filter("n + bad > 0").groupBy(*by).agg(n.alias("n"), F.sum("bad").alias("n_bad"), F.min("lo").alias("lowest"), F.max("hi").alias("highest"), F.sqrt(F.try_divide(F.greatest(around, F.lit(0.0)), n)).alias("std"))
    middle = _medians(tiles.filter((F.size(pixels) > 0) & (F.size(pixels) == F.col("h") * F.col("w"))).select(*by, pixels), by, pixels, whole.filter("n > 0"), exact)
    on = [whole[c].eqNullSafe(middle[c]) for c in by]
    return whole.join(middle, on, "left").select(*(whole[c] for c in by), "lowest", "highest", "median", "std", "n_bad")


def _medians(tiles: DataFrame, by: list[str], pixels: str, whole: DataFrame, exact: bool) -> DataFrame:
    """(by, median). The driver holds a range per group, and BINS counts while it narrows it: groups are surveys or filters, few."""
    spark, kinds = tiles.sparkSession, [tiles.schema[c] for c in by]
    # (lo, hi, how many pixels are below lo, how many in the range)
    ranges = {tuple(r[c] for c in by): (r["lowest"], r["highest"], 0, r["n"]) for r in whole.collect()}
    totals = {k: v[3] for k, v in ranges.items()}

    def counted(open_: dict) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, np.ndarray] = {}
            for batch in batches:
                lists = batch.column(batch.num_columns - 1)
                flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(len(by))))):
                    if key in open_:
                        lo, hi, _, _ = open_[key]
                        v = flat[starts[i] : starts[i + 1]]
                        v = v[(v >= lo) & (v <= hi)]
                        held[key] = held.get(key, 0) + np.bincount(np.minimum(((v / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS).astype(np.int64), BINS - 1), minlength=BINS)
            for key, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(at), f) for x, f in zip(key, arrow)), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=[*by, "bin", "n"])

        arrow = [to_arrow_type(k.dataType) for k in kinds]
        return tiles.mapInArrow(run, T.StructType([*kinds, *T.StructType.fromDDL("bin int, n bigint")])).groupBy(*by, "bin").agg(F.sum("n").alias("n"))

    stuck = {}  # ranges of a few values each, with very many pixels
    while True:
        open_ = {k: r for k, r in ranges.items() if r[3] > FEW_VALUES and r[0] < r[1]}
        if not open_:
            break
        bins: dict[tuple, np.ndarray] = {k: np.zeros(BINS, np.int64) for k in open_}
        for r in counted(open_).collect():  # at most BINS rows a group
            bins[tuple(r[c] for c in by)][r["bin"]] = r["n"]
        for k, (lo, hi, below, _) in open_.items():
            reached = below + np.cumsum(bins[k])
            first, last = (int(np.searchsorted(reached, place, "right")) for place in ((totals[k] - 1) // 2, totals[k] // 2))
            step = hi / BINS - lo / BINS
            left = int(bins[k][first : last + 1].sum())
            # a little wider than the bins, for what rounding moves over their edges
            low, high = max(lo, float(np.nextafter(lo + first * step * (1 - 1e-12), -np.inf))), min(hi, float(np.nextafter(lo + (last + 1) * step * (1 + 1e-12), np.inf)))
            if not exact:
                ranges[k] = (low / 2 + high / 2, low / 2 + high / 2, 0, 0)
            elif (low, high) == (lo, hi):
                stuck[k], ranges[k] = (lo, hi, below), (lo, lo, 0, 0)
            else:
                ranges[k] = (low, high, None, left)
        again = [k for k, r in ranges.items() if r[2] is None]
        if again:
            for k, below in _below(tiles, by, pixels, {k: ranges[k][0] for k in again}).items():
                ranges[k] = (ranges[k][0], ranges[k][1], below, ranges[k][3])
    ranges |= {k: (m, m, 0, 0) for k, m in _counted_medians(tiles, by, pixels, stuck, totals).items()}
    bounds = spark.createDataFrame([(*k, r[0], r[1], r[2], totals[k]) for k, r in ranges.items()], T.StructType([*kinds, *T.StructType.fromDDL("lo double, hi double, below bigint, total bigint")]))
    inside = F.filter(pixels, lambda v: (v >= F.col("lo")) & (v <= F.col("hi")) & (F.col("lo") < F.col("hi")))
    left = tiles.join(F.broadcast(bounds), by).select(*by, F.explode(inside).alias("v")).groupBy(*by).agg(F.sort_array(F.collect_list("v")).alias("vs"))  # FEW_VALUES at most
    at = lambda place: F.get("vs", (place - F.col("below")).cast("int"))
    middle = (at(F.expr("(total - 1) div 2")) + at(F.expr("total div 2"))) / 2
    return bounds.join(left, by, "left").select(*by, F.coalesce(middle, F.col("lo")).alias("median"))


def _counted_medians(tiles: DataFrame, by: list[str], pixels: str, ranges: dict, totals: dict) -> dict:
    """Medians of groups by the counts of each value in a range (lo, hi, pixels below lo) that is too narrow to be cut: the values in it are few."""
    if not ranges:
        return {}
    known = tiles.sparkSession.createDataFrame([(*k, *r[:2]) for k, r in ranges.items()], T.StructType([*(tiles.schema[c] for c in by), *T.StructType.fromDDL("lo double, hi double")]))
    inside = tiles.join(F.broadcast(known), by).select(*by, F.explode(F.filter(pixels, lambda v: (v >= F.col("lo")) & (v <= F.col("hi")))).alias("v"))
    counts: dict[tuple, list] = {}
    for r in inside.groupBy(*by, "v").count().orderBy("v").collect():
        counts.setdefault(tuple(r[c] for c in by), []).append((r["v"], r["count"]))
    out = {}
    for k, found in counts.items():
        reached = ranges[k][2] + np.cumsum([n for _, n in found])
        out[k] = sum(found[int(np.searchsorted(reached, place, "right"))][0] for place in ((totals[k] - 1) // 2, totals[k] // 2)) / 2
    return out


def _below(tiles: DataFrame, by: list[str], pixels: str, limits: dict) -> dict:
    """How many pixels of each group are below its limit."""
    kinds = [tiles.schema[c] for c in by]
    known = tiles.sparkSession.createDataFrame([(*k, x) for k, x in limits.items()], T.StructType([*kinds, *T.StructType.fromDDL("limit double")]))
    each = tiles.join(F.broadcast(known), by).select(*by, F.size(F.filter(pixels, lambda v: (v < F.col("limit")) & (v > float("-inf")))).alias("n"))
    return {tuple(r[c] for c in by): r["n"] for r in each.groupBy(*by).agg(F.sum("n").alias("n")).collect()}


def chunked(pixels: DataFrame, chunk: int) -> DataFrame:
    """Rows of a dense mosaic's pixels (y, x, v) as chunks (ty, tx, h, w, pixels) of at most chunk by chunk pixels."""
    at = lambda c: F.floor(F.col(c) / chunk).cast("int").alias(f"t{c}")
    return assemble_tiles(pixels.select("y", "x", "v", at("y"), at("x")), ["ty", "tx"])


def with_dataset_stats(tiles: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Tiles with their group's statistics."""
    return tiles.join(stats, by)
