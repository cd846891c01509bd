"""Simple astronomical images (FITS primary or extension arrays): small ones by Spark's binaryFile source, surveys by byte ranges.

The subset: two axes, BITPIX 8, 16, 32, -32 or -64, BSCALE and BZERO. A file that can't be decoded is a row
with an error and NULL pixels, never an exception.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 2880
CARD = 80
#: Array types by BITPIX, big-endian.
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}
IMAGE = "name string, h int, w int, pixels array<float>, header map<string,string>, error string"
RANGE = "path string, name string, start long, width long, kind int, scale double, zero double, y0 int, y1 int, x0 int, x1 int, error string"
RANGE_BYTES = 32 << 20
TASK_BYTES = 8 << 20
GIVEN_BYTES = 1 << 20
MOST_TASKS = 100_000
TILE = "name string, ty int, tx int, h int, w int, pixels array<float>, error string"


def _header(data: bytes, at: int) -> tuple[dict[str, str], int]:
    cards: dict[str, str] = {}
    while True:
        block = data[at : at + BLOCK]
        if len(block) < BLOCK:
            raise ValueError("the header has no end")
        at += BLOCK
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD].decode("ascii")
            key = card[:8].strip()
            if key == "END":
                return cards, at
            if card[8:10] == "= ":
                value = card[10:].strip()
                cards[key] = value[1:].split("'")[0].strip() if value.startswith("'") else value.split("/")[0].strip()


def decode(data: bytes, hdu: int = 0) -> tuple[np.ndarray, dict[str, str]]:
    """The array (float32) and header cards of one header-data unit."""
    at = 0
    for k in range(hdu + 1):
        cards, at = _header(data, at)
        axes = [int(cards[f"NAXIS{i}"]) for i in range(1, int(cards.get("NAXIS", "0")) + 1)]
        bytes_each = abs(int(cards["BITPIX"])) // 8
        size = int(np.prod(axes)) * bytes_each if axes else 0
        if k < hdu:
            at += -(-size // BLOCK) * BLOCK
    if len(axes) != 2:
        raise ValueError(f"{len(axes)} axes, 2 are needed")
    if len(data) < at + size:
        raise ValueError("the data are cut short")
    raw = np.frombuffer(data, KINDS[int(cards["BITPIX"])], axes[0] * axes[1], at).reshape(axes[1], axes[0])
    scaled = raw.astype(np.float64) * float(cards.get("BSCALE", "1")) + float(cards.get("BZERO", "0"))
    return scaled.astype(np.float32), cards


def encode(pixels: np.ndarray, cards: dict[str, float] | None = None) -> bytes:
    """A primary array of 32-bit floats, for round trips."""
    h, w = pixels.shape
    lines = ["SIMPLE  =                    T", f"BITPIX  = {-32:>20}", f"NAXIS   = {2:>20}", f"NAXIS1  = {w:>20}", f"NAXIS2  = {h:>20}"]
    lines += [f"{k:<8}= {v:>20}" for k, v in (cards or {}).items()] + ["END"]
    head = "".join(x.ljust(CARD) for x in lines).encode("ascii")
    data = pixels.astype(">f4").tobytes()
    pad = lambda b, c: b + c * (-len(b) % BLOCK)
    return pad(head, b" ") + pad(data, b"\0")


def write_images(tiles: DataFrame, path: str) -> DataFrame:
    """Write a file {name}.fits per tile (name, h, w, pixels) under path, and return (name, bytes) of each.

    Tasks write to the file system that path's scheme names, through Arrow, under a name of their own first; a task that runs again writes the same files. The
    result is computed once, so that reading it doesn't write again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for r in batch.to_pylist():
                data = encode(np.asarray(r["pixels"], np.float32).reshape(r["h"], r["w"]))
                own = f"{folder}/.{r['name']}.{TaskContext.get().taskAttemptId()}"  # a twin of this task writes beside it
                with store.open_output_stream(own) as f:
                    f.write(data)
                store.move(own, f"{folder}/{r['name']}.fits")
                names.append(r["name"])
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    done = tiles.select(F.col("name").cast("string").alias("name"), "h", "w", "pixels").mapInArrow(run, "name string, bytes long")
    done.write.mode("overwrite").parquet(f"{path}-written")
    return tiles.sparkSession.read.parquet(f"{path}-written")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.fits").load(path)


def list_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of the image files under a path; contents aren't read."""
    return _files(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def read_images(spark: SparkSession, path: str, hdu: int = 0) -> DataFrame:
    """One row per file: name, h, w, pixels, header, error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["name"], batch["content"]):
                try:
                    a, cards = decode(bytes(content), hdu)
                    rows.append((name, a.shape[0], a.shape[1], a.ravel(), cards, None))
                except Exception as e:  # noqa: BLE001 - any bad file is quarantined
                    rows.append((name, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["name", "h", "w", "pixels", "header", "error"]).astype({"h": "Int32", "w": "Int32"})

    return _files(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInPandas(run, IMAGE)


def _read_header(read: Callable[[int, int], bytes], hdu: int) -> tuple[dict[str, str], int]:
    """The cards of a unit and where its data start; read(offset, size) gives bytes of the file. Data before it are skipped, not read."""
    at = 0
    for k in range(hdu + 1):
        head = b""
        while not any(head[i : i + 8].rstrip() == b"END" for i in range(max(0, len(head) - BLOCK), len(head), CARD)):
            block = read(at + len(head), BLOCK)
            if len(block) < BLOCK:
                raise ValueError("the header has no end")
            head += block
        cards, size = _header(head, 0)
        at += size
        if k < hdu:
            axes = [int(cards[f"NAXIS{i}"]) for i in range(1, int(cards.get("NAXIS", "0")) + 1)]
            at += -(-(math.prod(axes) * abs(int(cards["BITPIX"])) // 8 if axes else 0) // BLOCK) * BLOCK
    return cards, at


def plan_ranges(spark: SparkSession, path: str, hdu: int = 0, tile: int = 1024, range_bytes: int = RANGE_BYTES, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Byte ranges of survey images, from their headers alone: (path, name, start, width, kind, scale, zero, y0, y1, x0, x1, error).

    A range is tile rows, and as many tiles beside each other as make range_bytes (one at least). region (y0, y1, x0, x1) keeps the
    ranges that touch it. A file whose header can't be read, or that is too short for it, is one row with an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fits").load(path).select("path", "length")  # contents aren't read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RANGE.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[x.split()[1]] for x in RANGE.split(", ")]
        for batch in batches:
            for where, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name, rows = where.rsplit("/", 1)[-1], []
                try:
                    store, inside = pafs.FileSystem.from_uri(where)
                    with store.open_input_file(inside) as f:
                        cards, start = _read_header(lambda at, n: f.read_at(n, at), hdu)
                    if (axes := int(cards.get("NAXIS", "0"))) != 2:
                        raise ValueError(f"{axes} axes, 2 are needed")
                    w, h, kind = int(cards["NAXIS1"]), int(cards["NAXIS2"]), int(cards["BITPIX"])
                    each = abs(kind) // 8
                    if length < start + w * h * each:
                        raise ValueError("the data are cut short")
                    wide = max(1, range_bytes // (tile * tile * each)) * tile
                    for y in range(0, h, tile):
                        for x in range(0, w, wide):
                            y1, x1 = min(y + tile, h), min(x + wide, w)
                            if not region or y < region[1] and y1 > region[0] and x < region[3] and x1 > region[2]:
                                rows.append((where, name, start, w, kind, float(cards.get("BSCALE", "1")), float(cards.get("BZERO", "0")), y, y1, x, x1, None))
                except Exception as e:  # noqa: BLE001 - any bad file is a row
                    rows = [(where, name, *[None] * 9, f"{type(e).__name__}: {e}")]
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return files.mapInArrow(run, RANGE)


def read_mosaic(spark: SparkSession, path: str, hdu: int = 0, tile: int = 1024, range_bytes: int = RANGE_BYTES, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Survey images of any size as rows of at most tile by tile pixels: write them to Parquet once, and read that later.

    The headers give byte ranges (plan_ranges), which are dealt to a task for every TASK_BYTES, or range if that is more, and to four a core if there are ranges
    enough; each task seeks its rows in the files through the file system that a path's scheme names, file by file, and holds one range at a time (small ones
    are given on together). With region, only tiles that touch it are read.
    """
    planned = plan_ranges(spark, path, hdu, tile, range_bytes, region)
    total = _files(spark, path).agg(F.sum("length")).first()[0] or 0
    ranges, loads = -(-total // range_bytes), -(-total // max(TASK_BYTES, range_bytes))
    tasks = max(1, min(ranges, max(loads, 4 * spark.sparkContext.defaultParallelism), MOST_TASKS))
    schema = pa.schema([("name", pa.string()), *((c, pa.int32()) for c in ("ty", "tx", "h", "w")), ("pixels", pa.list_(pa.float32())), ("error", pa.string())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, at, f = [], 0, None, None
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["error"]:
                        rows.append((r["name"], *[None] * 5, r["error"]))
                        continue
                    if r["path"] != at:
                        if f:
                            f.close()
                        store, inside = pafs.FileSystem.from_uri(r["path"])
                        at, f = r["path"], store.open_input_file(inside)
                    h, w, dtype = r["y1"] - r["y0"], r["x1"] - r["x0"], np.dtype(KINDS[r["kind"]])
                    row = lambda y: r["start"] + (y * r["width"] + r["x0"]) * dtype.itemsize  # noqa: E731, B023
                    if w == r["width"]:
                        raw = f.read_at(h * w * dtype.itemsize, row(r["y0"]))
                    else:
                        raw = b"".join(f.read_at(w * dtype.itemsize, row(y)) for y in range(r["y0"], r["y1"]))
                    a = (np.frombuffer(raw, dtype).reshape(h, w).astype(np.float64) * r["scale"] + r["zero"]).astype(np.float32)
                    for x in range(0, w, tile):
                        part = a[:, x : x + tile]
                        if not region or r["x0"] + x < region[3] and r["x0"] + x + part.shape[1] > region[2]:
                            rows.append((r["name"], r["y0"] // tile, (r["x0"] + x) // tile, *part.shape, part.ravel(), None))
                            held += part.nbytes
                            if held >= GIVEN_BYTES:
                                yield batch_of(rows)
                                rows, held = [], 0
            if rows:
                yield batch_of(rows)
        finally:
            if f:
                f.close()

    return planned.repartition(tasks, "path", "y0", "x0").sortWithinPartitions("path", "y0", "x0").mapInArrow(run, TILE)


def mosaic_pixels(tiles: DataFrame, tile: int = 1024) -> DataFrame:
    """(name, y, x, v) of mosaics' tile rows."""
    flat = tiles.filter("error is null").select("name", "ty", "tx", "w", F.posexplode("pixels").alias("i", "v"))
    y = F.col("ty") * tile + F.floor(F.col("i") / F.col("w"))
    return flat.select("name", y.cast("int").alias("y"), (F.col("tx") * tile + F.col("i") % F.col("w")).cast("int").alias("x"), F.col("v").cast("double").alias("v"))
