"""Footprints, cutouts and filtered pairs as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SURVEYS = 8  # files that a task holds open; tiles of more surveys are sorted


def write_footprint(mask: DataFrame, path: str) -> None:
    """(y, x, valid) with valid as 0 or 1."""
    mask.select("y", "x", F.col("valid").cast("tinyint").alias("valid")).write.mode("overwrite").parquet(path)


def write_footprint_with_wcs(mask: DataFrame, wcs: Column, path: str) -> None:
    """The footprint, and beside it under {path}-wcs one row: the header of the low-resolution image."""
    write_footprint(mask, path)
    mask.sparkSession.range(1).select(wcs.alias("wcs")).select("wcs.*").write.mode("overwrite").parquet(f"{path}-wcs")


def read_footprint_wcs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}-wcs")


def read_footprint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("valid", F.col("valid") == 1)


def _write_by_survey(tiles: DataFrame, path: str) -> None:
    """A folder per survey, a file of each open at once in a task: few surveys need no sort of a task's tiles, which would hold them all."""
    name, conf = "spark.sql.maxConcurrentOutputFileWriters", tiles.sparkSession.conf
    before = conf.get(name)
    conf.set(name, SURVEYS)
    try:
        tiles.write.mode("overwrite").partitionBy("survey").parquet(path)
    finally:
        conf.set(name, before)


def write_cutout_pairs(cutouts: DataFrame, path: str) -> None:
    """Tiles of both surveys under the same idx, a folder per survey; existing ones are replaced."""
    _write_by_survey(cutouts, path)


def write_filtered(tiles: DataFrame, accepted: DataFrame, path: str, name: str = "name") -> None:
    """The accepted names' tiles of both surveys."""
    _write_by_survey(tiles.join(accepted.select(name), name, "left_semi"), path)
