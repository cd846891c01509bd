"""Stand-ins for survey data, made from the driver's tables: see FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import bound, decimate, resize_nearest
from ..functions.stats import spread
from ..functions.wcs import header
from ..sources.shared import new_path as scratch  # noqa: F401

SIDE = 8
STEP_LR = 0.168 / 3600
STEP_HR = 0.084 / 3600
WINDOW = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 by 8 tiles (idx, label, h, w, pixels)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), "label", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), F.transform("embedding", lambda v: v.cast("double")).alias("pixels"))


def low_tiles(t: DataFrame) -> DataFrame:
    return t.select("idx", "label", F.lit(4).alias("h"), F.lit(4).alias("w"), decimate("pixels", SIDE, SIDE, 2).alias("pixels"))


def pred_tiles(t: DataFrame) -> DataFrame:
    return low_tiles(t).select("idx", "label", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), resize_nearest("pixels", 4, 4, SIDE, SIDE).alias("pixels"))


def masks(t: DataFrame) -> DataFrame:
    return t.select("idx", bound(spread("pixels") * 1.5, lambda s: F.transform("pixels", lambda v: (v > s).cast("tinyint"))).alias("pixels"))


def pairs(t: DataFrame) -> DataFrame:
    """(idx, label, real, fake, mask)."""
    real = t.select("idx", "label", F.col("pixels").alias("real"))
    return real.join(pred_tiles(t).select("idx", F.col("pixels").alias("fake")), "idx").join(masks(t).select("idx", F.col("pixels").alias("mask")), "idx")


def mosaic_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.expr("int(o_orderkey div 100)").alias("y"), (F.col("o_orderkey") % 100).cast("int").alias("x"), F.col("o_totalprice").alias("v"))


def mosaic_hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    y = F.expr("int(2 * (l_orderkey div 100) + (l_linenumber - 1) % 4 div 2)")
    x = F.expr("int(2 * (l_orderkey % 100) + (l_linenumber - 1) % 2)")
    return li.groupBy(y.alias("y"), x.alias("x")).agg(F.sum("l_extendedprice").alias("v"))


def mask_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, valid): low-resolution pixels with any high-resolution one that isn't zero."""
    lit = mosaic_hr(spark, sf_dir).filter("v != 0").select(F.expr("int(y div 2)").alias("y"), F.expr("int(x div 2)").alias("x")).distinct().withColumn("valid", F.lit(True))
    return mosaic_lr(spark, sf_dir).select("y", "x").join(lit, ["y", "x"], "left").select("y", "x", F.coalesce("valid", F.lit(False)).alias("valid"))


WCS_LR = {"crpix1": 50.5, "crpix2": 75.5, "crval1": 150.1, "crval2": 2.2, "cd11": -STEP_LR, "cd12": 0.0, "cd21": 0.0, "cd22": STEP_LR}
WCS_HR = WCS_LR | {"crpix1": 100.5, "crpix2": 150.5, "cd11": -STEP_HR, "cd22": STEP_HR}


def wcs_lr() -> Column:
    return header(**WCS_LR)


def wcs_hr() -> Column:
    return header(**WCS_HR)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, step, split, metric, value, ts)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("run").alias("run_id"), F.col("event_id").alias("step"), F.when(F.col("user_id") % 5 == 0, "val").otherwise("train").alias("split"), F.col("event_type").alias("metric"), "value", "ts")


def catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Measurements (object_id, source, mode, measured) and truth (object_id, truth)."""
    li = table(spark, sf_dir, "lineitem")
    m = li.groupBy(F.col("l_partkey").alias("object_id"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("mode")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("measured"))
    return m, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"), F.col("p_retailprice").alias("truth"))
