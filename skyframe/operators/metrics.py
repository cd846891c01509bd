"""Metric logs, run parameters and display panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import center_crop
from ..functions.stats import max_abs
from .pairs import residual


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append (run_id, step, split, metric, value) rows."""
    metrics.select("run_id", "step", "split", "metric", "value").write.mode("append").parquet(path)


def append_run_params(spark: SparkSession, run_id: str, params: dict[str, object], path: str) -> None:
    """Append one (run_id, key, value) row per parameter."""
    spark.createDataFrame([(run_id, k, str(v)) for k, v in params.items()], "run_id string, key string, value string").write.mode("append").parquet(path)


def params_wide(params: DataFrame, keys: list[str]) -> DataFrame:
    return params.groupBy("run_id").pivot("key", keys).agg(F.first("value"))


def metrics_wide(metrics: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """One row per group with the mean of each named metric; the names are given, so no job looks for them."""
    return metrics.groupBy(*by).pivot("metric", names).agg(F.avg("value"))


def train_val_gap(metrics: DataFrame, by: list[str]) -> DataFrame:
    """train, val and val - train per group."""
    side = lambda s: F.avg(F.when(F.col("split") == s, F.col("value")))
    return metrics.groupBy(*by).agg(side("train").alias("train"), side("val").alias("val")).withColumn("gap", F.col("val") - F.col("train"))


def figure_table(tiles: DataFrame, h: int, w: int, crop: int) -> DataFrame:
    """(idx, panel, pixels, vmin, vmax) of real, fake and residual panels, cropped to a centred square.

    Images are shown between -1 and 1, the residual between plus and minus its largest absolute value.
    """
    cropped = tiles.select("idx", center_crop("real", h, w, crop, crop).alias("real"), center_crop("fake", h, w, crop, crop).alias("fake"))
    cropped = cropped.withColumn("residual", residual("real", "fake")).withColumn("limit", max_abs("residual"))
    one = lambda name, lo, hi: F.struct(F.lit(name).alias("panel"), F.col(name).alias("pixels"), lo.alias("vmin"), hi.alias("vmax"))
    panels = F.array(one("real", F.lit(-1.0), F.lit(1.0)), one("fake", F.lit(-1.0), F.lit(1.0)), one("residual", -F.col("limit"), F.col("limit")))
    return cropped.select("idx", F.explode(panels).alias("p")).select("idx", "p.*")
