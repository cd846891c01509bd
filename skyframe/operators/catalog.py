"""Catalogues of measured objects against their truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_catalog(measured: DataFrame, truth: DataFrame, key: str = "object_id") -> DataFrame:
    return measured.join(truth, key)


def relative_bias(measured: str, truth: str) -> Column:
    return F.try_divide(F.col(measured) - F.col(truth), F.col(truth))


def absolute_bias(measured: str, truth: str) -> Column:
    return F.col(measured) - F.col(truth)


def orientation_similarity(ux: str, uy: str, tx: str, ty: str) -> Column:
    """1 - |cos| of the angle between two directions; NULL for a zero vector."""
    dot = F.col(ux) * F.col(tx) + F.col(uy) * F.col(ty)
    norms = F.sqrt(F.col(ux) ** 2 + F.col(uy) ** 2) * F.sqrt(F.col(tx) ** 2 + F.col(ty) ** 2)
    return 1 - F.abs(F.try_divide(dot, norms))


def bias_summary(biases: DataFrame, by: list[str], bias: str = "bias", standard_error: bool = False) -> DataFrame:
    """mean_bias, spread (population deviation, or standard error) and n per group."""
    spread = F.stddev_pop(bias)
    if standard_error:
        spread = F.try_divide(F.stddev_samp(bias), F.sqrt(F.count(bias)))
    return biases.groupBy(*by).agg(F.avg(bias).alias("mean_bias"), spread.alias("spread"), F.count(bias).alias("n"))


def better_flag(summary: DataFrame, by: list[str], source: str = "source", bias: str = "mean_bias") -> DataFrame:
    """Per group the source of the smallest absolute bias; of equals, the first by name."""
    return summary.groupBy(*by).agg(F.min(F.struct(F.abs(bias).alias("b"), F.col(source).alias("s"))).alias("m")).select(*by, F.col("m.s").alias("better"))
