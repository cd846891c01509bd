"""Pairing of surveys, predictions, masks and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_by_name(hr: DataFrame, lr: DataFrame, name: str = "name") -> DataFrame:
    return hr.join(lr, name, "inner")


def unpaired(hr: DataFrame, lr: DataFrame, name: str = "name") -> DataFrame:
    """High-resolution rows without a partner."""
    return hr.join(lr, name, "left_anti")


def pair_truth_pred(real: DataFrame, fake: DataFrame, key: str = "idx") -> DataFrame:
    """(key, real, fake) arrays; both sides have `pixels`."""
    return real.select(key, F.col("pixels").alias("real")).join(fake.select(key, F.col("pixels").alias("fake")), key)


def masked_pair(pairs: DataFrame, masks: DataFrame, key: str = "idx") -> DataFrame:
    """(key, real, fake, mask) arrays."""
    return pairs.join(masks.select(key, F.col("pixels").alias("mask")), key)


def residual(real: Column | str, fake: Column | str) -> Column:
    return F.zip_with(fake, real, lambda f, r: f - r)


def pair_val_batches(train_steps: DataFrame, val_batches: DataFrame, n_val: int, step: str = "ordinal") -> DataFrame:
    """Each training display step with the next validation batch, from the first again after the last.

    Both sides carry a dense ordinal from 0; n_val is the number of validation batches.
    """
    return train_steps.withColumn("val_ordinal", F.col(step) % n_val).join(val_batches.withColumnRenamed(step, "val_ordinal"), "val_ordinal")
