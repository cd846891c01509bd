"""Losses of image pairs. Aggregates are partial and final in one shuffle; pixels stay in arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import bce_with_logits

#: Weights of the generator's loss terms and its learning rate.
WEIGHTS = {"adv": 1.0, "recon": 200.0, "vgg": 1.0, "scat": 0.0, "seg": 200.0}
LEARNING_RATE = 1e-4


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def pair_sums(pairs: DataFrame, real: str = "real", fake: str = "fake", mask: str | None = None) -> DataFrame:
    """Per row: n, abs_sum, and with a mask masked_abs, masked_sq and mask_sum; then any grouping is a sum."""
    diff = F.zip_with(real, fake, lambda r, f: F.abs(r - f))
    out = pairs.withColumn("n", F.size(real).cast("bigint")).withColumn("abs_sum", _total(diff))
    if mask:
        masked = F.zip_with(diff, F.transform(mask, lambda m: m.cast("double")), lambda d, m: d * m)
        out = out.withColumn("masked_abs", _total(masked)).withColumn("masked_sq", _total(F.transform(masked, lambda v: v * v)))
        out = out.withColumn("mask_sum", _total(F.transform(mask, lambda m: m.cast("double"))))
    return out


def l1_loss() -> Column:
    return F.try_divide(F.sum("abs_sum"), F.sum("n"))


def masked_l1() -> Column:
    """NULL where no pixel is masked in."""
    return F.try_divide(F.sum("masked_abs"), F.sum("mask_sum"))


def masked_l2() -> Column:
    return F.try_divide(F.sum("masked_sq"), F.sum("mask_sum"))


def bce_mean(logits: DataFrame, target: float, by: list[str], pixels: str = "pixels", name: str = "bce") -> DataFrame:
    """Mean binary cross entropy of logit maps against 1 or 0."""
    each = logits.select(*by, _total(F.transform(pixels, lambda v: bce_with_logits(v, target))).alias("s"), F.size(pixels).alias("n"))
    return each.groupBy(*by).agg(F.try_divide(F.sum("s"), F.sum("n")).alias(name))


def disc_loss(logits: DataFrame, by: list[str], is_real: str = "is_real", pixels: str = "pixels") -> DataFrame:
    """BCE of real maps against 1 plus BCE of generated maps against 0, in one pass."""
    real = F.col(is_real)
    s = F.when(real, _total(F.transform(pixels, lambda v: bce_with_logits(v, 1.0)))).otherwise(_total(F.transform(pixels, lambda v: bce_with_logits(v, 0.0))))
    each = logits.select(*by, real.alias("real"), s.alias("s"), F.size(pixels).alias("n"))
    part = lambda cond: F.try_divide(F.sum(F.when(cond, F.col("s"))), F.sum(F.when(cond, F.col("n"))))
    return each.groupBy(*by).agg((part(F.col("real")) + part(~F.col("real"))).alias("disc_loss"))


def feature_mse(features: DataFrame, weights: DataFrame, a: str = "real", b: str = "fake") -> DataFrame:
    """One row: the weighted sum over levels of the mean squared difference of feature vectors (level, real, fake)."""
    squares = _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    each = features.select("level", squares.alias("s"), F.size(a).alias("n"))
    levels = each.groupBy("level").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mse"))
    return levels.join(weights, "level").agg(F.sum(F.col("mse") * F.col("weight")).alias("feature_mse"))


def coeff_distance(coefficients: DataFrame, a: str = "real", b: str = "fake") -> DataFrame:
    """One row: sums of absolute differences per image over all channels but 0, averaged over images."""
    each = coefficients.filter("channel > 0").select("idx", _total(F.zip_with(a, b, lambda x, y: F.abs(x - y))).alias("s"))
    return each.groupBy("idx").agg(F.sum("s").alias("s")).agg(F.avg("s").alias("coeff_distance"))


def composite_loss(terms: dict[str, Column], weights: dict[str, float] = WEIGHTS, rate: float = LEARNING_RATE) -> Column:
    """The learning rate times the weighted sum of the terms."""
    total = F.lit(0.0)
    for name, value in terms.items():
        total = total + value * weights[name]
    return total * rate


def validate(pairs: DataFrame, by: list[str], logits: dict[str, str] | None = None, features: str | None = None, coefficients: str | None = None, level_weights: dict[int, float] | None = None) -> DataFrame:
    """All component losses per group, of pairs with real, fake and mask, in one pass and one shuffle; no model is updated.

    Always l1, masked_l1, masked_l2 and loss_ratio. With logits, {"fake": column, "real": column} of the discriminator's
    maps: adv (fake against 1) and disc (real against 1 plus fake against 0). With features, an array of (level, real, fake)
    vectors: vgg, the weighted sum over levels of mean squared differences. With coefficients, an array of (channel,
    real, fake) maps: scat, the mean over pairs of the absolute differences in all channels but 0.
    """
    each, out = pair_sums(pairs, mask="mask"), {"l1": l1_loss(), "masked_l1": masked_l1(), "masked_l2": masked_l2()}
    mean = lambda s, n: F.try_divide(F.sum(s), F.sum(n))
    if logits:
        bce = lambda side, target: _total(F.transform(logits[side], lambda v: bce_with_logits(v, target)))
        each = each.withColumn("__f1", bce("fake", 1.0)).withColumn("__f0", bce("fake", 0.0)).withColumn("__r1", bce("real", 1.0)).withColumn("__fn", F.size(logits["fake"])).withColumn("__rn", F.size(logits["real"]))
        out |= {"adv": mean("__f1", "__fn"), "disc": mean("__r1", "__rn") + mean("__f0", "__fn")}
    if features:
        total = F.lit(0.0)
        for level, weight in sorted((level_weights or {}).items()):
            own = F.filter(features, lambda x: x["level"] == level)  # noqa: B023
            squares = F.aggregate(own, F.lit(0.0), lambda acc, x: acc + _total(F.zip_with(x["real"], x["fake"], lambda r, f: (r - f) * (r - f))))
            each = each.withColumn(f"__s{level}", squares).withColumn(f"__n{level}", F.aggregate(own, F.lit(0), lambda acc, x: acc + F.size(x["real"])))
            total = total + F.coalesce(mean(f"__s{level}", f"__n{level}"), F.lit(0.0)) * weight
        out["vgg"] = total
    if coefficients:
        each = each.withColumn("__c", F.aggregate(F.filter(coefficients, lambda x: x["channel"] > 0), F.lit(0.0), lambda acc, x: acc + _total(F.zip_with(x["real"], x["fake"], lambda r, f: F.abs(r - f)))))
        out["scat"] = F.avg("__c")
    return each.groupBy(*by).agg(*(c.alias(n) for n, c in out.items())).withColumn("loss_ratio", loss_ratio("masked_l1", "l1"))


def loss_ratio(masked: str, plain: str) -> Column:
    return F.try_divide(F.col(masked), F.col(plain))
