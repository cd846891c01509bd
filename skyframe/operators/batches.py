"""Numbering, shuffling, splitting, augmenting and batching, reproducible and without one-task windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def stable_number(*parts: Column | str) -> Column:
    """A 32-bit number from the MD5 of the parts, the same in any engine."""
    text = F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def stable_long(*parts: Column | str) -> Column:
    """A number of 60 bits from the MD5 of the parts, the same in any engine."""
    text = F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _ranges(rows: DataFrame, order: list[str | Column], ranges: int) -> DataFrame:
    """rows in order, dealt to ranges of about equal size, with `__at`: range and place. Equal keys are told apart by a hash of the row, then by where it was read, and spread over ranges."""
    hashable = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()]
    held = rows.select("*", F.xxhash64(*hashable).alias("__h"), F.monotonically_increasing_id().alias("__m"))
    keys = [*order, "__h", "__m"]
    return held.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("__h", "__m").withColumn("__at", F.monotonically_increasing_id())


def number_rows(rows: DataFrame, order: list[str | Column], name: str = "ordinal", buckets: int | None = None) -> DataFrame:
    """Dense numbers from 0 in the given order, of columns of any ordered type, ascending unless they say otherwise.

    The rows are range-partitioned by the whole order and written once to the shared folder; a range's numbers start after the
    rows of the ranges before it. As many ranges as `buckets`, else as the session's shuffle partitions. Rows that are equal in the order come in an order of their own.
    """
    ranges = buckets or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    held = stored(_ranges(rows, order, ranges), "numbered")
    part = F.shiftright("__at", 33)
    counts = held.groupBy(part.cast("int").alias("__p")).count().orderBy("__p").collect()  # a row a range
    before = np.cumsum([0, *(r["count"] for r in counts)]).tolist()
    starts = rows.sparkSession.createDataFrame([(r["__p"], n) for r, n in zip(counts, before)], "__p int, __before bigint")
    return held.withColumn("__p", part.cast("int")).join(F.broadcast(starts), "__p").select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("__before") + F.col("__at") - F.shiftleft(part, 33)).alias(name))


def take(rows: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    """The first n of numbered rows."""
    return rows.filter(F.col(idx) < n)


def shuffled(rows: DataFrame, key: str, epoch: int, seed: int = 0) -> DataFrame:
    """Rows with their place in an epoch's random order, as a sort key: equal keys are broken by `key`."""
    return rows.withColumn("shuffle_key", stable_number(F.lit(seed), F.lit(epoch), key))


def epoch_shards(rows: DataFrame, key: str, epoch: int, shards: int, seed: int = 0) -> DataFrame:
    """Rows with `shard` and `place` (from 0) of an epoch: every row in one shard, shards of about equal size, each in a random order of its own.

    One shuffle deals the rows to as many tasks as shards; a reader takes the shards it is given, in order of place. Both hang on the seed, the
    epoch and the key alone, equal keys by the row's other columns. Write it partitioned by shard for a trainer that reads files.
    """
    hashable = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()]
    dealt = rows.withColumn("shard", (stable_number(F.lit(seed), F.lit(epoch), key) % shards).cast("int")).withColumn("__s", stable_long(F.lit(seed), F.lit(epoch), F.lit("place"), key)).withColumn("__h", F.xxhash64(*hashable))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("__s", key, "__h")) - 1
    return dealt.withColumn("place", place.cast("bigint")).drop("__s", "__h")


def train_val_split(rows: DataFrame, key: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """`split` = val or train by a hash of the key: both surveys of a pair are on the same side, always."""
    return rows.withColumn("split", F.when(stable_number(F.lit(seed), key) % 10_000 < round(share * 10_000), "val").otherwise("train"))


def flips(key: str, epoch: int, seed: int = 0) -> tuple[Column, Column]:
    """Whether to flip a pair vertically and horizontally in an epoch: two bits of one hash, each with chance one half."""
    bits = stable_number(F.lit(seed), F.lit(epoch), key)
    return bits % 2 == 1, F.floor(bits / 2) % 2 == 1


def batched(numbered: DataFrame, size: int, ordinal: str = "ordinal") -> DataFrame:
    """`batch_id` of numbered rows. Numbered before filtering, bad rows shrink their batch; numbered after, batches are refilled."""
    return numbered.withColumn("batch_id", F.floor(F.col(ordinal) / size).cast("bigint"))


def every_n(rows: DataFrame, n: int, step: str = "step", include_zero: bool = False) -> DataFrame:
    due = F.col(step) % n == 0
    return rows.filter(due if include_zero else due & (F.col(step) > 0))


def carry_last(rows: DataFrame, value: str, by: list[str], order: list[str], name: str = "carried", ranges: int | None = None) -> DataFrame:
    """The last non-null value so far in each run (`by`), NULL before the first.

    Runs are cut at the ranges of a range-partitioned table, which is written once, so a run of any length is several tasks' work: values are
    carried inside a range, and into it from the ranges before for the runs that reach over a boundary, two a range at most.
    """
    held = stored(_ranges(rows, [*by, *order], ranges or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)), "carried")
    held = held.withColumn("__p", F.shiftright("__at", 33).cast("int"))
    so_far = Window.partitionBy("__p", *by).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    ends = held.groupBy("__p", *by).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__at"))).alias("__last"))
    run = Window.partitionBy(*by)
    over = ends.withColumn("__n", F.count("*").over(run)).filter("__n > 1")
    before = over.select("__p", *by, F.last("__last", ignorenulls=True).over(run.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__in"))
    before = before.select(F.col("__p").alias("__q"), *(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), "__in")
    same = F.col("__p") == F.col("__q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    inside = held.withColumn("__own", F.last(value, ignorenulls=True).over(so_far))
    return inside.join(F.broadcast(before), same, "left").select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce("__own", "__in").alias(name))
