"""Places of rows in a global order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

PART_SHIFT = 33  # of monotonically_increasing_id: the partition stands above it


def range_sorted(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df in the written order, with `part` (its range) and `at` (the row's place in it, from 0).

    Ranges hold about as many rows each. Equal keys share a range, so the last key should tell rows apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", PART_SHIFT)
    return written(placed.select(*df.columns, part.cast("int").alias("part"), (F.col("at") - F.shiftleft(part, PART_SHIFT)).alias("at")), name)


def running(sorted_rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Sums of `values` over all rows before each row of range_sorted. Totals of the ranges go to all tasks, a row a range."""
    spark = sorted_rows.sparkSession
    totals = sorted_rows.groupBy("part").agg(*(F.sum(v).alias(k) for k, v in values.items())).orderBy("part").collect()  # a row a range
    before, sums = [], dict.fromkeys(values, 0)
    for r in totals:
        before.append((r["part"], *sums.values()))
        sums = {k: sums[k] + r[k] for k in sums}
    starts = spark.createDataFrame(before, "part int, " + ", ".join(f"`{k}_before` long" for k in values))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    out = sorted_rows.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(k) for k, v in values.items())).join(F.broadcast(starts), "part")
    return out.select(*sorted_rows.columns, *((F.col(k) + F.col(f"{k}_before")).alias(k) for k in values))


def numbered(df: DataFrame, order: list[str | Column], name: str, number: str) -> DataFrame:
    """range_sorted with `number`, the row's place in the whole order from 0."""
    rows = range_sorted(df, order, name)
    counts = rows.groupBy("part").count().orderBy("part").collect()  # a row a range
    before, total = [], 0
    for r in counts:
        before.append((r["part"], total))
        total += r["count"]
    starts = df.sparkSession.createDataFrame(before, "part int, before long")
    return rows.join(F.broadcast(starts), "part").select(*df.columns, "part", "at", (F.col("before") + F.col("at")).alias(number))
