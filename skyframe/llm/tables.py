"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import clear_intermediates, new_path, shared_folder  # noqa: F401

BATCH_ROWS = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
# A join whose key holds a large share of the rows is split over tasks while it runs, whatever follows it.
SPLIT_HOT_KEYS = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.forceOptimizeSkewedJoin": "true", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings while a job runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most that many rows while a job runs, so that a task's memory hangs less on the length of texts."""
    with settings(spark, {BATCH_CONF: spark.conf.get(BATCH_CONF)}):
        bound_batches(spark, rows)
        yield


def bound_batches(spark: SparkSession, rows: int | None = None) -> None:
    """Lower the session's bound on rows in an Arrow batch, for frames that run after their query has returned."""
    rows, now = rows or BATCH_ROWS, int(spark.conf.get(BATCH_CONF))
    if now <= 0 or now > rows:
        spark.conf.set(BATCH_CONF, rows)


def written(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, so a lost executor costs only a read."""
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession, batch_rows), settings(df.sparkSession, SPLIT_HOT_KEYS):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def with_columns_from_text(docs: DataFrame, text_col: str, schema: str, compute) -> DataFrame:
    """Columns `row` (a struct of docs' columns, untouched) and `out` (a struct of `schema`).

    compute takes the texts of an Arrow batch (None where null) and returns the columns of `schema` as
    Arrow arrays. As docs' columns stay inside `row`, their names can't clash with those of `schema`.
    """
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    place = [c.lower() for c in docs.columns].index(text_col.lower())
    out = T.StructType.fromDDL(schema)
    names = out.fieldNames()

    def run(batches):
        for batch in batches:
            columns = compute(batch.column(0).field(place).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(columns, names)], names=["row", "out"])

    return held.mapInArrow(run, T.StructType([held.schema["row"], T.StructField("out", out)]))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, label, text) of at most `rows` labelled ids, those of the smallest hashes, one row each.

    Null ids, labels other than 0 and 1, and null texts are left out. Of an id with both labels the smaller counts, of
    an id with several texts that of the smallest hash.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    sample = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    return texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
