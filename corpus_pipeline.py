"""The training-data pipeline: documents through five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last keep documents' columns.
What a stage removes or masks is gone for the next. Stages act on what they get alone: empty documents
give an empty result, and columns beyond documents' own pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import decontam, minhash, packing, quality, secrets
from skyframe.llm.queries import vocabulary
from skyframe.llm.tables import bound_batches, documents, written
from skyframe.plans.shipping import ship


def prepare(spark: SparkSession) -> None:
    """Code on the executors, and Arrow batches that fit beside long texts."""
    ship(spark)
    bound_batches(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the model keep."""
    prepare(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).filter("out.kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 on five-word shingles: that of the smallest id."""
    prepare(spark)
    return minhash.deduplicated(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    prepare(spark)
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; n_chars follows the text where it changed."""
    prepare(spark)
    found = secrets.scan_secrets(docs, secrets.fit(docs))
    row = F.col("row")
    masked = row.withField("text", F.col("out.redacted"))
    if "n_chars" in docs.columns:
        masked = masked.withField("n_chars", F.length("out.redacted").cast(docs.schema["n_chars"].dataType))
    return found.select(F.when(F.col("out.redacted").isNotNull(), masked).otherwise(row).alias("row")).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    prepare(spark)
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]
ORACLE_SQL = None  # the models of the first and fourth stages can't be expressed in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
