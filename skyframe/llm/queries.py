"""The queries of this subpackage: one per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.shipping import ship
from . import counts, decontam, licenses, lm, merkle, minhash, packing, pii, quality, secrets, sql, toxicity, trie, warc
from .tables import bound_batches, documents


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select("row.doc_id", "out.*")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir).select("doc_id", "text")).select("row.doc_id", "out.n_email", "out.n_ip", "out.n_card", "out.n_phone", "out.base_sha256", "out.spans")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), size=2)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("row.doc_id", toxicity.held_out("row.doc_id").alias("held_out"), "out.*")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = secrets.scan_secrets(docs, secrets.fit(docs))
    return found.select("row.doc_id", "out.n_assign", "out.n_access", "out.n_hex", "out.base_sha256", "out.spans")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir).select("doc_id", "text")).select("row.doc_id", "out.*")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.train_and_score(documents(spark, sf_dir).select("doc_id", "text")).select("row.doc_id", "out.*")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), vocabulary())


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(trie.sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir), other_leaf=merkle.lowered_leaf())


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(f) for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    """What SQL can express: not the fitted models, the packing, the template matches and the tokens."""
    return {"op2_personal_data": sql.OP2, "op3_minhash_near_dedup": sql.OP3, "op4_warc": sql.OP4, "op12_prefix_trie": sql.OP12, "op13_merkle_manifest": sql.OP13}
