"""The whole pipeline against brute-force versions of what its stages must keep."""

from pyspark.sql import functions as F

import corpus_pipeline
from skyframe.llm.tables import written
from tests.llm import brute

D = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "minhash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]
    seen = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, D), "stage")
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality rules":
            failed = {d for d, t in seen.items() if (c := brute.base_quality(t))[0] < 20 or 100 * c[4] > 30 * c[0]}
            assert not failed & now.keys()
        if name == "minhash near-dedup":
            want = brute.near_duplicates(list(seen.items()), 5)
            assert now.keys() == {d for d, (_, c) in want.items() if c == d}
        if name == "secret scans":
            assert now.keys() == seen.keys()
            assert all(not brute.base_secrets(t) for t in now.values())
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        seen = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
    assert {r.doc_id for r in packed} == seen.keys()


def test_pipeline_of_no_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, D), "stage")
    assert docs.count() == 0


def test_stages_with_odd_rows_and_clashing_columns(spark):
    """Null, repeated and clashing ids, null and very long texts, and columns named like the stages' own pass through every stage."""
    docs = spark.read.parquet(f"{D}/documents.parquet").filter("doc_id < 60")
    some = docs.filter("length(text) > 200").limit(3)
    odd = [docs, docs.limit(2), some.withColumn("doc_id", F.lit(None).cast("bigint")), some.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")), docs.limit(1).withColumn("text", F.lit(None).cast("string"))]
    odd.append(some.limit(1).withColumn("doc_id", F.lit(900).cast("bigint")).withColumn("text", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("Wort"), F.md5(i.cast("string")))))))
    docs = odd[0]
    for more in odd[1:]:
        docs = docs.unionByName(more)
    for name in ("row", "out", "id", "__id", "f1", "n", "label", "h", "kept", "Label", "my col"):
        if name.lower() not in (c.lower() for c in docs.columns):
            docs = docs.withColumn(name, F.lit(name))
    docs = written(docs, "odd")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = written(stage(spark, docs, D), "stage")
        rows = docs.collect()
        assert docs.columns == columns and {r.doc_id for r in rows} <= before
        assert all(r["row"] == "row" and r["my col"] == "my col" for r in rows)
        if name == "minhash near-dedup":
            ids = [r.doc_id for r in rows if r.doc_id is not None]
            assert len(ids) == len(set(ids))
            texts = [r.text for r in rows]
            assert len(texts) == len(set(texts))
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()} == {r.doc_id for r in docs.collect()}
