"""The pipeline's stages against plain versions of what each decides."""

import sys

import pytest
from pyspark.sql import functions as F

from quillmeter.llm import neardup, packing, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus_pipeline():
    sys.path.insert(0, "/root/repo")
    import corpus_pipeline

    return corpus_pipeline


def test_stages_decide_and_the_run_is_their_product(spark, corpus_pipeline):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).checkpoint()
        seen.append((name, docs, out))
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        docs = out
    _, before, clean = seen[0]
    assert 0.7 * before.count() < clean.count() <= before.count()
    model = toxicity.fit(before, toxicity.learnable(spark.read.parquet(f"{SF}/labels.parquet")))
    rejected = {r["doc_id"] for r in toxicity.toxicity(before, model).where("score >= 0.5").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in before.collect()} - rejected
    _, before, kept = seen[1]
    groups = neardup.near_duplicates(before, k=5)
    assert kept.count() == groups.select("component_id").distinct().count()
    _, before, masked = seen[2]
    assert masked.count() == before.count() and masked.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]")).count() == 0
    _, before, mixed = seen[3]
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    _, before, packed = seen[4]
    tokenizer = packing.public_tokenizer()
    want = sum(len(tokenizer.ids(r["text"] or "")) + 1 for r in before.select("text").collect())
    assert packed.agg(F.sum("length")).first()[0] == want
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_toxic_documents_go(spark, corpus_pipeline):
    """Of a larger table, with more labels to learn from, some documents go, and nearly all that are labelled clean stay."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id")
    gone = docs.join(kept, "doc_id", "left_anti").join(labels, "doc_id", "left")
    clean = labels.where("toxic = 0").count()
    assert 10 < gone.count() < 120 and gone.where("toxic = 0").count() <= 0.02 * clean
