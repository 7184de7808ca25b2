"""Whole texts: what lies far in, ends a sentence, or is long counts as well."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmeter.llm import neardup, pii, secrets, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def common():
    rnd = random.Random(12)
    return ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8))) for _ in range(400)]


def test_toxic_passages_past_a_prefix_train_the_model(spark, common):
    rnd = random.Random(13)
    bad = ["zzgrok", "vlurpy", "quxxit", "wozzle", "yimmer"]
    long = lambda: " ".join(rnd.choice(common) for _ in range(4500))
    texts = [long() + (" " + " ".join(rnd.choice(bad) for _ in range(40)) if i % 2 else "") for i in range(80)]
    assert all(len(t) > 20_000 for t in texts)
    df = docs_of(spark, texts)
    model = toxicity.fit(df, df.select("doc_id", (F.col("doc_id") % 2).alias("toxic")).where("doc_id < 60"))
    rows = {r["doc_id"]: r["score"] for r in toxicity.toxicity(df, model).where("doc_id >= 60").collect()}
    assert all((score >= 0.5) == (i % 2 == 1) for i, score in rows.items()), rows


def test_texts_that_share_a_prefix_stay_apart_and_copies_are_one(spark, common):
    import pickle

    rnd = random.Random(14)
    start = " ".join(rnd.choice(common) for _ in range(5000))
    df = docs_of(spark, [start + " one", start + " two", start + " three", start + " three"])
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    assert pickle.loads(toxicity.fit(df, labels))["share"] == pytest.approx(1 / 3)


def test_identifiers_before_punctuation_and_long_ones_are_masked(spark):
    known = [f"please contact staff{i}@mail.example for help" for i in range(30)]
    long = "EMP" + "x" * 80 + "7"
    ends = ["EMP-7001.", "EMP-7002- ok", "EMP-7003/", "EMP-7004...", f"{long}, ok", f"{long}.", "EMP.-7005", "a.b-1."]
    rows = {r["doc_id"]: r["spans"] for r in pii.pii_digests(docs_of(spark, known + [f"please contact {e}" for e in ends])).collect()}
    got = [rows[30 + i] for i in range(len(ends))]
    assert got == ["context:15:23"] * 4 + ["context:15:99"] * 2 + ["context:15:24", ""], got


def test_long_opaque_values_link(spark):
    values = ["Zk3vQ9xLm2Rt8WyB", "Zk3vQ9xLm2Rt8WyB" * 30, "k" * 100 + "Q7", "Kz" * 100 + "=9"]
    texts = [t for v in values for t in (f"https://api.example.com/v1 client_id: alpha-7 and {v}", f"client_id: alpha-7 and {v.lower()} end")]
    rows = {r["doc_id"]: r["spans"] for r in secrets.secret_digests(docs_of(spark, texts)).collect()}
    for i, v in enumerate(values):
        assert rows[2 * i] == f"endpoint:0:26,weak_id:27:45,weak_secret:50:{50 + len(v)}" and rows[2 * i + 1] == "", (v, rows)


def test_signature_scatters_by_two_different_permutations():
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(neardup._place(x))) == len(x) and (neardup._place(x) != neardup._scatter(x)).mean() > 0.99
