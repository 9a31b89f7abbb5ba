import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomespark.llm import quality

WORDS = "and the of them read station handle with which over table before column were into after".split()


def text(rng, good, n=None):
    words = [rng.choice(WORDS) for _ in range(n or rng.randint(20, 200))]
    if good:
        return " ".join(words).capitalize() + "."
    return rng.choice([" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join(w + "###" for w in words)])


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    truth = {i: int(rng.random() < 0.8) for i in range(1200)}
    rows = [(i, text(rng, y), 0.5, 1) for i, y in truth.items()]
    rows += [(None, text(rng, 1), 0.1, 1), (5000, None, 0.1, 1), (5001, "", 0.1, 1), (5002, "x " * 100_000, 0.1, 1), (0, rows[0][1], 0.1, 1)]
    labels = [(i, y, "x") for i, y in truth.items() if rng.random() < 0.5] + [(1, None, "x"), (None, 1, "x"), (7, truth[7], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, quality int").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, text string"), truth


def test_held_out_accuracy(tables):
    docs, labels, truth = tables
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == 1205
    import zlib

    right = held = 0
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["held_out"] and r["doc_id"] in truth:
            held += 1
            right += truth[r["doc_id"]] == r["predicted"]
    assert held > 150 and right / held > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["predicted"] for r in rows)


def test_held_out_labels_and_other_columns_change_nothing(tables):
    docs, labels, _ = tables
    one = quality.train(docs, labels)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    two = quality.train(docs.withColumn("score", F.rand()), flipped)
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_no_labels_and_empty_tables(tables):
    docs, labels, _ = tables
    assert {r["score"] for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality.score_documents(docs.limit(0), labels).count() == 0


def test_query_returns_the_contract_columns(spark, tables, tmp_path):
    import zlib

    docs, labels, _ = tables
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = quality.op4_quality(spark, str(tmp_path)).select("doc_id", "held_out", "score", "predicted").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_sums_over_all_rows_equal_plain_ones(spark, tables):
    docs, labels, _ = tables
    model = quality.train(docs, labels)
    texts = [t or "" for (t,) in docs.select("text").collect()]
    rows = spark.createDataFrame([(i % 3 == 0, t) for i, t in enumerate(texts)], "p boolean, text string").repartition(5)
    got = quality.whole_sums(rows, model)
    x = ((quality.features([t.encode() for t in texts]) - model.mean) / model.scale).astype(np.float32)
    want = quality.sums(x[::3], x, model.weights.astype(np.float32), model.bias)
    assert (got.n_p, got.n_u) == (want.n_p, want.n_u) and np.allclose(got.packed(), want.packed(), rtol=1e-4, atol=1e-2)
