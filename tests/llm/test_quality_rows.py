"""The quality classifier learns from every labelled row."""

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import bradley_terry


def test_every_row_counts(spark):
    n = 2_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.repeat(F.lit("#*! "), (F.col("id") % 50 + 2).cast("int"))).otherwise(
        F.repeat(F.lit("the word of a text. "), (F.col("id") % 50 + 2).cast("int"))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    rows = docs.join(labels, "doc_id").collect()
    x = np.stack([bradley_terry.features(r["text"]) for r in rows])
    several = bradley_terry.train(docs, labels, group_rows=900)
    assert np.allclose(several.mean, x.mean(0, dtype=np.float64), atol=1e-4)
    raw = several.raw(x)
    assert abs(several.threshold - np.quantile(raw, 0.25, method="midpoint")) < 1e-3
    assert min(s for s, r in zip(raw, rows) if r["quality"]) > max(s for s, r in zip(raw, rows) if not r["quality"])
    alone = bradley_terry.train(docs.where('doc_id < 5'), labels, group_rows=1)
    assert np.isfinite(alone.weights).all() and np.isfinite(alone.threshold)
    again = bradley_terry.train(docs.repartition(7), labels, group_rows=900)
    assert np.array_equal(again.weights, several.weights) and again.threshold == several.threshold


def test_order_of_bits():
    x = np.array([-3.5, -1e-30, 0.0, 1e-30, 2.0, 1e9], np.float32)
    bits = bradley_terry._to_bits(x)
    assert (np.diff(bits) > 0).all() and np.array_equal(bradley_terry._from_bits(bits), x)


def test_labels_grow_with_the_documents(spark, monkeypatch):
    """The join of texts and labels is shuffled at every size, so that its disk grows as the input does."""
    plans, keep = [], bradley_terry.durable
    monkeypatch.setattr(bradley_terry, "durable", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df))[1])
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), (F.col("id") + 1).cast("int")).alias("text"))
    bradley_terry.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
