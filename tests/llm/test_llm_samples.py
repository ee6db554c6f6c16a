"""Bounded samples of labelled texts: a long text takes no place from the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from pocketlake.llm import quality_bayes


def test_even_share():
    assert quality_bayes.even_share([], 10) == 0
    assert quality_bayes.even_share([3, 4], 10) == 4
    assert quality_bayes.even_share([2, 100, 100], 20) == 9
    assert quality_bayes.even_share([50], 20) == 20


def test_long_text_displaces_none(spark):
    docs = spark.createDataFrame([(k, "é" * (1000 if k % 7 == 0 else 10)) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    sample = quality_bayes.bounded_labels(docs, labels, "doc_id", "text", "quality", 100, 900).collect()
    assert {r.key for r in sample} == set(range(60))
    sizes = {r.key: len(bytes(r.body).decode()) for r in sample}
    assert all(n == 10 for k, n in sizes.items() if k % 7) and {n for k, n in sizes.items() if k % 7 == 0} == {(900 - 510) // 9}
    whole = quality_bayes.bounded_labels(docs, labels, "doc_id", "text", "quality", 100, 100_000).collect()
    assert max(len(bytes(r.body).decode()) for r in whole) == 1000


def test_classifier_with_one_endless_text(spark, monkeypatch):
    monkeypatch.setattr(quality_bayes, "LABELLED_CHARS", 20_000)
    good, bad = "The river runs past the old mill, and people walk there. " * 3, "$$$ 111 ### WIN 999 " * 8
    rows = [(k, good if k % 2 else bad) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    # The text that comes first in the order of the hash has more characters than the whole sample may have.
    first = labels.orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id
    docs = spark.createDataFrame([(k, t * (400 if k == first else 1)) for k, t in rows], "doc_id long, text string")
    model = quality_bayes.learn(docs, labels)
    assert model(good.encode()) > 0.9 and model(bad.encode()) < 0.1
