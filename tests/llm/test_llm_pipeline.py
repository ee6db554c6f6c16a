"""The corpus pipeline stage by stage against plain versions of its decisions."""

from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline
from pocketlake.llm import langid, quality_bayes

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not there")


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def test_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    columns = docs.columns
    accepted = {r.doc_id for r in langid.predict(docs, langid.learn(docs)).filter("accepted").collect()}
    first = corpus_pipeline.language(spark, docs, SMALL)
    assert first.columns == columns and {r.doc_id for r in first.collect()} == accepted
    good = {r.doc_id for r in quality_bayes.judge(first, labels).filter("kept").collect()}
    second = corpus_pipeline.quality(spark, first, SMALL)
    assert second.columns == columns and {r.doc_id for r in second.collect()} == good
    sets = {r.doc_id: plain_set(r.text) for r in second.collect()}
    least = {}
    for a in sorted(sets):
        group, grown = {a}, True
        while grown:
            near = {b for b in sets if any(alike(sets[b], sets[c]) for c in group)}
            grown, group = near != group, near
        least[a] = min(group)
    assert len(set(least.values())) < len(least)
    third = corpus_pipeline.near_dedup(spark, second, SMALL)
    assert third.columns == columns and {r.doc_id for r in third.collect()} == set(least.values())
    packed = corpus_pipeline.pack(spark, third, SMALL)
    assert {r.doc_id for r in packed.collect()} == set(least.values())
    run = corpus_pipeline.run(spark, SMALL)
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(pieces).collect())) == sorted(map(tuple, packed.select(pieces).collect()))


def test_stages_on_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, label string, fp string, kept string"
    rows = [(None, None), (1, ""), (2, "word " * 60), (2, "word " * 60), (3, None), (None, "word " * 60)]
    docs = spark.createDataFrame([(k, t, None, None, 1, "a", "b", "c") for k, t in rows], schema)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:3]:
            assert stage(spark, frame, SMALL).columns == docs.columns
            stage(spark, frame, SMALL).count()
        corpus_pipeline.STAGES[3][1](spark, frame, SMALL).count()
    kept = corpus_pipeline.near_dedup(spark, docs, SMALL).collect()
    # One text of words and one of none: the least key of each stays, once.
    assert sorted(r.doc_id for r in kept) == [1, 2]


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
