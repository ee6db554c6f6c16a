"""Toxicity is learned from all labelled texts: counts, descent over shards and thresholds against plain versions."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from pocketlake.llm import toxicity

LETTERS = "abcdefghij"


def out(key):
    return zlib.crc32(str(key).encode()) % 5 == 0


def word(n):
    return "w" + "".join(LETTERS[int(c)] for c in str(n))


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(4)
    found = []
    for k in range(16_000):
        words = [word(x) for x in random.integers(0, 400, 3)] + ["vile"] * (k % 2)
        found.append((k, " ".join(words), "en" if k % 3 else "de", k % 2))
    return found


def frames(spark, rows):
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")


def test_leanings_count_every_labelled_text(spark, monkeypatch, rows):
    """6,400 toxic texts and as many others; neither are left out, and however they are dealt to shards the counts are the same."""
    monkeypatch.setattr(toxicity, "EPOCHS", 0)
    monkeypatch.setattr(toxicity, "SHARD_TEXTS", 3_000)
    network = toxicity.learn(*frames(spark, rows))
    known = [r for r in rows if not out(r[0])]
    seen, toxic, share = np.zeros(toxicity.BUCKETS + 1), np.zeros(toxicity.BUCKETS + 1), np.mean([r[3] for r in known])
    for _, text, _, label in known:
        own = np.unique(toxicity.buckets(toxicity.word_codes(text.encode(), toxicity._Codes()))[0])
        seen[own] += 1
        toxic[own] += label
    z = np.clip((toxic - seen * share) / np.sqrt(seen * share * (1 - share) + 1), -6, 12) / 6
    z[toxicity.BUCKETS] = 0
    assert np.allclose(network.tables[0][:, 0], z, atol=1e-12)


def test_descent_over_shards(spark, monkeypatch, rows):
    """Shards by the dozen give a network that tells held-out texts apart, the same one each time."""
    monkeypatch.setattr(toxicity, "SHARD_TEXTS", 200)
    some = rows[:3000]
    docs, labels = frames(spark, some)
    found = [sorted((r.doc_id, r.predicted, r.score) for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()) for _ in range(2)]
    assert found[0] == found[1]
    held = [(p, some[k][3]) for k, p, _ in found[0] if out(k)]
    assert np.mean([p == y for p, y in held]) >= 0.97


def test_thresholds_as_in_one_place(spark):
    random = np.random.default_rng(8)
    rows = [(g, float(random.integers(-20, 20)) / 4, float(random.random() < 0.3)) for g in (-2, 0, 1) for _ in range(500)] + [(2, 0.5, 0.0), (3, -1.0, 1.0)]
    found = toxicity.best_thresholds(spark.createDataFrame(rows, "guess int, logit double, label double"))
    for guess in (-2, 0, 1, 2, 3):
        own = np.array([r[1:] for r in rows if r[0] == guess])
        assert found[guess] == (toxicity.best_threshold(own[:, 0], own[:, 1]), own[:, 1].sum())
