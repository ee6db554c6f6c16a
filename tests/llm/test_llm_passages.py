"""Repeated passages against brute force, and the parts of the suffix trees."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from pocketlake.llm import substring_dedup as dedup


def plain(rows, window):
    """key and text of rows -> sorted (key, n_words, n_removed, kept_sha256)."""
    split = [(k, (t or "").encode().split()) for k, t in rows]
    order = [dedup.NO_KEY if k is None else k for k, _ in split]
    least = {}
    for key, (_, words) in zip(order, split, strict=True):
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            least[w] = min(least.get(w, key), key)
    out = []
    for key, (k, words) in zip(order, split, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i : i + window])] < key:
                gone |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((k, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def drawn(seed, documents, vocabulary=400):
    random = np.random.default_rng(seed)
    word = lambda: f"w{random.integers(vocabulary)}"
    passages = [[word() for _ in range(random.integers(5, 60))] for _ in range(8)]
    rows = []
    for key in range(documents):
        words = []
        for _ in range(random.integers(0, 6)):
            words += passages[random.integers(8)] if random.random() < 0.4 else [word() for _ in range(random.integers(1, 30))]
        rows.append((key, ("\n" if random.random() < 0.3 else " ").join(words)))
    rows += [(int(random.integers(documents)), rows[int(random.integers(documents))][1]) for _ in range(documents // 5)]
    return rows


@pytest.mark.parametrize("window,vocabulary", [(13, 400), (3, 12), (8, 2), (17, 30)])
def test_removals_against_brute_force(spark, monkeypatch, window, vocabulary):
    monkeypatch.setattr(dedup, "WORDS_AT_ONCE", 300)
    rows = drawn(window, 150, vocabulary)
    found = dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window=window)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows, window)


def test_spans_and_texts(spark):
    a = [f"a{i}" for i in range(20)]
    rows = [(1, " ".join(a)), (2, " ".join(["x", *a[:14], "y", "z", *a[5:20]]))]
    found = {r.doc_id: r for r in dedup.remove_repeats(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert found[1].kept == rows[0][1] and found[1].removed == []
    assert found[2].kept == "x y z" and [tuple(s) for s in found[2].removed] == [(1, 15), (17, 32)]


def test_odd_rows(spark):
    long = " ".join(f"v{i % 7000}" for i in range(60_000))
    passage = " ".join("abcdefghijklmnop")
    rows = [(None, passage), (None, passage), (5, passage), (5, passage), (7, None), (8, ""), (9, " \t "), (10, long), (11, long), (12, "short"), (-3, passage + " end")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS key", "text AS kept", "1 AS marks", "2 AS removed", "3 AS n_words")
    assert sorted(map(tuple, dedup.digests(table).collect()), key=str) == plain(rows, 13)
    assert dedup.digests(table.limit(0)).count() == 0
    with pytest.raises(TypeError):
        dedup.digests(table, key="text")


def test_plan_splits_frequent_prefixes():
    random = np.random.default_rng(2)
    hot = np.full(5000, 0x0102030405060708, np.uint64)
    front = np.concatenate((random.integers(0, 1 << 63, 5000, np.uint64), hot, (random.integers(0, 1 << 20, 5000, np.uint64) | np.uint64(0x7F << 56))))
    certain = random.integers(0, 1 << 63, len(front), np.uint64)
    plan = dedup.Plan(random.choice(front, 3000), len(front), 50)
    sizes = np.bincount(plan.group(front, certain))
    assert sizes.max() < 4 * len(front) / 50
    # Prefixes are of many lengths, and suffixes that share all their words share a group.
    assert len(set(plan.prefixes)) > 2
    assert (plan.group(front, certain) == plan.group(front.copy(), certain.copy())).all()
    assert set(dedup.Plan(np.zeros(0, np.uint64), 0, 3).group(front, certain)) == {0}


def test_deep_nodes_against_plain_prefixes():
    random = np.random.default_rng(4)
    words = [b"%d" % w for w in random.integers(0, 3, 400)]
    window = 10
    hashes = dedup.word_hashes(words)
    (front, edge), key, _ = dedup.split([dedup.symbols(hashes, window), dedup.rolling(hashes, window)], np.arange(len(words) - window + 1))
    node = dedup.deep_nodes(front, edge, window)
    shared = dedup.common_words(front)
    for n, (i, j) in enumerate(zip(key, key[1:], strict=False)):
        same = next((k for k in range(window) if words[i + k] != words[j + k]), window)
        assert shared[n] == min(same, 8)
        assert (node[n] == node[n + 1]) == (same == window)
