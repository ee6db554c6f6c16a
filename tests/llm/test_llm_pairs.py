"""SimHash components and the vector-approximation search against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from pocketlake.llm import simhash, va_search

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, prints, distance=2):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(root(i), []).append(keys[i])
    least = {r: min((k for k in ks if k is not None), default=None) for r, ks in groups.items()}
    return [least[root(i)] for i in range(len(prints))]


@pytest.fixture(scope="module")
def texts():
    random = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(500)]
    out = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one two"), (5, "one two"), (None, "one two"), (None, "alone here now"), (6, "ÀB à b\x0bc d")]
    for i in range(60):
        words = list(random.choice(vocabulary, size=int(random.choice([20, 200, 600]))))
        out.append((100 + 10 * i, " ".join(words)))
        for copy in range(int(random.integers(0, 4))):
            changed = list(words)
            changed[int(random.integers(len(words)))] = "Changed"
            out.append((100 + 10 * i + 1 + copy, " ".join(changed)))
    out.append((9000, "long " * 40_000))
    return out


def test_fingerprints(texts):
    for _, text in texts:
        assert simhash.fingerprint(text.encode() if text is not None else None) == plain_fingerprint(text)


def test_components(spark, texts):
    frame = spark.createDataFrame([(k, t, "f", 1) for k, t in texts], "doc_id long, text string, fp string, label int").repartition(5)
    rows = simhash.near_duplicates(frame).collect()
    prints = [plain_fingerprint(t) for _, t in texts]
    expected = zip([k for k, _ in texts], [f"{p:016x}" for p in prints], plain_components([k for k, _ in texts], prints), strict=True)
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_keep_one(spark, texts):
    frame = spark.createDataFrame([(k, t, "f", 1) for k, t in texts], "doc_id long, text string, _fp string, _n int")
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    prints = [plain_fingerprint(t) for _, t in texts]
    groups = set()
    order = {p: i for i, p in enumerate(dict.fromkeys(prints))}
    parent = plain_components([order[p] for p in prints], prints)
    groups = set(parent)
    assert kept.count() == len(groups)
    least = set(plain_components([k for k, _ in texts], prints))
    assert {r.doc_id for r in kept.collect()} == least
    assert simhash.keep_one(frame.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["uniform", "clustered", "chain"])
def test_tree_links_everything(spark, monkeypatch, kind):
    """Small leaves and few queries per task, so that routing, boundary visits and dealing out are all in play."""
    monkeypatch.setattr(simhash, "NODES_PER_LEAF", 64)
    monkeypatch.setattr(simhash, "QUERIES_PER_TASK", 300)
    random = np.random.default_rng(8)
    if kind == "uniform":
        base = random.integers(0, 1 << 64, 500, dtype=np.uint64)
        flips = np.uint64(1) << random.integers(0, 64, (500, 3)).astype(np.uint64)
        values = np.concatenate([base, base ^ flips[:, 0], base ^ flips[:, 0] ^ flips[:, 1], base ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2]])
    elif kind == "clustered":
        center = random.integers(0, 1 << 64, 3, dtype=np.uint64)
        flips = np.uint64(1) << random.integers(0, 64, (900, 4)).astype(np.uint64)
        values = np.concatenate([center.repeat(300) ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2] ^ flips[:, 3], random.integers(0, 1 << 64, 300, dtype=np.uint64)])
    else:
        values, at = [], 0
        for i in range(64):
            at ^= 1 << i
            values.append(at)
        values = np.array(values[::2] + [(1 << 63) | 5], np.uint64)
    values = np.unique(values)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(4)
    labels = {r.fp: r.label for r in simhash.fingerprint_components(frame).collect()}
    signed = values.view(np.int64).tolist()
    expected = plain_components(signed, values.tolist())
    assert [labels.get(v, v) for v in signed] == expected


def plain_search(rows, k, scale=1024):
    vectors = []
    for n, (key, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v):
            vectors.append((n, key, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]))
    out = []
    for n, key, v in vectors:
        if key is None or key % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), other is None, other or 0) for m, other, w in vectors if m != n and len(w) == len(v)]
        out += [(key, i + 1, None if none else other, -s) for i, (s, none, other) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("spread", [1.0, 1e5])
def test_search(spark, monkeypatch, spread):
    monkeypatch.setattr(va_search, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(va_search, "QUERY_BLOCK", 3)
    random = np.random.default_rng(2)
    rows = [(i, [float(x) for x in spread * random.normal(size=6).astype(np.float32)]) for i in range(700)]
    rows += [(7, rows[5][1]), (8, rows[5][1]), (100, rows[3][1]), (100, rows[3][1]), (None, rows[3][1])]
    rows += [(1100, None), (1200, []), (1300, [1.0, None, 1.0, 0.0, 0.0, 0.0]), (1400, [1.0, float("nan"), 1.0, 0.0, 0.0, 0.0]), (1500, [float("inf")] * 6)]
    rows += [(1600, [1.0, 2.0]), (1601, [0.5, 2.0]), (1700, [0.0] * 3)]
    frame = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    found = va_search.search(frame)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain_search(rows, 10), key=str)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert va_search.search(frame.limit(0)).count() == 0


def test_bounds_hold():
    random = np.random.default_rng(6)
    exact = random.integers(-3000, 3000, (200, 9))
    low, high = exact.min(axis=0).astype(float), exact.max(axis=0).astype(float)
    row = {"dims": 9, "keys": np.zeros(200, "<i8").tobytes(), "known": b"\x01" * 200, "nos": np.arange(200, dtype="<i8").tobytes(), "cells": va_search.cells_of(exact, low, high).tobytes()}
    queries = random.integers(-3000, 3000, (20, 9))
    lower, upper = va_search.VectorBlock(row, low, high).bounds(queries)
    scores = queries @ exact.T
    assert (lower <= scores).all() and (scores <= upper).all()
    assert (upper - lower).mean() < 0.3 * (scores.max() - scores.min())
