"""Minimal transducers against sorted lists, and the audit of sources against plain counts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pocketlake.llm import source_audit, transducer


def buffer_of(texts):
    bodies = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, bodies)])
    return np.frombuffer(b"".join(bodies), np.uint8), offsets


def terms_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def test_ordinals_are_ranks():
    random = np.random.default_rng(1)
    letters = list("abcdeßüé€😀")
    known = {lang: sorted({"".join(random.choice(letters, random.integers(1, 7))) for _ in range(800)}, key=str.encode) for lang in ("", "de", "en")}
    whole = [(lang, t.encode()) for lang in sorted(known) for t in known[lang]]
    built = transducer.Transducer.of(whole)
    asked = ["".join(random.choice(letters, random.integers(1, 8))).upper() if n % 2 else known["de"][n % len(known["de"])] for n in range(3000)]
    asked = ["".join(c.lower() if c in "ABCDE" else c for c in a) if n % 3 else a for n, a in enumerate(asked)]
    data, offsets = buffer_of(asked)
    for parts in (1, 7):
        cuts = np.linspace(0, len(whole), parts + 1).astype(int)
        shelf = transducer.Shelf([(int(a), transducer.Transducer.of(whole[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)])
        for lang in (*known, "none"):
            ranks = {t: n for n, (of, t) in enumerate(whole) if of == lang}
            want = [ranks.get(b"".join(c.lower().encode() if c in "ABCDE" else c.encode() for c in a), -1) for a in asked]
            assert shelf.ordinals(lang, data, offsets[:-1], offsets[1:]).tolist() == want
    # Minimal: no two states have equal ways on.
    ways = defaultdict(list)
    for key, target in zip(built.keys.tolist(), built.targets.tolist(), strict=True):
        ways[key >> 8].append((key & 255, target))
    names = [(bool(built.final[s]), *ways[s]) for s in range(len(built.final))]
    assert len(set(names)) == len(names) < sum(len(t) for _, t in whole) / 2


def test_spans_end_at_documents():
    texts = ["ab", "CD ef", "", "é-x", "12", "z"]
    data, offsets = buffer_of(texts)
    starts, ends, doc = transducer.term_spans(data, offsets)
    assert [(int(d), bytes(data[a:b]).decode()) for a, b, d in zip(starts, ends, doc, strict=True)] == [(0, "ab"), (1, "CD"), (1, "ef"), (3, "é"), (3, "x"), (5, "z")]


def plain(rows, least=3, ranks=200):
    docs = [(lang or "", source or "", terms_of(text)) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        stand = Counter(t for d in mine for t in set(d[2]))
        kept = sorted((t for t in stand if stand[t] >= least), key=str.encode)
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if stand[t] >= least) for s in {d[1] for d in mine}}

        def shares(count):
            total = sum(count.values())
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, n + 1) for n, (item, value) in enumerate(items[:most])]
    return sorted(out)


def drawn(seed, documents):
    random = np.random.default_rng(seed)
    words = ["The", "the", "fähre", "ÄRE", "x1y", "don't", "日本", "日", "a-b", "", "ZZ", "zz.", "\n"]
    rows = []
    for _ in range(documents):
        lang, source = (("en", "de", None, "")[random.integers(4)], (None, "s1", "s2", "ß", "s3")[random.integers(5)])
        text = " ".join(words[k] for k in random.integers(0, len(words), random.integers(0, 30)))
        rows.append((lang, source, None if random.random() < 0.1 else text + f" r{'abcdefg'[random.integers(7)]}{'xyz'[random.integers(3)]}"))
    return rows + [("none", "alone", "1 2 3"), ("none", "second", None), ("one", "only", "word word")]


@pytest.mark.parametrize("portion,block", [(10**6, (4096, 256)), (7, (3, 2))])
def test_audit_against_plain_counts(spark, monkeypatch, portion, block):
    monkeypatch.setattr(source_audit, "TERMS_BUILT", portion)
    monkeypatch.setattr(source_audit, "TERMS_SENT", 2 * portion)
    monkeypatch.setattr(source_audit, "COUNTS_HELD", 10 * portion)
    monkeypatch.setattr(source_audit, "BLOCK_TERMS", block[0])
    monkeypatch.setattr(source_audit, "BLOCK_SOURCES", block[1])
    rows = drawn(8, 200)
    table = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS ord", "3 AS n", "4 AS p").repartition(5)
    assert sorted(map(tuple, source_audit.audit(table, ranks=4).collect())) == plain(rows, ranks=4)


def test_odd_tables(spark):
    table = spark.createDataFrame([], "lang string, source string, text string")
    assert source_audit.audit(table).count() == 0
    rows = [("en", "a", "word " * 200_000), ("en", "a", "word"), ("en", "b", "Word"), ("en", "b", "Word")]
    assert sorted(map(tuple, source_audit.audit(spark.createDataFrame(rows, table.schema)).collect())) == plain(rows)


def test_shares_are_exact_beyond_longs():
    counts, total, terms = [0, 5, 7_000_000_000_001], 9_000_000_000_000_003, 12
    assert source_audit.shares(np.array(counts), total, terms).tolist() == [1 + 10**9 * (n + 1) // (total + terms) for n in counts]
    assert source_audit.shares(np.array(counts[:2]), 40, terms).tolist() == [1 + 10**9 * (n + 1) // 52 for n in counts[:2]]
