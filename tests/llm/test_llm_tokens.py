"""BPE by forced boundaries, packing and token counts, against the tokenizers library and plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pocketlake.llm import bpe, packing, token_fields
from pocketlake.llm.shared import BYTE_BPE

tokenizers = pytest.importorskip("tokenizers")

SMALL = "/root/testdata/sf0.001"
ODD = [
    (1, "The cat's 12 hats,\n\n  and don't\tstop."), (2, None), (3, ""), (4, "a"), (5, "  　 x y "), (6, "日本語の文 and é̃ß😀!"),
    (6, "日本語の文 and é̃ß😀!"), (None, "<|endoftext|>x <|endoftext|><|end"), (8, "word " * 30_000), (9, "''s 'll it''ll !'s \x00\x7f\x1c\n"),
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(BYTE_BPE)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "x", 7) for k, t in ODD], "doc_id long, text string, ids string, piece int")


def plain_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_codec_against_library(library):
    codec = bpe.codec(BYTE_BPE)
    parts = [*"aeis'’\"() \t\n\r\x0b\x85\xa0 　,.!?$%09½é中文本カ😀ß\x00\x7f", "'s", "'re", "<|endoftext|>", "<|", "  ", "\n\n", "the", " The", "QZ", " ,"]
    source = random.Random(5)
    for _ in range(4000):
        text = "".join(source.choices(parts, k=source.randint(0, 25)))
        ids = codec.encode(text.encode())
        assert np.frombuffer(ids, "<u4").tolist() == plain_ids(library, text), text
        assert codec.decode(ids) == library.decode(plain_ids(library, text), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_codec_round_trip(text):
    codec = bpe.codec(BYTE_BPE)
    assert codec.decode(codec.encode(text.encode("utf-8", errors="replace"))) == text.encode("utf-8", errors="replace").decode()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=12))
def test_decode_of_any_ids(ids):
    library = tokenizers.Tokenizer.from_file(BYTE_BPE)
    assert bpe.codec(BYTE_BPE).decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_no_cut_inside_a_token():
    codec = bpe.codec(BYTE_BPE)
    for number in random.Random(1).sample(range(50_000), 3000):
        token = codec.blob[codec.starts[number] : codec.starts[number] + codec.lengths[number]].astype(np.int64)
        assert not codec.cut[token[:-1] * 256 + token[1:]].any()


def test_digests(spark, odd, library):
    rows = sorted(bpe.encode_digests(odd).collect(), key=str)
    expected = []
    for key, text in ODD:
        ids = plain_ids(library, text)
        decimals = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        expected.append((key, len(ids), decimals, decoded))
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    assert bpe.encode_digests(odd.limit(0)).count() == 0


def test_encode_and_decode_tables(spark, odd):
    texts = bpe.decode_ids(bpe.encode_texts(odd))
    assert sorted(map(tuple, texts.collect()), key=str) == sorted([(k, t or "") for k, t in ODD], key=str)


def check_packing(rows, texts, library, capacity=1024, end_id=2):
    """Whole, gapless, cut only where allowed; returns the number of sequences."""
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    expected: dict = {}
    for key, text in texts:
        ids = plain_ids(library, text) + [end_id]
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids), capacity), len(ids)]
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            expected.setdefault(key, []).append((i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}
    return len(by_sequence)


def test_packing_odd_rows(spark, odd, library):
    check_packing(packing.pack(odd).collect(), ODD, library)
    assert packing.pack(odd.limit(0)).count() == 0


def test_packing_many_partitions(spark, library):
    source = random.Random(3)
    texts = [(i, " ".join(source.choices(["the", "cat", "runs", "zyx"], k=source.choice([1, 5, 40, 300, 900])))) for i in range(400)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(13)
    rows = packing.pack(frame).collect()
    used = check_packing(rows, texts, library)
    assert used <= best_fit_by_document([r.length for r in rows], 1024)


def best_fit_by_document(lengths, capacity):
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        fitting = [(f, i) for i, f in enumerate(free) if f >= n]
        if fitting:
            free[min(fitting)[1]] -= n
        else:
            free.append(capacity - n)
    return len(free)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_over_counts(lengths):
    capacity = 40
    histogram = {n: lengths.count(n) for n in set(lengths)}
    seen: dict = {}
    ranks: dict = {}
    for length, rank, each, first, offset in packing.plan_best_fit(histogram, capacity):
        assert rank == ranks.get(length, 0)
        later = [r for n, r, *_ in packing.plan_best_fit(histogram, capacity) if n == length and r > rank]
        stop = min(later, default=histogram[length])
        ranks[length] = stop
        for nth in range(stop - rank):
            seen.setdefault(first + nth // each, []).append((offset + nth % each * length, length))
    assert ranks == histogram
    for places in seen.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(seen) == best_fit_by_document(lengths, capacity)


def plain_counts(library, text, starts, stops, rule):
    """Tokens by section (-1 outside), by the bytes of every token."""
    ids = plain_ids(library, text)
    codec = bpe.codec(BYTE_BPE)
    out: dict = {}
    at = 0
    for number in ids:
        span = range(at, at + int(codec.lengths[number]))
        at = span.stop
        homes = [next((i for i, (a, b) in enumerate(zip(starts, stops, strict=True)) if a <= x < b), -1) for x in span]
        if rule == "start":
            home = homes[0]
        elif rule == "end":
            home = homes[-1]
        else:
            real = [h for h in dict.fromkeys(homes) if h >= 0]
            home = max(real, key=lambda h: (homes.count(h), -h), default=-1)
            if homes.count(-1) > homes.count(home):
                home = -1
        n, crossed = out.get(home, (0, 0))
        out[home] = (n + 1, crossed + (homes[0] != homes[-1]))
    return out


def test_line_counts(spark, odd, library):
    rows = token_fields.count_tokens(odd).collect()
    texts = [(k, t) for k, t in ODD if k != 8]
    for key, text in texts:
        if text is None or key == 6:
            continue
        lines = text.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        sizes = np.cumsum([0, *[len(x.encode()) for x in lines]])
        expected = plain_counts(library, text, sizes[:-1].tolist(), sizes[1:].tolist(), "start")
        mine = [r for r in rows if r.doc_id == key]
        assert [r.n_chars for r in sorted(mine, key=lambda r: r.section)] == [len(x) for x in lines]
        assert {r.section: (r.n_tokens, r.n_crossing) for r in mine if r.n_tokens} == expected
    whole = {r.doc_id: r.n for r in token_fields.count_tokens(odd).groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert whole[8] == len(plain_ids(library, ODD[8][1]))
    assert 2 not in whole and 3 not in whole
    assert token_fields.count_tokens(odd.limit(0)).count() == 0


@pytest.mark.parametrize("rule", token_fields.RULES)
def test_given_sections(spark, library, rule):
    text = "Title é of it\nBody goes here, über alles. Endnote 😀 x"
    sections = [(0, 5), (5, 9), (9, 9), (12, 30), (31, 400)]
    frame = spark.createDataFrame([(1, text, sections), (2, text, None), (3, None, sections)], "doc_id long, text string, sections array<struct<start:long,end:long>>")
    rows = token_fields.count_tokens(frame, sections="sections", rule=rule).collect()
    places = [len(text[:i].encode()) for i in range(len(text) + 1)]
    spans = [(places[min(a, len(text))], places[min(b, len(text))]) for a, b in sections]
    expected = plain_counts(library, text, [a for a, _ in spans], [b for _, b in spans], rule)
    assert {r.section: (r.n_tokens, r.n_crossing) for r in rows if r.doc_id == 1 and r.n_tokens} == expected
    assert [(r.section, r.n_tokens) for r in rows if r.doc_id == 2] == [(-1, len(plain_ids(library, text)))]
    assert all(r.n_tokens == 0 for r in rows if r.doc_id == 3)
