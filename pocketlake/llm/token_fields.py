"""Token counts of sections by offset-mapped attribution.

A document is encoded once as a whole, so the counts of its sections add up to its own count. The byte spans of its
tokens are then joined to the spans of its sections by binary search. A token that crosses a boundary is allocated by an
explicit rule:

* ``start``: to the section that holds its first byte;
* ``end``: to the section that holds its last byte;
* ``most``: to the section that holds most of its bytes, the earlier one if two hold as many.

Tokens in no section are reported under section -1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import codec
from .shared import BYTE_BPE, field

RULES = ("start", "end", "most")
OUTSIDE = -1


def attribute(token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token or -1, whether the token touches more than one section or leaves its own).

    Sections are half-open byte spans in order that do not overlap; empty ones get nothing.
    """
    token_starts = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends

    real = np.flatnonzero(ends > starts)

    def holder(at: np.ndarray) -> np.ndarray:
        if not len(real):
            return np.full(len(at), OUTSIDE)
        k = np.searchsorted(starts[real], at, side="right") - 1
        inside = (k >= 0) & (at < ends[real[np.maximum(k, 0)]])
        return np.where(inside, real[np.maximum(k, 0)], OUTSIDE)

    first, last = holder(token_starts), holder(token_ends - 1)
    crossing = first != last
    if rule == "start":
        return first, crossing
    if rule == "end":
        return last, crossing
    section = first.copy()
    for i in np.flatnonzero(crossing):
        a, b = token_starts[i], token_ends[i]
        near = real[(starts[real] < b) & (ends[real] > a)]
        held = np.minimum(ends[near], b) - np.maximum(starts[near], a)
        outside = (b - a) - held.sum()
        section[i] = near[held.argmax()] if len(near) and held.max() >= outside else OUTSIDE
    return section, crossing


def line_spans(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines, each with its line feed; a text without characters has no line."""
    if not body:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero(np.frombuffer(body, np.uint8) == 10) + 1
    starts = np.concatenate(([0], breaks[breaks < len(body)]))
    return starts, np.append(starts[1:], len(body))


def char_places(body: bytes) -> np.ndarray:
    """Byte place of every code point, and the length of the text at the end."""
    raw = np.frombuffer(body, np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def token_ends(ids: bytes, path: str) -> np.ndarray:
    return np.cumsum(codec(path).lengths[np.frombuffer(ids, "<u4")])


def count_tokens(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sections: str | None = None,
    rule: str = "start",
    path: str = BYTE_BPE,
) -> DataFrame:
    """(key, section, start_char, n_chars, n_tokens, n_crossing) for every section of every document.

    Sections are the lines of the text (each with its line feed), or the spans in column ``sections``: an array of
    structs (start, end) in code points, half-open, in order, without overlap; spans are clipped to the text. ``n_crossing``
    counts the tokens of the section that reach beyond it. Tokens outside all sections are under section -1, which is
    there only if it has tokens. A document without sections (null or empty text, null or empty array) gives no row but
    that one. Null keys and repeated rows stay; other columns are left out.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    made = ["section", "start_char", "n_chars", "n_tokens", "n_crossing"]
    schema = T.StructType([field(docs, key), *[T.StructField(n, T.IntegerType() if n == "section" else T.LongType()) for n in made]])

    def spans(body: bytes, given) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Byte spans, then the same in code points."""
        if sections is None:
            starts, ends = line_spans(body)
            if len(body) == len(body.decode("utf-8", errors="replace")):
                return starts, ends, starts, ends
            places = char_places(body)
            return starts, ends, np.searchsorted(places, starts), np.searchsorted(places, ends)
        places = char_places(body)
        pairs = np.array([(s["start"] or 0, s["end"] or 0) for s in given or []], np.int64).reshape(-1, 2)
        pairs = np.clip(pairs, 0, len(places) - 1)
        return places[pairs[:, 0]], places[pairs[:, 1]], pairs[:, 0], pairs[:, 1]

    def rows_of(body: bytes, given) -> np.ndarray:
        ends = token_ends(codec(path).encode(body), path)
        starts, stops, first_char, last_char = spans(body, given)
        section, crossing = attribute(ends, starts, stops, rule)
        n = len(starts)
        tokens = np.bincount(section + 1, minlength=n + 1)
        crossed = np.bincount(section[crossing] + 1, minlength=n + 1)
        table = np.zeros((n + 1, 5), np.int64)
        table[:, 0] = np.arange(-1, n)
        table[1:, 1], table[1:, 2] = first_char, last_char - first_char
        table[:, 3], table[:, 4] = tokens, crossed
        return table if tokens[0] else table[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                given = part.column(2).to_pylist() if sections else [None] * part.num_rows
                # Broken UTF-8 is repaired first, so that offsets are those of the text that is encoded.
                bodies = [(b or b"").decode("utf-8", errors="replace").encode() for b in part.column(1).to_pylist()]
                tables = [rows_of(b, g) for b, g in zip(bodies, given, strict=True)]
                owner = np.repeat(np.arange(len(tables)), [len(t) for t in tables])
                stacked = np.vstack(tables)
                columns = [pa.array(stacked[:, 0].astype(np.int32)), *[pa.array(stacked[:, j]) for j in range(1, 5)]]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), *columns], names=schema.names)

    chosen = [F.col(key), F.col(text).cast("binary").alias("_body")] + ([F.col(sections).alias("_sections")] if sections else [])
    return docs.select(*chosen).mapInArrow(run, schema)
