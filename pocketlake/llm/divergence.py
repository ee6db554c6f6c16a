"""Quality rules by divergence from the language.

Each language has two reference histograms: of character classes, and of its common words (a share of at least
``COMMON`` of the language's words) with all other words in one bin. A document's own histograms are held against them by
Jensen-Shannon distance (base 2, so 0 to 1). Short texts scatter more, so the limit widens as the text gets
shorter and no word histogram is judged below ``LEAST_WORDS`` words.

The references cover every document. Common words are found without shuffling the vocabulary: each task sends a
mergeable summary of heavy words with its error bound, which leaves a bounded number of candidates per language,
and the candidates are then counted exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textstats
from .shared import map_rows

#: Least share of a language's words that makes a word common.
COMMON = 1 / 500
#: Words in a task's summary for one language.
SUMMARY = int(8 / COMMON)
#: Distances up to which a long text passes, and what a text of n words (characters) is given on top: slack / sqrt(n).
WORD_LIMIT, WORD_SLACK = 0.03, 4.0
CLASS_LIMIT, CLASS_SLACK = 0.15, 3.0
#: Fewer words or characters than these are not judged by the histogram.
LEAST_WORDS, LEAST_CHARS = 50, 200
#: Base rules.
BASE_WORDS, BASE_REPEATED = 50, 50


@dataclass(frozen=True)
class Reference:
    """Histograms of one language; ``words`` are its common words, the last of ``word_counts`` is all others."""

    lang: str
    classes: np.ndarray
    words: tuple[bytes, ...]
    word_counts: np.ndarray


def shrink(summary: Counter, size: int) -> tuple[Counter, int]:
    """At most ``size`` words: the next count is taken from all of them, which is how far a count may fall short."""
    if len(summary) <= size:
        return summary, 0
    cut = sorted(summary.values(), reverse=True)[size]
    return Counter({w: c - cut for w, c in summary.items() if c > cut}), cut


def candidates(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word) for all words that can have a share of ``COMMON``: at most about 1.2 / ``COMMON`` per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries: dict[str, Counter] = {}
        errors: Counter = Counter()
        totals: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                by_lang: dict[str, list] = {}
                for code, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by_lang.setdefault(code, []).append(textstats.bare_words(body))
                for code, lists in by_lang.items():
                    words = textstats.flatten(lists)
                    totals[code] += len(words)
                    summaries.setdefault(code, Counter()).update(words)
                    if len(summaries[code]) > 50 * SUMMARY:
                        summaries[code], cut = shrink(summaries[code], SUMMARY)
                        errors[code] += cut
        rows = []
        for code, summary in summaries.items():
            summary, cut = shrink(summary, SUMMARY)
            rows.append((code, None, totals[code], errors[code] + cut))
            rows += [(code, w, c, 0) for w, c in summary.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "word", "n", "short"])

    sent = docs.select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("body")).filter("lang IS NOT NULL AND body IS NOT NULL")
    merged = sent.mapInArrow(run, "lang string, word binary, n long, short long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("short").alias("short"))
    totals = merged.filter("word IS NULL").select("lang", F.col("n").alias("_total"), F.col("short").alias("_short"))
    heavy = merged.filter("word IS NOT NULL").join(totals, "lang")
    return heavy.filter(F.col("n") + F.col("_short") >= COMMON * F.col("_total")).select("lang", "word")


def learn_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[Reference]:
    """References of all languages, from all documents with a language and a text."""
    lists: dict[str, list[bytes]] = {}
    for code, word in candidates(docs, text, lang).collect():  # bounded per language, see candidates()
        lists.setdefault(code, []).append(bytes(word))
    lists = {code: sorted(words) for code, words in lists.items()}
    places = {code: {w: i for i, w in enumerate(words)} for code, words in lists.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for code, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = places.get(code, {})
                if code not in counted:
                    counted[code] = [np.zeros(len(textstats.CLASSES), np.int64), np.zeros(len(known) + 1, np.int64)]
                counted[code][0] += textstats.class_counts(textstats.byte_counts(body))
                counted[code][1] += textstats.word_shares(textstats.bare_words(body), known, len(known))
        rows = [(code, kind, i, int(n)) for code, both in counted.items() for kind, c in enumerate(both) for i, n in enumerate(c)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "kind", "place", "n"])

    sent = docs.select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("body")).filter("lang IS NOT NULL AND body IS NOT NULL")
    counted = sent.mapInArrow(run, "lang string, kind int, place int, n long").groupBy("lang", "kind", "place").agg(F.sum("n").alias("n"))
    found: dict[str, list[np.ndarray]] = {}
    for code, kind, place, n in counted.collect():
        both = found.setdefault(code, [np.zeros(len(textstats.CLASSES)), np.zeros(len(lists.get(code, [])) + 1)])
        both[kind][place] = n
    out = []
    for code in sorted(found):
        classes, counts = found[code]
        total = counts.sum()
        kept = [i for i, n in enumerate(counts[:-1]) if n >= COMMON * total]
        counts = np.append(counts[kept], total - counts[kept].sum())
        out.append(Reference(code, classes, tuple(lists[code][i] for i in kept) if kept else (), counts))
    return out


def js_distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 1 if either is empty."""
    if not counts.sum() or not reference.sum():
        return 1.0
    p, q = counts / counts.sum(), reference / reference.sum()
    m = (p + q) / 2
    both = [np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])) for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(both) / 2)))


class Rules:
    """The verdict on one text against the references."""

    def __init__(self, references: list[Reference]):
        self.references = [(r, {w: i for i, w in enumerate(r.words)}) for r in references]

    def __call__(self, body: bytes | None) -> tuple:
        body = body or b""
        words = body.split()
        per_byte = textstats.byte_counts(body)
        _, repeated = textstats.repeated_words(words)
        _, twice = textstats.duplicate_lines(body)
        failed = len(words) < BASE_WORDS or 100 * repeated > BASE_REPEATED * len(words)
        nearest, word_distance, class_distance, passes = self.verdict(body, per_byte)
        counts = (len(words), textstats.word_chars(per_byte), textstats.symbols(per_byte), twice, repeated)
        return *counts, failed, not failed and passes, nearest, word_distance, class_distance

    def verdict(self, body: bytes, per_byte: np.ndarray) -> tuple[str | None, float | None, float | None, bool]:
        """(nearest language, its two distances, whether both pass). Without references everything passes."""
        if not self.references:
            return None, None, None, True
        classes = textstats.class_counts(per_byte)
        words = textstats.bare_words(body)
        best = None
        for reference, places in self.references:
            by_word = js_distance(textstats.word_shares(words, places, len(places)), reference.word_counts)
            by_class = js_distance(classes, reference.classes)
            if best is None or by_word + by_class < best[1] + best[2]:
                best = (reference.lang, by_word, by_class)
        lang, by_word, by_class = best
        characters = int(classes.sum())
        word_ok = len(words) < LEAST_WORDS or by_word <= WORD_LIMIT + WORD_SLACK / len(words) ** 0.5
        class_ok = characters < LEAST_CHARS or by_class <= CLASS_LIMIT + CLASS_SLACK / characters**0.5
        return lang, by_word, by_class, word_ok and class_ok


def judge(docs: DataFrame, references: list[Reference], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, nearest, word_distance, class_distance).

    Null texts have no words and fail the base rules, as do empty ones. A document is held against the language it is
    nearest to, so a wrong or missing language does not count against it. Null keys and repeated rows stay;
    other columns are left out. With no documents to learn from, only the base rules decide.
    """
    whole = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    extra = [T.StructField(n, T.LongType()) for n in whole]
    extra += [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("nearest", T.StringType())]
    extra += [T.StructField("word_distance", T.DoubleType()), T.StructField("class_distance", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast(references)
    return map_rows(docs, [key], text, extra, lambda: Rules(shared.value))
