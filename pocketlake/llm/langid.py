"""Language ID by compression.

A language is known by a raw-content zstandard dictionary made of its labelled texts. A text is compressed, chunk by
chunk so that the dictionary stays the main source of matches, once with each dictionary; the smallest total wins. The
margin is how much larger, in proportion, the runner-up comes out. Texts without letters and texts with a narrow margin are
rejected.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import each_body, held_out, low_hash, map_rows

#: Labelled documents taken for one language at most, and the bytes of its dictionary.
DOCUMENTS_PER_LANGUAGE = 400
DICTIONARY_BYTES = 160_000
#: Bytes that one document gives to a dictionary at most, so that long documents do not fill it alone.
BYTES_PER_DOCUMENT = 4_000
#: Bytes compressed at a time.
CHUNK_BYTES = 2_048
LEVEL = 3
#: A runner-up less than this share larger calls for the second look; after it, less than the other rejects.
CLOSE = 0.08
NARROW = 0.01
UNKNOWN = "und"


_BETWEEN_WORDS = re.compile(r"[\W\d_]+")


def letters(body: bytes) -> bytes:
    """The lower-cased words of letters of a text, one space around each."""
    words = _BETWEEN_WORDS.sub(" ", body.decode("utf-8", errors="replace").lower()).strip()
    return f" {words} ".encode() if words else b""


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, most frequent language first (it wins ties)."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Dictionaries from labelled documents outside the held-out fifth.

    The sample is bounded: ``DOCUMENTS_PER_LANGUAGE`` documents in the order of a hash of their key, ``DICTIONARY_BYTES`` of
    text. How frequent a language is comes from all labelled documents and decides ties only.
    """
    labelled = docs.filter(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    low = F.lit(False)
    for code, n in counts.items():
        low = low | ((F.col("lang") == code) & low_hash("key", DOCUMENTS_PER_LANGUAGE, n))
    keys = labelled.select(F.col(key).alias("key"), F.col(lang).alias("lang")).filter(low).distinct()
    keys = keys.withColumn("nth", F.row_number().over(order))
    keys = keys.filter(F.col("nth") <= DOCUMENTS_PER_LANGUAGE).select(F.col("key").alias("_k"), F.col("lang").alias("_l"), "nth")
    # At most DOCUMENTS_PER_LANGUAGE rows per language are sent to the tasks, and as many pieces of text come back.
    labelled = labelled.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), middle(F.col(text)).alias("body"))
    chosen = labelled.join(F.broadcast(keys), (F.col("_key") == F.col("_k")) & (F.col("_lang") == F.col("_l")))
    bodies: dict[str, list[tuple[int, bytes]]] = {}
    # Of repeated keys one text counts.
    for row in chosen.groupBy("_lang", "nth").agg(F.min("body").alias("body")).collect():
        bodies.setdefault(row[0], []).append((row[1], letters(bytes(row[2]))))
    languages = sorted(bodies, key=lambda x: (-counts[x], x))
    # What stands last in a dictionary is cheapest to refer to.
    made = [b"".join(b for _, b in sorted(bodies[x], reverse=True))[-DICTIONARY_BYTES:] for x in languages]
    return LanguageModel(tuple(languages), tuple(made))


def middle(text: Column) -> Column:
    """What a document gives to a dictionary: the middle of its UTF-8 bytes."""
    raw = text.cast("binary")
    start = F.greatest(F.lit(1), F.floor((F.length(raw) - BYTES_PER_DOCUMENT) / 2).cast("int") + 1)
    return F.substring(raw, start, F.lit(BYTES_PER_DOCUMENT))


class Judge:
    """Compresses texts with every dictionary of a model."""

    def __init__(self, model: LanguageModel):
        self.languages = model.languages
        plain = {"compression_level": LEVEL}
        fine = {"compression_level": LEVEL, "strategy": zstd.STRATEGY_BTOPT, "min_match": 3}
        self.plain, self.fine = ([compressor(d, options) for d in model.dictionaries] for options in (plain, fine))

    def look(self, compressors: list, body: bytes) -> tuple[list[int], int, float]:
        """(sizes, place of the smallest, margin)."""
        chunks = [body[i : i + CHUNK_BYTES] for i in range(0, len(body), CHUNK_BYTES)]
        sizes = [sum(len(c.compress(x)) for x in chunks) for c in compressors]
        best = min(range(len(sizes)), key=lambda i: sizes[i])
        runner_up = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        return sizes, best, (runner_up - sizes[best]) / sizes[best]

    def __call__(self, body: bytes | None) -> tuple[str, float, float]:
        """(language, score, margin). The score falls with what the other languages take more."""
        text = letters(body) if body else b""
        if not text or not self.languages:
            return UNKNOWN, 0.0, 0.0
        sizes, best, margin = self.look(self.plain, text)
        if margin < CLOSE:
            again = self.look(self.fine, b" " + b" ".join(dict.fromkeys(text.split())) + b" ")
            if again[2] >= margin:
                sizes, best, margin = again
        weights = [math.exp(-min(50.0, 50.0 * (s - sizes[best]) / sizes[best])) for s in sizes]
        return self.languages[best], 1.0 / sum(weights), margin


def compressor(dictionary: bytes, options: dict) -> zstd.ZstdCompressor:
    shared = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    bare = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
    return zstd.ZstdCompressor(dict_data=shared, compression_params=zstd.ZstdCompressionParameters(**options, **bare))


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score, margin, accepted) for every whole text.

    Null texts and texts without letters are ``und`` with score 0, and not accepted; so is every text if nothing was
    learned. A text whose margin is below ``NARROW`` keeps its best language but is not accepted. Null keys count as held
    out. Repeated rows stay; other columns are left out.
    """
    extra = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("margin", T.DoubleType()),
    ]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = map_rows(docs, [key], text, extra, lambda: Judge(shared.value))
    accepted = (F.col("lang_pred") != UNKNOWN) & (F.col("margin") >= NARROW)
    return found.select(key, held_out(key).alias("held_out"), "lang_pred", "score", "margin", accepted.alias("accepted"))


def accepted_rows(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is settled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.BooleanType())
    def settled(bodies: pa.Array) -> pa.Array:
        judge = Judge(shared.value)
        answers = (judge(b) for b in each_body(bodies))
        return pa.array([lang != UNKNOWN and margin >= NARROW for lang, _, margin in answers], pa.bool_())

    return docs.filter(settled(F.col(text).cast("binary")))
