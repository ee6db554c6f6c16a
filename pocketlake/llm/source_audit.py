"""Divergence audit of sources: how far the words of each source lie from those of the other sources of its language.

The kept terms of all languages are sorted over ranges, and each range becomes a minimal acyclic transducer (``transducer``) whose
ordinals are places in the order of (language, term). Texts are streamed through the transducers to recount their terms. Counts lie in
blocks of consecutive ordinals, a row for each block and source; ordinals also break ties, and only the terms that are reported are
turned back into text.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pocketlake.runtime import freeze

from .shared import each_body
from .transducer import Builder, Shelf, term_spans

#: Documents of a language that a term must stand in.
LEAST_DOCUMENTS = 3
#: Ranks reported of a group's terms.
TERM_RANKS = 200
#: Terms that a task builds into a transducer, and that are sent to the tasks at once; the texts of a language are read once for each such portion.
TERMS_BUILT, TERMS_SENT = 400_000, 1_600_000
#: Counts a task holds before it sends them on, and bytes of text it looks at together.
COUNTS_HELD = 400_000
BYTES_AT_ONCE = 4 << 20
#: Terms and sources of a block of the comparison of all sources of a language.
BLOCK_TERMS, BLOCK_SOURCES = 4096, 256
COUNTS = "lang string, source string, block long, ords array<long>, counts array<long>"
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def cleaned(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term): terms that stand in at least ``least`` documents of the language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def batch() -> pa.RecordBatch:
            rows = [(lang, term, n) for lang, terms in held.items() for term, n in terms.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            kinds = (pa.string(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "term", "n"])

        for part in batches:
            for lang, body in zip(part.column(0).to_pylist(), each_body(part.column(1)), strict=True):
                held.setdefault(lang, Counter()).update(set(_TERM.findall(body.lower())))
                if sum(map(len, held.values())) > COUNTS_HELD:
                    yield batch()
                    held.clear()
        yield batch()

    counted = docs.select("lang", F.col("text").cast("binary")).mapInArrow(count, "lang string, term binary, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


class Vocabulary:
    """Kept terms in ranges of their order, a transducer for each range, and what is known of each language."""

    def __init__(self, kept: DataFrame):
        kept = freeze(kept)
        count = kept.count()
        # Frozen: ordinals need the same ranges whenever they are read.
        self.ranges = freeze(kept.repartitionByRange(max(1, -(-count // TERMS_BUILT)), "lang", "term").sortWithinPartitions("lang", "term"))
        self.parts = freeze(self.ranges.mapInArrow(build, "part int, n long, low string, high string, body binary"))
        rows = self.parts.select("part", "n", "low", "high").orderBy("part").collect()  # a row for each TERMS_BUILT terms
        self.bases = dict(zip((r.part for r in rows), np.cumsum([0, *(r.n for r in rows)]).tolist(), strict=False))
        self.portions: list[list] = []
        for row in rows:
            if not self.portions or sum(r.n for r in self.portions[-1]) + row.n > TERMS_SENT:
                self.portions.append([])
            self.portions[-1].append(row)

    def ordinals(self) -> DataFrame:
        """(lang, ord, term)"""
        bases = self.bases

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = bases.get(TaskContext.get().partitionId(), 0)
            for batch in batches:
                numbers = pa.array(np.arange(at, at + batch.num_rows), pa.int64())
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), numbers, batch.column(1)], names=["lang", "ord", "term"])

        return self.ranges.mapInArrow(number, "lang string, ord long, term binary").withColumn("term", F.col("term").cast("string"))

    def recount(self, docs: DataFrame) -> DataFrame:
        """(lang, source, block, ords, counts): occurrences of kept terms in the texts of each group, in rows of a task, for blocks that have any."""
        spark, counted = docs.sparkSession, None
        for rows in self.portions:
            held = self.parts.filter(F.col("part").between(rows[0].part, rows[-1].part)).select("part", "body").collect()
            sent = spark.sparkContext.broadcast([(self.bases[r.part], bytes(r.body)) for r in sorted(held)])
            texts = docs.filter(F.col("lang").between(rows[0].low, rows[-1].high)).select("lang", "source", F.col("text").cast("binary"))
            portion = texts.mapInArrow(streamed(sent), COUNTS)
            counted = portion if counted is None else counted.unionByName(portion)
        if counted is None:
            return spark.createDataFrame([], COUNTS)
        return counted


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the transducer of a range, none if it is empty."""
    builder, n, low, high = Builder(), 0, None, None
    for batch in batches:
        for lang, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            builder.add(lang, term)
            n, low, high = n + 1, lang if low is None else low, lang
    if n:
        arrays = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n]), pa.array([low]), pa.array([high]), pa.array([pickle.dumps(builder.done())], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "n", "low", "high", "body"])


def streamed(sent):
    """A step that recounts texts by the transducers in the broadcast ``sent``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = Shelf([(base, pickle.loads(body)) for base, body in sent.value])
        groups: dict[tuple[str, str], int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def batch() -> pa.RecordBatch:
            group, ordinal, n = map(np.concatenate, zip(*held, strict=True))
            (group, ordinal), n = summed([group, ordinal], n)
            names, (block, of) = list(groups), (ordinal // BLOCK_TERMS, group)
            first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (block[1:] != block[:-1]))))
            cuts = pa.array(np.append(first, len(n)), pa.int32())
            columns = [pa.array([names[g][k] for g in of[first]], pa.string()) for k in (0, 1)]
            lists = [pa.ListArray.from_arrays(cuts, pa.array(c)) for c in (ordinal, n)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(block[first]), *lists], names=["lang", "source", "block", "ords", "counts"])

        for whole in batches:
            for part in slices(whole):
                langs, sources = part.column(0).to_pylist(), part.column(1).to_pylist()
                of = np.array([groups.setdefault(pair, len(groups)) for pair in zip(langs, sources, strict=True)], np.int64)
                data, offsets = buffers(part.column(2))
                starts, ends, doc = term_spans(data, offsets)
                for lang in set(langs):
                    mine = np.flatnonzero(np.array([x == lang for x in langs])[doc])
                    got = shelf.ordinals(lang, data, starts[mine], ends[mine])
                    known = got >= 0
                    pairs, n = np.unique(of[doc[mine[known]]] << 40 | got[known], return_counts=True)
                    held.append((pairs >> 40, pairs & ((1 << 40) - 1), n))
                if sum(len(h[0]) for h in held) > COUNTS_HELD:
                    merged = batch()
                    held.clear()
                    yield merged
        if sum(len(h[0]) for h in held):
            yield batch()

    return count


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about BYTES_AT_ONCE together; a longer text is a part of its own."""
    _, offsets = buffers(batch.column(2))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES_AT_ONCE, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def buffers(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column without nulls and where each text begins in them, and where the last ends."""
    wide = np.int64 if pa.types.is_large_binary(bodies.type) else np.int32
    _, places, data = bodies.buffers()
    offsets = np.frombuffer(places, wide)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order with the sum of each."""
    order = np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], n[order]
    new = np.zeros(len(n), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return [k[first] for k in keys], np.add.reduceat(n, first) if len(first) else n


def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each source of a block, out of the rows of the tasks; one batch is held at a time besides the sums."""
    of: dict[str, int] = {}
    sums = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        source, ords, counts = (batch.column(batch.schema.get_field_index(c)) for c in ("source", "ords", "counts"))
        each = np.array([of.setdefault(x, len(of)) for x in source.to_pylist()], np.int64).repeat(np.diff(ords.offsets.to_numpy()))
        parts = (each, ords.flatten().to_numpy(), counts.flatten().to_numpy())
        (one, two), n = summed([np.concatenate((a, b)) for a, b in zip(sums[:2], parts[:2], strict=True)], np.concatenate((sums[2], parts[2])))
        sums = [one, two, n]
    first = np.flatnonzero(np.diff(sums[0], prepend=-1))
    cuts, names = pa.array(np.append(first, len(sums[0])), pa.int32()), list(of)
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()] * len(first), pa.string()), pa.array([names[k] for k in sums[0][first]], pa.string()), pa.array([key[1].as_py()] * len(first), pa.int64()),
         pa.ListArray.from_arrays(cuts, pa.array(sums[1])), pa.ListArray.from_arrays(cuts, pa.array(sums[2]))], names=["lang", "source", "block", "ords", "counts"],
    )


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (n + 1) / (total + terms)) of each count n, exact at any count."""
    if not len(counts) or int(counts.max()) < 9_000_000_000:
        return 1 + 1_000_000_000 * (counts + 1) // (total + terms)
    return np.array([1 + 1_000_000_000 * (n + 1) // (total + terms) for n in counts.tolist()], np.int64)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of each (lang, source) group.

    Part ``pair`` has each other source of the language with the summed distance over all kept terms; part ``term`` the kept terms that
    the group uses more than its language does, with their distance, up to ``ranks``. Terms are runs of letters A-Z (in lower case) and
    of characters beyond ASCII, kept if in at least ``least`` documents (rows) of the language. Ties go to the lesser term or source in UTF-8.

    Nulls in the three columns count as empty. A group without terms has its pairs, with value 0 if the language keeps no terms; a source
    alone in its language has no pairs. Repeated rows count each. Other columns are left out. An empty table gives no rows.
    """
    docs = cleaned(docs, text, lang, source)
    vocabulary = Vocabulary(kept_terms(docs, least))
    groups = freeze(docs.select("lang", "source").distinct())
    # Blocks of sources: their number is that of the language with the most.
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    tile = F.pmod(F.xxhash64("source"), F.lit(-(-most // BLOCK_SOURCES))).cast("int").alias("tile")
    parts = vocabulary.recount(docs)
    counts = freeze(parts.groupBy("lang", "block", tile).applyInArrow(merged, COUNTS))
    ordinals = vocabulary.ordinals()
    terms = ordinals.groupBy("lang").agg(F.count("*").alias("terms"), F.min("ord").alias("low"))
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    totals = counts.groupBy("lang", "source").agg(F.sum(n).alias("total"))
    groups = groups.select("lang", "source", tile).join(totals, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["total", "terms", "low"])
    groups = freeze(groups)
    return term_part(counts, groups, ordinals, ranks).unionByName(pair_part(counts, groups, -(-most // BLOCK_SOURCES)))


def ranked(rows: DataFrame, tie: str, least: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), tie)
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows if least is None else rows.filter(F.col("rank") <= least)


def term_part(counts: DataFrame, groups: DataFrame, ordinals: DataFrame, ranks: int) -> DataFrame:
    """The terms with the greatest distances: those of each block first, then of all blocks."""
    whole = counts.select("lang", F.lit("").alias("source"), "block", "ords", "counts").groupBy("lang", "block").applyInArrow(merged, COUNTS)
    whole = whole.select("lang", "block", F.col("ords").alias("all_ords"), F.col("counts").alias("all_counts"))
    in_all = groups.groupBy("lang").agg(F.sum("total").alias("all_total"))
    rows = counts.join(groups.select("lang", "source", "total", "terms"), ["lang", "source"]).join(in_all, "lang").join(whole, ["lang", "block"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources, totals, terms, all_totals = (c.to_pylist() for c in batch.columns[:5])
            made = []
            for k in range(batch.num_rows):
                ords, counted, all_ords, all_counted = (c[k].values.to_numpy() for c in batch.columns[5:])
                p = shares(counted, totals[k], terms[k])
                q = shares(all_counted[np.searchsorted(all_ords, ords)], all_totals[k], terms[k])
                more = p > q
                p, q, ords = p[more], q[more], ords[more]
                value = (p - q) * (p - q) // q
                order = np.lexsort((ords, -value))[:ranks]
                made.append((np.full(len(order), k), ords[order], value[order]))
            at, ords, values = map(np.concatenate, zip(*made, strict=True))
            names = [pa.array([x[k] for k in at], pa.string()) for x in (langs, sources)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(ords), pa.array(values)], names=["lang", "source", "ord", "value"])

    chosen = rows.select("lang", "source", "total", "terms", "all_total", "ords", "counts", "all_ords", "all_counts")
    named = ranked(chosen.mapInArrow(best, "lang string, source string, ord long, value long"), "ord", ranks).join(ordinals, ["lang", "ord"])
    return named.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def pair_part(counts: DataFrame, groups: DataFrame, tiles: int) -> DataFrame:
    """Blocks of terms by blocks of sources: each task compares the sources of two blocks over the terms of one."""
    size = BLOCK_TERMS
    last = F.floor((F.col("low") + F.col("terms") - 1) / size)
    blocks = F.when(F.col("terms") > 0, F.sequence(F.floor(F.col("low") / size), last)).otherwise(F.array(F.lit(-1).cast("long")))
    rows = groups.withColumn("block", F.explode(blocks)).join(counts, ["lang", "source", "block"], "left")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    columns = ["source", "total", "terms", "low", "ords", "counts"]
    sides = rows.select("lang", "block", F.col("tile").alias("one"), F.col("other").alias("two"), F.lit(True).alias("left"), *columns)
    sides = sides.unionByName(rows.select("lang", "block", F.col("other").alias("one"), F.col("tile").alias("two"), F.lit(False).alias("left"), *columns))
    gaps = sides.groupBy("lang", "block", "one", "two").applyInArrow(lambda table: compare(table, size), "lang string, source string, item string, value long")
    pairs = gaps.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return ranked(pairs, "item").select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")


def compare(table: pa.Table, block_terms: int) -> pa.Table:
    """Summed distances of every left source from every other right source over the terms of a block."""
    left = table.column("left").to_numpy()
    lang, block, terms, low = (table.column(c)[0].as_py() for c in ("lang", "block", "terms", "low"))
    begin = max(low, block * block_terms)
    size = max(0, min(low + terms, (block + 1) * block_terms) - begin) if terms else 0

    def side(part: pa.Table) -> tuple[list[str], np.ndarray]:
        counted = np.zeros((part.num_rows, size), np.int64)
        for k, (ords, counts) in enumerate(zip(part.column("ords"), part.column("counts"), strict=True)):
            if ords.is_valid:
                counted[k, ords.values.to_numpy() - begin] = counts.values.to_numpy()
        return part.column("source").to_pylist(), np.stack([shares(c, t, terms) for c, t in zip(counted, part.column("total").to_pylist(), strict=True)] or [counted])

    parts = (table.filter(pa.array(left)), table.filter(pa.array(~left)))
    if not all(part.num_rows for part in parts):
        return pa.table({c: pa.array([], k) for c, k in (("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()))})
    (ones, mine), (others, theirs) = map(side, parts)
    of, items, values = [], [], []
    for name, own in zip(ones, mine, strict=True):
        gap = own[None, :] - theirs
        value = (gap * gap // theirs).sum(axis=1)
        rest = [k for k, other in enumerate(others) if other != name]
        of += [name] * len(rest)
        items += [others[k] for k in rest]
        values += value[rest].tolist()
    return pa.table({"lang": pa.array([lang] * len(of), pa.string()), "source": pa.array(of, pa.string()), "item": pa.array(items, pa.string()), "value": pa.array(values, pa.int64())})
