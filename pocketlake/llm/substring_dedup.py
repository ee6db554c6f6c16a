"""Repeated passages through prefix-partitioned suffix trees over words.

A suffix is the text from some word on. A window that also starts in a document with a lesser key is a deep place of the suffix tree of
all documents: an inner node at the depth of ``window`` words or more. No window asks for more depth, so suffixes are cut after
``window`` words. In a tree each of the first eight words is a symbol of eight bits and branches; the edge from there to the full depth is a
64-bit hash of all its words.

Suffixes are split by prefixes of one to eight words, longer where there are more suffixes, so that each group fits a task's memory; a group
builds its subtree by sorting and by the common prefixes of neighbours. A prefix of eight words that is still too frequent is split by
that hash, which is what tells its longer prefixes apart.

Before that, most suffixes are found to stand alone: the least hash of the sequences of ``ANCHOR`` words in a window is the same in every
copy of the window, so only windows whose least hash stands in two documents become suffixes. In both steps a task sends each distinct value once
and settles repetitions among its own documents itself, so a passage that stands everywhere is sent once by each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import each_body, low_hash

WINDOW = 13
#: Words of the sequences whose least hash stands for a window.
ANCHOR = 7
#: Words a task looks at together, and suffixes that a group is meant to hold.
WORDS_AT_ONCE = 1_000_000
SUFFIXES_PER_GROUP = 2_000_000
#: Documents, and their suffixes at most, that show which prefixes are frequent. They decide where work is done, never what is found.
PLAN_DOCUMENTS, PLAN_SUFFIXES = 2_000, 200_000
#: First bytes of a compressed text; no UTF-8 text has the last two.
FRAME = b"\x28\xb5\x2f\xfd"
#: Stands for a null key: greater than all others.
NO_KEY = (1 << 63) - 1
_random = np.random.default_rng(12)
_FACTORS = _random.integers(0, 1 << 63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def packed_texts(docs: DataFrame) -> DataFrame:
    """(key, body): texts compressed one by one, for their way through an exchange."""

    @F.arrow_udf(T.BinaryType())
    def pack(bodies: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return pa.array([squeeze(b) for b in each_body(bodies)], pa.binary())

    return docs.select("key", pack(F.col("text").cast("binary")).alias("body"))


def opened(body: bytes) -> bytes:
    """A text as it was before ``packed_texts``; text as such is left as it is, for its first bytes are never those of a frame."""
    return zstandard.ZstdDecompressor().decompress(body) if body[:4] == FRAME else body


def rolling(hashes: np.ndarray, words: int) -> np.ndarray:
    """A 64-bit hash of each sequence of ``words`` words."""
    n = max(0, len(hashes) - words + 1)
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total += hashes[k : k + n] * _FACTORS[k % 4096]
    return total


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window the least hash, of 48 bits, of the short sequences in it."""
    short = min(ANCHOR, window)
    mixed = rolling(hashes, short)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)
    n = max(0, len(hashes) - window + 1)
    least = mixed[:n].copy()
    for k in range(1, window - short + 1):
        np.minimum(least, mixed[k : k + n], out=least)
    return least.view(np.int64)


def symbols(hashes: np.ndarray, window: int) -> np.ndarray:
    """The first words of each window, eight at most, as a number of eight symbols, the first word in the highest byte; filled with zeros."""
    codes, n = hashes >> np.uint64(56), max(0, len(hashes) - window + 1)
    number = np.zeros(n, np.uint64)
    for k in range(8):
        number <<= np.uint64(8)
        if k < window:
            number |= codes[k : k + n]
    return number


def common_words(front: np.ndarray) -> np.ndarray:
    """How many symbols each number but the first shares with the one before, from the front."""
    differ = front[1:] ^ front[:-1]
    return np.sum([differ >> np.uint64(56 - 8 * k) == 0 for k in range(8)], axis=0)


def deep_nodes(front: np.ndarray, edge: np.ndarray, window: int) -> np.ndarray:
    """The number of the place at depth ``window`` below which each of the sorted suffixes lies; places with several suffixes are inner nodes."""
    deep = (common_words(front) >= min(window, 8)) & (edge[1:] == edge[:-1])
    return np.concatenate(([0], np.cumsum(~deep))) if len(edge) else np.zeros(0, np.int64)


def split(columns: list[np.ndarray], key: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct rows (columns, key) in order, and the number of the value of the columns that each has."""
    order = np.lexsort((key, *columns[::-1]))
    columns, key = [c[order] for c in columns], key[order]
    if not len(key):
        return columns, key, np.zeros(0, np.int64)
    new = np.zeros(len(key), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    own = new.copy()
    own[1:] |= key[1:] != key[:-1]
    return [c[own] for c in columns], key[own], np.cumsum(new)[own] - 1


def packed_rows(shard: np.ndarray, columns: dict[str, np.ndarray], settled: bool | None = None) -> pa.RecordBatch:
    """A row for each shard, with its values of each column as a list."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(shard)), bool), shard[1:] != shard[:-1])))
    cuts = pa.array(np.append(first, len(shard)), pa.int32())
    arrays, names = [pa.array(shard[first].astype(np.int32))], ["shard"]
    if settled is not None:
        arrays.append(pa.array(np.full(len(first), settled)))
        names.append("settled")
    arrays += [pa.ListArray.from_arrays(cuts, pa.array(c[order].view(np.int64))) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*names, *columns])


def flat(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy()


def mixed(values: np.ndarray) -> np.ndarray:
    values = values.view(np.uint64)
    return (values ^ values >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def portions(batches: Iterator[pa.RecordBatch], of: Callable[..., tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """What ``of`` gives for the words and further lists of the rows, joined with the key of each in front, for about WORDS_AT_ONCE values together."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            for key, body, *lists in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), *part.columns[2:], strict=True):
                made = of(opened(body).split(), *(x.values.to_numpy() for x in lists))
                held.append((np.full(len(made[0]), key, np.int64), *made))
                size += len(made[0])
                if size >= WORDS_AT_ONCE:
                    yield [np.concatenate(c) for c in zip(*held, strict=True)]
                    held, size = [], 0
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


class Plan:
    """Prefixes of one to eight words, each with as many suffixes as fit a group, and the groups they make."""

    def __init__(self, sample: np.ndarray, total: float, groups: int):
        sample = np.sort(sample)
        limit = max(1.0, total / groups)
        each = total / max(1, len(sample))
        self.starts, self.prefixes, weights = [0], [0], [0.0]
        todo = [(0, len(sample), 0)]
        while todo:
            low, high, depth = todo.pop()
            if (high - low) * each > limit and depth < 8:
                # One word more: a part for each next symbol, the first to be done first.
                symbol = sample[low:high] >> np.uint64(56 - 8 * depth) & np.uint64(255)
                cuts = [low, *(low + 1 + np.flatnonzero(symbol[1:] != symbol[:-1])).tolist(), high]
                todo += [(a, b, depth + 1) for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True)]
                continue
            if low == high:
                continue
            start = int(sample[low]) >> (64 - 8 * depth) << (64 - 8 * depth) if depth else 0
            if weights[-1] + (high - low) * each > limit and weights[-1]:
                self.starts.append(start)
                self.prefixes.append(depth)
                weights.append(0.0)
            weights[-1] += (high - low) * each
        self.starts = np.array(self.starts, np.uint64)
        self.parts = np.maximum(1, np.ceil(np.array(weights) / limit - 0.5)).astype(np.int64)
        self.first = np.cumsum(self.parts) - self.parts

    def group(self, front: np.ndarray, edge: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.starts, front, "right") - 1
        return self.first[at] + (mixed(edge) % self.parts[at].astype(np.uint64)).astype(np.int64)


def marks(docs: DataFrame, small: DataFrame, window: int) -> DataFrame:
    """(key, marks): for the documents with repeated passages, the hashes of the windows that also start in a document with a lesser key.

    ``docs`` has (key, text) without nulls, ``small`` (key, body) with the texts compressed.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    words = size / 6
    shards = int(max(2 * tasks, words // SUFFIXES_PER_GROUP))

    # 1. Windows that may repeat.
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(words: list[bytes]) -> tuple[np.ndarray]:
            return (np.unique(anchors(word_hashes(words), window)),)

        for key, least in portions(batches, of):
            (least,), key, value = split([least], key)
            several = np.bincount(value)[value] > 1
            yield packed_rows(mixed(key[several]) % np.uint64(shards), {"value": least[several], "key": key[several]}, True)
            once = np.concatenate((np.ones(min(1, len(value)), bool), value[1:] != value[:-1]))
            yield packed_rows(mixed(least[once]) % np.uint64(shards), {"value": least[once], "key": key[once]}, False)

    def repeated(table: pa.Table) -> pa.Table:
        settled = table.filter(table.column("settled"))
        rest = table.filter(pc.invert(table.column("settled")))
        (least,), key, value = split([flat(rest, "value")], flat(rest, "key"))
        several = np.bincount(value, minlength=1)[value] > 1
        least, key = np.concatenate((flat(settled, "value"), least[several])), np.concatenate((flat(settled, "key"), key[several]))
        return pa.Table.from_batches([packed_rows(mixed(key) % np.uint64(shards), {"value": least, "key": key})])

    sent = docs.select("key", F.col("text").cast("binary").alias("text"))
    packed = "shard int, settled boolean, value array<long>, key array<long>"
    found = sent.mapInArrow(candidates, packed).groupBy("shard").applyInArrow(repeated, "shard int, value array<long>, key array<long>")
    seen = found.groupBy("shard").applyInArrow(by_key, "key long, value array<long>")

    # 2. Groups of their suffixes by prefixes.
    plan = plan_of(docs, rows, words, window, shards)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(words: list[bytes], wanted: np.ndarray) -> tuple[np.ndarray, ...]:
            hashes = word_hashes(words)
            there = np.isin(anchors(hashes, window), wanted)
            return symbols(hashes, window)[there], rolling(hashes, window)[there]

        for key, front, edge in portions(batches, of):
            (front, edge), key, node = split([front, edge], key)
            first = np.concatenate((np.ones(min(1, len(node)), bool), node[1:] != node[:-1]))
            for rows_, of_group, settled in ((~first, mixed(key[~first]) % np.uint64(shards), True), (first, plan.group(front[first], edge[first]), False)):
                yield packed_rows(of_group, {"front": front[rows_] * np.uint64(not settled), "edge": edge[rows_], "key": key[rows_]}, settled)

    def subtree(table: pa.Table) -> pa.Table:
        settled = table.filter(table.column("settled"))
        rest = table.filter(pc.invert(table.column("settled")))
        (front, edge), key, _ = split([flat(rest, c).view(np.uint64) for c in ("front", "edge")], flat(rest, "key"))
        node = deep_nodes(front, edge, window)
        # Sorted by key within a node: all but the first stand in a document with a lesser key as well.
        later = np.concatenate((np.zeros(min(1, len(node)), bool), node[1:] == node[:-1]))
        value = np.concatenate((flat(settled, "edge"), edge[later].view(np.int64)))
        key = np.concatenate((flat(settled, "key"), key[later]))
        return pa.Table.from_batches([packed_rows(mixed(key) % np.uint64(shards), {"value": value, "key": key})])

    lists = "front array<long>, edge array<long>, key array<long>"
    chosen = small.join(seen, "key").select("key", "body", "value")
    trees = chosen.mapInArrow(suffixes, f"shard int, settled boolean, {lists}").groupBy("shard").applyInArrow(subtree, "shard int, value array<long>, key array<long>")
    return trees.groupBy("shard").applyInArrow(by_key, "key long, value array<long>").withColumnRenamed("value", "marks")


def by_key(table: pa.Table) -> pa.Table:
    """A row for each key with its distinct values."""
    (key,), value, number = split([flat(table, "key")], flat(table, "value"))
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(number)), bool), number[1:] != number[:-1])))
    cuts = pa.array(np.append(first, len(number)), pa.int32())
    return pa.table({"key": pa.array(key[first]), "value": pa.ListArray.from_arrays(cuts, pa.array(value))})


def plan_of(docs: DataFrame, rows: int, words: float, window: int, groups: int) -> Plan:
    """Groups of prefixes by a bounded sample of documents."""
    chosen = docs.filter(low_hash("key", PLAN_DOCUMENTS, rows)).select("key", F.col("text").cast("binary").alias("text"))
    part = min(1.0, PLAN_SUFFIXES / max(1.0, words * min(1.0, 4 * PLAN_DOCUMENTS / max(1, rows))))

    def fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            hashes = word_hashes(words)
            return symbols(hashes, window), mixed(rolling(hashes, window))

        for _, front, number in portions(batches, of):
            yield pa.RecordBatch.from_arrays([pa.array(front[number < np.uint64(part * (1 << 31))].view(np.int64))], names=["front"])

    sample = chosen.mapInArrow(fronts, "front long").toPandas()["front"].to_numpy(np.int64)
    return Plan(sample.view(np.uint64), words, groups)


def covered(words: list[bytes], marked: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window whose hash is among the marks."""
    edges = np.zeros(len(words) + 1, np.int64)
    if len(marked) and len(words) >= window:
        there = np.flatnonzero(np.isin(rolling(word_hashes(words), window).view(np.int64), marked))
        edges[there] += 1
        np.subtract.at(edges, there + window, 1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, kept, removed): the words that stay, joined by spaces, and the spans [begin, end) of the words that go.

    A word goes if it lies in a window of ``window`` consecutive words (white space of ASCII parts words) that also starts in a document
    with a lesser key; windows are those of the input. The key is an integer column. A null key comes after all others; rows with equal
    keys are parts of one document and take nothing from each other. Null and empty texts have no words. Repeated rows stay
    repeated. A document is held whole by a task. Other columns are left out. An empty table gives no rows.
    """
    kind = docs.schema[key].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{key} is not an integer column")
    plain = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Both joins with the texts read the same exchange.
    small = packed_texts(plain)
    joined = small.join(marks(plain, small, window), "key", "left")
    names = ["_n_words", "_kept", "_removed"]
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("key", T.LongType()), *(T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.StringType(), T.ArrayType(span)), strict=True))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n_words, kept, removed = [], [], []
                for body, marked in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    words = opened(body).split()
                    n_words.append(len(words))
                    if not marked.is_valid:
                        kept.append(b" ".join(words))
                        removed.append([])
                        continue
                    gone = covered(words, marked.values.to_numpy(), window)
                    kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
                    turns = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).reshape(-1, 2).tolist()
                    removed.append([{"begin": a, "end": b} for a, b in turns])
                arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(removed, spans)]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", *names])

    made = joined.select("key", "body", "marks").mapInArrow(apply, schema)
    back = F.when(F.col("key") != NO_KEY, F.col("key")).cast(kind).alias(key)
    return made.select(back, *(F.col(n).alias(n.lstrip("_")) for n in names))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of ``remove_repeats``."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return remove_repeats(docs, key, text, window).select(key, "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
