"""Best-fit packing planned on the histogram of lengths.

1. Every whole text is encoded once; documents longer than a sequence are cut into pieces of which only the first may be
   short. A task numbers its pieces within each length, so no ranking shuffle is needed later.
2. The plan sees counts only: best-fit decreasing over at most ``capacity`` lengths. Bins in the same state form one run
   of sequence numbers, so the plan has a row per (length, run), whatever the number of documents.
3. Pieces take their slots by rank within length: the ranks of a task start where those of the tasks before it end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pocketlake.runtime import freeze

from .bpe import codec, piece_crc
from .shared import BYTE_BPE, field

CAPACITY = 1024
END_ID = 2


def cut_pieces(docs: DataFrame, key: str, text: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """(key, piece, start, length, ids_crc32, _part, _nth): pieces in order, numbered within their task and length."""
    end = np.array([end_id], "<u4").tobytes()
    extra = ["piece int", "start long", "length long", "ids_crc32 long", "_part int", "_nth long"]
    schema = T.StructType([field(docs, key), *T.StructType.fromDDL(", ".join(extra)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = codec(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                owner, rows = [], []
                for i, body in enumerate(batch.column(1).slice(at, 1000).to_pylist()):
                    ids = encoder.encode(body) + end
                    total = len(ids) // 4
                    start, length = 0, (total - 1) % capacity + 1
                    for piece in range((total - 1) // capacity + 1):
                        owner.append(at + i)
                        rows.append((piece, start, length, piece_crc(ids, start, length), part, int(seen[length])))
                        seen[length] += 1
                        start, length = start + length, capacity
                keys = batch.column(0).take(pa.array(owner, pa.int64()))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([keys, *made], names=schema.names)

    return docs.select(key, F.col(text).cast("binary").alias("_body")).mapInArrow(run, schema)


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots by counts: rows (length, first rank, items per sequence, first sequence, first offset), ranks ascending per length.

    Items of one length go to the fullest open sequences that still take them, longest lengths first. The item of
    rank r in a row stands in sequence ``first + (r - first rank) // items``.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # free tokens -> runs (first sequence, sequences)
    sequences = 0
    for length in sorted((n for n, c in histogram.items() if c > 0), reverse=True):
        left, rank = histogram[length], 0

        def place(free: int, first: int, count: int, length: int = length) -> int:
            """Fill a run of ``count`` sequences; returns how many it used. The rest goes back unchanged."""
            nonlocal left, rank
            each = free // length
            full = min(count, left // each)
            used = full
            if full:
                plan.append((length, rank, each, first, capacity - free))
                room[free - each * length].append((first, full))
                rank, left = rank + full * each, left - full * each
            if left and full < count:
                plan.append((length, rank, left, first + full, capacity - free))
                room[free - left * length].append((first + full, 1))
                rank, left, used = rank + left, 0, full + 1
            return used

        for free in range(length, capacity + 1):
            runs, room[free] = room[free], []
            for first, count in runs:
                used = place(free, first, count) if left else 0
                if used < count:
                    room[free].append((first + used, count - used))
        if left:
            each = capacity // length
            count = -(-left // each)
            place(capacity, sequences, count)
            sequences += count
    return plan


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str = BYTE_BPE,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset): every piece and its place in a sequence of ``capacity``.

    Null texts count as empty: one piece that holds ``end_id``. Null keys and repeated rows are packed like any other
    row; an empty table gives no rows. Which of several pieces of a length takes which slot is left open.
    """
    pieces = freeze(cut_pieces(docs, key, text, path, capacity, end_id))
    held = pieces.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = held.withColumn("_begin", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # At most `capacity` rows reach the driver.
    histogram = {r[0]: r[1] for r in held.groupBy("length").agg(F.sum("_n")).collect()}
    rows = np.array(plan_best_fit(histogram, capacity), np.int64).reshape(-1, 5)
    ranked = pieces.join(begins, ["length", "_part"]).withColumn("_rank", F.col("_begin") + F.col("_nth"))
    schema = T.StructType([*ranked.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    # Rows of the plan sorted by (length, first rank): one number orders both.
    span = int(max(histogram.values(), default=0)) + 1
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    keys = rows[:, 0] * span + rows[:, 1]

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "_rank"))
            row = rows[np.searchsorted(keys, length * span + rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence = row[:, 3] + nth // row[:, 2]
            offset = row[:, 4] + nth % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], names=schema.names)

    placed = ranked.mapInArrow(slots, schema)
    return placed.select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
