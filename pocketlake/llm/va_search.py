"""Exact top-k by inner product over a vector-approximation file.

Every component is quantised to one of ``2**BITS`` cells between the least and the largest value of its dimension; a block of
the file keeps the cell numbers of its vectors beside the exact integers. For a query, the corners of a vector's cells bound its
inner product from below and above.

* First pass: every block bounds all of its vectors and sends the ``k`` best lower bounds; the ``k``-th best of all blocks is
  a score that the answer reaches for certain.
* Second pass: a block reads exact vectors in the order of their upper bounds, until the next bound falls below that score
  or below the block's own ``k``-th exact score, and sends its ``k`` best.

Queries are packed into blocks too, and each (vector block, query block) is a task of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pocketlake.runtime import freeze

BITS = 5
#: Vectors and queries in a block.
VECTOR_BLOCK, QUERY_BLOCK = 4_096, 256


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int, query: Column) -> DataFrame:
    """(key, asks, v): vectors as floor(scale * x); those null, empty, or with a null or non-finite component are left out."""
    values = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = F.col(vector).isNotNull() & (F.size(vector) > 0) & finite
    whole = F.transform(values, lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    return df.filter(good).select(F.col(key).cast("long").alias("key"), F.coalesce(query, F.lit(False)).alias("asks"), whole.alias("v"))


def pack_blocks(rows: DataFrame, limits: dict[int, tuple[np.ndarray, np.ndarray]], size: int) -> DataFrame:
    """(block, dims, keys, known, nos, cells, v): up to ``size`` vectors of one length, packed; longs are little-endian.

    ``known`` tells real keys from null ones, ``cells`` holds a byte per component.
    """
    names = ["block", "dims", "keys", "known", "nos", "cells", "v"]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict[int, list] = {}
        made = 0

        def block(dims: int) -> pa.RecordBatch:
            nonlocal made
            keys, known, numbers, vectors = zip(*held.pop(dims), strict=True)
            exact = np.array(vectors, "<i8")
            made += 1
            packed = [np.array(keys, "<i8"), np.array(known, bool), np.array(numbers, "<i8"), cells_of(exact, *limits[dims]), exact]
            values = [(part << 32) + made, dims, *[x.tobytes() for x in packed]]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("key", "no", "v"))
            for key, number, v in zip(*columns, strict=True):
                held.setdefault(len(v), []).append((key or 0, key is not None, number, v))
                if len(held[len(v)]) == size:
                    yield block(len(v))
        for dims in list(held):
            yield block(dims)

    return rows.mapInArrow(run, "block long, dims int, keys binary, known binary, nos binary, cells binary, v binary")


def cell_width(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whole numbers, so that a cell's corners are its least and largest integers."""
    return np.maximum(1.0, np.ceil((high - low + 1) / (1 << BITS)))


def cells_of(exact: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.clip((exact - low) // cell_width(low, high), 0, (1 << BITS) - 1).astype(np.uint8)


class VectorBlock:
    """A block of the file: the corners of its cells and, in the second pass, exact vectors."""

    def __init__(self, row: dict, low: np.ndarray, high: np.ndarray):
        dims = row["dims"]
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.known = np.frombuffer(row["known"], bool)
        self.numbers = np.frombuffer(row["nos"], "<i8")
        self.exact = np.frombuffer(row["v"], "<i8").reshape(-1, dims) if "v" in row else None
        width = cell_width(low, high)
        self.near = low + np.frombuffer(row["cells"], np.uint8).reshape(-1, dims) * width
        self.far = self.near + width - 1

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of the inner products, a row per query; widened by what rounding can cost."""
        up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
        lower = up @ self.near.T + down @ self.far.T
        upper = up @ self.far.T + down @ self.near.T
        largest = np.maximum(np.abs(self.near), np.abs(self.far)).max(axis=1)
        slack = np.abs(queries).sum(axis=1, dtype=float)[:, None] * largest[None, :] * (queries.shape[1] * 2.0**-50)
        return lower - slack, upper + slack


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return vectors @ query


def search(
    df: DataFrame,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    query: Column | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of every query, by score, then by smaller key.

    ``query`` says which rows ask (default: key divisible by 100); a row is never its own candidate, a repeated row is.
    Vectors that are null, empty, or hold a null or non-finite component take no part; pairs of unequal length are not
    compared. A null key asks nothing and comes last in ties. Scores are 64-bit. Other columns are left out.
    """
    query = F.col(key) % 100 == 0 if query is None else query
    rows = freeze(integer_vectors(df, key, vector, scale, query).withColumn("no", F.monotonically_increasing_id()))
    # One row per dimension of each vector length.
    ranges = rows.select(F.size("v").alias("dims"), F.posexplode("v").alias("at", "x")).groupBy("dims", "at").agg(F.min("x"), F.max("x"))
    corners: dict[int, dict[int, tuple[int, int]]] = {}
    for dims, at, low, high in ranges.collect():
        corners.setdefault(dims, {})[at] = (low, high)
    limits = {d: tuple(np.array([by[i][j] for i in range(d)], float) for j in (0, 1)) for d, by in corners.items()}
    asks = rows.filter("asks")
    queries = freeze(pack_blocks(asks.repartition(asks.count() // QUERY_BLOCK + 1), limits, QUERY_BLOCK))
    vectors = freeze(pack_blocks(rows, limits, VECTOR_BLOCK))
    # Blocks, not rows, meet: a pair is VECTOR_BLOCK x QUERY_BLOCK comparisons, done by one matrix product.
    asked = queries.select("dims", F.col("block").alias("q_block"), F.col("keys").alias("q_keys"), F.col("nos").alias("q_nos"), F.col("v").alias("q_v"))
    pairs = vectors.join(asked, "dims").repartition("block", "q_block")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block, q, _, numbers = opened(row, limits)
            lower, _ = block.bounds(q)
            lower[numbers[:, None] == block.numbers[None, :]] = -np.inf
            top = -np.partition(-lower, min(k, lower.shape[1]) - 1, axis=1)[:, :k] if lower.shape[1] > k else lower
            asks, bound = np.repeat(numbers, top.shape[1]), top.ravel()
            real = np.isfinite(bound)
            yield pa.RecordBatch.from_arrays([pa.array(asks[real]), pa.array(bound[real])], names=["no", "bound"])

    best = Window.partitionBy("no").orderBy(F.desc("bound"))
    sure = pairs.drop("v").mapInArrow(first, "no long, bound double").withColumn("nth", F.row_number().over(best)).filter(F.col("nth") == k)
    # Thresholds go back to the query block that they belong to.
    home = queries.mapInArrow(numbers_of, "no long, q_block long")
    sure = home.join(sure.select("no", "bound"), "no").groupBy("q_block").agg(F.collect_list(F.struct("no", "bound")).alias("sure"))
    pairs = pairs.join(sure, "q_block", "left")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block, q, keys, numbers = opened(row, limits)
            known = {s["no"]: s["bound"] for s in row["sure"] or []}
            _, upper = block.bounds(q)
            out = []
            for i, no in enumerate(numbers):
                out += [(int(keys[i]), int(no), *r) for r in read_in_order(block, q[i], upper[i], no, known.get(int(no), -np.inf), k)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "no", "vec_id", "score"])

    found = pairs.mapInArrow(second, "query_id long, no long, vec_id long, score long")
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def read_in_order(block: VectorBlock, query: np.ndarray, upper: np.ndarray, own: int, sure: float, k: int) -> list[tuple[int | None, int]]:
    """The block's best ``k`` (key, score): exact vectors are read by falling upper bound until the rest cannot matter."""
    places = np.flatnonzero((upper >= sure) & (block.numbers != own))
    places = places[np.argsort(-upper[places], kind="stable")]
    taken, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = 4 * k
    for at in range(0, len(places), step):
        part = places[at : at + step]
        if len(scores) >= k and upper[part[0]] < np.partition(scores, len(scores) - k)[len(scores) - k]:
            break
        taken = np.concatenate([taken, part])
        scores = np.concatenate([scores, exact_scores(query, block.exact[part])])
    order = np.lexsort((block.keys[taken], ~block.known[taken], -scores))[:k]
    return [(int(block.keys[i]) if block.known[i] else None, int(s)) for i, s in zip(taken[order], scores[order], strict=True)]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def opened(row: dict, limits: dict) -> tuple[VectorBlock, np.ndarray, np.ndarray, np.ndarray]:
    """The vector block, the queries, their keys and their row numbers."""
    queries = np.frombuffer(row["q_v"], "<i8").reshape(-1, row["dims"])
    return VectorBlock(row, *limits[row["dims"]]), queries, np.frombuffer(row["q_keys"], "<i8"), np.frombuffer(row["q_nos"], "<i8")


def numbers_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        numbers = np.frombuffer(row["nos"], "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.full(len(numbers), row["block"]))], names=["no", "q_block"])
