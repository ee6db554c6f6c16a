"""SimHash near-duplicates through a vantage-point tree.

Fingerprints are 64 majority bits over word shingles. Equal fingerprints are one node. Nodes are partitioned by a
vantage-point tree: an inner node of the tree holds a fingerprint and a radius, nearer fingerprints go left, the others
right. The tree's upper part is laid over a bounded sample, so it has a bounded number of leaves; every node has one home
leaf. By the triangle inequality a fingerprint within ``distance`` of a node can only lie in leaves whose bounds the node's
ball touches, so a node also visits those leaves (only later ones than its home: each pair is met once). Inside a leaf
the tree is continued over the leaf's own nodes, and pairs are compared exactly in its small leaves.

A leaf's task sends on a spanning forest, never all pairs; the forests are joined by contracting edges to the least
neighbour until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pocketlake.runtime import freeze

from .shared import each_body, fresh, low_hash

WORDS = 3
DISTANCE = 2
#: Fingerprints that the upper tree is laid over at most, and how many of all fingerprints a leaf is meant to hold.
SAMPLE = 16_384
NODES_PER_LEAF = 8_192
#: Fingerprints of a leaf that one task compares at most with the leaf; beyond that the queries of the leaf are dealt out.
QUERIES_PER_TASK = 200_000
#: Size up to which all pairs of a small leaf are compared.
SMALL = 96


def shingle_hashes(body: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles in order; of all words if there are not more than ``words``; none without words."""
    tokens = (body or b"").lower().split()
    text = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(text, 42)] if tokens else [], np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(tokens) - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    hash_of = xxhash.xxh64_intdigest
    return np.array([hash_of(text[i:j], 42) for i, j in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(body: bytes | None, words: int = WORDS) -> int:
    """Majority bits of the hashes of the word shingles, as an unsigned number; 0 without words."""
    return majority(shingle_hashes(body, words))


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: str, words: int = WORDS) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.arrow_udf(T.LongType())
    def of(bodies: pa.Array) -> pa.Array:
        made = np.array([fingerprint(b, words) for b in each_body(bodies)], np.uint64)
        return pa.array(made.view(np.int64))

    return of(F.col(text).cast("binary"))


def distances(values: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ point)


class UpperTree:
    """The part of the tree above the leaves: arrays of vantage points, radii and children; a child below 0 is leaf ``-1 - child``."""

    def __init__(self, sample: np.ndarray, per_leaf: int, distance: int):
        self.points: list[np.uint64] = []
        self.radii: list[int] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.distance = distance
        self.root = self._grow(np.unique(sample), per_leaf)

    def _grow(self, values: np.ndarray, per_leaf: int) -> int:
        split = split_by_vantage(values) if len(values) > per_leaf else None
        if split is None:
            self.leaves += 1
            return -self.leaves
        point, radius, near = split
        at = len(self.points)
        self.points.append(point)
        self.radii.append(radius)
        self.children.append([0, 0])
        self.children[at] = [self._grow(values[near], per_leaf), self._grow(values[~near], per_leaf)]
        return at

    def visits(self, values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, places of the values that touch it, whether it is their home)."""
        todo = [(self.root, np.arange(len(values)), np.ones(len(values), bool))]
        while todo:
            node, places, home = todo.pop()
            if not len(places):
                continue
            if node < 0:
                yield -1 - node, places, home
                continue
            d = distances(values[places], self.points[node]).astype(np.int64)
            radius = self.radii[node]
            for child, own, touches in (
                (self.children[node][0], d <= radius, d <= radius + self.distance),
                (self.children[node][1], d > radius, d > radius - self.distance),
            ):
                todo.append((child, places[touches], (home & own)[touches]))


def split_by_vantage(values: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage point, a radius near the median distance, and who is within it; nothing if no radius splits."""
    for point in (values[0], values[-1], values[len(values) // 2]):
        d = distances(values, point)
        radius = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        near = d <= radius
        if near.all():
            radius -= 1
            near = d <= radius
        if near.any():
            return point, radius, near
    return None


class Forest:
    """Union by least index with path halving."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def roots(self, places: np.ndarray) -> np.ndarray:
        at = self.parent[places]
        while not np.array_equal(at, up := self.parent[at]):
            at = up
        self.parent[places] = at
        return at

    def join(self, one: np.ndarray, other: np.ndarray) -> None:
        """Unite pairs of places. Pairs that are together already cost no Python."""
        while len(one):
            a, b = self.roots(one), self.roots(other)
            apart = a != b
            one, other, a, b = one[apart], other[apart], a[apart], b[apart]
            if not len(a):
                return
            low, high = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((low, high))
            first = np.concatenate(([True], high[order][1:] != high[order][:-1]))
            self.parent[high[order][first]] = low[order][first]


def link_within(values: np.ndarray, query: np.ndarray, index: np.ndarray, distance: int, forest: Forest) -> None:
    """Unite every query place with every index place at most ``distance`` away, by a vantage-point tree over both."""
    todo = [(query, index)]
    while todo:
        asked, held = todo.pop()
        if not len(asked) or not len(held):
            continue
        split = None if len(held) <= SMALL else split_by_vantage(values[held])
        if split is None:
            step = max(1, (1 << 22) // len(held))
            for at in range(0, len(asked), step):
                part = asked[at : at + step]
                i, j = np.nonzero(np.bitwise_count(values[part][:, None] ^ values[held][None, :]) <= distance)
                forest.join(part[i], held[j])
            continue
        point, radius, near = split
        d = distances(values[asked], point).astype(np.int64)
        todo.append((asked[d <= radius + distance], held[near]))
        todo.append((asked[d > radius - distance], held[~near]))


def near_edges(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): edges of spanning forests that connect all of the distinct longs in ``nodes.fp`` within ``distance`` bits."""
    nodes = freeze(nodes.select("fp"))
    # A bounded sample in the order of a hash; the tree that comes of it decides the work, never the result.
    count = nodes.count()
    sample = nodes.filter(low_hash("fp", SAMPLE, count)).orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE)
    sample = sample.toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    per_leaf = max(16, len(sample) * NODES_PER_LEAF // max(1, count))
    tree = UpperTree(sample, per_leaf, distance)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            leaf, place, home = [], [], []
            for number, places, own in tree.visits(values):
                leaf.append(np.full(len(places), number))
                place.append(places)
                home.append(own)
            if not leaf:
                continue
            leaf, place, home = map(np.concatenate, (leaf, place, home))
            own_leaf = np.zeros(len(values), np.int64)
            own_leaf[place[home]] = leaf[home]
            keep = leaf >= own_leaf[place]
            arrays = [values[place[keep]].view(np.int64), leaf[keep], home[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["fp", "leaf", "home"])

    routed = freeze(nodes.mapInArrow(route, "fp long, leaf long, home boolean"))
    # Rows of a leaf are dealt to as many tasks as its size asks for; the leaf's own nodes go to each of them.
    dealt = routed.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES_PER_TASK).cast("int").alias("_deals"))
    rows = routed.join(dealt, "leaf")
    asked = rows.select("leaf", F.pmod(F.xxhash64("fp"), F.col("_deals")).cast("int").alias("deal"), "fp", "home", F.lit(True).alias("asks"))
    held = rows.filter("home AND _deals > 1").select("leaf", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1)).alias("deal"), "fp", "home", F.lit(False).alias("asks"))

    def link(table: pa.Table) -> pa.Table:
        values = table.column("fp").to_numpy().view(np.uint64)
        home, asks = table.column("home").to_numpy(), table.column("asks").to_numpy()
        values, at = np.unique(values, return_inverse=True)
        held_set, asked_set = np.zeros(len(values), bool), np.zeros(len(values), bool)
        held_set[at[home]] = True
        asked_set[at[asks]] = True
        forest = Forest(len(values))
        link_within(values, np.flatnonzero(asked_set), np.flatnonzero(held_set), distance, forest)
        root = forest.roots(np.arange(len(values)))
        moved = np.flatnonzero(root != np.arange(len(values)))
        return pa.table({"a": values[moved].view(np.int64), "b": values[root[moved]].view(np.int64)})

    return asked.unionByName(held).groupBy("leaf", "deal").applyInArrow(link, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(fp, label): the least node reachable from each node that has an edge, by contraction to the least neighbour.

    Each round replaces every edge by one to the least neighbour seen from either end (large star, then small star);
    at the end each node points straight at its label. The number of rounds grows with the logarithm of the component.
    """
    edges = freeze(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select("a", F.col("_m").alias("b")))
        new = freeze(small.filter("a <> b").distinct())
        # Settled when every node has one edge and no label has an edge of its own.
        loose = new.groupBy("a").count().filter("count > 1").select("a").unionByName(new.select(F.col("b").alias("a")).join(new.select("a"), "a", "left_semi"))
        edges = new
        if loose.isEmpty():
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("label"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """(key, fingerprint, component_id): fingerprint as 16 hex digits and the least key among the documents reachable.

    Documents link when their fingerprints differ in at most ``distance`` bits. Null and empty texts have fingerprint 0 and
    link like any other. A null key never becomes a component's number; a component of null keys only has number null.
    Repeated rows stay repeated. Other columns are left out.
    """
    marked = freeze(docs.select(key, fingerprint_column(text, words).alias("fp")))
    labels = fingerprint_components(marked, distance)
    named = marked.groupBy("fp").agg(F.min(key).alias("_least")).join(labels, "fp", "left")
    named = named.withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("_least").alias("component_id"))
    numbered = named.select("fp", "label").join(least, "label").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return marked.join(numbered, "fp").select(key, digits, "component_id")


def fingerprint_components(marked: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, label) for the fingerprints that have a neighbour."""
    return components(near_edges(marked.select("fp").distinct(), distance))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` with one row for each component: that of the least key (null keys last), all columns as they are.

    Of repeated rows with the same key in one component any one stays.
    """
    marked = freeze(docs.select(F.col(key).alias("_key"), fingerprint_column(text, words).alias("fp")))
    labels = fingerprint_components(marked, distance)
    return keep_least(docs, key, fingerprint_column(text, words), marked, labels)


def keep_least(docs: DataFrame, key: str, node: Column, marked: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row for each component; ``marked`` has (_key, fp) of each row, fp being what ``node`` gives for it."""
    nodes = marked.groupBy("fp", "_key").agg(F.lit(1).alias("_n")).join(labels, "fp", "left")
    nodes = nodes.withColumn("label", F.coalesce("label", "fp"))
    # The least key, and of its texts in the component the least fingerprint: a row per component that a task has summed up before it is sent.
    best = nodes.groupBy("label").agg(F.min(F.struct(F.col("_key").isNull().alias("no_key"), F.col("_key"), F.col("fp"))).alias("best"))
    fp, name, nth, mine = (fresh(docs, n) for n in ("fp", "name", "nth", "mine"))
    # A null key gets a name of its own, so that an ordinary equality joins it.
    named = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null"))
    chosen = best.select(F.col("best.fp").alias(fp), F.col("best._key").alias(key)).select(fp, named.alias(name), F.lit(True).alias(mine))
    tagged = docs.withColumns({fp: node, name: named})
    kept = tagged.join(chosen, [fp, name])
    # Repeated rows: the join has put them side by side already.
    order = Window.partitionBy(fp, name).orderBy(fp)
    return kept.withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1).select(*docs.columns)
