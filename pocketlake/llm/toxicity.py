"""Toxicity by a small convolutional network over hashed words, trained in numpy.

A word's CRC-32 picks one row in each of two tables; the sum is its embedding, so two words share an embedding only if they
meet in both. Filters of width 1, 2 and 3 run over the sequence, each is max-pooled over the whole text, and a logistic
unit reads the pools. The first dimension of the tables is how much the bucket leans to toxic texts; the filters, the
output and (slowly) the other dimensions are trained by descent. While a text is trained on or calibrated
with, the leanings come from the other folds only, so that chance words of single texts are not learned by heart.

All labelled texts take part, dealt to shards. Counts by bucket are sums over the shards. In each epoch every shard descends from
the same network on its own texts, and the networks that come of it are averaged.

Thresholds are calibrated by language, on the scores of all labelled texts. The language is guessed from the same hashed words (what
the labelled texts show of each language's words), never read from the row.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pocketlake.plans.ordering import running
from pocketlake.runtime import freeze

from .langid import letters
from .shared import held_out, map_rows

#: Word codes and texts meant for a shard; every labelled text is in one, whole.
SHARD_CODES, SHARD_TEXTS = 4_000_000, 20_000
#: Values of a summed array that travel in one row.
BLOCK_VALUES = 4_096
BUCKETS = 1 << 16
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 2
FOLDS = 5
BATCH = 16
RATE, TABLE_RATE = 0.01, 0.002
#: Toxic documents of a language that its own threshold needs; below, the one of all languages holds.
LEAST_FOR_LANGUAGE = 50
SLOTS = [(width, place) for width in WIDTHS for place in range(width)]


class _Codes(dict):
    """CRC-32 of words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        out = self[word] = zlib.crc32(word)
        return out


def word_codes(body: bytes | None, codes: dict) -> np.ndarray:
    words = letters(body or b"").split()
    return np.fromiter(map(codes.__getitem__, words), np.uint32, len(words))


def buckets(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the two tables. Rows of zeros are appended, so that every filter has a place to stand on."""
    code = code.astype(np.uint64)
    one = (code % BUCKETS).astype(np.int64)
    other = ((code * np.uint64(2654435761)) >> np.uint64(13)).astype(np.int64) % BUCKETS
    pad = np.full(max(WIDTHS), BUCKETS)
    return np.concatenate([one, pad]), np.concatenate([other, pad])


@dataclass
class Network:
    """Tables (with a last row of zeros), filters by (width, place), biases, output; language leanings and thresholds."""

    tables: list[np.ndarray]
    filters: np.ndarray
    bias: np.ndarray
    output: np.ndarray
    base: float
    languages: tuple[str, ...]
    leanings: list[np.ndarray]
    thresholds: np.ndarray
    common_threshold: float

    def projected(self) -> list[np.ndarray]:
        """Each table through all filters, beside its language leanings: one gather then serves a word."""
        flat = self.filters.transpose(1, 0, 2).reshape(DIMENSIONS, -1)
        return [np.hstack([t @ flat, lean]).astype(np.float32) for t, lean in zip(self.tables, self.leanings, strict=True)]

    def logit(self, pools: np.ndarray) -> float:
        return float(np.maximum(pools + self.bias, 0) @ self.output + self.base)

    def pools(self, gathered: np.ndarray) -> np.ndarray:
        """Maxima over all places of a text, from the projected rows of its words; long texts go block by block."""
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        n = len(gathered)
        for k, width in enumerate(WIDTHS):
            first = SLOTS.index((width, 0)) * FILTERS
            total = gathered[: n - width + 1, first : first + FILTERS]
            for place in range(1, width):
                at = first + place * FILTERS
                total = total + gathered[place : n - width + 1 + place, at : at + FILTERS]
            best[k * FILTERS : (k + 1) * FILTERS] = total.max(axis=0)
        return best


class Scorer:
    """Scores whole texts with a trained network."""

    BLOCK = 50_000

    def __init__(self, network: Network):
        self.network, self.codes = network, _Codes()
        self.one, self.other = network.projected()

    def raw(self, code: np.ndarray) -> tuple[float, int]:
        """(log-odds, place of the guessed language or -1)."""
        net = self.network
        rows, others = buckets(code)
        pools, lean = None, np.zeros(len(net.languages))
        width = len(SLOTS) * FILTERS
        overlap = max(WIDTHS) - 1
        for at in range(0, max(1, len(rows) - overlap), self.BLOCK):
            block = slice(at, at + self.BLOCK + overlap)
            gathered = self.one[rows[block]] + self.other[others[block]]
            found = net.pools(gathered)
            pools = found if pools is None else np.maximum(pools, found)
            lean += gathered[: self.BLOCK, width:].sum(axis=0, dtype=np.float64)
        language = int(lean.argmax()) if len(code) and len(net.languages) else -1
        return net.logit(pools), language

    def __call__(self, body: bytes | None) -> tuple[float, int, str | None]:
        logit, language = self.raw(word_codes(body, self.codes))
        net = self.network
        threshold = net.thresholds[language] if language >= 0 else net.common_threshold
        score = float(1 / (1 + np.exp(-np.clip(logit - threshold, -30, 30))))
        return score, int(score >= 0.5), net.languages[language] if language >= 0 else None


@dataclass
class Shard:
    """Some of the labelled texts, in a fixed order. ``number`` tells shards apart."""

    codes: list[np.ndarray]
    labels: np.ndarray
    langs: list[str | None]
    folds: np.ndarray
    number: int = 0

    def counts(self, languages: tuple[str, ...]) -> dict[str, np.ndarray]:
        """By table and bucket: texts and toxic texts of each fold that have it, and its words in each language."""
        seen, toxic = np.zeros((2, FOLDS, BUCKETS + 1)), np.zeros((2, FOLDS, BUCKETS + 1))
        words = np.zeros((2, max(1, len(languages)), BUCKETS + 1))
        places = {lang: k for k, lang in enumerate(languages)}
        for code, label, lang, fold in zip(self.codes, self.labels, self.langs, self.folds, strict=True):
            for table, rows in enumerate(buckets(code)):
                unique, times = np.unique(rows, return_counts=True)
                seen[table, fold, unique] += 1
                toxic[table, fold, unique] += label
                if lang in places:
                    words[table, places[lang], unique] += times
        return {"seen": seen, "toxic": toxic, "words": words}

    def descended(self, net: Network, held: list[np.ndarray], share: float, seed: list[int]) -> dict[str, np.ndarray]:
        """An epoch's network times the number of texts; of the tables, what changed and the texts behind each changed row."""
        own = replace(net, tables=[t.copy() for t in net.tables], filters=net.filters.copy(), bias=net.bias.copy(), output=net.output.copy())
        _descend(own, self, held, share, np.random.default_rng([*seed, self.number]))
        n = len(self.labels)
        change = np.stack(own.tables) - np.stack(net.tables)
        touched = n * change.any(axis=2).astype(float)
        rest = np.concatenate([x.ravel() for x in (own.filters, own.bias, own.output)] + [[own.base, 1.0]])
        return {"change": n * change, "touched": touched, "rest": n * rest}

    def scored(self, net: Network, held: list[np.ndarray]) -> Iterator[tuple[int, float, float]]:
        """(place of the guessed language or -1, log-odds from the other folds, label) of each text."""
        for code, label, fold in zip(self.codes, self.labels, self.folds, strict=True):
            rows = buckets(code)
            yield _guess(net, rows), net.logit(_forward(net, rows, held[fold])[1]), float(label)


def leanings(seen: np.ndarray, toxic: np.ndarray, share: float) -> list[np.ndarray]:
    """How far each bucket's share of toxic texts stands from the common share, in standard errors, shrunk and scaled.

    ``seen`` and ``toxic`` count by fold. One list per fold, from the texts outside it, and a last one from all texts.
    """
    share = np.clip(share, 1e-3, 1 - 1e-3)
    out = []
    for without in [*range(FOLDS), None]:
        n, t = (x.sum(axis=0) - (0 if without is None else x[without]) for x in (seen, toxic))
        z = (t - n * share) / np.sqrt(n * share * (1 - share) + 1.0)
        z[BUCKETS] = 0
        out.append(np.clip(z, -6, 12) / 6)
    return out


def language_leanings(words: np.ndarray, languages: tuple[str, ...]) -> list[np.ndarray]:
    out = []
    for counts in words:
        shares = (counts.T + 0.1) / (counts.sum(axis=1) + 0.1 * BUCKETS)
        lean = np.log(shares / shares.mean(axis=1, keepdims=True)) / 2
        lean[BUCKETS] = 0
        out.append(lean[:, : len(languages)])
    return out


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The log-odds at which F1 is highest, midway to the next lower one."""
    if not len(labels) or not labels.any():
        return float(logits.max(initial=0.0)) + 1.0
    order = np.argsort(-logits, kind="stable")
    ordered, hits = logits[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(labels) + 1) + labels.sum())
    f1[:-1][ordered[:-1] == ordered[1:]] = -1
    at = int(f1.argmax())
    return float((ordered[at] + ordered[at + 1]) / 2) if at + 1 < len(ordered) else float(ordered[at]) - 1.0


def fit(summed: Callable[[Callable[[Shard], dict[str, np.ndarray]]], dict[str, np.ndarray]], share: float, languages: tuple[str, ...], seed: int) -> tuple[Network, list[np.ndarray]]:
    """A network without thresholds, and the leanings without each fold. ``summed`` gives a function's arrays summed over all shards."""
    random = np.random.default_rng(seed)
    counts = summed(lambda shard: shard.counts(languages))
    leans = [leanings(counts["seen"][table], counts["toxic"][table], share) for table in (0, 1)]
    tables = []
    for table in (0, 1):
        body = random.normal(0, 0.02, (BUCKETS + 1, DIMENSIONS))
        body[:, 0] = leans[table][FOLDS]
        body[BUCKETS] = 0
        tables.append(body)
    filters = random.normal(0, 0.1, (len(SLOTS), DIMENSIONS, FILTERS))
    filters[:, 0, :] += np.where(np.arange(FILTERS) < FILTERS // 2, 0.6, -0.3) / np.array([w for w, _ in SLOTS])[:, None]
    net = Network(
        tables, filters, np.full(len(WIDTHS) * FILTERS, -0.2), random.normal(0.2, 0.1, len(WIDTHS) * FILTERS), -2.0,
        languages, language_leanings(counts["words"], languages), np.zeros(len(languages)), 0.0,
    )
    held = [np.stack([leans[table][fold] for table in (0, 1)]) for fold in range(FOLDS)]
    for epoch in range(EPOCHS if 0 < share < 1 else 0):
        net = mixed(net, summed(lambda shard, net=net, epoch=epoch: shard.descended(net, held, share, [seed, epoch])))
    return net, held


def mixed(net: Network, sums: dict[str, np.ndarray]) -> Network:
    """The average of the shards' networks; a row of a table moves by the average of the shards that moved it."""
    change = sums["change"] / np.maximum(sums["touched"], 1)[:, :, None]
    *rest, base, _ = sums["rest"] / sums["rest"][-1]
    filters, bias, output = np.split(np.array(rest), np.cumsum([net.filters.size, net.bias.size]))
    return replace(net, tables=[t + c for t, c in zip(net.tables, change, strict=True)], filters=filters.reshape(net.filters.shape), bias=bias, output=output, base=float(base))


def train(codes: list[np.ndarray], labels: np.ndarray, langs: list[str | None], seed: int = 7) -> Network:
    """A network from labelled texts that are at hand, as one shard. Without labels of both kinds it calls nothing toxic."""
    shard = Shard(codes, labels, langs, np.arange(len(codes)) % FOLDS)
    languages = tuple(sorted({x for x in langs if x is not None}))
    net, held = fit(lambda of: of(shard), float(labels.mean()) if len(labels) else 0.0, languages, seed)
    guessed, logits, _ = np.array(list(shard.scored(net, held))).reshape(-1, 3).T
    own = {k: (best_threshold(logits[guessed == k], labels[guessed == k]), labels[guessed == k].sum()) for k in range(len(languages))}
    return calibrated(net, best_threshold(logits, labels), own)


def calibrated(net: Network, common: float, own: dict[int, tuple[float, float]]) -> Network:
    """With the threshold of all texts, and those of the languages by (threshold, toxic texts)."""
    enough = {k: at for k, (at, toxic) in own.items() if toxic >= LEAST_FOR_LANGUAGE}
    return replace(net, common_threshold=common, thresholds=np.array([enough.get(k, common) for k in range(len(net.languages))]))


def _guess(net: Network, rows: tuple[np.ndarray, np.ndarray]) -> int:
    if len(rows[0]) == max(WIDTHS) or not net.languages:
        return -1
    return int(sum(lean[r].sum(axis=0) for lean, r in zip(net.leanings, rows, strict=True)).argmax())


def _forward(net: Network, rows: tuple[np.ndarray, np.ndarray], lean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(embeddings, pools, places of the pools) with the leanings of the other folds."""
    one, other = rows
    x = net.tables[0][one] + net.tables[1][other]
    x[:, 0] = lean[0][one] + lean[1][other]
    n = len(x)
    pools, places = np.empty(len(net.bias)), np.empty(len(net.bias), np.int64)
    flat = x @ net.filters.transpose(1, 0, 2).reshape(DIMENSIONS, -1)
    for k, width in enumerate(WIDTHS):
        first = SLOTS.index((width, 0)) * FILTERS
        total = flat[: n - width + 1, first : first + FILTERS]
        for place in range(1, width):
            column = first + place * FILTERS
            total = total + flat[place : n - width + 1 + place, column : column + FILTERS]
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        places[own] = total.argmax(axis=0)
        pools[own] = total.max(axis=0)
    return x, pools, places


def _descend(net: Network, shard: Shard, held: list[np.ndarray], share: float, random: np.random.Generator) -> None:
    """An epoch of Adam on filters, biases and output, plain steps on the rows of the tables that a pool was taken from."""
    parameters = [net.filters, net.bias, net.output]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters] + [(np.zeros(1), np.zeros(1))]
    weight = np.where(shard.labels > 0, 0.5 / share, 0.5 / (1 - share))
    order = random.permutation(len(shard.labels))
    for step, at in enumerate(range(0, len(order), BATCH), 1):
        gradients = [np.zeros_like(p) for p in parameters] + [np.zeros(1)]
        for i in order[at : at + BATCH]:
            _backward(net, buckets(shard.codes[i]), held[shard.folds[i]], float(shard.labels[i]), float(weight[i]), gradients)
        for k, gradient in enumerate(gradients):
            gradient /= BATCH
            mean, square = moments[k]
            mean += 0.1 * (gradient - mean)
            square += 0.001 * (gradient**2 - square)
            move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
            if k < len(parameters):
                parameters[k] -= move
            else:
                net.base -= float(move[0])


def _backward(net: Network, rows: tuple[np.ndarray, np.ndarray], lean: np.ndarray, label: float, weight: float, gradients: list[np.ndarray]) -> None:
    one, other = rows
    x, pools, places = _forward(net, rows, lean)
    raised = np.maximum(pools + net.bias, 0)
    logit = raised @ net.output + net.base
    error = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label)
    gradients[2] += error * raised
    gradients[3] += error
    back = error * net.output * (raised > 0)
    gradients[1] += back
    for k, width in enumerate(WIDTHS):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        for place in range(width):
            slot = SLOTS.index((width, place))
            at = places[own] + place
            gradients[0][slot] += x[at].T * back[own]
            change = TABLE_RATE * back[own][:, None] * net.filters[slot].T
            change[:, 0] = 0  # the leanings stay what they are
            for table, number in ((net.tables[0], one[at]), (net.tables[1], other[at])):
                real = number < BUCKETS
                np.subtract.at(table, number[real], change[real])


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, label: str) -> DataFrame:
    """(hash, label, lang, codes) of every document outside the held-out fifth (see ``held_out``) that has a label 0 or 1; of several labels the highest."""
    own = docs.filter(~held_out(key)).select(F.col(key).alias("_doc"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("lang"))
    known = labels.filter(~held_out(key) & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("double").alias("label"))

    def pack():
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return lambda body: (squeeze(body or b""),)

    def make():
        opened, cache = zstandard.ZstdDecompressor().decompress, _Codes()
        return lambda body: (word_codes(opened(body), cache).astype("<u4").tobytes(),)

    # Texts meet their labels by a shuffle at any size, packed, so that what it writes stays in proportion.
    packed = map_rows(own, ["_doc", "lang"], "_text", [T.StructField("packed", T.BinaryType())], pack)
    found = packed.join(known.hint("merge"), F.col("_doc") == F.col("_key")).withColumn("hash", F.xxhash64("_doc"))
    return map_rows(found, ["hash", "label", "lang"], "packed", [T.StructField("codes", T.BinaryType())], make)


def held_shard(batches: Iterator[pa.RecordBatch]) -> Shard | None:
    """The rows of a task as a shard, in the order of their hashes."""
    rows = sorted((h, y, lang or "", lang is None, codes) for b in batches for h, y, lang, codes in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))
    if not rows:
        return None
    hashes, marks, langs, nulls, codes = zip(*rows, strict=True)
    folds = (np.array(hashes, np.int64).view(np.uint64) % np.uint64(FOLDS)).astype(int)
    named = [None if null else lang for lang, null in zip(langs, nulls, strict=True)]
    return Shard([np.frombuffer(c, "<u4") for c in codes], np.array(marks), named, folds, TaskContext.get().partitionId())


def sum_over(shards: DataFrame, of: Callable[[Shard], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The arrays that ``of`` gives for each shard, summed over all. They travel in blocks, without those that are zero throughout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = held_shard(batches)
        if shard is None:
            return
        for name, array in of(shard).items():
            flat = array.astype("<f8").ravel()
            for at in range(0, len(flat), BLOCK_VALUES):
                part = flat[at : at + BLOCK_VALUES]
                # The last block of an array is sent in any case, since it tells the length.
                if part.any() or at + BLOCK_VALUES >= len(flat):
                    values = [[name], [list(array.shape)], [at], [shard.number], [part.tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    def add(table: pa.Table) -> pa.Table:
        # In the order of the shards, so that rounding does not depend on which came first.
        table = table.sort_by("shard")
        total = sum(np.frombuffer(x, "<f8") for x in table.column("body").to_pylist())
        return table.slice(0, 1).drop(["body"]).append_column("body", pa.array([total.tobytes()], pa.binary()))

    kinds, names = [pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()], ["name", "shape", "at", "shard", "body"]
    schema = "name string, shape array<long>, at long, shard long, body binary"
    out: dict[str, np.ndarray] = {}
    for row in shards.mapInArrow(run, schema).groupBy("name", "at").applyInArrow(add, schema).toLocalIterator():
        flat = out.setdefault(row["name"], np.zeros(row["shape"])).reshape(-1)
        part = np.frombuffer(row["body"], "<f8")
        flat[row["at"] : row["at"] + len(part)] = part
    return out


def best_thresholds(rows: DataFrame) -> dict[int, tuple[float, float]]:
    """(threshold, toxic texts) of each guess in ``rows`` (guess, logit, label), as ``best_threshold`` gives it."""
    tied = freeze(rows.groupBy("guess", "logit").agg(F.count("*").alias("n"), F.sum("label").alias("hits")))
    totals = tied.groupBy("guess").agg(F.sum("hits").alias("toxic"), F.max("logit").alias("top"))
    curve = running(tied, [F.desc("logit")], {"upto": ("sum", F.col("n")), "found": ("sum", F.col("hits"))}, ["guess"]).join(totals, "guess")
    f1 = 2 * F.col("found") / (F.col("upto") + F.col("toxic"))
    best = freeze(curve.groupBy("guess", "toxic", "top").agg(F.max_by("logit", F.struct(f1, "logit")).alias("best")))
    lower = tied.select("guess", "logit").join(best.select("guess", "best"), "guess").filter("logit < best").groupBy("guess").agg(F.max("logit").alias("next"))
    out = {}
    for r in best.join(lower, "guess", "left").collect():
        at = max(r.top, 0.0) + 1.0 if not r.toxic else r.best - 1.0 if r.next is None else (r.best + r.next) / 2
        out[r.guess] = (at, r.toxic)
    return out


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", seed: int = 7) -> Network:
    """A network from all labelled documents outside the held-out fifth. Null texts are texts without words; repeated rows count each.

    The network is held whole by the driver and by each task; its size hangs on the buckets and the languages only.
    """
    rows = freeze(labelled(docs, labels, key, text, lang, label))
    known = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("label").alias("toxic"), F.sum(F.length("codes")).alias("bytes")).collect()
    n, toxic, size = (sum(r[k] for r in known) for k in ("n", "toxic", "bytes"))
    languages = tuple(sorted(r.lang for r in known if r.lang is not None))
    if not n:
        return train([], np.zeros(0), [], seed)
    shards = rows.coalesce(max(-(-size // (4 * SHARD_CODES)), -(-n // SHARD_TEXTS)))
    net, held = fit(lambda of: sum_over(shards, of), toxic / n, languages, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = held_shard(batches)
        if shard is not None:
            columns = zip(*shard.scored(net, held), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["guess", "logit", "label"])

    scored = freeze(shards.mapInArrow(run, "guess int, logit double, label double"))
    own = best_thresholds(scored.unionByName(scored.withColumn("guess", F.lit(-2))))
    return calibrated(net, own[-2][0], own)


def score(docs: DataFrame, network: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted, guessed_lang) for every whole text.

    0.5 is the threshold of the guessed language. Null and empty texts are scored as texts without words. Null keys count as held
    out. Repeated rows stay; other columns are left out.
    """
    extra = [
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField("guessed_lang", T.StringType()),
    ]
    shared = docs.sparkSession.sparkContext.broadcast(network)
    found = map_rows(docs, [key], text, extra, lambda: Scorer(shared.value))
    return found.select(key, held_out(key).alias("held_out"), "score", "predicted", "guessed_lang")
