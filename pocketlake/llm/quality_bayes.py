"""Quality by hierarchical empirical Bayes.

A logistic classifier on counts of the whole text gives each document its evidence. Evidence is summed by path and by host;
hosts are shrunk toward the corpus, paths toward their host, each by a prior whose strength is fitted to how much the
sites really differ (method of moments). A document's quality joins its own log-odds with how far its path's
posterior stands from the corpus mean, so a sparse site adds next to nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pocketlake.runtime import freeze

from . import textstats
from .shared import each_body, fresh, low_hash, map_rows

#: Labelled documents that the classifier is fitted on at most.
LABELLED = 8_000
#: Labelled characters that it is fitted on at most; beyond that the longest texts give their beginnings only.
LABELLED_CHARS = 48_000_000
RIDGE = 1.0
ROUNDS = 25
#: Weight of the site's posterior beside the document's own evidence.
SITE_WEIGHT = 0.5
#: Quality from which a document is kept.
KEEP = 0.4
#: Sites up to which their table is sent to every task; larger ones are joined by a shuffle.
SITES_SENT_WHOLE = 100_000
#: Strength of a prior is held between these numbers of documents.
WEAKEST, STRONGEST = 1.0, 1e6

FEATURES = (
    "log_words", "word_length", "distinct", "repeated", "duplicate_lines", "symbols", "marks", "stops", "capitals", "digits", "beyond_ascii",
)


def features(body: bytes | None) -> list[float]:
    """Numbers that describe a text, all defined for any text."""
    body = body or b""
    per_byte = textstats.byte_counts(body)
    classes = dict(zip(textstats.CLASSES, textstats.class_counts(per_byte).tolist(), strict=True))
    words = body.split()
    n, chars = max(1, len(words)), max(1, textstats.word_chars(per_byte))
    distinct, repeated = textstats.repeated_words(words)
    lines, twice = textstats.duplicate_lines(body)
    letters = max(1, classes["lower"] + classes["upper"])
    return [
        np.log1p(len(words)), min(chars / n, 30.0), distinct / n**0.9, repeated / n, twice / max(1, lines), min(1.0, 5 * classes["symbol"] / chars),
        min(1.0, 5 * classes["other_mark"] / chars), classes["stop"] / chars, classes["upper"] / letters, classes["digit"] / chars, classes["beyond_ascii"] / chars,
    ]


@dataclass(frozen=True)
class Classifier:
    """A logistic model on standardised features; with no labels it gives the same prior to every text."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __call__(self, body: bytes | None) -> float:
        z = np.clip((np.array(features(body)) - self.center) / self.scale, -6, 6)
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30))))


def fit(rows: np.ndarray, labels: np.ndarray) -> Classifier:
    """Ridge logistic regression by Newton's method."""
    width = len(FEATURES)
    if not len(labels):
        return Classifier(np.zeros(width), np.ones(width), np.zeros(width + 1))
    center, scale = rows.mean(axis=0), rows.std(axis=0)
    scale[scale < 1e-9] = 1.0
    x = np.hstack([np.ones((len(rows), 1)), np.clip((rows - center) / scale, -6, 6)])
    w = np.zeros(width + 1)
    penalty = np.diag([1e-3] + [RIDGE] * width)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (labels - p) - penalty @ w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(center, scale, w)


def even_share(sizes: list[int], chars: int) -> int:
    """The most characters that every text may give so that all together give at most ``chars``; texts below it stay whole."""
    left = chars
    for n, size in enumerate(sorted(sizes)):
        even = left // (len(sizes) - n)
        if size > even:
            return even
        left -= size
    return max(sizes, default=0)


def bounded_labels(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int, chars: int) -> DataFrame:
    """(key, label, body) of at most ``rows`` labelled documents, the first in the order of a hash of the key.

    No document is left out for its length: where they have more than ``chars`` characters in all, the longest ones give
    their first characters only, each as many as fit, which is never less than ``chars / rows``.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("double").alias("_label"))
    known = freeze(known)
    first = known.filter(low_hash("_key", rows, known.count())).orderBy(F.xxhash64("_key"), "_key").limit(rows)
    found = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).filter("_text IS NOT NULL")
    found = found.join(F.broadcast(first), F.col("_doc") == F.col("_key"))
    # Of repeated keys one text counts, so there are at most `rows` of them.
    found = found.groupBy("_key", "_label").agg(F.min("_text").alias("_text"))
    share = even_share([r[0] for r in found.select(F.length("_text")).collect()], chars)
    return found.select(F.col("_key").alias("key"), F.col("_label").alias("label"), F.substring("_text", 1, share).cast("binary").alias("body"))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Classifier:
    """The classifier from a bounded sample of labelled documents."""
    sample = bounded_labels(docs, labels, key, text, label, LABELLED, LABELLED_CHARS)
    extra = [T.StructField("row", T.ArrayType(T.DoubleType()))]
    made = map_rows(sample, ["key", "label"], "body", extra, lambda: lambda b: (features(b),)).orderBy("key").collect()
    rows = np.array([r["row"] for r in made]).reshape(-1, len(FEATURES))
    return fit(rows, np.array([r["label"] for r in made]))


@dataclass(frozen=True)
class Prior:
    """Corpus mean, and how many documents' worth a host's and a path's prior count."""

    mean: float
    host_strength: float
    path_strength: float


def strength(groups: DataFrame, mean: Column) -> DataFrame:
    """One row: the strength that the spread of ``s / n`` around ``mean`` between groups implies.

    The spread that groups of one common mean would show by chance is taken off first.
    """
    noise = mean * (1 - mean)
    spread = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2))
    chance = F.sum(noise) - F.sum(F.col("n") * noise) / F.sum("n")
    room = F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n")
    between = (spread - chance) / room
    level = F.sum(F.col("n") * noise) / F.sum("n")
    fitted = F.when((room > 0) & (between > 0), level / between - 1).otherwise(F.lit(STRONGEST))
    return groups.agg(F.least(F.greatest(fitted, F.lit(WEAKEST)), F.lit(STRONGEST)).alias("strength"))


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, Prior]:
    """(host, path, host_posterior, path_posterior) from rows (host, path, p), and the prior that was fitted."""
    paths = freeze(evidence.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("p").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    whole = paths.agg(F.sum("s"), F.sum("n")).first()
    mean = float(whole[0] / whole[1]) if whole[1] else 0.5
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    host_strength = float(strength(hosts, F.lit(mean)).first()[0] or STRONGEST)
    posterior = (F.col("s") + host_strength * mean) / (F.col("n") + host_strength)
    hosts = hosts.select(F.col("host").alias("_host"), posterior.alias("host_posterior"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    path_strength = float(strength(paths, F.col("host_posterior")).first()[0] or STRONGEST)
    posterior = (F.col("s") + path_strength * F.col("host_posterior")) / (F.col("n") + path_strength)
    sites = freeze(paths.select("host", "path", "host_posterior", posterior.alias("path_posterior")))
    return sites, Prior(mean, host_strength, path_strength)


def with_site(rows: DataFrame, sites: DataFrame, size: int, on: Column) -> DataFrame:
    """Rows with their site: without a shuffle of the rows if there are few sites."""
    return rows.join(F.broadcast(sites) if size <= SITES_SENT_WHOLE else sites, on)


def log_odds(p: Column) -> Column:
    held = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(held / (1 - held))


def joined_quality(p: Column, path_posterior: Column, mean: float) -> Column:
    total = log_odds(p) + SITE_WEIGHT * (log_odds(path_posterior) - log_odds(F.lit(mean)))
    return 1 / (1 + F.exp(-total))


def evidence_column(classifier: Classifier, text: str) -> Column:
    @F.arrow_udf(T.DoubleType())
    def of(bodies: pa.Array) -> pa.Array:
        return pa.array([classifier(b) for b in each_body(bodies)], pa.float64())

    return of(F.col(text).cast("binary"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality") -> DataFrame:
    """(key, host, path, p_document, host_posterior, path_posterior, quality, kept) for every document.

    Null hosts and paths are groups of their own. Null and empty texts are judged by their (zero) counts. Repeated rows stay
    and count as often as they stand there. Without labels the classifier gives 0.5 to every text and everything is kept.
    Other columns, and columns of ``labels`` but the key and the label, play no part.
    """
    classifier = learn(docs, labels, key, text, label)
    rows = docs.select(F.col(key), F.col(host).alias("host"), F.col(path).alias("path"), evidence_column(classifier, text).alias("p"))
    rows = freeze(rows)
    sites, prior = site_posteriors(rows)
    size = sites.count()
    sites = sites.withColumnsRenamed({"host": "_host", "path": "_path"})
    on = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    quality = joined_quality(F.col("p"), F.col("path_posterior"), prior.mean)
    found = with_site(rows, sites, size, on).withColumn("quality", quality)
    return found.select(key, "host", "path", F.col("p").alias("p_document"), "host_posterior", "path_posterior", "quality", (F.col("quality") >= KEEP).alias("kept"))


def kept_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``judge`` keeps."""
    classifier = learn(docs, labels, key, text, label)
    evidence = docs.select(F.col(host).alias("host"), F.col(path).alias("path"), evidence_column(classifier, text).alias("p"))
    sites, prior = site_posteriors(evidence)
    size = sites.count()
    shift = SITE_WEIGHT * (log_odds(F.col("path_posterior")) - log_odds(F.lit(prior.mean)))
    p, own_host, own_path, own_shift = (fresh(docs, n) for n in ("p", "host", "path", "shift"))
    sites = sites.select(F.col("host").alias(own_host), F.col("path").alias(own_path), shift.alias(own_shift))
    on = docs[host].eqNullSafe(F.col(own_host)) & docs[path].eqNullSafe(F.col(own_path))
    scored = with_site(docs.withColumn(p, evidence_column(classifier, text)), sites, size, on)
    quality = 1 / (1 + F.exp(-(log_odds(F.col(p)) + F.col(own_shift))))
    return scored.filter(quality >= KEEP).select(*docs.columns)
