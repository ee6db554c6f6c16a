"""Term enrichment over an ontology, and permutation enrichment of categories."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import neg_log10
from ..functions.special import fisher_p, hypergeometric_shift_tail
from ..runtime import freeze
from .comparative import protein_hits
from .testing import benjamini_hochberg


def ancestor_closure(edges: DataFrame, child: str = "go_id", parent: str = "parent_id") -> DataFrame:
    """All distinct (term, ancestor) pairs, ancestors included by any path, by repeated doubling.

    A graph of depth d settles after about log2(d) rounds; each round is written to the checkpoint folder.
    """
    reach = freeze(edges.select(F.col(child).alias("term"), F.col(parent).alias("ancestor")).distinct())
    size = reach.count()
    while True:
        step = reach.select(F.col("term").alias("_mid"), F.col("ancestor").alias("_far"))
        longer = reach.join(step, F.col("ancestor") == F.col("_mid")).select("term", F.col("_far").alias("ancestor"))
        reach = freeze(reach.unionByName(longer).distinct())
        grown = reach.count()
        if grown == size:
            return reach
        size = grown


def term_enrichment(
    hits: DataFrame, associations: DataFrame, edges: DataFrame, terms: DataFrame | None = None
) -> DataFrame:
    """Fisher test per (organism, term) of hits against all annotated proteins, ancestors included.

    ``associations`` has (organism, protein_id, go_id). Each protein counts once per term, which is
    settled before counting, so a root term held by every protein is only summed. ``terms`` (go_id, name, namespace)
    adds the names of the terms, NULL for those it lacks.
    """
    closure = ancestor_closure(edges)
    direct = associations.select("organism", "protein_id", F.col("go_id").alias("term")).distinct()
    inherited = direct.join(closure, "term").select("organism", "protein_id", F.col("ancestor").alias("term"))
    annotated = direct.unionByName(inherited).distinct()
    is_study = protein_hits(hits).where("is_hit").select("organism", "protein_id", F.lit(1).alias("_study"))
    population = associations.select("organism", "protein_id").distinct()
    totals = (
        population.join(is_study, ["organism", "protein_id"], "left")
        .groupBy("organism")
        .agg(F.count("*").alias("pop_n"), F.count("_study").alias("study_n"))
    )
    counts = (
        annotated.join(is_study, ["organism", "protein_id"], "left")
        .groupBy("organism", "term")
        .agg(F.count("*").alias("population_count"), F.count("_study").alias("study_count"))
        .join(totals, "organism")
    )
    s, p, sn, pn = (F.col(c) for c in ("study_count", "population_count", "study_n", "pop_n"))
    tested = counts.withColumn("p_uncorrected", fisher_p(s, sn - s, p - s, pn - sn - p + s)).withColumn(
        "enrichment", F.when(s * pn > p * sn, "e").otherwise("p")
    )
    adjusted = benjamini_hochberg(freeze(tested), "p_uncorrected", partition=["organism"])
    enriched = adjusted.select(
        "organism",
        F.col("term").alias("go_id"),
        "study_count",
        "population_count",
        "study_n",
        "pop_n",
        "p_uncorrected",
        F.col("fdr_q_value").alias("fdr_bh"),
        "enrichment",
    )
    if terms is None:
        return enriched
    return enriched.join(terms.select("go_id", "name", "namespace").dropDuplicates(["go_id"]), "go_id", "left")


def best_per_term(enriched: DataFrame) -> DataFrame:
    """Lowest FDR of each term and the organism that reaches it."""
    return enriched.where("fdr_bh IS NOT NULL").groupBy("go_id").agg(
        F.min("fdr_bh").alias("best_fdr"), F.min_by("organism", F.struct("fdr_bh", "organism")).alias("best_organism")
    )


def term_heatmap(enriched: DataFrame, organisms: list[str], top_n: int = 15) -> DataFrame:
    """Best terms × organisms with the largest −log10 FDR, 0 where a pair is absent.

    The pivot values are given, so Spark does not run a job to find them.
    """
    top = best_per_term(enriched).orderBy("best_fdr", "go_id").limit(top_n).select("go_id")
    kept = enriched.join(top, "go_id", "left_semi").withColumn("_s", neg_log10("fdr_bh"))
    return kept.groupBy("go_id").pivot("organism", organisms).agg(F.max("_s")).na.fill(0.0)


def permutation_enrichment(
    df: DataFrame, category: str, hit: str, n_permutations: int = 5000, seed: int = 0
) -> DataFrame:
    """Permutation p-value of the hit-rate shift of each category, with FDR control.

    Shuffling hit flags gives the hit count of a category a hypergeometric law, so rows are never shuffled. Replicates are
    independent, so how many of them are as extreme as what was seen is one binomial draw with that law's tail, which
    is summed exactly at any number of rows. Draws depend on ``seed`` and the category only.
    """
    counts = df.groupBy(F.col(category).alias("category")).agg(
        F.count("*").alias("n"), F.count_if(F.col(hit)).alias("k")
    )
    totals = counts.agg(F.struct(F.sum("n").alias("n_all"), F.sum("k").alias("k_all")).alias("t")).scalar()
    sized = counts.withColumn("_t", totals).select("category", "n", "k", "_t.n_all", "_t.k_all")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            extreme = []
            for row in batch.itertuples(index=False):
                rng = np.random.default_rng([seed, zlib.crc32(str(row.category).encode())])
                seen = abs(row.k / row.n - row.k_all / row.n_all)
                tail = hypergeometric_shift_tail(int(row.n_all), int(row.k_all), int(row.n), seen)
                extreme.append(int(rng.binomial(n_permutations, tail)))
            yield batch.assign(p_value=(np.asarray(extreme) + 1) / (n_permutations + 1))

    kind = df.schema[category].dataType.simpleString()
    drawn = sized.mapInPandas(draw, f"category {kind}, n long, k long, n_all long, k_all long, p_value double")
    rate, overall = F.col("k") / F.col("n"), F.col("k_all") / F.col("n_all")
    rows = drawn.select(
        "category",
        rate.alias("observed_hit_rate"),
        overall.alias("overall_hit_rate"),
        (rate - overall).alias("delta_hit_rate"),
        "p_value",
    )
    return benjamini_hochberg(freeze(rows)).withColumnRenamed("reject", "reject_fdr_0_05")
