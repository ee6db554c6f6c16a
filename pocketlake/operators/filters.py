"""Candidate gates, ranking and top-k selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import model_class, rule_class
from ..plans.ordering import rank_rows
from .features import plddt_summary, residue_map


def by_score(df: DataFrame, min_score: float = 0.60) -> DataFrame:
    return df.where(F.col("composite_score") >= min_score)


def by_criteria(
    df: DataFrame,
    min_basic: int = 4,
    max_sasa: float = 10.0,
    min_volume: float = 300,
    max_volume: float = 800,
) -> DataFrame:
    """Plain conjuncts on stored columns, so that they reach the Parquet scan."""
    return df.where(
        (F.col("basic_residues") >= min_basic)
        & (F.col("sasa") <= max_sasa)
        & (F.col("volume") >= min_volume)
        & (F.col("volume") <= max_volume)
    )


def by_burial_depth(df: DataFrame, min_depth: float = 15.0, depth_col: str = "burial_depth") -> DataFrame:
    """Keep deep pockets; a table without the column passes unchanged."""
    if depth_col not in df.columns:
        return df
    return df.where(F.coalesce(F.col(depth_col), F.lit(0.0)) >= min_depth)


def by_confidence(df: DataFrame, min_plddt: float = 70.0) -> DataFrame:
    """Keep confident pockets by their column; a table without the column passes unchanged."""
    if "plddt_confidence" not in df.columns:
        return df
    return df.where(F.coalesce(F.col("plddt_confidence"), F.lit(0.0)) >= min_plddt)


def by_residue_confidence(
    df: DataFrame,
    residues: DataFrame,
    min_plddt: float = 70.0,
    residue_col: str = "residue_ids",
    keys: Sequence[str] = ("structure_id", "pocket_id"),
) -> DataFrame:
    """Keep a pocket by the confidence of its lining residues.

    Rows with a residue list pass when at least 80 % of the residues found reach ``min_plddt`` and none
    lies more than 10 below it. Rows without a list fall back to their own column, and rows with
    neither are kept.
    """
    has_column = "plddt_confidence" in df.columns
    own = F.col("plddt_confidence") if has_column else F.lit(None).cast("double")
    if residue_col not in df.columns:
        return df.where(own.isNull() | (own >= min_plddt))
    listed = df.where(F.col(residue_col).isNotNull())
    pairs = listed.select(*keys, F.explode(F.array_distinct(residue_col)).alias("resseq"))
    gate = plddt_summary(pairs, residue_map(residues), min_plddt, keys)
    passing = gate.where("passes_confidence_gate").select(*keys)
    unlisted = df.where(F.col(residue_col).isNull()).where(own.isNull() | (own >= min_plddt))
    return listed.join(passing, list(keys), "left_semi").unionByName(unlisted)


def with_rank(
    df: DataFrame,
    id_cols: Sequence[str] = ("structure_id", "pocket_id"),
    partition: Sequence[str] = (),
    score: str = "composite_score",
) -> DataFrame:
    """Rank 1..n by score (ties by id) with the rule class, globally or within ``partition``."""
    order = [F.desc(score), *[F.asc(c) for c in id_cols if c not in partition]]
    return rank_rows(df, order, "rank", partition).withColumn("classification", rule_class(score))


def cryptic_candidates(
    df: DataFrame,
    residues: DataFrame | None = None,
    *,
    min_score: float = 0.60,
    min_plddt: float = 70.0,
    min_basic: int = 4,
    max_sasa: float = 10.0,
    min_volume: float = 300,
    max_volume: float = 800,
    min_burial_depth: float | None = None,
    id_cols: Sequence[str] = ("structure_id", "pocket_id"),
) -> DataFrame:
    """The gates in order of cost (columns first, residue join last), then the rank."""
    kept = by_criteria(by_score(df, min_score), min_basic, max_sasa, min_volume, max_volume)
    if min_burial_depth is not None:
        kept = by_burial_depth(kept, min_burial_depth)
    if residues is not None:
        kept = by_residue_confidence(kept, residues, min_plddt)
    return with_rank(kept, id_cols)


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of each group. Spark limits each task to k rows per group before the shuffle."""
    within = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(within)).where(F.col(rank) <= k)


def top_candidates(
    df: DataFrame, n: int = 50, id_cols: Sequence[str] = ("structure_id", "pocket_id")
) -> DataFrame:
    """Best ``n`` rows with rank and class; each task keeps n rows, so the rank window sees n."""
    best = df.orderBy(F.desc("composite_score"), *[F.asc(c) for c in id_cols]).limit(n)
    order = Window.orderBy(F.desc("composite_score"), *[F.asc(c) for c in id_cols])
    return best.withColumn("rank", F.row_number().over(order)).withColumn(
        "classification", rule_class("composite_score")
    )


def top_for_dynamics(df: DataFrame, n: int = 20, id_cols: Sequence[str] = ("candidate_id",)) -> DataFrame:
    """Rows to simulate: the best by score, or the first by id when the table has no score."""
    by_id = [F.asc(c) for c in id_cols]
    order = [F.desc("composite_score"), *by_id] if "composite_score" in df.columns else by_id
    return df.orderBy(*order).limit(n)


def catalog_by_confidence(catalog: DataFrame, min_plddt: float = 70.0) -> DataFrame:
    """Confident structures; when no structure has a value at all, every structure."""
    known = catalog.agg(F.bool_or(F.col("mean_plddt").isNotNull()).alias("known"))
    passes = F.coalesce(F.col("mean_plddt"), F.lit(0.0)) >= min_plddt
    return catalog.where(passes | ~F.coalesce(known.scalar(), F.lit(False)))


def study_gate(
    df: DataFrame, min_score: float = 0.7, min_plddt: float = 70.0, plddt_col: str = "plddt_confidence"
) -> DataFrame:
    """Candidates per organism as a count and a percentage of all its rows."""
    passes = (F.col("composite_score") >= min_score) & (F.col(plddt_col) >= min_plddt)
    return (
        df.groupBy("organism")
        .agg(F.count_if(passes).alias("n_candidates"), F.count("*").alias("n_total"))
        .withColumn("percent", 100.0 * F.col("n_candidates") / F.col("n_total"))
    )


def quarantine(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Split rows into good ones and failed ones (with an ``error`` text), so one bad row stops nothing."""
    marked = df.withColumn("error", error)
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def model_ranked(df: DataFrame, id_cols: Sequence[str] = ("structure_id", "pocket_id")) -> DataFrame:
    """As ``with_rank`` for model probabilities, whose class cut-offs differ."""
    order = [F.desc("composite_score"), *[F.asc(c) for c in id_cols]]
    return rank_rows(df, order).withColumn("classification", model_class("composite_score"))
