"""Choosing and labelling pockets against reference sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import class_label


def ligand_distance(pockets: DataFrame, centroids: DataFrame) -> DataFrame:
    """Pockets with the distance of their centre to the ligand centroid (NULL without a ligand)."""
    gap = F.lit(0.0)
    for a in ("x", "y", "z"):
        d = F.col(f"center_{a}") - F.col(f"ligand_{a}")
        gap = gap + d * d
    columns = ["structure_id", "ligand_x", "ligand_y", "ligand_z"]
    return (
        pockets.join(centroids.select(*columns), "structure_id", "left")
        .withColumn("ligand_distance", F.sqrt(gap))
        .drop(*columns[1:])
    )


def residue_overlap(lining: DataFrame, site: DataFrame) -> DataFrame:
    """How many lining residues of each pocket belong to the site of its structure."""
    common = lining.join(site.select("structure_id", "resseq").distinct(), ["structure_id", "resseq"])
    return common.groupBy("structure_id", "pocket_id").agg(F.count("*").alias("overlap"))


def best_pocket(
    pockets: DataFrame,
    lining: DataFrame,
    site: DataFrame,
    centroids: DataFrame,
    *,
    overlap_first: bool = False,
    decoy: bool = False,
) -> DataFrame:
    """The pocket of each structure that fits its reference site best.

    With a centroid: nearest, then most overlap, then best score. Without one: the best score, or with
    ``overlap_first`` most overlap and then the best score. ``decoy`` takes the best score always.
    """
    rows = ligand_distance(pockets, centroids).join(
        residue_overlap(lining, site), ["structure_id", "pocket_id"], "left"
    )
    rows = rows.withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    score, tie = F.desc("composite_score"), F.asc("pocket_id")
    if decoy:
        order = [score, tie]
    elif overlap_first:
        near = F.col("ligand_distance")
        by_overlap = F.when(near.isNull(), F.col("overlap")).otherwise(0)
        order = [near.asc_nulls_last(), by_overlap.desc(), F.desc("overlap"), score, tie]
    else:
        known = F.col("ligand_distance").isNotNull()
        order = [
            F.col("ligand_distance").asc_nulls_last(),
            F.when(known, F.col("overlap")).otherwise(0).desc(),
            score,
            tie,
        ]
    best = Window.partitionBy("structure_id").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def pocket_labels(
    pockets: DataFrame, centroids: DataFrame, dataset: DataFrame, cutoff: float = 8.0, key: str = "structure_id"
) -> DataFrame:
    """Label 1 for pockets of a buried structure whose centre lies within ``cutoff`` of the ligand."""
    classes = dataset.select(key, class_label("classification").alias("_positive"), "classification")
    near = ligand_distance(pockets, centroids).join(classes, key, "left")
    hit = (F.coalesce("_positive", F.lit(0)) == 1) & (F.col("ligand_distance") <= cutoff)
    return near.withColumn("label", F.when(hit, 1).otherwise(0)).drop("_positive")


def one_row_per_structure(dataset: DataFrame, key: str = "pdb_id", order: str = "seq") -> DataFrame:
    """First row of each structure, its id compared without regard to case."""
    first = Window.partitionBy("_id").orderBy(order)
    return (
        dataset.withColumn("_id", F.upper(F.col(key).cast("string")))
        .withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .withColumn(key, F.col("_id"))
        .drop("_n", "_id")
    )
