"""Dynamics metrics of pocket atoms over trajectory frames kept as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.controls import pocket_stability
from .features import RADII, solvent_area

_AXES = ("x", "y", "z")


def pocket_atoms(frames: DataFrame) -> DataFrame:
    return frames.where(~F.col("is_water") & (F.col("element") != "H"))


def mean_rmsf(frames: DataFrame) -> DataFrame:
    """Fluctuation of each pocket atom about its mean position, averaged per candidate.

    The mean square deviation is the summed population variance, so one aggregation does it.
    """
    spread = sum((F.var_pop(a) for a in _AXES), start=F.lit(0.0))
    per_atom = pocket_atoms(frames).groupBy("candidate_id", "atom_id").agg(F.sqrt(spread).alias("rmsf"))
    return per_atom.groupBy("candidate_id").agg(F.avg("rmsf").alias("avg_pocket_rmsf_nm"))


def box_volume(frames: DataFrame) -> DataFrame:
    """Bounding-box volume of the pocket atoms per frame, as mean and population deviation."""
    volume = F.lit(1.0)
    for a in _AXES:
        volume = volume * F.greatest(F.max(a) - F.min(a), F.lit(1e-6))
    per_frame = pocket_atoms(frames).groupBy("candidate_id", "frame").agg(volume.alias("v"))
    return per_frame.groupBy("candidate_id").agg(
        F.avg("v").alias("avg_pocket_volume_nm3"), F.stddev_pop("v").alias("std_pocket_volume_nm3")
    )


def water_counts(frames: DataFrame, centres: DataFrame | None = None, radius: float = 0.4) -> DataFrame:
    """Mean number of waters within ``radius`` of the pocket centre per frame, 0 without waters.

    ``centres`` fixes one centre per candidate; otherwise each frame uses the mean of its pocket atoms.
    """
    means = pocket_atoms(frames).groupBy("candidate_id", "frame").agg(*[F.avg(a).alias(f"_c{a}") for a in _AXES])
    if centres is not None:
        fixed = centres.select("candidate_id", *[F.col(f"center_{a}").alias(f"_c{a}") for a in _AXES])
        means = means.select("candidate_id", "frame").join(fixed, "candidate_id")
    waters = frames.where("is_water").select("candidate_id", "frame", *_AXES)
    gap = F.lit(0.0)
    for a in _AXES:
        gap = gap + (F.col(a) - F.col(f"_c{a}")) * (F.col(a) - F.col(f"_c{a}"))
    inside = waters.join(means, ["candidate_id", "frame"]).where(F.sqrt(gap) <= radius)
    counted = inside.groupBy("candidate_id", "frame").agg(F.count("*").alias("n"))
    return (
        means.select("candidate_id", "frame")
        .join(counted, ["candidate_id", "frame"], "left")
        .groupBy("candidate_id")
        .agg(F.avg(F.coalesce("n", F.lit(0))).alias("avg_waters_in_pocket"))
    )


def pocket_area(frames: DataFrame, points: int = 960) -> DataFrame:
    """Mean summed solvent area (nm²) of the pocket atoms over frames, among all atoms of a frame."""
    radii = {element: size / 10 for element, size in RADII.items()}
    area = solvent_area(frames, ("candidate_id", "frame"), "row_id", 0.14, points, radii, other_radius=0.2)
    per_frame = pocket_atoms(area).groupBy("candidate_id", "frame").agg(F.sum("sasa").alias("a"))
    return per_frame.groupBy("candidate_id").agg(F.avg("a").alias("avg_pocket_sasa_nm2"))


def dynamics_report(candidates: DataFrame, frames: DataFrame) -> DataFrame:
    """Metrics and stability class per candidate; a candidate without pocket atoms is ``failed``."""
    report = candidates.select("candidate_id")
    for metrics in (pocket_area(frames), mean_rmsf(frames), box_volume(frames), water_counts(frames)):
        report = report.join(metrics, "candidate_id", "left")
    failed = F.col("avg_pocket_rmsf_nm").isNull()
    return report.withColumn("classification", F.when(failed, "failed").otherwise(pocket_stability())).withColumn(
        "error", F.when(failed, "no pocket atoms in any frame")
    )


def stability_summary(report: DataFrame) -> DataFrame:
    """Candidates per class with the part that is stable and the part that is filtered out."""
    kind = F.col("classification")
    return report.groupBy("classification").agg(
        F.count("*").alias("n_candidates"),
        F.count_if(kind == "stably buried").alias("n_stable"),
        F.count_if(kind.isin("exposed", "failed")).alias("n_filtered_out"),
    )


def stable_candidates(report: DataFrame) -> DataFrame:
    return report.where(F.col("classification") == "stably buried").select("candidate_id")


def filtered_out_candidates(report: DataFrame) -> DataFrame:
    return report.where(F.col("classification").isin("exposed", "failed")).select("candidate_id")
