"""Burial classes and pass rules for positive and negative controls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import as_column, drop_nan

ARTIFACT = "crystal_artifact"
SEMI_CRYPTIC = "semi_cryptic"


def burial_component(sasa: Column | str) -> Column:
    s = drop_nan(sasa)
    return F.when(s <= 5, 1.0).when(s >= 50, 0.0).otherwise((50 - s) / 45)


def electrostatic_component(potential: Column | str) -> Column:
    p = drop_nan(potential)
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (p + 2.0) / 12.0))
    return F.when(p.isNull(), 0.5).otherwise(scaled)


def cryptic_likeness(
    pocket_score: Column | str,
    ligand_sasa: Column | str,
    potential: Column | str | None = None,
) -> Column:
    """Burial-weighted score; the potential is mixed in only when a column for it is given."""
    pocket, sasa = as_column(pocket_score), drop_nan(ligand_sasa)
    base = 0.55 * burial_component(sasa) + 0.35 * pocket
    if potential is not None:
        base = 0.75 * base + 0.25 * electrostatic_component(potential)
    return F.when(sasa.isNull(), pocket).otherwise(base)


def positive_passed(
    score: Column | str,
    ligand_sasa: Column | str,
    basic_residues: Column | str,
    pocket_score: Column | str,
    burial_class: Column | str,
    threshold: float = 0.55,
) -> Column:
    value, sasa, basic = as_column(score), drop_nan(ligand_sasa), as_column(basic_residues)
    pocket, kind = as_column(pocket_score), as_column(burial_class)
    semi = (sasa >= 10) & (sasa < 50) & (basic >= 4) & (pocket >= 0.45) & (value >= 0.40)
    buried = (sasa < 10) & (basic >= 4) & (pocket >= 0.50) & (value >= threshold)
    unbound = (basic >= 3) & (value >= threshold)
    verdict = (
        F.when(kind == ARTIFACT, F.lit(False))
        .when(kind == SEMI_CRYPTIC, sasa.isNotNull() & semi)
        .when(sasa.isNotNull(), buried)
        .otherwise(unbound)
    )
    return F.coalesce(verdict, F.lit(False))


def negative_passed(
    score: Column | str,
    ligand_sasa: Column | str,
    pocket_score: Column | str,
    decoy: Column | str | bool = False,
    threshold: float = 0.45,
) -> Column:
    value, sasa, pocket = as_column(score), drop_nan(ligand_sasa), as_column(pocket_score)
    is_decoy = F.lit(decoy) if isinstance(decoy, bool) else as_column(decoy)
    limit = F.when(is_decoy, 0.55).otherwise(threshold)
    verdict = (
        F.when(sasa >= 50, value <= limit)
        .when(sasa >= 20, value <= 0.65)
        .when(sasa.isNotNull(), (value <= limit) & (pocket < 0.55))
        .otherwise(value <= limit)
    )
    return F.coalesce(verdict, F.lit(False))


def burial_class(ligand_sasa: Column | str, phosphate_sasa: Column | str | None = None) -> Column:
    """Class of a bound ligand; phosphate area wins over ligand area when known."""
    metric = drop_nan(ligand_sasa)
    if phosphate_sasa is not None:
        metric = F.coalesce(drop_nan(phosphate_sasa), metric)
    return (
        F.when(metric.isNull(), "unknown")
        .when(metric <= 5, "cryptic")
        .when(metric <= 50, SEMI_CRYPTIC)
        .otherwise("surface")
    )


def dataset_class(sasa: Column | str) -> Column:
    """Class used by the validation dataset; its cut-offs differ from ``burial_class``."""
    s = as_column(sasa)
    return F.when(s < 5, "Cryptic").when(s <= 20, "Semi-cryptic").otherwise("Surface")


def artifact_override(control_type: Column | str, ligand_sasa: Column | str, burial: Column | str) -> Column:
    exposed = (as_column(control_type) == "positive") & (drop_nan(ligand_sasa) > 100)
    return F.when(exposed, ARTIFACT).otherwise(as_column(burial))


def pocket_stability(
    sasa: Column | str = "avg_pocket_sasa_nm2",
    rmsf: Column | str = "avg_pocket_rmsf_nm",
    waters: Column | str = "avg_waters_in_pocket",
    *,
    sasa_limits: tuple[float, float] = (1.0, 5.0),
    rmsf_limits: tuple[float, float] = (0.20, 0.45),
    waters_limits: tuple[float, float] = (1.0, 5.0),
) -> Column:
    """Majority vote of three dynamics metrics between buried and exposed."""
    buried, exposed = F.lit(0), F.lit(0)
    for metric, (low, high) in ((sasa, sasa_limits), (rmsf, rmsf_limits), (waters, waters_limits)):
        value = as_column(metric)
        buried = buried + F.when(value <= low, 1).otherwise(0)
        exposed = exposed + F.when((value > low) & (value >= high), 1).otherwise(0)
    return F.when(buried >= 2, "stably buried").when(exposed >= 2, "exposed").otherwise("transiently accessible")
