"""Rule scores and classes as column expressions (no shuffle, inside whole-stage codegen)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score weights, class names and class cut-offs of the screen.
DEFAULT_WEIGHTS = {
    "volume": 0.10,
    "depth": 0.25,
    "sasa": 0.40,
    "basic_residues": 0.20,
    "electrostatics": 0.05,
}
HIGH = "High confidence cryptic IP site"
MODERATE = "Moderate confidence candidate"
LOW = "Low confidence - manual inspection recommended"
UNLIKELY = "Unlikely cryptic IP site"
RULE_CUTS = (0.75, 0.60, 0.40)
MODEL_CUTS = (0.8, 0.6, 0.4)
CRYPTIC_CLASSES = ("Cryptic", "Semi-cryptic")


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def drop_nan(value: Column | str) -> Column:
    """NaN becomes NULL: Spark orders NaN above every number, which no rule here intends."""
    return F.nanvl(as_column(value).cast("double"), F.lit(None).cast("double"))


def volume_score(volume: Column | str) -> Column:
    v = drop_nan(volume)
    return (
        F.when(v.between(300, 800), 1.0)
        .when(v < 300, F.greatest(F.lit(0.0), v / 300))
        .when(v > 800, F.greatest(F.lit(0.0), 1.0 - (v - 800) / 1000))
        .otherwise(0.0)
    )


def depth_score(depth: Column | str) -> Column:
    d = drop_nan(depth)
    return F.when(d >= 15, 1.0).when(d.isNotNull(), 1.0 / (1.0 + F.exp(-(d - 10) / 2)))


def sasa_score(sasa: Column | str) -> Column:
    s = drop_nan(sasa)
    return F.when(s <= 5, 1.0).when(s >= 50, 0.0).otherwise((50 - s) / 45)


def basic_residue_score(count: Column | str) -> Column:
    n = as_column(count)
    return F.when(n >= 6, 1.0).when(n >= 4, 0.8).when(n >= 2, 0.4).otherwise(0.0)


def potential_score(potential: Column | str) -> Column:
    p = drop_nan(potential)
    return F.when(p.isNull(), 0.5).when(p >= 5, 1.0).when(p >= 3, 0.7).when(p >= 1, 0.4).otherwise(0.0)


def composite_score(
    weights: Mapping[str, float] | None = None,
    *,
    volume: Column | str = "volume",
    depth: Column | str = "depth",
    sasa: Column | str = "sasa",
    basic_residues: Column | str = "basic_residues",
    electrostatics: Column | str = "electrostatic_potential",
) -> Column:
    """Weighted sum of the five component scores as one fused expression."""
    chosen = dict(weights or DEFAULT_WEIGHTS)
    parts = {
        "volume": volume_score(volume),
        "depth": depth_score(depth),
        "sasa": sasa_score(sasa),
        "basic_residues": basic_residue_score(basic_residues),
        "electrostatics": potential_score(electrostatics),
    }
    missing = sorted(set(parts) - set(chosen))
    if missing:
        raise ValueError(f"weights are missing for: {', '.join(missing)}")
    total = F.lit(0.0)
    for name, score in parts.items():
        total = total + score * F.lit(float(chosen[name]))
    return total


def _confidence_class(score: Column | str, cuts: tuple[float, float, float]) -> Column:
    s = as_column(score)
    return F.when(s >= cuts[0], HIGH).when(s >= cuts[1], MODERATE).when(s >= cuts[2], LOW).otherwise(UNLIKELY)


def rule_class(score: Column | str) -> Column:
    return _confidence_class(score, RULE_CUTS)


def model_class(score: Column | str) -> Column:
    return _confidence_class(score, MODEL_CUTS)


def class_label(classification: Column | str) -> Column:
    """1 for the two buried classes, 0 for anything else."""
    return F.when(as_column(classification).isin(*CRYPTIC_CLASSES), 1).otherwise(0)


def surrogate_features(columns: list[str], sasa: str = "sasa") -> dict[str, Column]:
    """Stand-ins for feature columns the table lacks; columns it has are passed through."""
    s = F.col(sasa)
    stand_ins = {
        "pocket_depth": 20.0 - F.least(s, F.lit(20.0)),
        "sasa": s,
        "electrostatic_potential": 8.0 - 0.1 * s,
        "n_basic_residues": F.bround(F.greatest(8.0 - 0.2 * s, F.lit(1.0)), 0),
        "pocket_volume": 600.0 - 3.5 * s,
        "plddt_confidence": F.lit(85.0),
    }
    return {name: F.col(name) if name in columns else expr for name, expr in stand_ins.items()}


def neg_log10(q: Column | str, floor: float = 1e-300) -> Column:
    return -F.log10(F.greatest(as_column(q), F.lit(floor)))
