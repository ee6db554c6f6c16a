"""Whole screens: features, score, gates, top hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scorers import RuleScorer, Scorer
from ..functions.scoring import composite_score, rule_class
from ..operators.features import lining_features, residues_from_atoms
from ..operators.filters import by_criteria, cryptic_candidates, top_per_group
from ..operators.ledger import remaining
from ..operators.spatial import burial_depth
from ..runtime import freeze


def analyse(pockets: DataFrame, atoms: DataFrame, scorer: Scorer | None = None, potential: DataFrame | None = None) -> DataFrame:
    """Features and score of every pocket of every structure in one plan.

    The residue table is frozen: it serves two joins and is a fraction of the atoms it comes from.
    """
    residues = freeze(residues_from_atoms(atoms))
    rows = lining_features(pockets, residues).join(burial_depth(pockets, atoms), ["structure_id", "pocket_id"])
    if potential is None:
        rows = rows.withColumn("electrostatic_potential", F.lit(None).cast("double"))
    else:
        rows = rows.join(potential, ["structure_id", "pocket_id"], "left")
    return (scorer or RuleScorer()).score(rows)


def screen_top(scored_input: DataFrame, k: int = 3, min_score: float | None = None) -> DataFrame:
    """Best ``k`` pockets of each structure that pass the hard criteria."""
    rows = by_criteria(scored_input).withColumn("composite_score", composite_score())
    if min_score is not None:
        rows = rows.where(F.col("composite_score") >= min_score)
    best = top_per_group(rows, ["structure_id"], [F.desc("composite_score"), F.asc("pocket_id")], k)
    return best.withColumn("classification", rule_class("composite_score"))


def screen_proteome(
    pockets: DataFrame, atoms: DataFrame, processed: DataFrame | None = None, min_burial_depth: float | None = None
) -> DataFrame:
    """Resume-aware screen: skip processed structures, analyse, gate, rank."""
    todo = pockets if processed is None else remaining(pockets, processed, "structure_id")
    return cryptic_candidates(analyse(todo, atoms), min_burial_depth=min_burial_depth)


def refine(candidates: DataFrame, potential: DataFrame, top_n: int = 50) -> DataFrame:
    """Second pass: only the best candidates get the costly potential, and are scored again."""
    best = candidates.orderBy(F.desc("composite_score"), "structure_id", "pocket_id").limit(top_n)
    rows = best.drop("electrostatic_potential", "composite_score", "classification", "rank")
    return RuleScorer().score(rows.join(potential, ["structure_id", "pocket_id"], "left"))
