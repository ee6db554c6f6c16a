"""Per-pocket features from the residues that line a pocket."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_basic, is_ligand, is_phosphate_atom
from ..runtime import freeze
from .spatial import pairs_with_others, radius_pairs

POCKET_KEY = ("structure_id", "pocket_id")

# Van der Waals radii in Å by element; anything else counts as 2.0.
RADII = {"H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80, "P": 1.80}


def residues_from_atoms(atoms: DataFrame) -> DataFrame:
    """Residue table of the protein part: summed area, CA coordinates and CA B-factor as pLDDT."""
    ca = F.col("atom_name") == "CA"
    return (
        atoms.where(~F.col("is_het"))
        .groupBy("structure_id", "chain", "resseq")
        .agg(
            F.min("resname").alias("resname"),
            F.sum("sasa").alias("sasa"),
            F.max(F.when(ca, F.col("bfactor"))).alias("plddt"),
            F.max(F.when(ca, F.col("x"))).alias("ca_x"),
            F.max(F.when(ca, F.col("y"))).alias("ca_y"),
            F.max(F.when(ca, F.col("z"))).alias("ca_z"),
        )
    )


def residue_map(residues: DataFrame) -> DataFrame:
    """One row per residue number: pocket residue lists carry no chain, so the last chain wins."""
    return residues.groupBy("structure_id", "resseq").agg(
        F.max_by("sasa", "chain").alias("sasa"),
        F.max_by("plddt", F.when(F.col("plddt").isNotNull(), F.col("chain"))).alias("plddt"),
    )


def lining_residues(pockets: DataFrame, residues: DataFrame, cutoff: float = 8.0) -> DataFrame:
    """Distinct (structure, pocket, resseq): a pocket's own list, else residues with CA within ``cutoff``."""
    own = pockets.where(F.size("residue_ids") > 0).select(
        *POCKET_KEY, F.explode(F.array_distinct(F.col("residue_ids").cast("array<int>"))).alias("resseq")
    )
    open_pockets = pockets.where(F.coalesce(F.size("residue_ids"), F.lit(0)) <= 0).select(
        *POCKET_KEY, F.col("center_x").alias("x"), F.col("center_y").alias("y"), F.col("center_z").alias("z")
    )
    alphas = residues.where("ca_x IS NOT NULL").select(
        "structure_id", "resseq", F.col("ca_x").alias("x"), F.col("ca_y").alias("y"), F.col("ca_z").alias("z")
    )
    near = radius_pairs(open_pockets, alphas, cutoff).select(*POCKET_KEY, F.col("resseq").cast("int")).distinct()
    return own.unionByName(near)


def pocket_sasa(pockets: DataFrame, lining: DataFrame, by_number: DataFrame) -> DataFrame:
    """Mean residue area over the lining; unknown residues count as 0, an empty lining gives 0."""
    means = (
        lining.join(by_number.select("structure_id", "resseq", "sasa"), ["structure_id", "resseq"], "left")
        .groupBy(*POCKET_KEY)
        .agg(F.avg(F.coalesce("sasa", F.lit(0.0))).alias("sasa"), F.count("*").alias("residue_count"))
    )
    return (
        pockets.select(*POCKET_KEY)
        .join(means, list(POCKET_KEY), "left")
        .select(
            *POCKET_KEY,
            F.coalesce("sasa", F.lit(0.0)).alias("sasa"),
            F.coalesce("residue_count", F.lit(0)).alias("residue_count"),
        )
    )


def basic_residue_count(pockets: DataFrame, lining: DataFrame, residues: DataFrame) -> DataFrame:
    """Basic residues among the lining, counted over all chains."""
    basics = residues.where(is_basic("resname")).select("structure_id", "resseq")
    counts = lining.join(basics, ["structure_id", "resseq"]).groupBy(*POCKET_KEY).agg(F.count("*").alias("n"))
    return (
        pockets.select(*POCKET_KEY)
        .join(counts, list(POCKET_KEY), "left")
        .select(*POCKET_KEY, F.coalesce("n", F.lit(0)).alias("basic_residues"))
    )


def plddt_summary(
    pairs: DataFrame, by_number: DataFrame, min_plddt: float = 70.0, keys: Sequence[str] = POCKET_KEY
) -> DataFrame:
    """Mean, minimum and confident fraction of the residues found, with the 80 % / −10 gate."""
    value = F.col("plddt")
    fraction = F.avg(F.when(value.isNotNull(), (value >= min_plddt).cast("double")))
    return (
        pairs.join(by_number.select("structure_id", "resseq", "plddt"), ["structure_id", "resseq"], "left")
        .groupBy(*keys)
        .agg(
            F.avg(value).alias("plddt_mean"),
            F.min(value).alias("plddt_min"),
            F.coalesce(fraction, F.lit(0.0)).alias("plddt_fraction_above_cutoff"),
        )
        .withColumn(
            "passes_confidence_gate",
            F.coalesce(
                (F.col("plddt_fraction_above_cutoff") >= 0.80) & (F.col("plddt_min") >= min_plddt - 10.0),
                F.lit(False),
            ),
        )
    )


def lining_features(pockets: DataFrame, residues: DataFrame, cutoff: float = 8.0, min_plddt: float = 70.0) -> DataFrame:
    """Area, residue count, basic count and pLDDT of every pocket in one pass over its lining.

    Residue rows are folded to one row per residue number first, so the lining is joined once and
    the four features come from one aggregation.
    """
    folded = residues.groupBy("structure_id", "resseq").agg(
        F.max_by("sasa", "chain").alias("sasa"),
        F.max_by("plddt", F.when(F.col("plddt").isNotNull(), F.col("chain"))).alias("plddt"),
        F.count_if(is_basic("resname")).alias("n_basic"),
    )
    lined = lining_residues(pockets, residues, cutoff).join(folded, ["structure_id", "resseq"], "left")
    means = lined.groupBy(*POCKET_KEY).agg(
        F.avg(F.coalesce("sasa", F.lit(0.0))).alias("sasa"),
        F.sum(F.coalesce("n_basic", F.lit(0))).alias("basic_residues"),
        F.count("*").alias("residue_count"),
        F.avg("plddt").alias("plddt_confidence"),
    )
    return (
        pockets.join(means, list(POCKET_KEY), "left")
        .withColumn("sasa", F.coalesce("sasa", F.lit(0.0)))
        .withColumn("basic_residues", F.coalesce("basic_residues", F.lit(0)))
        .withColumn("residue_count", F.coalesce("residue_count", F.lit(0)))
    )


def residue_plddt(atoms: DataFrame) -> DataFrame:
    """Per-residue confidence from the B-factors of CA atoms; the last chain wins."""
    return (
        atoms.where((F.col("atom_name") == "CA") & ~F.col("is_het"))
        .groupBy("structure_id", "resseq")
        .agg(F.max_by("bfactor", "chain").alias("plddt"))
    )


def mean_plddt(atoms: DataFrame) -> DataFrame:
    return residue_plddt(atoms).groupBy("structure_id").agg(F.avg("plddt").alias("mean_plddt"))


def ligand_burial(atoms: DataFrame) -> DataFrame:
    """Ligand and phosphate area per structure from per-atom areas; the area change equals the former."""
    ligand = is_ligand("resname")
    phosphate = ligand & is_phosphate_atom("atom_name")
    return atoms.groupBy("structure_id").agg(
        F.sum(F.when(ligand, F.col("sasa"))).alias("ligand_sasa"),
        F.sum(F.when(phosphate, F.col("sasa"))).alias("phosphate_sasa"),
        F.sum(F.when(ligand, F.col("sasa"))).alias("delta_sasa"),
    )


def ligand_total_sasa(atoms: DataFrame, ligand: str | None = None) -> DataFrame:
    """Summed area of all copies of each ligand name; structures without it have no row."""
    rows = atoms.where(is_ligand("resname") if ligand is None else F.col("resname") == ligand)
    return rows.groupBy("structure_id", "resname").agg(F.sum("sasa").alias("total_sasa"))


#: Small cells of ``solvent_area`` along the reach of an atom; more of them leave fewer atoms to meet all neighbours.
CELLS_PER_REACH = 3


def _sphere(points: int) -> np.ndarray:
    """Points of a golden-angle spiral on the unit sphere."""
    k = np.arange(points)
    z = 1 - (2 * k + 1) / points
    turn = k * np.pi * (3 - np.sqrt(5.0))
    ring = np.sqrt(1 - z * z)
    return np.stack([np.cos(turn) * ring, np.sin(turn) * ring, z])


def solvent_area(
    atoms: DataFrame,
    group: Sequence[str] = ("structure_id",),
    atom_key: str = "atom_id",
    probe: float = 1.4,
    points: int = 100,
    radii: Mapping[str, float] = RADII,
    other_radius: float = 2.0,
) -> DataFrame:
    """Solvent-accessible area per atom by the rolling-probe method of Shrake and Rupley (1973).

    A grid join finds the neighbours of each atom. Each neighbour turns into bit masks of the sphere
    points it buries, and ``bit_or`` merges the masks, so no neighbour list is ever collected. An atom first meets one neighbour of each small
    cell around it, whose number does not grow with the atoms; only atoms with a point that none of those buries meet all neighbours. Atoms with the same position and
    radius are folded into one weighted row before the join, since they bury alike; two or more of them bury each other.
    """
    element = F.upper(F.col("element")) if "element" in atoms.columns else F.upper(F.substring("atom_name", 1, 1))
    radius = F.lit(other_radius)
    for name, size in radii.items():
        radius = F.when(element == name, size).otherwise(radius)
    sized = atoms.withColumn("_r", radius + probe)
    reach = 2 * (max(*radii.values(), other_radius) + probe)
    spheres = _sphere(points)
    starts = list(range(0, points, 60))
    names = [f"m{i}" for i in range(len(starts))]

    @F.pandas_udf(", ".join(f"{name} long" for name in names))
    def buried(dx: pd.Series, dy: pd.Series, dz: pd.Series, own: pd.Series, other: pd.Series) -> pd.DataFrame:
        gap = np.stack([dx, dy, dz], axis=1)
        r = own.to_numpy()
        # A point c + r·u lies within R of the neighbour n iff u·(c − n) ≤ (R² − |c − n|² − r²) / 2r.
        limit = (other.to_numpy() ** 2 - (gap**2).sum(axis=1) - r**2) / (2 * r)
        hidden = gap @ spheres <= limit[:, None] + 1e-12
        weights = np.left_shift(np.int64(1), np.arange(60, dtype=np.int64))
        masks = {}
        for name, start in zip(names, starts):
            part = hidden[:, start : start + 60]
            masks[name] = part @ weights[: part.shape[1]]
        return pd.DataFrame(masks)

    spot = [*group, "x", "y", "z", "_r"]
    spots = freeze(sized.groupBy(*spot).agg(F.count("*").alias("_atoms")))
    others = spots.select(*group, "x", "y", "z", F.col("_r").alias("_other_r"))

    def masks(pairs: DataFrame) -> DataFrame:
        itself = (F.col("distance") == 0) & (F.col("_r") == F.col("_other_r"))
        met = pairs.where((~itself | (F.col("_atoms") > 1)) & (F.col("distance") < F.col("_r") + F.col("_other_r")))
        return (
            met.select(*spot, buried("dx", "dy", "dz", "_r", "_other_r").alias("_m"))
            .groupBy(*spot)
            .agg(*[F.bit_or(F.col(f"_m.{name}")).alias(f"_{name}") for name in names])
        )

    # One neighbour of each small cell and radius buries most atoms of a dense structure entirely.
    fine = [F.floor(F.col(axis) / (reach / CELLS_PER_REACH)) for axis in "xyz"]
    first = F.min(F.struct("x", "y", "z")).alias("_first")
    few = others.groupBy(*group, "_other_r", *[c.alias(f"_f{i}") for i, c in enumerate(fine)]).agg(first)
    few = few.select(*group, "_other_r", "_first.*")
    kept = spots.withColumns({f"_s{axis}": F.col(axis) for axis in "xyz"})
    near = radius_pairs(few, kept, reach, group).withColumns(
        {axis: F.col(f"_s{axis}") for axis in "xyz"} | {f"d{axis}": -F.col(f"d{axis}") for axis in "xyz"}
    )
    settled = freeze(masks(near))
    # The others meet the rest of their neighbours.
    full = sum((F.bit_count(f"_{name}") for name in names), start=F.lit(0)) == points
    open_spots = spots.join(settled.where(full), spot, "left_anti")
    later = pairs_with_others(open_spots, others, few, reach, group)
    merged = settled
    if later is not None:
        both = settled.unionByName(masks(later))
        merged = both.groupBy(*spot).agg(*[F.bit_or(f"_{name}").alias(f"_{name}") for name in names])
    hidden = sum((F.coalesce(F.bit_count(f"_{name}"), F.lit(0)) for name in names), start=F.lit(0))
    area = (points - hidden) * (4 * float(np.pi) / points) * F.col("_r") * F.col("_r")
    return (
        sized.drop("sasa")
        .join(merged, spot, "left")
        .withColumn("sasa", area)
        .drop("_r", *[f"_{name}" for name in names])
    )
