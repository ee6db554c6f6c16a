"""Potential grids and pH profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import protonation

_AXES = ("x", "y", "z")
FALLBACK_PKA = 10.5
PHYSIOLOGICAL_PH = 7.4


def sample_grid(
    points: DataFrame, headers: DataFrame, grid: DataFrame, point_key: Sequence[str], fallback: str | None = None
) -> DataFrame:
    """Trilinear value of a potential map at each point, clamped to the border cell.

    ``headers`` has one row per map: ``map_id``, ``n*`` counts, ``o*`` origin and ``d*`` spacing. A point becomes eight
    weighted corner rows that meet the grid in an equi-join, so no map is ever held in one place.
    Points without a map take ``fallback``.
    """
    placed = points.join(headers, "map_id")
    for a in _AXES:
        step = (F.col(a) - F.col(f"o{a}")) / F.col(f"d{a}")
        # A point exactly on a grid plane belongs to the cell below it, as in a left-sided search.
        index = F.greatest(F.least(F.ceil(step) - 1, F.col(f"n{a}") - 2), F.lit(0)).cast("long")
        placed = placed.withColumn(f"_i{a}", index).withColumn(f"_t{a}", step - F.col(f"_i{a}"))
    corners = []
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                weight = F.lit(1.0)
                for bit, a in zip((i, j, k), _AXES):
                    weight = weight * (F.col(f"_t{a}") if bit else 1 - F.col(f"_t{a}"))
                corners.append(
                    F.struct(
                        (F.col("_ix") + i).alias("ix"),
                        (F.col("_iy") + j).alias("iy"),
                        (F.col("_iz") + k).alias("iz"),
                        weight.alias("w"),
                    )
                )
    exploded = placed.select(*point_key, "map_id", F.explode(F.array(*corners)).alias("c")).select(
        *point_key, "map_id", "c.ix", "c.iy", "c.iz", "c.w"
    )
    sampled = (
        exploded.join(grid, ["map_id", "ix", "iy", "iz"])
        .groupBy(*point_key)
        .agg(F.sum(F.col("w") * F.col("value")).alias("_potential"))
    )
    value = F.col("_potential") if fallback is None else F.coalesce("_potential", F.col(fallback))
    return points.join(sampled, list(point_key), "left").withColumn("potential", value).drop("_potential")


def site_pka(sites: DataFrame, pka: DataFrame) -> DataFrame:
    """Residues of each site with their pKa; a site that matches none uses 10.5 for each listed residue."""
    found = sites.join(pka.select("residue_number", "pka"), "residue_number").select("site", "residue_number", "pka")
    matched = found.select("site").distinct()
    bare = sites.join(matched, "site", "left_anti").select("site", "residue_number", F.lit(FALLBACK_PKA).alias("pka"))
    return found.unionByName(bare)


def site_potentials(sites: DataFrame, pka: DataFrame, energy_by_ph: Mapping[float, float]) -> DataFrame:
    """Charge factor (summed protonation) and energy × factor per (site, pH)."""
    grid = F.array(*[F.struct(F.lit(float(ph)).alias("ph"), F.lit(float(e)).alias("energy")) for ph, e in energy_by_ph.items()])
    return (
        site_pka(sites, pka)
        .withColumn("_g", F.explode(grid))
        .select("site", "_g.ph", "_g.energy", "pka")
        .groupBy("site", "ph", "energy")
        .agg(F.sum(protonation("ph", "pka")).alias("site_charge_factor"))
        .withColumn("site_potential", F.col("energy") * F.col("site_charge_factor"))
    )


def optimal_ph(potentials: DataFrame) -> DataFrame:
    """pH of the largest potential per site, the smallest such pH on ties."""
    best = F.struct("site_potential", (-F.col("ph")).alias("minus_ph"))
    return potentials.groupBy("site").agg(F.max_by("ph", best).alias("optimal_ph"))


def compare_profiles(potentials: DataFrame, site_types: DataFrame) -> DataFrame:
    """Mean potential per (site type, pH); sites without a type are ``unlabeled``."""
    typed = potentials.join(site_types.select("site", "site_type"), "site", "left")
    return typed.groupBy(F.coalesce("site_type", F.lit("unlabeled")).alias("site_type"), "ph").agg(
        F.avg("site_potential").alias("mean_site_potential")
    )


def ph_sensitive(sites: DataFrame, pka: DataFrame, ph: float = PHYSIOLOGICAL_PH, window: float = 1.0) -> DataFrame:
    """Site residues whose pKa lies within ``window`` of ``ph``."""
    near = pka.where(F.abs(F.col("pka") - ph) <= window)
    return near.join(sites.select("site", "residue_number").distinct(), "residue_number")
