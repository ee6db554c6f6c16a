"""Distributed neighbour search: radius join and nearest distance on a cell grid.

Cells split a large structure over many join keys, so one structure holding most atoms does not end
in one task; cells that crowd are counted and cut into halves. Both searches are plain equi-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import is_basic, is_ligand
from ..runtime import freeze

_AXES = ("x", "y", "z")


# The 27 steps from a cell to itself and the cells that touch it.
_STEPS = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def _cell(size: float) -> list[Column]:
    return [F.floor(F.col(axis) / size).cast("long").alias(f"_c{axis}") for axis in _AXES]


def _around(rows: DataFrame, size: float) -> DataFrame:
    """Each row once for every cell around it. The steps are a constant, so the plan stays small."""
    steps = F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(_AXES, step)]) for step in _STEPS])
    cells = [(F.floor(F.col(a) / size) + F.col(f"_step.{a}")).cast("long").alias(f"_c{a}") for a in _AXES]
    return rows.withColumn("_step", F.explode(steps)).select(*rows.columns, *cells)


def crowded_cells(targets: DataFrame, size: float, group: Sequence[str], limit: int, depth: int = 8) -> list[DataFrame]:
    """One table a level of the cells with more than ``limit`` targets, from cells of ``size`` down by halves.

    ``_split`` says that a cell is cut into its eight halves; one that is not, because its targets share one position or ``depth`` is
    reached, is dealt to ``_parts`` keys. A table has at most one row for ``limit`` targets; only the rows of split cells are counted
    on the next level, and the list is empty if no cell is crowded.
    """
    key = [*group, "_cx", "_cy", "_cz"]
    levels: list[DataFrame] = []
    inside = targets.select(*group, *_AXES)
    while True:
        edge = size / 2 ** len(levels)
        spread = F.greatest(*[F.max(a) - F.min(a) for a in _AXES])
        counted = inside.select("*", *_cell(edge)).groupBy(*key).agg(F.count("*").alias("_n"), spread.alias("_spread"))
        split = (F.col("_spread") > 0) & F.lit(len(levels) < depth)
        parts = F.when(split, 1).otherwise(F.ceil(F.col("_n") / limit)).cast("long")
        table = freeze(counted.where(F.col("_n") > limit).select(*key, split.alias("_split"), parts.alias("_parts")))
        if table.isEmpty():
            return levels
        levels.append(table)
        if table.where("_split").isEmpty():
            return levels
        inside = inside.select("*", *_cell(edge)).join(table.where("_split"), key, "left_semi").select(*group, *_AXES)


def _found(rows: DataFrame, table: DataFrame, level: int, group: Sequence[str]) -> DataFrame:
    """``rows`` with ``_split`` and ``_parts`` of their cell, if it stands in the table of its level."""
    key = [*group, "_level", "_cx", "_cy", "_cz"]
    joined = rows.join(table.withColumn("_level", F.lit(level)), key, "left")
    return joined.withColumns({"_split": F.coalesce("_split", F.lit(False)), "_parts": F.coalesce("_parts", F.lit(1))})


def place_targets(targets: DataFrame, size: float, group: Sequence[str], levels: Sequence[DataFrame]) -> DataFrame:
    """Every target once, with its cell: the first one on the way down that is not split."""
    placed = targets.select("*", *_cell(size)).withColumns({"_level": F.lit(0), "_part": F.lit(0).cast("long")})
    for level, table in enumerate(levels):
        below = {f"_c{a}": F.floor(F.col(a) / (size / 2 ** (level + 1))).cast("long") for a in _AXES}
        found = _found(placed, table, level, group)
        dealt = F.pmod(F.xxhash64(*targets.columns), F.greatest("_parts", F.lit(1)))
        placed = found.withColumns(
            {name: F.when(F.col("_split"), cell).otherwise(F.col(name)) for name, cell in below.items()}
            | {
                "_level": F.when(F.col("_split"), level + 1).otherwise(F.col("_level")),
                "_part": F.when(F.col("_parts") > 1, dealt).otherwise(F.col("_part")),
            }
        ).drop("_split", "_parts")
    return placed


def place_points(points: DataFrame, size: float, group: Sequence[str], levels: Sequence[DataFrame]) -> DataFrame:
    """Every point once for each unsplit cell and part that can hold a target within ``size``.

    Cells above the point's reach are left out where a cell is split, so a point meets few halves.
    """
    placed = _around(points, size).withColumns({"_level": F.lit(0), "_part": F.lit(0).cast("long")})
    halves = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    for level, table in enumerate(levels):
        scale = 2 ** (level + 1)
        steps = F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(_AXES, half)]) for half in halves])
        same = F.array(F.struct(*[F.lit(0).alias(a) for a in _AXES]))
        found = _found(placed, table, level, group).withColumn("_half", F.explode(F.when(F.col("_split"), steps).otherwise(same)))
        gap = F.lit(0.0)
        for a in _AXES:
            at, low = F.col(a) / size * scale, F.col(f"_c{a}") * 2 + F.col(f"_half.{a}")
            outside = F.greatest(low - at, at - low - 1, F.lit(0.0))
            gap = gap + outside * outside
        near = found.where(~F.col("_split") | (gap <= scale * scale * (1 + 1e-6)))
        cells = {f"_c{a}": F.when(F.col("_split"), F.col(f"_c{a}") * 2 + F.col(f"_half.{a}")).otherwise(F.col(f"_c{a}")) for a in _AXES}
        own = F.array(F.col("_part"))
        parts = F.when(F.col("_parts") > 1, F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).otherwise(own)
        placed = near.withColumns(
            cells | {"_level": F.when(F.col("_split"), level + 1).otherwise(F.col("_level")), "_part": F.explode(parts)}
        ).drop("_split", "_parts", "_half")
    return placed


def radius_pairs(
    points: DataFrame,
    targets: DataFrame,
    radius: float,
    group: Sequence[str] = ("structure_id",),
    salts: int = 1,
    limit: int = 2000,
) -> DataFrame:
    """Pairs within ``radius`` inside the same group, with ``dx, dy, dz`` (point − target) and ``distance``.

    ``points`` should be the smaller side: it is repeated for its 27 surrounding cells, the targets are
    not. All other columns of both sides are kept and must differ in name. Targets are counted per cell first. A cell with more than
    ``limit`` of them is cut into halves until it has no more, and one whose targets all share a position is dealt to several keys by
    the hash of the row, so the targets of a join key stay near ``limit`` wherever they crowd. ``salts`` splits every cell of targets
    into that many join keys in addition.
    """
    levels = crowded_cells(targets, radius, group, limit)
    key = [*group, "_level", "_part", "_cx", "_cy", "_cz"]
    spread = place_points(points, radius, group, levels)
    placed = place_targets(targets, radius, group, levels).withColumnsRenamed({a: f"_t{a}" for a in _AXES})
    if salts > 1:
        key.append("_salt")
        spread = spread.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)])))
        placed = placed.withColumn("_salt", F.pmod(F.xxhash64(*placed.columns), F.lit(salts)).cast("long"))
    joined = spread.join(placed, key)
    gaps = [(F.col(a) - F.col(f"_t{a}")).alias(f"d{a}") for a in _AXES]
    kept = [c for c in joined.columns if c not in {"_cx", "_cy", "_cz", "_tx", "_ty", "_tz", "_salt", "_level", "_part"}]
    distance = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    return joined.select(*kept, *gaps).withColumn("distance", distance).where(F.col("distance") <= radius)


def pairs_with_others(
    points: DataFrame, targets: DataFrame, met: DataFrame, radius: float, group: Sequence[str] = ("structure_id",)
) -> DataFrame | None:
    """``radius_pairs`` with the targets that are not in ``met`` (of the same columns); None if there are no others."""
    rest = freeze(targets.join(met, met.columns, "left_anti"))
    return None if rest.isEmpty() else radius_pairs(points, rest, radius, group)


def _box_bounds() -> tuple[Column, Column]:
    """Squared distance from the row's point to the nearest and the farthest spot of its box."""
    low, high = F.lit(0.0), F.lit(0.0)
    for a in _AXES:
        p, lo, hi = F.col(a), F.col(f"_lo{a}"), F.col(f"_hi{a}")
        outside = F.greatest(lo - p, p - hi, F.lit(0.0))
        reach = F.greatest(F.abs(p - lo), F.abs(hi - p))
        low, high = low + outside * outside, high + reach * reach
    return low, high


def _boxes(df: DataFrame, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    parts = []
    for a in _AXES:
        parts += [F.min(f"{lo}{a}").alias(f"_lo{a}"), F.max(f"{hi}{a}").alias(f"_hi{a}")]
    return df.groupBy(*keys).agg(*parts)


def _closest_boxes(candidates: DataFrame, point_key: Sequence[str]) -> DataFrame:
    """Drop boxes that cannot hold the nearest target: farther than some box lies at its farthest."""
    low, high = _box_bounds()
    bounded = candidates.withColumn("_near", low).withColumn("_far", high)
    best = Window.partitionBy(*point_key)
    return (
        bounded.withColumn("_best", F.min("_far").over(best))
        .where(F.col("_near") <= F.col("_best"))
        .drop("_near", "_far", "_best", *[f"_{e}{a}" for e in ("lo", "hi") for a in _AXES])
    )


def _box_levels(placed: DataFrame, group: str, fine: float, factor: int, levels: int) -> list[DataFrame]:
    """Boxes around the targets of each cell, from cells of size ``fine`` up; a cell lies in one of ``factor`` times its size."""
    cells = [f"_k{a}" for a in _AXES]
    boxes = [_boxes(placed, [group, *cells], "_t", "_t")]
    for _ in range(levels):
        above = boxes[-1].withColumns({f"_k{a}": F.floor(F.col(f"_k{a}") / factor).cast("long") for a in _AXES})
        boxes.append(_boxes(above, [group, *cells], "_lo", "_hi"))
    return boxes


def _level_count(spots: DataFrame, group: str, fine: float, factor: int) -> int:
    """How often cells must grow until no group reaches over more than two of them on any axis."""
    reach = [F.max(f"_t{a}") - F.min(f"_t{a}") for a in _AXES]
    widest = spots.groupBy(group).agg(F.greatest(*reach).alias("reach")).agg(F.max("reach")).first()[0] or 0.0
    levels = 0
    while fine * factor**levels < widest:
        levels += 1
    return levels


def nearest_distance(
    points: DataFrame,
    targets: DataFrame,
    point_key: Sequence[str],
    group: str = "structure_id",
    fine: float = 8.0,
    factor: int = 4,
) -> DataFrame:
    """``point_key`` with the ``distance`` to the nearest target of the same group (no row if it has none).

    Targets lie in a hierarchy of cells. A point starts with the cells at the root, eight of its group at most, and goes down by one join
    on (group, parent cell) for each level; boxes that cannot hold the nearest target are dropped on every level, so a point meets the
    boxes around its nearest target, however many its group has. Targets without a finite position are left out. The target positions are
    frozen, so that however they were derived is run once.
    """
    finite = " AND ".join(f"abs({a}) < double('infinity')" for a in _AXES)
    spots = freeze(targets.where(finite).select(group, *_AXES).distinct()).withColumnsRenamed({a: f"_t{a}" for a in _AXES})
    key = list(dict.fromkeys([*point_key, group]))
    located = points.select(*key, *_AXES)
    gap = F.sqrt(
        sum(((F.col(a) - F.col(f"_t{a}")) * (F.col(a) - F.col(f"_t{a}")) for a in _AXES), start=F.lit(0.0))
    )
    cells, parents = [f"_k{a}" for a in _AXES], [f"_p{a}" for a in _AXES]
    placed = spots.select("*", *[F.floor(F.col(f"_t{a}") / fine).cast("long").alias(f"_k{a}") for a in _AXES])
    *lower, root = _box_levels(placed, group, fine, factor, _level_count(spots, group, fine, factor))
    candidates = _closest_boxes(located.join(root, group), key)
    for boxes in reversed(lower):
        under = boxes.withColumns({f"_p{a}": F.floor(F.col(f"_k{a}") / factor).cast("long") for a in _AXES})
        above = candidates.withColumnsRenamed(dict(zip(cells, parents, strict=True)))
        candidates = _closest_boxes(above.join(under, [group, *parents]).drop(*parents), key)
    pairs = candidates.join(placed, [group, *cells])
    return pairs.groupBy(*key).agg(F.min(gap).alias("distance")).select(*point_key, "distance")


def burial_depth(
    pockets: DataFrame, atoms: DataFrame, min_sasa: float = 1.0, key: Sequence[str] = ("structure_id", "pocket_id")
) -> DataFrame:
    """Distance from each pocket centre to the nearest exposed protein atom, 0 when there is none.

    A structure without any exposed atom falls back to all its protein atoms.
    """
    protein = atoms.where(~F.col("is_het")).select("structure_id", *_AXES, "sasa")
    exposed = F.coalesce(F.col("sasa") > min_sasa, F.lit(False))
    has_surface = protein.groupBy("structure_id").agg(F.bool_or(exposed).alias("_surface"))
    surface = protein.join(has_surface, "structure_id").where(exposed | ~F.col("_surface"))
    centres = pockets.select(
        *key, F.col("center_x").alias("x"), F.col("center_y").alias("y"), F.col("center_z").alias("z")
    )
    near = nearest_distance(centres, surface, key)
    return (
        pockets.select(*key)
        .join(near, list(key), "left")
        .select(*key, F.coalesce("distance", F.lit(0.0)).alias("burial_depth"))
    )


def ligand_centroids(atoms: DataFrame) -> DataFrame:
    """Mean position of all ligand atoms of a structure, over all copies."""
    return (
        atoms.where(is_ligand("resname"))
        .groupBy("structure_id")
        .agg(*[F.avg(a).alias(f"ligand_{a}") for a in _AXES], F.count("*").alias("ligand_atoms"))
    )


def ligand_burial_depth(atoms: DataFrame, residues: DataFrame, min_sasa: float = 30.0) -> DataFrame:
    """Distance from the ligand centroid to the nearest CA of an exposed residue, 0 when there is none."""
    centroid = ligand_centroids(atoms).select("structure_id", *[F.col(f"ligand_{a}").alias(a) for a in _AXES])
    exposed = residues.where((F.col("sasa") >= min_sasa) & F.col("ca_x").isNotNull()).select(
        "structure_id", *[F.col(f"ca_{a}").alias(a) for a in _AXES]
    )
    near = nearest_distance(centroid, exposed, ["structure_id"])
    return (
        centroid.select("structure_id")
        .join(near, "structure_id", "left")
        .select("structure_id", F.coalesce("distance", F.lit(0.0)).alias("burial_depth"))
    )


def coordinating_residues(atoms: DataFrame, cutoff: float = 5.0) -> DataFrame:
    """Distinct basic residues with any atom within ``cutoff`` of any ligand atom."""
    ligand = atoms.where(is_ligand("resname")).select("structure_id", *_AXES)
    basic = atoms.where(is_basic("resname")).select("structure_id", "resseq", *_AXES)
    return radius_pairs(ligand, basic, cutoff).select("structure_id", "resseq").distinct()


def ligand_context(atoms: DataFrame, cutoff: float = 5.0, agg: str = "min") -> DataFrame:
    """Per structure with a ligand: coordinating residue count, ligand area over copies, centroid.

    ``agg`` picks how the area of several copies is combined: ``min`` or ``sum``.
    """
    if agg not in ("min", "sum"):
        raise ValueError("agg must be 'min' or 'sum'")
    copies = (
        atoms.where(is_ligand("resname"))
        .groupBy("structure_id", "chain", "resseq")
        .agg(F.sum("sasa").alias("copy_sasa"))
        .groupBy("structure_id")
        .agg((F.min if agg == "min" else F.sum)("copy_sasa").alias("ligand_sasa"))
    )
    counts = coordinating_residues(atoms, cutoff).groupBy("structure_id").agg(F.count("*").alias("n"))
    return (
        ligand_centroids(atoms)
        .join(copies, "structure_id")
        .join(counts, "structure_id", "left")
        .withColumn("n_coordinating", F.coalesce("n", F.lit(0)))
        .drop("n")
    )
