"""Registered queries: neighbour joins, pocket features, potentials, pH profiles, dynamics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import electro, features, matching, spatial, trajectory
from . import domain, screen
from .oracle_views import oracle
from .queries_comparative import rounded
from .registry import query


def _parts(spark, sf):
    atoms = domain.atoms(spark, sf)
    residues = features.residues_from_atoms(atoms)
    return domain.pocket_centres(spark, sf), atoms, residues


@query("lining_residues", oracle("SELECT structure_id, pocket_id, resseq FROM v_lining", "v_lining"))
def lining_residues(spark, sf):
    centres, _, residues = _parts(spark, sf)
    return features.lining_residues(centres, residues)


@query(
    "radius_pairs",
    oracle(
        """SELECT a.structure_id, a.atom_id, b.atom_id AS other_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6)
             AS distance FROM v_atoms a JOIN v_atoms b ON a.structure_id = b.structure_id AND a.atom_id != b.atom_id
           WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 4""",
        "v_atoms",
    ),
)
def radius_pairs(spark, sf):
    rows = domain.atoms(spark, sf).select("structure_id", "atom_id", "x", "y", "z")
    pairs = spatial.radius_pairs(rows, rows.withColumnRenamed("atom_id", "other_id"), 4.0)
    return rounded(pairs.where("atom_id != other_id").select("structure_id", "atom_id", "other_id", "distance"), "distance")


@query(
    "pocket_sasa",
    oracle(
        """SELECT c.structure_id, c.pocket_id, round(coalesce(avg(coalesce(m.sasa, 0)) FILTER (WHERE l.resseq IS NOT NULL), 0), 6)
             AS sasa, count(l.resseq) AS residue_count
           FROM v_centres c LEFT JOIN v_lining l USING (structure_id, pocket_id)
           LEFT JOIN v_residue_map m USING (structure_id, resseq) GROUP BY c.structure_id, c.pocket_id""",
        "v_lining",
        "v_residue_map",
    ),
)
def pocket_sasa(spark, sf):
    centres, _, residues = _parts(spark, sf)
    lining = features.lining_residues(centres, residues)
    return rounded(features.pocket_sasa(centres, lining, features.residue_map(residues)), "sasa")


@query(
    "basic_count",
    oracle(
        """SELECT c.structure_id, c.pocket_id, count(r.resname) AS basic_residues
           FROM v_centres c LEFT JOIN v_lining l USING (structure_id, pocket_id)
           LEFT JOIN (SELECT * FROM v_residues WHERE resname IN ('ARG', 'LYS', 'HIS')) r USING (structure_id, resseq)
           GROUP BY c.structure_id, c.pocket_id""",
        "v_lining",
    ),
)
def basic_count(spark, sf):
    centres, _, residues = _parts(spark, sf)
    return features.basic_residue_count(centres, features.lining_residues(centres, residues), residues)


@query(
    "pocket_plddt",
    oracle(
        """SELECT structure_id, pocket_id, round(mean, 6) AS plddt_mean, low AS plddt_min, round(fraction, 6)
             AS plddt_fraction_above_cutoff, coalesce(fraction >= 0.80 AND low >= 60, false) AS passes_confidence_gate
           FROM (SELECT l.structure_id, l.pocket_id, avg(plddt) AS mean, min(plddt) AS low,
               coalesce(avg((plddt >= 70)::INT) FILTER (WHERE plddt IS NOT NULL), 0) AS fraction
             FROM v_lining l LEFT JOIN v_residue_map USING (structure_id, resseq) GROUP BY ALL)""",
        "v_lining",
        "v_residue_map",
    ),
)
def pocket_plddt(spark, sf):
    centres, _, residues = _parts(spark, sf)
    summary = features.plddt_summary(features.lining_residues(centres, residues), features.residue_map(residues))
    return rounded(summary, "plddt_mean", "plddt_fraction_above_cutoff")


_NEAR = "min(sqrt((c.center_x - a.x) ** 2 + (c.center_y - a.y) ** 2 + (c.center_z - a.z) ** 2))"
_SURFACE = """f AS (SELECT structure_id, bool_or(sasa > 12) AS s FROM v_atoms WHERE NOT is_het GROUP BY structure_id),
  t AS (SELECT v_atoms.* FROM v_atoms JOIN f USING (structure_id) WHERE NOT is_het AND (sasa > 12 OR NOT s))"""


@query(
    "burial_depth_nn",
    oracle(
        f"""WITH {_SURFACE}
        SELECT c.structure_id, c.pocket_id, round(coalesce({_NEAR}, 0), 6) AS burial_depth
        FROM v_centres c LEFT JOIN t a ON a.structure_id = c.structure_id GROUP BY ALL""",
        "v_centres",
    ),
)
def burial_depth_nn(spark, sf):
    centres, atoms, _ = _parts(spark, sf)
    return rounded(spatial.burial_depth(centres, atoms, 12.0), "burial_depth")


@query(
    "nearest_by_boxes",
    oracle(
        """SELECT a.structure_id, a.atom_id, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 6) AS distance
           FROM v_atoms a JOIN v_atoms b ON a.structure_id = b.structure_id AND NOT b.is_het WHERE a.is_het OR a.atom_id % 2 = 1
           GROUP BY ALL""",
        "v_atoms",
    ),
)
def nearest_by_boxes(spark, sf):
    atoms = domain.atoms(spark, sf)
    points = atoms.where("is_het OR atom_id % 2 = 1").select("structure_id", "atom_id", "x", "y", "z")
    near = spatial.nearest_distance(
        points, atoms.where("NOT is_het"), ["structure_id", "atom_id"], fine=4.0
    )
    return rounded(near, "distance")


@query(
    "ligand_burial_depth",
    oracle(
        """WITH c AS (SELECT structure_id, avg(x) AS center_x, avg(y) AS center_y, avg(z) AS center_z FROM v_atoms WHERE is_het
            GROUP BY structure_id)
        SELECT c.structure_id, round(coalesce(min(sqrt((center_x - ca_x) ** 2 + (center_y - ca_y) ** 2 + (center_z - ca_z) ** 2)), 0), 6)
          AS burial_depth FROM c LEFT JOIN v_residues r ON c.structure_id = r.structure_id AND r.sasa >= 10 GROUP BY c.structure_id""",
        "v_residues",
    ),
)
def ligand_burial_depth(spark, sf):
    _, atoms, residues = _parts(spark, sf)
    return rounded(spatial.ligand_burial_depth(atoms, residues, 10.0), "burial_depth")


_NEAR_LIGAND = """nb AS (SELECT DISTINCT l.structure_id, b.resseq FROM v_atoms l JOIN v_atoms b ON l.structure_id = b.structure_id
    WHERE l.is_het AND b.resname IN ('ARG', 'LYS', 'HIS')
      AND sqrt((l.x - b.x) ** 2 + (l.y - b.y) ** 2 + (l.z - b.z) ** 2) <= 5)"""


@query(
    "coordinating_residues",
    oracle(f"WITH {_NEAR_LIGAND} SELECT structure_id, resseq FROM nb", "v_atoms"),
)
def coordinating_residues(spark, sf):
    return spatial.coordinating_residues(domain.atoms(spark, sf))


def _context_sql(agg):
    return oracle(
        f"""WITH {_NEAR_LIGAND}, c AS (SELECT structure_id, chain, resseq, sum(sasa) AS s FROM v_atoms WHERE is_het GROUP BY ALL),
        k AS (SELECT structure_id, {agg}(s) AS ligand_sasa FROM c GROUP BY structure_id)
        SELECT a.structure_id, round(avg(x), 6) AS ligand_x, round(avg(y), 6) AS ligand_y, round(avg(z), 6) AS ligand_z,
          count(*) AS ligand_atoms, round(any_value(k.ligand_sasa), 6) AS ligand_sasa,
          (SELECT count(*) FROM nb WHERE nb.structure_id = a.structure_id) AS n_coordinating
        FROM v_atoms a JOIN k USING (structure_id) WHERE is_het GROUP BY a.structure_id""",
        "v_atoms",
    )


@query("ligand_context", _context_sql("min"))
def ligand_context(spark, sf):
    return rounded(spatial.ligand_context(domain.atoms(spark, sf)), "ligand_x", "ligand_y", "ligand_z", "ligand_sasa")


@query("ligand_context_sum", _context_sql("sum"))
def ligand_context_sum(spark, sf):
    context = spatial.ligand_context(domain.atoms(spark, sf), agg="sum")
    return rounded(context, "ligand_x", "ligand_y", "ligand_z", "ligand_sasa")


@query(
    "ligand_total_sasa",
    oracle(
        "SELECT structure_id, resname, round(sum(sasa), 6) AS total_sasa FROM v_atoms WHERE is_het GROUP BY ALL", "v_atoms"
    ),
)
def ligand_total_sasa(spark, sf):
    return rounded(features.ligand_total_sasa(domain.atoms(spark, sf)), "total_sasa")


@query(
    "ligand_burial_sums",
    oracle(
        """SELECT structure_id, round(sum(sasa) FILTER (WHERE is_het), 6) AS ligand_sasa,
             round(sum(sasa) FILTER (WHERE is_het AND atom_name = 'O1'), 6) AS phosphate_sasa,
             round(sum(sasa) FILTER (WHERE is_het), 6) AS delta_sasa FROM v_atoms GROUP BY structure_id""",
        "v_atoms",
    ),
)
def ligand_burial_sums(spark, sf):
    return rounded(features.ligand_burial(domain.atoms(spark, sf)), "ligand_sasa", "phosphate_sasa", "delta_sasa")


_BEST = f"""{_NEAR_LIGAND},
  g AS (SELECT structure_id, avg(x) AS lx, avg(y) AS ly, avg(z) AS lz FROM v_atoms WHERE is_het GROUP BY structure_id),
  o AS (SELECT l.structure_id, l.pocket_id, count(*) AS overlap FROM v_lining l JOIN nb USING (structure_id, resseq) GROUP BY ALL),
  b AS (SELECT c.structure_id, c.pocket_id, c.composite_score, coalesce(o.overlap, 0) AS overlap,
      sqrt((center_x - lx) ** 2 + (center_y - ly) ** 2 + (center_z - lz) ** 2) AS d
    FROM v_centres c JOIN g USING (structure_id) LEFT JOIN o USING (structure_id, pocket_id))"""


def _best(spark, sf, **options):
    centres, atoms, residues = _parts(spark, sf)
    lining = features.lining_residues(centres, residues)
    site, centroids = spatial.coordinating_residues(atoms), spatial.ligand_centroids(atoms)
    best = matching.best_pocket(centres, lining, site, centroids, **options)
    return rounded(best.select("structure_id", "pocket_id", "overlap", "ligand_distance"), "ligand_distance")


@query(
    "best_pocket_match",
    oracle(
        f"""WITH {_BEST}
        SELECT structure_id, pocket_id, overlap, round(d, 6) AS ligand_distance FROM b
        QUALIFY row_number() OVER (PARTITION BY structure_id ORDER BY d, overlap DESC, composite_score DESC, pocket_id) = 1""",
        "v_lining",
    ),
)
def best_pocket_match(spark, sf):
    return _best(spark, sf)


@query(
    "best_pocket_decoy",
    oracle(
        f"""WITH {_BEST}
        SELECT structure_id, pocket_id, overlap, round(d, 6) AS ligand_distance FROM b
        QUALIFY row_number() OVER (PARTITION BY structure_id ORDER BY composite_score DESC, pocket_id) = 1""",
        "v_lining",
    ),
)
def best_pocket_decoy(spark, sf):
    return _best(spark, sf, decoy=True)


@query(
    "residue_overlap",
    oracle(
        f"""WITH {_NEAR_LIGAND}
        SELECT l.structure_id, l.pocket_id, count(*) AS overlap FROM v_lining l JOIN nb USING (structure_id, resseq) GROUP BY ALL""",
        "v_lining",
    ),
)
def residue_overlap(spark, sf):
    centres, atoms, residues = _parts(spark, sf)
    return matching.residue_overlap(features.lining_residues(centres, residues), spatial.coordinating_residues(atoms))


@query(
    "pocket_labels",
    oracle(
        """WITH g AS (SELECT structure_id, avg(x) AS lx, avg(y) AS ly, avg(z) AS lz FROM v_atoms WHERE is_het GROUP BY structure_id)
        SELECT structure_id, pocket_id, round(d, 6) AS ligand_distance, classification,
          CASE WHEN classification != 'Surface' AND d <= 8 THEN 1 ELSE 0 END AS label FROM (
          SELECT c.structure_id, pocket_id, classification,
            sqrt((center_x - lx) ** 2 + (center_y - ly) ** 2 + (center_z - lz) ** 2) AS d
          FROM v_centres c LEFT JOIN g USING (structure_id) LEFT JOIN v_dataset ON pdb_id = c.structure_id)""",
        "v_centres",
        "v_dataset",
    ),
)
def pocket_labels(spark, sf):
    centres, atoms, _ = _parts(spark, sf)
    dataset = domain.dataset(spark, sf).withColumnRenamed("pdb_id", "structure_id")
    labelled = matching.pocket_labels(centres, spatial.ligand_centroids(atoms), dataset)
    return rounded(labelled.select("structure_id", "pocket_id", "ligand_distance", "classification", "label"), "ligand_distance")


# One potential map per region key: the value is a polynomial over 9×9×9 grid nodes.
_GRID_SQL = """h AS (SELECT CASE WHEN n_nationkey % 5 = 4 THEN -1 - n_nationkey ELSE n_nationkey END AS map_id, 9 AS n, -4.0::DOUBLE AS o,
    1.0::DOUBLE AS d FROM nation),
  v AS (SELECT map_id, ix, iy, iz, (1 + 0.5 * ix - 0.25 * iy + 0.125 * iz + 0.01 * ix * iy * iz + map_id)::DOUBLE AS value
    FROM h, range(9) a(ix), range(9) b(iy), range(9) c(iz)),
  p AS (SELECT vec_id, vec_id % 25 AS map_id, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y,
    embedding[3]::DOUBLE * 20 AS z FROM embeddings),
  l AS (SELECT p.*, greatest(0, least(7, ceil(x + 4) - 1)) AS ix, greatest(0, least(7, ceil(y + 4) - 1)) AS iy,
    greatest(0, least(7, ceil(z + 4) - 1)) AS iz FROM p JOIN h USING (map_id))"""


def _maps(spark, sf):
    # Every fifth map belongs to no point, so the points of that key have none.
    map_id = F.expr("CASE WHEN n_nationkey % 5 = 4 THEN -1 - n_nationkey ELSE n_nationkey END")
    maps = domain.table(spark, sf, "nation").select(map_id.alias("map_id"))
    headers = maps.select(
        "map_id",
        *[F.lit(9).alias(f"n{a}") for a in "xyz"],
        *[F.lit(-4.0).alias(f"o{a}") for a in "xyz"],
        *[F.lit(1.0).alias(f"d{a}") for a in "xyz"],
    )
    nodes = F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))
    grid = maps
    for a in "xyz":
        grid = grid.withColumn(f"i{a}", F.explode(nodes))
    ix, iy, iz = F.col("ix"), F.col("iy"), F.col("iz")
    value = 1 + 0.5 * ix - 0.25 * iy + 0.125 * iz + 0.01 * ix * iy * iz + F.col("map_id")
    return headers, grid.withColumn("value", value.cast("double"))


@query(
    "trilinear_sample",
    oracle(
        f"""WITH {_GRID_SQL}
        SELECT p.vec_id, round(coalesce(s.v, p.vec_id), 6) AS potential FROM p LEFT JOIN (
          SELECT l.vec_id, sum(v.value * (1 - abs(l.x + 4 - v.ix)) * (1 - abs(l.y + 4 - v.iy)) * (1 - abs(l.z + 4 - v.iz))) AS v
          FROM l JOIN v ON v.map_id = l.map_id AND v.ix IN (l.ix, l.ix + 1) AND v.iy IN (l.iy, l.iy + 1) AND v.iz IN (l.iz, l.iz + 1)
          WHERE abs(l.x) <= 4 AND abs(l.y) <= 4 AND abs(l.z) <= 4 GROUP BY l.vec_id
          UNION ALL
          SELECT l.vec_id, sum(v.value * CASE WHEN v.ix = l.ix THEN 1 - (l.x + 4 - l.ix) ELSE l.x + 4 - l.ix END
            * CASE WHEN v.iy = l.iy THEN 1 - (l.y + 4 - l.iy) ELSE l.y + 4 - l.iy END
            * CASE WHEN v.iz = l.iz THEN 1 - (l.z + 4 - l.iz) ELSE l.z + 4 - l.iz END)
          FROM l JOIN v ON v.map_id = l.map_id AND v.ix IN (l.ix, l.ix + 1) AND v.iy IN (l.iy, l.iy + 1) AND v.iz IN (l.iz, l.iz + 1)
          WHERE NOT (abs(l.x) <= 4 AND abs(l.y) <= 4 AND abs(l.z) <= 4) GROUP BY l.vec_id) s USING (vec_id)"""
    ),
)
def trilinear_sample(spark, sf):
    headers, grid = _maps(spark, sf)
    points = domain.table(spark, sf, "embeddings").select(
        "vec_id",
        (F.col("vec_id") % 25).cast("int").alias("map_id"),
        *[(F.element_at("embedding", i + 1).cast("double") * 20).alias(a) for i, a in enumerate("xyz")],
        F.col("vec_id").cast("double").alias("energy"),
    )
    sampled = electro.sample_grid(points, headers, grid, ["vec_id"], fallback="energy")
    return rounded(sampled.select("vec_id", "potential"), "potential")


_ENERGY = {5.0: 3.0, 6.0: 2.5, 7.0: 2.0, 7.4: 1.8, 8.0: 1.5, 9.0: 1.0}


def _potentials(spark, sf):
    return electro.site_potentials(domain.site_residues(spark, sf), domain.pka_rows(spark, sf), _ENERGY)


@query(
    "ph_profile",
    oracle(
        """SELECT site, ph, energy, round(site_charge_factor, 6) AS site_charge_factor, round(site_potential, 6) AS site_potential
           FROM v_site_potentials""",
        "v_site_potentials",
    ),
)
def ph_profile(spark, sf):
    return rounded(_potentials(spark, sf), "site_charge_factor", "site_potential")


@query(
    "optimal_ph",
    oracle(
        "SELECT site, min_by(ph, (-round(site_potential, 9), ph)) AS optimal_ph FROM v_site_potentials GROUP BY site",
        "v_site_potentials",
    ),
)
def optimal_ph(spark, sf):
    return electro.optimal_ph(_potentials(spark, sf))


@query(
    "site_type_profiles",
    oracle(
        """SELECT site_type, ph, round(avg(site_potential), 6) AS mean_site_potential FROM (
          SELECT *, CASE WHEN site IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'cryptic'
            WHEN site IN ('Brand#11', 'Brand#12') THEN 'surface' ELSE 'unlabeled' END AS site_type FROM v_site_potentials)
        GROUP BY ALL""",
        "v_site_potentials",
    ),
)
def site_type_profiles(spark, sf):
    kinds = F.when(F.col("site").isin("Brand#1", "Brand#2", "Brand#3"), "cryptic").when(
        F.col("site").isin("Brand#11", "Brand#12"), "surface"
    )
    types = domain.site_residues(spark, sf).select("site").distinct().select("site", kinds.alias("site_type"))
    profiles = electro.compare_profiles(_potentials(spark, sf), types.where("site_type IS NOT NULL"))
    return rounded(profiles, "mean_site_potential")


@query(
    "ph_sensitive",
    oracle(
        """SELECT site, residue_number, residue_name, chain_id, pka FROM v_pka JOIN v_sites USING (residue_number)
           WHERE abs(pka - 7.4) <= 1.0""",
        "v_pka",
        "v_sites",
    ),
)
def ph_sensitive(spark, sf):
    return electro.ph_sensitive(domain.site_residues(spark, sf), domain.pka_rows(spark, sf))


_POCKET_FRAMES = "p AS (SELECT * FROM v_frames WHERE NOT is_water AND element != 'H')"


@query(
    "rmsf",
    oracle(
        f"""WITH {_POCKET_FRAMES}
        SELECT candidate_id, round(avg(r), 6) AS avg_pocket_rmsf_nm FROM (
          SELECT candidate_id, atom_id, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS r FROM p GROUP BY ALL) GROUP BY candidate_id""",
        "v_frames",
    ),
)
def rmsf(spark, sf):
    return rounded(trajectory.mean_rmsf(domain.frames(spark, sf)), "avg_pocket_rmsf_nm")


@query(
    "box_volume",
    oracle(
        f"""WITH {_POCKET_FRAMES}
        SELECT candidate_id, round(avg(v), 6) AS avg_pocket_volume_nm3, round(stddev_pop(v), 6) AS std_pocket_volume_nm3 FROM (
          SELECT candidate_id, frame, greatest(max(x) - min(x), 1e-6) * greatest(max(y) - min(y), 1e-6)
            * greatest(max(z) - min(z), 1e-6) AS v FROM p GROUP BY ALL) GROUP BY candidate_id""",
        "v_frames",
    ),
)
def box_volume(spark, sf):
    return rounded(trajectory.box_volume(domain.frames(spark, sf)), "avg_pocket_volume_nm3", "std_pocket_volume_nm3")


@query(
    "water_count",
    oracle(
        f"""WITH {_POCKET_FRAMES}, c AS (SELECT candidate_id, frame, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY ALL)
        SELECT candidate_id, round(avg(n), 6) AS avg_waters_in_pocket FROM (
          SELECT c.candidate_id, c.frame, count(w.row_id) AS n FROM c LEFT JOIN (SELECT * FROM v_frames WHERE is_water) w
            ON w.candidate_id = c.candidate_id AND w.frame = c.frame
            AND sqrt((w.x - cx) ** 2 + (w.y - cy) ** 2 + (w.z - cz) ** 2) <= 0.4 GROUP BY ALL) GROUP BY candidate_id""",
        "v_frames",
    ),
)
def water_count(spark, sf):
    return rounded(trajectory.water_counts(domain.frames(spark, sf)), "avg_waters_in_pocket")


def _area_sql(source, key, radius, probe, points):
    """Every sphere point of every atom against every other atom of its group."""
    match = " AND ".join(f"b.{k} = a.{k}" for k in key)
    return f"""sph AS (SELECT cos(t) * sqrt(1 - z * z) AS ux, sin(t) * sqrt(1 - z * z) AS uy, z AS uz FROM (
      SELECT 1 - (2 * k + 1) / {points}::DOUBLE AS z, k * pi() * (3 - sqrt(5)) AS t FROM range({points}) r(k))),
    src AS (SELECT *, {radius} + {probe} AS rad FROM {source}),
    open_points AS (SELECT a.row_key, count(*) AS n FROM (SELECT src.*, ux, uy, uz FROM src, sph) a WHERE NOT EXISTS (
      SELECT 1 FROM src b WHERE {match} AND b.row_key != a.row_key
        AND (a.x + a.rad * ux - b.x) ** 2 + (a.y + a.rad * uy - b.y) ** 2 + (a.z + a.rad * uz - b.z) ** 2 <= b.rad * b.rad)
      GROUP BY a.row_key),
    area AS (SELECT src.*, coalesce(n, 0) * 4 * pi() / {points} * rad * rad AS area FROM src LEFT JOIN open_points USING (row_key))"""


_ATOM_AREA = _area_sql(
    "(SELECT *, atom_id AS row_key FROM v_atoms)",
    ["structure_id"],
    "(CASE substr(atom_name, 1, 1) WHEN 'C' THEN 1.7 ELSE 1.52 END)::DOUBLE",
    1.4,
    100,
)
_FRAME_AREA = (
    _area_sql(
        "(SELECT *, row_id AS row_key FROM v_frames)",
        ["candidate_id", "frame"],
        "(CASE element WHEN 'C' THEN 0.17 ELSE 0.12 END)::DOUBLE",
        0.14,
        960,
    )
    + """, pa AS (SELECT candidate_id, avg(a) AS avg_pocket_sasa_nm2 FROM (SELECT candidate_id, frame, sum(area) AS a FROM area
      WHERE NOT is_water AND element != 'H' GROUP BY ALL) GROUP BY candidate_id)"""
)


@query(
    "solvent_area",
    oracle(f"WITH {_ATOM_AREA} SELECT structure_id, atom_id, round(area, 4) AS sasa FROM area", "v_atoms"),
)
def solvent_area(spark, sf):
    area = features.solvent_area(domain.atoms(spark, sf))
    return rounded(area.select("structure_id", "atom_id", "sasa"), "sasa", digits=4)


@query(
    "trajectory_area",
    oracle(
        f"WITH {_FRAME_AREA} SELECT candidate_id, round(avg_pocket_sasa_nm2, 6) AS avg_pocket_sasa_nm2 FROM pa", "v_frames"
    ),
)
def trajectory_area(spark, sf):
    return rounded(trajectory.pocket_area(domain.frames(spark, sf)), "avg_pocket_sasa_nm2")


_REPORT = f"""{_FRAME_AREA}, {_POCKET_FRAMES},
  rm AS (SELECT candidate_id, avg(r) AS avg_pocket_rmsf_nm FROM (SELECT candidate_id, atom_id,
      sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS r FROM p GROUP BY ALL) GROUP BY candidate_id),
  bv AS (SELECT candidate_id, avg(v) AS avg_pocket_volume_nm3, stddev_pop(v) AS std_pocket_volume_nm3 FROM (
      SELECT candidate_id, frame, greatest(max(x) - min(x), 1e-6) * greatest(max(y) - min(y), 1e-6)
        * greatest(max(z) - min(z), 1e-6) AS v FROM p GROUP BY ALL) GROUP BY candidate_id),
  c AS (SELECT candidate_id, frame, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY ALL),
  wc AS (SELECT candidate_id, avg(n) AS avg_waters_in_pocket FROM (
      SELECT c.candidate_id, c.frame, count(w.row_id) AS n FROM c LEFT JOIN (SELECT * FROM v_frames WHERE is_water) w
        ON w.candidate_id = c.candidate_id AND w.frame = c.frame
        AND sqrt((w.x - cx) ** 2 + (w.y - cy) ** 2 + (w.z - cz) ** 2) <= 0.4 GROUP BY ALL) GROUP BY candidate_id),
  ids AS (SELECT DISTINCT candidate_id FROM v_frames UNION SELECT DISTINCT candidate_id + 1000 FROM v_frames),
  rep AS (SELECT candidate_id, avg_pocket_sasa_nm2, avg_pocket_rmsf_nm, avg_pocket_volume_nm3, std_pocket_volume_nm3,
      avg_waters_in_pocket, CASE WHEN avg_pocket_rmsf_nm IS NULL THEN 'failed'
        WHEN (avg_pocket_sasa_nm2 <= 1)::INT + (avg_pocket_rmsf_nm <= 0.2)::INT + (avg_waters_in_pocket <= 1)::INT >= 2 THEN 'stably buried'
        WHEN (avg_pocket_sasa_nm2 >= 5)::INT + (avg_pocket_rmsf_nm >= 0.45)::INT + (avg_waters_in_pocket >= 5)::INT >= 2 THEN 'exposed'
        ELSE 'transiently accessible' END AS classification
    FROM ids LEFT JOIN pa USING (candidate_id) LEFT JOIN rm USING (candidate_id)
      LEFT JOIN bv USING (candidate_id) LEFT JOIN wc USING (candidate_id))"""


@query(
    "dynamics_report",
    oracle(
        f"""WITH {_REPORT}
        SELECT candidate_id, round(avg_pocket_sasa_nm2, 6) AS avg_pocket_sasa_nm2, round(avg_pocket_rmsf_nm, 6) AS avg_pocket_rmsf_nm,
          round(avg_pocket_volume_nm3, 6) AS avg_pocket_volume_nm3, round(std_pocket_volume_nm3, 6) AS std_pocket_volume_nm3,
          round(avg_waters_in_pocket, 6) AS avg_waters_in_pocket, classification FROM rep""",
        "v_frames",
    ),
)
def dynamics_report(spark, sf):
    frames = domain.frames(spark, sf)
    ids = frames.select("candidate_id").distinct()
    candidates = ids.unionByName(ids.select((F.col("candidate_id") + 1000).alias("candidate_id")))
    report = trajectory.dynamics_report(candidates, frames).drop("error")
    return rounded(report, *[c for c in report.columns if c.startswith(("avg_", "std_"))])


@query(
    "stability_summary",
    oracle(
        f"""WITH {_REPORT}
        SELECT classification, count(*) AS n_candidates, count(*) FILTER (WHERE classification = 'stably buried') AS n_stable,
          count(*) FILTER (WHERE classification IN ('exposed', 'failed')) AS n_filtered_out FROM rep GROUP BY classification""",
        "v_frames",
    ),
)
def stability_summary(spark, sf):
    return trajectory.stability_summary(dynamics_report(spark, sf))


@query(
    "stable_candidates",
    oracle(f"WITH {_REPORT} SELECT candidate_id FROM rep WHERE classification = 'stably buried'", "v_frames"),
)
def stable_candidates(spark, sf):
    return trajectory.stable_candidates(dynamics_report(spark, sf))


@query(
    "filtered_out_candidates",
    oracle(f"WITH {_REPORT} SELECT candidate_id FROM rep WHERE classification IN ('exposed', 'failed')", "v_frames"),
)
def filtered_out_candidates(spark, sf):
    return trajectory.filtered_out_candidates(dynamics_report(spark, sf))


@query(
    "residue_plddt",
    oracle(
        """SELECT structure_id, resseq, max_by(bfactor, chain) AS plddt FROM v_atoms WHERE atom_name = 'CA' AND NOT is_het
           GROUP BY ALL""",
        "v_atoms",
    ),
)
def residue_plddt(spark, sf):
    return features.residue_plddt(domain.atoms(spark, sf))


_ANALYSED = f"""{_SURFACE.replace('12', '1')},
  d AS (SELECT c.structure_id, c.pocket_id, coalesce({_NEAR}, 0) AS burial_depth
    FROM v_centres c LEFT JOIN t a ON a.structure_id = c.structure_id GROUP BY ALL),
  n AS (SELECT structure_id, resseq, count(*) FILTER (WHERE resname IN ('ARG', 'LYS', 'HIS')) AS nb FROM v_residues GROUP BY ALL),
  l AS (SELECT structure_id, pocket_id, avg(coalesce(m.sasa, 0)) AS sasa, coalesce(sum(nb), 0)::BIGINT AS basic_residues,
      count(*) AS residue_count FROM v_lining LEFT JOIN v_residue_map m USING (structure_id, resseq)
      LEFT JOIN n USING (structure_id, resseq) GROUP BY ALL),
  a AS (SELECT c.structure_id, c.pocket_id, burial_depth, coalesce(sasa, 0) AS sasa, coalesce(basic_residues, 0) AS basic_residues,
      coalesce(residue_count, 0) AS residue_count, 300.0 + c.pocket_id % 700 AS volume, (c.pocket_id % 20)::DOUBLE AS depth,
      NULL::DOUBLE AS electrostatic_potential
    FROM v_centres c JOIN d USING (structure_id, pocket_id) LEFT JOIN l USING (structure_id, pocket_id))"""


def _analysed(spark, sf):
    centres, atoms, _ = _parts(spark, sf)
    described = centres.drop("composite_score").select(
        "*",
        (F.lit(300.0) + F.col("pocket_id") % 700).alias("volume"),
        (F.col("pocket_id") % 20).cast("double").alias("depth"),
    )
    return screen.analyse(described, atoms)


def _analysed_sql():
    from .oracle_views import composite_sql

    return oracle(
        f"""WITH {_ANALYSED}
        SELECT structure_id, pocket_id, round(burial_depth, 6) AS burial_depth, round(sasa, 6) AS sasa, basic_residues,
          residue_count, round({composite_sql()}, 6) AS composite_score FROM a""",
        "v_lining",
        "v_residue_map",
    )


@query("analyse_all_pockets", _analysed_sql())
def analyse_all_pockets(spark, sf):
    names = ("structure_id", "pocket_id", "burial_depth", "sasa", "basic_residues", "residue_count", "composite_score")
    return rounded(_analysed(spark, sf).select(*names), "burial_depth", "sasa", "composite_score")
