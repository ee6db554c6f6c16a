"""Neighbour joins against brute force, solvent areas against closed forms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pocketlake.operators import electro, features, matching, spatial, trajectory

ATOM = "structure_id string, atom_id long, atom_name string, resname string, chain string, resseq int, x double, y double, z double, is_het boolean, sasa double, bfactor double"


def cloud(spark, n=400, seed=1, groups=("a", "a", "a", "b")):
    """Points of which one group holds three quarters, some in the very same place."""
    rng = np.random.default_rng(seed)
    xyz = rng.normal(0, 12, (n, 3))
    xyz[: n // 5] = xyz[0]
    pdf = pd.DataFrame(xyz, columns=list("xyz"))
    pdf["structure_id"] = [groups[i % len(groups)] for i in range(n)]
    pdf["k"] = range(n)
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("salts", [1, 4])
def test_radius_join_equals_brute_force(spark, salts):
    pdf, df = cloud(spark)
    points, targets = df.where("k % 3 = 0"), df.where("k % 3 != 0").withColumnRenamed("k", "j")
    rows = [(r.k, r.j) for r in spatial.radius_pairs(points, targets, 6.0, salts=salts).collect()]
    got, want = set(rows), set()
    assert len(rows) == len(got)
    for _, g in pdf.groupby("structure_id"):
        p, t = g[g.k % 3 == 0], g[g.k % 3 != 0]
        for i, a in zip(p.k, p[list("xyz")].to_numpy()):
            d = np.sqrt(((t[list("xyz")].to_numpy() - a) ** 2).sum(1))
            want |= {(i, j) for j in t.k[d <= 6.0]}
    assert got == want


def brute_pairs(points, targets, radius):
    gaps = np.sqrt(((points[:, None, :] - targets[None, :, :]) ** 2).sum(2))
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(gaps <= radius))}


def test_crowded_cells_are_cut_and_lose_no_pair(spark):
    """A third of the targets in one cell, a sixth in one place, negative positions and cell edges: keys stay near the limit."""
    rng = np.random.default_rng(5)
    wide, crowd, heap = rng.uniform(-40, 40, (600, 3)), rng.uniform(-4, 0, (400, 3)), np.full((200, 3), [12.0, -8.0, 4.0])
    crowd[::10] = np.floor(crowd[::10] * 4) / 4
    spots, ends = np.concatenate([wide, crowd, heap]), np.concatenate([wide[:60] + 0.5, crowd[:40], heap[:2], [[np.nan] * 3]])
    columns = "structure_id string, x double, y double, z double"
    targets = spark.createDataFrame([("s", *map(float, p), j) for j, p in enumerate(spots)], f"{columns}, j int")
    points = spark.createDataFrame([("s", *map(float, p), i) for i, p in enumerate(ends)], f"{columns}, i int")
    levels = spatial.crowded_cells(targets, 4.0, ["structure_id"], 20)
    assert len(levels) > 1 and sum(table.count() for table in levels) <= len(levels) * len(spots) / 20
    placed = spatial.place_targets(targets, 4.0, ["structure_id"], levels)
    held = placed.groupBy("_level", "_part", "_cx", "_cy", "_cz").count().agg(F.max("count"), F.sum("count")).first()
    # Keys of cells that were cut hold the limit at most; keys of the heap are dealt by hash and vary around it.
    assert held[0] <= 40 and held[1] == len(spots)
    rows = [(r.i, r.j) for r in spatial.radius_pairs(points, targets, 4.0, limit=20).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_pairs(ends, spots, 4.0)


def test_no_cell_is_counted_twice_without_crowds(spark):
    _, df = cloud(spark)
    assert spatial.crowded_cells(df, 6.0, ["structure_id"], 1000) == []
    assert spatial.radius_pairs(df.limit(0), df.withColumnRenamed("k", "j"), 6.0, limit=5).count() == 0
    assert spatial.radius_pairs(df, df.withColumnRenamed("k", "j").limit(0), 6.0, limit=5).count() == 0


def test_nearest_distance_equals_brute_force(spark):
    pdf, df = cloud(spark, seed=2)
    near = spatial.nearest_distance(
        df.where("k % 2 = 0"), df.where("k % 2 = 1"), ["structure_id", "k"], fine=3.0, factor=2
    )
    got = {r.k: r.distance for r in near.collect()}
    assert len(got) == (pdf.k % 2 == 0).sum()
    for _, g in pdf.groupby("structure_id"):
        t = g[g.k % 2 == 1][list("xyz")].to_numpy()
        for k, a in zip(g.k[g.k % 2 == 0], g[g.k % 2 == 0][list("xyz")].to_numpy()):
            assert got[k] == pytest.approx(np.sqrt(((t - a) ** 2).sum(1)).min())


def test_boxes_met_do_not_grow_with_the_structure(spark, monkeypatch):
    """A structure with over 100 times the boxes of another: a point meets about as many in each."""
    met, plain = [], spatial._closest_boxes

    def counted(candidates, point_key):
        met.append({r.structure_id: r["count"] for r in candidates.groupBy("structure_id").count().collect()})
        return plain(candidates, point_key)

    monkeypatch.setattr(spatial, "_closest_boxes", counted)
    grid = [("small", 3.0 + 8 * i, 3.0 + 8 * j, 3.0 + 8 * k) for i in range(4) for j in range(4) for k in range(4)]
    grid += [("large", 3.0 + 8 * i, 3.0 + 8 * j, 3.0 + 8 * k) for i in range(20) for j in range(20) for k in range(20)]
    targets = spark.createDataFrame([*grid, ("large", float("nan"), 0.0, 0.0)], "structure_id string, x double, y double, z double")
    rng = np.random.default_rng(3)
    points = [(name, n, *map(float, rng.uniform(0, 30, 3))) for name in ("small", "large", "none") for n in range(20)]
    frame = spark.createDataFrame(points, "structure_id string, n int, x double, y double, z double")
    got = {(r.structure_id, r.n): r.distance for r in spatial.nearest_distance(frame, targets, ["structure_id", "n"]).collect()}
    for name in ("small", "large"):
        spots = np.array([g[1:] for g in grid if g[0] == name])
        for who, n, *at in points:
            if who == name:
                assert got[name, n] == pytest.approx(np.sqrt(((spots - at) ** 2).sum(1)).min())
    assert len(got) == 40 and len(met) == 4
    assert met[0]["large"] <= 8 * 20
    # Eight boxes with 64 children each are the most that a point may meet on a level, however many boxes there are.
    assert max(level["large"] for level in met) <= 8 * 64 * 20


def atoms(spark, rows):
    return spark.createDataFrame(rows, ATOM)


def test_area_of_one_and_two_spheres(spark):
    lone = ("one", 1, "CA", "ALA", "A", 1, 0.0, 0.0, 0.0, False, 0.0, 80.0)
    pair = [("two", i, "CA", "ALA", "A", i, 3.0 * i, 0.0, 0.0, False, 0.0, 80.0) for i in (0, 1)]
    far = [("far", i, "N", "ALA", "A", i, 50.0 * i, 0.0, 0.0, False, 0.0, 80.0) for i in (0, 1)]
    rows = features.solvent_area(atoms(spark, [lone, *pair, *far]), points=1000).collect()
    area = {(r.structure_id, r.atom_id): r.sasa for r in rows}
    r = 1.7 + 1.4
    assert area["one", 1] == pytest.approx(4 * math.pi * r * r)
    assert area["far", 0] == pytest.approx(4 * math.pi * (1.55 + 1.4) ** 2)
    # The cap cut off by an equal sphere at distance d has height r − d/2.
    assert area["two", 0] == pytest.approx(4 * math.pi * r * r - 2 * math.pi * r * (r - 1.5), rel=0.01)


def plain_area(rows, points):
    """Area per atom by testing every sphere point against every other atom."""
    unit, out = features._sphere(points).T, {}
    for a in rows:
        r = features.RADII[a[2][0]] + 1.4
        dots = np.array(a[6:9]) + r * unit
        free = np.ones(points, dtype=bool)
        for b in rows:
            if b is not a:
                free &= ((dots - np.array(b[6:9])) ** 2).sum(1) > (features.RADII[b[2][0]] + 1.4) ** 2 + 1e-9
        out[a[1]] = free.sum() * 4 * math.pi * r * r / points
    return out


def test_area_in_a_crowd_equals_the_plain_method(spark, monkeypatch):
    """Repeated atoms, equal places of different radius and a crowded cell that is cut."""
    rng = np.random.default_rng(6)
    spread = [*rng.uniform(-9, 9, (60, 3)), *rng.uniform(0, 1.5, (40, 3))]
    rows = [("s", i, "CNOS"[i % 4] + "A", "ALA", "A", i, *map(float, p), False, 0.0, 80.0) for i, p in enumerate(spread)]
    rows += [("s", 200 + i, name, "ALA", "A", 1, 30.0, 0.0, 0.0, False, 0.0, 80.0) for i, name in enumerate(["CA", "CA", "S"])]
    rows += [("s", 300 + i, name, "ALA", "A", 1, 60.0, 0.0, 0.0, False, 0.0, 80.0) for i, name in enumerate(["C", "O"])]
    plain, seen = spatial.radius_pairs, []

    def crowded(*args):
        seen.append(plain(*args, limit=8))
        return seen[-1]

    monkeypatch.setattr(features, "radius_pairs", crowded)
    got = {r.atom_id: r.sasa for r in features.solvent_area(atoms(spark, rows), points=100).collect()}
    want = plain_area(rows, 100)
    assert got.keys() == want.keys() and len(seen) == 1
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_atoms_at_one_point_are_one_row_of_the_join(spark, monkeypatch):
    heap = spark.range(10_000).select(
        F.lit("s").alias("structure_id"), F.col("id").alias("atom_id"), F.lit("CA").alias("atom_name"),
        *[F.when(F.col("id") == 9_999, 3.0).otherwise(0.0).alias(a) for a in "xyz"],
    )
    plain, sizes = spatial.radius_pairs, []

    def counted(*args):
        pairs = plain(*args)
        sizes.append(pairs.count())
        return pairs

    monkeypatch.setattr(features, "radius_pairs", counted)
    area = features.solvent_area(heap, points=60)
    assert sizes == [4]
    assert area.count() == 10_000 and area.where("sasa = 0").count() == 9_999


def test_lining_and_basic_count(spark):
    residues = spark.createDataFrame(
        [("s", "A", n, name, 10.0, 80.0, x, 0.0, 0.0) for n, name, x in ((58, "ARG", 0.0), (59, "LYS", 3.0), (60, "HIS", 6.0), (128, "ALA", 50.0))],
        "structure_id string, chain string, resseq int, resname string, sasa double, plddt double, ca_x double, ca_y double, ca_z double",
    )
    pockets = spark.createDataFrame(
        [("s", 1, 0.0, 0.0, 0.0, [58, 59, 60]), ("s", 2, 50.0, 0.0, 0.0, None), ("s", 3, 0.0, 90.0, 0.0, [])],
        "structure_id string, pocket_id int, center_x double, center_y double, center_z double, residue_ids array<int>",
    )
    lining = features.lining_residues(pockets, residues, 5.0)
    assert sorted((r.pocket_id, r.resseq) for r in lining.collect()) == [(1, 58), (1, 59), (1, 60), (2, 128)]
    counts = {r.pocket_id: r.basic_residues for r in features.basic_residue_count(pockets, lining, residues).collect()}
    assert counts == {1: 3, 2: 0, 3: 0}
    table = {r.pocket_id: r for r in features.lining_features(pockets, residues, 5.0).collect()}
    assert (table[1].basic_residues, table[1].residue_count, table[3].sasa) == (3, 3, 0.0)


def test_burial_depth_cases(spark):
    rows = [
        ("s", 1, "CA", "ALA", "A", 1, 0.0, 0.0, 0.0, False, 0.5, 80.0),
        ("s", 2, "CA", "ALA", "A", 2, 10.0, 0.0, 0.0, False, 30.0, 80.0),
        ("s", 3, "P1", "IHP", "A", 3, 1.0, 0.0, 0.0, True, 99.0, 80.0),
        ("t", 4, "CA", "ALA", "A", 1, 4.0, 0.0, 0.0, False, 0.0, 80.0),
    ]
    pockets = spark.createDataFrame(
        [("s", 1, 0.0, 0.0, 0.0), ("t", 1, 0.0, 0.0, 0.0), ("u", 1, 0.0, 0.0, 0.0)],
        "structure_id string, pocket_id int, center_x double, center_y double, center_z double",
    )
    got = {r.structure_id: r.burial_depth for r in spatial.burial_depth(pockets, atoms(spark, rows)).collect()}
    # Exposed atom wins over a nearer buried one; all atoms when none is exposed; 0 without atoms.
    assert got == {"s": 10.0, "t": 4.0, "u": 0.0}


def test_best_pocket_prefers_distance_then_overlap(spark):
    schema = "structure_id string, pocket_id int, center_x double, center_y double, center_z double, composite_score double"
    pockets = spark.createDataFrame([("s", 1, 9.0, 0.0, 0.0, 0.9), ("s", 2, 1.0, 0.0, 0.0, 0.2), ("s", 3, -1.0, 0.0, 0.0, 0.1)], schema)
    lining = spark.createDataFrame([("s", 3, 5), ("s", 1, 5), ("s", 1, 6)], "structure_id string, pocket_id int, resseq int")
    site = spark.createDataFrame([("s", 5), ("s", 6)], "structure_id string, resseq int")
    centre = spark.createDataFrame([("s", 0.0, 0.0, 0.0)], "structure_id string, ligand_x double, ligand_y double, ligand_z double")
    none = centre.where("structure_id = ''")
    assert matching.best_pocket(pockets, lining, site, centre).collect()[0].pocket_id == 3
    assert matching.best_pocket(pockets, lining, site, centre, decoy=True).collect()[0].pocket_id == 1
    assert matching.best_pocket(pockets, lining, site, none, overlap_first=True).collect()[0].pocket_id == 1


def test_grid_sampling_is_exact_on_linear_fields_and_clamps(spark):
    headers = spark.createDataFrame([(1, 3, 3, 3, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "map_id int, nx int, ny int, nz int, ox double, oy double, oz double, dx double, dy double, dz double")
    grid = spark.range(27).select(
        F.lit(1).alias("map_id"), (F.floor(F.col("id") / 9)).alias("ix"), F.pmod(F.floor(F.col("id") / 3), F.lit(3)).alias("iy"), F.pmod("id", F.lit(3)).alias("iz")
    ).withColumn("value", (F.col("ix") + 2 * F.col("iy") - F.col("iz")).cast("double"))
    points = spark.createDataFrame(
        [(1, 1, 0.25, 1.5, 1.75, 9.0), (2, 1, 2.0, 0.0, 0.0, 9.0), (3, 7, 0.0, 0.0, 0.0, 9.0)], "p int, map_id int, x double, y double, z double, energy double"
    )
    got = {r.p: r.potential for r in electro.sample_grid(points, headers, grid, ["p"], "energy").collect()}
    assert got == {1: pytest.approx(0.25 + 3.0 - 1.75), 2: pytest.approx(2.0), 3: 9.0}


def test_ph_workflow(spark):
    pka = spark.createDataFrame([("ARG", 10, "A", 12.0), ("HIS", 20, "A", 6.9)], "residue_name string, residue_number int, chain_id string, pka double")
    sites = spark.createDataFrame([("cryptic_1", 10), ("cryptic_1", 30), ("surface_1", 20), ("bare", 99)], "site string, residue_number int")
    table = electro.site_potentials(sites, pka, {5.0: 2.0, 7.0: 1.0, 9.0: 0.5})
    assert table.count() == 9
    best = {r.site: r.optimal_ph for r in electro.optimal_ph(table).collect()}
    assert best == {"cryptic_1": 5.0, "surface_1": 5.0, "bare": 5.0}
    types = spark.createDataFrame([("cryptic_1", "cryptic"), ("surface_1", "surface")], "site string, site_type string")
    assert {r.site_type for r in electro.compare_profiles(table, types).collect()} == {"cryptic", "surface", "unlabeled"}
    assert [r.residue_number for r in electro.ph_sensitive(sites, pka).collect()] == [20]


def test_dynamics_report_marks_failures(spark):
    rows = [("c", f, a, False, "C", f * 10 + a, 0.1 * a, 0.0, 0.01 * f) for f in range(3) for a in range(3)]
    rows += [("c", f, 9, True, "O", 100 + f, 0.1, 0.0, 0.0) for f in range(3)]
    frames = spark.createDataFrame(rows, "candidate_id string, frame int, atom_id int, is_water boolean, element string, row_id long, x double, y double, z double")
    ids = spark.createDataFrame([("c",), ("lost",)], "candidate_id string")
    report = {r.candidate_id: r for r in trajectory.dynamics_report(ids, frames).collect()}
    assert report["lost"].classification == "failed" and report["lost"].error
    assert report["c"].avg_waters_in_pocket == 1.0
    assert report["c"].avg_pocket_rmsf_nm == pytest.approx(np.std([0.0, 0.01, 0.02]))


def test_crowded_atoms_meet_few_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("s", i, "CA" if i % 2 else "O1", "ALA", "A", i, *map(float, p), False, 0.0, 80.0) for i, p in enumerate(rng.normal(0, 2.0, (1500, 3)))]
    heap = atoms(spark, rows)
    plain, sizes = spatial.radius_pairs, []

    def counted(*args):
        pairs = plain(*args)
        sizes.append(pairs.count())
        return pairs

    monkeypatch.setattr(features, "radius_pairs", counted)
    monkeypatch.setattr(spatial, "radius_pairs", counted)
    got = {r.atom_id: r.sasa for r in features.solvent_area(heap, points=60).collect()}
    assert sum(sizes) < 1500 * 1500 / 5
    at, r = np.array([row[6:9] for row in rows]), np.array([1.7 if row[1] % 2 else 1.52 for row in rows]) + 1.4
    for i in range(0, 1500, 7):
        spots = at[i] + r[i] * features._sphere(60).T
        others = np.arange(1500) != i
        free = (((spots[:, None] - at[others]) ** 2).sum(2) > r[others] ** 2).all(axis=1).sum()
        assert got[i] == pytest.approx(free * 4 * math.pi / 60 * r[i] ** 2)
