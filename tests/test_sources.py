"""File scans, sinks and data-quality checks on small files."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pocketlake.operators import features, quality
from pocketlake.sources import annotations, reports, structure_text, tables


def pdb(record, serial, name, res, chain, seq, x, y, z, b):
    return f"{record:<6}{serial:>5}  {name:<3} {res:>3} {chain}{seq:>4}    {x:8.3f}{y:8.3f}{z:8.3f}{1.0:6.2f}{b:6.2f}"


@pytest.fixture
def structures(tmp_path):
    folder = tmp_path / "structures" / "deep"
    folder.mkdir(parents=True)
    lines = ["REMARK   2 RESOLUTION.    1.70 ANGSTROMS."]
    for i, (name, seq, x) in enumerate((("ARG", 58, 0.0), ("LYS", 59, 1.0), ("HIS", 60, 2.0), ("ALA", 128, 50.0))):
        lines += [pdb("ATOM", 2 * i, "N", name, "A", seq, x, 0.5, 0, 81), pdb("ATOM", 2 * i + 1, "CA", name, "A", seq, x, 0, 0, 80 + i)]
    lines += [pdb("HETATM", 9, "P1", "IHP", "A", 200, 0, 0, 0, 50), "END", ""]
    (folder / "AF-P12345-F1-model_v4.pdb").write_text("\n".join(lines))
    (tmp_path / "structures" / "plain.pdb").write_text("MODEL        1\n" + pdb("ATOM", 1, "CA", "GLY", "B", 1, 1, 2, 3, 60) + "\nENDMDL\nMODEL        2\n" + pdb("ATOM", 1, "CA", "GLY", "B", 1, 1, 2, 4, 60) + "\nENDMDL\n")
    (tmp_path / "structures" / "notes.txt").write_text("not a structure")
    return tmp_path / "structures"


def test_structure_scan(spark, structures):
    lines = structure_text.read_lines(spark, str(structures))
    atoms = structure_text.parse_atoms(lines).withColumn("sasa", F.lit(1.0))
    assert {r.structure_id for r in atoms.select("structure_id").collect()} == {"AF-P12345-F1-model_v4", "plain"}
    assert atoms.where("is_het").count() == 1 and atoms.count() == 11
    assert sorted(r.model for r in atoms.where("structure_id = 'plain'").collect()) == [1, 2]
    row = quality.resolution(lines).collect()[0]
    assert (row.resolution, row.warn) == (1.70, False)
    assert quality.resolution(lines, compat=True).collect()[0].resolution == 2.0
    assert features.mean_plddt(atoms).where("structure_id LIKE 'AF%'").collect()[0].mean_plddt == 81.5


def test_catalog_is_kept_until_forced(spark, structures, tmp_path):
    target = str(tmp_path / "catalog")
    rows = {r.uniprot_id: r for r in structure_text.build_catalog(spark, str(structures), target).collect()}
    assert set(rows) == {"P12345", "plain"} and rows["P12345"].mean_plddt == 81.5 and rows["plain"].file_size > 0
    (structures / "new.pdb").write_text("REMARK empty\n")
    assert structure_text.build_catalog(spark, str(structures), target).count() == 2
    again = {r.uniprot_id: r.mean_plddt for r in structure_text.build_catalog(spark, str(structures), target, force=True).collect()}
    assert len(again) == 3 and again["new"] is None


def test_pocket_info_blocks(spark):
    text = "Created: now\nPocket 1 :\n\tScore : \t0.42\n\tVolume :  120.0\n\tMean alpha-sphere radius : 3.9\n\nPocket 2 :\n\tScore : n/a\n"
    lines = structure_text.split_lines(spark.createDataFrame([("s", text)], "structure_id string, value string"))
    table = {r.pocket_id: r for r in structure_text.pocket_table(structure_text.parse_info(lines)).collect()}
    assert (table[1].score, table[1].volume) == (0.42, 120.0)
    assert table[1].extra == {"mean_alpha_sphere_radius": "3.9"}
    assert table[2].score is None and table[2].volume is None


def test_pocket_atom_file(spark):
    text = "\n".join([pdb("ATOM", 1, "CA", "ARG", "A", 128, 1, 2, 3, 0), pdb("ATOM", 2, "CA", "ALA", "A", 58, 3, 2, 1, 0), "TER"])
    lines = structure_text.split_lines(spark.createDataFrame([(1, text)], "pocket_id int, value string"))
    assert structure_text.pocket_residue_lists(lines, ["pocket_id"]).collect()[0].residue_ids == [58, 128]
    both = spark.createDataFrame([(1,), (2,)], "pocket_id int")
    rows = {r.pocket_id: r for r in structure_text.pocket_centroids(both, lines, ["pocket_id"]).collect()}
    assert (rows[1].center_x, rows[1].center_z) == (2.0, 2.0) and rows[2].center_y == 0.0


def test_pka_report(spark):
    lines = ["   ARG   42 A    12.20", "LYS   51 A    10.1", "ASP  60 A  3.9", "  HIS  120 B   6.40   7"]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    assert sorted(r.residue_number for r in reports.parse_pka(df).collect()) == [42, 51, 120]
    assert reports.parse_pka(df.where("false")).columns == ["residue_name", "residue_number", "chain_id", "pka"]


def test_grid_axis_orders(spark):
    body = "object 1 class gridpositions counts 2 1 3\norigin 0 0 0\ndelta 1 0 0\ndelta 0 1 0\ndelta 0 0 1\nobject 3 class array type double\n0 1 2\n3 4 5\nattribute x\n"
    df = spark.createDataFrame([(1, body)], "map_id int, value string")
    fast_z = {(r.ix, r.iz): r.value for r in reports.parse_grid_values(df).collect()}
    fast_x = {(r.ix, r.iz): r.value for r in reports.parse_grid_values(df, "x_fastest").collect()}
    assert fast_z == {(0, 0): 0, (0, 1): 1, (0, 2): 2, (1, 0): 3, (1, 1): 4, (1, 2): 5}
    assert fast_x == {(0, 0): 0, (1, 0): 1, (0, 1): 2, (1, 1): 3, (0, 2): 4, (1, 2): 5}


def test_ontology(spark):
    text = "format-version: 1.2\n\n[Term]\nid: GO:1\nname: root\nnamespace: p\n\n[Term]\nid: GO:2\nname: leaf\nnamespace: p\nis_a: GO:1 ! root\nis_a: GO:3\n\n[Typedef]\nid: part_of\n"
    terms, edges = reports.parse_ontology(spark.createDataFrame([(text,)], "value string"))
    assert sorted(r.go_id for r in terms.collect()) == ["GO:1", "GO:2"]
    assert sorted(r.parent_id for r in edges.collect()) == ["GO:1", "GO:3"]


def test_empty_payloads_get_defaults(spark):
    df = spark.createDataFrame([("x1", "{}")], "pdb_id string, payload string")
    entry = annotations.flatten_entries(df).collect()[0]
    assert (entry.pdb_id, entry.title, entry.resolution) == ("X1", "", None)
    assert annotations.flatten_entities(df).collect()[0].uniprot_id == "NA"
    protein = annotations.flatten_proteins(df).collect()[0]
    assert protein.gene_name == "" and protein.sequence_length == 0 and protein.biological_process == []
    model = annotations.flatten_models(spark.createDataFrame([("Q1", '[{"uniprotAccession": "Q1"}]')], "uniprot_id string, payload string")).collect()[0]
    assert (model.entry_id, model.model_version) == ("AF-Q1-F1", 4)


def test_results_files(spark, tmp_path):
    cases = {"list.json": '[{"pocket_id": 1}, {"pocket_id": 2}]', "wrapped.json": '{"results": [{"pocket_id": 1}]}', "plain.json": '{"pocket_id": 7}'}
    sizes = {}
    for name, text in cases.items():
        (tmp_path / name).write_text(text)
        table, issues = tables.read_results(spark, str(tmp_path / name))
        sizes[name] = table.count()
        assert issues.count() == 0
    assert sizes == {"list.json": 2, "wrapped.json": 1, "plain.json": 1}
    (tmp_path / "bad.json").write_text('{"results": [')
    table, issues = tables.read_results(spark, str(tmp_path / "bad.json"))
    assert table is None and issues.collect()[0].check == "file_read"
    assert tables.read_results(spark, "x.xlsx")[1].collect()[0].check == "file_format"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "uniprot_id string, v double")
    for kind in tables.EXPORT_FORMATS:
        assert tables.export_table(df, str(tmp_path / kind), kind)
    assert tables.read_csv(spark, str(tmp_path / "csv"), "uniprot_id string, v double").count() == 2
    with pytest.raises(ValueError, match="unsupported export"):
        tables.export_table(df, str(tmp_path / "x"), "hdf5")
    tables.append_results([], str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    tables.append_results([df, spark.createDataFrame([("c", 3)], "uniprot_id string, n int")], str(tmp_path / "app"))
    assert spark.read.parquet(str(tmp_path / "app")).columns == ["n", "uniprot_id", "v"]
    (tmp_path / "work.jsonl").write_text('{"uniprot_id": "P1"}\n\n{"uniprot_id": "P2"}\n')
    tables.enqueue(tables.read_work_list(spark, str(tmp_path / "work.jsonl")), str(tmp_path / "queue"), "2026-01-01")
    assert {r.status for r in spark.read.json(str(tmp_path / "queue")).collect()} == {"queued"}
    assert spark.read.json(str(tmp_path / "queue")).count() == 2


def test_checksums_and_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("b.csv", "a.csv"):
        (tmp_path / "in" / name).write_text(name)
    sums = tables.checksums(spark, str(tmp_path / "in"))
    rows = sums.collect()
    assert [r.path.rsplit("/", 1)[-1] for r in rows] == ["a.csv", "b.csv"]
    assert rows[0].sha256 == hashlib.sha256(b"a.csv").hexdigest()
    manifest = json.loads(tables.provenance_manifest(sums, sums.limit(1), {"k": 1}, {}, "v1", "2026-01-01").collect()[0].manifest)
    assert len(manifest["inputs"]) == 2 and json.loads(manifest["parameters"]) == {"k": 1}


def test_comparative_package(spark, tmp_path):
    hits = spark.createDataFrame([(o, f"{o}{i}", "1" if i < k else "0") for o, k in (("a", 3), ("b", 2), ("c", 1)) for i in range(4)], "organism string, protein_id string, is_hit string")
    orthologs = hits.select(F.substring("protein_id", 2, 1).alias("orthogroup"), "organism", "protein_id")
    go = hits.select("organism", "protein_id", F.lit("GO:2").alias("go_id"))
    edges = spark.createDataFrame([("GO:2", "GO:1")], "go_id string, parent_id string")
    paths = tables.write_comparative_package(hits, orthologs, go, edges, {"a": 20.0, "b": 25.0, "c": 520.0}, str(tmp_path))
    counts = {name: tables.read_csv(spark, path).count() for name, path in paths.items()}
    assert counts == {
        "comparative_statistics_table": 3, "hit_rates": 3, "ip6_hit_rate_spearman": 1, "pairwise_organism_tests": 3,
        "ortholog_conservation": 4, "go_enrichment_results": 6,
    }


def test_bad_results_table(spark):
    bad = spark.createDataFrame([(1, -5.0)], "pocket_id int, volume double")
    checks = {r.check for r in quality.results_issues(bad, "bad.csv").collect()}
    assert checks == {"required_features", "impossible_geometry"}
    assert not quality.verdict(quality.results_issues(bad, "bad.csv")).collect()[0].valid
    good = spark.createDataFrame([(1, 5.0, 5.0, 5.0, 0.5)], "pocket_id int, volume double, sasa double, depth double, composite_score double")
    assert quality.verdict(quality.results_issues(good, "good.csv")).collect()[0].valid
    diff = quality.schema_consistency([("a", good), ("b", bad), ("c", good)]).collect()
    assert [r.subject for r in diff] == ["b"] and "missing=['composite_score'" in diff[0].message


def test_numbers_wider_than_their_fields(spark):
    ids = [-999, 0, 9_999, 10_000, 99_999, 100_000, 43_770_015, 43_770_016, 87_440_031, 87_440_032, 10**12]
    residues = [-999, 0, 9_999, 10_000, 1_223_055, 1_223_056, 2_436_111, 2_436_112, 2**31 - 1]
    pairs = [(a, residues[i % len(residues)]) for i, a in enumerate(ids)]
    rows = [(1, a, "CA", "ALA", "A", r, 1.5, -2.25, 3.125, 50.0, False) for a, r in pairs]
    schema = "structure_id int, atom_id long, atom_name string, resname string, chain string, resseq int, x double, y double, z double, bfactor double, is_het boolean"
    written = spark.createDataFrame(rows, schema).withColumn("line", structure_text.format_pdb_line(spark.createDataFrame(rows, schema)))
    texts = {r["atom_id"]: r["line"] for r in written.collect()}
    assert texts[100_000][6:11] == "A0000" and texts[43_770_016][6:11] == "a0000"
    read = structure_text.parse_atoms(written.select("structure_id", F.lit(0).alias("pos"), "line")).collect()
    assert sorted((r["atom_id"], r["resseq"]) for r in read) == sorted(pairs)
    assert {(r["x"], r["y"], r["z"], r["bfactor"]) for r in read} == {(1.5, -2.25, 3.125, 50.0)}
    lists = structure_text.pocket_residue_ids(written, ["structure_id"]).collect()
    assert {r["resseq"] for r in lists} == set(residues)


def test_block_parse_needs_few_passes(spark):
    """Repeated names: the last wins, NULL too; one aggregation and no regular expression for white space."""
    text = "Pocket 1 :\n Score : 1\n\tKind :\ta\n Kind : b \n Score : x\n Other-Key : 5\nPocket 2 :\nPocketed : 3\n"
    info = structure_text.parse_info(structure_text.split_lines(spark.createDataFrame([(1, text)], "structure_id int, value string")))
    table = structure_text.pocket_table(info, ("score",))
    got = {r.pocket_id: (r.score, r.extra) for r in table.collect()}
    assert got == {1: (None, {"kind": "b", "other_key": "5"}), 2: (None, {"pocketed": "3"})}
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and r"\s+$" not in plan
