"""Registered queries: text and JSON scans over lines and payloads that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from ..sources import annotations, reports, structure_text, tables
from . import domain
from .oracle_views import oracle
from .queries_comparative import rounded
from .registry import query


def _whole_files(rows, key, line, order):
    """One text per key from line rows, as a file scan with whole texts would give it."""
    lines = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(line).alias("l")))).alias("ls"))
    return lines.select(*key, F.array_join(F.transform("ls", lambda s: s["l"]), "\n").alias("value"))


def pdb_files(spark, sf):
    """Each structure as one PDB text with a resolution remark."""
    atoms = domain.atoms(spark, sf)
    near = atoms.select("*", *[F.round(a, 3).alias(f"r{a}") for a in "xyz"]).drop("x", "y", "z").withColumnsRenamed(
        {f"r{a}": a for a in "xyz"}
    )
    lines = near.select("structure_id", "atom_id", structure_text.format_pdb_line(near).alias("line"))
    files = _whole_files(lines, ["structure_id"], "line", "atom_id")
    remark = F.format_string("REMARK   2 RESOLUTION.    %.2f ANGSTROMS.", F.col("structure_id") * 0.75 + 0.5)
    return files.select("structure_id", F.concat(remark, F.lit("\n"), "value", F.lit("\nEND\n")).alias("value"))


@query(
    "pdb_line_roundtrip",
    oracle(
        """SELECT structure_id, atom_id, resname, chain, resseq, atom_name, is_het, bfactor, round(x, 3) AS x, round(y, 3) AS y,
             round(z, 3) AS z FROM v_atoms""",
        "v_atoms",
    ),
)
def pdb_line_roundtrip(spark, sf):
    atoms = structure_text.parse_atoms(structure_text.split_lines(pdb_files(spark, sf)))
    return atoms.select(
        "structure_id", "atom_id", "resname", "chain", "resseq", "atom_name", "is_het", "bfactor", "x", "y", "z"
    )


@query(
    "resolution",
    oracle(
        """SELECT structure_id, round(structure_id * 0.75 + 0.5, 2)::DOUBLE AS resolution, structure_id * 0.75 + 0.5 > 4 AS warn
           FROM v_atoms GROUP BY structure_id""",
        "v_atoms",
    ),
)
def resolution(spark, sf):
    return quality.resolution(structure_text.split_lines(pdb_files(spark, sf)))


@query(
    "structure_catalog",
    """SELECT page_id, 'AF-P' || page_id || '-F1-model_v4.pdb' AS filename, 'P' || page_id AS uniprot_id,
         strlen(html) AS file_size FROM pages WHERE page_id % 3 != 0
       UNION ALL SELECT page_id, 'plain' || page_id || '.pdb', 'plain' || page_id, strlen(html) FROM pages
         WHERE page_id % 3 = 0""",
)
def structure_catalog(spark, sf):
    model = F.concat(F.lit("AF-P"), "page_id", F.lit("-F1-model_v4.pdb"))
    plain = F.concat(F.lit("plain"), "page_id", F.lit(".pdb"))
    name = F.when(F.col("page_id") % 3 != 0, model).otherwise(plain)
    paths = domain.table(spark, sf, "pages").select(
        "page_id",
        F.concat(F.split("url", "[?#]")[0], F.lit("/"), name).alias("path"),
        F.octet_length("html").cast("long").alias("file_size"),
    )
    return structure_text.catalog_columns(paths).select("page_id", "filename", "uniprot_id", "file_size")


@query(
    "catalog_stats",
    """SELECT count(*) AS total_structures, round(sum(strlen(html)) / 1024.0 ** 3, 9) AS total_size_gb,
         count(DISTINCT url) AS unique_proteins FROM pages""",
)
def catalog_stats(spark, sf):
    from ..operators.reports import catalog_stats as stats

    catalog = domain.table(spark, sf, "pages").select(
        F.col("url").alias("uniprot_id"), F.octet_length("html").cast("long").alias("file_size")
    )
    return rounded(stats(catalog), "total_size_gb", digits=9)


def info_lines(spark, sf):
    """Pocket-info lines per structure: a preamble, then a block of properties per pocket."""
    rows = domain.pockets(spark, sf).select("structure_id", "pocket_id", "volume", "sasa", "return_class")
    block = F.array(
        F.format_string("Pocket %d :", F.col("pocket_id") % 1000000),
        F.concat(F.lit("\tVolume : \t"), F.col("volume").cast("string")),
        F.concat(F.lit("\tMean alpha-sphere SASA : "), F.col("sasa").cast("string")),
        F.concat(F.lit("\tKind : class "), "return_class"),
    )
    blocks = rows.select("structure_id", "pocket_id", F.array_join(block, "\n").alias("block"))
    files = _whole_files(blocks, ["structure_id"], "block", "pocket_id")
    return structure_text.split_lines(files.withColumn("value", F.concat(F.lit("Created : by a test\n"), "value")))


@query(
    "pocket_block_parse",
    oracle(
        """WITH n AS (SELECT structure_id, pocket_id % 1000000 AS k, volume, sasa, return_class, pocket_id FROM v_pockets),
        m AS (SELECT structure_id, k, max_by(volume, pocket_id) AS volume, max_by(sasa, pocket_id) AS s,
            max_by(return_class, pocket_id) AS c FROM n GROUP BY ALL)
        SELECT structure_id, k::INTEGER AS pocket_id, volume, s AS mean_alpha_sphere_sasa, 'class ' || c AS kind FROM m""",
        "v_pockets",
    ),
)
def pocket_block_parse(spark, sf):
    info = structure_text.parse_info(info_lines(spark, sf))
    table = structure_text.pocket_table(info, ("volume", "mean_alpha_sphere_sasa"))
    return table.select(
        "structure_id", "pocket_id", "volume", "mean_alpha_sphere_sasa", F.try_element_at("extra", F.lit("kind")).alias("kind")
    )


def _pocket_lines(spark, sf):
    """Atom lines of each structure as if they were one pocket file, every seventh with an unreadable number."""
    lines = structure_text.split_lines(pdb_files(spark, sf))
    broken = F.concat(F.substring("line", 1, 22), F.lit(" xx "), F.substring("line", 27, 60))
    unreadable = F.col("line").startswith("ATOM") & (F.col("pos") % 7 == 0)
    return lines.withColumn("line", F.when(unreadable, broken).otherwise(F.col("line")))


_LINES = """p AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY atom_id) AS pos FROM v_atoms)"""


@query(
    "pocket_residue_lists",
    oracle(
        f"""WITH {_LINES}
        SELECT structure_id, string_agg(DISTINCT resseq::VARCHAR, ',' ORDER BY resseq::VARCHAR) AS residues FROM p
        WHERE is_het OR pos % 7 != 0 GROUP BY structure_id""",
        "v_atoms",
    ),
)
def pocket_residue_lists(spark, sf):
    lists = structure_text.pocket_residue_lists(_pocket_lines(spark, sf), ["structure_id"])
    text = F.array_join(F.array_sort(F.col("residue_ids").cast("array<string>")), ",")
    return lists.select("structure_id", text.alias("residues"))


@query(
    "pocket_centroids",
    oracle(
        """SELECT structure_id, round(coalesce(avg(round(x, 3)), 0), 6) AS center_x, round(coalesce(avg(round(y, 3)), 0), 6) AS center_y,
             round(coalesce(avg(round(z, 3)), 0), 6) AS center_z FROM (
             SELECT structure_id, x, y, z FROM v_atoms UNION ALL SELECT DISTINCT structure_id + 100, NULL, NULL, NULL FROM v_atoms)
           GROUP BY structure_id""",
        "v_atoms",
    ),
)
def pocket_centroids(spark, sf):
    ids = domain.atoms(spark, sf).select("structure_id").distinct()
    every = ids.unionByName(ids.select((F.col("structure_id") + 100).alias("structure_id")))
    centres = structure_text.pocket_centroids(every, _pocket_lines(spark, sf), ["structure_id"])
    return rounded(centres, "center_x", "center_y", "center_z")


@query(
    "pka_report_scan",
    """SELECT p_partkey AS part, ['ARG', 'LYS', 'HIS'][p_partkey % 4 + 1] AS residue_name, p_partkey::INTEGER AS residue_number,
         'A' AS chain_id, round(6 + p_size / 10, 2) AS pka FROM part WHERE p_partkey % 4 != 3""",
)
def pka_report_scan(spark, sf):
    name = F.element_at(F.array(*[F.lit(n) for n in ("ARG", "LYS", "HIS", "ASP")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    line = F.format_string("   %s %5d %s  %8.2f    0 %%", name, "p_partkey", F.lit("A"), 6 + F.col("p_size") / 10.0)
    lines = domain.table(spark, sf, "part").select(F.col("p_partkey").alias("part"), line.alias("line"))
    return reports.parse_pka(lines, ["part"])


@query(
    "potential_grid_scan",
    """SELECT n_nationkey AS map_id, ix, iy, iz, (n_nationkey * 0.5 + ix + 0.25 * iy - iz)::DOUBLE AS value
       FROM nation, range(3) a(ix), range(4) b(iy), range(5) c(iz)""",
)
def potential_grid_scan(spark, sf):
    nodes = F.sequence(F.lit(0), F.lit(59))
    value = F.transform(
        nodes,
        lambda i: (F.col("n_nationkey") * 0.5 + F.floor(i / 20) + 0.25 * F.pmod(F.floor(i / 5), F.lit(4)) - F.pmod(i, F.lit(5))).cast("string"),
    )
    head = "object 1 class gridpositions counts 3 4 5\\norigin -1.0 -2.0 -3.0\\ndelta 0.5 0 0\\ndelta 0 0.5 0\\ndelta 0 0 0.5\\nobject 3 class array type double rank 0 items 60 data follows\\n"
    files = domain.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("map_id"),
        F.concat(F.lit(head.replace("\\n", "\n")), F.array_join(value, " "), F.lit("\nattribute \"dep\" string \"positions\"\n")).alias("value"),
    )
    return reports.parse_grid_values(files)


@query(
    "ontology_edges",
    """SELECT DISTINCT c_mktsegment AS go_id, 'GO:' || substr(c_mktsegment, 1, 1) AS parent_id FROM customer""",
)
def ontology_edges(spark, sf):
    segments = domain.table(spark, sf, "customer").select("c_mktsegment").distinct()
    stanza = F.concat(
        F.lit("[Term]\nid: "), "c_mktsegment", F.lit("\nname: segment\nnamespace: market\nis_a: GO:"),
        F.substring("c_mktsegment", 1, 1), F.lit(" ! initial\n"),
    )
    text = segments.agg(F.concat_ws("\n", F.lit("format-version: 1.2\n"), F.array_sort(F.collect_list(stanza))).alias("value"))
    _, edges = reports.parse_ontology(text)
    return edges


def _protein_payloads(spark, sf):
    c = F.col
    term = F.concat(F.element_at(F.array(F.lit("P:"), F.lit("F:"), F.lit("C:")), (c("c_custkey") % 3 + 1).cast("int")), c("c_mktsegment"))
    ref = F.struct(
        F.when(c("c_custkey") % 4 == 0, "KEGG").otherwise("GO").alias("database"),
        F.array(F.struct(F.lit("GoTerm").alias("key"), term.alias("value"))).alias("properties"),
    )
    mixed = F.struct(
        F.lit("GO").alias("database"),
        F.array(F.struct(F.lit("GoTerm").alias("key"), F.concat(F.lit("C:in F:"), c("c_name")).alias("value"))).alias("properties"),
    )
    comments = F.array(
        F.struct(
            F.lit("FUNCTION").alias("commentType"),
            F.array(F.struct(F.concat(F.lit("binds "), c("c_mktsegment")).alias("value"))).alias("texts"),
            F.lit(None).cast("array<struct<location:struct<value:string>>>").alias("subcellularLocations"),
        ),
        F.struct(
            F.lit("SUBCELLULAR_LOCATION").alias("commentType"),
            F.lit(None).cast("array<struct<value:string>>").alias("texts"),
            F.array(F.struct(F.struct(F.lit("Nucleus").alias("value")).alias("location"))).alias("subcellularLocations"),
        ),
    )
    payload = F.to_json(
        F.struct(
            c("c_name").alias("primaryAccession"),
            F.when(c("c_custkey") % 5 != 0, F.array(F.struct(F.struct(c("c_mktsegment").alias("value")).alias("geneName")))).alias("genes"),
            F.struct(F.lit("Homo sapiens").alias("scientificName"), c("c_nationkey").alias("taxonId")).alias("organism"),
            F.when(c("c_custkey") % 2 == 0, F.struct(c("c_custkey").alias("length"))).alias("sequence"),
            F.when(c("c_custkey") % 3 != 1, comments).alias("comments"),
            F.array(ref, mixed).alias("uniProtKBCrossReferences"),
        )
    )
    return domain.table(spark, sf, "customer").select("c_custkey", payload.alias("payload"))


@query(
    "protein_annotations",
    """SELECT c_name AS accession, CASE WHEN c_custkey % 5 != 0 THEN c_mktsegment ELSE '' END AS gene_name, '' AS protein_name,
         'Homo sapiens' AS organism, c_nationkey::BIGINT AS taxonomy_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END
         AS sequence_length, 0::BIGINT AS mass, CASE WHEN c_custkey % 3 != 1 THEN 'binds ' || c_mktsegment ELSE '' END AS "function",
         CASE WHEN c_custkey % 4 != 0 AND c_custkey % 3 = 0 THEN 'P:' || c_mktsegment ELSE '' END AS biological_process,
         CASE WHEN c_custkey % 4 != 0 AND c_custkey % 3 = 1 THEN 'F:' || c_mktsegment || '|' ELSE '' END || 'C:in F:' || c_name
           AS molecular_function,
         CASE WHEN c_custkey % 4 != 0 AND c_custkey % 3 = 2 THEN 'C:' || c_mktsegment ELSE '' END AS cellular_component,
         CASE WHEN c_custkey % 3 != 1 THEN 'Nucleus' ELSE '' END AS subcellular_location FROM customer""",
)
def protein_annotations(spark, sf):
    flat = annotations.flatten_proteins(_protein_payloads(spark, sf))
    lists = ("biological_process", "molecular_function", "cellular_component", "subcellular_location")
    return flat.select(
        *[
            F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c) if c in lists else F.col(c)
            for c in flat.columns
        ]
    )


@query(
    "entry_annotations",
    """SELECT upper('x' || p_partkey) AS pdb_id, p_name AS title, CASE WHEN p_partkey % 3 != 0 THEN p_size / 10.0::DOUBLE END AS resolution,
         CASE WHEN p_partkey % 4 != 0 THEN p_type ELSE '' END AS method, '2020-01-01' AS deposition_date, '' AS release_date,
         p_brand AS organism FROM part""",
)
def entry_annotations(spark, sf):
    c = F.col
    payload = F.to_json(
        F.struct(
            F.struct(c("p_name").alias("title")).alias("struct"),
            F.struct(F.when(c("p_partkey") % 3 != 0, F.array(c("p_size") / 10.0)).alias("resolution_combined")).alias("rcsb_entry_info"),
            F.when(c("p_partkey") % 4 != 0, F.array(F.struct(c("p_type").alias("method")))).alias("exptl"),
            F.struct(F.lit("2020-01-01").alias("deposit_date")).alias("rcsb_accession_info"),
            F.struct(F.array(c("p_brand")).alias("source_organism_scientific_name")).alias("rcsb_entry_container_identifiers"),
        )
    )
    rows = domain.table(spark, sf, "part").select(F.concat(F.lit("x"), "p_partkey").alias("pdb_id"), payload.alias("payload"))
    return annotations.flatten_entries(rows)


@query(
    "entity_annotations",
    """SELECT p_partkey AS pdb_id, CASE WHEN p_partkey % 6 = 0 THEN 'NA' ELSE p_brand END AS organism,
         CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 8 = 0 THEN 'NA' ELSE 'R' || p_partkey END
           WHEN p_brand < p_type THEN p_brand || ';' || p_type ELSE p_type || ';' || p_brand END AS uniprot_id FROM part""",
)
def entity_annotations(spark, sf):
    c = F.col

    def entity(accession, named):
        identifier = F.struct(F.lit("UniProt").alias("database_name"), accession.alias("database_accession"))
        other = F.struct(F.lit("Norine").alias("database_name"), F.lit("x").alias("database_accession"))
        return F.struct(
            F.array(F.struct(F.when(named, c("p_brand")).otherwise("").alias("ncbi_scientific_name"))).alias("rcsb_entity_source_organism"),
            F.struct(F.when(c("p_partkey") % 4 != 0, F.array(identifier, other)).alias("reference_sequence_identifiers")).alias(
                "rcsb_polymer_entity_container_identifiers"
            ),
        )

    named = c("p_partkey") % 6 != 0
    refs = F.array(
        F.struct(
            F.when(c("p_partkey") % 8 == 0, "GB").otherwise("UniProt").alias("db_name"),
            F.concat(F.lit("R"), "p_partkey").alias("pdbx_db_accession"),
        )
    )
    payload = F.to_json(
        F.struct(F.array(entity(c("p_type"), F.lit(False)), entity(c("p_brand"), named), entity(c("p_type"), named)).alias("entities"), refs.alias("struct_ref"))
    )
    rows = domain.table(spark, sf, "part").select(c("p_partkey").alias("pdb_id"), payload.alias("payload"))
    return annotations.flatten_entities(rows)


@query(
    "model_annotations",
    """SELECT 'S' || s_suppkey AS uniprot_id, CASE WHEN s_suppkey % 2 = 0 THEN 'E' || s_suppkey ELSE 'AF-' || s_suppkey || '-F1' END
         AS entry_id, s_name AS gene, '' AS organism, s_nationkey::BIGINT AS sequence_length, s_acctbal AS global_metric_value,
         CASE WHEN s_suppkey % 3 = 0 THEN 6 ELSE 4 END::BIGINT AS model_version, '' AS model_date FROM supplier""",
)
def model_annotations(spark, sf):
    c = F.col
    model = F.struct(
        F.concat(F.lit("S"), "s_suppkey").alias("uniprotAccession"),
        F.when(c("s_suppkey") % 2 == 0, F.concat(F.lit("E"), "s_suppkey")).alias("entryId"),
        c("s_name").alias("gene"),
        c("s_nationkey").alias("uniprotSequenceLength"),
        c("s_acctbal").alias("globalMetricValue"),
        F.when(c("s_suppkey") % 3 == 0, 6).alias("latestVersion"),
    )
    rows = domain.table(spark, sf, "supplier").select(c("s_suppkey").alias("uniprot_id"), F.to_json(F.array(model)).alias("payload"))
    return annotations.flatten_models(rows)


@query("sha_manifest", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha_manifest(spark, sf):
    return tables.text_checksums(domain.table(spark, sf, "documents"), "doc_id", "text")


@query(
    "checksum_issues",
    """SELECT CAST(page_id AS VARCHAR) AS path, 'error' AS level, CASE WHEN page_id % 10 = 0 THEN 'checksum_file_exists'
         ELSE 'checksum_match' END AS "check" FROM pages WHERE page_id % 10 = 0 OR page_id % 7 = 0""",
)
def checksum_issues(spark, sf):
    pages = domain.table(spark, sf, "pages").withColumn("path", F.col("page_id").cast("string"))
    expected = tables.text_checksums(pages, "path", "html")
    changed = F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    actual = tables.text_checksums(pages.where("page_id % 10 != 0").withColumn("html", changed), "path", "html")
    return quality.checksum_issues(expected, actual)
