"""Registered queries that write given tables to the shared folder and read them back through the library's own sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning, quality
from ..runtime import freeze, scratch_path
from ..sources import tables
from . import domain
from .oracle_views import oracle
from .queries_comparative import rounded
from .registry import query


def _parts(spark, sf):
    return domain.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")


@query("csv_round_trip", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv")
    tables.write_csv(_parts(spark, sf), path)
    return tables.read_csv(spark, path, _parts(spark, sf).schema)


@query("results_reader", "SELECT p_partkey, p_brand, p_size, 0 AS issues FROM part")
def results_reader(spark, sf):
    path = f"{scratch_path(spark, 'results')}.csv"
    tables.write_csv(_parts(spark, sf), path)
    found, issues = tables.read_results(spark, path)
    columns = [F.col(c).cast(t).alias(c) for c, t in (("p_partkey", "long"), ("p_brand", "string"), ("p_size", "int"))]
    return found.select(*columns).withColumn("issues", issues.agg(F.count("*").cast("int")).scalar())


@query(
    "work_queue",
    """SELECT CAST(o_custkey AS VARCHAR) AS uniprot_id, 'queued' AS status, '2026-01-01' AS started
       FROM orders WHERE o_custkey % 7 != 0""",
)
def work_queue(spark, sf):
    ids = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey").cast("string")).alias("uniprot_id")
    incoming, queue = scratch_path(spark, "incoming"), scratch_path(spark, "queue")
    domain.table(spark, sf, "orders").select(ids).write.json(incoming)
    tables.enqueue(tables.read_work_list(spark, incoming), queue, "2026-01-01")
    return spark.read.schema("uniprot_id STRING, status STRING, started STRING").json(queue)


@query(
    "table_export",
    """SELECT f.format, count(*) AS n, sum(p_partkey)::BIGINT AS keys, count(DISTINCT p_brand) AS brands
       FROM part CROSS JOIN (VALUES ('csv'), ('json'), ('parquet')) AS f(format) GROUP BY f.format""",
)
def table_export(spark, sf):
    parts = _parts(spark, sf)
    read = []
    for kind in tables.EXPORT_FORMATS:
        path = tables.export_table(parts, scratch_path(spark, kind), kind)
        reader = spark.read.option("header", True) if kind == "csv" else spark.read
        read.append(reader.schema(parts.schema).format(kind).load(path).withColumn("format", F.lit(kind)))
    whole = read[0].unionByName(read[1]).unionByName(read[2])
    return whole.groupBy("format").agg(
        F.count("*").alias("n"), F.sum("p_partkey").alias("keys"), F.countDistinct("p_brand").alias("brands")
    )


@query(
    "results_append",
    """SELECT p_brand AS brand, p_partkey AS key, NULL::INTEGER AS size FROM part WHERE p_size <= 25
       UNION ALL SELECT NULL, p_partkey, p_size FROM part WHERE p_size > 25
       UNION ALL SELECT p_brand, p_partkey, p_size FROM part""",
)
def results_append(spark, sf):
    path = scratch_path(spark, "append")
    parts = _parts(spark, sf).select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    tables.append_results([parts.where("size <= 25").drop("size"), parts.where("size > 25").drop("brand")], path)
    tables.append_results([], path)
    tables.append_results([parts], path)
    return spark.read.parquet(path)


@query(
    "file_checksums",
    """SELECT count(DISTINCT n_regionkey) AS n_files, count(DISTINCT n_regionkey) AS n_same FROM nation""",
)
def file_checksums(spark, sf):
    """Checksums of files written twice: as many files as regions, and each equal to its copy."""
    nations = domain.table(spark, sf, "nation").select("n_regionkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("value"))
    sums = []
    for _ in range(2):
        path = scratch_path(spark, "nations")
        ordered = nations.repartition(1).sortWithinPartitions("n_regionkey", "value")
        ordered.write.partitionBy("n_regionkey").text(path)
        region = F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).alias("path")
        sums.append(tables.checksums(spark, path, "*.txt").select(region, "sha256"))
    moved = learning.dataset_changed(*sums)
    same = sums[0].join(sums[1], ["path", "sha256"])
    return same.agg(sums[0].agg(F.count("*")).scalar().alias("n_files"), (F.count("*") * F.lit(int(not moved))).alias("n_same"))


@query(
    "retrain_decision",
    "SELECT false AS same_files, true AS changed_file FROM nation WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation)",
)
def retrain_decision(spark, sf):
    before = tables.text_checksums(domain.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_name"), "path", "p_name")
    after = before.withColumn("sha256", F.when(F.col("path") == "7", "0").otherwise(F.col("sha256")))
    answers = (learning.dataset_changed(before, before), learning.dataset_changed(after, before))
    return spark.createDataFrame([answers], "same_files boolean, changed_file boolean")


@query(
    "provenance_manifest",
    """SELECT (SELECT count(*) FROM nation) AS n_inputs, (SELECT count(*) FROM region) AS n_outputs,
         (SELECT sha256(n_name) FROM nation ORDER BY CAST(n_nationkey AS VARCHAR) LIMIT 1) AS first_input, 'v1' AS version""",
)
def provenance_manifest(spark, sf):
    def sums(name, key, text):
        return tables.text_checksums(domain.table(spark, sf, name).select(F.col(key).cast("string").alias("path"), text), "path", text)

    made = tables.provenance_manifest(
        sums("nation", "n_nationkey", "n_name"), sums("region", "r_regionkey", "r_name"), {"min_score": 0.6}, {"source": "tables"}, "v1", "2026-01-01"
    )
    path = scratch_path(spark, "manifest")
    made.write.text(path)
    files = "array<struct<path: string, sha256: string>>"
    row = spark.read.text(path).select(F.from_json("value", f"pipelineVersion string, inputs {files}, outputs {files}").alias("m"))
    return row.select(
        F.size("m.inputs").cast("long").alias("n_inputs"),
        F.size("m.outputs").cast("long").alias("n_outputs"),
        F.col("m.inputs")[0]["sha256"].alias("first_input"),
        F.col("m.pipelineVersion").alias("version"),
    )


@query(
    "schema_differences",
    """SELECT 'renamed' AS subject, 'error' AS level, 'schema_consistency' AS check
       UNION ALL SELECT 'shorter', 'error', 'schema_consistency'""",
)
def schema_differences(spark, sf):
    parts = _parts(spark, sf)
    sets = [("first", parts), ("same", parts), ("renamed", parts.withColumnRenamed("p_size", "size")), ("shorter", parts.drop("p_size"))]
    read = []
    for name, df in sets:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        read.append((name, spark.read.parquet(path)))
    return quality.schema_consistency(read).select("subject", "level", "check")


@query(
    "comparative_package",
    oracle(
        """SELECT organism, n_proteins, n_hits, round(hit_rate, 6) AS hit_rate, 6 AS n_tables FROM v_hit_rates""",
        "v_hit_rates",
    ),
)
def comparative_package(spark, sf):
    edges = spark.createDataFrame([("BUILDING", "ROOT")], "go_id string, parent_id string")
    associations = domain.organisms(spark, sf).join(
        domain.table(spark, sf, "customer").select(F.col("c_custkey").alias("protein_id"), F.col("c_mktsegment").alias("go_id")), "protein_id"
    )
    folder = scratch_path(spark, "package")
    written = tables.write_comparative_package(
        domain.hits(spark, sf), domain.orthologs(spark, sf), associations, edges, domain.IP6_MICROMOLAR, folder
    )
    kinds = "organism string, n_proteins long, n_hits long, hit_rate double"
    back = tables.read_csv(spark, written["hit_rates"]).select(*[F.col(x.split()[0]).cast(x.split()[1]).alias(x.split()[0]) for x in kinds.split(", ")])
    return rounded(back, "hit_rate").withColumn("n_tables", F.lit(len(written)))


@query(
    "model_round_trip",
    oracle("SELECT structure_id AS pdb_id, pocket_id, true AS same, true AS in_range FROM v_pockets", "v_pockets"),
)
def model_round_trip(spark, sf):
    """A model read back from its folder scores every pocket as the one that was saved."""
    rows = freeze(domain.features(spark, sf))
    model, _ = learning.fit(rows, "random_forest", grid={"numTrees": [10], "maxDepth": [5]})
    path = scratch_path(spark, "model")
    learning.save_model(model, path)
    first = learning.predict(model, rows, "p")
    both = learning.predict(learning.load_model(path), first, "q")
    return both.select("pdb_id", "pocket_id", (F.col("p") == F.col("q")).alias("same"), F.col("p").between(0, 1).alias("in_range"))
