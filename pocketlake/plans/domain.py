"""Core tables derived from the test tables, so that every operator runs on whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IP6_MICROMOLAR = {"AFRICA": 20.0, "AMERICA": 25.0, "ASIA": 520.0, "EUROPE": 40.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pocket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pocket features, one row per source row (a key may repeat)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("structure_id"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("pocket_id"),
        (F.col("l_extendedprice") / 100).alias("volume"),
        (F.col("l_discount") * 200).alias("depth"),
        (F.col("l_discount") * 250).alias("burial_depth"),
        F.col("l_quantity").alias("sasa"),
        F.col("l_linenumber").alias("basic_residues"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") % 3 == 0), None)
        .otherwise(F.col("l_tax") * 100 - 1)
        .alias("electrostatic_potential"),
        F.when(F.col("l_partkey") % 11 == 0, None)
        .otherwise((F.lit(50) + F.col("l_partkey") % 50).cast("double"))
        .alias("plddt_confidence"),
        F.col("l_returnflag").alias("return_class"),
        F.col("l_shipdate").alias("seen_at"),
    )


def pockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pocket_rows`` with one row, the latest, per (structure, pocket)."""
    latest = Window.partitionBy("structure_id", "pocket_id").orderBy(
        F.desc("seen_at"), F.desc("volume"), F.desc("sasa"), F.desc("depth"), F.desc("return_class")
    )
    rows = pocket_rows(spark, sf_dir)
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    is_het = F.col("vec_id") % 25 == 7
    protein = F.element_at(
        F.array(*[F.lit(name) for name in ("ARG", "LYS", "HIS", "ALA", "GLY")]), (F.col("vec_id") % 5 + 1).cast("int")
    )

    def axis(position: int) -> F.Column:
        return F.element_at("embedding", position).cast("double") * 40

    return emb.select(
        F.col("label").alias("structure_id"),
        F.col("vec_id").alias("atom_id"),
        axis(1).alias("x"),
        axis(2).alias("y"),
        axis(3).alias("z"),
        is_het.alias("is_het"),
        F.when(is_het, "IHP").otherwise(protein).alias("resname"),
        F.when(F.col("vec_id") % 3 == 0, "B").otherwise("A").alias("chain"),
        F.floor(F.col("vec_id") / 2).cast("int").alias("resseq"),
        F.when(F.col("vec_id") % 2 == 0, "CA").otherwise("O1").alias("atom_name"),
        (F.lit(50) + F.col("vec_id") % 50).cast("double").alias("bfactor"),
        (F.abs(F.element_at("embedding", 4).cast("double")) * 100).alias("sasa"),
    )


def pocket_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One centre per ligand atom; odd ids carry their own residue list."""
    own = F.array(F.col("resseq") - 1, F.col("resseq"), F.col("resseq") + 20)
    return (
        atoms(spark, sf_dir)
        .where("is_het")
        .select(
            "structure_id",
            F.col("atom_id").alias("pocket_id"),
            (F.col("x") + 1.5).alias("center_x"),
            (F.col("y") + 1.5).alias("center_y"),
            (F.col("z") + 1.5).alias("center_z"),
            F.when(F.col("atom_id") % 2 == 1, own).alias("residue_ids"),
            ((F.col("atom_id") % 100) / 100.0).alias("composite_score"),
        )
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")

    def axis(position: int) -> F.Column:
        return F.element_at("embedding", position).cast("double") * 4

    return emb.select(
        F.col("label").alias("candidate_id"),
        (F.col("vec_id") % 4).cast("int").alias("frame"),
        (F.floor(F.col("vec_id") / 4) % 5).cast("int").alias("atom_id"),
        (F.col("vec_id") % 3 == 0).alias("is_water"),
        F.when(F.col("vec_id") % 7 == 0, "H").otherwise("C").alias("element"),
        F.col("vec_id").alias("row_id"),
        axis(1).alias("x"),
        axis(2).alias("y"),
        axis(3).alias("z"),
    )


def organisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer → region, the organism dimension of the comparative tables."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.col("r_name").alias("organism")
    )
    customer = table(spark, sf_dir, "customer")
    return customer.join(places, customer.c_nationkey == places.n_nationkey).select(
        F.col("c_custkey").alias("protein_id"), "organism", "c_mktsegment", "c_acctbal"
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    people = organisms(spark, sf_dir).select("protein_id", "organism")
    return orders.join(people, orders.o_custkey == people.protein_id).select(
        "organism", "protein_id", F.when(F.col("o_orderpriority") == "1-URGENT", "yes").otherwise("no").alias("is_hit")
    )


def orthologs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organisms(spark, sf_dir).select(
        (F.col("protein_id") % 97).alias("orthogroup"), "organism", "protein_id"
    )


def go_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organisms(spark, sf_dir).select("organism", "protein_id", F.col("c_mktsegment").alias("go_id"))


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").alias("y"),
        ((F.col("n_chars") % 100) / 100.0).alias("score"),
        F.col("source").alias("grp"),
        "n_chars",
    )


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pdb_id"),
        F.col("p_type").alias("ligand_type"),
        size.alias("sasa"),
        F.when(F.col("p_size") % 7 == 0, "NA").otherwise(F.col("p_brand")).alias("organism"),
        F.concat_ws(";", "p_brand", "p_type").alias("uniprot_id"),
        F.when(size < 5, "Cryptic").when(size <= 20, "Semi-cryptic").otherwise("Surface").alias("classification"),
    )


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("uniprot_id"),
        F.col("event_type").alias("organism"),
        F.col("props").alias("analysis_results"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") % 3).cast("string").alias("pipeline_version"),
        F.substring(F.sha2(F.col("props"), 256), 1, 1).alias("params_hash"),
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("function_name"), F.col("value").alias("seconds")
    )


def pka_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pKa rows; every eighth is of a residue that is in no site, so the site's own residue has none."""
    return (
        table(spark, sf_dir, "part")
        .select(
            F.element_at(
                F.array(F.lit("ARG"), F.lit("LYS"), F.lit("HIS")), (F.col("p_partkey") % 3 + 1).cast("int")
            ).alias("residue_name"),
            F.when(F.col("p_partkey") % 8 == 0, -F.col("p_partkey")).otherwise(F.col("p_partkey")).alias("residue_number"),
            F.lit("A").alias("chain_id"),
            (6 + F.col("p_size") / 10.0).alias("pka"),
        )
    )


def site_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, residue) list: brands are sites; the multiples of 40 form a site without any pKa."""
    return table(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 40 == 0, "no_pka").otherwise(F.col("p_brand")).alias("site"),
        F.col("p_partkey").alias("residue_number"),
    )


def apply_feature_names(pocket_table: DataFrame) -> DataFrame:
    """Pocket columns under the names the classifiers train on."""
    return pocket_table.withColumnsRenamed(
        {"depth": "pocket_depth", "basic_residues": "n_basic_residues", "volume": "pocket_volume"}
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pockets: label by a rule on depth and area, so that a classifier can learn it."""
    rows = apply_feature_names(pockets(spark, sf_dir))
    label = ((F.col("pocket_depth") >= 12) & (F.col("sasa") <= 20)).cast("int")
    return rows.select(
        F.col("structure_id").alias("pdb_id"),
        "pocket_id",
        "pocket_depth",
        "sasa",
        "electrostatic_potential",
        F.col("n_basic_residues").cast("double").alias("n_basic_residues"),
        "pocket_volume",
        "plddt_confidence",
        label.alias("label"),
    )
