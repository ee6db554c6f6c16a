"""Landed JSON payloads of public databases as flat columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TEXTS = "ARRAY<STRUCT<value: STRING>>"
PROTEIN_SCHEMA = f"""STRUCT<
  primaryAccession: STRING,
  genes: ARRAY<STRUCT<geneName: STRUCT<value: STRING>>>,
  proteinDescription: STRUCT<recommendedName: STRUCT<fullName: STRUCT<value: STRING>>>,
  organism: STRUCT<scientificName: STRING, taxonId: BIGINT>,
  sequence: STRUCT<length: BIGINT, molWeight: BIGINT>,
  comments: ARRAY<STRUCT<commentType: STRING, texts: {_TEXTS},
    subcellularLocations: ARRAY<STRUCT<location: STRUCT<value: STRING>>>>>,
  uniProtKBCrossReferences: ARRAY<STRUCT<database: STRING, properties: ARRAY<STRUCT<key: STRING, value: STRING>>>>>"""
ENTRY_SCHEMA = """STRUCT<
  struct: STRUCT<title: STRING>,
  rcsb_entry_info: STRUCT<resolution_combined: ARRAY<DOUBLE>>,
  exptl: ARRAY<STRUCT<method: STRING>>,
  rcsb_accession_info: STRUCT<deposit_date: STRING, initial_release_date: STRING>,
  rcsb_entry_container_identifiers: STRUCT<source_organism_scientific_name: ARRAY<STRING>>>"""
ENTITIES_SCHEMA = """STRUCT<
  entities: ARRAY<STRUCT<
    rcsb_entity_source_organism: ARRAY<STRUCT<ncbi_scientific_name: STRING>>,
    rcsb_polymer_entity_container_identifiers: STRUCT<
      reference_sequence_identifiers: ARRAY<STRUCT<database_name: STRING, database_accession: STRING>>>>>,
  struct_ref: ARRAY<STRUCT<db_name: STRING, pdbx_db_accession: STRING>>>"""
MODEL_SCHEMA = """ARRAY<STRUCT<uniprotAccession: STRING, entryId: STRING, gene: STRING, organismScientificName: STRING,
  uniprotSequenceLength: BIGINT, globalMetricValue: DOUBLE, latestVersion: BIGINT, modelCreatedDate: STRING>>"""


def _flat(schema: str) -> str:
    return " ".join(schema.split())


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def go_bucket(refs: Column, aspect: str) -> Column:
    """GO terms of one aspect. A term counts under the first of P:, F:, C: that it contains."""
    earlier = {"P": (), "F": ("P:",), "C": ("P:", "F:")}[aspect]

    def term(ref: Column) -> Column:
        named = F.filter(ref["properties"], lambda p: p["key"] == "GoTerm")
        return _text(F.element_at(F.transform(named, lambda p: p["value"]), -1))

    def belongs(ref: Column) -> Column:
        keep = (ref["database"] == "GO") & (F.size(F.filter(ref["properties"], lambda p: p["key"] == "GoTerm")) > 0)
        keep = keep & term(ref).contains(f"{aspect}:")
        for other in earlier:
            keep = keep & ~term(ref).contains(other)
        return keep

    empty = F.array().cast("array<string>")
    return F.coalesce(F.transform(F.filter(refs, belongs), term), empty)


def flatten_proteins(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Accession, names, organism, sequence facts, function, GO terms by aspect and locations."""
    parsed = payloads.select(F.from_json(text, _flat(PROTEIN_SCHEMA)).alias("d"))
    comments = F.coalesce(F.col("d.comments"), F.from_json(F.lit("[]"), "ARRAY<STRUCT<commentType: STRING, texts: ARRAY<STRUCT<value: STRING>>, subcellularLocations: ARRAY<STRUCT<location: STRUCT<value: STRING>>>>>"))
    about = F.filter(comments, lambda c: (c["commentType"] == "FUNCTION") & (F.size(c["texts"]) > 0))
    places = F.flatten(
        F.transform(
            F.filter(comments, lambda c: (c["commentType"] == "SUBCELLULAR_LOCATION") & c["subcellularLocations"].isNotNull()),
            lambda c: F.transform(c["subcellularLocations"], lambda s: _text(s["location"]["value"])),
        )
    )
    refs = F.col("d.uniProtKBCrossReferences")
    return parsed.select(
        F.col("d.primaryAccession").alias("accession"),
        _text(_first(F.col("d.genes"))["geneName"]["value"]).alias("gene_name"),
        _text(F.col("d.proteinDescription.recommendedName.fullName.value")).alias("protein_name"),
        _text(F.col("d.organism.scientificName")).alias("organism"),
        F.coalesce("d.organism.taxonId", F.lit(0)).alias("taxonomy_id"),
        F.coalesce("d.sequence.length", F.lit(0)).alias("sequence_length"),
        F.coalesce("d.sequence.molWeight", F.lit(0)).alias("mass"),
        _text(_first(_first(about)["texts"])["value"]).alias("function"),
        go_bucket(refs, "P").alias("biological_process"),
        go_bucket(refs, "F").alias("molecular_function"),
        go_bucket(refs, "C").alias("cellular_component"),
        F.filter(places, lambda p: p != "").alias("subcellular_location"),
    )


def flatten_entries(payloads: DataFrame, key: str = "pdb_id", text: str = "payload") -> DataFrame:
    parsed = payloads.select(F.upper(F.col(key).cast("string")).alias("pdb_id"), F.from_json(text, _flat(ENTRY_SCHEMA)).alias("d"))
    return parsed.select(
        "pdb_id",
        _text(F.col("d.struct.title")).alias("title"),
        _first(F.col("d.rcsb_entry_info.resolution_combined")).alias("resolution"),
        _text(_first(F.col("d.exptl"))["method"]).alias("method"),
        _text(F.col("d.rcsb_accession_info.deposit_date")).alias("deposition_date"),
        _text(F.col("d.rcsb_accession_info.initial_release_date")).alias("release_date"),
        _text(_first(F.col("d.rcsb_entry_container_identifiers.source_organism_scientific_name"))).alias("organism"),
    )


def flatten_entities(payloads: DataFrame, key: str = "pdb_id", text: str = "payload") -> DataFrame:
    """First named source organism, and the sorted distinct accessions joined by ``;`` (``NA`` without any).

    Accessions come from the polymer entities, or from the entry's own references when those have none.
    """
    parsed = payloads.select(key, F.from_json(text, _flat(ENTITIES_SCHEMA)).alias("d"))
    entities = F.col("d.entities")
    names = F.filter(
        F.flatten(
            F.transform(
                F.filter(entities, lambda e: e["rcsb_entity_source_organism"].isNotNull()),
                lambda e: F.transform(e["rcsb_entity_source_organism"], lambda s: s["ncbi_scientific_name"]),
            )
        ),
        lambda n: n.isNotNull() & (n != ""),
    )
    ids = "rcsb_polymer_entity_container_identifiers"
    refs = F.flatten(
        F.transform(
            F.filter(entities, lambda e: e[ids]["reference_sequence_identifiers"].isNotNull()),
            lambda e: e[ids]["reference_sequence_identifiers"],
        )
    )
    primary = F.transform(F.filter(refs, lambda r: r["database_name"] == "UniProt"), lambda r: r["database_accession"])
    backup = F.transform(
        F.filter(F.col("d.struct_ref"), lambda r: F.lower(r["db_name"]) == "uniprot"), lambda r: r["pdbx_db_accession"]
    )

    def joined(array: Column) -> Column:
        kept = F.filter(array, lambda a: a.isNotNull() & (a != ""))
        return F.nullif(F.array_join(F.array_sort(F.array_distinct(kept)), ";"), F.lit(""))

    return parsed.select(
        key,
        F.coalesce(_first(names), F.lit("NA")).alias("organism"),
        F.coalesce(joined(primary), joined(backup), F.lit("NA")).alias("uniprot_id"),
    )


def flatten_models(payloads: DataFrame, key: str = "uniprot_id", text: str = "payload") -> DataFrame:
    """First entry of each model-metadata list with its defaults."""
    parsed = payloads.select(key, _first(F.from_json(text, _flat(MODEL_SCHEMA))).alias("d"))
    default_id = F.concat(F.lit("AF-"), F.col(key).cast("string"), F.lit("-F1"))
    return parsed.where("d IS NOT NULL").select(
        F.col("d.uniprotAccession").alias("uniprot_id"),
        F.coalesce("d.entryId", default_id).alias("entry_id"),
        _text(F.col("d.gene")).alias("gene"),
        _text(F.col("d.organismScientificName")).alias("organism"),
        F.coalesce("d.uniprotSequenceLength", F.lit(0)).alias("sequence_length"),
        F.coalesce("d.globalMetricValue", F.lit(0.0)).alias("global_metric_value"),
        F.coalesce("d.latestVersion", F.lit(4)).alias("model_version"),
        _text(F.col("d.modelCreatedDate")).alias("model_date"),
    )
