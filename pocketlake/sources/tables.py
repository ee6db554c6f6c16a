"""Table sources and sinks, checksums and provenance."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.comparative import (
    hit_rates,
    ortholog_conservation,
    pairwise_tests,
    protein_hits,
    with_conservation_p,
    with_row,
)
from ..operators.enrichment import term_enrichment
from ..operators.testing import spearman
from ..runtime import freeze
from ..schemas import ISSUES, require_columns

EXPORT_FORMATS = ("csv", "json", "parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame]:
    """A results table from CSV or JSON with its read issues.

    JSON may be a list of rows, an object with a ``results`` list, or one plain object.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix not in ("csv", "json"):
        fix = "export the table in one of the two formats"
        row = (name, "error", "file_format", f"results must be .csv or .json, not .{suffix}", fix)
        return None, spark.createDataFrame([row], ISSUES)
    if suffix == "csv":
        return read_csv(spark, path), spark.createDataFrame([], ISSUES)
    df = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    if "_corrupt_record" in df.columns:
        fix = "write the file again"
        row = (name, "error", "file_read", f"{name} cannot be read", fix)
        return None, spark.createDataFrame([row], ISSUES)
    if "results" in df.columns:
        df = df.select(F.inline("results"))
    return df, spark.createDataFrame([], ISSUES)


def enqueue(ids: DataFrame, path: str, started: str) -> DataFrame:
    """Append ``{uniprot_id, status, started}`` rows for the ids of a JSON-lines work list; blanks are skipped."""
    rows = ids.where("uniprot_id IS NOT NULL").select(
        "uniprot_id", F.lit("queued").alias("status"), F.lit(started).alias("started")
    )
    rows.write.mode("append").json(path)
    return rows


def read_work_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("uniprot_id STRING").json(path)


def export_table(df: DataFrame, path: str, export_format: str) -> str:
    if export_format not in EXPORT_FORMATS:
        raise ValueError(f"unsupported export format, use one of {', '.join(EXPORT_FORMATS)}")
    writer = df.write.mode("overwrite")
    if export_format == "csv":
        writer = writer.option("header", True)
    writer.format(export_format).save(path)
    return path


def append_results(parts: Sequence[DataFrame], path: str) -> None:
    """Append result tables under the sorted union of their columns; no tables, no write."""
    if not parts:
        return
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    merged.select(*sorted(merged.columns)).write.mode("append").parquet(path)


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of every file below ``path``, by path."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    )
    return files.select("path", F.sha2("content", 256).alias("sha256")).orderBy("path")


def text_checksums(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.sha2(F.col(text).cast("binary"), 256).alias("sha256"))


def provenance_manifest(
    inputs: DataFrame,
    outputs: DataFrame,
    parameters: Mapping[str, Any],
    sources: Mapping[str, Any],
    version: str,
    generated_at: str,
) -> DataFrame:
    """One JSON text with the checksums of a run's input and output files and its parameters.

    It lists the files of one run by contract, so it is as long as that list.
    """

    def files(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias(name))

    fixed = {"parameters": dict(parameters), "dataSources": dict(sources)}
    row = with_row(files(inputs, "inputs"), files(outputs, "outputs"))
    return row.select(
        F.to_json(
            F.struct(
                F.lit("Dataset").alias("@type"),
                F.lit(generated_at).alias("generatedAt"),
                F.lit(version).alias("pipelineVersion"),
                F.lit(json.dumps(fixed["parameters"], sort_keys=True)).alias("parameters"),
                F.lit(json.dumps(fixed["dataSources"], sort_keys=True)).alias("dataSources"),
                "inputs",
                "outputs",
            )
        ).alias("manifest")
    )


def go_association_pairs(df: DataFrame) -> DataFrame:
    require_columns(df, ["protein_id", "go_id"], "GO association table")
    return df.select(F.col("protein_id").cast("string"), F.col("go_id").cast("string")).distinct()


def write_comparative_package(
    hits: DataFrame,
    orthologs: DataFrame,
    associations: DataFrame,
    edges: DataFrame,
    ip6: Mapping[str, float],
    folder: str,
) -> dict[str, str]:
    """All tables of the comparative study as CSV folders below ``folder``."""
    folded = freeze(protein_hits(hits))
    rates = freeze(hit_rates(folded, ip6))
    correlation = spearman(rates, "ip6_uM", "hit_rate")
    tables = {
        "comparative_statistics_table": with_row(rates, correlation),
        "hit_rates": rates,
        "ip6_hit_rate_spearman": correlation,
        "pairwise_organism_tests": pairwise_tests(rates).withColumn(
            "contingency_table", F.to_json("contingency_table")
        ),
        "ortholog_conservation": with_conservation_p(ortholog_conservation(orthologs, folded)),
        "go_enrichment_results": term_enrichment(folded, associations, edges),
    }
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in tables}
