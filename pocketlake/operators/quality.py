"""Data-quality checks: each yields rows of (subject, level, check, message, fix) or plain metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import STANDARD_RESNAMES, is_basic
from ..schemas import ISSUES
from .testing import normality_k2

# Columns a results table must have and columns that must lie in 0..1.
REQUIRED_FEATURES = ("pocket_id", "pocket_depth", "sasa", "volume", "composite_score")
NORMALISED_COLUMNS = ("composite_score", "normalized_score", "confidence_score")
GEOMETRY_COLUMNS = ("volume", "sasa", "pocket_depth")
OVERLAP_COLUMNS = ("overlap_fraction", "overlap_with_other_pockets")
DATE_COLUMNS = ("model_date", "download_date", "updated_at")
_ALIASES = {"depth": "pocket_depth"}


def _issue(subject: Column | str, level: str, check: str, message: Column | str, fix: str) -> list[Column]:
    def text(value: Column | str) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    return [
        text(subject).cast("string").alias("subject"),
        F.lit(level).alias("level"),
        F.lit(check).alias("check"),
        text(message).alias("message"),
        F.lit(fix).alias("fix"),
    ]


def no_issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ISSUES)


def required_features(df: DataFrame, subject: str) -> DataFrame:
    """An issue row when columns are missing, settled at plan time. ``depth`` stands for ``pocket_depth``."""
    have = set(df.columns) | {_ALIASES.get(c, c) for c in df.columns}
    missing = sorted(set(REQUIRED_FEATURES) - have)
    spark = df.sparkSession
    if not missing:
        return no_issues(spark)
    row = (
        subject,
        "error",
        "required_features",
        f"columns not found: {missing}",
        "add the columns, or run the feature step again",
    )
    return spark.createDataFrame([row], ISSUES)


def schema_consistency(tables: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Compare the column set of every table with that of the first."""
    (_, first), *others = tables
    expected, rows = set(first.columns), []
    for name, df in others:
        missing, extra = sorted(expected - set(df.columns)), sorted(set(df.columns) - expected)
        if missing or extra:
            message = f"columns differ from the first table: missing={missing}, extra={extra}"
            fix = "write all tables with one version of the pipeline"
            rows.append((name, "error", "schema_consistency", message, fix))
    return first.sparkSession.createDataFrame(rows, ISSUES)


def results_counts(df: DataFrame) -> DataFrame:
    """One row with every violation count the checks below need, in a single pass."""
    parts = [F.count("*").alias("rows")]
    parts += [
        F.count_if((F.col(c) < 0) | (F.col(c) > 1)).alias(f"range_{c}") for c in NORMALISED_COLUMNS if c in df.columns
    ]
    parts += [F.count_if(F.col(c) <= 0).alias(f"geometry_{c}") for c in GEOMETRY_COLUMNS if c in df.columns]
    parts += [F.count_if(F.col(c) > 0.7).alias(f"overlap_{c}") for c in OVERLAP_COLUMNS if c in df.columns]
    return df.agg(*parts)


def duplicate_pairs(df: DataFrame, keys: Sequence[str] = ("protein_file", "pocket_id")) -> DataFrame:
    """Rows beyond the first of each key; keys are counted first, so a repeated key is folded map-side."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return counts.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_pairs"))


def results_issues(df: DataFrame, subject: str, keys: Sequence[str] = ("protein_file", "pocket_id")) -> DataFrame:
    """All issue rows of a results table: columns, ranges, geometry, overlap, normality, duplicates."""
    counts = results_counts(df)
    found = [required_features(df, subject)]

    def when(source: DataFrame, condition: Column, *issue) -> None:
        found.append(source.where(condition).select(*_issue(subject, *issue)))

    for name in counts.columns:
        kind, _, column = name.partition("_")
        n = F.col(name)
        if kind == "range":
            message = F.format_string(f"{column}: %d values outside [0, 1]", n)
            when(counts, n > 0, "error", "score_range", message, "rescale the score to [0, 1]")
        elif kind == "geometry":
            when(
                counts, n > 0, "error", "impossible_geometry", f"{column}: values of 0 or below",
                "measure these pockets again",
            )
        elif kind == "overlap":
            message = F.format_string(f"{column}: %d pockets above 0.7", n)
            when(
                counts, n > 0, "warning", "pocket_overlap", message,
                "merge overlapping pockets before ranking",
            )
    if "composite_score" in df.columns:
        when(
            normality_k2(df, "composite_score"), F.col("p_value") < 0.05, "warning", "normality_assumption",
            "composite_score: not normal at 0.05",
            "prefer rank tests",
        )
    if set(keys) <= set(df.columns):
        n = F.col("duplicate_pairs")
        message = F.format_string(f"{'/'.join(keys)}: %d repeated rows", n)
        when(
            duplicate_pairs(df, keys), n > 0, "warning", "independence_assumption", message,
            "drop repeated pockets before testing",
        )
    return reduce(DataFrame.unionByName, found)


def verdict(issues: DataFrame) -> DataFrame:
    """One row: valid iff no error-level issue exists."""
    return issues.agg(
        (F.count_if(F.col("level") == "error") == 0).alias("valid"),
        F.count_if(F.col("level") == "error").alias("errors"),
        F.count_if(F.col("level") == "warning").alias("warnings"),
    )


def _amino_acids(atoms: DataFrame) -> DataFrame:
    return atoms.where(F.col("resname").isin(*STANDARD_RESNAMES))


def completeness(atoms: DataFrame, minimum: float = 0.7) -> DataFrame:
    """Distinct residue numbers over the span they cover, per structure; no residue at all is an error."""
    number = F.when(F.col("resname").isin(*STANDARD_RESNAMES), F.col("resseq"))
    per = atoms.groupBy("structure_id").agg(
        F.countDistinct(number).alias("n_residues"), (F.max(number) - F.min(number) + 1).alias("span")
    )
    share = F.try_divide(F.col("n_residues"), F.col("span"))
    level = F.when(F.col("n_residues") == 0, "error").when(share < minimum, "warning").otherwise("ok")
    return per.select("structure_id", "n_residues", share.alias("completeness"), level.alias("level"))


def chain_lengths(atoms: DataFrame, minimum: int = 50) -> DataFrame:
    """Residues per chain folded to the shortest, the longest and the number of short chains."""
    per_chain = (
        _amino_acids(atoms).groupBy("structure_id", "chain").agg(F.countDistinct("resseq").alias("n"))
    )
    return per_chain.groupBy("structure_id").agg(
        F.min("n").alias("min_chain_length"),
        F.max("n").alias("max_chain_length"),
        F.count_if(F.col("n") < minimum).alias("short_chains"),
    )


def confidence_fraction(atoms: DataFrame, threshold: float = 70.0, maximum: float = 0.2) -> DataFrame:
    low = F.avg((F.col("bfactor") < threshold).cast("double"))
    per = atoms.groupBy("structure_id").agg(low.alias("low_confidence_fraction"), F.avg("bfactor").alias("mean_b_factor"))
    return per.withColumn("warn", F.col("low_confidence_fraction") > maximum)


def coordinate_sanity(atoms: DataFrame, tolerance: float = 1e-3, max_b: float = 300.0) -> DataFrame:
    """Atoms at the origin (error) and implausible B-factors (warning), as counts and fractions."""
    at_origin = F.lit(True)
    for a in ("x", "y", "z"):
        at_origin = at_origin & (F.abs(F.col(a)) < tolerance)
    per = atoms.groupBy("structure_id").agg(
        F.count("*").alias("n_atoms"),
        F.count_if(at_origin).alias("origin_atoms"),
        F.count_if(F.col("bfactor") > max_b).alias("high_b_atoms"),
    )
    level = F.when(F.col("origin_atoms") > 0, "error").when(F.col("high_b_atoms") > 0, "warning").otherwise("ok")
    return per.select(
        "structure_id",
        "n_atoms",
        "origin_atoms",
        "high_b_atoms",
        (F.col("origin_atoms") / F.col("n_atoms")).alias("origin_atom_fraction"),
        (F.col("high_b_atoms") / F.col("n_atoms")).alias("unreasonable_b_factor_fraction"),
        level.alias("level"),
    )


def structure_quality(atoms: DataFrame) -> DataFrame:
    """Residues, atoms, B-factor mean and minimum, missing numbers and the basic share per structure."""
    residue = F.struct("chain", "resseq")
    protein = F.col("resname").isin(*STANDARD_RESNAMES)
    number = F.when(protein, F.col("resseq"))
    per = atoms.groupBy("structure_id").agg(
        F.countDistinct(F.when(protein, residue)).alias("n_residues"),
        F.count("*").alias("n_atoms"),
        F.avg("bfactor").alias("avg_plddt"),
        F.min("bfactor").alias("min_plddt"),
        F.countDistinct(F.when(is_basic("resname"), residue)).alias("basic_residues"),
        F.coalesce(F.max(number) - F.min(number) + 1 - F.countDistinct(number), F.lit(0)).cast("long").alias("missing_residues"),
    )
    return per.withColumn("basic_fraction", F.coalesce(F.try_divide("basic_residues", "n_residues"), F.lit(0.0)))


def missing_site_residues(site: DataFrame, residues: DataFrame, shown: int = 10) -> DataFrame:
    """Site residues a structure lacks: how many, and the first ``shown`` of them."""
    absent = site.select("structure_id", "resseq").distinct().join(
        residues.select("structure_id", "resseq").distinct(), ["structure_id", "resseq"], "left_anti"
    )
    # Only the first ``shown`` numbers travel: Spark cuts each task's groups before the shuffle.
    from .filters import top_per_group

    first = top_per_group(absent, ["structure_id"], [F.asc("resseq")], shown)
    listed = first.groupBy("structure_id").agg(F.array_sort(F.collect_list("resseq")).alias("first_missing"))
    counts = absent.groupBy("structure_id").agg(F.count("*").alias("n_missing"))
    return counts.join(listed, "structure_id")


def resolution(lines: DataFrame, compat: bool = False, limit: float = 4.0) -> DataFrame:
    """Resolution from the REMARK 2 line of each file; ``compat`` keeps the first number of that line, its 2."""
    marked = lines.where(F.col("line").startswith("REMARK   2 RESOLUTION."))
    first = marked.groupBy("structure_id").agg(F.min_by("line", "pos").alias("line"))
    pattern = r"REMARK\s+([0-9.]+)" if compat else r"RESOLUTION\.\s+([0-9]+\.?[0-9]*)"
    value = F.regexp_extract("line", pattern, 1).try_cast("double")
    return (
        first.select("structure_id", value.alias("resolution"))
        .where("resolution IS NOT NULL")
        .withColumn("warn", F.col("resolution") > limit)
    )


def stale_rows(df: DataFrame, as_of: str, max_age_days: int = 365, id_col: str = "uniprot_id") -> DataFrame:
    """Rows whose first available date column is older than the limit; unreadable dates are skipped."""
    present = [c for c in DATE_COLUMNS if c in df.columns]
    if not present:
        return df.select(id_col, F.lit(0).cast("long").alias("age_days")).where(F.lit(False))
    when = F.try_to_timestamp(F.col(present[0]).cast("string"))
    seconds = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(when)
    age = F.floor(seconds / 86400)
    return df.select(id_col, age.alias("age_days")).where(F.col("age_days") > max_age_days)


def unknown_accessions(df: DataFrame, known: DataFrame, id_col: str = "uniprot_id") -> DataFrame:
    """All distinct ids that the landed accession table lacks."""
    ids = df.where(F.col(id_col).isNotNull() & (F.col(id_col) != "")).select(id_col).distinct()
    return ids.join(known.select(id_col), id_col, "left_anti")


def checksum_issues(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected (path, sha256) rows whose file is missing or differs."""
    joined = expected.join(actual.withColumnRenamed("sha256", "_actual"), "path", "left")
    check = F.when(F.col("_actual").isNull(), "checksum_file_exists").when(
        F.col("_actual") != F.col("sha256"), "checksum_match"
    )
    return joined.select("path", F.lit("error").alias("level"), check.alias("check")).where("check IS NOT NULL")
