"""Summaries over results, runs, timings and published tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def screen_summary(screened: DataFrame, hits: DataFrame, id_col: str = "structure_id", **thresholds: float) -> DataFrame:
    """Structures screened, structures with hits, hits, hit rate, score bands and the thresholds used."""
    totals = screened.agg(F.countDistinct(id_col).alias("n")).scalar()
    score = F.col("composite_score")
    row = hits.agg(
        F.countDistinct(id_col).alias("proteins_with_hits"),
        F.count("*").alias("total_hits"),
        F.count_if(score >= 0.75).alias("n_high"),
        F.count_if((score >= 0.60) & (score < 0.75)).alias("n_moderate"),
    ).withColumn("structures_screened", totals)
    rate = F.coalesce(F.try_divide("proteins_with_hits", "structures_screened"), F.lit(0.0))
    row = row.withColumn("hit_rate", rate)
    for name, value in thresholds.items():
        row = row.withColumn(name, F.lit(value))
    return row


def catalog_stats(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.count("*").alias("total_structures"),
        (F.sum("file_size") / float(1024**3)).alias("total_size_gb"),
        F.countDistinct("uniprot_id").alias("unique_proteins"),
    )


def timing_summary(timings: DataFrame) -> DataFrame:
    """Calls, total, mean and longest time per function, the most expensive first."""
    return (
        timings.groupBy("function_name")
        .agg(
            F.count("*").alias("calls"),
            F.sum("seconds").alias("total_seconds"),
            F.avg("seconds").alias("mean_seconds"),
            F.max("seconds").alias("max_seconds"),
        )
        .orderBy(F.desc("total_seconds"), "function_name")
    )


def throughput(profile: DataFrame, runtime: str = "runtime_seconds", memory: str = "peak_memory_mb") -> DataFrame:
    """Mean runtime and memory, proteins per hour, and whether the slow step should be skipped."""
    per_hour = F.try_divide(F.lit(3600.0), F.avg(runtime))
    return profile.agg(
        F.avg(runtime).alias("mean_runtime_seconds"),
        F.avg(memory).alias("mean_peak_memory_mb"),
        per_hour.alias("throughput_proteins_per_hour"),
    ).withColumn("skip_electrostatics", F.col("throughput_proteins_per_hour") < 1000)


def control_spread(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation per expected class with the gap between the two means."""
    expected, score = F.col("expected"), F.col("composite_score")
    parts = []
    for kind in ("positive", "negative"):
        member = F.when(expected == kind, score)
        parts += [F.avg(member).alias(f"{kind}_mean"), F.stddev_samp(member).alias(f"{kind}_sd")]
    return scores.agg(*parts).withColumn("separation", F.col("positive_mean") - F.col("negative_mean"))


def separation_quality(controls: DataFrame) -> DataFrame:
    """Separation of positive and negative controls with the tier-1 gate.

    Crystal artifacts are left out of the positives unless nothing else is left; NaN and NULL scores are
    skipped; without a score on both sides there is no row.
    """
    score = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    artifact = F.coalesce(F.col("burial_class") == "crystal_artifact", F.lit(False))
    positive, negative = F.col("control_type") == "positive", F.col("control_type") == "negative"
    first = F.col("tier") == 1
    passed = F.coalesce(F.col("passed"), F.lit(False))
    row = controls.withColumn("score", score).agg(
        F.coalesce(F.avg(F.when(positive & ~artifact, F.col("score"))), F.avg(F.when(positive, F.col("score")))).alias(
            "positive_mean"
        ),
        F.avg(F.when(negative, F.col("score"))).alias("negative_mean"),
        F.avg(F.when(positive & first, F.col("score"))).alias("_t1p"),
        F.avg(F.when(negative & first, F.col("score"))).alias("_t1n"),
        F.bool_and(F.when(first, passed)).alias("_t1pass"),
        F.coalesce(F.bool_and(F.when(positive & ~artifact, passed)), F.lit(True)).alias("all_positive_passed"),
        F.coalesce(F.bool_and(F.when(negative, passed)), F.lit(True)).alias("all_negative_passed"),
    )
    gap = F.col("positive_mean") - F.col("negative_mean")
    tier = F.col("_t1p") - F.col("_t1n")
    gate = F.coalesce(tier > 0.50, F.lit(False)) & F.coalesce(F.col("_t1pass"), F.lit(False))
    return row.where("positive_mean IS NOT NULL AND negative_mean IS NOT NULL").select(
        "positive_mean",
        "negative_mean",
        gap.alias("separation"),
        tier.alias("tier1_separation"),
        (gap > 0.30).alias("clear_separation"),
        gate.alias("tier1_gate_passed"),
        "all_positive_passed",
        "all_negative_passed",
    )


def mean_by_organism(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return df.groupBy("organism").agg(*[F.avg(m).alias(m) for m in metrics])


def first_value(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Value of the first row of each group along ``order``."""
    return df.groupBy(group).agg(F.min_by(value, order).alias(value))


def feature_summary(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count("*").alias("n_pockets"),
        F.coalesce(F.sum("label"), F.lit(0)).alias("n_positive_pockets"),
        F.countDistinct("pdb_id").alias("n_structures"),
    )


def structure_labels(features: DataFrame) -> DataFrame:
    return features.groupBy("pdb_id").agg(F.max("label").alias("label"))


def status_counts(events: DataFrame, status: str = "status", group: Sequence[str] = ()) -> DataFrame:
    return events.groupBy(*group, status).agg(F.count("*").alias("n"))


def class_counts(dataset: DataFrame) -> DataFrame:
    return dataset.groupBy("classification").agg(F.count("*").alias("n"))


def best_by_method(comparison: DataFrame, patterns: Mapping[str, str], metric: str = "test_roc_auc") -> DataFrame:
    """Best metric among the methods whose name matches each pattern (case is ignored)."""
    parts = [
        F.max(F.when(F.col("method").rlike(f"(?i){pattern}"), F.col(metric))).alias(name)
        for name, pattern in patterns.items()
    ]
    return comparison.agg(*parts)


def table_manifest(expected: Sequence[tuple[str, str]], present: Mapping[str, DataFrame]) -> DataFrame:
    """(table, source, rows, status) for each expected table; absent ones are pending.

    Each present table is one ``count(*)``, answered from Parquet footers where there are any.
    """
    rows = []
    for name, source in expected:
        if name in present:
            counted = present[name].agg(F.count("*").alias("rows"))
        else:
            counted = next(iter(present.values())).agg(F.lit(None).cast("long").alias("rows"))
        rows.append(
            counted.select(
                F.lit(name).alias("table"),
                F.lit(source).alias("source"),
                "rows",
                F.when(F.col("rows").isNull(), "pending").otherwise("included").alias("status"),
            )
        )
    return reduce(DataFrame.unionByName, rows)


def concatenated(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack result tables; a column that a table lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def deterministic_order(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """Sort by (column, ascending) pairs; the last one must make the order total."""
    return df.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in keys])
