"""Comparison of hit rates and conservation across organisms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_p, chi2_yates, fisher_p, odds_ratio
from ..functions.values import to_boolean
from ..runtime import freeze
from ..schemas import HIT_COLUMNS, ORTHOLOG_COLUMNS, require_columns
from .testing import benjamini_hochberg, two_proportion_sample_size, wilson_interval

# Intracellular IP6 in µM by organism.
PACKAGE_IP6 = {
    "Homo sapiens": 25.0,
    "Saccharomyces cerevisiae": 20.0,
    "Dictyostelium discoideum": 520.0,
    "Mus musculus": 25.0,
    "Rattus norvegicus": 25.0,
}


def lookup(key: str, values: Mapping[str, float], default: float | None = None) -> Column:
    """A fixed dimension as a literal map; keys it lacks give ``default``."""
    if not values:
        return F.lit(default).cast("double")
    pairs = [F.lit(part) for item in values.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(key)), F.lit(default).cast("double"))


def protein_hits(hits: DataFrame) -> DataFrame:
    """One row per (organism, protein): is any of its rows a hit. Shrinks repeated rows map-side."""
    require_columns(hits, HIT_COLUMNS, "hits table")
    return (
        hits.where("organism IS NOT NULL")
        .withColumn("is_hit", to_boolean("is_hit"))
        .groupBy("organism", "protein_id")
        .agg(F.bool_or("is_hit").alias("is_hit"))
    )


def hit_rates(hits: DataFrame, ip6: Mapping[str, float], confidence: float = 0.95) -> DataFrame:
    """Distinct proteins and hits per organism with the Wilson interval and the IP6 level."""
    counts = (
        protein_hits(hits)
        .where("protein_id IS NOT NULL")
        .groupBy("organism")
        .agg(F.count("*").alias("n_proteins"), F.count_if(F.col("is_hit")).alias("n_hits"))
    )
    n, k = F.col("n_proteins"), F.col("n_hits")
    low, high = wilson_interval(k, n, confidence)
    rate = k / n
    return counts.select(
        "organism",
        "n_proteins",
        "n_hits",
        rate.alias("hit_rate"),
        (rate * 100).alias("hit_rate_percent"),
        low.alias("ci_low"),
        high.alias("ci_high"),
        (low * 100).alias("ci_low_percent"),
        (high * 100).alias("ci_high_percent"),
        lookup("organism", ip6).alias("ip6_uM"),
    )


def organism_pairs(rates: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unordered pairs of the one-row-per-organism table, with the given columns suffixed _a and _b.

    The table is one row per organism, so each row carries the list of the later organisms.
    """
    entry = F.struct("organism", *columns)
    listed = rates.agg(F.array_sort(F.collect_list(entry)).alias("l")).scalar()
    return (
        rates.withColumn("_all", listed)
        .withColumn("_b", F.explode(F.filter("_all", lambda other: other["organism"] > F.col("organism"))))
        .select(
            F.col("organism").alias("organism_a"),
            F.col("_b.organism").alias("organism_b"),
            *[F.col(c).alias(f"{c}_a") for c in columns],
            *[F.col(f"_b.{c}").alias(f"{c}_b") for c in columns],
        )
    )


def pairwise_tests(rates: DataFrame) -> DataFrame:
    """Chi-square and Fisher tests for every organism pair, each with its own FDR control.

    The rates are frozen first: they are a few rows behind a full scan of the hits.
    """
    pairs = organism_pairs(freeze(rates), ["n_hits", "n_proteins"])
    a, c = F.col("n_hits_a"), F.col("n_hits_b")
    b, d = F.col("n_proteins_a") - a, F.col("n_proteins_b") - c
    tested = pairs.select(
        "organism_a",
        "organism_b",
        F.array(F.array(a, b), F.array(c, d)).alias("contingency_table"),
        chi2_yates(a, b, c, d).alias("chi2_stat"),
        odds_ratio(a, b, c, d).alias("fisher_odds_ratio"),
        fisher_p(a, b, c, d).alias("fisher_p_value"),
    ).withColumn("chi2_p_value", chi2_p(F.col("chi2_stat")))
    with_fisher = benjamini_hochberg(freeze(tested), "fisher_p_value", prefix="fisher_").drop("fisher_reject")
    both = benjamini_hochberg(with_fisher, "chi2_p_value", prefix="chi2_").drop("chi2_reject")
    return both.withColumnsRenamed({"fisher_fdr_q_value": "fisher_fdr_q", "chi2_fdr_q_value": "chi2_fdr_q"})


def pairwise_power(rates: DataFrame, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    pairs = organism_pairs(freeze(rates), ["hit_rate"])
    size = two_proportion_sample_size(F.col("hit_rate_a"), F.col("hit_rate_b"), alpha, power)
    return pairs.withColumn("required_n_per_group", size)


def ortholog_hits(orthologs: DataFrame, hits: DataFrame) -> DataFrame:
    """Orthologs with their hit flag; unscreened proteins count as no hit."""
    require_columns(orthologs, ORTHOLOG_COLUMNS, "ortholog table")
    return orthologs.join(protein_hits(hits), ["organism", "protein_id"], "left").withColumn(
        "is_hit", F.coalesce("is_hit", F.lit(False))
    )


def ortholog_conservation(orthologs: DataFrame, hits: DataFrame, n_organisms: int = 3) -> DataFrame:
    """Organisms present and organisms with hits per orthogroup, with the conservation flags.

    Rows are folded to (orthogroup, organism) first, which bounds what one orthogroup sends on.
    """
    per_organism = (
        ortholog_hits(orthologs, hits).groupBy("orthogroup", "organism").agg(F.bool_or("is_hit").alias("is_hit"))
    )
    summary = per_organism.groupBy("orthogroup").agg(
        F.count("organism").alias("organisms_present"), F.count_if(F.col("is_hit")).alias("organisms_with_hits")
    )
    with_hits = F.col("organisms_with_hits")
    return summary.withColumn("hit_conserved_all", (with_hits == n_organisms).cast("int")).withColumn(
        "hit_in_any", (with_hits >= 1).cast("int")
    )


def conservation_counts(summary: DataFrame, n_organisms: int = 3) -> DataFrame:
    """Conserved, partial and absent orthogroups as one row."""
    with_hits = F.col("organisms_with_hits")
    return summary.agg(
        F.count_if(with_hits == n_organisms).alias("conserved"),
        F.count_if((with_hits >= 1) & (with_hits < n_organisms)).alias("partial"),
        F.count_if(with_hits == 0).alias("absent"),
    )


def with_conservation_p(summary: DataFrame, n_organisms: int = 3) -> DataFrame:
    """The summary with one Fisher p of [[conserved, partial], [partial, absent]] on every row."""
    counts = conservation_counts(summary, n_organisms)
    partial = F.col("partial")
    p = counts.select(fisher_p(F.col("conserved"), partial, partial, F.col("absent")).alias("p"))
    return summary.withColumn("conservation_fisher_p_value", p.scalar())


def membership_regions(orthologs: DataFrame, hits: DataFrame) -> DataFrame:
    """Venn regions: how many orthogroups have hits in exactly this set of organisms."""
    with_hits = ortholog_hits(orthologs, hits).where("is_hit").select("orthogroup", "organism").distinct()
    patterns = with_hits.groupBy("orthogroup").agg(F.array_join(F.sort_array(F.collect_set("organism")), "&").alias("region"))
    return patterns.groupBy("region").agg(F.count("*").alias("n_orthogroups"))


def class_fractions(dataset: DataFrame) -> DataFrame:
    """Buried fraction and structures per organism; if no organism is known, per ligand type."""
    buried = F.col("classification").isin("Cryptic", "Semi-cryptic").cast("double")
    known = F.col("organism").isNotNull() & (F.col("organism") != "NA")

    def by(column: str) -> DataFrame:
        return dataset.groupBy(F.col(column).alias("organism")).agg(
            F.avg(buried).alias("hit_rate"), F.countDistinct("pdb_id").alias("n_structures")
        )

    any_known = F.coalesce(dataset.agg(F.bool_or(known).alias("k")).scalar(), F.lit(False))
    named = by("organism").where(known)
    fallback = by("ligand_type").where(F.col("organism").isNotNull()).where(~any_known)
    return named.unionByName(fallback)


def with_package_ip6(rates: DataFrame) -> DataFrame:
    return rates.withColumn("ip6_concentration", lookup("organism", PACKAGE_IP6, 25.0))


def class_enrichment(dataset: DataFrame) -> DataFrame:
    """Counts of the three burial classes (0 when absent), scaled by the largest count."""
    classes = ("Cryptic", "Semi-cryptic", "Surface")
    names = F.array(*[F.lit(c) for c in classes])
    known = dataset.where(F.col("classification").isin(*classes))
    # At most three rows, so the map below has at most three entries.
    found = known.groupBy("classification").agg(F.count("*").alias("count")).agg(
        F.map_from_entries(F.collect_list(F.struct("classification", "count"))).alias("m")
    )
    listed = found.select(F.explode(names).alias("classification"), "m").select(
        "classification", F.coalesce(F.try_element_at("m", F.col("classification")), F.lit(0)).alias("count"), "m"
    )
    peak = F.greatest(F.lit(1), *[F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0)) for c in classes])
    return listed.select("classification", "count", (F.col("count") / peak).alias("enrichment_score"))


def min_max_normalised(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Each metric rescaled to 0..1 over all rows; a constant metric gives NULL."""
    bounds = df.agg(
        F.struct(*[x for m in metrics for x in (F.min(m).alias(f"lo_{m}"), F.max(m).alias(f"hi_{m}"))]).alias("b")
    ).scalar()
    scaled = df.withColumn("_b", bounds)
    for m in metrics:
        lo, hi = F.col(f"_b.lo_{m}"), F.col(f"_b.hi_{m}")
        scaled = scaled.withColumn(m, F.try_divide(F.col(m) - lo, hi - lo))
    return scaled.drop("_b")


def conservation_scores(dataset: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` cryptic rows of smallest area with 1 − area / largest area."""
    top = lowest_area(dataset, n)
    peak = top.agg(F.greatest(F.max("sasa"), F.lit(1.0)).alias("p")).scalar()
    species = F.coalesce(F.nullif(F.col("organism"), F.lit("NA")), F.col("pdb_id").cast("string"))
    return top.withColumn("_peak", peak).select(
        species.alias("species"),
        (1.0 - F.col("sasa") / F.col("_peak")).alias("conservation_score"),
        F.col("pdb_id").alias("candidate"),
    )


def lowest_area(dataset: DataFrame, n: int = 10) -> DataFrame:
    return dataset.where(F.col("classification") == "Cryptic").orderBy(F.asc("sasa"), F.asc("pdb_id")).limit(n)


def candidate_gallery(controls: DataFrame, dataset: DataFrame, n: int = 10) -> DataFrame:
    """Best positive controls; if there is none, cryptic dataset rows scored by their area."""
    positives = controls.where(F.col("control_type") == "positive")
    none = F.coalesce(positives.agg(F.count("*").alias("n")).scalar(), F.lit(0)) == 0
    best = (
        positives.orderBy(F.desc("score"), F.asc("pdb_id"))
        .limit(n)
        .select(F.concat(F.col("protein"), F.lit(" ("), F.col("pdb_id").cast("string"), F.lit(")")).alias("candidate"), "score")
    )
    fallback = (
        dataset.where(F.col("classification") == "Cryptic")
        .orderBy("pdb_id")
        .limit(n)
        .where(none)
        .select(F.col("pdb_id").cast("string").alias("candidate"), (1.0 - F.col("sasa") / 50.0).alias("score"))
    )
    return best.unionByName(fallback)


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row of ``df`` with the columns of a one-row table."""
    packed = one_row.select(F.struct(*one_row.columns).alias("r")).scalar()
    return df.withColumn("_r", packed).select(*df.columns, *[F.col(f"_r.{c}").alias(c) for c in one_row.columns])


def unique_listed_ids(dataset: DataFrame, column: str = "uniprot_id", minimum: int = 20) -> DataFrame:
    """Distinct ids over ``;``-separated lists and whether they fall short of ``minimum``."""
    ids = dataset.where(F.col(column) != "NA").select(F.explode(F.split(column, ";")).alias("id"))
    return ids.where("id != ''").agg(F.countDistinct("id").alias("n_proteins")).withColumn(
        "below_minimum", F.col("n_proteins") < minimum
    )
