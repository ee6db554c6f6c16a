"""Registered queries: gates, ranks, top-k, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import composite_score
from ..operators import features, filters, matching, reports
from . import domain
from .oracle_views import class_sql, oracle
from .registry import query

_ROW = "structure_id, pocket_id, round(composite_score, 8) AS composite_score"


def scored_rows(spark, sf):
    return domain.pocket_rows(spark, sf).withColumn("composite_score", composite_score())


def scored(spark, sf):
    return domain.pockets(spark, sf).withColumn("composite_score", composite_score())


def _brief(df):
    return df.select("structure_id", "pocket_id", F.round("composite_score", 8).alias("composite_score"))


@query("gate_score", oracle(f"SELECT {_ROW} FROM v_scored_rows WHERE composite_score >= 0.60::DOUBLE", "v_scored_rows"))
def gate_score(spark, sf):
    return _brief(filters.by_score(scored_rows(spark, sf)))


@query(
    "gate_criteria",
    oracle(
        f"""SELECT {_ROW} FROM v_scored_rows
            WHERE basic_residues >= 4 AND sasa <= 10 AND volume BETWEEN 300 AND 800""",
        "v_scored_rows",
    ),
)
def gate_criteria(spark, sf):
    return _brief(filters.by_criteria(scored_rows(spark, sf)))


@query(
    "gate_burial_depth",
    oracle("SELECT structure_id, pocket_id, burial_depth FROM v_pocket_rows WHERE burial_depth >= 15", "v_pocket_rows"),
)
def gate_burial_depth(spark, sf):
    return filters.by_burial_depth(domain.pocket_rows(spark, sf)).select("structure_id", "pocket_id", "burial_depth")


@query(
    "gate_confidence_column",
    oracle(
        "SELECT structure_id, pocket_id, plddt_confidence FROM v_pocket_rows WHERE coalesce(plddt_confidence, 0) >= 70",
        "v_pocket_rows",
    ),
)
def gate_confidence_column(spark, sf):
    return filters.by_confidence(domain.pocket_rows(spark, sf)).select("structure_id", "pocket_id", "plddt_confidence")


_GATE = """g AS (SELECT c.structure_id, c.pocket_id,
    coalesce(avg((m.plddt >= 70)::INT) FILTER (WHERE m.plddt IS NOT NULL), 0) AS fraction, min(m.plddt) AS low
  FROM (SELECT structure_id, pocket_id, unnest(residue_ids) AS resseq FROM c WHERE residue_ids IS NOT NULL) c
  LEFT JOIN v_residue_map m USING (structure_id, resseq) GROUP BY ALL)"""
_CENTRE_CONFIDENCE = """c AS (SELECT *, CASE WHEN pocket_id % 4 = 0 THEN CAST(60 + pocket_id % 30 AS DOUBLE) END
  AS plddt_confidence FROM v_centres)"""


@query(
    "gate_confidence_residues",
    oracle(
        f"""WITH {_CENTRE_CONFIDENCE}, {_GATE}
        SELECT c.structure_id, c.pocket_id FROM c LEFT JOIN g USING (structure_id, pocket_id)
        WHERE CASE WHEN c.residue_ids IS NOT NULL THEN g.fraction >= 0.80 AND g.low >= 60
                   ELSE c.plddt_confidence IS NULL OR c.plddt_confidence >= 70 END""",
        "v_centres",
        "v_residue_map",
    ),
)
def gate_confidence_residues(spark, sf):
    own = F.when(F.col("pocket_id") % 4 == 0, (F.lit(60) + F.col("pocket_id") % 30).cast("double"))
    centres = domain.pocket_centres(spark, sf).withColumn("plddt_confidence", own)
    residues = features.residues_from_atoms(domain.atoms(spark, sf))
    return filters.by_residue_confidence(centres, residues).select("structure_id", "pocket_id")


@query(
    "gate_cascade_ranked",
    oracle(
        f"""SELECT {_ROW}, row_number() OVER (ORDER BY v_scored.composite_score DESC, structure_id, pocket_id) AS rank,
              {class_sql("v_scored.composite_score")} AS classification
            FROM v_scored WHERE v_scored.composite_score >= 0.60::DOUBLE AND basic_residues >= 4 AND sasa <= 10
              AND volume BETWEEN 300 AND 800 AND burial_depth >= 15""",
        "v_scored",
    ),
)
def gate_cascade_ranked(spark, sf):
    ranked = filters.cryptic_candidates(scored(spark, sf), min_burial_depth=15.0)
    return ranked.select(
        "structure_id", "pocket_id", F.round("composite_score", 8).alias("composite_score"), "rank", "classification"
    )


@query(
    "catalog_confidence_gate",
    oracle(
        """SELECT structure_id, round(mean_plddt, 6) AS mean_plddt FROM (
          SELECT structure_id, avg(plddt) AS mean_plddt FROM (
            SELECT structure_id, resseq, max_by(bfactor, chain) AS plddt FROM v_atoms
            WHERE atom_name = 'CA' AND NOT is_het GROUP BY ALL) GROUP BY structure_id)
        WHERE coalesce(mean_plddt, 0) >= 74""",
        "v_atoms",
    ),
)
def catalog_confidence_gate(spark, sf):
    catalog = features.mean_plddt(domain.atoms(spark, sf))
    return filters.catalog_by_confidence(catalog, 74.0).select("structure_id", F.round("mean_plddt", 6).alias("mean_plddt"))


@query(
    "study_gate",
    oracle(
        """SELECT organism, n_candidates, n_total, round(100.0 * n_candidates / n_total, 6) AS percent FROM (
          SELECT return_class AS organism, count(*) FILTER (WHERE composite_score >= 0.7::DOUBLE AND plddt_confidence >= 70)
            AS n_candidates, count(*) AS n_total FROM v_scored_rows GROUP BY return_class)""",
        "v_scored_rows",
    ),
)
def study_gate(spark, sf):
    gated = filters.study_gate(scored_rows(spark, sf).withColumnRenamed("return_class", "organism"))
    return gated.select("organism", "n_candidates", "n_total", F.round("percent", 6).alias("percent"))


@query(
    "fault_isolation",
    oracle(
        """SELECT CASE WHEN pocket_id % 13 = 0 THEN 'unreadable volume' END AS error, count(*) AS n,
             round(sum(CASE WHEN pocket_id % 13 != 0 THEN volume END), 4) AS volume FROM v_pocket_rows GROUP BY ALL""",
        "v_pocket_rows",
    ),
)
def fault_isolation(spark, sf):
    text = F.when(F.col("pocket_id") % 13 == 0, F.lit("n/a")).otherwise(F.col("volume").cast("string"))
    rows = domain.pocket_rows(spark, sf).select("pocket_id", text.try_cast("double").alias("volume"))
    good, bad = filters.quarantine(rows, F.when(F.col("volume").isNull(), "unreadable volume"))
    merged = good.withColumn("error", F.lit(None).cast("string")).unionByName(bad)
    return merged.groupBy("error").agg(F.count("*").alias("n"), F.round(F.sum("volume"), 4).alias("volume"))


@query(
    "rank_within_structure",
    oracle(
        f"""SELECT {_ROW}, row_number() OVER (PARTITION BY structure_id ORDER BY v_scored.composite_score DESC, pocket_id)
              AS rank, {class_sql("v_scored.composite_score")} AS classification FROM v_scored""",
        "v_scored",
    ),
)
def rank_within_structure(spark, sf):
    ranked = filters.with_rank(scored(spark, sf).select("structure_id", "pocket_id", "composite_score"), partition=["structure_id"])
    return ranked.withColumn("composite_score", F.round("composite_score", 8))


@query(
    "rank_global",
    oracle(
        """SELECT structure_id, pocket_id,
             row_number() OVER (ORDER BY composite_score DESC, structure_id, pocket_id) AS rank FROM v_scored""",
        "v_scored",
    ),
)
def rank_global(spark, sf):
    rows = scored(spark, sf).select("structure_id", "pocket_id", "composite_score")
    return filters.with_rank(rows).select("structure_id", "pocket_id", "rank")


@query(
    "top_candidates",
    oracle(
        f"""SELECT {_ROW}, row_number() OVER (ORDER BY v_scored.composite_score DESC, structure_id, pocket_id) AS rank,
              {class_sql("v_scored.composite_score")} AS classification FROM v_scored
            QUALIFY rank <= 50""",
        "v_scored",
    ),
)
def top_candidates(spark, sf):
    rows = scored(spark, sf).select("structure_id", "pocket_id", "composite_score")
    return filters.top_candidates(rows).withColumn("composite_score", F.round("composite_score", 8))


@query(
    "deterministic_order",
    oracle(
        """SELECT structure_id, pocket_id, round(composite_score, 8) AS composite_score FROM v_scored
           ORDER BY v_scored.composite_score DESC, structure_id, pocket_id""",
        "v_scored",
    ),
)
def deterministic_order(spark, sf):
    rows = scored(spark, sf).select("structure_id", "pocket_id", "composite_score")
    ordered = reports.deterministic_order(rows, [("composite_score", False), ("structure_id", True), ("pocket_id", True)])
    return _brief(ordered)


@query(
    "top_for_dynamics",
    oracle(
        """SELECT candidate_id, round(composite_score, 8) AS composite_score FROM (
          SELECT pocket_id AS candidate_id, structure_id, composite_score FROM v_scored
          ORDER BY composite_score DESC, pocket_id, structure_id LIMIT 20)""",
        "v_scored",
    ),
)
def top_for_dynamics(spark, sf):
    rows = scored(spark, sf).select(F.col("pocket_id").alias("candidate_id"), "structure_id", "composite_score")
    return filters.top_for_dynamics(rows, 20, ["candidate_id", "structure_id"]).select(
        "candidate_id", F.round("composite_score", 8).alias("composite_score")
    )


@query("head_catalog", "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 25")
def head_catalog(spark, sf):
    return domain.table(spark, sf, "pages").select("page_id", "url").orderBy("page_id").limit(25)


@query(
    "concatenated_results",
    oracle(
        """SELECT structure_id, pocket_id, volume, NULL::DOUBLE AS depth FROM v_pocket_rows WHERE return_class = 'A'
           UNION ALL
           SELECT structure_id, pocket_id, NULL, depth FROM v_pocket_rows WHERE return_class != 'A'""",
        "v_pocket_rows",
    ),
)
def concatenated_results(spark, sf):
    rows = domain.pocket_rows(spark, sf)
    first = rows.where("return_class = 'A'").select("structure_id", "pocket_id", "volume")
    second = rows.where("return_class != 'A'").select("structure_id", "pocket_id", "depth")
    return reports.concatenated([first, second])


@query("distinct_ids", oracle("SELECT DISTINCT structure_id FROM v_pocket_rows ORDER BY 1", "v_pocket_rows"))
def distinct_ids(spark, sf):
    return domain.pocket_rows(spark, sf).select("structure_id").distinct().orderBy("structure_id")


@query(
    "one_row_per_structure",
    """SELECT upper(c_mktsegment) AS pdb_id, min(c_custkey) AS seq FROM customer GROUP BY upper(c_mktsegment)""",
)
def one_row_per_structure(spark, sf):
    rows = domain.table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("pdb_id"),
        F.col("c_custkey").alias("seq"),
    )
    return matching.one_row_per_structure(rows)


@query(
    "structure_file_predicate",
    """SELECT regexp_matches(lower(p), '\\.(pdb|cif|ent)$') AS supported, count(*) AS n FROM (
      SELECT url || CASE page_id % 4 WHEN 0 THEN '.pdb' WHEN 1 THEN '.CIF' WHEN 2 THEN '.ent' ELSE '.txt' END AS p
      FROM pages) GROUP BY ALL""",
)
def structure_file_predicate(spark, sf):
    from ..functions.values import supported_structure

    suffix = F.element_at(F.array(*[F.lit(s) for s in (".pdb", ".CIF", ".ent", ".txt")]), (F.col("page_id") % 4 + 1).cast("int"))
    rows = domain.table(spark, sf, "pages").select(F.concat("url", suffix).alias("p"))
    return rows.groupBy(supported_structure("p").alias("supported")).agg(F.count("*").alias("n"))
