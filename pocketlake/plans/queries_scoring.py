"""Registered queries: scores, classes, control rules, value parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import controls, scoring, values
from ..operators import comparative, reports
from . import domain
from .oracle_views import (
    BASIC_SQL,
    DEPTH_SQL,
    POTENTIAL_SQL,
    SASA_SQL,
    VOLUME_SQL,
    class_sql,
    composite_sql,
    oracle,
)
from .registry import query
from .screen import screen_top


@query(
    "screen_top3_per_structure",
    oracle(
        f"""SELECT structure_id, pocket_id, round(composite_score, 8) AS composite_score, rank,
                   {class_sql()} AS classification
            FROM (SELECT *, row_number() OVER (PARTITION BY structure_id
                    ORDER BY composite_score DESC, pocket_id) AS rank
                  FROM v_scored WHERE basic_residues >= 4 AND sasa <= 10 AND volume BETWEEN 300 AND 800)
            WHERE rank <= 3""",
        "v_scored",
    ),
)
def screen_top3_per_structure(spark, sf):
    return screen_top(domain.pockets(spark, sf)).select(
        "structure_id", "pocket_id", F.round("composite_score", 8).alias("composite_score"), "rank", "classification"
    )


@query(
    "score_components",
    oracle(
        f"""SELECT structure_id, pocket_id, round({VOLUME_SQL}, 8) AS volume_score, round({DEPTH_SQL}, 8) AS depth_score,
                   round({SASA_SQL}, 8) AS sasa_score, CAST({BASIC_SQL} AS DOUBLE) AS basic_score,
                   CAST({POTENTIAL_SQL} AS DOUBLE) AS potential_score
            FROM v_pocket_rows""",
        "v_pocket_rows",
    ),
)
def score_components(spark, sf):
    return domain.pocket_rows(spark, sf).select(
        "structure_id",
        "pocket_id",
        F.round(scoring.volume_score("volume"), 8).alias("volume_score"),
        F.round(scoring.depth_score("depth"), 8).alias("depth_score"),
        F.round(scoring.sasa_score("sasa"), 8).alias("sasa_score"),
        scoring.basic_residue_score("basic_residues").alias("basic_score"),
        scoring.potential_score("electrostatic_potential").alias("potential_score"),
    )


@query(
    "composite_score",
    oracle(
        "SELECT structure_id, pocket_id, round(composite_score, 8) AS composite_score FROM v_scored_rows",
        "v_scored_rows",
    ),
)
def composite(spark, sf):
    return domain.pocket_rows(spark, sf).select(
        "structure_id", "pocket_id", F.round(scoring.composite_score(), 8).alias("composite_score")
    )


_OTHER_WEIGHTS = {"volume": 0.2, "depth": 0.2, "sasa": 0.2, "basic_residues": 0.2, "electrostatics": 0.2}


@query(
    "weight_and_threshold_overrides",
    oracle(
        f"""SELECT structure_id, pocket_id, round(s, 8) AS composite_score FROM (
              SELECT *, {composite_sql(.2, .2, .2, .2, .2)} AS s FROM v_pocket_rows) WHERE s >= 0.7::DOUBLE
              AND basic_residues >= 3 AND sasa <= 20 AND volume BETWEEN 200 AND 900""",
        "v_pocket_rows",
    ),
)
def weight_and_threshold_overrides(spark, sf):
    from ..operators.filters import by_criteria, by_score

    rows = by_criteria(domain.pocket_rows(spark, sf), 3, 20.0, 200, 900)
    kept = by_score(rows.withColumn("composite_score", scoring.composite_score(_OTHER_WEIGHTS)), 0.7)
    return kept.select("structure_id", "pocket_id", F.round("composite_score", 8).alias("composite_score"))


@query(
    "classify_hist",
    oracle(
        f"""SELECT {class_sql()} AS rule_class, {class_sql(cuts=(0.8, 0.6, 0.4))} AS model_class, count(*) AS n
            FROM v_scored_rows GROUP BY ALL""",
        "v_scored_rows",
    ),
)
def classify_hist(spark, sf):
    scored = domain.pocket_rows(spark, sf).withColumn("composite_score", scoring.composite_score())
    return scored.groupBy(
        scoring.rule_class("composite_score").alias("rule_class"),
        scoring.model_class("composite_score").alias("model_class"),
    ).agg(F.count("*").alias("n"))


_BURIAL = "(CASE WHEN sasa <= 5 THEN 1.0 WHEN sasa >= 50 THEN 0.0 ELSE (50 - sasa) / 45 END)"
_ELEC = """(CASE WHEN electrostatic_potential IS NULL THEN 0.5
  ELSE greatest(0.0, least(1.0, (electrostatic_potential + 2.0) / 12.0)) END)"""


@query(
    "control_components",
    oracle(
        f"""SELECT structure_id, pocket_id, round({_BURIAL}, 8) AS burial, round({_ELEC}, 8) AS electrostatic
            FROM v_pocket_rows""",
        "v_pocket_rows",
    ),
)
def control_components(spark, sf):
    return domain.pocket_rows(spark, sf).select(
        "structure_id",
        "pocket_id",
        F.round(controls.burial_component("sasa"), 8).alias("burial"),
        F.round(controls.electrostatic_component("electrostatic_potential"), 8).alias("electrostatic"),
    )


# Control rows from pockets: a fifth has no ligand area, and areas reach beyond 100.
_CONTROLS = f"""SELECT *, CASE WHEN basic_residues = 5 THEN NULL ELSE depth * 6 END AS ligand_sasa,
    CASE WHEN return_class = 'A' THEN 'positive' ELSE 'negative' END AS control_type,
    basic_residues % 2 + 1 AS tier, return_class = 'R' AS decoy,
    CASE WHEN sasa < 20 THEN 'cryptic' WHEN sasa < 35 THEN 'semi_cryptic' ELSE 'crystal_artifact' END AS burial_class
  FROM v_scored_rows"""
_LIKELY = """(CASE WHEN ligand_sasa IS NULL THEN composite_score
  ELSE 0.55 * (CASE WHEN ligand_sasa <= 5 THEN 1.0 WHEN ligand_sasa >= 50 THEN 0.0 ELSE (50 - ligand_sasa) / 45 END)
    + 0.35 * composite_score END)"""


def half_up(sql):
    """Rounding by plain arithmetic: the engines' own round() disagrees on decimal ties."""
    return f"floor({sql} * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"


def _half_up(column):
    return F.floor(column * 1e6 + 0.5) / 1e6


def control_rows(spark, sf):
    rows = domain.pocket_rows(spark, sf).withColumn("composite_score", scoring.composite_score())
    return rows.select(
        "*",
        F.when(F.col("basic_residues") != 5, F.col("depth") * 6).alias("ligand_sasa"),
        F.when(F.col("return_class") == "A", "positive").otherwise("negative").alias("control_type"),
        (F.col("basic_residues") % 2 + 1).alias("tier"),
        (F.col("return_class") == "R").alias("decoy"),
        F.when(F.col("sasa") < 20, "cryptic")
        .when(F.col("sasa") < 35, "semi_cryptic")
        .otherwise("crystal_artifact")
        .alias("burial_class"),
    )


@query(
    "cryptic_likeness",
    oracle(
        f"""WITH c AS ({_CONTROLS})
        SELECT structure_id, pocket_id, {half_up(_LIKELY)} AS score,
          {half_up(f"(CASE WHEN ligand_sasa IS NULL THEN composite_score ELSE 0.75 * {_LIKELY} + 0.25 * {_ELEC} END)")}
            AS score_with_potential FROM c""",
        "v_scored_rows",
    ),
)
def cryptic_likeness(spark, sf):
    return control_rows(spark, sf).select(
        "structure_id",
        "pocket_id",
        _half_up(controls.cryptic_likeness("composite_score", "ligand_sasa")).alias("score"),
        _half_up(controls.cryptic_likeness("composite_score", "ligand_sasa", "electrostatic_potential")).alias(
            "score_with_potential"
        ),
    )


_POSITIVE = """CASE WHEN burial_class = 'crystal_artifact' THEN false
  WHEN burial_class = 'semi_cryptic' THEN coalesce(ligand_sasa >= 10 AND ligand_sasa < 50 AND basic_residues >= 4
    AND composite_score >= 0.45 AND score >= 0.40, false)
  WHEN ligand_sasa IS NOT NULL THEN ligand_sasa < 10 AND basic_residues >= 4 AND composite_score >= 0.50
    AND score >= 0.55
  ELSE basic_residues >= 3 AND score >= 0.55 END"""
_NEGATIVE = """CASE WHEN ligand_sasa >= 50 THEN score <= (CASE WHEN decoy THEN 0.55 ELSE 0.45 END)
  WHEN ligand_sasa >= 20 THEN score <= 0.65
  WHEN ligand_sasa IS NOT NULL THEN score <= (CASE WHEN decoy THEN 0.55 ELSE 0.45 END) AND composite_score < 0.55
  ELSE score <= (CASE WHEN decoy THEN 0.55 ELSE 0.45 END) END"""
_SCORED_CONTROLS = f"c AS ({_CONTROLS}), s AS (SELECT *, {_LIKELY} AS score FROM c)"


def _judged(spark, sf):
    rows = control_rows(spark, sf).withColumn("score", controls.cryptic_likeness("composite_score", "ligand_sasa"))
    return rows.select(
        "*",
        controls.positive_passed("score", "ligand_sasa", "basic_residues", "composite_score", "burial_class").alias("as_positive"),
        controls.negative_passed("score", "ligand_sasa", "composite_score", "decoy").alias("as_negative"),
    )


@query(
    "control_pass_rules",
    oracle(
        f"""WITH {_SCORED_CONTROLS}
        SELECT structure_id, pocket_id, {_POSITIVE} AS as_positive, {_NEGATIVE} AS as_negative FROM s""",
        "v_scored_rows",
    ),
)
def control_pass_rules(spark, sf):
    return _judged(spark, sf).select("structure_id", "pocket_id", "as_positive", "as_negative")


@query(
    "control_separation",
    oracle(
        f"""WITH {_SCORED_CONTROLS},
        p AS (SELECT *, CASE WHEN control_type = 'positive' THEN {_POSITIVE} ELSE {_NEGATIVE} END AS passed FROM s),
        a AS (SELECT avg(score) FILTER (WHERE control_type = 'positive' AND burial_class != 'crystal_artifact') AS pm,
            avg(score) FILTER (WHERE control_type = 'negative') AS nm,
            avg(score) FILTER (WHERE control_type = 'positive' AND tier = 1) AS tp,
            avg(score) FILTER (WHERE control_type = 'negative' AND tier = 1) AS tn,
            bool_and(passed) FILTER (WHERE tier = 1) AS tpass,
            bool_and(passed) FILTER (WHERE control_type = 'positive' AND burial_class != 'crystal_artifact') AS allp,
            bool_and(passed) FILTER (WHERE control_type = 'negative') AS alln FROM p)
        SELECT round(pm, 6) AS positive_mean, round(nm, 6) AS negative_mean, round(pm - nm, 6) AS separation,
          round(tp - tn, 6) AS tier1_separation, pm - nm > 0.30 AS clear_separation,
          tp - tn > 0.50 AND tpass AS tier1_gate_passed, allp AS all_positive_passed, alln AS all_negative_passed
        FROM a""",
        "v_scored_rows",
    ),
)
def control_separation(spark, sf):
    passed = F.when(F.col("control_type") == "positive", F.col("as_positive")).otherwise(F.col("as_negative"))
    row = reports.separation_quality(_judged(spark, sf).withColumn("passed", passed))
    rounded = ("positive_mean", "negative_mean", "separation", "tier1_separation")
    return row.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in row.columns])


@query(
    "control_spread",
    oracle(
        f"""WITH c AS ({_CONTROLS})
        SELECT round(avg(composite_score) FILTER (WHERE control_type = 'positive'), 6) AS positive_mean,
          round(stddev_samp(composite_score) FILTER (WHERE control_type = 'positive'), 6) AS positive_sd,
          round(avg(composite_score) FILTER (WHERE control_type = 'negative'), 6) AS negative_mean,
          round(stddev_samp(composite_score) FILTER (WHERE control_type = 'negative'), 6) AS negative_sd,
          round(avg(composite_score) FILTER (WHERE control_type = 'positive')
            - avg(composite_score) FILTER (WHERE control_type = 'negative'), 6) AS separation FROM c""",
        "v_scored_rows",
    ),
)
def control_spread(spark, sf):
    row = reports.control_spread(control_rows(spark, sf).withColumnRenamed("control_type", "expected"))
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


@query(
    "burial_classes",
    oracle(
        f"""WITH c AS ({_CONTROLS})
        SELECT CASE WHEN m IS NULL THEN 'unknown' WHEN m <= 5 THEN 'cryptic' WHEN m <= 50 THEN 'semi_cryptic'
                    ELSE 'surface' END AS burial,
          CASE WHEN sasa < 5 THEN 'Cryptic' WHEN sasa <= 20 THEN 'Semi-cryptic' ELSE 'Surface' END AS dataset_class,
          CASE WHEN control_type = 'positive' AND ligand_sasa > 100 THEN 'crystal_artifact' ELSE burial_class END
            AS overridden, count(*) AS n
        FROM (SELECT *, coalesce(CASE WHEN tier = 1 THEN electrostatic_potential END, ligand_sasa) AS m FROM c)
        GROUP BY ALL""",
        "v_scored_rows",
    ),
)
def burial_classes(spark, sf):
    rows = control_rows(spark, sf).withColumn("phosphate", F.when(F.col("tier") == 1, F.col("electrostatic_potential")))
    return rows.groupBy(
        controls.burial_class("ligand_sasa", "phosphate").alias("burial"),
        controls.dataset_class("sasa").alias("dataset_class"),
        controls.artifact_override("control_type", "ligand_sasa", "burial_class").alias("overridden"),
    ).agg(F.count("*").alias("n"))


@query(
    "pocket_stability",
    oracle(
        """SELECT CASE WHEN b >= 2 THEN 'stably buried' WHEN e >= 2 THEN 'exposed' ELSE 'transiently accessible' END
             AS classification, count(*) AS n FROM (
           SELECT (s <= 1.0)::INT + (r <= 0.20)::INT + (w <= 1.0)::INT AS b,
                  (s >= 5.0)::INT + (r >= 0.45)::INT + (w >= 5.0)::INT AS e
           FROM (SELECT sasa / 5 AS s, depth / 30 AS r, basic_residues::DOUBLE AS w FROM v_pocket_rows))
           GROUP BY ALL""",
        "v_pocket_rows",
    ),
)
def pocket_stability(spark, sf):
    rows = domain.pocket_rows(spark, sf)
    kind = controls.pocket_stability(F.col("sasa") / 5, F.col("depth") / 30, F.col("basic_residues").cast("double"))
    return rows.groupBy(kind.alias("classification")).agg(F.count("*").alias("n"))


@query(
    "parse_residue_lists",
    oracle(
        """SELECT structure_id, pocket_id, len(ids) AS n_residues, list_sum(ids)::BIGINT AS sum_residues, x, y, z FROM (
          SELECT structure_id, pocket_id, [basic_residues, basic_residues + 1, CAST(sasa AS INTEGER)] AS ids,
            CAST(basic_residues AS DOUBLE) AS x, CAST(CAST(sasa AS INTEGER) AS DOUBLE) AS y, 0.5::DOUBLE AS z
          FROM v_pocket_rows)""",
        "v_pocket_rows",
    ),
)
def parse_residue_lists(spark, sf):
    whole = F.col("sasa").cast("int").cast("string")
    n = F.col("basic_residues")
    rows = domain.pocket_rows(spark, sf).select(
        "structure_id",
        "pocket_id",
        F.concat_ws(" , ", n.cast("string"), (n + 1).cast("string"), whole, F.lit("")).alias("listed"),
        F.concat_ws(",", n.cast("string"), whole, F.lit(" 0.5")).alias("spot"),
    )
    ids = values.residue_list("listed")
    return rows.select(
        "structure_id",
        "pocket_id",
        F.size(ids).cast("long").alias("n_residues"),
        F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_residues"),
        values.center("spot")["x"].alias("x"),
        values.center("spot")["y"].alias("y"),
        values.center("spot")["z"].alias("z"),
    )


@query(
    "to_boolean",
    oracle("SELECT organism, is_hit = 'yes' AS is_hit, count(*) AS n FROM v_hits GROUP BY ALL", "v_hits"),
)
def to_boolean(spark, sf):
    rows = domain.hits(spark, sf).withColumn("is_hit", values.to_boolean(F.upper("is_hit")))
    return rows.groupBy("organism", "is_hit").agg(F.count("*").alias("n"))


@query(
    "atom_vocabularies",
    oracle(
        """SELECT resname, resname = 'IHP' AS is_ligand, resname IN ('ARG', 'LYS', 'HIS') AS is_basic,
             atom_name = 'O1' AS is_phosphate, count(*) AS n FROM v_atoms GROUP BY ALL""",
        "v_atoms",
    ),
)
def atom_vocabularies(spark, sf):
    return domain.atoms(spark, sf).groupBy(
        "resname",
        values.is_ligand("resname").alias("is_ligand"),
        values.is_basic("resname").alias("is_basic"),
        values.is_phosphate_atom("atom_name").alias("is_phosphate"),
    ).agg(F.count("*").alias("n"))


@query(
    "protonation",
    oracle(
        "SELECT residue_number, round(1.0 / (1.0 + 10.0 ** (7.4 - pka)), 8) AS fraction FROM v_pka",
        "v_pka",
    ),
)
def protonation(spark, sf):
    return domain.pka_rows(spark, sf).select("residue_number", F.round(values.protonation(7.4, "pka"), 8).alias("fraction"))


@query(
    "surrogate_features",
    oracle(
        """SELECT pdb_id, 20.0 - least(sasa, 20.0) AS pocket_depth, round(8.0 - 0.1 * sasa, 8) AS electrostatic_potential,
          round_even(greatest(8.0::DOUBLE - 0.2::DOUBLE * sasa, 1.0), 0) AS n_basic_residues,
          600.0 - 3.5 * sasa AS pocket_volume, 85.0::DOUBLE AS plddt_confidence,
          CASE WHEN classification IN ('Cryptic', 'Semi-cryptic') THEN 1 ELSE 0 END AS label FROM v_dataset""",
        "v_dataset",
    ),
)
def surrogate_features(spark, sf):
    rows = domain.dataset(spark, sf)
    stand_ins = scoring.surrogate_features(rows.columns)
    stand_ins.pop("sasa")
    stand_ins["electrostatic_potential"] = F.round(stand_ins["electrostatic_potential"], 8)
    return rows.select(
        "pdb_id", *[expr.alias(name) for name, expr in stand_ins.items()], scoring.class_label("classification").alias("label")
    )


@query(
    "params_fingerprint",
    oracle(
        """SELECT return_class, sha256('{"max_sasa": 10.0, "min_score": 0.6}') AS run_hash,
          sha256('{"class":"' || return_class || '","n":"' || count(*) || '"}') AS row_hash
        FROM v_pocket_rows GROUP BY return_class""",
        "v_pocket_rows",
    ),
)
def params_fingerprint(spark, sf):
    counts = domain.pocket_rows(spark, sf).groupBy("return_class").agg(F.count("*").alias("n"))
    params = F.create_map(F.lit("n"), F.col("n").cast("string"), F.lit("class"), F.col("return_class"))
    return counts.select(
        "return_class",
        values.params_fingerprint({"min_score": 0.6, "max_sasa": 10.0}).alias("run_hash"),
        values.map_fingerprint(params).alias("row_hash"),
    )


@query(
    "missing_residue_numbers",
    oracle(
        """SELECT structure_id, (max(resseq) - min(resseq) + 1 - count(DISTINCT resseq))::BIGINT AS missing_residues
           FROM v_atoms WHERE NOT is_het GROUP BY structure_id""",
        "v_atoms",
    ),
)
def missing_residue_numbers(spark, sf):
    return domain.atoms(spark, sf).where("NOT is_het").groupBy("structure_id").agg(
        values.missing_residue_count("resseq").alias("missing_residues")
    )


_METRICS = ("composite_score", "depth", "sasa", "electrostatic_potential", "basic_residues")


@query(
    "organism_metrics_normalised",
    oracle(
        """WITH m AS (SELECT return_class AS organism, """
        + ", ".join(f"avg({m}) AS {m}" for m in _METRICS)
        + " FROM v_scored_rows GROUP BY return_class) SELECT organism, "
        + ", ".join(
            f"round(({m} - min({m}) OVER ()) / nullif(max({m}) OVER () - min({m}) OVER (), 0), 5) AS {m}" for m in _METRICS
        )
        + " FROM m",
        "v_scored_rows",
    ),
)
def organism_metrics_normalised(spark, sf):
    rows = domain.pocket_rows(spark, sf).withColumn("composite_score", scoring.composite_score())
    means = reports.mean_by_organism(rows.withColumnRenamed("return_class", "organism"), _METRICS)
    scaled = comparative.min_max_normalised(means, _METRICS)
    return scaled.select("organism", *[F.round(m, 5).alias(m) for m in _METRICS])
