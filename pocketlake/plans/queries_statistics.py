"""Registered queries: curves, tests on groups, multiple testing, quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import composite_score
from ..operators import curves, quality, resampling, testing
from . import domain
from .oracle_views import betainc_sql, oracle
from .queries_comparative import rounded
from .registry import query


@query(
    "running_counts",
    oracle("SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp FROM v_curve", "v_curve"),
)
def running_counts(spark, sf):
    return curves.score_curve(domain.scored_labels(spark, sf)).select("score", "tp", "fp")


@query(
    "roc_points",
    oracle(
        """SELECT score AS threshold, round(fp / tot_neg, 6) AS fpr, round(tp / tot_pos, 6) AS tpr FROM v_curve
           UNION ALL SELECT NULL, 0.0, 0.0""",
        "v_curve",
    ),
)
def roc_points(spark, sf):
    return rounded(curves.roc_points(curves.score_curve(domain.scored_labels(spark, sf))), "fpr", "tpr")


@query(
    "pr_points",
    oracle(
        """SELECT score AS threshold, round(tp / tot_pos, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM v_curve
           UNION ALL SELECT NULL, 0.0, 1.0
           UNION ALL SELECT NULL, 1.0, round(max(tot_pos) / (max(tot_pos) + max(tot_neg)), 6) FROM v_curve""",
        "v_curve",
    ),
)
def pr_points(spark, sf):
    return rounded(curves.pr_points(curves.score_curve(domain.scored_labels(spark, sf))), "recall", "precision")


@query(
    "curve_areas",
    oracle(
        """WITH p AS (SELECT score, fp / tot_neg AS x, tp / tot_pos AS y, tp / (tp + fp) AS pr FROM v_curve),
        l AS (SELECT *, lag(x, 1, 0) OVER w AS x0, lag(y, 1, 0) OVER w AS y0, lag(pr, 1, 1) OVER w AS pr0 FROM p
              WINDOW w AS (ORDER BY score DESC))
        SELECT round(sum((x - x0) * (y + y0) / 2), 6) AS roc_auc, round(sum((y - y0) * (pr + pr0) / 2), 6) AS pr_auc_trapz,
          round(sum((y - y0) * pr), 6) AS average_precision FROM l""",
        "v_curve",
    ),
)
def curve_areas(spark, sf):
    areas = curves.curve_areas(curves.score_curve(domain.scored_labels(spark, sf)))
    return rounded(areas, "roc_auc", "pr_auc_trapz", "average_precision")


@query(
    "curve_areas_by_group",
    oracle(
        """WITH g AS (SELECT return_class AS grp, volume AS score, sum((depth > 10)::INT) AS p, sum((depth <= 10)::INT) AS n
          FROM v_pocket_rows GROUP BY ALL),
        r AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY grp) AS pp,
            sum(n) OVER (PARTITION BY grp) AS nn FROM g WINDOW w AS (PARTITION BY grp ORDER BY score DESC))
        SELECT grp, round(sum((n / nn) * ((tp - p) + tp) / pp / 2), 6) AS roc_auc FROM r GROUP BY grp""",
        "v_pocket_rows",
    ),
)
def curve_areas_by_group(spark, sf):
    rows = domain.pocket_rows(spark, sf).select(
        F.col("return_class").alias("grp"), F.col("volume").alias("score"), (F.col("depth") > 10).cast("int").alias("y")
    )
    areas = curves.curve_areas(curves.score_curve(rows, partition=["grp"]), ["grp"])
    return rounded(areas.select("grp", "roc_auc"), "roc_auc")


@query(
    "mcc",
    oracle(
        """WITH c AS (SELECT grp, count(*) FILTER (WHERE score >= 0.5 AND y = 1)::DOUBLE AS tp,
            count(*) FILTER (WHERE score >= 0.5 AND y = 0)::DOUBLE AS fp, count(*) FILTER (WHERE score < 0.5 AND y = 1)::DOUBLE AS fn,
            count(*) FILTER (WHERE score < 0.5 AND y = 0)::DOUBLE AS tn FROM v_scored_labels GROUP BY grp)
        SELECT grp, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0
          ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc FROM c""",
        "v_scored_labels",
    ),
)
def mcc(spark, sf):
    return rounded(curves.mcc(domain.scored_labels(spark, sf), partition=["grp"]), "mcc")


_INTERPOLATED = """p AS (SELECT grp, x, y, s FROM (
      SELECT l_returnflag AS grp, l_discount * 10 AS x, avg(l_quantity) / 50 AS y, l_linenumber AS s
      FROM lineitem GROUP BY l_returnflag, l_discount, l_linenumber)),
  n AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY grp ORDER BY x, s)),
  g AS (SELECT k AS grid_index, k / 40 AS gx FROM range(41) t(k))"""


def _profile(spark, sf):
    li = domain.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("grp"), F.col("l_discount"), F.col("l_linenumber").alias("s")).agg(
        (F.avg("l_quantity") / 50).alias("y")
    ).select("grp", (F.col("l_discount") * 10).alias("x"), "y", "s")


@query(
    "interpolate_on_grid",
    f"""WITH {_INTERPOLATED}
    SELECT grp, grid_index, round(gx, 6) AS grid_x, round(max_by(CASE WHEN x1 IS NULL THEN y
        WHEN x1 = x THEN y ELSE y + (y1 - y) * (gx - x) / (x1 - x) END, (x, s)), 6) AS grid_y
    FROM n JOIN g ON x <= gx + 1e-12 GROUP BY grp, grid_index, gx""",
)
def interpolate_on_grid(spark, sf):
    grid = curves.interpolate_on_grid(_profile(spark, sf), "x", "y", "s", 41, ["grp"])
    return rounded(grid, "grid_x", "grid_y")


@query(
    "trapezoid_area",
    f"""WITH {_INTERPOLATED}
    SELECT grp, round(sum((x1 - x) * (y + y1) / 2), 6) AS area FROM n WHERE x1 IS NOT NULL GROUP BY grp""",
)
def trapezoid_area(spark, sf):
    return rounded(curves.trapezoid_area(_profile(spark, sf), "x", "y", "s", ["grp"]), "area")


@query(
    "fdr_bh",
    oracle(
        """WITH t AS (SELECT structure_id, pocket_id, power((volume % 100) / 100, 6) AS p FROM v_pockets),
        r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM t),
        q AS (SELECT *, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q,
            max(CASE WHEN p <= k / m * 0.05 THEN k END) OVER () AS last FROM r)
        SELECT structure_id, pocket_id, round(p, 6) AS p_value, round(least(1.0, q), 6) AS fdr_q_value,
          coalesce(k <= last, false) AS reject FROM q""",
        "v_pockets",
    ),
)
def fdr_bh(spark, sf):
    rows = domain.pockets(spark, sf).select(
        "structure_id", "pocket_id", F.pow(F.col("volume") % 100 / 100, F.lit(6.0)).alias("p_value")
    )
    return rounded(testing.benjamini_hochberg(rows), "p_value", "fdr_q_value")


@query(
    "average_ranks",
    oracle(
        """SELECT row_id, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS avg_rank
           FROM v_scored_labels""",
        "v_scored_labels",
    ),
)
def average_ranks(spark, sf):
    return testing.ranks_with_ties(domain.scored_labels(spark, sf).select("row_id", "score"), "score")


@query(
    "empirical_cdf",
    oracle(
        """SELECT return_class, volume, count(*) AS n_rows, round(any_value(cd), 6) AS cume_dist FROM (
          SELECT return_class, volume, cume_dist() OVER (PARTITION BY return_class ORDER BY volume) AS cd FROM v_pocket_rows)
        GROUP BY ALL""",
        "v_pocket_rows",
    ),
)
def empirical_cdf(spark, sf):
    return rounded(testing.empirical_cdf(domain.pocket_rows(spark, sf), "volume", "return_class"), "cume_dist")


@query(
    "cohens_d",
    oracle(
        """SELECT na AS n_a, nb AS n_b, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohens_d
        FROM (SELECT count(sasa) FILTER (WHERE depth > 10) AS na, count(sasa) FILTER (WHERE NOT depth > 10) AS nb,
          avg(sasa) FILTER (WHERE depth > 10) AS ma, avg(sasa) FILTER (WHERE NOT depth > 10) AS mb,
          var_samp(sasa) FILTER (WHERE depth > 10) AS va, var_samp(sasa) FILTER (WHERE NOT depth > 10) AS vb
          FROM v_pocket_rows)""",
        "v_pocket_rows",
    ),
)
def cohens_d(spark, sf):
    return rounded(testing.cohens_d(domain.pocket_rows(spark, sf), "sasa", F.col("depth") > 10), "cohens_d")


_T_MOMENTS = """m AS (SELECT count(*) FILTER (WHERE y = 1)::DOUBLE AS na, count(*) FILTER (WHERE y = 0)::DOUBLE AS nb,
    avg(score) FILTER (WHERE y = 1) AS ma, avg(score) FILTER (WHERE y = 0) AS mb,
    var_samp(score) FILTER (WHERE y = 1) AS va, var_samp(score) FILTER (WHERE y = 0) AS vb FROM v_scored_labels),
  t AS (SELECT *, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)) AS st,
      (ma - mb) / sqrt(va / na + vb / nb) AS wt,
      (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) AS wd FROM m)"""


@query(
    "t_tests",
    oracle(
        f"""WITH {_T_MOMENTS}
        SELECT round(st, 6) AS student_t, na + nb - 2 AS student_dof, round(wt, 6) AS welch_t, round(wd, 4) AS welch_dof,
          round(1 - {betainc_sql('0.5', '((na + nb - 2) / 2)', '(st * st / (na + nb - 2 + st * st))')}, 6) AS student_p,
          round(1 - {betainc_sql('0.5', '(wd / 2)', '(wt * wt / (wd + wt * wt))')}, 6) AS welch_p FROM t""",
        "v_scored_labels",
    ),
)
def t_tests(spark, sf):
    row = testing.t_tests(domain.scored_labels(spark, sf), "score", F.col("y") == 1)
    kept = row.select("student_t", "student_dof", "welch_t", F.round("welch_dof", 4).alias("welch_dof"), "student_p", "welch_p")
    return rounded(kept, "student_t", "welch_t", "student_p", "welch_p")


_LEVENE = """z AS (SELECT y, abs(score - median(score) OVER (PARTITION BY y)) AS z FROM v_scored_labels),
  c AS (SELECT y, count(*)::DOUBLE AS n, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY y),
  w AS (SELECT count(*)::DOUBLE AS k, sum(n) AS nn,
      (sum(n) - count(*)) * (sum(n * m * m) - sum(n * m) ** 2 / sum(n)) / ((count(*) - 1) * sum(n * v)) AS w FROM c)"""


@query(
    "levene",
    oracle(
        f"""WITH {_LEVENE}
        SELECT round(w, 6) AS levene_w, k - 1 AS dof_between, nn - k AS dof_within,
          round(1 - {betainc_sql('((k - 1) / 2)', '((nn - k) / 2)', '((k - 1) * w / (nn - k + (k - 1) * w))')}, 6) AS levene_p
        FROM w""",
        "v_scored_labels",
    ),
)
def levene(spark, sf):
    return rounded(testing.levene(domain.scored_labels(spark, sf), "score", "y"), "levene_w", "levene_p")


@query(
    "levene_chosen_t_test",
    oracle(
        f"""WITH {_LEVENE}, {_T_MOMENTS},
        p AS (SELECT 1 - {betainc_sql('((k - 1) / 2)', '((nn - k) / 2)', '((k - 1) * w / (nn - k + (k - 1) * w))')} AS lp FROM w)
        SELECT round(CASE WHEN lp >= 0.05 THEN st ELSE wt END, 6) AS t_stat, lp >= 0.05 AS equal_variance FROM t, p""",
        "v_scored_labels",
    ),
)
def levene_chosen_t_test(spark, sf):
    rows = domain.scored_labels(spark, sf).withColumn("side", F.when(F.col("y") == 1, "a").otherwise("b"))
    row = testing.chosen_t_test(rows, "score", "side", "a")
    return rounded(row.select("t_stat", "equal_variance"), "t_stat")


@query(
    "normality_k2",
    oracle(
        """WITH m AS (SELECT count(*)::DOUBLE AS n, avg(volume) AS mu FROM v_pocket_rows),
        c AS (SELECT any_value(n) AS n, avg((volume - mu) ** 2) AS m2, avg((volume - mu) ** 3) AS m3, avg((volume - mu) ** 4) AS m4
              FROM v_pocket_rows, m),
        g AS (SELECT n, m3 / m2 ** 1.5 AS g1, m4 / (m2 * m2) AS b2 FROM c),
        s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
            -1 + sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) AS w2,
            (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x,
            6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM g),
        a AS (SELECT *, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS a FROM s),
        z AS (SELECT n, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs, (1 - 2 / (9 * a)
            - sign(1 + x * sqrt(2 / (a - 4))) * (abs((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) ** (1 / 3)) / sqrt(2 / (9 * a)) AS zk
          FROM a)
        SELECT n::BIGINT AS n, round(zs, 5) AS z_skew, round(zk, 4) AS z_kurt FROM z""",
        "v_pocket_rows",
    ),
)
def normality_k2(spark, sf):
    row = testing.normality_k2(domain.pocket_rows(spark, sf), "volume")
    return row.select("n", F.round("z_skew", 5).alias("z_skew"), F.round("z_kurt", 4).alias("z_kurt"))


@query("bootstrap_bands")
def bootstrap_bands(spark, sf):
    bands, _ = resampling.bootstrap_curves(domain.scored_labels(spark, sf), n_bootstrap=300, seed=11, grid_size=101)
    return bands


@query("bootstrap_areas")
def bootstrap_areas(spark, sf):
    _, areas = resampling.bootstrap_curves(domain.scored_labels(spark, sf), n_bootstrap=1000, seed=11, grid_size=2)
    return areas


def _results(spark, sf):
    return domain.pocket_rows(spark, sf).select(
        F.col("structure_id").alias("protein_file"),
        F.col("pocket_id").alias("pocket_id"),
        F.col("depth").alias("pocket_depth"),
        "sasa",
        "volume",
        composite_score().alias("composite_score"),
        (F.col("depth") / 15).alias("normalized_score"),
        (F.col("sasa") / 50).alias("overlap_fraction"),
    )


@query(
    "results_counts",
    oracle(
        """SELECT count(*) AS rows, count(*) FILTER (WHERE composite_score NOT BETWEEN 0 AND 1) AS range_composite_score,
          count(*) FILTER (WHERE depth / 15 < 0 OR depth / 15 > 1) AS range_normalized_score,
          count(*) FILTER (WHERE volume <= 0) AS geometry_volume, count(*) FILTER (WHERE sasa <= 0) AS geometry_sasa,
          count(*) FILTER (WHERE depth <= 0) AS geometry_pocket_depth,
          count(*) FILTER (WHERE sasa / 50 > 0.7) AS overlap_overlap_fraction FROM v_scored_rows""",
        "v_scored_rows",
    ),
)
def results_counts(spark, sf):
    return quality.results_counts(_results(spark, sf))


@query(
    "duplicate_pairs",
    oracle(
        """SELECT (count(*) - count(DISTINCT (structure_id, basic_residues)))::BIGINT AS duplicate_pairs FROM v_pocket_rows""",
        "v_pocket_rows",
    ),
)
def duplicate_pairs(spark, sf):
    return quality.duplicate_pairs(domain.pocket_rows(spark, sf), ("structure_id", "basic_residues"))


@query(
    "quality_issues",
    oracle(
        """WITH c AS (SELECT count(*) FILTER (WHERE depth / 15 > 1) AS r, count(*) FILTER (WHERE depth <= 0) AS g,
            count(*) FILTER (WHERE sasa / 50 > 0.7) AS o, count(*) - count(DISTINCT (structure_id, pocket_id)) AS d
          FROM v_pocket_rows)
        SELECT 'screen' AS subject, 'error' AS level, 'score_range' AS "check",
          'normalized_score: ' || r || ' values outside [0, 1]' AS message FROM c WHERE r > 0
        UNION ALL SELECT 'screen', 'error', 'impossible_geometry', 'pocket_depth: values of 0 or below' FROM c WHERE g > 0
        UNION ALL SELECT 'screen', 'warning', 'pocket_overlap', 'overlap_fraction: ' || o || ' pockets above 0.7' FROM c
          WHERE o > 0
        UNION ALL SELECT 'screen', 'warning', 'normality_assumption',
          'composite_score: not normal at 0.05'
        UNION ALL SELECT 'screen', 'warning', 'independence_assumption',
          'protein_file/pocket_id: ' || d || ' repeated rows' FROM c WHERE d > 0""",
        "v_pocket_rows",
    ),
)
def quality_issues(spark, sf):
    return quality.results_issues(_results(spark, sf), "screen").drop("fix")


@query(
    "quality_verdict",
    oracle(
        """SELECT false AS valid, 2::BIGINT AS errors, (2 + (count(*) > count(DISTINCT (structure_id, pocket_id)))::INT)::BIGINT
             AS warnings FROM v_pocket_rows""",
        "v_pocket_rows",
    ),
)
def quality_verdict(spark, sf):
    return quality.verdict(quality.results_issues(_results(spark, sf), "screen"))


_AMINO = "resname IN ('ARG', 'LYS', 'HIS', 'ALA', 'GLY')"


@query(
    "completeness",
    oracle(
        f"""SELECT structure_id, n AS n_residues, round(n / span, 6) AS completeness,
          CASE WHEN n = 0 THEN 'error' WHEN n / span < 0.7 THEN 'warning' ELSE 'ok' END AS level FROM (
          SELECT structure_id, count(DISTINCT resseq) AS n, max(resseq) - min(resseq) + 1 AS span FROM v_atoms
          WHERE {_AMINO} GROUP BY structure_id)""",
        "v_atoms",
    ),
)
def completeness(spark, sf):
    return rounded(quality.completeness(domain.atoms(spark, sf)), "completeness")


@query(
    "chain_lengths",
    oracle(
        f"""SELECT structure_id, min(n) AS min_chain_length, max(n) AS max_chain_length,
          count(*) FILTER (WHERE n < 50) AS short_chains FROM (
          SELECT structure_id, chain, count(DISTINCT resseq) AS n FROM v_atoms WHERE {_AMINO} GROUP BY ALL)
        GROUP BY structure_id""",
        "v_atoms",
    ),
)
def chain_lengths(spark, sf):
    return quality.chain_lengths(domain.atoms(spark, sf))


@query(
    "low_confidence_atoms",
    oracle(
        """SELECT structure_id, round(avg((bfactor < 70)::INT), 6) AS low_confidence_fraction,
          round(avg(bfactor), 6) AS mean_b_factor, avg((bfactor < 70)::INT) > 0.2 AS warn FROM v_atoms GROUP BY structure_id""",
        "v_atoms",
    ),
)
def low_confidence_atoms(spark, sf):
    return rounded(quality.confidence_fraction(domain.atoms(spark, sf)), "low_confidence_fraction", "mean_b_factor")


@query(
    "coordinate_sanity",
    oracle(
        """SELECT structure_id, n AS n_atoms, o AS origin_atoms, b AS high_b_atoms, round(o / n, 6) AS origin_atom_fraction,
          round(b / n, 6) AS unreasonable_b_factor_fraction,
          CASE WHEN o > 0 THEN 'error' WHEN b > 0 THEN 'warning' ELSE 'ok' END AS level FROM (
          SELECT structure_id, count(*) AS n, count(*) FILTER (WHERE abs(x) < 1.5 AND abs(y) < 1.5 AND abs(z) < 1.5) AS o,
            count(*) FILTER (WHERE bfactor > 97) AS b FROM v_atoms GROUP BY structure_id)""",
        "v_atoms",
    ),
)
def coordinate_sanity(spark, sf):
    rows = quality.coordinate_sanity(domain.atoms(spark, sf), tolerance=1.5, max_b=97.0)
    return rounded(rows, "origin_atom_fraction", "unreasonable_b_factor_fraction")


@query(
    "structure_quality",
    oracle(
        f"""SELECT structure_id, count(DISTINCT (chain, resseq)) FILTER (WHERE {_AMINO}) AS n_residues, count(*) AS n_atoms,
          round(avg(bfactor), 6) AS avg_plddt, min(bfactor) AS min_plddt,
          count(DISTINCT (chain, resseq)) FILTER (WHERE resname IN ('ARG', 'LYS', 'HIS')) AS basic_residues,
          (max(resseq) FILTER (WHERE {_AMINO}) - min(resseq) FILTER (WHERE {_AMINO}) + 1
            - count(DISTINCT resseq) FILTER (WHERE {_AMINO}))::BIGINT AS missing_residues,
          round(count(DISTINCT (chain, resseq)) FILTER (WHERE resname IN ('ARG', 'LYS', 'HIS'))
            / count(DISTINCT (chain, resseq)) FILTER (WHERE {_AMINO}), 6) AS basic_fraction
        FROM v_atoms GROUP BY structure_id""",
        "v_atoms",
    ),
)
def structure_quality(spark, sf):
    return rounded(quality.structure_quality(domain.atoms(spark, sf)), "avg_plddt", "basic_fraction")


@query(
    "missing_site_residues",
    oracle(
        """WITH s AS (SELECT DISTINCT structure_id, resseq + d AS resseq FROM v_atoms, (VALUES (0), (1), (7)) t(d) WHERE is_het),
        m AS (SELECT structure_id, resseq FROM s EXCEPT SELECT structure_id, resseq FROM v_residues)
        SELECT structure_id, count(*) AS n_missing, array_to_string(list(resseq ORDER BY resseq)[1:10], ',') AS first_missing
        FROM m GROUP BY structure_id""",
        "v_residues",
    ),
)
def missing_site_residues(spark, sf):
    from ..operators.features import residues_from_atoms

    atoms = domain.atoms(spark, sf)
    steps = F.explode(F.array(F.lit(0), F.lit(1), F.lit(7)))
    site = atoms.where("is_het").select("structure_id", "resseq", steps.alias("d"))
    site = site.select("structure_id", (F.col("resseq") + F.col("d")).alias("resseq"))
    missing = quality.missing_site_residues(site, residues_from_atoms(atoms))
    return missing.withColumn("first_missing", F.array_join(F.col("first_missing").cast("array<string>"), ","))


@query(
    "stale_rows",
    """SELECT CAST(event_id AS VARCHAR) AS uniprot_id,
         CAST(floor(epoch(TIMESTAMP '2025-01-20 06:00:00' - date_trunc('second', ts)) / 86400) AS BIGINT) AS age_days FROM events
       WHERE event_id % 5 != 0 AND floor(epoch(TIMESTAMP '2025-01-20 06:00:00' - date_trunc('second', ts)) / 86400) > 365""",
)
def stale_rows(spark, sf):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    rows = domain.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("uniprot_id"),
        F.when(F.col("event_id") % 5 == 0, "not a date").otherwise(text).alias("model_date"),
    )
    return quality.stale_rows(rows, "2025-01-20T06:00:00Z")


@query(
    "unknown_accessions",
    """SELECT id AS uniprot_id FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events)
       WHERE id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 3 != 0)""",
)
def unknown_accessions(spark, sf):
    ids = domain.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("uniprot_id"))
    known = domain.table(spark, sf, "supplier").where("s_suppkey % 3 != 0").select(
        F.col("s_suppkey").cast("string").alias("uniprot_id")
    )
    return quality.unknown_accessions(ids, known)
