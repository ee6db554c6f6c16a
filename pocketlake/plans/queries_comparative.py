"""Registered queries: hit rates, conservation, enrichment, published tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.special import chi2_p, chi2_yates, fisher_p, odds_ratio, shift_tail_p
from ..functions.scoring import composite_score
from ..operators import comparative, enrichment, reports, testing
from ..sources.reports import parse_ontology
from . import domain
from .oracle_views import erfc_sql, fisher_sql, oracle
from .registry import query

_Z = testing.normal_quantile(0.975)


def rounded(df, *columns, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def rates(spark, sf):
    return comparative.hit_rates(domain.hits(spark, sf), domain.IP6_MICROMOLAR)


@query(
    "hit_rate_wilson",
    oracle(
        f"""WITH w AS (SELECT *, {_Z}::DOUBLE AS z, n_proteins::DOUBLE AS n FROM v_hit_rates),
        m AS (SELECT *, (hit_rate + z * z / (2 * n)) / (1 + z * z / n) AS mid,
            z / (1 + z * z / n) * sqrt(hit_rate * (1 - hit_rate) / n + z * z / (4 * n * n)) AS half FROM w)
        SELECT organism, n_proteins, n_hits, round(hit_rate, 6) AS hit_rate, round(100 * hit_rate, 6) AS hit_rate_percent,
          round(mid - half, 6) AS ci_low, round(mid + half, 6) AS ci_high, round(100 * (mid - half), 6) AS ci_low_percent,
          round(100 * (mid + half), 6) AS ci_high_percent, ip6_uM FROM m""",
        "v_hit_rates",
    ),
)
def hit_rate_wilson(spark, sf):
    names = ("hit_rate", "hit_rate_percent", "ci_low", "ci_high", "ci_low_percent", "ci_high_percent")
    return rounded(rates(spark, sf), *names)


_CHI = """(CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) > 0 THEN (a + b + c + d)
  * (abs(a * d - b * c) - least((a + b + c + d) / 2, abs(a * d - b * c))) ** 2
  / ((a + b)::DOUBLE * (c + d) * (a + c) * (b + d)) END)"""


def _bh_sql(p: str, m: str = "count(*) OVER ()") -> str:
    return f"least(1.0, {p} * {m} / rank() OVER (ORDER BY {p}))"


_TESTED = f"""t AS (SELECT *, {_CHI} AS chi2 FROM v_pairs),
  p AS (SELECT *, {erfc_sql('sqrt(chi2 / 2)')} AS chi_p, {fisher_sql('a', 'b', 'c', 'd')} AS fis_p FROM t),
  r AS (SELECT *, row_number() OVER (ORDER BY chi_p) AS rc, row_number() OVER (ORDER BY fis_p) AS rf,
          count(*) OVER () AS m FROM p),
  q AS (SELECT *, least(1.0, min(chi_p * m / rc) OVER (ORDER BY rc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS qc,
          least(1.0, min(fis_p * m / rf) OVER (ORDER BY rf ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS qf FROM r)"""


@query(
    "pairwise_organism_tests",
    oracle(
        f"""WITH {_TESTED}
        SELECT organism_a, organism_b, round(chi2, 6) AS chi2_stat, round(chi_p, 6) AS chi2_p_value,
          round(a * d / (b * c), 6) AS fisher_odds_ratio, round(fis_p, 6) AS fisher_p_value,
          round(qf, 6) AS fisher_fdr_q, round(qc, 6) AS chi2_fdr_q,
          '[[' || a || ',' || b || '],[' || c || ',' || d || ']]' AS contingency_table FROM q""",
        "v_pairs",
    ),
)
def pairwise_organism_tests(spark, sf):
    tested = comparative.pairwise_tests(rates(spark, sf)).withColumn("contingency_table", F.to_json("contingency_table"))
    return rounded(
        tested, "chi2_stat", "chi2_p_value", "fisher_odds_ratio", "fisher_p_value", "fisher_fdr_q", "chi2_fdr_q"
    )


@query(
    "pairwise_counts",
    oracle("SELECT organism_a, organism_b, a AS n_hits_a, c AS n_hits_b FROM v_pairs", "v_pairs"),
)
def pairwise_counts(spark, sf):
    return comparative.organism_pairs(rates(spark, sf), ["n_hits"])


# 2×2 tables per pocket class and depth step: many tables, with some empty cells.
_TABLES = """k AS (SELECT basic_residues AS g, count(*) FILTER (WHERE depth >= 15 AND sasa < 3) AS a,
    count(*) FILTER (WHERE depth >= 15 AND sasa >= 3 AND sasa < 10) AS b,
    count(*) FILTER (WHERE depth < 1 AND sasa < 3) AS c,
    count(*) FILTER (WHERE depth < 1 AND sasa >= 3 AND sasa < 10) AS d
  FROM v_pocket_rows GROUP BY basic_residues)"""


def _tables(spark, sf):
    deep, flat = F.col("depth") >= 15, F.col("depth") < 1
    small, mid = F.col("sasa") < 3, (F.col("sasa") >= 3) & (F.col("sasa") < 10)
    return (
        domain.pocket_rows(spark, sf)
        .groupBy(F.col("basic_residues").alias("g"))
        .agg(
            F.count_if(deep & small).alias("a"),
            F.count_if(deep & mid).alias("b"),
            F.count_if(flat & small).alias("c"),
            F.count_if(flat & mid).alias("d"),
        )
    )


_ABCD = ("a", "b", "c", "d")


@query(
    "chi2_by_group",
    oracle(
        f"""WITH {_TABLES}, t AS (SELECT *, {_CHI} AS chi2 FROM k)
        SELECT g, round(chi2, 6) AS chi2_stat, round({erfc_sql('sqrt(chi2 / 2)')}, 6) AS chi2_p_value FROM t""",
        "v_pocket_rows",
    ),
)
def chi2_by_group(spark, sf):
    parts = [F.col(c) for c in _ABCD]
    rows = _tables(spark, sf).select("g", chi2_yates(*parts).alias("chi2_stat"))
    return rounded(rows.withColumn("chi2_p_value", chi2_p(F.col("chi2_stat"))), "chi2_stat", "chi2_p_value")


@query(
    "fisher_by_group",
    oracle(
        f"""WITH {_TABLES}
        SELECT g, round({fisher_sql('a', 'b', 'c', 'd')}, 6) AS fisher_p_value,
          round(CASE WHEN b * c > 0 THEN a * d / (b * c) END, 6) AS odds_ratio FROM k""",
        "v_pocket_rows",
    ),
)
def fisher_by_group(spark, sf):
    parts = [F.col(c) for c in _ABCD]
    rows = _tables(spark, sf).select("g", fisher_p(*parts).alias("fisher_p_value"), odds_ratio(*parts).alias("odds_ratio"))
    return rounded(rows, "fisher_p_value", "odds_ratio")


@query(
    "pairwise_power",
    oracle(
        f"""SELECT organism_a, organism_b, round(hit_rate_a, 6) AS hit_rate_a, round(hit_rate_b, 6) AS hit_rate_b,
          CAST(ceil(({_Z}::DOUBLE * sqrt(2 * m * (1 - m)) + {testing.normal_quantile(0.8)}::DOUBLE
            * sqrt(hit_rate_a * (1 - hit_rate_a) + hit_rate_b * (1 - hit_rate_b))) ** 2
            / (hit_rate_a - hit_rate_b) ** 2) AS BIGINT) AS required_n_per_group
        FROM (SELECT *, (hit_rate_a + hit_rate_b) / 2 AS m FROM v_pairs)""",
        "v_pairs",
    ),
)
def pairwise_power(spark, sf):
    return rounded(comparative.pairwise_power(rates(spark, sf)), "hit_rate_a", "hit_rate_b")


@query(
    "sample_size_issues",
    oracle(
        """SELECT g, p1, p2, CASE WHEN p1 <= 0 OR p1 >= 1 OR p2 <= 0 OR p2 >= 1 THEN 'a rate is not inside (0, 1)'
             WHEN p1 = p2 THEN 'the two rates are equal' END AS issue
           FROM (SELECT basic_residues AS g, round(count(*) FILTER (WHERE sasa < 10) / count(*), 2) AS p1,
             CASE basic_residues WHEN 1 THEN 1.0 WHEN 2 THEN round(count(*) FILTER (WHERE sasa < 10) / count(*), 2)
               ELSE 0.5 END AS p2 FROM v_pocket_rows GROUP BY basic_residues)""",
        "v_pocket_rows",
    ),
)
def sample_size_issues(spark, sf):
    share = F.round(F.count_if(F.col("sasa") < 10) / F.count("*"), 2)
    rows = domain.pocket_rows(spark, sf).groupBy(F.col("basic_residues").alias("g")).agg(share.alias("p1"))
    rows = rows.withColumn("p2", F.when(F.col("g") == 1, 1.0).when(F.col("g") == 2, F.col("p1")).otherwise(0.5))
    return rows.withColumn("issue", testing.sample_size_issue(F.col("p1"), F.col("p2")))


_CONSERVATION = """o AS (SELECT orthogroup, o.organism, bool_or(coalesce(h.is_hit = 'yes', false)) AS hit
    FROM v_orthologs o LEFT JOIN v_hits h USING (organism, protein_id) GROUP BY ALL),
  s AS (SELECT orthogroup, count(*) AS present, count(*) FILTER (WHERE hit) AS hits FROM o GROUP BY orthogroup),
  c AS (SELECT count(*) FILTER (WHERE hits = 3) AS conserved, count(*) FILTER (WHERE hits BETWEEN 1 AND 2) AS part,
    count(*) FILTER (WHERE hits = 0) AS absent FROM s)"""


@query(
    "ortholog_conservation",
    oracle(
        f"""WITH {_CONSERVATION}
        SELECT orthogroup, present AS organisms_present, hits AS organisms_with_hits, (hits = 3)::INT AS hit_conserved_all,
          (hits >= 1)::INT AS hit_in_any,
          round((SELECT {fisher_sql('conserved', 'part', 'part', 'absent')} FROM c), 6) AS conservation_fisher_p_value
        FROM s""",
        "v_orthologs",
        "v_hits",
    ),
)
def ortholog_conservation(spark, sf):
    summary = comparative.ortholog_conservation(domain.orthologs(spark, sf), domain.hits(spark, sf))
    return rounded(comparative.with_conservation_p(summary), "conservation_fisher_p_value")


@query(
    "conservation_contingency",
    oracle(
        f"WITH {_CONSERVATION} SELECT conserved, part AS partial, absent FROM c",
        "v_orthologs",
        "v_hits",
    ),
)
def conservation_contingency(spark, sf):
    summary = comparative.ortholog_conservation(domain.orthologs(spark, sf), domain.hits(spark, sf))
    return comparative.conservation_counts(summary)


@query(
    "ortholog_hits",
    oracle(
        """SELECT o.orthogroup, o.organism, o.protein_id, bool_or(coalesce(h.is_hit = 'yes', false)) AS is_hit
           FROM v_orthologs o LEFT JOIN v_hits h USING (organism, protein_id) GROUP BY ALL""",
        "v_orthologs",
        "v_hits",
    ),
)
def ortholog_hits(spark, sf):
    return comparative.ortholog_hits(domain.orthologs(spark, sf), domain.hits(spark, sf))


@query(
    "venn_regions",
    oracle(
        f"""WITH {_CONSERVATION}
        SELECT region, count(*) AS n_orthogroups FROM (
          SELECT orthogroup, string_agg(organism, '&' ORDER BY organism) AS region FROM o WHERE hit GROUP BY orthogroup)
        GROUP BY region""",
        "v_orthologs",
        "v_hits",
    ),
)
def venn_regions(spark, sf):
    return comparative.membership_regions(domain.orthologs(spark, sf), domain.hits(spark, sf))


def _edges(spark, sf):
    """A two-level ontology: each segment under its initial, each initial under ROOT."""
    segments = domain.organisms(spark, sf).select("c_mktsegment").distinct()
    initial = F.concat(F.lit("GO:"), F.substring("c_mktsegment", 1, 1))
    low = segments.select(F.col("c_mktsegment").alias("go_id"), initial.alias("parent_id"))
    return low.unionByName(segments.select(initial.alias("go_id"), F.lit("ROOT").alias("parent_id")).distinct())


_GO = f"""e AS (SELECT DISTINCT go_id, 'GO:' || substr(go_id, 1, 1) AS parent FROM v_go
      UNION SELECT DISTINCT 'GO:' || substr(go_id, 1, 1), 'ROOT' FROM v_go),
  closure AS (SELECT go_id AS term, parent AS ancestor FROM e UNION SELECT c.term, e.parent FROM closure c JOIN e ON c.ancestor = e.go_id),
  ann AS (SELECT DISTINCT organism, protein_id, go_id AS term FROM v_go
      UNION SELECT organism, protein_id, ancestor FROM v_go JOIN closure ON go_id = term),
  study AS (SELECT DISTINCT organism, protein_id FROM v_hits WHERE is_hit = 'yes'),
  tot AS (SELECT g.organism, count(*) AS pn, count(s.protein_id) AS sn FROM (SELECT DISTINCT organism, protein_id FROM v_go) g
      LEFT JOIN study s USING (organism, protein_id) GROUP BY g.organism),
  cnt AS (SELECT a.organism, a.term, count(*) AS pc, count(s.protein_id) AS sc FROM ann a
      LEFT JOIN study s USING (organism, protein_id) GROUP BY ALL),
  tst AS (SELECT *, {fisher_sql('sc', '(sn - sc)', '(pc - sc)', '(pn - sn - pc + sc)')} AS p FROM cnt JOIN tot USING (organism)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY organism ORDER BY p) AS r, count(*) OVER (PARTITION BY organism) AS m FROM tst),
  enr AS (SELECT *, least(1.0, min(p * m / r) OVER (PARTITION BY organism ORDER BY r
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM rk)"""


def _enriched(spark, sf, terms=None):
    return enrichment.term_enrichment(domain.hits(spark, sf), domain.go_associations(spark, sf), _edges(spark, sf), terms)


@query(
    "go_enrichment",
    oracle(
        f"""WITH {_GO}
        SELECT organism, term AS go_id, sc AS study_count, pc AS population_count, sn AS study_n, pn AS pop_n,
          round(p, 6) AS p_uncorrected, round(q, 6) AS fdr_bh,
          CASE WHEN sc * pn > pc * sn THEN 'e' ELSE 'p' END AS enrichment,
          CASE WHEN term IN (SELECT go_id FROM v_go) THEN 'term ' || lower(term) END AS name,
          CASE WHEN term IN (SELECT go_id FROM v_go) THEN 'segment' END AS namespace FROM enr""",
        "v_go",
        "v_hits",
        recursive=True,
    ),
)
def go_enrichment(spark, sf):
    text = F.concat_ws("\n", F.lit("[Term]"), F.concat(F.lit("id: "), "go_id"), F.concat(F.lit("name: term "), F.lower("go_id")), F.lit("namespace: segment"))
    stanzas = domain.go_associations(spark, sf).select("go_id").distinct().select(F.concat(F.lit("\n"), text).alias("value"))
    terms, _ = parse_ontology(stanzas)
    return rounded(_enriched(spark, sf, terms), "p_uncorrected", "fdr_bh")


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(
    "go_heat_pivot",
    oracle(
        f"""WITH {_GO},
        top AS (SELECT term FROM enr GROUP BY term ORDER BY min(round(q, 9)), term LIMIT 15)
        SELECT term AS go_id, """
        + ", ".join(
            f"""round(coalesce(max(-log10(greatest(q, 1e-300))) FILTER (WHERE organism = '{r}'), 0), 6) AS "{r}" """
            for r in _REGIONS
        )
        + " FROM enr WHERE term IN (SELECT term FROM top) GROUP BY term",
        "v_go",
        "v_hits",
        recursive=True,
    ),
)
def go_heat_pivot(spark, sf):
    enriched = _enriched(spark, sf).withColumn("fdr_bh", F.round("fdr_bh", 12))
    heat = enrichment.term_heatmap(enriched, _REGIONS)
    return rounded(heat, *_REGIONS)


@query(
    "go_best_per_term",
    oracle(
        f"""WITH {_GO}
        SELECT term AS go_id, round(min(q), 6) AS best_fdr, min_by(organism, (round(q, 9), organism)) AS best_organism
        FROM enr GROUP BY term""",
        "v_go",
        "v_hits",
        recursive=True,
    ),
)
def go_best_per_term(spark, sf):
    enriched = _enriched(spark, sf).withColumn("fdr_bh", F.round("fdr_bh", 9))
    return rounded(enrichment.best_per_term(enriched), "best_fdr")


@query(
    "go_association_pairs",
    "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS protein_id, c_mktsegment AS go_id FROM customer",
)
def go_association_pairs(spark, sf):
    from ..sources.tables import go_association_pairs as pairs

    return pairs(domain.go_associations(spark, sf))


@query(
    "permutation_enrichment",
    oracle(
        """WITH p AS (SELECT organism, protein_id, bool_or(is_hit = 'yes') AS h FROM v_hits GROUP BY ALL),
        c AS (SELECT organism, count(*)::BIGINT AS n, (count(*) FILTER (WHERE h))::BIGINT AS k FROM p GROUP BY organism),
        t AS (SELECT sum(n)::BIGINT AS nn, sum(k)::BIGINT AS kk FROM c),
        w AS (SELECT organism, n, k, nn, kk, unnest(range(greatest(0, n - (nn - kk)), least(n, kk) + 1)) AS i FROM c, t),
        d AS (SELECT *, exp(lgamma(kk + 1) - lgamma(i + 1) - lgamma(kk - i + 1) + lgamma(nn - kk + 1) - lgamma(n - i + 1)
            - lgamma(nn - kk - n + i + 1) - lgamma(nn + 1) + lgamma(n + 1) + lgamma(nn - n + 1)) AS pr FROM w)
        SELECT organism AS category, round(any_value(k / n), 6) AS observed_hit_rate, round(any_value(kk / nn), 6) AS overall_hit_rate,
          round(any_value(k / n - kk / nn), 6) AS delta_hit_rate,
          round(coalesce(sum(pr) FILTER (WHERE abs(i / n - kk / nn) >= abs(k / n - kk / nn) - 1e-12), 0), 6) AS p_exact,
          true AS estimate_agrees FROM d GROUP BY organism""",
        "v_hits",
    ),
)
def permutation_enrichment(spark, sf):
    """The permutation estimate beside the exact tail of the same law; they agree within six standard errors."""
    replicates = 5000
    people = comparative.protein_hits(domain.hits(spark, sf))
    found = enrichment.permutation_enrichment(people, "organism", "is_hit", replicates, seed=7)
    counts = people.groupBy(F.col("organism").alias("category")).agg(F.count("*").alias("n"), F.count_if("is_hit").alias("k"))
    whole = counts.agg(F.struct(F.sum("n").alias("n"), F.sum("k").alias("k")).alias("t")).scalar()
    exact = counts.withColumn("_t", whole).select("category", shift_tail_p(F.col("_t.n"), F.col("_t.k"), F.col("n"), F.col("k")).alias("p_exact"))
    p = F.col("p_exact")
    margin = 6 * F.sqrt(p * (1 - p) / replicates) + 2 / replicates
    joined = found.join(exact, "category").withColumn("estimate_agrees", F.abs(F.col("p_value") - p) <= margin)
    names = ("observed_hit_rate", "overall_hit_rate", "delta_hit_rate", "p_exact")
    return rounded(joined.select("category", *names, "estimate_agrees"), *names)


@query(
    "spearman_rank",
    oracle(
        """WITH r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx,
            rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry
          FROM (SELECT volume AS x, sasa AS y FROM v_pocket_rows))
        SELECT count(*) AS n_organisms, round(corr(rx, ry), 6) AS spearman_rho FROM r""",
        "v_pocket_rows",
    ),
)
def spearman_rank(spark, sf):
    return rounded(testing.spearman(domain.pocket_rows(spark, sf), "volume", "sasa"), "spearman_rho").drop("spearman_p_value")


_SPEARMAN = """r AS (SELECT rank() OVER (ORDER BY ip6_uM) + (count(*) OVER (PARTITION BY ip6_uM) - 1) / 2 AS rx,
    rank() OVER (ORDER BY hit_rate) + (count(*) OVER (PARTITION BY hit_rate) - 1) / 2 AS ry
  FROM v_hit_rates WHERE ip6_uM IS NOT NULL),
  s AS (SELECT count(*) AS n, corr(rx, ry) AS rho FROM r)"""


@query(
    "comparative_statistics",
    oracle(
        f"""WITH {_SPEARMAN}
        SELECT organism, n_proteins, n_hits, round(hit_rate, 6) AS hit_rate, n AS n_organisms, round(rho, 6) AS spearman_rho
        FROM v_hit_rates, s""",
        "v_hit_rates",
    ),
)
def comparative_statistics(spark, sf):
    table = rates(spark, sf)
    joined = comparative.with_row(table, testing.spearman(table, "ip6_uM", "hit_rate"))
    kept = joined.select("organism", "n_proteins", "n_hits", "hit_rate", "n_organisms", "spearman_rho")
    return rounded(kept, "hit_rate", "spearman_rho")


@query(
    "hypothesis_verdict",
    oracle(
        """SELECT basic_residues, CASE WHEN p < 0.1 AND rho > 0.5 THEN 'supported' WHEN p < 0.1 AND rho < -0.5 THEN 'rejected'
             ELSE 'inconclusive' END AS verdict FROM (
          SELECT basic_residues, avg(sasa) / 25.5 - 0.49 AS rho, avg(depth) / 100 AS p FROM v_pocket_rows GROUP BY 1)""",
        "v_pocket_rows",
    ),
)
def hypothesis_verdict(spark, sf):
    means = domain.pocket_rows(spark, sf).groupBy("basic_residues").agg(
        (F.avg("sasa") / 25.5 - 0.49).alias("rho"), (F.avg("depth") / 100).alias("p")
    )
    return means.select("basic_residues", testing.hypothesis_verdict(F.col("rho"), F.col("p")).alias("verdict"))


@query(
    "linear_fit",
    oracle(
        """SELECT round(regr_slope(sasa, volume), 6) AS slope, round(regr_intercept(sasa, volume), 6) AS intercept
           FROM v_pocket_rows""",
        "v_pocket_rows",
    ),
)
def linear_fit(spark, sf):
    return rounded(testing.linear_fit(domain.pocket_rows(spark, sf), "volume", "sasa"), "slope", "intercept")


@query(
    "class_fractions",
    oracle(
        """SELECT organism, round(avg((classification != 'Surface')::INT), 6) AS hit_rate,
             count(DISTINCT pdb_id) AS n_structures, 25.0::DOUBLE AS ip6_concentration
           FROM v_dataset WHERE organism != 'NA' GROUP BY organism""",
        "v_dataset",
    ),
)
def class_fractions(spark, sf):
    table = comparative.with_package_ip6(comparative.class_fractions(domain.dataset(spark, sf)))
    return rounded(table, "hit_rate")


@query(
    "class_fractions_fallback",
    oracle(
        """SELECT ligand_type AS organism, round(avg((classification != 'Surface')::INT), 6) AS hit_rate,
             count(DISTINCT pdb_id) AS n_structures FROM v_dataset GROUP BY ligand_type""",
        "v_dataset",
    ),
)
def class_fractions_fallback(spark, sf):
    unknown = domain.dataset(spark, sf).withColumn("organism", F.lit("NA"))
    return rounded(comparative.class_fractions(unknown), "hit_rate")


@query(
    "class_enrichment",
    oracle(
        """SELECT n.classification, count(v.pdb_id) AS count,
             round(count(v.pdb_id) / greatest(1, max(count(v.pdb_id)) OVER ()), 6) AS enrichment_score
           FROM (VALUES ('Cryptic'), ('Semi-cryptic'), ('Surface')) n(classification)
           LEFT JOIN v_dataset v USING (classification) GROUP BY n.classification""",
        "v_dataset",
    ),
)
def class_enrichment(spark, sf):
    return rounded(comparative.class_enrichment(domain.dataset(spark, sf)), "enrichment_score")


@query(
    "conservation_scores",
    oracle(
        """WITH t AS (SELECT * FROM v_dataset WHERE classification = 'Cryptic' ORDER BY sasa, pdb_id LIMIT 10)
        SELECT CASE WHEN organism = 'NA' THEN pdb_id::VARCHAR ELSE organism END AS species,
          round(1.0 - sasa / greatest((SELECT max(sasa) FROM t), 1.0), 6) AS conservation_score, pdb_id AS candidate FROM t""",
        "v_dataset",
    ),
)
def conservation_scores(spark, sf):
    return rounded(comparative.conservation_scores(domain.dataset(spark, sf)), "conservation_score")


@query(
    "lowest_area",
    oracle(
        "SELECT pdb_id, sasa FROM v_dataset WHERE classification = 'Cryptic' ORDER BY sasa, pdb_id LIMIT 10", "v_dataset"
    ),
)
def lowest_area(spark, sf):
    return comparative.lowest_area(domain.dataset(spark, sf)).select("pdb_id", "sasa")


def _gallery_controls(spark, sf, positive="positive"):
    rows = domain.pockets(spark, sf).withColumn("score", composite_score())
    kind = F.when(F.col("return_class") == "A", positive).otherwise("negative")
    return rows.select(F.col("pocket_id").alias("pdb_id"), F.col("return_class").alias("protein"), kind.alias("control_type"), "score")


@query(
    "candidate_gallery",
    oracle(
        """SELECT return_class || ' (' || pocket_id || ')' AS candidate, round(composite_score, 6) AS score FROM (
          SELECT * FROM v_scored WHERE return_class = 'A' ORDER BY composite_score DESC, pocket_id LIMIT 10)""",
        "v_scored",
    ),
)
def candidate_gallery(spark, sf):
    return rounded(comparative.candidate_gallery(_gallery_controls(spark, sf), domain.dataset(spark, sf)), "score")


@query(
    "candidate_gallery_fallback",
    oracle(
        """SELECT pdb_id::VARCHAR AS candidate, round(1.0 - sasa / 50.0, 6) AS score FROM (
          SELECT * FROM v_dataset WHERE classification = 'Cryptic' ORDER BY pdb_id LIMIT 10)""",
        "v_dataset",
    ),
)
def candidate_gallery_fallback(spark, sf):
    controls = _gallery_controls(spark, sf, "unknown")
    return rounded(comparative.candidate_gallery(controls, domain.dataset(spark, sf)), "score")


@query(
    "unique_listed_ids",
    oracle(
        """SELECT count(DISTINCT id) AS n_proteins, count(DISTINCT id) < 20 AS below_minimum
           FROM (SELECT unnest(string_split(uniprot_id, ';')) AS id FROM v_dataset)""",
        "v_dataset",
    ),
)
def unique_listed_ids(spark, sf):
    return comparative.unique_listed_ids(domain.dataset(spark, sf))


@query(
    "first_value_per_group",
    """SELECT event_type, min_by(value, event_id) AS value FROM events GROUP BY event_type""",
)
def first_value_per_group(spark, sf):
    return reports.first_value(domain.table(spark, sf, "events"), "event_type", "value", "event_id")


@query("class_counts", oracle("SELECT classification, count(*) AS n FROM v_dataset GROUP BY 1", "v_dataset"))
def class_counts(spark, sf):
    return reports.class_counts(domain.dataset(spark, sf))


@query(
    "screen_summary",
    oracle(
        """WITH h AS (SELECT * FROM v_scored WHERE basic_residues >= 4 AND sasa <= 10 AND volume BETWEEN 300 AND 800
            AND composite_score >= 0.60::DOUBLE)
        SELECT count(DISTINCT structure_id) AS proteins_with_hits, count(*) AS total_hits,
          count(*) FILTER (WHERE composite_score >= 0.75::DOUBLE) AS n_high,
          count(*) FILTER (WHERE composite_score >= 0.60::DOUBLE AND composite_score < 0.75::DOUBLE) AS n_moderate,
          (SELECT count(DISTINCT structure_id) FROM v_scored) AS structures_screened,
          round(count(DISTINCT structure_id) / (SELECT count(DISTINCT structure_id) FROM v_scored), 6) AS hit_rate,
          0.6::DOUBLE AS score_threshold, 10.0::DOUBLE AS max_sasa FROM h""",
        "v_scored",
    ),
)
def screen_summary(spark, sf):
    from ..operators.filters import by_criteria, by_score

    scored = domain.pockets(spark, sf).withColumn("composite_score", composite_score())
    hits = by_score(by_criteria(scored))
    return rounded(reports.screen_summary(scored, hits, score_threshold=0.6, max_sasa=10.0), "hit_rate")


@query(
    "timing_summary",
    """SELECT event_type AS function_name, count(*) AS calls, round(sum(value), 4) AS total_seconds,
         round(avg(value), 6) AS mean_seconds, max(value) AS max_seconds FROM events GROUP BY event_type""",
)
def timing_summary(spark, sf):
    summary = reports.timing_summary(domain.timings(spark, sf))
    return rounded(rounded(summary, "mean_seconds"), "total_seconds", digits=4)


@query(
    "throughput",
    """SELECT round(avg(value), 6) AS mean_runtime_seconds, round(avg(user_id), 6) AS mean_peak_memory_mb,
         round(3600.0 / avg(value), 6) AS throughput_proteins_per_hour, 3600.0 / avg(value) < 1000 AS skip_electrostatics
       FROM events""",
)
def throughput(spark, sf):
    profile = domain.table(spark, sf, "events").select(
        F.col("value").alias("runtime_seconds"), F.col("user_id").cast("double").alias("peak_memory_mb")
    )
    names = ("mean_runtime_seconds", "mean_peak_memory_mb", "throughput_proteins_per_hour")
    return rounded(reports.throughput(profile), *names)


@query(
    "status_counts",
    """SELECT event_id % 3 AS run, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'downloaded'
         END AS status, count(*) AS n FROM events GROUP BY ALL""",
)
def status_counts(spark, sf):
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped")
    rows = domain.table(spark, sf, "events").select((F.col("event_id") % 3).alias("run"), kind.otherwise("downloaded").alias("status"))
    return reports.status_counts(rows, group=["run"])


@query(
    "feature_summary",
    oracle(
        """SELECT count(*) AS n_pockets, sum(label)::BIGINT AS n_positive_pockets, count(DISTINCT pdb_id) AS n_structures
           FROM v_features""",
        "v_features",
    ),
)
def feature_summary(spark, sf):
    return reports.feature_summary(domain.features(spark, sf))


@query(
    "structure_labels",
    oracle("SELECT pdb_id, max(label) AS label FROM v_features GROUP BY pdb_id", "v_features"),
)
def structure_labels(spark, sf):
    return reports.structure_labels(domain.features(spark, sf))


@query(
    "best_by_method",
    oracle(
        """SELECT round(max(hit_rate) FILTER (WHERE organism ILIKE '%am%' OR organism ILIKE '%af%'), 6) AS ml_auc,
             round(max(hit_rate) FILTER (WHERE organism ILIKE '%asia%'), 6) AS threshold_auc FROM v_hit_rates""",
        "v_hit_rates",
    ),
)
def best_by_method(spark, sf):
    table = rates(spark, sf).select(F.col("organism").alias("method"), F.col("hit_rate").alias("test_roc_auc"))
    best = reports.best_by_method(table, {"ml_auc": "am|af", "threshold_auc": "asia"})
    return rounded(best, "ml_auc", "threshold_auc")


@query(
    "table_manifest",
    """SELECT 'part' AS "table", 'dataset' AS source, count(*) AS rows, 'included' AS status FROM part
       UNION ALL SELECT 'orders', 'benchmark', count(*), 'included' FROM orders
       UNION ALL SELECT 'gallery', 'gallery', NULL, 'pending'""",
)
def table_manifest(spark, sf):
    expected = [("part", "dataset"), ("orders", "benchmark"), ("gallery", "gallery")]
    return reports.table_manifest(expected, {n: domain.table(spark, sf, n) for n in ("part", "orders")})
