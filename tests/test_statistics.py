"""Tests, curves and resampling against closed forms, NumPy and enumeration."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pocketlake.functions import special
from pocketlake.operators import comparative, curves, enrichment, resampling, testing
from pocketlake.plans.ordering import rank_rows, running


def fisher_by_enumeration(a, b, c, d):
    r, s, k = a + b, c + d, a + c
    pmf = {i: math.comb(r, i) * math.comb(s, k - i) / math.comb(r + s, k) for i in range(max(0, k - s), min(r, k) + 1)}
    return min(1.0, sum(v for v in pmf.values() if v <= pmf[a] * (1 + 1e-7)))


@settings(max_examples=200, deadline=None)
@given(*[st.integers(0, 40)] * 4)
def test_fisher_equals_enumeration(a, b, c, d):
    assert special.fisher_two_sided(a, b, c, d) == pytest.approx(fisher_by_enumeration(a, b, c, d), abs=1e-10)


def test_fisher_on_huge_tables():
    assert special.fisher_two_sided(10**9, 10**9, 10**9, 10**9) == pytest.approx(1.0)
    assert special.fisher_two_sided(10**8, 0, 0, 10**8) < 1e-12


def test_tail_identities():
    # With many degrees of freedom t is normal; one-degree t is Cauchy; F(1, n) is t² and chi-square(1) is z².
    assert special.t_two_sided(1.96, 1e7) == pytest.approx(special.erfc_tail(1.96**2), abs=1e-6)
    assert special.t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert special.f_upper(2.5**2, 1, 17) == pytest.approx(special.t_two_sided(2.5, 17))
    assert special.erfc_tail(3.841458820694124) == pytest.approx(0.05)


def bh_reference(p, alpha=0.05):
    p = np.asarray(p)
    order = np.argsort(p, kind="stable")
    m, ranks = len(p), np.arange(1, len(p) + 1)
    q = np.minimum(np.minimum.accumulate((p[order] * m / ranks)[::-1])[::-1], 1)
    ok = np.where(p[order] <= ranks / m * alpha)[0]
    out, reject = np.empty(m), np.zeros(m, bool)
    out[order] = q
    reject[order] = np.arange(m) <= (ok.max() if len(ok) else -1)
    return out, reject


@pytest.mark.parametrize("p", [[0.001, 0.01, 0.04, 0.2, 0.8], [0.02] * 4 + [0.9, 0.01], [0.9, 0.95, 1.0]])
def test_benjamini_hochberg(spark, p):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p_value double")
    rows = sorted(testing.benjamini_hochberg(df).collect(), key=lambda r: r.i)
    q, reject = bh_reference(p)
    assert [r.fdr_q_value for r in rows] == pytest.approx(q.tolist())
    assert [r.reject for r in rows] == reject.tolist()


def test_benjamini_hochberg_rejects_bad_p(spark):
    with pytest.raises(Exception, match=r"\[0, 1\]"):
        testing.benjamini_hochberg(spark.createDataFrame([(1.5,)], "p_value double")).collect()


def test_running_aggregates_split_a_hot_group(spark):
    n = 5000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"))
    out = running(df, [F.col("id")], {"n": ("sum", F.lit(1)), "low": ("min", -F.col("id")), "prev": ("max", F.col("id"))}, ["g"]).toPandas()
    for _, part in out.sort_values("id").groupby("g"):
        assert part.n.tolist() == list(range(1, len(part) + 1))
        assert part.low.tolist() == (-part.id).tolist()
    ranks = rank_rows(df, [F.desc("id")]).toPandas().sort_values("id", ascending=False)
    assert ranks["rank"].tolist() == list(range(1, n + 1))


def labelled(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    score = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    return y, score, spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, score)], "y int, score double")


def test_roc_auc_is_the_rank_probability(spark):
    y, score, df = labelled(spark)
    pos, neg = score[y == 1], score[y == 0]
    wins = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    for shape in (F.col("score"), F.pow("score", F.lit(3.0)) * 7):
        area = curves.curve_areas(curves.score_curve(df.withColumn("score", shape))).collect()[0]
        assert area.roc_auc == pytest.approx(wins)
        assert 0 <= area.average_precision <= 1


def test_curve_needs_both_labels(spark):
    with pytest.raises(Exception, match="labels must be 0 and 1"):
        curves.curve_areas(curves.score_curve(spark.createDataFrame([(1, 0.5)], "y int, score double"))).collect()


def test_interpolation_matches_numpy(spark):
    x = [0.1, 0.1, 0.25, 0.5, 0.5, 0.9]
    y = [0.0, 0.3, 0.4, 0.4, 0.8, 1.0]
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(zip(x, y))], "x double, y double, s int")
    rows = sorted(curves.interpolate_on_grid(df, "x", "y", "s", 33).collect(), key=lambda r: r.grid_index)
    grid = np.linspace(0, 1, 33)
    assert [r.grid_y for r in rows] == pytest.approx(np.interp(grid, x, y).tolist())
    area = curves.trapezoid_area(df, "x", "y", "s").collect()[0].area
    assert area == pytest.approx(float(np.trapezoid(y, x)))


def test_bootstrap_agrees_with_resampling_rows(spark):
    y, score, df = labelled(spark)
    bands, areas = resampling.bootstrap_curves(df, n_bootstrap=400, seed=5, grid_size=21)
    again, _ = resampling.bootstrap_curves(df, n_bootstrap=400, seed=5, grid_size=21)
    got = {r.metric: r for r in areas.collect()}
    rng = np.random.default_rng(0)
    sample = []
    for _ in range(400):
        at = rng.integers(0, len(y), len(y))
        pos, neg = score[at][y[at] == 1], score[at][y[at] == 0]
        sample.append((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
    assert got["roc_auc"].lower == pytest.approx(np.quantile(sample, 0.025), abs=0.02)
    assert got["roc_auc"].upper == pytest.approx(np.quantile(sample, 0.975), abs=0.02)
    rows = {(r.curve, r.grid_index): r for r in bands.collect()}
    assert len(rows) == 42 and rows["roc", 20].y_lower == pytest.approx(1.0)
    assert all(r.y_lower <= r.y_upper for r in rows.values())
    assert rows == {(r.curve, r.grid_index): r for r in again.collect()}


def test_sample_size_and_errors(spark):
    df = spark.createDataFrame([(0.2, 0.5), (0.3, 0.3), (0.0, 0.5)], "a double, b double")
    rows = df.select(testing.two_proportion_sample_size(F.col("a"), F.col("b")).alias("n"), testing.sample_size_issue(F.col("a"), F.col("b")).alias("i")).collect()
    assert rows[0].n == 39 and rows[0].i is None
    assert rows[1].n is None and "equal" in rows[1].i and "inside" in rows[2].i
    one = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, v double")
    with pytest.raises(Exception, match="fewer than two"):
        testing.cohens_d(one, "v", F.col("g") == "a").collect()


def test_spearman_small_table(spark):
    df = spark.createDataFrame([(20.0, 1.0), (25.0, 2.0), (520.0, 3.0), (None, 9.0)], "x double, y double")
    row = testing.spearman(df, "x", "y").collect()[0]
    assert (row.n_organisms, row.spearman_rho, row.spearman_p_value) == (3, pytest.approx(1.0), pytest.approx(0.0))


@pytest.fixture(scope="module")
def hits(spark):
    rows = [(o, f"{o}{i}", "yes" if i < k else "no") for o, k in (("dicty", 3), ("human", 2), ("yeast", 1)) for i in range(3)]
    return spark.createDataFrame(rows, "organism string, protein_id string, is_hit string")


def test_hit_rates_and_pairs(spark, hits):
    rates = comparative.hit_rates(hits.unionByName(hits), {"yeast": 20.0, "human": 25.0, "dicty": 520.0})
    rows = {r.organism: r for r in rates.collect()}
    assert (rows["human"].n_proteins, rows["human"].n_hits) == (3, 2)
    assert all(r.ci_low <= r.hit_rate <= r.ci_high for r in rows.values())
    pairs = comparative.pairwise_tests(rates).collect()
    assert len(pairs) == 3
    by = {(r.organism_a, r.organism_b): r for r in pairs}
    assert by["dicty", "yeast"].fisher_p_value == pytest.approx(fisher_by_enumeration(3, 0, 1, 2))
    assert math.isinf(by["dicty", "human"].fisher_odds_ratio)


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="hits table lacks columns: is_hit"):
        comparative.hit_rates(spark.createDataFrame([("a", "b")], "organism string, protein_id string"), {})


def test_conservation(spark, hits):
    rows = [(f"OG{i + 1}", o, f"{o}{i}") for i in range(3) for o in ("dicty", "human", "yeast")]
    groups = spark.createDataFrame(rows, "orthogroup string, organism string, protein_id string")
    table = {r.orthogroup: r for r in comparative.with_conservation_p(comparative.ortholog_conservation(groups, hits)).collect()}
    assert {r.organisms_present for r in table.values()} == {3}
    assert [table[f"OG{i}"].hit_conserved_all for i in (1, 2, 3)] == [1, 0, 0]
    regions = {r.region: r.n_orthogroups for r in comparative.membership_regions(groups, hits).collect()}
    assert regions == {"dicty&human&yeast": 1, "dicty&human": 1, "dicty": 1}


def test_closure_follows_diamonds(spark):
    edges = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("a", "root")], "go_id string, parent_id string")
    got = {(r.term, r.ancestor) for r in enrichment.ancestor_closure(edges).collect()}
    assert ("d", "root") in got and ("d", "a") in got and len(got) == 4 + 2 + 2 + 1


def test_permutation_p_matches_exact_tail(spark):
    rows = [("kinase", i < 8) for i in range(10)] + [("tf", i < 2) for i in range(30)]
    df = spark.createDataFrame(rows, "category string, hit boolean")
    table = {r.category: r for r in enrichment.permutation_enrichment(df, "category", "hit", 4000, seed=1).collect()}
    n_all, k_all, n = 40, 10, 10
    rate = k_all / n_all
    pmf = {i: math.comb(k_all, i) * math.comb(n_all - k_all, n - i) / math.comb(n_all, n) for i in range(11)}
    exact = sum(v for i, v in pmf.items() if abs(i / n - rate) >= abs(0.8 - rate) - 1e-12)
    assert table["kinase"].p_value == pytest.approx(exact, abs=0.003)
    assert table["kinase"].fdr_q_value >= table["kinase"].p_value


@pytest.mark.parametrize("d", [1, 3, 17, 1e5, 1e9, 1e12, 1e13])
def test_f_of_one_is_the_median_at_equal_degrees(d):
    assert special.f_upper(1.0, d, d) == pytest.approx(0.5, abs=1e-9)


@pytest.mark.parametrize("t", [0.5, 1.96, 3.5, 4.2])
@pytest.mark.parametrize("dof", [1e9, 1e11, 1e13])
def test_t_at_huge_degrees_is_normal(t, dof):
    assert special.t_two_sided(t, dof) == pytest.approx(special.erfc_tail(t * t), rel=1e-6)


def test_hypergeometric_tail_by_enumeration():
    for total, marked, drawn, shift in ((20, 7, 9, 0.1), (50, 3, 40, 0.02), (12, 12, 5, 0.1), (30, 10, 30, 0.0)):
        ways = [math.comb(marked, k) * math.comb(total - marked, drawn - k) for k in range(drawn + 1)]
        extreme = [w for k, w in enumerate(ways) if abs(k / drawn - marked / total) >= shift - 1e-12]
        assert special.hypergeometric_shift_tail(total, marked, drawn, shift) == pytest.approx(sum(extreme) / sum(ways))


def test_hypergeometric_tail_at_a_trillion_rows():
    deviation = math.sqrt(0.09 / 1e11 * 0.9)
    tail = special.hypergeometric_shift_tail(10**12, 10**11, 10**11, 2 * deviation)
    assert tail == pytest.approx(math.erfc(2 / math.sqrt(2)), rel=1e-3)


def test_null_group_is_ranked_like_any_other(spark):
    from pocketlake.plans import ordering

    coalescing = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(2000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'a' END AS g", "(id * 7919) % 2000 AS v")
        ranks = ordering.rank_rows(df, [F.col("v")], partition=["g"]).groupBy("g").agg(F.countDistinct("rank"), F.max("rank")).collect()
        assert sorted(r[1:] for r in ranks) == [(1000, 1000), (1000, 1000)] and {r[0] for r in ranks} == {"a", None}
        shares = testing.empirical_cdf(df, "v", "g").groupBy("g").agg(F.max("cume_dist"), F.count("*")).collect()
        assert {r[0]: tuple(r[1:]) for r in shares} == {"a": (1.0, 1000), None: (1.0, 1000)}
        middle = {r[0]: r[1] for r in ordering.medians(df, "v", "g").collect()}
        assert set(middle) == {"a", None}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalescing)
