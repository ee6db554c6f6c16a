"""Interval estimates, tests on groups, effect sizes and multiple-testing control."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import f_p, t_p
from ..plans.ordering import accumulate, average_ranks, join_groups, medians, running, spread
from ..runtime import freeze


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def wilson_interval(successes: Column, total: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Score interval of a proportion in closed form."""
    z = normal_quantile(1 - (1 - confidence) / 2)
    n, p = total.cast("double"), successes / total
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low = F.when(successes == 0, 0.0).otherwise(middle - half)
    high = F.when(successes == total, 1.0).otherwise(middle + half)
    return low, high


def benjamini_hochberg(
    df: DataFrame, p: str = "p_value", alpha: float = 0.05, partition: Sequence[str] = (), prefix: str = ""
) -> DataFrame:
    """Add ``fdr_q_value`` and ``reject`` for the step-up procedure, within ``partition``.

    Equal p-values share one adjusted value, so the running minimum runs over distinct p only. NULL
    p-values take no part and get NULL. A p outside [0, 1] raises.
    """
    q_name, reject = f"{prefix}fdr_q_value", f"{prefix}reject"
    value = F.col(p)
    bad = (value < 0) | (value > 1) | F.isnan(value)
    checked = df.withColumn(
        p, F.when(bad, F.raise_error(F.lit("p-value outside [0, 1]")).cast("double")).otherwise(value)
    )
    groups = checked.where(F.col(p).isNotNull()).groupBy(*partition, p).agg(F.count("*").alias("_n"))
    ranges = spread(groups, [F.col(p)], partition)
    ranked = accumulate(ranges, [F.col(p)], {"_rank": ("sum", F.col("_n"))}, partition)
    sizes = ranges.groupBy(*partition).agg(F.sum("_n").alias("_m"))
    if partition:
        sized = join_groups(ranked, sizes, list(partition))
    else:
        sized = ranked.withColumn("_m", sizes.select("_m").scalar())
    passing = F.when(F.col(p) <= F.col("_rank") / F.col("_m") * alpha, F.col(p))
    raw = F.least(F.col(p) * F.col("_m") / F.col("_rank"), F.lit(1.0))
    # Ranks are read three times from here on.
    scaled = freeze(sized.select(*partition, p, "_range", raw.alias("_raw"), passing.alias("_passing")))
    adjusted = accumulate(scaled, [F.desc(p)], {q_name: ("min", F.col("_raw"))}, partition, backwards=True)
    cut = scaled.groupBy(*partition).agg(F.max("_passing").alias("_cut"))
    if partition:
        decided = join_groups(adjusted, cut, list(partition))
    else:
        decided = adjusted.withColumn("_cut", cut.select("_cut").scalar())
    decided = decided.select(
        *partition, p, q_name, F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False)).alias(reject)
    )
    return join_groups(checked, decided, [*partition, p], "left")


def two_proportion_sample_size(
    p1: Column, p2: Column, alpha: float = 0.05, power: float = 0.8, two_sided: bool = True
) -> Column:
    """Per-group size to detect p1 against p2; NULL when a rate is not inside (0, 1) or both are equal."""
    z_alpha = normal_quantile(1 - alpha / 2 if two_sided else 1 - alpha)
    z_beta = normal_quantile(power)
    mean = (p1 + p2) / 2
    effect = z_alpha * F.sqrt(2 * mean * (1 - mean)) + z_beta * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    valid = (p1 > 0) & (p1 < 1) & (p2 > 0) & (p2 < 1) & (p1 != p2)
    return F.when(valid, F.ceil(effect * effect / ((p1 - p2) * (p1 - p2))))


def sample_size_issue(p1: Column, p2: Column) -> Column:
    inside = (p1 > 0) & (p1 < 1) & (p2 > 0) & (p2 < 1)
    return F.when(~inside, "a rate is not inside (0, 1)").when(
        p1 == p2, "the two rates are equal"
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: pair count, rank correlation (average ranks) and its two-sided p. NULL pairs are dropped."""
    pairs = freeze(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("_n")))

    def ranks(value: str, name: str) -> DataFrame:
        counts = pairs.groupBy(value).agg(F.sum("_n").alias("_n"))
        upto = running(counts, [F.col(value)], {"_upto": ("sum", F.col("_n"))})
        return upto.select(value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))

    ranked = pairs.join(ranks(x, "_rx"), x).join(ranks(y, "_ry"), y)
    n, rx, ry = F.col("_n").cast("double"), F.col("_rx"), F.col("_ry")
    # Ranks 1..n with ties keep the mean (n + 1) / 2, so centring needs the count only.
    mean = pairs.agg(((F.sum("_n") + 1) / 2).alias("m")).scalar()
    sums = ranked.withColumn("_dx", rx - mean).withColumn("_dy", ry - mean)
    moments = sums.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        F.sum(n * F.col("_dx") * F.col("_dy")).alias("sxy"),
        F.sum(n * F.col("_dx") * F.col("_dx")).alias("sxx"),
        F.sum(n * F.col("_dy") * F.col("_dy")).alias("syy"),
    )
    rho = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    dof = F.col("n") - 2
    clipped = F.least(F.greatest(F.col("spearman_rho"), F.lit(-1.0)), F.lit(1.0))
    t = F.abs(clipped) * F.sqrt(F.try_divide(dof.cast("double"), 1 - clipped * clipped))
    return (
        moments.withColumn("spearman_rho", rho)
        .withColumn("_t", F.when((dof > 0) & (F.abs(clipped) < 1), t))
        .withColumn("_p", t_p(F.col("_t"), dof))
        .select(
            F.col("n").alias("n_organisms"),
            "spearman_rho",
            F.when((dof > 0) & (F.abs(clipped) >= 1 - 1e-15), 0.0).otherwise(F.col("_p")).alias("spearman_p_value"),
        )
    )


def hypothesis_verdict(rho: Column, p: Column) -> Column:
    return (
        F.when((p < 0.1) & (rho > 0.5), "supported").when((p < 0.1) & (rho < -0.5), "rejected").otherwise("inconclusive")
    )


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def _two_group_moments(df: DataFrame, value: str, is_a: Column) -> DataFrame:
    v = F.col(value)
    parts = []
    for side, condition in (("a", is_a), ("b", ~is_a)):
        member = F.when(condition, v)
        parts += [
            F.count(member).alias(f"n_{side}"),
            F.avg(member).alias(f"mean_{side}"),
            F.var_samp(member).alias(f"var_{side}"),
        ]
    return df.agg(*parts)


def cohens_d(df: DataFrame, value: str, is_a: Column) -> DataFrame:
    """Standardised mean difference with pooled sample variance; too few rows or no spread raises."""
    m = _two_group_moments(df, value, is_a)
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = F.sqrt(((na - 1) * F.col("var_a") + (nb - 1) * F.col("var_b")) / (na + nb - 2))
    few = F.raise_error(F.lit("a group has fewer than two values")).cast("double")
    flat = F.raise_error(F.lit("both groups are constant, so the effect size is undefined")).cast("double")
    d = F.when((na < 2) | (nb < 2), few).when(pooled == 0, flat).otherwise((F.col("mean_a") - F.col("mean_b")) / pooled)
    return m.select("n_a", "n_b", d.alias("cohens_d"))


def t_tests(df: DataFrame, value: str, is_a: Column) -> DataFrame:
    """Student and Welch statistics of two groups with degrees of freedom and two-sided p."""
    m = _two_group_moments(df, value, is_a)
    na, nb, va, vb = F.col("n_a"), F.col("n_b"), F.col("var_a"), F.col("var_b")
    gap = F.col("mean_a") - F.col("mean_b")
    pooled = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
    student = F.try_divide(gap, F.sqrt(pooled * (1 / na + 1 / nb)))
    ea, eb = va / na, vb / nb
    welch = F.try_divide(gap, F.sqrt(ea + eb))
    welch_dof = F.try_divide((ea + eb) * (ea + eb), ea * ea / (na - 1) + eb * eb / (nb - 1))
    stats = m.select(
        "*",
        student.alias("student_t"),
        (na + nb - 2).cast("double").alias("student_dof"),
        welch.alias("welch_t"),
        welch_dof.alias("welch_dof"),
    )
    return stats.withColumn("student_p", t_p(F.col("student_t"), F.col("student_dof"))).withColumn(
        "welch_p", t_p(F.col("welch_t"), F.col("welch_dof"))
    )


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """Median-centred Levene statistic over the groups of ``group`` and its p.

    A test compares a handful of groups, so their medians travel as one small map and rows stay where they are.
    """
    table = medians(df, value, group).agg(F.map_from_entries(F.collect_list(F.struct(group, "median"))).alias("m"))
    centre = F.try_element_at("_m", F.col(group))
    gaps = df.withColumn("_m", table.scalar()).withColumn("_z", F.abs(F.col(value) - centre))
    cells = gaps.groupBy(group).agg(
        F.count("_z").alias("n"), F.avg("_z").alias("m"), F.var_pop("_z").alias("v")
    )
    grand = cells.agg(
        F.count("*").cast("double").alias("k"),
        F.sum("n").cast("double").alias("n_all"),
        F.sum(F.col("n") * F.col("m")).alias("s"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
    )
    between = F.col("s2") - F.col("s") * F.col("s") / F.col("n_all")
    w = F.try_divide((F.col("n_all") - F.col("k")) * between, (F.col("k") - 1) * F.col("within"))
    return grand.select(
        w.alias("levene_w"), (F.col("k") - 1).alias("dof_between"), (F.col("n_all") - F.col("k")).alias("dof_within")
    ).withColumn("levene_p", f_p(F.col("levene_w"), F.col("dof_between"), F.col("dof_within")))


def chosen_t_test(df: DataFrame, value: str, group: str, a: str, alpha: float = 0.05) -> DataFrame:
    """Levene's test picks Student (equal variances not rejected) or Welch."""
    variances = levene(df, value, group).select("levene_w", "levene_p")
    verdict = variances.select(F.struct("levene_w", "levene_p").alias("s")).scalar()
    tests = t_tests(df, value, F.col(group) == a).withColumn("_s", verdict)
    equal = F.col("levene_p") >= alpha
    return tests.select("*", "_s.levene_w", "_s.levene_p").select(
        "n_a",
        "n_b",
        "levene_w",
        "levene_p",
        equal.alias("equal_variance"),
        F.when(equal, F.col("student_t")).otherwise(F.col("welch_t")).alias("t_stat"),
        F.when(equal, F.col("student_p")).otherwise(F.col("welch_p")).alias("t_p_value"),
    )


def normality_k2(df: DataFrame, value: str) -> DataFrame:
    """Omnibus skewness-kurtosis statistic (D'Agostino and Pearson 1973) and its p, for 8 rows or more."""
    m = df.agg(
        F.count(value).cast("double").alias("n"),
        F.skewness(value).alias("g1"),
        (F.kurtosis(value) + 3).alias("b2"),
    ).where("n >= 8")
    n, g1, b2 = F.col("n"), F.col("g1"), F.col("b2")
    # Skewness part: a Johnson SU approximation to the null distribution of g1.
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    scaled = y / F.sqrt(2 / (w2 - 1))
    z_skew = delta * F.asinh(scaled)
    # Kurtosis part: a cube-root transformation.
    mean_b2 = 3 * (n - 1) / (n + 1)
    var_b2 = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - mean_b2) / F.sqrt(var_b2)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    lever = 1 - 2 / (9 * a)
    base = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z_kurt = (lever - F.signum(base) * F.pow(F.abs(base), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    k2 = z_skew * z_skew + z_kurt * z_kurt
    return m.select(n.cast("long").alias("n"), z_skew.alias("z_skew"), z_kurt.alias("z_kurt"), k2.alias("k2")).withColumn(
        "p_value", F.exp(-F.col("k2") / 2)
    )


def ranks_with_ties(df: DataFrame, value: str, name: str = "avg_rank") -> DataFrame:
    """Every row with the average rank of its value."""
    return df.join(average_ranks(df.where(F.col(value).isNotNull()), value, name), value, "left")


def empirical_cdf(df: DataFrame, value: str, group: str) -> DataFrame:
    """Distinct values of each group with the fraction of its rows that are no larger."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("_n"))
    upto = running(counts, [F.col(value)], {"_upto": ("sum", F.col("_n"))}, [group])
    totals = upto.groupBy(group).agg(F.sum("_n").alias("_total"))
    return join_groups(upto, totals, [group]).select(
        group, value, F.col("_n").alias("n_rows"), (F.col("_upto") / F.col("_total")).alias("cume_dist")
    )
