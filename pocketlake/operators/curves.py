"""ROC and precision-recall curves over tied score groups, their areas, and curve interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import join_groups, running


def score_curve(df: DataFrame, label: str = "y", score: str = "score", partition: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score, best first: own counts, running TP/FP and the totals.

    Rows are grouped by score before anything is ordered, so ties share one point and a score held by a
    third of the rows is summed map-side. Labels other than 0 and 1, or a missing class, raise.
    """
    y = F.col(label)
    groups = df.groupBy(*partition, score).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("n_pos"),
        F.sum(F.when(y == 0, 1).otherwise(0)).cast("long").alias("n_neg"),
        F.sum(F.when(y.isin(0, 1), 0).otherwise(1)).cast("long").alias("_odd"),
    )
    curve = running(
        groups,
        [F.desc(score)],
        {"tp": ("sum", F.col("n_pos")), "fp": ("sum", F.col("n_neg"))},
        partition,
    )
    totals = curve.groupBy(*partition).agg(
        F.sum("n_pos").alias("tot_pos"), F.sum("n_neg").alias("tot_neg"), F.sum("_odd").alias("_odd")
    )
    valid = (F.col("tot_pos") > 0) & (F.col("tot_neg") > 0) & (F.col("_odd") == 0)
    wrong = F.raise_error(F.lit("labels must be 0 and 1, and both must occur")).cast("long")
    totals = totals.withColumn("tot_pos", F.when(valid, F.col("tot_pos")).otherwise(wrong)).drop("_odd")
    if partition:
        return join_groups(curve.drop("_odd"), totals, list(partition))
    sums = totals.select(F.struct("tot_pos", "tot_neg").alias("s")).scalar()
    return curve.withColumn("_s", sums).select("*", "_s.tot_pos", "_s.tot_neg").drop("_s", "_odd")


def _rates() -> dict[str, Column]:
    """The curve point of a row and the one before it; the latter follows from the row's own counts."""
    tp, fp = F.col("tp"), F.col("fp")
    before_tp, before_fp = tp - F.col("n_pos"), fp - F.col("n_neg")
    seen, seen_before = tp + fp, before_tp + before_fp
    return {
        "fpr": fp / F.col("tot_neg"),
        "tpr": tp / F.col("tot_pos"),
        "fpr0": before_fp / F.col("tot_neg"),
        "tpr0": before_tp / F.col("tot_pos"),
        "precision": tp / seen,
        "precision0": F.when(seen_before == 0, 1.0).otherwise(F.try_divide(before_tp, seen_before)),
    }


def roc_points(curve: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) with the (0, 0) start; the last score group is the (1, 1) end."""
    r = _rates()
    points = curve.select(*partition, F.col("score").alias("threshold"), r["fpr"].alias("fpr"), r["tpr"].alias("tpr"))
    starts = curve.select(*partition).distinct() if partition else curve.agg(F.count("*").alias("_n"))
    origin = starts.select(
        *partition, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(points)


def pr_points(curve: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """(threshold, recall, precision) with the (0, 1) start and the (1, base rate) end."""
    r = _rates()
    points = curve.select(
        *partition, F.col("score").alias("threshold"), r["tpr"].alias("recall"), r["precision"].alias("precision")
    )
    none = F.lit(None).cast("double").alias("threshold")
    ends = curve.groupBy(*partition).agg(
        (F.max("tot_pos") / (F.max("tot_pos") + F.max("tot_neg"))).alias("_base")
    )
    start = ends.select(*partition, none, F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    end = ends.select(*partition, none, F.lit(1.0).alias("recall"), F.col("_base").alias("precision"))
    return start.unionByName(points).unionByName(end)


def curve_areas(curve: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """ROC AUC, trapezoid PR area and step average precision.

    Every segment knows both its ends, so the areas are plain sums. The PR end points (0, 1) and (1, base rate) add
    no further width once ties share a point, so the area with and without them is the same.
    """
    r = _rates()
    roc = (r["fpr"] - r["fpr0"]) * (r["tpr"] + r["tpr0"]) / 2
    pr = (r["tpr"] - r["tpr0"]) * (r["precision"] + r["precision0"]) / 2
    step = (r["tpr"] - r["tpr0"]) * r["precision"]
    return curve.groupBy(*partition).agg(
        F.sum(roc).alias("roc_auc"),
        F.sum(pr).alias("pr_auc_trapz"),
        F.sum(step).alias("average_precision"),
    )


def mcc(df: DataFrame, label: str = "y", score: str = "score", threshold: float = 0.5, partition: Sequence[str] = ()) -> DataFrame:
    """Matthews correlation at a cut-off; a zero denominator gives 0."""
    said, truth = F.col(score) >= threshold, F.col(label) == 1
    counts = df.groupBy(*partition).agg(
        F.count_if(said & truth).cast("double").alias("tp"),
        F.count_if(said & ~truth).cast("double").alias("fp"),
        F.count_if(~said & truth).cast("double").alias("fn"),
        F.count_if(~said & ~truth).cast("double").alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    below = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    value = F.when(below == 0, 0.0).otherwise(F.try_divide(tp * tn - fp * fn, below))
    return counts.select(*partition, value.alias("mcc"))


def _with_previous(points: DataFrame, x: str, y: str, seq: str, partition: Sequence[str]) -> DataFrame:
    """Each point with the one before it along (x, seq)."""
    here = F.struct(F.col(x).alias("x"), F.col(seq).alias("s"), F.col(y).alias("y"))
    return running(points, [F.col(x), F.col(seq)], {"_prev": ("max", here)}, partition, inclusive=False)


def trapezoid_area(points: DataFrame, x: str, y: str, seq: str, partition: Sequence[str] = ()) -> DataFrame:
    """Trapezoid integral of a curve given as points ordered by (x, seq)."""
    pairs = _with_previous(points, x, y, seq, partition).where("_prev IS NOT NULL")
    part = (F.col(x) - F.col("_prev.x")) * (F.col(y) + F.col("_prev.y")) / 2
    return pairs.groupBy(*partition).agg(F.sum(part).alias("area"))


def interpolate_on_grid(
    points: DataFrame, x: str, y: str, seq: str, grid_size: int = 200, partition: Sequence[str] = ()
) -> DataFrame:
    """Linear interpolation of curves on the even grid 0..1, clamped at the ends.

    ``seq`` orders points that share an x; the last of them counts. Each segment emits the grid
    points it covers, so the output has ``grid_size`` rows per curve and nothing is searched.
    """
    last = grid_size - 1
    pairs = _with_previous(points, x, y, seq, partition)
    x1, y1, x0, y0 = F.col(x), F.col(y), F.col("_prev.x"), F.col("_prev.y")
    first = F.greatest(F.ceil(x0 * last - 1e-9), F.lit(0))
    stop = F.least(F.ceil(x1 * last - 1e-9) - 1, F.lit(last))
    inner = (
        pairs.where(F.col("_prev").isNotNull() & (x1 > x0) & (stop >= first))
        .withColumn("grid_index", F.explode(F.sequence(first.cast("int"), stop.cast("int"))))
        .select(
            *partition,
            "grid_index",
            (F.col("grid_index") / last).alias("grid_x"),
            (y0 + (y1 - y0) * (F.col("grid_index") / last - x0) / (x1 - x0)).alias("grid_y"),
        )
    )
    here = F.struct(F.col(x).alias("x"), F.col(seq).alias("s"), F.col(y).alias("y"))
    ends = points.groupBy(*partition).agg(F.min(here).alias("_first"), F.max(here).alias("_last"))

    def clamp(start: Column, stop_at: Column, value: Column) -> DataFrame:
        return (
            ends.where(start <= stop_at)
            .withColumn("grid_index", F.explode(F.sequence(start.cast("int"), stop_at.cast("int"))))
            .select(*partition, "grid_index", (F.col("grid_index") / last).alias("grid_x"), value.alias("grid_y"))
        )

    left = clamp(F.lit(0), F.ceil(F.col("_first.x") * last - 1e-9) - 1, F.col("_first.y"))
    right = clamp(F.greatest(F.ceil(F.col("_last.x") * last - 1e-9), F.lit(0)), F.lit(last), F.col("_last.y"))
    return left.unionByName(inner).unionByName(right)
