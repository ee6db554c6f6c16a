"""Bootstrap bands and intervals of ROC and precision-recall curves.

A resample of n rows is a multinomial draw over tied score groups. Groups are split into blocks of adjacent scores, and the draw is
made in two steps that are exact together: block sizes first, then groups within each block. Each task
needs its own block only, and the same seed gives it the same draw in both passes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import freeze


class _Draws:
    """Weights of one block under each replicate."""

    def __init__(self, seed: int, block_sizes: np.ndarray, block: int, rows: pd.DataFrame):
        self.seed, self.block, self.sizes = seed, block, block_sizes
        cells = np.concatenate([rows["n_pos"].to_numpy(float), rows["n_neg"].to_numpy(float)])
        self.shares = cells / cells.sum()

    def weights(self, replicate: int) -> tuple[np.ndarray, np.ndarray]:
        total = self.sizes.sum()
        per_block = np.random.default_rng([self.seed, replicate]).multinomial(int(total), self.sizes / total)
        own = np.random.default_rng([self.seed, replicate, self.block + 1])
        drawn = own.multinomial(per_block[self.block], self.shares)
        half = len(drawn) // 2
        return drawn[:half], drawn[half:]


def bootstrap_curves(
    df: DataFrame,
    label: str = "y",
    score: str = "score",
    n_bootstrap: int = 2000,
    ci: float = 0.95,
    seed: int = 0,
    grid_size: int = 200,
) -> tuple[DataFrame, DataFrame]:
    """``(bands, areas)`` of the ROC and PR curves over ``n_bootstrap`` resamples.

    ``bands`` has (curve, grid_index, grid_x, y_lower, y_upper) and ``areas`` has (metric, lower, upper, n_valid).
    Resamples with one class only are left out; when none is valid the job fails.
    """
    groups = df.groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg")
    )
    blocks = freeze(
        groups.select(F.col(score).cast("double").alias("score"), "n_pos", "n_neg")
        .repartitionByRange(F.desc("score"))
        .withColumn("block", F.spark_partition_id())
    )
    # One number per range partition.
    sized = blocks.groupBy("block").agg(F.sum(F.col("n_pos") + F.col("n_neg")).alias("n")).collect()
    sizes = np.zeros(max((r.block for r in sized), default=0) + 1)
    for r in sized:
        sizes[r.block] = r.n

    def totals(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("score", ascending=False)
        draws = _Draws(seed, sizes, int(key[0]), rows)
        out = np.empty((n_bootstrap, 2))
        for b in range(n_bootstrap):
            pos, neg = draws.weights(b)
            out[b] = pos.sum(), neg.sum()
        return pd.DataFrame(
            {"replicate": np.arange(n_bootstrap), "block": int(key[0]), "pos": out[:, 0], "neg": out[:, 1]}
        )

    per_block = freeze(
        blocks.groupBy("block").applyInPandas(totals, "replicate int, block int, pos double, neg double")
    )
    # At most one row per range partition and replicate.
    whole = Window.partitionBy("replicate")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_block.select(
        "replicate",
        "block",
        F.coalesce(F.sum("pos").over(earlier), F.lit(0.0)).alias("pos_before"),
        F.coalesce(F.sum("neg").over(earlier), F.lit(0.0)).alias("neg_before"),
        F.sum("pos").over(whole).alias("pos_all"),
        F.sum("neg").over(whole).alias("neg_all"),
        (F.col("block") == F.max("block").over(whole)).alias("is_last"),
    ).where("pos_all > 0 AND neg_all > 0")

    last = grid_size - 1

    def grid_part(x: np.ndarray, y: np.ndarray, is_last: bool) -> tuple[np.ndarray, np.ndarray]:
        first = int(np.ceil(x[0] * last - 1e-9))
        stop = last if is_last else int(np.ceil(x[-1] * last - 1e-9)) - 1
        index = np.arange(max(first, 0), stop + 1)
        return index, np.interp(index / last, x, y)

    def curves(key: tuple, rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("score", ascending=False)
        draws = _Draws(seed, sizes, int(key[0]), rows)
        parts: list[pd.DataFrame] = []
        for s in starts.itertuples(index=False):
            pos, neg = draws.weights(int(s.replicate))
            used = (pos + neg) > 0
            tp = np.concatenate(([s.pos_before], s.pos_before + np.cumsum(pos[used])))
            fp = np.concatenate(([s.neg_before], s.neg_before + np.cumsum(neg[used])))
            tpr, fpr = tp / s.pos_all, fp / s.neg_all
            seen = tp + fp
            precision = np.where(seen > 0, tp / np.maximum(seen, 1), 1.0)
            step = np.diff(tpr)
            areas = {
                "roc_auc": float(np.sum(np.diff(fpr) * (tpr[1:] + tpr[:-1]) / 2)),
                "pr_auc_trapz": float(np.sum(step * (precision[1:] + precision[:-1]) / 2)),
                "average_precision": float(np.sum(step * precision[1:])),
            }
            names, index, value = list(areas), [-1] * len(areas), list(areas.values())
            for name, x, y in (("roc", fpr, tpr), ("pr", tpr, precision)):
                at, height = grid_part(x, y, bool(s.is_last))
                names += [name] * len(at)
                index += at.tolist()
                value += height.tolist()
            parts.append(
                pd.DataFrame({"replicate": int(s.replicate), "what": names, "grid_index": index, "value": value})
            )
        columns = ["replicate", "what", "grid_index", "value"]
        return pd.concat(parts) if parts else pd.DataFrame(columns=columns)

    drawn = freeze(
        blocks.groupBy("block")
        .cogroup(placed.groupBy("block"))
        .applyInPandas(curves, "replicate int, what string, grid_index int, value double")
    )
    low, high = (1 - ci) / 2, 1 - (1 - ci) / 2
    bounds = [F.percentile("value", F.lit(low)), F.percentile("value", F.lit(high))]
    bands = (
        drawn.where("grid_index >= 0")
        .groupBy(F.col("what").alias("curve"), "grid_index")
        .agg(bounds[0].alias("y_lower"), bounds[1].alias("y_upper"))
        .withColumn("grid_x", F.col("grid_index") / last)
    )
    per_replicate = drawn.where("grid_index < 0").groupBy("what", "replicate").agg(F.sum("value").alias("value"))
    areas = per_replicate.groupBy(F.col("what").alias("metric")).agg(
        bounds[0].alias("lower"), bounds[1].alias("upper"), F.count("*").alias("n_valid")
    )
    if drawn.isEmpty():
        raise RuntimeError("no resample holds both labels")
    return bands, areas
