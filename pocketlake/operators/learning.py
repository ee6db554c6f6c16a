"""Classifier training, grouped folds, scoring and comparison with the rule score."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import composite_score
from ..plans.ordering import rank_rows
from ..runtime import freeze
from ..schemas import FEATURE_COLUMNS, require_columns
from .curves import curve_areas, mcc, roc_points, score_curve

# Feature name → pocket column.
FEATURES_FROM_POCKETS = {
    "pocket_depth": "depth",
    "sasa": "sasa",
    "electrostatic_potential": "electrostatic_potential",
    "n_basic_residues": "basic_residues",
    "pocket_volume": "volume",
    "plddt_confidence": "plddt_confidence",
}


def class_counts(features: DataFrame, label: str = "label") -> DataFrame:
    return features.groupBy(label).agg(F.count("*").alias("n"))


def checked_counts(features: DataFrame, label: str = "label") -> dict[int, int]:
    """Rows per class after the input checks: six features, labels 0 and 1, two rows or more of each."""
    require_columns(features, [*FEATURE_COLUMNS, label], "feature table")
    # Two labels pass; a third is enough to know the check fails.
    counts = {row[label]: row["n"] for row in class_counts(features, label).limit(3).collect()}
    if set(counts) != {0, 1}:
        raise ValueError("labels must be 0 and 1, and both must occur")
    if min(counts.values()) < 2:
        raise ValueError(f"each class needs two rows or more, found {counts}")
    return counts


def imputed(features: DataFrame) -> DataFrame:
    """Feature columns with NULL and NaN replaced by the column median."""
    model = Imputer(strategy="median", inputCols=list(FEATURE_COLUMNS), outputCols=[f"{c}_imp" for c in FEATURE_COLUMNS])
    return model.fit(features).transform(features)


def balanced_weights(features: DataFrame, counts: Mapping[int, int], label: str = "label") -> DataFrame:
    """Row weights that give both classes the same total."""
    total = sum(counts.values())
    return features.withColumn(
        "weight", F.when(F.col(label) == 1, total / (2.0 * counts[1])).otherwise(total / (2.0 * counts[0]))
    )


def classifier(model_type: str = "random_forest", seed: int = 42, weighted: bool = False, **params: Any) -> Pipeline:
    """Median imputation, assembly and the tree model as one pipeline."""
    inputs = [f"{c}_imp" for c in FEATURE_COLUMNS]
    if model_type == "random_forest":
        tree = RandomForestClassifier(labelCol="label", seed=seed, **params)
    elif model_type == "gradient_boosting":
        tree = GBTClassifier(labelCol="label", seed=seed, **params)
    else:
        raise ValueError("unknown model_type, use random_forest or gradient_boosting")
    if weighted:
        tree.setWeightCol("weight")
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=list(FEATURE_COLUMNS), outputCols=inputs),
            VectorAssembler(inputCols=inputs, outputCol="features"),
            tree,
        ]
    )


def prepared(pipeline: Pipeline, rows: DataFrame) -> tuple[list, DataFrame]:
    """The fitted stages before the tree, and the columns that the tree reads, kept until ``unpersist``.

    A tree reads its rows several times before it holds them in bins.
    """
    *stages, tree = pipeline.getStages()
    done = [stage.fit(rows) if isinstance(stage, Estimator) else stage for stage in stages]
    columns = ["features", tree.getLabelCol(), *([tree.getWeightCol()] if tree.isSet("weightCol") else [])]
    return done, PipelineModel(done).transform(rows).select(columns).persist(StorageLevel.MEMORY_AND_DISK)


def param_grid(pipeline: Pipeline, values: Mapping[str, Sequence[Any]] | None = None) -> list[dict]:
    """Grid over the tree stage; the default spans size, depth and leaf size (or step size when boosting)."""
    tree = pipeline.getStages()[-1]
    if values is None:
        if isinstance(tree, RandomForestClassifier):
            values = {"numTrees": [200, 500], "maxDepth": [8, 12, 16], "minInstancesPerNode": [1, 2]}
        else:
            values = {"maxIter": [200, 500], "maxDepth": [3, 6], "stepSize": [0.03, 0.1], "subsamplingRate": [0.8, 1.0]}
    builder = ParamGridBuilder()
    for name, choices in values.items():
        builder = builder.addGrid(tree.getParam(name), list(choices))
    return builder.build()


def stratified_folds(features: DataFrame, k: int, key: Sequence[str], label: str = "label", seed: int = 42) -> DataFrame:
    """Fold numbers 0..k−1 dealt in hash order within each label, so folds hold equal class shares."""
    order = [F.xxhash64(F.lit(seed), *key), *[F.asc(c) for c in key]]
    dealt = rank_rows(features.withColumn("_h", order[0]), [F.asc("_h"), *order[1:]], "_n", [label])
    return dealt.withColumn("fold", F.pmod(F.col("_n") - 1, F.lit(k)).cast("int")).drop("_n", "_h")


def grouped_folds(features: DataFrame, k: int, group: str = "pdb_id", seed: int = 42) -> DataFrame:
    """Fold numbers by structure hash: every row of a structure is in one fold, without a shuffle."""
    return features.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(k)).cast("int"))


def fold_leaks(folded: DataFrame, group: str = "pdb_id") -> DataFrame:
    """Structures that occur in more than one fold (none, if folds are right)."""
    return folded.groupBy(group).agg(F.countDistinct("fold").alias("n_folds")).where("n_folds > 1")


def grouped_split(features: DataFrame, test_size: float = 0.2, group: str = "pdb_id", seed: int = 42) -> DataFrame:
    """``is_test`` per row: whole structures, the same share of each structure label, in hash order."""
    # The ranges are sampled before they are written, so the structures' labels would be computed twice.
    labels = freeze(features.groupBy(group).agg(F.max("label").alias("_label")))
    hashed = labels.withColumn("_h", F.xxhash64(F.lit(seed), F.col(group)))
    ranked = rank_rows(hashed, [F.asc("_h"), F.asc(group)], "_n", ["_label"])
    sizes = ranked.groupBy("_label").agg(F.max("_n").alias("_size"))
    # One row per label, and labels are binary.
    split = ranked.join(F.broadcast(sizes), "_label").select(group, (F.col("_n") <= F.ceil(F.col("_size") * test_size)).alias("is_test"))
    return features.join(split, group)


def fit(
    features: DataFrame,
    model_type: str = "random_forest",
    *,
    key: Sequence[str] = ("pdb_id", "pocket_id"),
    grid: Mapping[str, Sequence[Any]] | None = None,
    folds: int = 5,
    balanced: bool = True,
    seed: int = 42,
    parallelism: int = 4,
) -> tuple[PipelineModel, dict[str, Any]]:
    """Grid search over stratified folds on average precision, refitted on all rows.

    Returns the model and its parameters. With one grid point there is nothing to choose, so no folds are run.
    """
    counts = checked_counts(features)
    k = min(folds, min(counts.values()))
    rows = balanced_weights(features, counts) if balanced else features
    pipeline = classifier(model_type, seed, weighted=balanced)
    points = param_grid(pipeline, grid)
    best, tree = 0, pipeline.getStages()[-1]
    if len(points) > 1:
        folded = freeze(stratified_folds(rows, k, key, seed=seed))
        evaluator = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderPR", numBins=0)
        metrics = [0.0] * len(points)
        for fold in range(k):
            # Imputation and assembly are the same for every point, so a fold is prepared once.
            stages, train = prepared(pipeline, folded.where(F.col("fold") != fold))
            held = PipelineModel(stages).transform(folded.where(F.col("fold") == fold)).select("features", "label")
            held = held.persist(StorageLevel.MEMORY_AND_DISK)
            with ThreadPool(min(parallelism, len(points))) as pool:
                models = tree.fitMultiple(train, points)
                for at, metric in pool.imap_unordered(lambda _: _measured(models, held, evaluator), points):
                    metrics[at] += metric / k
            train.unpersist()
            held.unpersist()
        best = max(range(len(points)), key=lambda i: metrics[i])
    stages, train = prepared(pipeline, rows)
    model = PipelineModel([*stages, tree.fit(train, points[best])])
    train.unpersist()
    return model, {param.name: value for param, value in points[best].items()}


def _measured(models: Iterator, held: DataFrame, evaluator: BinaryClassificationEvaluator) -> tuple[int, float]:
    at, model = next(models)
    return at, evaluator.evaluate(model.transform(held))


def predict(model: PipelineModel, features: DataFrame, name: str = "probability_cryptic") -> DataFrame:
    """All rows with the probability of class 1."""
    scored = model.transform(features.select("*"))
    added = [c for c in scored.columns if c not in features.columns]
    return scored.withColumn(name, vector_to_array("probability")[1]).drop(*[c for c in added if c != name])


def cross_predict(
    folded: DataFrame, model_type: str, params: Mapping[str, Any], *, weighted: bool = False, seed: int = 42
) -> DataFrame:
    """Out-of-fold probabilities: each fold is scored by a model fitted on the others."""
    folds = sorted(row["fold"] for row in folded.select("fold").distinct().collect())
    parts = []
    for fold in folds:
        model = classifier(model_type, seed, weighted, **params).fit(folded.where(F.col("fold") != fold))
        parts.append(predict(model, folded.where(F.col("fold") == fold)))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def rule_baseline(features: DataFrame, name: str = "rule_score") -> DataFrame:
    """Rule score over the classifier's feature columns."""
    return features.withColumn(
        name,
        composite_score(
            volume="pocket_volume",
            depth="pocket_depth",
            sasa="sasa",
            basic_residues=F.floor(F.col("n_basic_residues")),
            electrostatics="electrostatic_potential",
        ),
    )


def long_scores(scored: DataFrame, methods: Mapping[str, str], label: str = "label") -> DataFrame:
    """(method, y, score) rows from one column per method, in one pass."""
    entries = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("score")) for m, c in methods.items()])
    return scored.select(F.col(label).alias("y"), F.explode(entries).alias("_e")).select("y", "_e.method", "_e.score")


def benchmark(scored: DataFrame, methods: Mapping[str, str], label: str = "label") -> DataFrame:
    """ROC AUC, average precision and MCC per method."""
    rows = long_scores(scored, methods, label)
    areas = curve_areas(score_curve(rows, partition=["method"]), ["method"])
    return areas.join(mcc(rows, partition=["method"]), "method").select(
        "method",
        F.col("roc_auc").alias("test_roc_auc"),
        F.col("average_precision").alias("test_pr_auc"),
        F.col("mcc").alias("test_mcc"),
    )


def best_method(comparison: DataFrame, metric: str = "test_pr_auc") -> DataFrame:
    return comparison.agg(F.max_by("method", F.struct(metric, "method")).alias("best_method"), F.max(metric).alias(metric))


def roc_export(scored: DataFrame, methods: Mapping[str, str], label: str = "label") -> DataFrame:
    """ROC points of all methods in long form (model, fpr, tpr)."""
    curve = score_curve(long_scores(scored, methods, label), partition=["method"])
    return roc_points(curve, ["method"]).select(F.col("method").alias("model"), "fpr", "tpr")


def permutation_importance(
    model: PipelineModel, features: DataFrame, key: Sequence[str] = ("pdb_id", "pocket_id"), seed: int = 42
) -> DataFrame:
    """Loss of average precision when one feature is taken from another row, per feature.

    Rows get a random order once; feature f takes its value from the row a fixed stride further on.
    One join serves all six features.
    """
    rows = features.select(*key, "label", *FEATURE_COLUMNS).withColumn("_h", F.xxhash64(F.lit(seed), *key))
    ordered = freeze(rank_rows(rows, [F.asc("_h"), *[F.asc(c) for c in key]], "_n").drop("_h"))
    n = ordered.count()
    strides = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.lit(max(1, (i + 1) * n // (len(FEATURE_COLUMNS) + 1))).alias("by"))
            for i, c in enumerate(FEATURE_COLUMNS)
        ]
    )
    asked = ordered.withColumn("_s", F.explode(strides)).select(
        "*", F.col("_s.feature").alias("feature"), (F.pmod(F.col("_n") - 1 + F.col("_s.by"), F.lit(n)) + 1).alias("_from")
    )
    donors = ordered.select(F.col("_n").alias("_from"), F.struct(*FEATURE_COLUMNS).alias("_d"))
    swapped = asked.join(donors, "_from").select(
        "label",
        "feature",
        *[F.when(F.col("feature") == c, F.col(f"_d.{c}")).otherwise(F.col(c)).alias(c) for c in FEATURE_COLUMNS],
    )
    base = ordered.select("label", F.lit("(none)").alias("feature"), *FEATURE_COLUMNS)
    scored = predict(model, base.unionByName(swapped), "score").select(F.col("label").alias("y"), "score", "feature")
    areas = curve_areas(score_curve(scored, partition=["feature"]), ["feature"])
    # Seven rows from here on.
    full = areas.where("feature = '(none)'").select("average_precision").scalar()
    return (
        areas.withColumn("_full", full)
        .where("feature != '(none)'")
        .select("feature", (F.col("_full") - F.col("average_precision")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def tree_importances(model: PipelineModel) -> list[tuple[str, float]]:
    """Impurity importances of the fitted trees, largest first."""
    weights = model.stages[-1].featureImportances.toArray()
    return sorted(zip(FEATURE_COLUMNS, weights.tolist()), key=lambda item: -item[1])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def dataset_changed(current: DataFrame, previous: DataFrame) -> bool:
    """Whether the checksums of the training files differ from those kept with the model."""
    moved = current.select("path", "sha256").exceptAll(previous.select("path", "sha256"))
    lost = previous.select("path", "sha256").exceptAll(current.select("path", "sha256"))
    return not (moved.isEmpty() and lost.isEmpty())
