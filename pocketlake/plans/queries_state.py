"""Registered queries: ledger, resume, streaming, classifiers, user functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from ..functions.scorers import RuleScorer, per_item, per_item_isolated
from ..operators import learning, ledger
from ..runtime import freeze, scratch_path
from ..streaming import incremental
from . import domain
from .oracle_views import class_sql, composite_sql, oracle
from .queries_comparative import rounded
from .registry import query

_LEDGER_COLUMNS = ("uniprot_id", "organism", "analysis_results", "seq", "pipeline_version", "params_hash")


@query("ledger_latest", oracle(f"SELECT {', '.join(_LEDGER_COLUMNS)} FROM v_ledger", "v_ledger"))
def ledger_latest(spark, sf):
    return ledger.latest_wins(domain.ledger_events(spark, sf)).select(*_LEDGER_COLUMNS)


@query(
    "ledger_batch_upsert",
    oracle(f"SELECT {', '.join(_LEDGER_COLUMNS)} FROM v_ledger", "v_ledger"),
)
def ledger_batch_upsert(spark, sf):
    """Two batches appended to a ledger folder, compacted, then read back."""
    store = ledger.Ledger(spark, scratch_path(spark, "ledger"))
    events = domain.ledger_events(spark, sf)
    store.upsert(events.where("seq % 2 = 1"))
    store.upsert(events.where("seq % 2 = 0"))
    store.compact()
    return store.rows().select(*_LEDGER_COLUMNS)


@query(
    "ledger_lookup",
    oracle(
        """SELECT uniprot_id, CAST(regexp_extract(analysis_results, '[0-9]+') AS INTEGER) AS k, seq FROM v_ledger
           WHERE pipeline_version = '1' AND params_hash = 'a' AND organism = 'click'""",
        "v_ledger",
    ),
)
def ledger_lookup(spark, sf):
    rows = _stored(spark, sf).get("1", "a", "click")
    return rows.select("uniprot_id", F.from_json("analysis_results", "k INT")["k"].alias("k"), "seq")


def _stored(spark, sf) -> ledger.Ledger:
    """A ledger folder that holds all events."""
    store = ledger.Ledger(spark, scratch_path(spark, "ledger"))
    store.upsert(domain.ledger_events(spark, sf))
    return store


@query(
    "ledger_invalidate",
    oracle(
        """SELECT count(*) FILTER (WHERE pipeline_version != '1' OR params_hash != 'a') AS deleted,
             count(*) FILTER (WHERE pipeline_version = '1' AND params_hash = 'a') AS kept FROM v_ledger""",
        "v_ledger",
    ),
)
def ledger_invalidate(spark, sf):
    store = _stored(spark, sf)
    gone = store.invalidate("1", "a")
    return store.current().agg(F.lit(gone).cast("long").alias("deleted"), F.count("*").alias("kept"))


@query(
    "resume_anti",
    oracle(
        """SELECT DISTINCT protein_id FROM v_organisms WHERE CAST(protein_id AS VARCHAR) NOT IN
             (SELECT uniprot_id FROM v_events_ledger WHERE pipeline_version = '1')""",
        "v_organisms",
        "v_events_ledger",
    ),
)
def resume_anti(spark, sf):
    items = domain.organisms(spark, sf).select("protein_id", F.col("protein_id").cast("string").alias("uniprot_id"))
    done = domain.ledger_events(spark, sf).where("pipeline_version = '1'")
    return ledger.remaining(items, done).select("protein_id").distinct()


@query(
    "cache_aside",
    oracle(
        """WITH have AS (SELECT uniprot_id, analysis_results FROM v_ledger WHERE pipeline_version = '1' AND params_hash = 'a')
        SELECT uniprot_id, analysis_results, true AS cached FROM have WHERE uniprot_id IN (SELECT protein_id::VARCHAR FROM v_organisms)
        UNION ALL SELECT DISTINCT protein_id::VARCHAR, 'computed ' || protein_id, false FROM v_organisms
        WHERE protein_id::VARCHAR NOT IN (SELECT uniprot_id FROM have)""",
        "v_ledger",
        "v_organisms",
    ),
)
def cache_aside(spark, sf):
    items = domain.organisms(spark, sf).select(F.col("protein_id").cast("string").alias("uniprot_id")).distinct()

    def compute(todo):
        return todo.select(
            "uniprot_id", F.lit(None).cast("string").alias("organism"), F.concat(F.lit("computed "), "uniprot_id").alias("analysis_results"),
            F.lit("2030-01-01").cast("timestamp").alias("timestamp"), F.lit(1 << 60).alias("seq"), F.lit("1").alias("pipeline_version"), F.lit("a").alias("params_hash"),
        )

    rows = _stored(spark, sf).compute_missing(items, compute, "1", "a")
    return rows.select("uniprot_id", "analysis_results", (~F.col("analysis_results").startswith("computed ")).alias("cached"))


@query(
    "download_resume_status",
    """SELECT event_id % 3 AS proteome, CAST(user_id AS VARCHAR) AS uniprot_id,
         CASE WHEN max_by(event_type, (ts, event_id)) = 'error' THEN 'failed' ELSE 'completed' END AS status
       FROM events GROUP BY ALL""",
)
def download_resume_status(spark, sf):
    rows = domain.table(spark, sf, "events").select(
        (F.col("event_id") % 3).alias("proteome"),
        F.col("user_id").cast("string").alias("uniprot_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("seq"),
    )
    return ledger.latest_status(rows).select("proteome", "uniprot_id", "status")


@query(
    "checked_resume_state",
    """SELECT CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL""",
)
def checked_resume_state(spark, sf):
    states = domain.table(spark, sf, "events").select(F.col("props").alias("value"))
    return ledger.checked_state(states, "k INT").groupBy("k").agg(F.count("*").alias("n"))


#: Rows of a landed file, so that the task that writes one is of one size for any table.
LANDED_ROWS = 500_000


def _pocket_stream(spark, sf, cut_by="l_partkey"):
    """The pocket source as a stream of four micro-batches; rows with one ``cut_by`` are in one file."""
    rows = domain.table(spark, sf, "lineitem")
    folder = scratch_path(spark, "landing")
    per_batch = math.ceil(rows.count() / (4 * LANDED_ROWS)) or 1
    rows.repartition(4 * per_batch, cut_by).write.parquet(folder)
    raw = incremental.read_new_files(spark, folder, rows.schema, files_per_batch=per_batch)
    return raw.select(
        F.col("l_orderkey").alias("structure_id"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("pocket_id"),
        (F.col("l_extendedprice") / 100).alias("volume"),
        (F.col("l_discount") * 200).alias("depth"),
        F.col("l_quantity").alias("sasa"),
        F.col("l_linenumber").alias("basic_residues"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") % 3 == 0), None)
        .otherwise(F.col("l_tax") * 100 - 1)
        .alias("electrostatic_potential"),
    )


@query(
    "stream_screen",
    oracle(
        """SELECT DISTINCT structure_id, pocket_id FROM v_scored_rows WHERE composite_score >= 0.60::DOUBLE AND basic_residues >= 4
             AND sasa <= 10 AND volume BETWEEN 300 AND 800""",
        "v_scored_rows",
    ),
)
def stream_screen(spark, sf):
    sink, state = scratch_path(spark, "hits"), scratch_path(spark, "state")
    keys = ["structure_id", "pocket_id"]
    incremental.run_available(incremental.screen(_pocket_stream(spark, sf)), incremental.write_once(keys, sink), state)
    return spark.read.parquet(sink).select(*keys)


@query("stream_distinct_ids", oracle("SELECT DISTINCT structure_id FROM v_pocket_rows", "v_pocket_rows"))
def stream_distinct_ids(spark, sf):
    sink, state = scratch_path(spark, "ids"), scratch_path(spark, "state")
    ids = incremental.distinct_ids(_pocket_stream(spark, sf).select("structure_id"), ["structure_id"])
    incremental.run_available(ids, incremental.write_once(["structure_id"], sink), state)
    return spark.read.parquet(sink).select("structure_id")


@query(
    "stream_top_hits",
    oracle(
        """SELECT structure_id, pocket_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY structure_id
             ORDER BY composite_score DESC, pocket_id, volume) AS rank FROM v_scored_rows
             WHERE composite_score >= 0.60::DOUBLE AND basic_residues >= 4 AND sasa <= 10 AND volume BETWEEN 300 AND 800) WHERE rank <= 3""",
        "v_scored_rows",
    ),
)
def stream_top_hits(spark, sf):
    sink, state = scratch_path(spark, "top"), scratch_path(spark, "state")
    order = [F.desc("composite_score"), F.asc("pocket_id"), F.asc("volume")]
    writer = incremental.top_hits_per_batch(["structure_id"], order, 3, sink)
    # The best of a batch are the best of a structure where a structure arrives whole.
    incremental.run_available(incremental.screen(_pocket_stream(spark, sf, "l_orderkey")), writer, state)
    return spark.read.parquet(sink).select("structure_id", "pocket_id", "rank")


@query(
    "class_balance",
    oracle("SELECT label, count(*) AS n FROM v_features GROUP BY label", "v_features"),
)
def class_balance(spark, sf):
    return learning.class_counts(domain.features(spark, sf))


@query(
    "median_imputation",
    oracle(
        """SELECT pdb_id, pocket_id, coalesce(plddt_confidence,
             (SELECT quantile_disc(plddt_confidence, 0.5) FROM v_features)) AS plddt_confidence FROM v_features""",
        "v_features",
    ),
)
def median_imputation(spark, sf):
    rows = learning.imputed(domain.features(spark, sf))
    return rows.select("pdb_id", "pocket_id", F.col("plddt_confidence_imp").alias("plddt_confidence"))


@query(
    "group_fold_leak",
    oracle("SELECT 0::BIGINT AS leaking, count(DISTINCT pdb_id) AS structures, count(*) AS rows FROM v_features", "v_features"),
)
def group_fold_leak(spark, sf):
    folded = learning.grouped_folds(domain.features(spark, sf), 5)
    leaks = learning.fold_leaks(folded).agg(F.count("*").alias("leaking"))
    return folded.agg(F.countDistinct("pdb_id").alias("structures"), F.count("*").alias("rows")).withColumn("leaking", leaks.scalar())


@query(
    "grouped_split_sizes",
    oracle(
        """WITH l AS (SELECT pdb_id, max(label) AS label FROM v_features GROUP BY pdb_id)
        SELECT label, ceil(count(*) * 0.2)::BIGINT AS n_test, count(*) - ceil(count(*) * 0.2)::BIGINT AS n_train FROM l GROUP BY label""",
        "v_features",
    ),
)
def grouped_split_sizes(spark, sf):
    split = learning.grouped_split(domain.features(spark, sf))
    per = split.groupBy("pdb_id").agg(F.max("label").alias("label"), F.max("is_test").alias("is_test"))
    return per.groupBy("label").agg(F.count_if("is_test").alias("n_test"), F.count_if(~F.col("is_test")).alias("n_train"))


@query(
    "stratified_fold_sizes",
    oracle(
        """WITH n AS (SELECT label, count(*) AS n FROM v_features GROUP BY label)
        SELECT label, fold::INTEGER AS fold, n // 5 + (fold < n % 5)::INT AS rows FROM n, range(5) r(fold)""",
        "v_features",
    ),
)
def stratified_fold_sizes(spark, sf):
    folded = learning.stratified_folds(domain.features(spark, sf), 5, ["pdb_id", "pocket_id"])
    return folded.groupBy("label", "fold").agg(F.count("*").alias("rows"))


@query(
    "rule_baseline",
    oracle(
        f"""SELECT structure_id AS pdb_id, pocket_id, round({composite_sql()}, 8) AS rule_score FROM v_pockets""",
        "v_pockets",
    ),
)
def rule_baseline(spark, sf):
    scored = learning.rule_baseline(domain.features(spark, sf))
    return scored.select("pdb_id", "pocket_id", F.round("rule_score", 8).alias("rule_score"))


def _split(spark, sf):
    return freeze(learning.grouped_split(freeze(domain.features(spark, sf))))


def _forest(train, **grid):
    return learning.fit(train, "random_forest", grid=grid or {"numTrees": [20], "maxDepth": [6]}, folds=3)[0]


@query("forest_scores")
def forest_scores(spark, sf):
    split = _split(spark, sf)
    scored = learning.predict(_forest(split.where("NOT is_test")), split.where("is_test"))
    return scored.select("pdb_id", "pocket_id", "label", F.round("probability_cryptic", 6).alias("probability_cryptic"))


@query("boosted_scores")
def boosted_scores(spark, sf):
    split = _split(spark, sf)
    model, _ = learning.fit(split.where("NOT is_test"), "gradient_boosting", grid={"maxIter": [10], "maxDepth": [3]})
    scored = learning.predict(model, split.where("is_test"))
    return scored.select("pdb_id", "pocket_id", "label", F.round("probability_cryptic", 6).alias("probability_cryptic"))


@query("grid_search_best")
def grid_search_best(spark, sf):
    train = _split(spark, sf).where("NOT is_test")
    _, best = learning.fit(train, "random_forest", grid={"numTrees": [5, 10], "maxDepth": [3]}, folds=2)
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(best.items())], "param string, value double")


@query("method_benchmark")
def method_benchmark(spark, sf):
    split = _split(spark, sf)
    scored = learning.predict(_forest(split.where("NOT is_test")), split.where("is_test"))
    both = freeze(learning.rule_baseline(scored))
    table = learning.benchmark(both, {"ML (random_forest)": "probability_cryptic", "Threshold scoring": "rule_score"})
    return rounded(table, "test_roc_auc", "test_pr_auc", "test_mcc")


@query(
    "roc_export",
    oracle(
        f"""WITH s AS (SELECT 'Threshold scoring' AS model, {composite_sql()} AS score,
             CASE WHEN depth >= 12 AND sasa <= 20 THEN 1 ELSE 0 END AS y FROM v_pockets
           UNION ALL SELECT 'Area only', -sasa, CASE WHEN depth >= 12 AND sasa <= 20 THEN 1 ELSE 0 END FROM v_pockets),
        g AS (SELECT model, score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY ALL),
        c AS (SELECT model, score, sum(n) OVER w / sum(n) OVER (PARTITION BY model) AS fpr,
            sum(p) OVER w / sum(p) OVER (PARTITION BY model) AS tpr FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC))
        SELECT model, round(fpr, 4) AS fpr, round(tpr, 4) AS tpr FROM c
        UNION ALL SELECT DISTINCT model, 0, 0 FROM s""",
        "v_pockets",
    ),
)
def roc_export(spark, sf):
    scored = learning.rule_baseline(domain.features(spark, sf)).withColumn("area_score", -F.col("sasa"))
    points = learning.roc_export(scored, {"Threshold scoring": "rule_score", "Area only": "area_score"})
    return rounded(points, "fpr", "tpr", digits=4)


@query("feature_importance")
def feature_importance(spark, sf):
    split = _split(spark, sf)
    model = _forest(split.where("NOT is_test"))
    return rounded(learning.permutation_importance(model, split.where("is_test")), "importance")


@query(
    "per_item_function",
    oracle(
        "SELECT structure_id, pocket_id, floor(volume / greatest(sasa, 1.0) * 1e6::DOUBLE + 0.5::DOUBLE) AS ratio_ppm FROM v_pocket_rows",
        "v_pocket_rows",
    ),
)
def per_item_function(spark, sf):
    def ratio(batch: pd.DataFrame) -> pd.DataFrame:
        parts = (batch.volume / batch.sasa.clip(lower=1.0) * 1e6 + 0.5) // 1
        return batch.assign(ratio_ppm=parts)[["structure_id", "pocket_id", "ratio_ppm"]]

    rows = domain.pocket_rows(spark, sf).select("structure_id", "pocket_id", "volume", "sasa")
    return per_item(rows, ratio, "structure_id long, pocket_id long, ratio_ppm double")


@query(
    "per_item_failures",
    oracle(
        """SELECT structure_id, pocket_id,
          CASE WHEN volume >= 12 THEN floor(volume / greatest(sasa, 1.0) * 1e6::DOUBLE + 0.5::DOUBLE) END AS ratio_ppm,
          CASE WHEN volume >= 12 THEN NULL ELSE 'ValueError: pocket too small' END AS error FROM v_pocket_rows""",
        "v_pocket_rows",
    ),
)
def per_item_failures(spark, sf):
    """A function that fails on small pockets: every other pocket has its result, and each failure is listed."""

    def ratio(batch: pd.DataFrame) -> pd.DataFrame:
        if not (batch.volume >= 12).all():
            raise ValueError("pocket too small")
        parts = (batch.volume / batch.sasa.clip(lower=1.0) * 1e6 + 0.5) // 1
        return batch.assign(ratio_ppm=parts)[["structure_id", "pocket_id", "ratio_ppm"]]

    rows = domain.pocket_rows(spark, sf).select("structure_id", "pocket_id", "volume", "sasa")
    return per_item_isolated(rows, ratio, "structure_id long, pocket_id long, ratio_ppm double", ("structure_id", "pocket_id"))


@query(
    "pluggable_scorer",
    oracle(
        f"""SELECT structure_id, pocket_id, round(s, 8) AS composite_score, {class_sql('s')} AS classification FROM (
          SELECT *, {composite_sql(1, 0, 0, 0, 0)} AS s FROM v_pocket_rows)""",
        "v_pocket_rows",
    ),
)
def pluggable_scorer(spark, sf):
    weights = {"volume": 1.0, "depth": 0.0, "sasa": 0.0, "basic_residues": 0.0, "electrostatics": 0.0}
    scored = RuleScorer(weights).score(domain.pocket_rows(spark, sf))
    return scored.select("structure_id", "pocket_id", F.round("composite_score", 8).alias("composite_score"), "classification")
