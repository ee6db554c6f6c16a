"""Ledger, streaming and classifiers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pocketlake.functions.scorers import ModelScorer, per_item_isolated, scorer_from_path
from pocketlake.operators import learning, ledger
from pocketlake.schemas import FEATURE_COLUMNS
from pocketlake.streaming import incremental

ROW = "uniprot_id string, organism string, analysis_results string, timestamp timestamp, seq long, pipeline_version string, params_hash string"


def rows(spark, *items):
    return spark.createDataFrame(items, "uniprot_id string, organism string, analysis_results string, t string, seq long, pipeline_version string, params_hash string").withColumn(
        "timestamp", F.col("t").cast("timestamp")
    )


def test_upsert_lookup_invalidate(spark, tmp_path):
    store = ledger.Ledger(spark, str(tmp_path / "ledger"))
    assert store.rows().count() == 0
    day = "2026-01-01"
    assert store.upsert(rows(spark, ("P1", "yeast", "old", day, 1, "v1", "h"), ("P1", "yeast", "new", day, 2, "v1", "h"), ("P2", "yeast", "x", day, 3, "v1", "h"))) == 3
    assert {r.uniprot_id: r.analysis_results for r in store.get("v1", "h", "yeast").collect()} == {"P1": "new", "P2": "x"}
    # The organism is not part of the key: an upsert under another one hides the row.
    store.upsert(rows(spark, ("P1", "human", "moved", "2026-01-02", 4, "v1", "h"), ("P1", "yeast", "y", day, 5, "v2", "h")))
    assert [r.uniprot_id for r in store.get("v1", "h", "yeast").collect()] == ["P2"]
    before = sorted(map(str, store.current().collect()))
    store.compact()
    assert sorted(map(str, store.rows().collect())) == before and store.rows().count() == 3
    assert store.invalidate("v2", "h") == 2
    assert [r.analysis_results for r in store.rows().collect()] == ["y"]


def test_invalidate_takes_odd_names_and_null(spark, tmp_path):
    store = ledger.Ledger(spark, str(tmp_path / "ledger"))
    day = "2026-01-01"
    store.upsert(rows(spark, ("P1", "y", "a", day, 1, "v2:beta/1", "h"), ("P2", "y", "b", day, 2, "v1", None), ("P3", "y", "c", day, 3, "v1", "h=%/x")))
    assert store.get("v1", "h=%/x").count() == 1
    assert store.invalidate("v1", "h=%/x") == 2
    assert [r.uniprot_id for r in store.rows().collect()] == ["P3"]
    store.upsert(rows(spark, ("P4", "y", "d", day, 4, "v2:beta/1", "h")))
    assert sorted(r.uniprot_id for r in store.rows().collect()) == ["P3", "P4"]
    store.compact()
    assert sorted(r.uniprot_id for r in store.rows().collect()) == ["P3", "P4"]
    assert store.invalidate("v9", "none") == 2 and store.rows().count() == 0


def test_append_during_compaction_stays(spark, tmp_path, monkeypatch):
    store = ledger.Ledger(spark, str(tmp_path / "ledger"))
    day = "2026-01-01"
    store.upsert(rows(spark, ("P1", "y", "a", day, 1, "v1", "h")))
    store.upsert(rows(spark, ("P1", "y", "b", day, 2, "v1", "h")))
    write = store._write

    def slow(frame, batch):
        write(frame, batch)
        monkeypatch.setattr(store, "_write", write)
        store.upsert(rows(spark, ("P2", "y", "late", day, 3, "v1", "h")))

    monkeypatch.setattr(store, "_write", slow)
    store.compact()
    assert {r.uniprot_id: r.analysis_results for r in store.rows().collect()} == {"P1": "b", "P2": "late"}


def test_lookup_prunes_to_one_version(spark, tmp_path, capsys):
    store = ledger.Ledger(spark, str(tmp_path / "ledger"))
    store.upsert(rows(spark, *[(f"P{i}", "y", "a", "2026-01-01", i, f"v{i % 3}", "h") for i in range(9)]))
    found = store.get("v1", "h")
    assert found.count() == 3
    found.explain("formatted")
    filters = [x for x in capsys.readouterr().out.splitlines() if "PartitionFilters" in x]
    assert filters and all("pipeline_version" in x and "params_hash" in x and "batch" in x for x in filters)


def test_second_run_computes_nothing(spark, tmp_path):
    store = ledger.Ledger(spark, str(tmp_path / "ledger"))
    items = spark.createDataFrame([(f"P{i}",) for i in range(8)], "uniprot_id string")
    calls = []

    def compute(todo):
        calls.append(todo.count())
        return todo.select(
            "uniprot_id", F.lit("yeast").alias("organism"), F.lit("{}").alias("analysis_results"), F.current_timestamp().alias("timestamp"),
            F.lit(1).alias("seq"), F.lit("v1").alias("pipeline_version"), F.lit("h").alias("params_hash"),
        )

    assert store.compute_missing(items, compute, "v1", "h").count() == 8
    assert store.compute_missing(items, compute, "v1", "h").count() == 8
    assert calls == [8, 0]


def test_corrupt_state_stops(spark):
    good = spark.createDataFrame([('{"processed": ["P1"]}',)], "value string")
    assert ledger.checked_state(good, "processed ARRAY<STRING>").collect()[0].processed == ["P1"]
    bad = spark.createDataFrame([("{not json",)], "value string")
    with pytest.raises(Exception, match="not valid JSON"):
        ledger.checked_state(bad, "processed ARRAY<STRING>").collect()


def test_stream_writes_each_id_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    pockets = spark.createDataFrame(
        [(i, 400.0, 16.0, 2.0, 6, 6.0) for i in range(6)], "structure_id long, volume double, depth double, sasa double, basic_residues int, electrostatic_potential double"
    )
    writer = incremental.write_once(["structure_id"], sink)

    def run():
        stream = incremental.screen(incremental.read_new_files(spark, source, pockets.schema))
        incremental.run_available(stream, writer, state)
        return spark.read.parquet(sink)

    pockets.write.mode("append").parquet(source)
    assert run().count() == 6
    pockets.withColumn("structure_id", F.col("structure_id") + 3).write.mode("append").parquet(source)
    assert sorted(r.structure_id for r in run().collect()) == list(range(9))
    assert run().count() == 9
    # A replayed batch overwrites its own folder and changes nothing.
    writer(incremental.screen(pockets), 0)
    assert spark.read.parquet(sink).count() == 9


@pytest.fixture(scope="module")
def features(spark):
    side = (F.col("id") % 2).cast("int")
    noise = F.pmod(F.xxhash64("id"), F.lit(100)) / 100
    return spark.range(120).select(
        F.concat(F.lit("s"), (F.col("id") % 30).cast("string")).alias("pdb_id"),
        F.col("id").alias("pocket_id"),
        (10 + 8 * side + noise).alias("pocket_depth"),
        (40 - 35 * side + noise).alias("sasa"),
        F.when(F.col("id") % 7 != 0, 5 * side + noise).alias("electrostatic_potential"),
        (2 + 3 * side).cast("double").alias("n_basic_residues"),
        (300 + 200 * side + noise).alias("pocket_volume"),
        F.lit(80.0).alias("plddt_confidence"),
        side.alias("label"),
    )


def test_input_checks(spark, features):
    assert learning.checked_counts(features) == {0: 60, 1: 60}
    with pytest.raises(ValueError, match="lacks columns: sasa"):
        learning.checked_counts(features.drop("sasa"))
    with pytest.raises(ValueError, match="labels must be 0 and 1"):
        learning.checked_counts(features.where("label = 1"))
    with pytest.raises(ValueError, match="two rows or more"):
        learning.checked_counts(features.where("label = 1 OR pocket_id = 0"))


def test_split_keeps_structures_together(features):
    split = learning.grouped_split(features)
    per = split.groupBy("pdb_id").agg(F.countDistinct("is_test").alias("n"), F.max("is_test").alias("t"), F.max("label").alias("l")).collect()
    assert {r.n for r in per} == {1}
    assert sum(r.t for r in per if r.l == 1) == 3 and sum(r.t for r in per if r.l == 0) == 3
    assert learning.fold_leaks(learning.grouped_folds(features, 5)).count() == 0


def test_train_save_load_score(spark, features, tmp_path):
    model, best = learning.fit(features, grid={"numTrees": [3, 5], "maxDepth": [2]}, folds=2)
    assert best["maxDepth"] == 2
    scored = learning.predict(model, features)
    assert set(scored.columns) == {*features.columns, "probability_cryptic"}
    table = learning.benchmark(learning.rule_baseline(scored), {"ML": "probability_cryptic", "Rule": "rule_score"})
    row = {r.method: r for r in table.collect()}
    assert row["ML"].test_roc_auc == pytest.approx(1.0) and 0 <= row["Rule"].test_roc_auc <= 1
    assert learning.best_method(table).collect()[0].best_method in ("ML", "Rule")
    path = str(tmp_path / "model")
    learning.save_model(model, path)
    again = learning.predict(learning.load_model(path), features)
    assert sorted(map(str, again.collect())) == sorted(map(str, scored.collect()))
    scorer = scorer_from_path(path)
    assert isinstance(scorer, ModelScorer)
    pockets = features.select(F.col("pocket_depth").alias("depth"), "sasa", "electrostatic_potential", F.col("n_basic_residues").cast("int").alias("basic_residues"), F.col("pocket_volume").alias("volume"), "plddt_confidence")
    assert scorer.score(pockets).where("composite_score NOT BETWEEN 0 AND 1").count() == 0
    importance = {r.feature: r.importance for r in learning.permutation_importance(model, features).collect()}
    assert set(importance) == set(FEATURE_COLUMNS) and importance["plddt_confidence"] == pytest.approx(0.0)
    assert learning.tree_importances(model)[0][1] > 0


def test_out_of_fold_scores_and_boosting(spark, features):
    folded = learning.stratified_folds(features, 2, ["pdb_id", "pocket_id"])
    out = learning.cross_predict(folded, "gradient_boosting", {"maxIter": 2, "maxDepth": 2})
    assert out.count() == 120 and out.where("probability_cryptic NOT BETWEEN 0 AND 1").count() == 0


def test_retraining_only_on_change(spark):
    one = spark.createDataFrame([("a", "1")], "path string, sha256 string")
    two = spark.createDataFrame([("a", "2")], "path string, sha256 string")
    assert not learning.dataset_changed(one, one) and learning.dataset_changed(one, two)


def test_failing_rows_cost_few_calls(spark):
    """A batch with a quarter of failing rows that hang on one column is settled by little more than a call for each of them."""
    calls = spark.sparkContext.accumulator(0)
    rows = spark.range(4000, numPartitions=1).selectExpr("id AS structure_id", "pmod(xxhash64(id), 1000) AS volume", "pmod(hash(id), 7) AS other")

    def strict(batch):
        calls.add(1)
        if (batch.volume < 250).any():
            raise ValueError(f"too small: {batch.volume.iloc[0]}" if len(batch) == 1 else "some")
        return batch.assign(twice=batch.volume * 2.0)[["structure_id", "twice"]]

    got = {r.structure_id: r for r in per_item_isolated(rows, strict, "structure_id long, twice double").collect()}
    want = rows.collect()
    assert len(got) == len(want) == 4000
    for r in want:
        small = r.volume < 250
        assert got[r.structure_id].error == (f"ValueError: too small: {r.volume}" if small else None)
        assert got[r.structure_id].twice == (None if small else r.volume * 2.0)
    assert calls.value < sum(r.volume < 250 for r in want) + 800


def test_stream_files_grow_in_number(spark, tmp_path, monkeypatch):
    """Landed files hold few rows each, and a structure lies in one of them, so its best hits are ranked in one batch."""
    from pocketlake.plans import queries_state

    monkeypatch.setattr(queries_state, "LANDED_ROWS", 500, raising=False)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    folder = str(tmp_path / "landing")
    monkeypatch.setattr(queries_state, "scratch_path", lambda *_: folder)
    queries_state._pocket_stream(spark, "/root/testdata/sf0.001", "l_orderkey")
    landed = spark.read.parquet(folder).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.collect_set("l_orderkey").alias("k"))
    files = landed.collect()
    assert sum(f.n for f in files) == lines.count() and max(f.n for f in files) < 1000
    assert sum(len(f.k) for f in files) == lines.select("l_orderkey").distinct().count()


def test_fit_prepares_its_rows_once_per_fold(features, monkeypatch):
    calls, plain = [], learning.prepared
    monkeypatch.setattr(learning, "prepared", lambda *a: calls.append(1) or plain(*a))
    model, _ = learning.fit(features, grid={"numTrees": [3], "maxDepth": [2]})
    whole = learning.classifier("random_forest", 42, True, numTrees=3, maxDepth=2).fit(learning.balanced_weights(features, {0: 60, 1: 60}))
    assert sorted(map(str, learning.predict(model, features).collect())) == sorted(map(str, learning.predict(whole, features).collect()))
    assert len(calls) == 1
    learning.fit(features, grid={"numTrees": [3, 5], "maxDepth": [2]}, folds=2)
    assert len(calls) == 1 + 2 + 1
