"""Scores, control rules, value parsing and gates on literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pocketlake.functions import controls, scoring, values
from pocketlake.functions.scorers import RuleScorer, per_item, per_item_isolated, scorer_from_path
from pocketlake.operators import filters


def one(df):
    return df.collect()[0]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(1, 0.82, 5, 4.0, 450.0, 85.0), (2, 0.78, 4, 8.0, 520.0, 72.0), (3, 0.70, 3, 6.0, 400.0, 80.0), (4, 0.90, 6, 25.0, 500.0, 90.0)]
    return spark.createDataFrame(
        rows, "pocket_id int, composite_score double, basic_residues int, sasa double, volume double, plddt_confidence double"
    )


def ids(df):
    return sorted(r.pocket_id for r in df.collect())


def test_rule_score_cases(spark):
    df = spark.createDataFrame(
        [(650.0, 18.0, 2.0, 6, 7.5), (400.0, 6.0, 65.0, 3, 3.0)],
        "volume double, depth double, sasa double, basic_residues int, electrostatic_potential double",
    )
    good, bad = (r.s for r in df.select(scoring.composite_score().alias("s")).collect())
    assert good > 0.55 and bad < 0.45 and good - bad > 0.20


def test_nan_and_null_inputs(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, nan, nan, nan), (None, None, None, None)], "v double, d double, s double, p double")
    rows = df.select(
        scoring.volume_score("v"), scoring.depth_score("d"), scoring.sasa_score("s"), scoring.potential_score("p")
    ).collect()
    for row in rows:
        assert row[0] == 0.0 and row[1] is None and row[2] is None and row[3] == 0.5


def test_missing_weight_is_rejected():
    with pytest.raises(ValueError):
        scoring.composite_score({"volume": 1.0})


def test_gates(scored):
    assert ids(filters.by_score(scored, 0.75)) == [1, 2, 4]
    assert ids(filters.by_criteria(scored)) == [1, 2]
    assert ids(filters.by_confidence(scored, 75.0)) == [1, 3, 4]
    ranked = filters.cryptic_candidates(scored, min_score=0.75, id_cols=["pocket_id"]).orderBy("rank").collect()
    assert [r.pocket_id for r in ranked] == [1, 2]
    assert ranked[0].classification == scoring.HIGH


def test_gate_without_column_is_a_no_op(scored):
    assert ids(filters.by_burial_depth(scored)) == [1, 2, 3, 4]
    assert ids(filters.by_confidence(scored.drop("plddt_confidence"))) == [1, 2, 3, 4]


def test_ranking_nothing_gives_nothing(scored):
    empty = filters.with_rank(scored.where("pocket_id > 99"), ["pocket_id"])
    assert empty.count() == 0 and "classification" in empty.columns


def test_control_scores(spark):
    df = spark.createDataFrame([(0.8, 0.0), (0.7, 99.0), (0.5, 27.5)], "pocket double, sasa double")
    rows = df.select(controls.cryptic_likeness("pocket", "sasa").alias("s"), controls.burial_component("sasa").alias("b")).collect()
    assert rows[0].s > 0.7 and rows[1].s < 0.35 and rows[2].b == pytest.approx(0.5)


def test_published_control_scores(spark):
    """A buried ligand (area 0) with pocket score .637522 scores .773133."""
    df = spark.createDataFrame([(0.637522, 0.0)], "pocket double, sasa double")
    assert one(df.select(controls.cryptic_likeness("pocket", "sasa").alias("s"))).s == pytest.approx(0.773133, abs=1e-6)


def test_stability_votes(spark):
    rows = [(0.5, 0.1, 0.5), (6.0, 0.5, 1.5), (2.0, 0.3, 2.0)]
    df = spark.createDataFrame(rows, "avg_pocket_sasa_nm2 double, avg_pocket_rmsf_nm double, avg_waters_in_pocket double")
    got = [r.c for r in df.select(controls.pocket_stability().alias("c")).collect()]
    assert got == ["stably buried", "exposed", "transiently accessible"]


def test_centre_needs_three_parts(spark):
    df = spark.createDataFrame([("1,2,3",), ("1,2",), ("",)], "t string")
    assert one(df.where("t = '1,2,3'").select(values.center("t").alias("c"))).c.y == 2.0
    assert one(df.where("t = ''").select(values.center("t").alias("c"))).c is None
    with pytest.raises(Exception, match="three coordinates"):
        df.where("t = '1,2'").select(values.center("t").alias("c")).collect()
    good, bad = filters.quarantine(df, F.when(values.try_center("t").isNull(), "bad centre"))
    assert good.count() == 1 and bad.count() == 2


def test_boolean_words(spark):
    df = spark.createDataFrame([("Yes",), ("0",)], "t string")
    assert [r.b for r in df.select(values.to_boolean("t").alias("b")).collect()] == [True, False]
    with pytest.raises(Exception, match="yes/no"):
        spark.createDataFrame([("maybe",)], "t string").select(values.to_boolean("t")).collect()


def test_scorer_falls_back_to_rules():
    assert isinstance(scorer_from_path("/tmp/no-such-model"), RuleScorer)
    assert isinstance(scorer_from_path(None), RuleScorer)


def test_user_function_must_keep_the_id(spark):
    df = spark.range(5).select(F.col("id").cast("string").alias("structure_id"))
    good = per_item(df, lambda b: b.assign(n=1), "structure_id string, n long")
    assert good.count() == 5
    with pytest.raises(Exception, match="missing structure_id"):
        per_item(df, lambda b: b.assign(structure_id=None), "structure_id string").collect()


def test_residue_gate_keeps_rows_without_information(spark):
    pockets = spark.createDataFrame(
        [("s", 1, [1, 2], None), ("s", 2, [3], None), ("s", 3, None, 90.0), ("s", 4, None, 50.0), ("s", 5, None, None)],
        "structure_id string, pocket_id int, residue_ids array<int>, plddt_confidence double",
    )
    residues = spark.createDataFrame(
        [("s", "A", 1, 10.0, 90.0), ("s", "A", 2, 10.0, 80.0), ("s", "A", 3, 10.0, 55.0)],
        "structure_id string, chain string, resseq int, sasa double, plddt double",
    )
    assert ids(filters.by_residue_confidence(pockets, residues)) == [1, 3, 5]


def test_failing_items_are_listed_and_stop_nothing(spark):
    def inverse(batch):
        if (batch.x == 0).any():
            raise ZeroDivisionError("x is zero")
        result = batch.assign(y=1 / batch.x, note=batch.x.map(lambda v: "odd" if v % 2 else "even"))
        result.loc[batch.x == 50, "structure_id"] = None
        return result.assign(y=result.y.astype(object).where(batch.x != 70, "text"))

    rows = spark.createDataFrame([(f"s{i}", i % 100) for i in range(2_000)], "structure_id string, x int").repartition(3)
    schema = "structure_id string, note string, y double"
    got = per_item_isolated(rows, inverse, schema).collect()
    assert len(got) == 2_000 and len({r.structure_id for r in got}) == 2_000
    failed = {int(r.structure_id[1:]): r for r in got if r.error is not None}
    assert {i % 100 for i in failed} == {0, 50, 70} and len(failed) == 60
    assert failed[100].error == "ZeroDivisionError: x is zero" and failed[100].y is None
    assert failed[50].error == "ValueError: result missing structure_id" and failed[50].structure_id == "s50"
    assert all(r.y == 1 / (int(r.structure_id[1:]) % 100) for r in got if r.error is None)
    assert per_item_isolated(rows.limit(0), inverse, schema).count() == 0
    nobody = spark.createDataFrame([(None, 3), ("a", None)], "structure_id string, x int")
    assert [r.structure_id for r in per_item_isolated(nobody, inverse, schema).collect() if r.error] == [None]
    with pytest.raises(ValueError):
        per_item_isolated(rows, inverse, "note string")


def test_calls_for_a_failing_item_grow_with_the_halvings(spark, tmp_path):
    def counted(batch):
        with open(tmp_path / "calls", "a") as log:
            log.write("x")
        if (batch.x == 700).any():
            raise ValueError("bad")
        return batch

    rows = spark.range(1_000).select(F.col("id").cast("string").alias("structure_id"), F.col("id").alias("x")).coalesce(1)
    got = per_item_isolated(rows, counted, "structure_id string, x long").where("error IS NOT NULL").collect()
    assert [r.structure_id for r in got] == ["700"]
    assert len((tmp_path / "calls").read_text()) <= 2 * 11
