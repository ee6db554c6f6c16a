"""Registered queries: names, SQL text, and one query end to end on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract

SMALL = "/root/testdata/sf0.001"


def test_every_sql_text_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) >= 150


@pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not there")
def test_flagship_query(spark):
    df = contract.entry(spark)
    assert df.columns == ["structure_id", "pocket_id", "composite_score", "rank", "classification"]
    per = df.groupBy("structure_id").count().agg({"count": "max"}).collect()[0][0]
    assert 1 <= per <= 3
