"""Pluggable scorers and per-item user functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from ..runtime import is_absent
from .scoring import composite_score, model_class, rule_class


class Scorer(Protocol):
    """Adds ``composite_score`` and ``classification`` to a pocket table."""

    def score(self, pockets: DataFrame) -> DataFrame: ...


class RuleScorer:
    """Weighted rule score; weights may be overridden."""

    def __init__(self, weights: Mapping[str, float] | None = None):
        self.weights = weights

    def score(self, pockets: DataFrame) -> DataFrame:
        scored = pockets.withColumn("composite_score", composite_score(self.weights))
        return scored.withColumn("classification", rule_class("composite_score"))


class ModelScorer:
    """Probability of a fitted classifier as the score."""

    def __init__(self, model):
        self.model = model

    def score(self, pockets: DataFrame) -> DataFrame:
        from ..operators.learning import FEATURES_FROM_POCKETS, predict

        renamed = pockets.select("*", *[F.col(old).cast("double").alias(new) for new, old in FEATURES_FROM_POCKETS.items() if new != old])
        scored = predict(self.model, renamed, "composite_score")
        added = [new for new, old in FEATURES_FROM_POCKETS.items() if new != old]
        return scored.drop(*added).withColumn("classification", model_class("composite_score"))


def scorer_from_path(path: str | None) -> Scorer:
    """The model stored at ``path``, or the rule scorer when nothing is stored there.

    A model that is there but cannot be read raises: scores must not change silently.
    """
    if path is None:
        return RuleScorer()
    from ..operators.learning import load_model

    try:
        SparkSession.active().read.text(path)
    except AnalysisException as error:
        if not is_absent(error):
            raise
        return RuleScorer()
    return ModelScorer(load_model(path))


def per_item(
    df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, id_col: str = "structure_id"
) -> DataFrame:
    """Apply a user function to Arrow batches of rows; a result row without its id fails the job.

    Rows of one structure are not gathered, so a structure of any size spreads over tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    guard: Column = F.when(
        F.col(id_col).isNull(), F.raise_error(F.lit(f"result missing {id_col}")).cast("boolean")
    ).otherwise(F.lit(True))
    return df.mapInPandas(run, schema).where(guard)


#: Rows that fail one after another before the next one is tried alone at once.
STREAK = 8
#: Rows tried first in a batch while no failing row has been seen.
FIRST_ROWS = 256


def telling_column(rows: pd.DataFrame, failed: list[int]) -> str | None:
    """The column along which failing rows (places in ``rows``) lie together most, None if none beats the given order by half."""
    marks = np.zeros(len(rows), np.int8)
    marks[failed] = 1
    best, fewest = None, np.count_nonzero(np.diff(marks)) / 2
    for name in rows.columns[rows.dtypes.map(pd.api.types.is_numeric_dtype)]:
        changes = np.count_nonzero(np.diff(marks[np.argsort(rows[name].to_numpy(), kind="stable")]))
        if changes < fewest:
            best, fewest = name, changes
    return best


def per_item_isolated(
    df: DataFrame,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    keys: Sequence[str] = ("structure_id",),
) -> DataFrame:
    """As ``per_item``, with failing items listed in place of ending the run: the columns of ``schema`` and ``error``.

    ``function`` treats rows independently. A batch that it cannot handle is halved until the failing row stands alone, so the
    other rows of the batch keep their results. Once rows have failed, later ones are put in the order of the column that parts failing
    rows from others best, and where several failed in a row the next is tried alone: failures that hang on a column cost about one
    call each, others up to two for each halving; ``quarantine`` suits failures that an expression can name. That row gives its
    ``keys`` (columns of ``schema``), no other value, and the kind and text of the error. A result that does not fit ``schema`` or
    has no value in a key counts as a failure of the rows that it came from; empty batches are not passed on.
    """
    fields = StructType.fromDDL(schema)
    if not set(keys) <= set(fields.names):
        raise ValueError("keys must be columns of the schema")
    names, arrow = fields.names, to_arrow_schema(fields)

    def fitting(batch: pd.DataFrame) -> pa.Table:
        result = function(batch)
        if result[list(keys)].isna().any(axis=None):
            raise ValueError(f"result missing {', '.join(keys)}")
        return pa.Table.from_pandas(result[names], schema=arrow, preserve_index=False)

    def outcomes(rows: pd.DataFrame) -> tuple[list[pa.Table], dict[int, str]]:
        """Results of the rows that pass, and the errors of the others by place."""
        passed, errors, waiting, streak = [], {}, [(0, len(rows))], 0
        while waiting:
            start, count = waiting.pop()
            if count == 0:
                continue
            if count > 1 and streak >= STREAK:
                waiting += [(start + 1, count - 1), (start, 1)]
                continue
            part = rows.iloc[start : start + count].reset_index(drop=True)
            try:
                passed.append(fitting(part))
                streak = 0
            except Exception as problem:
                if count > 1:
                    half = count // 2
                    waiting += [(start + half, count - half), (start, half)]
                else:
                    errors[start] = f"{type(problem).__name__}: {problem}"
                    streak += 1
        return passed, errors

    def listed(whole: pa.RecordBatch, errors: dict[int, str]) -> pa.Table:
        items = whole.take(pa.array(list(errors), pa.int64()))
        known = {k: items.column(items.schema.get_field_index(k)).cast(arrow.field(k).type) for k in keys}
        columns = [known[n] if n in known else pa.nulls(len(errors), arrow.field(n).type) for n in names]
        return pa.Table.from_arrays([*columns, pa.array(list(errors.values()), pa.string())], names=[*names, "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guide = None
        for batch in batches:
            # Until a column is known to tell failing rows, a few rows are looked at first.
            cuts = [0, batch.num_rows] if guide is not None else [0, min(FIRST_ROWS, batch.num_rows), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                whole = batch.slice(start, end - start)
                rows = whole.to_pandas()
                if guide is not None:
                    order = np.argsort(rows[guide].to_numpy(), kind="stable")
                    whole, rows = whole.take(pa.array(order)), rows.iloc[order]
                passed, errors = outcomes(rows)
                if errors:
                    guide = telling_column(rows, list(errors)) or guide
                tables = [t.append_column("error", pa.nulls(t.num_rows, pa.string())) for t in passed]
                if errors:
                    tables.append(listed(whole, errors))
                yield from pa.concat_tables(tables).combine_chunks().to_batches()

    return df.mapInArrow(run, StructType(fields.fields).add("error", StringType()))
