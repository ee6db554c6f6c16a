"""Incremental screening with Structured Streaming.

A pocket table is read as a file stream, scored and gated; each micro-batch is written once per id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import composite_score
from ..operators.filters import by_criteria, by_score, top_per_group
from ..runtime import is_absent


def read_new_files(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """File stream with an explicit schema; ``files_per_batch`` paces the micro-batches and leaves nothing out."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def screen(pockets: DataFrame, min_score: float = 0.60) -> DataFrame:
    """Score and gate; stateless, so it runs the same on a stream and on a table."""
    return by_score(by_criteria(pockets).withColumn("composite_score", composite_score()), min_score)


def write_once(id_cols: list[str], sink: str) -> Callable[[DataFrame, int], None]:
    """Batch writer that adds only ids the sink does not hold yet.

    Each batch owns the folder ``batch=N`` and overwrites it, so a replayed batch leaves one copy; ids are compared
    with the folders of other batches only.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(id_cols)
        stored = T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])
        try:
            seen = spark.read.option("basePath", sink).schema(stored).parquet(sink)
        except AnalysisException as error:
            if not is_absent(error):
                raise
        else:
            fresh = fresh.join(seen.where(F.col("batch") != number).select(*id_cols), id_cols, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return write


def top_hits_per_batch(group: list[str], order: list, k: int, sink: str) -> Callable[[DataFrame, int], None]:
    """Batch writer that keeps the best ``k`` rows of each group of that batch."""

    def write(batch: DataFrame, number: int) -> None:
        top_per_group(batch, group, order, k).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return write


def run_available(stream: DataFrame, writer: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything there is, then stop; progress is kept in ``checkpoint``."""
    query = (
        stream.writeStream.foreachBatch(writer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def distinct_ids(stream: DataFrame, id_cols: list[str]) -> DataFrame:
    """Drop repeated ids by stream state; use ``write_once`` when the state must not grow with the ids."""
    return stream.dropDuplicates(id_cols)
