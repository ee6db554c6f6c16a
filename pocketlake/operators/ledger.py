"""Results ledger: upserts, lookups and resume over partitioned Parquet.

Writers only append; the newest row of a key wins on reading. That makes a retried write harmless. Files are
partitioned by (batch, pipeline_version, params_hash), so a lookup reads the folders of one version only. A log with a row per
commit tells which batches count: a batch is seen once its row is there, and compaction or invalidation names the batches
it is about, so what is appended meanwhile stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import freeze, is_absent
from ..schemas import LEDGER

KEY = ("uniprot_id", "pipeline_version", "params_hash")
PARTITIONS = ("pipeline_version", "params_hash")


def latest_wins(rows: DataFrame, key: Sequence[str] = KEY, order: Sequence[str] = ("timestamp", "seq")) -> DataFrame:
    """The newest row of each key. Each task passes on one row per key, so a hot key stays small."""
    newest = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def lookup(ledger: DataFrame, version: str, params_hash: str, organism: str | None = None) -> DataFrame:
    """Current rows of one pipeline version and parameter set.

    The organism is compared after the newest row is chosen: it is not part of the key, so an upsert under
    another organism hides the older row.
    """
    current = latest_wins(ledger.where((F.col("pipeline_version") == version) & (F.col("params_hash") == params_hash)))
    return current if organism is None else current.where(F.col("organism") == organism)


def outdated(ledger: DataFrame, version: str, params_hash: str) -> DataFrame:
    """Rows of any other version or parameter set; a NULL one is another one."""
    return ledger.where(~_belongs(version, params_hash))


def _belongs(version: str | None, params_hash: str | None) -> Column:
    return F.col("pipeline_version").eqNullSafe(F.lit(version)) & F.col("params_hash").eqNullSafe(F.lit(params_hash))


def remaining(items: DataFrame, processed: DataFrame, key: str = "uniprot_id") -> DataFrame:
    """Items not processed yet."""
    return items.join(processed.select(key).distinct(), key, "left_anti")


def latest_status(events: DataFrame, key: Sequence[str] = ("proteome", "uniprot_id")) -> DataFrame:
    """Newest status per item: a later success clears a failure."""
    return latest_wins(events, key)


def checked_state(states: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """Resume state from JSON text; text that is not valid JSON stops the job instead of restarting it."""
    parsed = F.from_json(text, f"{schema}, _corrupt_record STRING", {"columnNameOfCorruptRecord": "_corrupt_record"})
    staged = states.withColumn("_s", parsed)
    bad = F.col("_s").isNull() | F.col("_s._corrupt_record").isNotNull()
    guard = F.when(bad, F.raise_error(F.lit("resume state is not valid JSON")).cast("boolean")).otherwise(F.lit(True))
    return staged.where(guard).select("_s.*").drop("_corrupt_record")


#: A commit: ``add`` brings a batch, ``replace`` brings one for those in ``targets``, ``keep`` narrows the targets to one version.
COMMITS = T.StructType(
    [
        T.StructField("action", T.StringType()),
        T.StructField("batch", T.StringType()),
        T.StructField("targets", T.ArrayType(T.StringType())),
        T.StructField("pipeline_version", T.StringType()),
        T.StructField("params_hash", T.StringType()),
    ]
)
_STORED = T.StructType([*LEDGER.fields, T.StructField("batch", T.StringType())])


class Ledger:
    """A ledger folder. ``seq`` orders rows of one timestamp; later batches must use larger numbers.

    The log has a row per commit and is read by the driver; ``compact`` keeps the number of live batches small.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.data, self.log = f"{path}/data", f"{path}/log"

    def _commits(self) -> list:
        try:
            return self.spark.read.schema(COMMITS).json(self.log).collect()
        except AnalysisException as error:
            if not is_absent(error):
                raise
            return []

    def _commit(self, action: str, batch: str | None = None, targets: Sequence[str] = (), version=None, params_hash=None) -> None:
        row = (action, batch, list(targets), version, params_hash)
        self.spark.createDataFrame([row], COMMITS).coalesce(1).write.mode("append").json(self.log)

    def _live(self) -> dict[str, list[tuple[str | None, str | None]]]:
        """Batches that count, each with the versions that it was narrowed to."""
        commits = self._commits()
        replaced = {t for c in commits if c.action == "replace" for t in c.targets}
        live = {c.batch: [] for c in commits if c.action in ("add", "replace") and c.batch not in replaced}
        for c in commits:
            if c.action == "keep":
                for target in c.targets:
                    if target in live:
                        live[target].append((c.pipeline_version, c.params_hash))
        return live

    def _seen(self, live: dict[str, list[tuple[str | None, str | None]]]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], LEDGER)
        stored = self.spark.read.schema(_STORED).parquet(self.data)
        whole = [b for b, narrowed in live.items() if not narrowed]
        seen = F.col("batch").isin(whole)
        for batch, narrowed in live.items():
            for version, params_hash in narrowed[:1]:
                own = _belongs(version, params_hash) if len(set(narrowed)) == 1 else F.lit(False)
                seen = seen | ((F.col("batch") == batch) & own)
        return stored.where(seen).select(*LEDGER.names)

    def _write(self, rows: DataFrame, batch: str) -> None:
        """Few files per partition folder; adaptive execution splits a folder that holds most rows."""
        spread = rows.withColumn("batch", F.lit(batch)).hint("rebalance", *PARTITIONS)
        spread.write.mode("append").partitionBy("batch", *PARTITIONS).parquet(self.data)

    def rows(self) -> DataFrame:
        return self._seen(self._live())

    def current(self) -> DataFrame:
        return latest_wins(self.rows())

    def upsert(self, rows: DataFrame) -> int:
        """Append a batch; within it the last row of a key wins. Returns the number of rows handed in."""
        batch = uuid.uuid4().hex
        # The batch may be dear to compute: it is frozen, counted and written from the copy.
        handed_in = freeze(rows.select(*[F.col(f.name).cast(f.dataType) for f in LEDGER.fields]))
        count = handed_in.count()
        if count:
            self._write(latest_wins(handed_in), batch)
            self._commit("add", batch)
        return count

    def get(self, version: str, params_hash: str, organism: str | None = None) -> DataFrame:
        return lookup(self.rows(), version, params_hash, organism)

    def invalidate(self, version: str, params_hash: str) -> int:
        """Drop rows of any other version or parameter set; returns how many current rows went away.

        A row in the log does it: no data is read beyond the count, none is rewritten. Batches appended meanwhile are
        untouched.
        """
        live = self._live()
        gone = outdated(latest_wins(self._seen(live)), version, params_hash).count()
        if live:
            self._commit("keep", targets=sorted(live), version=version, params_hash=params_hash)
        return gone

    def compact(self) -> None:
        """Put one batch of current rows in the place of the batches that are live now.

        Old files stay until they are removed from outside, so readers that began earlier finish.
        """
        live = self._live()
        if not live:
            return
        batch = uuid.uuid4().hex
        self._write(latest_wins(self._seen(live)), batch)
        self._commit("replace", batch, sorted(live))

    def compute_missing(self, items: DataFrame, compute, version: str, params_hash: str) -> DataFrame:
        """Cache-aside: compute only items the ledger lacks, store them, and return all rows."""
        have = self.get(version, params_hash)
        todo = remaining(items, have)
        self.upsert(compute(todo))
        return self.get(version, params_hash).join(items.select("uniprot_id").distinct(), "uniprot_id", "left_semi")
