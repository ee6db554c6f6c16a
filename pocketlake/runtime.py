"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "pocketlake") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    ship(session)
    return session


def ship(spark: SparkSession) -> None:
    """Hand this package to the workers of a session, for clusters where it is not installed."""
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    ``spark.checkpoint.dir`` is used when the cluster names one. Only a local master falls back to a
    temporary folder, because there driver and tasks share one disk.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        configured = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    context.setCheckpointDir(configured)
    return context._jsc.sc().getCheckpointDir().get()


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so that later plans read exactly these rows.

    Needed wherever a plan is used twice and must see the same physical split both times (range
    partition ids), and at the end of each round of an iteration.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_absent(error: AnalysisException) -> bool:
    """Whether a read failed because there is nothing at its path."""
    return error.getCondition() == "PATH_NOT_FOUND"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
