"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Deletes the shuffle files of a write once it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# The paths that the innermost ``released`` block deletes at its end.
_paths: ContextVar[list[str] | None] = ContextVar("paths", default=None)

# Runtime settings the operators are designed around.  AQE sizes the reduce
# side from real shuffle statistics, splits hot partitions of a join even where
# that costs one more exchange, and turns a join into a broadcast once the
# other side is measured to be small.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "cashtide", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="cashtide-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; never reused, so nothing is overwritten."""
    return f"{shared_dir(spark)}/cashtide/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Writes within delete their shuffle files once they are done; otherwise these stay until
    the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def delete_path(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``materialise`` stored within; nothing that is left may read it."""
    paths: list[str] = []
    outer = _paths.set(paths)
    try:
        yield
    finally:
        _paths.reset(outer)
        for path in paths:
            delete_path(spark, path)


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Store a result once in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the planner the
    true size of the result, so that a small one is broadcast on its measured size
    and a reader takes only the columns it needs, and only the values of
    ``partition_by`` it asks for.
    """
    path = scratch_path(df.sparkSession, "stage")
    if (paths := _paths.get()) is not None:
        paths.append(path)
    with shuffles_cleared(df.sparkSession):
        df.write.partitionBy(*partition_by).parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
