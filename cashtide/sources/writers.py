"""Writing outputs, versioned snapshots and append-only logs."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtide.operators.mutate import timestamp_literal

VERSIONS = "_versions"


def write_csv_outputs(outputs: Mapping[str, DataFrame], directory: str) -> None:
    """Each output as a CSV folder with header; missing values are empty fields, and a quote
    inside a field is doubled."""
    options = {"header": True, "emptyValue": "", "nullValue": "", "quote": '"', "escape": '"'}
    for name, df in outputs.items():
        df.write.options(**options).csv(f"{directory.rstrip('/')}/{name}")


def write_text_lines(lines: DataFrame, path: str, column: str = "text") -> None:
    """Write ordered text lines; the parts of the output follow the order of the rows."""
    lines.select(column).write.text(path)


def append_log(df: DataFrame, directory: str) -> None:
    """Add rows to a log; rows already there are never rewritten."""
    df.write.mode("append").parquet(directory)


def write_snapshot(
    tables: Mapping[str, DataFrame],
    directory: str,
    version: int,
    run_ts: dt.datetime,
    partition_by: Mapping[str, Sequence[str]] | None = None,
    source: str | None = None,
) -> None:
    """Write changed tables as a new version and only then record it.

    Readers follow the record, so they see the previous version until the new one
    is complete.  Every attempt writes to a path of its own, so a failed one can be
    repeated; a version that is already recorded is an error.  ``partition_by``
    names partition columns per table, such as the date key of a long history.
    ``source`` names the input a version was made from.
    """
    root = directory.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    if is_recorded(spark, root, version):
        raise ValueError(f"version {version} is already recorded in {root}")
    attempt = f"{root}/v{version}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.partitionBy(*(partition_by or {}).get(name, ())).parquet(f"{attempt}/{name}")
    entries = [
        F.struct(F.lit(n).alias("table_name"), F.lit(f"{attempt}/{n}").alias("path")) for n in tables
    ]
    record = spark.range(1, numPartitions=1).select(
        F.lit(version).cast("bigint").alias("version"),
        timestamp_literal(run_ts).alias("written_at"),
        F.inline(F.array(*entries)),
    ).withColumn("source", F.lit(source).cast("string"))
    append_log(record, f"{root}/{VERSIONS}")


RECORD = "version bigint, written_at timestamp, table_name string, path string, source string"


def _records(spark: SparkSession, directory: str) -> DataFrame | None:
    """The record of versions, or nothing if none was written yet."""
    try:
        return spark.read.schema(RECORD).parquet(f"{directory.rstrip('/')}/{VERSIONS}")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def is_recorded(spark: SparkSession, directory: str, version: int) -> bool:
    records = _records(spark, directory)
    return records is not None and not records.filter(F.col("version") == version).isEmpty()


def is_imported(spark: SparkSession, directory: str, source: str) -> bool:
    """Whether a version was made from this input."""
    records = _records(spark, directory)
    return records is not None and not records.filter(F.col("source") == source).isEmpty()


def next_version(spark: SparkSession, directory: str) -> int:
    """One more than the last recorded version, from 1."""
    records = _records(spark, directory)
    last = None if records is None else records.agg(F.max("version")).first()[0]
    return 1 if last is None else last + 1


def read_history(spark: SparkSession, directory: str, table: str) -> DataFrame | None:
    """A table in all recorded versions that have it, with ``version``."""
    records = _records(spark, directory)
    rows = [] if records is None else records.filter(F.col("table_name") == table).select("version", "path").collect()
    parts = [spark.read.parquet(r.path).withColumn("version", F.lit(r.version)) for r in sorted(rows)]
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def read_snapshot(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The latest recorded version of every table."""
    records = _records(spark, directory)
    if records is None:
        return {}
    latest = records.groupBy("table_name").agg(F.max_by("path", "version").alias("path"))
    return {row.table_name: spark.read.parquet(row.path) for row in latest.collect()}
