"""Importing invoice batches as they arrive in a folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from cashtide.operators.imports import import_run
from cashtide.seeds import reference_domains
from cashtide.sources.readers import read_invoice_csv
from cashtide.sources.writers import is_imported, next_version, read_snapshot, write_snapshot

# The tables an import changes; the report goes to a log of its own.
CHANGED = [
    "invoice",
    "payment_schedule",
    "cashflow_forecast",
    "dim_date",
    "dim_project",
    "dim_customer",
    "dim_cost_type",
    "fact_daily_cashflow",
    "stg_sevdesk_invoice",
    "etl_run",
]


def import_dropped_files(
    spark: SparkSession,
    folder: str,
    store: str,
    state: str,
    as_of: Callable[[int], dt.date],
    run_ts: Callable[[int], dt.datetime],
    user: str = "drop-folder",
    available_now: bool = True,
) -> StreamingQuery:
    """Run the import once for every CSV file that appears in ``folder``.

    Each file is one micro-batch and one version of the tables in ``store``, numbered after
    the last one there.  What a version was made from, the path of the file and when it was
    last changed, is recorded with it, and so is the report, as table ``import_report``.  A
    file that is delivered again, after a failure or by a query with a new checkpoint, is
    skipped if a version of the store was made from it, and imported if not.  A file without
    rows fails the query, as it fails an import.  ``as_of`` and ``run_ts`` give the dates of
    a version.
    """
    arrivals = (
        spark.readStream.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .option("maxFilesPerTrigger", 1)
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .load(folder)
        .select("path", F.unix_millis("modificationTime").alias("changed"))
    )

    def run(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        file = rows.first()  # at most one file per batch
        if file is None:
            return
        source = f"{file.path}@{file.changed}"
        if is_imported(session, store, source):
            return
        version = next_version(session, store)
        tables = {**reference_domains(session), **read_snapshot(session, store)}
        when = run_ts(version)
        name = file.path.rsplit("/", 1)[-1]
        done = import_run(tables, read_invoice_csv(session, file.path), as_of(version), when, name, user)
        written = {n: done[n] for n in CHANGED} | {"import_report": done["report"]}
        write_snapshot(written, store, version, when, source=source)

    writer = arrivals.writeStream.foreachBatch(run).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
