"""Invoice batches: staging, validation, promotion, run log and report."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.functions.numbers import MONEY, without_spaces
from cashtide.operators.mutate import one_row_per_key, timestamp_literal, upsert
from cashtide.operators.pipeline import rule_pipeline
from cashtide.operators.rules import HORIZON_DAYS
from cashtide.operators.skew import join_stored
from cashtide.operators.views import KPI_COLUMNS, view_dashboard_kpi
from cashtide.session import materialise

# Fixed values of the import.
RAW_FIELDS = ["invoice_number", "project_id", "invoice_date", "due_date", "amount", "status"]
SOURCE_SYSTEM = "SEVDESK"
CREATED_BY = "etl:sevdesk"
DEFAULT_FILENAME = "upload.csv"
DEFAULT_USER = "retool"
PINNED = ("invoice", "payment_schedule")
RUN_COUNTS = ["rows_received", "rows_promoted", "rows_rejected"]
DAY_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
AMOUNT_PATTERN = r"^[0-9]+(\.[0-9]{1,2})?\z"


# Rows of a batch that a join broadcasts at most.
SMALL_BATCH = 50_000

# Row numbers take the lower bits of a staging id, the run id those above.
ROW_BITS = 40


def import_stage(raw: DataFrame, run_id: int) -> DataFrame:
    """Land the six fields as trimmed text under a run id; nothing is cast here."""
    return raw.select(
        (F.lit(run_id << ROW_BITS) + F.col("row_number")).cast("bigint").alias("stg_id"),
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.col("row_number").cast("int").alias("row_number"),
        *[without_spaces(F.col(c)).alias(f"raw_{c}") for c in RAW_FIELDS],
        F.lit(False).alias("is_valid"),
        F.lit(None).cast("string").alias("rejection_reason"),
        F.lit(None).cast("timestamp").alias("promoted_at"),
    )


def import_validate(staged: DataFrame, project: DataFrame, invoice_status: DataFrame) -> DataFrame:
    """Mark each staged row valid, or give the first check it fails.

    Values that have the right shape but no meaning (30 February, a number too
    long for its type) are rejected under the check of their shape.
    """
    raw = {c: F.coalesce(F.col(f"raw_{c}"), F.lit("")) for c in RAW_FIELDS}
    rows = (
        staged.withColumn("_project", F.when(raw["project_id"].rlike(r"^[0-9]+\z"), raw["project_id"].try_cast("bigint")))
        .withColumn("_invoiced", F.when(raw["invoice_date"].rlike(DAY_PATTERN), raw["invoice_date"].try_cast("date")))
        .withColumn("_due", F.when(raw["due_date"].rlike(DAY_PATTERN), raw["due_date"].try_cast("date")))
        .withColumn("_amount", F.when(raw["amount"].rlike(AMOUNT_PATTERN), raw["amount"].try_cast(MONEY)))
    )
    # The batch is small next to the projects: its distinct ids select among them,
    # so the projects are filtered in place instead of being shuffled.
    asked = rows.select(F.col("_project").alias("project_id")).distinct()
    projects = project.select("project_id").join(asked, "project_id", "left_semi")
    projects = projects.select(F.col("project_id").alias("_project"), F.lit(True).alias("_known_project"))
    statuses = invoice_status.select(F.col("status_code").alias("_known_status"))
    rows = join_stored(rows, projects, ["_project"], "left").join(
        statuses, raw["status"] == F.col("_known_status"), "left"
    )

    def because(text: str, field: str):
        return F.concat(F.lit(text), raw[field])

    reason = (
        F.when(F.trim(raw["invoice_number"]) == "", "invoice_number is empty")
        .when(F.col("_project").isNull(), because("project_id is not a whole number: ", "project_id"))
        .when(
            F.col("_known_project").isNull(),
            F.concat(F.lit("project_id "), raw["project_id"], F.lit(" does not exist")),
        )
        .when(F.col("_invoiced").isNull(), because("invoice_date is not YYYY-MM-DD: ", "invoice_date"))
        .when(F.col("_due").isNull(), because("due_date is not YYYY-MM-DD: ", "due_date"))
        .when(F.col("_due") < F.col("_invoiced"), "due_date is before invoice_date")
        .when(F.col("_amount").isNull(), because("amount is not a positive decimal: ", "amount"))
        .when(F.col("_known_status").isNull(), because("unknown invoice status: ", "status"))
    )
    return (
        rows.withColumn("rejection_reason", reason)
        .withColumn("is_valid", F.col("rejection_reason").isNull())
        .select(*staged.columns)
    )


def import_arrivals(staged: DataFrame, highest: Column, on_duplicate: str = "raise") -> DataFrame:
    """The valid rows of a batch as invoices, one per number, stored.

    New invoices continue the ids after the highest one, in steps of their row
    number, so ids stay unique without numbering the batch again.
    """
    incoming = staged.filter("is_valid").select(
        (highest + F.col("row_number")).cast("bigint").alias("invoice_id"),
        F.col("raw_project_id").cast("bigint").alias("project_id"),
        F.trim("raw_invoice_number").alias("invoice_number"),
        F.col("raw_invoice_date").cast("date").alias("invoice_date"),
        F.col("raw_due_date").cast("date").alias("due_date"),
        F.col("raw_amount").cast(MONEY).alias("amount"),
        F.col("raw_status").alias("status"),
        F.lit(CREATED_BY).alias("created_by"),
    )
    # The batch meets the table three times; it is grouped by number and stored once.
    return materialise(one_row_per_key(incoming, ["invoice_number"], "invoice_id" if on_duplicate == "last" else None))


def import_merge(invoice: DataFrame, incoming: DataFrame, run_ts: dt.datetime | None = None) -> DataFrame:
    """Invoices after the arrival of others, matched by number.

    A small batch patches the table in place, which is not shuffled then; a larger one meets
    it in one join, as patching would shuffle the table once for its rows and once for its numbers.
    """
    return upsert(
        invoice,
        incoming,
        ["invoice_number"],
        ["project_id", "invoice_date", "due_date", "amount", "status"],
        unique=True,
        small_batch=incoming.limit(SMALL_BATCH + 1).count() <= SMALL_BATCH,
        run_ts=run_ts,
    )


def import_promote(
    invoice: DataFrame,
    staged: DataFrame,
    run_ts: dt.datetime | None = None,
    on_duplicate: str = "raise",
) -> DataFrame:
    """Upsert the valid rows into the invoices by number."""
    highest = invoice.select(F.coalesce(F.max("invoice_id"), F.lit(0).cast("bigint"))).scalar()
    return import_merge(invoice, import_arrivals(staged, highest, on_duplicate), run_ts)


def import_stamp_promoted(staged: DataFrame, run_ts: dt.datetime) -> DataFrame:
    return staged.withColumn(
        "promoted_at", F.when(F.col("is_valid"), timestamp_literal(run_ts)).otherwise(F.col("promoted_at"))
    )


def import_run_status(staged: DataFrame) -> DataFrame:
    """Per run the counts and Succeeded, Failed or Partial."""
    promoted, rejected = F.count_if(F.col("is_valid")), F.count_if(~F.col("is_valid"))
    return (
        staged.groupBy("run_id")
        .agg(
            F.count(F.lit(1)).cast("int").alias("rows_received"),
            promoted.cast("int").alias("rows_promoted"),
            rejected.cast("int").alias("rows_rejected"),
        )
        .withColumn(
            "status",
            F.when(F.col("rows_rejected") == 0, "Succeeded")
            .when(F.col("rows_promoted") == 0, "Failed")
            .otherwise("Partial"),
        )
    )


def import_rejections(staged: DataFrame) -> DataFrame:
    """The rejected rows in file order, each also as the JSON object the report
    lists.  They stay rows: a batch may have any number of them."""
    entry = F.struct(
        F.col("row_number").alias("row"),
        F.col("raw_invoice_number").alias("invoiceNumber"),
        F.col("rejection_reason").alias("reason"),
    )
    return (
        staged.filter(~F.col("is_valid"))
        .select(
            "run_id",
            F.col("row_number").alias("row"),
            F.col("raw_invoice_number").alias("invoiceNumber"),
            F.col("rejection_reason").alias("reason"),
            F.to_json(entry).alias("entry"),
        )
        .orderBy("run_id", "row")
    )


def import_run_open(staged: DataFrame, filename: str, user: str, run_ts: dt.datetime) -> DataFrame:
    """The log row of a run that has just started."""
    return staged.groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("rows_received")).select(
        "run_id",
        F.lit(SOURCE_SYSTEM).alias("source_system"),
        F.lit(filename).alias("source_filename"),
        timestamp_literal(run_ts).alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"),
        F.lit("Running").alias("status"),
        "rows_received",
        F.lit(0).alias("rows_promoted"),
        F.lit(0).alias("rows_rejected"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(user).alias("triggered_by"),
    )


def import_run_log(
    opened: DataFrame,
    status: DataFrame | None,
    finished: dt.datetime,
    error: str | None = None,
) -> DataFrame:
    """The log row of a finished run: its counts and status, or its error."""
    closing = {"finished_at": timestamp_literal(finished)}
    if error is not None or status is None:
        closing |= {"status": F.lit("Failed"), "error_message": F.lit(error)}
        return opened.withColumns(closing)
    counts = status.select("run_id", *[F.col(c).alias(f"_{c}") for c in ("status", *RUN_COUNTS)])
    closing |= {c: F.col(f"_{c}") for c in ("status", *RUN_COUNTS)}
    return opened.join(counts, "run_id").withColumns(closing).select(*opened.columns)


def import_report(run: DataFrame, staged: DataFrame, kpi: DataFrame) -> DataFrame:
    """The report of a run as the lines of one JSON object.

    Read in the order of ``seq`` the lines are the whole object: its head, one
    line per rejected row, and its tail.  So a report is written by many tasks
    however many rows were rejected.
    """
    head = F.concat(
        F.lit('{"runId":'),
        F.col("run_id").cast("string"),
        *[
            F.concat(F.lit(f',"{key}":'), value)
            for key, value in {
                "sourceFile": _json_text("source_filename"),
                "status": _json_text("status"),
                "rowsReceived": F.col("rows_received").cast("string"),
                "upsertedCount": F.col("rows_promoted").cast("string"),
                "rejectedCount": F.col("rows_rejected").cast("string"),
            }.items()
        ],
        F.lit(',"rejections":['),
    )
    rejected = staged.filter(~F.col("is_valid"))
    first = rejected.select(F.min("row_number")).scalar()
    entries = import_rejections(rejected).select(
        F.col("row").cast("bigint").alias("seq"),
        F.concat(F.when(F.col("row") == first, "").otherwise(","), F.col("entry")).alias("text"),
    )
    figures = [F.concat(F.lit(f'"{c}":'), F.col(c).cast("string")) for c in KPI_COLUMNS]
    tail = F.concat(F.lit('],"kpi":{'), F.concat_ws(",", *figures), F.lit("}}"))
    return (
        run.select(F.lit(0).cast("bigint").alias("seq"), head.alias("text"))
        .unionByName(entries)
        .unionByName(kpi.select(F.lit(2**62).alias("seq"), tail.alias("text")))
        .orderBy("seq")
    )


def _json_text(name: str):
    """A string column as a quoted JSON value."""
    quoted = F.to_json(F.struct(F.col(name).alias("v")), {"ignoreNullFields": "false"})
    return F.substring(quoted, F.lit(6), F.length(quoted) - 6)


def import_run(
    T: Mapping[str, DataFrame],
    raw: DataFrame,
    as_of: dt.date,
    run_ts: dt.datetime,
    filename: str = DEFAULT_FILENAME,
    user: str = DEFAULT_USER,
    horizon: int = HORIZON_DAYS,
    on_duplicate: str = "raise",
) -> dict[str, DataFrame]:
    """Import one batch and rerun the rules.

    Returns the tables with the new invoices, schedule, forecast, star schema,
    staging rows and run log, plus ``report``.  Staging and the rule results are
    stored, as many of the outputs read them.  A run whose data fails
    leaves its log row, marked Failed, in the error raised.
    """
    log = T.get("etl_run")
    last = 0 if log is None else log.select(F.coalesce(F.max("run_id"), F.lit(0).cast("bigint"))).first()[0]
    staged = materialise(import_validate(import_stage(raw, last + 1), T["project"], T["ref_invoice_status"]))
    if staged.isEmpty():
        raise ValueError("records is empty")
    opened = import_run_open(staged, filename, user, run_ts)
    T = dict(T)
    try:
        T["invoice"] = import_promote(T["invoice"], staged, run_ts, on_duplicate)
        T = rule_pipeline(T, as_of, horizon, run_ts, pin=PINNED)
    except Exception as failure:
        raise ImportFailed(str(failure), import_run_log(opened, None, run_ts, str(failure))) from failure
    staged = import_stamp_promoted(staged, run_ts)
    run = import_run_log(opened, import_run_status(staged), run_ts)
    T["report"] = import_report(run, staged, view_dashboard_kpi(T, as_of, horizon))
    T["etl_run"] = run if log is None else log.unionByName(run)
    earlier = T.get("stg_sevdesk_invoice")
    if earlier is not None:
        staged = earlier.unionByName(staged, allowMissingColumns=True)
    T["stg_sevdesk_invoice"] = staged
    return T


class ImportFailed(RuntimeError):
    """A run that could not be carried out; ``run`` is its log row."""

    def __init__(self, message: str, run: DataFrame):
        super().__init__(message)
        self.run = run
