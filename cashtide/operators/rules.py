"""The business rules: payment schedules, invoice classification, forecast."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashtide.functions.hashing import short_key
from cashtide.functions.numbers import MONEY
from cashtide.operators.mutate import replace_from_date, stamp_updated, update_where_distinct, upsert
from cashtide.operators.skew import join_stored, numbered
from cashtide.session import materialise

Tables = Mapping[str, DataFrame]

# Thresholds, codes and provenance marks of the rules.
SPLIT_THRESHOLD = 3000
HORIZON_DAYS = 30
FIRST_STAGE = "STAGE_1_ROOF"
SECOND_STAGE = "STAGE_2_COMMISSIONING"
SINGLE = "SINGLE_PAYMENT"
ADJUSTMENT = "ADJUSTMENT"
OPEN_SCHEDULE_STATUSES = ["Pending", "Invoiced", "Overdue"]
SCHEDULE_RULE = "rule:BR-1"
FORECAST_RULE = "rule:BR-3"
MILESTONE_FLOW = "customer_milestone"
SUPPLIER_FLOW = "supplier_order"
OVERHEAD_FLOW = "operational_overhead"

# A schedule id is the project id followed by 16 bits taken from the milestone
# code, so two projects never share one.  Codes that agree in those bits are refused.
SLOT_BITS = 16

SCHEDULE_COLUMNS = [
    "schedule_id",
    "project_id",
    "milestone_code",
    "due_offset_days",
    "expected_amount",
    "status",
    "created_by",
]
FORECAST_COLUMNS = [
    "project_id",
    "forecast_date",
    "expected_cash_in",
    "expected_cash_out",
    "net_cashflow",
    "flow_source",
    "created_by",
]


def unshared(key: Column, message: Column) -> Column:
    """A short key of the rows of a small reference table; an error if two rows share it."""
    times = F.count(F.lit(1)).over(Window.partitionBy(key))
    return F.when(times > 1, F.raise_error(message).cast("bigint")).otherwise(key)


def milestone_slot(milestone_code: Column) -> Column:
    return short_key(milestone_code, SLOT_BITS // 4)


def rule_payment_schedule(
    project: DataFrame,
    milestone_type: DataFrame,
    schedule: DataFrame | None = None,
    threshold: int = SPLIT_THRESHOLD,
    project_id: int | None = None,
    run_ts: dt.datetime | None = None,
) -> DataFrame:
    """One schedule row per project and milestone type that fits its value.

    An existing row only has its expected amount replaced; nothing is deleted.
    Asking for one project that does not exist is an error.
    """
    if project_id is not None:
        project = project.filter(F.col("project_id") == project_id)
        if project.isEmpty():
            raise ValueError(f"Project {project_id} does not exist")
    milestones = milestone_type.filter("is_milestone").select(
        "milestone_code",
        "percentage",
        "part_of_split",
        F.col("default_due_offset_days").alias("due_offset_days"),
        unshared(milestone_slot(F.col("milestone_code")), F.lit("milestone codes share a slot")).alias("slot"),
    )
    due = (
        project.select("project_id", "total_value", (F.col("total_value") >= threshold).alias("part_of_split"))
        .join(milestones, "part_of_split")
        .select(
            (F.col("project_id") * F.lit(1 << SLOT_BITS) + F.col("slot")).alias("schedule_id"),
            "project_id",
            "milestone_code",
            "due_offset_days",
            F.round(F.col("total_value") * F.col("percentage") / 100, 2).cast(MONEY).alias("expected_amount"),
            F.lit("Pending").alias("status"),
            F.lit(SCHEDULE_RULE).alias("created_by"),
        )
    )
    if schedule is None:
        return due
    return upsert(schedule, due, ["project_id", "milestone_code"], ["expected_amount"], unique=True, run_ts=run_ts)


def _with_columns(invoice: DataFrame, **types: str) -> DataFrame:
    """Add the columns the milestone rules fill, where a table does not have them yet."""
    missing = {c: F.lit(None).cast(t) for c, t in types.items() if c not in invoice.columns}
    return invoice.withColumns(missing) if missing else invoice


def _scope(invoice: DataFrame, project: DataFrame, project_id: int | None) -> DataFrame:
    """Per project its value and its first two invoices by date and number.

    The rank behind the two stages counts all invoices of the project, small and
    cancelled ones too.  Only ranks 1 and 2 decide anything, so they are found with
    a per-project limit that already applies before the shuffle; a project with very
    many invoices is never sorted in one task.
    """
    by_date = Window.partitionBy("project_id").orderBy("invoice_date", "invoice_number")
    leading = (
        invoice.select("project_id", "invoice_date", "invoice_number", "invoice_id")
        .withColumn("rank", F.row_number().over(by_date))
        .filter(F.col("rank") <= 2)
        .groupBy("project_id")
        .agg(
            F.max(F.when(F.col("rank") == 1, F.col("invoice_id"))).alias("_first_id"),
            F.max(F.when(F.col("rank") == 2, F.col("invoice_id"))).alias("_second_id"),
        )
    )
    if project_id is not None:
        project = project.filter(F.col("project_id") == project_id)
    return project.select("project_id", F.col("total_value").alias("_value")).join(leading, "project_id", "left")


def _milestone(threshold: int) -> Column:
    """The code of an invoice next to the scope of its project; without one, the code
    it has."""
    code = (
        F.when(F.col("_value") < threshold, SINGLE)
        .when(F.col("amount") < threshold, ADJUSTMENT)
        .when(F.col("invoice_id") == F.col("_first_id"), FIRST_STAGE)
        .when(F.col("invoice_id") == F.col("_second_id"), SECOND_STAGE)
        .otherwise(ADJUSTMENT)
    )
    return F.when(F.col("_value").isNull(), F.col("milestone_code")).otherwise(code)


def rule_classify_invoices(
    invoice: DataFrame,
    project: DataFrame,
    project_id: int | None = None,
    threshold: int = SPLIT_THRESHOLD,
    run_ts: dt.datetime | None = None,
) -> DataFrame:
    """Set ``milestone_code`` on every invoice of a known project."""
    invoice = _with_columns(invoice, milestone_code="string")
    scope = _scope(invoice, project, project_id)
    joined = join_stored(invoice, scope, ["project_id"], "left")
    code = _milestone(threshold)
    changed = ~F.col("milestone_code").eqNullSafe(code)
    return stamp_updated(joined, changed, run_ts).withColumn("milestone_code", code).select(*invoice.columns)


def _slots(schedule: DataFrame, milestone_type: DataFrame, project_id: int | None) -> DataFrame:
    """Schedule rows of real milestones."""
    real = milestone_type.filter("is_milestone").select("milestone_code")
    slots = schedule.select("project_id", "milestone_code", "schedule_id").join(real, "milestone_code", "left_semi")
    return slots if project_id is None else slots.filter(F.col("project_id") == project_id)


def rule_link_schedule(
    invoice: DataFrame,
    schedule: DataFrame,
    milestone_type: DataFrame,
    project_id: int | None = None,
    run_ts: dt.datetime | None = None,
) -> DataFrame:
    """Point invoices of a real milestone at the schedule row of that milestone.

    A link is never cleared, even if the invoice is reclassified.
    """
    invoice = _with_columns(invoice, schedule_id="bigint")
    slots = materialise(_slots(schedule, milestone_type, project_id))
    return update_where_distinct(invoice, slots, ["project_id", "milestone_code"], "schedule_id", run_ts)


def classify_and_link(
    invoice: DataFrame,
    project: DataFrame,
    schedule: DataFrame,
    milestone_type: DataFrame,
    project_id: int | None = None,
    threshold: int = SPLIT_THRESHOLD,
    run_ts: dt.datetime | None = None,
) -> DataFrame:
    """Both invoice rules in one pass over the invoices.

    Code and slot depend on the project alone, so the slots of a project, at most
    one per milestone type, travel with its scope and the invoices are shuffled once.
    """
    invoice = _with_columns(invoice, milestone_code="string", schedule_id="bigint")
    slots = (
        _slots(schedule, milestone_type, project_id)
        .groupBy("project_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("milestone_code", "schedule_id"))).alias("_slots"))
    )
    scope = _scope(invoice, project, project_id).join(slots, "project_id", "full_outer")
    joined = join_stored(invoice, scope, ["project_id"], "left")
    coded = joined.withColumn("_code", _milestone(threshold))
    coded = coded.withColumn("_slot", F.coalesce(F.try_element_at("_slots", F.col("_code")), F.col("schedule_id")))
    changed = ~(F.col("milestone_code").eqNullSafe(F.col("_code")) & F.col("schedule_id").eqNullSafe(F.col("_slot")))
    return (
        stamp_updated(coded, changed, run_ts)
        .withColumns({"milestone_code": F.col("_code"), "schedule_id": F.col("_slot")})
        .select(*invoice.columns)
    )


def rule_advance_schedule(
    schedule: DataFrame,
    invoice: DataFrame,
    project_id: int | None = None,
    run_ts: dt.datetime | None = None,
) -> DataFrame:
    """Move a schedule row to Invoiced once linked, and to Paid once a linked
    invoice is paid.  A row never moves back."""
    linked = (
        invoice.filter(F.col("schedule_id").isNotNull())
        .groupBy("schedule_id")
        .agg(F.bool_or(F.col("status") == "Paid").alias("_paid"))
    )
    joined = schedule.join(linked, "schedule_id", "left")
    status = F.when(F.col("_paid"), F.lit("Paid")).when(
        F.col("_paid").isNotNull() & (F.col("status") == "Pending"), F.lit("Invoiced")
    )
    if project_id is not None:
        status = F.when(F.col("project_id") == project_id, status)
    advanced = F.coalesce(status, F.col("status"))
    stamped = stamp_updated(joined, advanced != F.col("status"), run_ts)
    return stamped.withColumn("status", advanced).select(*schedule.columns)


def _within(dates: DataFrame, column: str, offsets: DataFrame, offset: str, as_of: dt.date, horizon: int) -> DataFrame:
    """Keep base dates that some offset can carry into the window.

    The window is on date plus offset, which spans two tables and cannot reach a scan.
    The least and the largest offset are read first, so these two bounds on the date alone
    are literals and do reach it.
    """
    found = offsets.agg(F.min(offset).alias("shortest"), F.max(offset).alias("longest")).first()
    if found.shortest is None:
        return dates.filter(F.lit(False))
    first = as_of - dt.timedelta(days=found.longest)
    last = as_of + dt.timedelta(days=horizon - found.shortest)
    return dates.filter(F.col(column).between(F.lit(first), F.lit(last)))


def _flow(df: DataFrame, project: Column, cash_in: Column, cash_out: Column, source: str) -> DataFrame:
    return df.select(
        project.cast("bigint").alias("project_id"),
        F.col("_due").alias("forecast_date"),
        cash_in.cast(MONEY).alias("expected_cash_in"),
        cash_out.cast(MONEY).alias("expected_cash_out"),
        (cash_in - cash_out).cast(MONEY).alias("net_cashflow"),
        F.lit(source).alias("flow_source"),
        F.lit(FORECAST_RULE).alias("created_by"),
    )


def _in_window(as_of: dt.date, horizon: int, column: str = "_due") -> Column:
    """Both ends count: a horizon of 30 covers 31 days."""
    return F.col(column).between(F.lit(as_of), F.lit(as_of + dt.timedelta(days=horizon)))


def forecast_milestones(T: Tables, as_of: dt.date, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Money expected from customers: unsettled schedule rows falling due."""
    open_rows = (
        T["payment_schedule"]
        .filter(F.col("status").isin(OPEN_SCHEDULE_STATUSES))
        .select("project_id", "due_offset_days", "expected_amount")
    )
    starts = _within(
        T["project"].select("project_id", "start_date"), "start_date", open_rows, "due_offset_days", as_of, horizon
    )
    due = (
        open_rows.join(starts, "project_id")
        .withColumn("_due", F.date_add("start_date", F.col("due_offset_days")))
        .filter(_in_window(as_of, horizon))
    )
    return _flow(due, F.col("project_id"), F.col("expected_amount"), F.lit(0).cast(MONEY), MILESTONE_FLOW)


def forecast_suppliers(T: Tables, as_of: dt.date, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Money owed to suppliers: the order date starts the payment clock."""
    payable = T["ref_order_status"].filter("counts_as_payable").select(F.col("status_code").alias("status"))
    terms = T["supplier"].select("supplier_id", "payment_terms_days")
    orders = _within(T["purchase_order"], "order_date", terms, "payment_terms_days", as_of, horizon)
    due = (
        orders.select("supplier_id", "project_id", "order_date", "total_amount", "status")
        .join(payable, "status", "left_semi")
        .join(terms, "supplier_id")
        .withColumn("_due", F.date_add("order_date", F.col("payment_terms_days")))
        .filter(_in_window(as_of, horizon))
    )
    return _flow(due, F.col("project_id"), F.lit(0).cast(MONEY), F.col("total_amount"), SUPPLIER_FLOW)


def forecast_overhead(T: Tables, as_of: dt.date, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Overhead costs dated inside the window; they belong to no project."""
    due = (
        T["cost"]
        .select("cost_id", "amount", F.col("cost_date").alias("_due"))
        .filter(_in_window(as_of, horizon))
        .join(T["operational_cost"].select("cost_id"), "cost_id")
    )
    return _flow(due, F.lit(None), F.lit(0).cast(MONEY), F.col("amount"), OVERHEAD_FLOW)


def rule_forecast(
    T: Tables, as_of: dt.date, horizon: int = HORIZON_DAYS, run_ts: dt.datetime | None = None
) -> DataFrame:
    """The forecast table with its future part replaced by the three flows."""
    fresh = (
        forecast_milestones(T, as_of, horizon)
        .unionByName(forecast_suppliers(T, as_of, horizon))
        .unionByName(forecast_overhead(T, as_of, horizon))
    )
    past = T.get("cashflow_forecast")
    if past is None:
        return fresh
    stays = past.filter(F.col("forecast_date") < F.lit(as_of))
    fresh = shaped_like(fresh, past, run_ts, "forecast_id", FORECAST_COLUMNS, stays)
    return replace_from_date(past, fresh, "forecast_date", as_of)


def shaped_like(
    fresh: DataFrame,
    past: DataFrame,
    run_ts: dt.datetime | None = None,
    key: str | None = None,
    order: Sequence[str] = (),
    stays: DataFrame | None = None,
) -> DataFrame:
    """New rows with the columns of a table: stamped, otherwise empty, and, if the table has
    ids, with ids in the given order after the highest one that ``stays``; so a run that is
    repeated gives the same ids."""
    missing = [c for c in past.columns if c not in fresh.columns]
    fresh = fresh.withColumns({c: F.lit(None).cast(past.schema[c].dataType) for c in missing})
    fresh = stamp_updated(fresh, F.lit(True), run_ts)
    fresh = stamp_updated(fresh, F.lit(True), run_ts, "created_at")
    if key in past.columns:
        highest = stays.select(F.coalesce(F.max(key), F.lit(0).cast("bigint"))).first()[0]
        fresh = numbered(fresh, key, order, F.lit(highest))
    return fresh.select(*past.columns)


def apply_milestone_rules(
    T: Tables, project_id: int | None = None, run_ts: dt.datetime | None = None
) -> dict[str, DataFrame]:
    """Classify, link and advance; the changed tables come back in a new mapping."""
    invoice = classify_and_link(
        T["invoice"], T["project"], T["payment_schedule"], T["ref_milestone_type"], project_id, run_ts=run_ts
    )
    schedule = rule_advance_schedule(T["payment_schedule"], invoice, project_id, run_ts)
    return {**T, "invoice": invoice, "payment_schedule": schedule}
