"""Reporting views over the tables, and the dashboard queries on top of them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashtide.functions.numbers import date_key
from cashtide.operators.rules import HORIZON_DAYS
from cashtide.operators.skew import join_stored, keep_all_left

Tables = Mapping[str, DataFrame]

# Fixed values of the views.
CASH_BUFFER = 10000
DUE_SOON_DAYS = 7
TOTAL = "decimal(22,2)"
RUNNING_TOTAL = "decimal(32,2)"


def view_cashflow_30day(T: Tables, as_of: dt.date, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Daily cash in, cash out and net over the window, with a running total.

    The fact is summed per day first, so the running total sees one row per day
    of the window and nothing else.
    """
    first, last = F.lit(as_of), F.lit(as_of + dt.timedelta(days=horizon))
    days = T["dim_date"].filter(F.col("full_date").between(first, last)).select("date_key", "full_date")
    daily = (
        T["fact_daily_cashflow"]
        .filter(F.col("date_key").between(date_key(first), date_key(last)))
        .groupBy("date_key")
        .agg(
            F.sum("expected_cash_in").alias("cash_in"),
            F.sum("expected_cash_out").alias("cash_out"),
            F.sum("net_cashflow").alias("net_cashflow"),
        )
    )
    amounts = ["cash_in", "cash_out", "net_cashflow"]
    per_day = (
        days.join(daily, "date_key", "left")
        .groupBy("full_date")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(TOTAL).alias(c) for c in amounts])
    )
    running = Window.orderBy("full_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_day.select(
        "full_date",
        *amounts,
        F.sum("net_cashflow").over(running).cast(RUNNING_TOTAL).alias("cumulative_position"),
    ).orderBy("full_date")


def view_cost_isa_violations(T: Tables) -> DataFrame:
    """Costs that are in neither subtype, or in both."""
    in_project = T["project_cost"].select("cost_id", F.lit(True).alias("_project"))
    in_overhead = T["operational_cost"].select("cost_id", F.lit(True).alias("_overhead"))
    has_project, has_overhead = F.col("_project").isNotNull(), F.col("_overhead").isNotNull()
    return (
        T["cost"]
        .select("cost_id", "cost_category")
        .join(in_project, "cost_id", "left")
        .join(in_overhead, "cost_id", "left")
        .filter(has_project == has_overhead)
        .select(
            "cost_id",
            "cost_category",
            has_project.alias("has_project_subtype"),
            has_overhead.alias("has_overhead_subtype"),
        )
    )


CUSTOMER_COLUMNS = [
    "customer_id",
    "first_name",
    "last_name",
    "company_name",
    "email",
    "phone",
    "street_name",
    "house_number",
    "postal_code",
    "city",
    "country",
]


def view_customer_data_export(T: Tables) -> DataFrame:
    """Everything held about each customer, down to the single payment."""
    payments = T["payment"].select(
        "invoice_id", "payment_date", F.col("amount").alias("payment_amount"), "payment_method"
    )
    invoices = T["invoice"].select(
        "invoice_id",
        "project_id",
        "invoice_number",
        "invoice_date",
        F.col("amount").alias("invoice_amount"),
        F.col("status").alias("invoice_status"),
    )
    projects = T["project"].select(
        "project_id", "customer_id", "project_name", F.col("status").alias("project_status"), "total_value"
    )
    billed = keep_all_left(invoices, payments, ["invoice_id"])
    worked = keep_all_left(projects, billed, ["project_id"], T["invoice"])
    return keep_all_left(T["customer"].select(*CUSTOMER_COLUMNS), worked, ["customer_id"], T["project"]).select(
        *CUSTOMER_COLUMNS,
        "project_id",
        "project_name",
        "project_status",
        "total_value",
        "invoice_number",
        "invoice_date",
        "invoice_amount",
        "invoice_status",
        "payment_date",
        "payment_amount",
        "payment_method",
    )


def view_customer_minimised(T: Tables) -> DataFrame:
    """Customers without anything that identifies them."""
    return T["customer"].select(
        "customer_id",
        "city",
        F.substring("postal_code", 1, 2).alias("postal_area"),
        "country",
        F.col("pseudonymized_at").isNotNull().alias("is_pseudonymised"),
    )


def view_etl_rejections(T: Tables) -> DataFrame:
    """Rejected import rows, newest run first.

    All rows of a batch have the run in common, so the runs are stored first: joined on
    their measured size, the rows are not brought together by run.
    """
    runs = T["etl_run"].select("run_id", "source_filename", "started_at")
    return (
        join_stored(T["stg_sevdesk_invoice"].filter(~F.col("is_valid")), runs, ["run_id"], "inner")
        .select(
            "run_id",
            "source_filename",
            "started_at",
            "row_number",
            "raw_invoice_number",
            "raw_project_id",
            "raw_amount",
            "rejection_reason",
        )
        .orderBy(F.desc("started_at"), "row_number")
    )


def view_liquidity_alert(
    T: Tables, as_of: dt.date, horizon: int = HORIZON_DAYS, buffer: int = CASH_BUFFER
) -> DataFrame:
    """Days on which the running position is below the cash buffer."""
    position = F.col("cumulative_position")
    return (
        view_cashflow_30day(T, as_of, horizon)
        .filter(position < buffer)
        .select(
            "full_date",
            "cumulative_position",
            F.when(position < 0, "NEGATIVE").otherwise("BELOW_BUFFER").alias("liquidity_status"),
        )
        .orderBy("full_date")
    )


def view_payment_schedule(T: Tables) -> DataFrame:
    """The schedule with the label and share of each milestone."""
    labels = T["ref_milestone_type"].select("milestone_code", "milestone_label", "percentage")
    stamps = [c for c in ("created_at", "updated_at") if c in T["payment_schedule"].columns]
    return (
        T["payment_schedule"]
        .join(labels, "milestone_code")
        .select(
            "schedule_id",
            "project_id",
            "milestone_code",
            "milestone_label",
            "percentage",
            "due_offset_days",
            "expected_amount",
            "status",
            *stamps,
        )
    )


def _sum_by_project(df: DataFrame, amount: str, name: str) -> DataFrame:
    return df.groupBy("project_id").agg(F.sum(amount).alias(name))


def billing_by_project(invoice: DataFrame, payment: DataFrame) -> DataFrame:
    """Invoiced and received totals per project, in one grouping: payments are summed per
    invoice and join its row."""
    paid = payment.groupBy("invoice_id").agg(F.sum("amount").alias("_paid"))
    return (
        invoice.select("invoice_id", "project_id", "amount")
        .join(paid, "invoice_id", "left")
        .groupBy("project_id")
        .agg(F.sum("amount").alias("invoiced_to_date"), F.sum("_paid").alias("received_to_date"))
    )


def view_project_profitability(T: Tables) -> DataFrame:
    """Value, costs, margin and billing of each project."""
    direct = _sum_by_project(
        T["project_cost"].select("cost_id", "project_id").join(T["cost"].select("cost_id", "amount"), "cost_id"),
        "amount",
        "direct_cost",
    )
    supplied = _sum_by_project(T["purchase_order"], "total_amount", "supplier_cost")
    billing = billing_by_project(T["invoice"], T["payment"])
    joined = T["project"].select("project_id", "customer_id", "project_name", "status", "total_value")
    for totals in (direct, supplied, billing):
        joined = joined.join(totals, "project_id", "left")
    joined = joined.join(T["customer"].select("customer_id", "city"), "customer_id")

    def amount(name):
        return F.coalesce(F.col(name), F.lit(0)).cast(TOTAL)

    margin = (F.col("total_value") - amount("direct_cost") - amount("supplier_cost")).cast(TOTAL)
    return joined.select(
        "project_id",
        "project_name",
        "city",
        "status",
        "total_value",
        amount("direct_cost").alias("direct_cost"),
        amount("supplier_cost").alias("supplier_cost"),
        margin.alias("gross_margin"),
        F.round(margin * 100 / F.nullif(F.col("total_value"), F.lit(0).cast("decimal(12,2)")), 1)
        .cast("decimal(22,1)")
        .alias("margin_pct"),
        amount("invoiced_to_date").alias("invoiced_to_date"),
        amount("received_to_date").alias("received_to_date"),
    )


def _payable_orders(T: Tables, as_of: dt.date, due_soon_days: int) -> DataFrame:
    """Payable orders with their due date, days left and alert level."""
    payable = T["ref_order_status"].filter("counts_as_payable").select(F.col("status_code").alias("status"))
    supplier = T["supplier"].select("supplier_id", "supplier_name", "credit_limit", "payment_terms_days")
    due = F.date_add("order_date", F.col("payment_terms_days"))
    days_left = F.datediff(F.col("payment_due_date"), F.lit(as_of))
    return (
        T["purchase_order"]
        .join(payable, "status", "left_semi")
        .join(supplier, "supplier_id")
        .withColumn("payment_due_date", due)
        .withColumn("days_until_due", days_left)
        .withColumn(
            "alert_level",
            F.when(F.col("days_until_due") < 0, "OVERDUE")
            .when(F.col("days_until_due") <= due_soon_days, "DUE_SOON")
            .otherwise("SCHEDULED"),
        )
    )


def view_supplier_watch(T: Tables, as_of: dt.date, due_soon_days: int = DUE_SOON_DAYS) -> DataFrame:
    """Payable orders by payment due date, with an alert level."""
    return (
        _payable_orders(T, as_of, due_soon_days)
        .join(T["project"].select("project_id", "project_name"), "project_id")
        .select(
            "order_id",
            "supplier_name",
            "credit_limit",
            "payment_terms_days",
            "project_name",
            "order_date",
            "expected_delivery_date",
            "payment_due_date",
            "days_until_due",
            "total_amount",
            "status",
            "alert_level",
        )
        .orderBy("payment_due_date", "order_id")
    )


KPI_COLUMNS = [
    "outstanding_receivables",
    "supplier_due_7_days",
    "projected_30day_net",
    "active_projects",
    "days_negative_next_30",
]


def view_dashboard_kpi(T: Tables, as_of: dt.date, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Five figures in one row.

    Each figure is a one-row aggregate; they are stacked and folded into one row
    rather than joined.
    """
    receivable = T["ref_invoice_status"].filter("counts_as_receivable").select(F.col("status_code").alias("status"))
    running = T["ref_project_status"].filter("NOT is_terminal").select(F.col("status_code").alias("status"))
    due = (
        _payable_orders(T, as_of, DUE_SOON_DAYS)
        .filter(F.col("alert_level") != "SCHEDULED")
        .join(T["project"].select("project_id"), "project_id", "left_semi")
    )
    zero = F.lit(0).cast(RUNNING_TOTAL)
    money = [
        T["invoice"]
        .join(receivable, "status", "left_semi")
        .agg(F.coalesce(F.sum("amount").cast(RUNNING_TOTAL), zero).alias("outstanding_receivables")),
        due.agg(F.coalesce(F.sum("total_amount").cast(RUNNING_TOTAL), zero).alias("supplier_due_7_days")),
    ]
    days = view_cashflow_30day(T, as_of, horizon).agg(
        F.coalesce(F.sum("net_cashflow").cast(RUNNING_TOTAL), zero).alias("projected_30day_net"),
        F.count_if(F.col("cumulative_position") < 0).alias("days_negative_next_30"),
    )
    projects = T["project"].join(running, "status", "left_semi").agg(F.count(F.lit(1)).alias("active_projects"))
    stacked = days
    for part in (*money, projects):
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in KPI_COLUMNS])


def dash_stats(T: Tables, as_of: dt.date) -> DataFrame:
    """The KPI row under its display names, empty figures as zero."""
    # Display names of the figures.
    names = ["outstandingReceivables", "supplierPaymentsDue", "netCashPosition30d", "activeProjects", "daysNegativeNext30"]
    kpi = view_dashboard_kpi(T, as_of)
    return kpi.select(
        *[F.coalesce(F.col(c), F.lit(0)).cast(kpi.schema[c].dataType).alias(n) for c, n in zip(KPI_COLUMNS, names)]
    )


def dash_cashflow_chart(T: Tables, as_of: dt.date) -> DataFrame:
    return view_cashflow_30day(T, as_of).withColumnRenamed("full_date", "forecast_date")


def dash_active_projects(T: Tables) -> DataFrame:
    """Running projects with billing totals and milestone progress.

    Billing comes from its totals directly; the other columns of the profitability view
    are not computed, and only invoices of running projects are summed.
    """
    order = T["ref_project_status"].filter("NOT is_terminal").select(F.col("status_code").alias("status"), "sort_order")
    running = T["project"].join(order.select("status"), "status", "left_semi").select("project_id")
    billing = billing_by_project(T["invoice"].join(running, "project_id", "left_semi"), T["payment"])
    # The profitability view only knows projects of a known customer.
    known = T["customer"].select("customer_id", F.lit(True).alias("_known"))
    progress = (
        T["payment_schedule"]
        .groupBy("project_id")
        .agg(F.count_if(F.col("status") == "Paid").alias("_paid"), F.count(F.lit(1)).alias("_total"))
    )

    def shown(name):
        return F.coalesce(F.when(F.col("_known"), F.col(name)), F.lit(0)).cast(TOTAL).alias(name)

    def milestones(name):
        return F.coalesce(F.col(name), F.lit(0)).cast("string")

    return (
        T["project"]
        .join(order, "status")
        .join(billing, "project_id", "left")
        .join(progress, "project_id", "left")
        .join(known, "customer_id", "left")
        .orderBy("sort_order", "start_date", "project_id")
        .select(
            "project_id",
            "project_name",
            "total_value",
            "status",
            shown("invoiced_to_date"),
            shown("received_to_date"),
            F.concat(milestones("_paid"), F.lit("/"), milestones("_total")).alias("milestone_progress"),
        )
    )


def dash_supplier_watch(T: Tables, as_of: dt.date) -> DataFrame:
    return view_supplier_watch(T, as_of).drop("credit_limit", "payment_terms_days", "expected_delivery_date")
