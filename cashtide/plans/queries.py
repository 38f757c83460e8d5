"""One query per operator, over the derived domain tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtide.functions.numbers import without_spaces
from cashtide.operators import audit, imports, increment, ledger, mutate, privacy, rebase, rules, star, storno, views
from cashtide.operators.pipeline import rule_pipeline
from cashtide.plans.derived import AS_OF, DOMAIN_TABLES, LEDGER_YEAR, RUN_TS, SALT, STORED, Derived
from cashtide.schemas import TABLES
from cashtide.session import materialise, scratch_path
from cashtide.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Callable[[Derived], DataFrame], stored: Sequence[str] = ()) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(Derived(spark, sf_dir, stored))

    run.__name__ = function.__name__
    run.__doc__ = function.__doc__
    QUERIES[function.__name__] = run
    return run


def query_of_many_readers(function: Callable[[Derived], DataFrame]) -> Query:
    """A query whose steps read the line documents so often, in plans of their own or with other
    columns, that storing them once is less work than grouping them for each."""
    return query(function, STORED)


# --- shared stages -----------------------------------------------------------


# Tables that single stages read, so that the others are not planned, and the outputs of a transform.
RULED = ("project", "invoice", "ref_milestone_type")
TRANSFORMED = ("customers", "suppliers", "invoices_for_pipeline", "payments", "costs", "supplier_payments")
WATCHED = ("purchase_order", "supplier", "project", "ref_order_status")


def scheduled(d: Derived, *names: str) -> dict[str, DataFrame]:
    """Tables with a schedule generated over the one left by an earlier run."""
    T = d.tables(*names)
    T["payment_schedule"] = rules.rule_payment_schedule(T["project"], T["ref_milestone_type"], d["schedule_before"])
    return T


def ruled(d: Derived, *names: str) -> dict[str, DataFrame]:
    """Tables after classification, linking and advancing."""
    return rules.apply_milestone_rules(scheduled(d, *names))


def with_past(d: Derived, T: dict[str, DataFrame], ids: bool = False) -> dict[str, DataFrame]:
    """Forecast, fact and dimensions as an earlier run left them, with the ids of their rows if asked for."""
    dim = d["cost_types_before"]
    forecast, fact = d["forecast_before"], d["fact_before"]
    if ids:
        forecast = forecast.withColumn("forecast_id", F.col("project_id"))
        fact = fact.withColumn("fact_id", F.col("project_key"))
    key = star.cost_type_key(F.col("cost_category"), F.col("cost_subcategory"))
    return {
        **T,
        "cashflow_forecast": forecast,
        "fact_daily_cashflow": fact,
        "dim_date": star.calendar_rows(d["days_before"]),
        "dim_project": d["dim_project_before"],
        "dim_customer": d["dim_customer_before"],
        "dim_cost_type": dim.select(
            key.alias("cost_type_key"), "cost_category", "cost_subcategory", "is_indirect"
        ),
    }


def starred(d: Derived, ids: bool = False) -> dict[str, DataFrame]:
    """Tables after the whole chain."""
    return rule_pipeline({**with_past(d, d.tables(), ids), "payment_schedule": d["schedule_before"]}, AS_OF)


def settled(d: Derived, *names: str) -> dict[str, DataFrame]:
    """Tables after the rules, with the schedule stored as the forecast finds it."""
    T = ruled(d, *names)
    return {**T, "payment_schedule": materialise(T["payment_schedule"])}


def classified(d: Derived) -> DataFrame:
    return ledger.ledger_classify(ledger.ledger_parse(d["ledger"], LEDGER_YEAR))


def revenue(d: Derived) -> DataFrame:
    return ledger.of_class(classified(d), ledger.REVENUE)


def stored_postings(d: Derived) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings stored once, credit matches and live invoices."""
    stored = ledger.ledger_stored(classified(d))
    rows = ledger.of_class(stored, ledger.REVENUE)
    matches = storno.ledger_storno_match(rows)
    return stored, matches, storno.ledger_live_invoices(rows, matches)


def batch(d: Derived, block: str = "staging") -> DataFrame:
    """A raw batch in the shape the readers give."""
    return d[block].select("row_number", *[F.col(f"raw_{c}").alias(c) for c in imports.RAW_FIELDS])


def validated(d: Derived, block: str = "staging") -> DataFrame:
    T = d.tables("project", "ref_invoice_status")
    return imports.import_validate(imports.import_stage(batch(d, block), 1), T["project"], T["ref_invoice_status"])


def run_log(d: Derived, staged: DataFrame) -> DataFrame:
    opened = imports.import_run_open(staged, "batch.csv", "tester", RUN_TS)
    return imports.import_run_log(opened, imports.import_run_status(staged), RUN_TS)


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Instants as text, so that engines with other instant types can compare."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


def digests(frames: dict[str, DataFrame], empty: str = "~") -> DataFrame:
    """Per table its rows and a digest of all values of all columns, whatever the order of rows;
    ``empty`` stands for missing values."""
    parts = []
    for name, df in frames.items():
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(empty)) for c in sorted(df.columns)])
        value = F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 15), 16, 10).cast("decimal(38,0)")
        row = df.select(value.alias("v")).agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("v"), F.lit(0)).cast("string").alias("digest"))
        parts.append(row.select(F.lit(name).alias("table_name"), "row_count", "digest"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- sources and sinks -------------------------------------------------------


@query
def source_invoice_csv(d: Derived) -> DataFrame:
    path = scratch_path(d.spark, "batch")
    batch(d).orderBy("row_number").drop("row_number").write.option("header", True).option("emptyValue", "").csv(path)
    rows = readers.read_invoice_csv(d.spark, path)
    return rows.select("row_number", *[without_spaces(F.col(c)).alias(c) for c in imports.RAW_FIELDS])


@query
def source_invoice_json(d: Derived) -> DataFrame:
    record = F.struct(
        *[F.col(f"raw_{c}").alias(c) for c in imports.RAW_FIELDS if c != "amount"],
        F.col("raw_row").cast("decimal(12,2)").alias("amount"),
        F.lit("x").alias("ignored"),
    )
    short = F.struct(F.concat(F.lit("  "), F.col("raw_invoice_number"), F.lit(" ")).alias("invoice_number"))
    payloads = d["staging"].withColumn("raw_row", F.col("row_number")).select(
        F.col("row_number").alias("payload_id"),
        F.concat(F.lit("["), F.to_json(record), F.lit(","), F.to_json(short), F.lit("]")).alias("payload"),
    )
    return readers.read_invoice_json(payloads)


@query
def source_ledger_csv(d: Derived) -> DataFrame:
    path = scratch_path(d.spark, "ledger")
    named = [F.col(short).alias(name) for short, name in readers.LEDGER_COLUMNS.items() if short != "vat"]
    d["ledger"].orderBy("line").select(*named).write.option("header", True).option("emptyValue", "").csv(path)
    rows = readers.read_ledger_csv(d.spark, path)
    return rows.withColumn("name", F.coalesce("name", F.lit("")))


@query
def source_load_tables(d: Derived) -> DataFrame:
    """All values of every table, written and loaded again, and of the built-in domains."""
    path = scratch_path(d.spark, "tables")
    T = {**{name: d[block] for name, block in DOMAIN_TABLES.items()}, "product": d["product"], "project_product": d["project_product"]}
    for name, df in T.items():
        df.write.parquet(f"{path}/{name}")
    loaded = readers.load_tables(d.spark, path, T)
    return digests({name: df.select(*T[name].columns) if name in T else df for name, df in loaded.items()})


@query
def sink_csv_outputs(d: Derived) -> DataFrame:
    """All values of the six outputs of a transform, as read back from their files."""
    path = scratch_path(d.spark, "outputs")
    done = ledger.ledger_transform(d["ledger"], LEDGER_YEAR, SALT)
    outputs = {name: done[name] for name in TRANSFORMED}
    writers.write_csv_outputs(outputs, path)
    options = {"header": True, "quote": '"', "escape": '"', "enforceSchema": False}
    text = {name: ", ".join(f"{c} string" for c in df.columns) for name, df in outputs.items()}
    return digests({name: d.spark.read.options(**options).csv(f"{path}/{name}", schema=text[name]) for name in outputs}, empty="")


@query
def sink_snapshot(d: Derived) -> DataFrame:
    path = scratch_path(d.spark, "store")
    writers.write_snapshot({"project": d["project"], "supplier": d["supplier_dim"]}, path, 1, RUN_TS)
    renamed = d["project"].withColumn("project_name", F.upper("project_name"))
    writers.write_snapshot({"project": renamed}, path, 2, RUN_TS)
    current = writers.read_snapshot(d.spark, path)
    return current["project"].select("project_id", "project_name", "total_value")


@query
def sink_append_log(d: Derived) -> DataFrame:
    path = scratch_path(d.spark, "log")
    staged = materialise(validated(d))
    opened = imports.import_run_open(staged, "batch.csv", "tester", RUN_TS)
    writers.append_log(opened, path)
    writers.append_log(run_log(d, staged), path)
    return as_text(d.spark.read.parquet(path), "started_at", "finished_at")


# --- changes to tables -------------------------------------------------------


@query
def mutate_upsert(d: Derived) -> DataFrame:
    incoming = d["dim_project_before"].withColumn("total_value", F.col("total_value") + 5)
    return mutate.upsert(
        d["project"].select("project_id", "project_name", "status", "total_value"),
        incoming.select("project_id", "project_name", "status", "total_value"),
        ["project_id"],
        ["project_name", "total_value"],
    )


@query
def mutate_update_where_distinct(d: Derived) -> DataFrame:
    target = d["customer_rec"].select("customer_id", "company_name")
    source = d["customer_rec"].filter("customer_id % 3 = 0").select(
        "customer_id", F.when(F.col("customer_id") % 2 == 0, F.col("last_name")).alias("company_name")
    )
    return mutate.update_where_distinct(target, source, ["customer_id"], "company_name")


@query
def mutate_replace_from_date(d: Derived) -> DataFrame:
    fresh = d["forecast_before"].withColumn("created_by", F.lit("fresh")).filter("project_id % 4 = 0")
    return mutate.replace_from_date(d["forecast_before"], fresh, "forecast_date", AS_OF)


@query
def mutate_stamp_updated(d: Derived) -> DataFrame:
    dated = d["project"].select("project_id", "status", F.lit(None).cast("timestamp").alias("updated_at"))
    return as_text(mutate.stamp_updated(dated, F.col("status") == "Completed", RUN_TS), "updated_at")


# --- business rules ----------------------------------------------------------


@query
def rule_payment_schedule(d: Derived) -> DataFrame:
    return scheduled(d, "project", "ref_milestone_type")["payment_schedule"]


@query
def rule_classify_invoices(d: Derived) -> DataFrame:
    classified_invoices = rules.rule_classify_invoices(d["invoice"], d["project"])
    return classified_invoices.select("invoice_id", "project_id", "invoice_number", "amount", "milestone_code")


@query
def rule_link_schedule(d: Derived) -> DataFrame:
    T = scheduled(d, *RULED)
    coded = rules.rule_classify_invoices(T["invoice"], T["project"])
    linked = rules.rule_link_schedule(coded, T["payment_schedule"], T["ref_milestone_type"])
    return linked.select("invoice_id", "milestone_code", "schedule_id")


@query
def rule_advance_schedule(d: Derived) -> DataFrame:
    return ruled(d, *RULED)["payment_schedule"]


@query
def rule_forecast(d: Derived) -> DataFrame:
    return rules.rule_forecast(with_past(d, settled(d), ids=True), AS_OF)


@query
def rule_pipeline_totals(d: Derived) -> DataFrame:
    """The whole chain, as counts and sums per kind of row."""
    T = starred(d)

    def totals(table: str, kind: str, amount: str) -> DataFrame:
        return (
            T[table]
            .groupBy(F.coalesce(F.col(kind).cast("string"), F.lit("-")).alias("kind"))
            .agg(F.count(F.lit(1)).alias("row_count"), F.sum(amount).cast("decimal(22,2)").alias("amount"))
            .select(F.lit(table).alias("table_name"), "kind", "row_count", "amount")
        )

    return (
        totals("payment_schedule", "status", "expected_amount")
        .unionByName(totals("invoice", "milestone_code", "amount"))
        .unionByName(totals("cashflow_forecast", "flow_source", "net_cashflow"))
        .unionByName(totals("fact_daily_cashflow", "date_key", "net_cashflow"))
    )


@query
def forecast_milestones(d: Derived) -> DataFrame:
    return rules.forecast_milestones(settled(d, *RULED), AS_OF)


@query
def forecast_suppliers(d: Derived) -> DataFrame:
    return rules.forecast_suppliers(d.tables("purchase_order", "supplier", "ref_order_status"), AS_OF)


@query
def forecast_overhead(d: Derived) -> DataFrame:
    return rules.forecast_overhead(d.tables("cost", "operational_cost"), AS_OF)


# --- star schema -------------------------------------------------------------


@query
def star_dim_date(d: Derived) -> DataFrame:
    return star.star_dim_date(d.spark, AS_OF, dim=star.calendar_rows(d["days_before"]))


@query
def star_dim_project(d: Derived) -> DataFrame:
    return star.star_dim_project(d["project"], d["dim_project_before"])


@query
def star_dim_customer(d: Derived) -> DataFrame:
    return star.star_dim_customer(d["customer_rec"], d["dim_customer_before"])


@query
def star_dim_cost_type(d: Derived) -> DataFrame:
    T = with_past(d, d.tables("ref_direct_cost_type", "ref_overhead_category"))
    return star.star_dim_cost_type(T["ref_direct_cost_type"], T["ref_overhead_category"], T["dim_cost_type"])


@query
def star_fact(d: Derived) -> DataFrame:
    return starred(d, ids=True)["fact_daily_cashflow"]


@query
def star_refresh(d: Derived) -> DataFrame:
    """All values of the refreshed tables."""
    T = starred(d)
    return digests({name: T[name] for name in ("dim_date", "dim_project", "dim_customer", "dim_cost_type", "fact_daily_cashflow")})


# --- views and dashboard -----------------------------------------------------


@query
def view_cashflow_30day(d: Derived) -> DataFrame:
    return views.view_cashflow_30day(starred(d), AS_OF)


@query
def view_cost_isa_violations(d: Derived) -> DataFrame:
    return views.view_cost_isa_violations(d.tables("cost", "project_cost", "operational_cost"))


@query_of_many_readers
def view_customer_data_export(d: Derived) -> DataFrame:
    return views.view_customer_data_export(d.tables("customer", "project", "invoice", "payment"))


@query
def view_customer_minimised(d: Derived) -> DataFrame:
    return views.view_customer_minimised(d.tables("customer"))


@query
def view_dashboard_kpi(d: Derived) -> DataFrame:
    return views.view_dashboard_kpi(starred(d), AS_OF)


@query
def view_etl_rejections(d: Derived) -> DataFrame:
    staged = materialise(validated(d))
    T = {"stg_sevdesk_invoice": staged, "etl_run": run_log(d, staged)}
    return as_text(views.view_etl_rejections(T), "started_at")


@query
def view_liquidity_alert(d: Derived) -> DataFrame:
    """Alert days of the moved calendar, which opens below zero."""
    moved, _ = rebase.rebase_dates(with_past(d, d.tables()), AS_OF)
    return views.view_liquidity_alert(moved, AS_OF)


@query
def view_payment_schedule(d: Derived) -> DataFrame:
    return views.view_payment_schedule(ruled(d, *RULED))


@query
def view_project_profitability(d: Derived) -> DataFrame:
    return views.view_project_profitability(
        d.tables("customer", "project", "invoice", "payment", "purchase_order", "cost", "project_cost")
    )


@query
def view_supplier_watch(d: Derived) -> DataFrame:
    return views.view_supplier_watch(d.tables(*WATCHED), AS_OF)


@query
def dash_stats(d: Derived) -> DataFrame:
    return views.dash_stats(starred(d), AS_OF)


@query
def dash_cashflow_chart(d: Derived) -> DataFrame:
    return views.dash_cashflow_chart(starred(d), AS_OF)


@query_of_many_readers
def dash_active_projects(d: Derived) -> DataFrame:
    return views.dash_active_projects(ruled(d, *RULED, "customer", "payment", "ref_project_status"))


@query
def dash_supplier_watch(d: Derived) -> DataFrame:
    return views.dash_supplier_watch(d.tables(*WATCHED), AS_OF)


# --- import ------------------------------------------------------------------


@query
def import_stage(d: Derived) -> DataFrame:
    return as_text(imports.import_stage(batch(d), 1), "promoted_at")


@query
def import_validate(d: Derived) -> DataFrame:
    return validated(d).select("run_id", "row_number", "is_valid", "rejection_reason")


@query
def import_promote(d: Derived) -> DataFrame:
    coded = d["invoice"].withColumn("created_by", F.lit("seed"))
    return imports.import_promote(coded, validated(d, "rerun_staging"), RUN_TS)


@query
def import_run_status(d: Derived) -> DataFrame:
    return imports.import_run_status(validated(d))


@query
def import_rejections(d: Derived) -> DataFrame:
    return imports.import_rejections(validated(d))


@query
def import_run_log(d: Derived) -> DataFrame:
    return as_text(run_log(d, materialise(validated(d))), "started_at", "finished_at")


@query_of_many_readers
def import_report(d: Derived) -> DataFrame:
    staged = materialise(validated(d))
    return imports.import_report(run_log(d, staged), staged, views.view_dashboard_kpi(starred(d), AS_OF))


def before_import(d: Derived) -> dict[str, DataFrame]:
    T = with_past(d, d.tables())
    return {**T, "invoice": T["invoice"].withColumn("created_by", F.lit("seed")), "payment_schedule": d["schedule_before"]}


def imported(done: dict[str, DataFrame]) -> DataFrame:
    """All values of the ten tables that an import changes, and of its report."""
    changed = digests({name: done[name] for name in increment.LIVE})
    report = done["report"].select(F.lit("report").alias("table_name"), F.col("seq").alias("row_count"), F.col("text").alias("digest"))
    return changed.unionByName(report)


@query_of_many_readers
def import_run(d: Derived) -> DataFrame:
    """A batch through the whole import."""
    return imported(imports.import_run(before_import(d), batch(d, "rerun_staging"), AS_OF, RUN_TS, "batch.csv", "tester"))


@query_of_many_readers
def import_increment(d: Derived) -> DataFrame:
    """The same batch into tables that were laid out after a run of the chain: only partitions
    that it touches are read and written."""
    folder = scratch_path(d.spark, "live")
    T = before_import(d)
    increment.create_live(T, folder, AS_OF, RUN_TS, buckets=32)
    return imported(increment.import_live(folder, T, batch(d, "rerun_staging"), AS_OF, RUN_TS, "batch.csv", "tester"))


# --- ledger ------------------------------------------------------------------


@query
def ledger_parse(d: Derived) -> DataFrame:
    return ledger.ledger_parse(d["ledger"], LEDGER_YEAR).select("line", "amount", "quarantined", "doc", "text", "name")


@query
def ledger_date(d: Derived) -> DataFrame:
    return ledger.ledger_date(d["ledger"], LEDGER_YEAR).select("line", "belegdatum", "date")


@query
def ledger_account_class(d: Derived) -> DataFrame:
    return ledger.ledger_account_class(d["ledger"]).select("line", "gegenkonto", "account_class")


@query
def ledger_classify(d: Derived) -> DataFrame:
    return classified(d).select("line", "konto", "account_class", "posting_class")


@query
def ledger_storno_match(d: Derived) -> DataFrame:
    return storno.ledger_storno_match(revenue(d))


@query
def ledger_live_invoices(d: Derived) -> DataFrame:
    _, _, live = stored_postings(d)
    return live.select("line", "doc", "geg", "amount", "date")


@query
def ledger_invoices_out(d: Derived) -> DataFrame:
    stored, _, live = stored_postings(d)
    return ledger.ledger_invoices_out(live, ledger.of_class(stored, ledger.CUSTOMER_PAYMENT))


@query
def ledger_payments_out(d: Derived) -> DataFrame:
    return ledger.ledger_payments_out(classified(d))


@query
def ledger_costs_out(d: Derived) -> DataFrame:
    return ledger.ledger_costs_out(classified(d), SALT)


@query
def ledger_supplier_payments_out(d: Derived) -> DataFrame:
    return ledger.ledger_supplier_payments_out(classified(d), SALT)


@query
def ledger_debtor_names(d: Derived) -> DataFrame:
    return ledger.ledger_debtor_names(classified(d))


@query
def ledger_creditor_names(d: Derived) -> DataFrame:
    return ledger.ledger_creditor_names(classified(d))


@query
def ledger_customers_out(d: Derived) -> DataFrame:
    return ledger.ledger_customers_out(ledger.ledger_debtor_names(classified(d)), SALT)


@query
def ledger_suppliers_out(d: Derived) -> DataFrame:
    return ledger.ledger_suppliers_out(ledger.ledger_creditor_names(classified(d)), SALT)


@query
def ledger_unmatched_payments(d: Derived) -> DataFrame:
    stored, _, live = stored_postings(d)
    return ledger.ledger_unmatched_payments(ledger.of_class(stored, ledger.CUSTOMER_PAYMENT), live)


@query
def ledger_report(d: Derived) -> DataFrame:
    return ledger.ledger_report(*stored_postings(d))


@query
def ledger_report_lines(d: Derived) -> DataFrame:
    stored, matches, live = stored_postings(d)
    unmatched = ledger.ledger_unmatched_payments(ledger.of_class(stored, ledger.CUSTOMER_PAYMENT), live)
    lines = ledger.ledger_report_lines(ledger.ledger_report(stored, matches, live), matches, unmatched)
    return lines.select("section", "text")


# --- privacy and calendar ----------------------------------------------------


@query
def pseudonymise_names(d: Derived) -> DataFrame:
    names = d["customer_rec"].select(
        "customer_id", F.coalesce("company_name", "last_name").alias("person"), F.lit("").alias("company")
    )
    person = privacy.pseudonymise_names(names, "person", "person", SALT)
    return privacy.pseudonymise_names(person, "company", "company", SALT, "customer_id")


@query
def pseudonymise_addresses(d: Derived) -> DataFrame:
    rows = d["customer_rec"].select("customer_id", "street_name", "house_number", "postal_code", "city")
    return privacy.pseudonymise_addresses(rows, "customer_id")


def erasable(d: Derived) -> dict[str, DataFrame]:
    return {**d.tables("customer", "project", "ref_invoice_status"), "invoice": d["settled_invoice"]}


def verdicts(d: Derived) -> DataFrame:
    return privacy.erasure_check(erasable(d), d["erasure_request"])


@query
def erasure_check(d: Derived) -> DataFrame:
    return verdicts(d)


@query
def erasure_apply(d: Derived) -> DataFrame:
    done = privacy.erasure_apply(erasable(d), verdicts(d), RUN_TS)
    return as_text(done["customer"], "pseudonymized_at")


@query
def erasure_log(d: Derived) -> DataFrame:
    return as_text(privacy.erasure_log(verdicts(d), "tester", RUN_TS), "requested_at", "executed_at")


@query
def erase_customers(d: Derived) -> DataFrame:
    T = {**erasable(d), "dim_customer": star.star_dim_customer(d["customer_rec"])}
    return privacy.erase_customers(T, d["erasure_request"], RUN_TS, "tester")["dim_customer"]


@query
def rebase_dates(d: Derived) -> DataFrame:
    """The moved calendar as seen by the daily cash flow."""
    moved, _ = rebase.rebase_dates(with_past(d, d.tables()), AS_OF)
    return views.view_cashflow_30day(moved, AS_OF)


@query_of_many_readers
def rebase_report(d: Derived) -> DataFrame:
    """The report of moving the calendar, its numbers as rows."""
    _, report = rebase.rebase_dates(with_past(d, d.tables()), AS_OF)
    shape = (
        "shiftDays int, anchorRule string, rowsShifted struct<project: bigint, purchase_order: bigint, cost: bigint, invoice: bigint, "
        "payment: bigint>, liquidityAlerts array<struct<date: date, position: decimal(32,2), status: string>>, kpiAfterRebase struct<"
        + ", ".join(f"{c}: {'bigint' if c in ('active_projects', 'days_negative_next_30') else 'decimal(32,2)'}" for c in views.KPI_COLUMNS)
        + ">"
    )
    read = report.select(F.from_json("report", shape).alias("r"))
    alert = F.transform("r.liquidityAlerts", lambda a: F.concat_ws(" ", a["date"].cast("string"), a["position"].cast("string"), a["status"]))
    alerts = F.array_join(alert, ", ").alias("alerts")
    return read.select("r.shiftDays", "r.anchorRule", "r.rowsShifted.*", alerts, "r.kpiAfterRebase.*")


# --- audits ------------------------------------------------------------------


# The tables that the chain writes.
WRITTEN = (
    "payment_schedule", "invoice", "cashflow_forecast", "fact_daily_cashflow", "dim_date", "dim_project", "dim_customer", "dim_cost_type",
)
_AUDITED: dict[tuple[str, str], dict[str, DataFrame]] = {}


def audited_tables(d: Derived) -> dict[str, DataFrame]:
    """Every declared table: the given ones, those the chain writes as it leaves them, and the
    logs of an import and of erasures.

    The chain runs once for a session and a directory; its tables are stored, and all audits
    read those.
    """
    place = (d.spark.sparkContext.applicationId, d.directory)
    if place not in _AUDITED:
        before = {**with_past(d, d.tables(), ids=True), "payment_schedule": d["schedule_before"]}
        done = rule_pipeline(before, AS_OF, pin=("payment_schedule", "invoice", "cashflow_forecast"))
        staged = materialise(validated(d))
        pinned = ("payment_schedule", "invoice", "cashflow_forecast")
        _AUDITED[place] = {
            **done,
            **{name: materialise(done[name]) for name in WRITTEN if name not in pinned},
            "payment": materialise(done["payment"]),
            "product": d["product"],
            "project_product": d["project_product"],
            "etl_run": run_log(d, staged),
            "stg_sevdesk_invoice": staged,
            "data_erasure_log": materialise(privacy.erasure_log(verdicts(d), "tester", RUN_TS)),
        }
    return _AUDITED[place]


def _stack(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _declared(d: Derived) -> list[tuple[str, DataFrame, list]]:
    """Each table with its keys and dependencies; the key of postings is not unique."""
    frames = [("posting", d["posting_key"], [(("l_orderkey", "l_linenumber"), ["l_partkey", "l_suppkey"], True)])]
    return frames + [(name, df, audit.declared_rules(name, df.columns)) for name, df in audited_tables(d).items()]


@query_of_many_readers
def audit_keys(d: Derived) -> DataFrame:
    """One pass over every table, and one grouping of all their keys."""
    tables = [(name, df, [(key, []) for key, _, unique in found if unique]) for name, df, found in _declared(d)]
    labels = [(name, ", ".join(key)) for name, _, found in tables for key, _ in found]
    groups = audit.key_groups([(df, found) for _, df, found in tables]).filter("occurrences > 1")
    named = audit.named_rules(groups, ("table_name", [n for n, _ in labels]), ("key_columns", [k for _, k in labels]))
    return named.select("table_name", "key_columns", "key_value", "occurrences")


@query_of_many_readers
def audit_foreign_keys(d: Derived) -> DataFrame:
    """One pass over every child; the keys of a parent are stored once for all references to it."""
    T, indexes, found = audited_tables(d), {}, []
    for name, df in T.items():
        references = []
        for r in TABLES[name].references:
            if r.parent in T and set(r.columns) <= set(df.columns):
                place = (r.parent, tuple(r.parent_columns))
                if place not in indexes:
                    indexes[place] = audit.key_index(T[r.parent], r.parent_columns)
                references.append((r.parent, r.columns, indexes[place]))
        if references:
            orphans = audit.audit_references(df, references)
            found.append(orphans.select(F.lit(name).alias("table_name"), F.col("reference").alias("parent"), "key_value", "orphan_rows"))
    return _stack(found)


@query_of_many_readers
def audit_checks(d: Derived) -> DataFrame:
    found = []
    for name, df in audited_tables(d).items():
        table = TABLES[name]
        broken = audit.audit_checks(df, audit.table_predicates(table, df.columns))
        key = table.primary_key
        found.append(
            broken.select(
                F.lit(name).alias("table_name"),
                audit.key_text(key).alias("key_value"),
                F.explode("broken_checks").alias("broken_check"),
            )
        )
    return _stack(found)


@query_of_many_readers
def audit_functional_dependency(d: Derived) -> DataFrame:
    """One pass and one grouping for all determinants: what occurs once determines anything.  Only
    rules with values that repeat have their dependents compared, and only of those that are
    broken, none in sound data, are the combinations counted."""
    tables = [(name, df, [(key, rest) for key, rest, _ in found if rest]) for name, df, found in _declared(d)]
    alone = audit.key_groups([(df, [(key, []) for key, _ in found]) for _, df, found in tables if found])
    repeated = {r.rule for r in alone.filter("occurrences > 1").select("rule").distinct().collect()}
    numbers = iter(range(sum(len(found) for _, _, found in tables)))
    tables = [(name, df, [rule for rule in found if next(numbers) in repeated]) for name, df, found in tables]
    rules_ = [(name, df, key, rest) for name, df, found in tables for key, rest in found]
    empty = d.spark.createDataFrame([], "table_name string, determinant string, key_value string, combinations bigint")
    if not rules_:
        return empty
    suspects = audit.key_groups([(df, found) for _, df, found in tables if found]).filter("differs").select("rule").distinct()
    broken = sorted(r.rule for r in suspects.collect())
    found = [
        audit.audit_functional_dependency(df, key, rest).select(
            F.lit(name).alias("table_name"), F.lit(", ".join(key)).alias("determinant"), audit.key_text(key).alias("key_value"), "combinations"
        )
        for name, df, key, rest in (rules_[i] for i in broken)
    ]
    return _stack([empty, *found])


@query
def audit_specialisation(d: Derived) -> DataFrame:
    return audit.audit_specialisation(d["cost"], d["project_cost"], d["operational_cost"])
