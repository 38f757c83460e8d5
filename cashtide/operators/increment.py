"""Imports that only read and write what a batch touches.

The tables an import changes live in folders whose partitions are replaced one by one.
Invoices, schedules and project rows are in buckets of their project, the forecast and the
fact in partitions of their day, and a narrow index of invoice numbers in buckets of the
number.  A batch then touches

- the buckets of the index that hold its numbers, which name the invoices that exist and
  the projects they belong to now;
- the buckets of the projects it takes invoices from or gives them to, and of those that the
  caller names as changed since the last run;
- the schedule rows that a touched invoice is still linked to, wherever they are: a link
  survives a move to another project;
- the days of the window.  Forecast rows of other projects stay for the days the last run
  covered; the days since then are computed for all projects.

The result is that of the full run, ids of forecast rows included: those from the day on are
numbered anew.  Everything is computed and stored before the partitions
it replaces are changed, the index and the logs come last, and every step can be done again:
a run that was lost halfway is repeated with the same batch.  One import at a time: a second
writer is not kept out.

Tables in buckets are written once, as partitions beside those they replace, which are then
moved into their place; what is stored on the way is deleted as soon as nothing reads it.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from cashtide.operators import imports, rules, star
from cashtide.operators.mutate import upsert
from cashtide.operators.pipeline import rule_pipeline
from cashtide.operators.skew import numbered
from cashtide.operators.views import view_dashboard_kpi
from cashtide.session import delete_path, materialise, released
from cashtide.sources.partitions import BUCKET, bucketed, move_partitions, replace_partitions_from, write_partitions

Tables = Mapping[str, DataFrame]

#: The column each table is partitioned by; the others are only added to.
BUCKET_KEYS = {
    "invoice": "project_id",
    "payment_schedule": "project_id",
    "dim_project": "project_id",
    "dim_customer": "customer_id",
    "invoice_index": "invoice_number",
}
DAYS = {"cashflow_forecast": "forecast_date", "fact_daily_cashflow": "date_key"}
GROWING = ("dim_date", "dim_cost_type", "stg_sevdesk_invoice", "etl_run")
LIVE = [*(n for n in BUCKET_KEYS if n != "invoice_index"), *DAYS, *GROWING]
STAGED = "_staged"
INDEX_COLUMNS = ["invoice_number", "invoice_id", "project_id"]
_STATE = "run_id bigint, as_of date, horizon int, buckets int, highest bigint, layout int"

# How keys are dealt to buckets; folders of another layout are refused.
LAYOUT = 2

# Projects beyond which what is known of them is joined by a shuffle, not broadcast.
MANY_PROJECTS = 1_000_000


def _path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def _partition(name: str) -> str | None:
    return BUCKET if name in BUCKET_KEYS else DAYS.get(name)


def _log(spark: SparkSession, folder: str, run_id: int, as_of: dt.date, horizon: int, buckets: int, highest: int) -> None:
    row = spark.createDataFrame([(run_id, as_of, horizon, buckets, highest, LAYOUT)], _STATE)
    row.coalesce(1).write.mode("append").parquet(_path(folder, "_runs"))


def _last(spark: SparkSession, folder: str):
    runs = spark.read.schema(_STATE).parquet(_path(folder, "_runs"))
    last = runs.orderBy(F.desc("run_id")).first()
    if last.layout != LAYOUT:
        raise ValueError(f"{folder} has layout {last.layout or 1}, not {LAYOUT}: create it anew")
    return last


def _many(projects: DataFrame) -> bool:
    """Whether a join by project shuffles the other side, so that rows of a bucket are in few tasks."""
    return projects.count() > MANY_PROJECTS


def _key_of(date: dt.date) -> int:
    return date.year * 10000 + date.month * 100 + date.day


def create_live(
    T: Tables,
    folder: str,
    as_of: dt.date,
    run_ts: dt.datetime | None = None,
    horizon: int = rules.HORIZON_DAYS,
    buckets: int = 256,
) -> None:
    """Run the whole chain once and lay out its tables for imports.

    ``buckets`` is the number of parts that tables are cut into by project: a batch
    rewrites those of its projects, so they should be small against the table and large
    against a file.
    """
    spark = T["project"].sparkSession
    # Dimensions come from a join on their key.
    gathered = {"invoice": _many(T["project"]), "dim_project": True, "dim_customer": True}
    schemas = {}

    def store(name: str, df: DataFrame) -> DataFrame:
        path, schemas[name] = _path(folder, name), df.schema
        rows = bucketed(df, BUCKET_KEYS[name], buckets) if name in BUCKET_KEYS else df
        if column := _partition(name):
            write_partitions(rows, path, column, gathered=gathered.get(name, False))
        else:
            rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path).select(*df.columns)

    with released(spark):
        done = rule_pipeline(T, as_of, horizon, run_ts, ("payment_schedule", "invoice", "cashflow_forecast"), store)
        done["invoice_index"] = done["invoice"].select(*INDEX_COLUMNS)
        for name in [*LIVE, "invoice_index"]:
            if name in done and name not in schemas:
                store(name, done[name])
        highest = done["invoice"].select(F.coalesce(F.max("invoice_id"), F.lit(0).cast("bigint"))).first()[0]
        runs = done["etl_run"].select(F.coalesce(F.max("run_id"), F.lit(0).cast("bigint"))).first()[0] if "etl_run" in done else 0
    shapes = [(name, schema.json()) for name, schema in schemas.items()]
    spark.createDataFrame(shapes, "table_name string, shape string").coalesce(1).write.parquet(_path(folder, "_tables"))
    _log(spark, folder, runs, as_of, horizon, buckets, highest)


def _live(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a folder, with their partition columns."""
    shapes = {r.table_name: StructType.fromJson(json.loads(r.shape)) for r in spark.read.parquet(_path(folder, "_tables")).collect()}
    found = {}
    for name, shape in shapes.items():
        full = StructType([*shape.fields]).add(BUCKET, IntegerType()) if name in BUCKET_KEYS else shape
        found[name] = spark.read.schema(full).parquet(_path(folder, name)).select(*full.fieldNames())
    return found


def read_live(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables as the last import left them."""
    return {n: df.drop(BUCKET) for n, df in _live(spark, folder).items() if n != "invoice_index"}


def _values(df: DataFrame) -> list[int]:
    """The buckets that occur, at most as many as there are."""
    return sorted(r[0] for r in df.select(BUCKET).distinct().collect())


def _forecast(T: Tables, before: DataFrame, schedule: DataFrame, others: DataFrame, touched: DataFrame, as_of: dt.date, last, horizon: int, run_ts) -> DataFrame:
    """The forecast from ``as_of`` on: fresh rows of touched projects, of the days that the last
    run did not cover, and of what belongs to no project; the others as they are.

    ``schedule`` are the rows of touched buckets, ``others`` those of the other ones.
    """
    ids = touched.select("project_id")
    mine = {
        "payment_schedule": schedule.join(ids, "project_id", "left_semi"),
        "project": T["project"].join(ids, "project_id", "left_semi"),
        "purchase_order": T["purchase_order"].join(ids, "project_id", "left_semi").unionByName(T["purchase_order"].filter("project_id is null")),
        "supplier": T["supplier"],
        "ref_order_status": T["ref_order_status"],
    }
    parts = [
        rules.forecast_milestones(mine, as_of, horizon),
        rules.forecast_suppliers(mine, as_of, horizon),
        rules.forecast_overhead(T, as_of, horizon),
    ]
    covered = last.as_of + dt.timedelta(days=last.horizon)
    until = as_of + dt.timedelta(days=horizon)
    if until > covered:
        first = max(as_of, covered + dt.timedelta(days=1))
        days = (until - first).days
        rest = {
            **T,
            "payment_schedule": schedule.unionByName(others).join(ids, "project_id", "left_anti"),
            "purchase_order": T["purchase_order"].filter("project_id is not null").join(ids, "project_id", "left_anti"),
        }
        parts += [rules.forecast_milestones(rest, first, days), rules.forecast_suppliers(rest, first, days)]
    fresh = parts[0]
    for part in parts[1:]:
        fresh = fresh.unionByName(part)
    window = F.col("forecast_date").between(F.lit(as_of), F.lit(min(covered, until)))
    kept = before.filter(window & F.col("project_id").isNotNull()).join(ids, "project_id", "left_anti")
    kept = kept.select(*before.columns)
    rows = kept.unionByName(rules.shaped_like(fresh, before, run_ts))
    if "forecast_id" not in before.columns:
        return rows
    # All rows from the day on are numbered, as the full run does.
    past = before.filter(F.col("forecast_date") < F.lit(as_of))
    highest = past.select(F.coalesce(F.max("forecast_id"), F.lit(0).cast("bigint"))).first()[0]
    return numbered(rows, "forecast_id", rules.FORECAST_COLUMNS, F.lit(highest)).select(*before.columns)


def import_live(
    folder: str,
    T: Tables,
    raw: DataFrame,
    as_of: dt.date,
    run_ts: dt.datetime,
    filename: str = imports.DEFAULT_FILENAME,
    user: str = imports.DEFAULT_USER,
    on_duplicate: str = "raise",
    changed_projects: DataFrame | None = None,
    changed_customers: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Import a batch into the tables of a folder; returns them with the ``report``.

    ``T`` has the tables an import reads but does not change.  Of these, projects that are
    new or differ since the last run, or whose orders do, are named by ``changed_projects``
    (project_id), customers by ``changed_customers`` (customer_id).  A day before that of
    the last run is refused, as the rows between are gone.
    """
    spark = raw.sparkSession
    last = _last(spark, folder)
    if as_of < last.as_of:
        raise ValueError(f"the last import was of {last.as_of}, after {as_of}")
    live = _live(spark, folder)
    run_id, buckets, horizon = last.run_id + 1, last.buckets, last.horizon
    staged = materialise(imports.import_validate(imports.import_stage(raw, run_id), T["project"], T["ref_invoice_status"]))
    if staged.isEmpty():
        raise ValueError("records is empty")
    opened = imports.import_run_open(staged, filename, user, run_ts)
    try:
        with released(spark):
            incoming = imports.import_arrivals(staged, F.lit(last.highest), on_duplicate)
            highest = _apply(spark, folder, T, live, incoming, as_of, last, run_ts, changed_projects, changed_customers)
    except Exception as failure:
        raise imports.ImportFailed(str(failure), imports.import_run_log(opened, None, run_ts, str(failure))) from failure
    finally:
        delete_path(spark, _path(folder, STAGED))
    staged = imports.import_stamp_promoted(staged, run_ts)
    run = materialise(imports.import_run_log(opened, imports.import_run_status(staged), run_ts))
    for name, rows in (("stg_sevdesk_invoice", staged), ("etl_run", run)):
        if name in live:
            rules.shaped_like(rows, live[name]).write.mode("append").parquet(_path(folder, name))
    _log(spark, folder, run_id, as_of, horizon, buckets, highest)
    now = read_live(spark, folder)
    report = imports.import_report(run, staged, view_dashboard_kpi({**T, **now}, as_of, horizon))
    return {"stg_sevdesk_invoice": staged, "etl_run": run, **now, "report": report}  # logs of this run, where none are kept


def _apply(spark, folder, T, live, incoming, as_of, last, run_ts, changed_projects, changed_customers) -> int:
    """Bring the tables up to date; returns the highest invoice id."""
    buckets, horizon = last.buckets, last.horizon

    def part(name: str, which: list[int]) -> DataFrame:
        return live[name].filter(F.col(BUCKET).isin(which)).drop(BUCKET)

    def stage(name: str, df: DataFrame, gathered: bool) -> DataFrame:
        """Write the rows that are to replace partitions of a table, and read them back."""
        rows = bucketed(df, BUCKET_KEYS[name], buckets)
        write_partitions(rows, _path(folder, f"{STAGED}/{name}"), BUCKET, gathered=gathered)
        return spark.read.schema(rows.schema).parquet(_path(folder, f"{STAGED}/{name}")).select(*df.columns)

    delete_path(spark, _path(folder, STAGED))

    # What the batch touches.  The index is brought up to date with it; a number that moves
    # to another project also names the one it leaves.
    asked = _values(bucketed(incoming.select("invoice_number"), "invoice_number", buckets))
    index = part("invoice_index", asked).withColumns({"_known": F.lit(True), "_was": F.col("project_id")})
    index = upsert(index, incoming.select(*INDEX_COLUMNS), ["invoice_number"], ["project_id"], unique=True)
    moved = F.col("_known") & ~F.col("_was").eqNullSafe(F.col("project_id"))
    index = stage("invoice_index", index.select(*INDEX_COLUMNS, F.when(moved, F.struct("_was")).alias("_left")), gathered=True)
    ids = index.filter("_left is not null").select(F.col("_left._was").alias("project_id"))
    ids = ids.unionByName(incoming.select("project_id"))
    if changed_projects is not None:
        ids = ids.unionByName(changed_projects.select(F.col("project_id").cast("bigint")))
    touched = materialise(bucketed(ids.distinct(), "project_id", buckets))
    where = _values(touched)
    project = T["project"].join(touched.select("project_id"), "project_id", "left_semi")

    # Invoices and schedules of these buckets; rows of other projects pass as they are.
    schedule = rules.rule_payment_schedule(project, T["ref_milestone_type"], part("payment_schedule", where), run_ts=run_ts)
    schedule = materialise(schedule)
    with released(spark):
        invoice = materialise(imports.import_merge(part("invoice", where), incoming, run_ts))
        invoice = rules.classify_and_link(invoice, project, schedule, T["ref_milestone_type"], run_ts=run_ts)
        invoice = stage("invoice", invoice, gathered=_many(touched))

    # Links that lead out of these buckets.
    reached = where
    if len(where) < buckets:
        linked = invoice.filter("schedule_id is not null").join(touched.select("project_id"), "project_id", "left_semi")
        foreign = materialise(linked.select("schedule_id").distinct().join(schedule.select("schedule_id"), "schedule_id", "left_anti"))
        if not foreign.isEmpty():
            there = live["payment_schedule"].filter(~F.col(BUCKET).isin(where)).join(foreign, "schedule_id", "left_semi")
            there = materialise(there.select("project_id", BUCKET).distinct())
            more = _values(there)
            schedule = schedule.unionByName(part("payment_schedule", more))
            touched = materialise(touched.unionByName(there).distinct())
            reached = sorted({*where, *more})
    schedule = stage("payment_schedule", rules.rule_advance_schedule(schedule, invoice, run_ts=run_ts), gathered=False)
    others = live["payment_schedule"].filter(~F.col(BUCKET).isin(reached)).drop(BUCKET)
    forecast = materialise(_forecast(T, live["cashflow_forecast"], schedule, others, touched, as_of, last, horizon, run_ts))

    # Dimensions, as far as what they show has changed.
    days = star.star_dim_date(spark, as_of, horizon).join(live["dim_date"].select("date_key"), "date_key", "left_anti")
    days = materialise(days.select(*live["dim_date"].columns))
    kinds = star.star_dim_cost_type(T["ref_direct_cost_type"], T["ref_overhead_category"])
    kinds = kinds.join(live["dim_cost_type"].select("cost_category", "cost_subcategory"), ["cost_category", "cost_subcategory"], "left_anti")
    kinds = materialise(kinds.select(*live["dim_cost_type"].columns))
    shown = stage("dim_project", star.star_dim_project(project, part("dim_project", where)), gathered=True)
    customers, homes = None, []
    if changed_customers is not None:
        chosen = materialise(bucketed(changed_customers.select(F.col("customer_id").cast("bigint")).distinct(), "customer_id", buckets))
        homes = _values(chosen)
        customer = T["customer"].join(chosen.select("customer_id"), "customer_id", "left_semi")
        customers = stage("dim_customer", star.star_dim_customer(customer, part("dim_customer", homes)), gathered=True)
    dims = {
        "dim_project": shown.unionByName(live["dim_project"].filter(~F.col(BUCKET).isin(where)).drop(BUCKET)),
        "dim_customer": live["dim_customer"].drop(BUCKET)
        if customers is None
        else customers.unionByName(live["dim_customer"].filter(~F.col(BUCKET).isin(homes)).drop(BUCKET)),
        "dim_cost_type": live["dim_cost_type"].unionByName(kinds),
    }
    fact = star.star_fact({**T, **dims, "cashflow_forecast": forecast}, as_of, horizon)
    before = live["fact_daily_cashflow"]
    fact = rules.shaped_like(fact, before, None, "fact_id", star.FACT_KEYS, before.filter(F.col("date_key") < _key_of(as_of)))
    fact = materialise(fact)
    highest = invoice.agg(F.max("invoice_id")).first()[0]

    # From here on partitions are replaced.
    def replace(name: str, which: list[int]) -> None:
        move_partitions(spark, _path(folder, f"{STAGED}/{name}"), _path(folder, name), BUCKET, which)

    for name, which in (("invoice", where), ("payment_schedule", reached), ("dim_project", where), ("dim_customer", homes)):
        replace(name, which)
    days.write.mode("append").parquet(_path(folder, "dim_date"))
    kinds.write.mode("append").parquet(_path(folder, "dim_cost_type"))
    replace_partitions_from(forecast, _path(folder, "cashflow_forecast"), "forecast_date", as_of)
    replace_partitions_from(fact, _path(folder, "fact_daily_cashflow"), "date_key", _key_of(as_of))
    replace("invoice_index", asked)
    return max(last.highest, highest or 0)
