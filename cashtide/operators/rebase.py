"""Moving every business date of a data set by one whole number of days."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.operators.mutate import stamp_updated
from cashtide.operators.pipeline import rule_pipeline
from cashtide.operators.rules import HORIZON_DAYS
from cashtide.operators.views import view_dashboard_kpi, view_liquidity_alert

# The lag of the newest order and the date columns that move.
LAG_DAYS = 3
MOVED_DATES = {
    "project": ["start_date", "expected_completion_date"],
    "purchase_order": ["order_date", "expected_delivery_date"],
    "cost": ["cost_date"],
    "invoice": ["invoice_date", "due_date"],
    "payment": ["payment_date"],
}
PINNED = ("invoice", "payment_schedule")
NOTHING_TO_MOVE = "no purchase orders found; nothing to rebase"


def shift_tables(
    T: Mapping[str, DataFrame], days: int, run_ts: dt.datetime | None = None
) -> dict[str, DataFrame]:
    """All tables, with the business dates moved; missing dates stay missing."""
    moved = dict(T)
    if days == 0:
        return moved
    for name, columns in MOVED_DATES.items():
        df = T[name]
        moved[name] = stamp_updated(
            df.withColumns({c: F.date_add(c, days) for c in columns if c in df.columns}), F.lit(True), run_ts
        )
    return moved


def rebase_dates(
    T: Mapping[str, DataFrame],
    as_of: dt.date,
    lag: int = LAG_DAYS,
    horizon: int = HORIZON_DAYS,
    run_ts: dt.datetime | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Move the calendar so that the newest order is ``lag`` days before ``as_of``,
    rerun the rules, and report.

    The shift is one value read from the data, so running it again on the same
    day moves nothing.  Without orders nothing happens at all.
    """
    newest = T["purchase_order"].agg(F.max("order_date")).first()[0]
    spark = T["purchase_order"].sparkSession
    if newest is None:
        note = F.to_json(F.struct(F.lit(0).alias("shiftDays"), F.lit(NOTHING_TO_MOVE).alias("note")))
        return dict(T), spark.range(1).select(note.alias("report"))
    shift = (as_of - dt.timedelta(days=lag) - newest).days
    moved = rule_pipeline(shift_tables(T, shift, run_ts), as_of, horizon, run_ts, pin=PINNED)
    return moved, rebase_report(T, moved, shift, as_of, lag, horizon)


def rebase_report(
    T: Mapping[str, DataFrame],
    moved: Mapping[str, DataFrame],
    shift: int,
    as_of: dt.date,
    lag: int = LAG_DAYS,
    horizon: int = HORIZON_DAYS,
) -> DataFrame:
    """One JSON object: shift, rows moved per table, alert days and figures.

    Alerts are at most one per day of the window.
    """
    parts = [
        T[name].agg(
            F.lit(name).alias("part"), (F.count(F.lit(1)) if shift else F.lit(0).cast("bigint")).alias("moved")
        )
        for name in MOVED_DATES
    ]
    alerts = view_liquidity_alert(moved, as_of, horizon).agg(
        F.lit("alerts").alias("part"),
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("full_date").alias("date"),
                    F.col("cumulative_position").alias("position"),
                    F.col("liquidity_status").alias("status"),
                )
            )
        ).alias("alerts"),
    )
    kpi = view_dashboard_kpi(moved, as_of, horizon)
    kpi = kpi.select(F.lit("kpi").alias("part"), F.struct(*kpi.columns).alias("kpi"))
    stacked = alerts.unionByName(kpi, allowMissingColumns=True)
    for part in parts:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    counts = F.struct(
        *[F.max(F.when(F.col("part") == name, F.col("moved"))).alias(name) for name in MOVED_DATES]
    )
    report = F.struct(
        F.lit(shift).alias("shiftDays"),
        F.lit(f"newest purchase order sits {lag} days before today").alias("anchorRule"),
        counts.alias("rowsShifted"),
        F.any_value("alerts", True).alias("liquidityAlerts"),
        F.any_value("kpi", True).alias("kpiAfterRebase"),
    )
    return stacked.agg(F.to_json(report).alias("report"))
