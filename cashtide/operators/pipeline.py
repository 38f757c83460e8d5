"""The whole chain from schedules to the star schema."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from cashtide.operators.rules import (
    HORIZON_DAYS,
    apply_milestone_rules,
    rule_advance_schedule,
    rule_forecast,
    rule_payment_schedule,
)
from cashtide.operators.star import star_refresh
from cashtide.session import materialise


def rule_pipeline(
    T: Mapping[str, DataFrame],
    as_of: dt.date,
    horizon: int = HORIZON_DAYS,
    run_ts: dt.datetime | None = None,
    pin: Sequence[str] = ("payment_schedule",),
    store: Callable[[str, DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Schedules, milestone rules, forecast and star schema, as new tables.

    The tables named by ``pin`` are stored after the milestone rules, the forecast
    once it is made.  The forecast reads the schedule several times, so it is pinned unless told
    otherwise; callers that also read the invoices repeatedly add those.  ``store`` takes the
    name and the rows of a finished table, pinned or a dimension, and gives it back as stored.
    """
    T = dict(T)
    keep = store or (lambda _, rows: materialise(rows))
    scheduled = rule_payment_schedule(
        T["project"], T["ref_milestone_type"], T.get("payment_schedule"), run_ts=run_ts
    )
    if "payment_schedule" in pin:
        scheduled = materialise(scheduled)  # read for the slots of invoices and to advance it
    T = apply_milestone_rules({**T, "payment_schedule": scheduled}, run_ts=run_ts)
    if "invoice" in pin:
        T["invoice"] = keep("invoice", T["invoice"])
        T["payment_schedule"] = rule_advance_schedule(scheduled, T["invoice"], run_ts=run_ts)
    if "payment_schedule" in pin:
        T["payment_schedule"] = keep("payment_schedule", T["payment_schedule"])
    T["cashflow_forecast"] = rule_forecast(T, as_of, horizon, run_ts)
    if "cashflow_forecast" in pin:
        T["cashflow_forecast"] = keep("cashflow_forecast", T["cashflow_forecast"])
    return star_refresh(T, as_of, horizon, store)
