"""Boundaries of the business rules."""

import pytest
from pyspark.sql import functions as F
from tables import DAY, NOW, customer, day, invoice, money, order, project, supplier, tables, values

from cashtide.operators import rules
from cashtide.operators.pipeline import rule_pipeline


def test_value_of_exactly_the_threshold_is_split(spark):
    T = tables(spark, project=[project(1, "2999.99"), project(2, "3000.00"), project(3, "3000.01")])
    got = values(rules.rule_payment_schedule(T["project"], T["ref_milestone_type"]), "project_id", "milestone_code", "expected_amount")
    assert got == [
        (1, "SINGLE_PAYMENT", money("2999.99")),
        (2, "STAGE_1_ROOF", money("1650.00")),
        (2, "STAGE_2_COMMISSIONING", money("1350.00")),
        (3, "STAGE_1_ROOF", money("1650.01")),
        (3, "STAGE_2_COMMISSIONING", money("1350.00")),
    ]


def test_schedule_update_keeps_status_and_offset(spark):
    kept = {
        "schedule_id": 7, "project_id": 2, "milestone_code": "STAGE_1_ROOF", "due_offset_days": 99,
        "expected_amount": money(1), "status": "Paid", "created_by": "hand",
    }
    T = tables(spark, project=[project(2, 10000)], payment_schedule=[kept])
    after = rules.rule_payment_schedule(T["project"], T["ref_milestone_type"], T["payment_schedule"], run_ts=NOW)
    rows = {r.milestone_code: r for r in after.collect()}
    assert len(rows) == 2
    first = rows["STAGE_1_ROOF"]
    assert (first.schedule_id, first.due_offset_days, first.status, first.created_by) == (7, 99, "Paid", "hand")
    assert first.expected_amount == money(5500) and first.updated_at == NOW and first.created_at is None
    assert rows["STAGE_2_COMMISSIONING"].created_at == NOW


def test_schedule_of_one_project(spark):
    T = tables(spark, project=[project(1, 5000), project(2, 5000)])
    only = rules.rule_payment_schedule(T["project"], T["ref_milestone_type"], project_id=2)
    assert {r.project_id for r in only.collect()} == {2}
    with pytest.raises(ValueError, match="Project 9 does not exist"):
        rules.rule_payment_schedule(T["project"], T["ref_milestone_type"], project_id=9)


def test_small_and_cancelled_invoices_consume_a_rank(spark):
    T = tables(
        spark,
        project=[project(1, 50000), project(2, 50000), project(3, 2500)],
        invoice=[
            invoice(1, 1, 100, 0),
            invoice(2, 1, 9000, 1),
            invoice(3, 1, 9000, 2),
            invoice(4, 2, 9000, 0, "Cancelled"),
            invoice(5, 2, 3000, 0),
            invoice(6, 2, "2999.99", 1),
            invoice(7, 2, 9000, 2),
            invoice(8, 3, 9000, 0),
        ],
    )
    got = dict(values(rules.rule_classify_invoices(T["invoice"], T["project"]), "invoice_id", "milestone_code"))
    assert got == {
        1: "ADJUSTMENT", 2: "STAGE_2_COMMISSIONING", 3: "ADJUSTMENT",
        4: "STAGE_1_ROOF", 5: "STAGE_2_COMMISSIONING", 6: "ADJUSTMENT", 7: "ADJUSTMENT",
        8: "SINGLE_PAYMENT",
    }


def test_classification_of_one_project_leaves_the_others(spark):
    T = tables(spark, project=[project(1, 50000), project(2, 50000)], invoice=[invoice(1, 1, 9000), invoice(2, 2, 9000)])
    got = dict(values(rules.rule_classify_invoices(T["invoice"], T["project"], project_id=2), "invoice_id", "milestone_code"))
    assert got == {1: None, 2: "STAGE_1_ROOF"}


def test_link_is_never_cleared_and_status_never_regresses(spark):
    slots = [
        {"schedule_id": i, "project_id": 1, "milestone_code": code, "due_offset_days": 0, "expected_amount": money(1), "status": status}
        for i, code, status in ((1, "STAGE_1_ROOF", "Paid"), (2, "STAGE_2_COMMISSIONING", "Overdue"), (3, "ADJUSTMENT", "Pending"))
    ]
    T = tables(
        spark,
        project=[project(1, 50000)],
        payment_schedule=slots,
        invoice=[
            invoice(1, 1, 100, 0, schedule_id=2, milestone_code="STAGE_1_ROOF"),
            invoice(2, 1, 9000, 1, "Paid"),
            invoice(3, 1, 9000, 2),
        ],
    )
    coded = rules.rule_classify_invoices(T["invoice"], T["project"], run_ts=NOW)
    linked = rules.rule_link_schedule(coded, T["payment_schedule"], T["ref_milestone_type"], run_ts=NOW)
    after = rules.apply_milestone_rules(T, run_ts=NOW)
    columns = after["invoice"].columns
    assert values(linked, *columns) == values(after["invoice"], *columns)
    assert values(after["invoice"], "invoice_id", "milestone_code", "schedule_id") == [
        (1, "ADJUSTMENT", 2), (2, "STAGE_2_COMMISSIONING", 2), (3, "ADJUSTMENT", None),
    ]
    assert values(after["payment_schedule"], "schedule_id", "status") == [(1, "Paid"), (2, "Paid"), (3, "Pending")]
    stamped = dict(values(after["payment_schedule"], "schedule_id", "updated_at"))
    assert stamped == {1: None, 2: NOW, 3: None}


def test_forecast_window_ends_count(spark):
    T = tables(
        spark,
        project=[project(1, 1000, -15), project(2, 1000, -14), project(3, 1000, 16), project(4, 1000, 17)],
        purchase_order=[order(1, 10, -15), order(2, 20, -14), order(3, 30, 16), order(4, 40, 17), order(5, 50, 0, status="Cancelled")],
        cost=[{"cost_id": i, "amount": money(i), "cost_date": day(d), "cost_category": "Operational Overhead"} for i, d in ((1, -1), (2, 0), (3, 30), (4, 31))],
        operational_cost=[{"cost_id": i, "overhead_category": "Rent", "cost_category": "Operational Overhead"} for i in range(1, 5)],
    )
    T["payment_schedule"] = rules.rule_payment_schedule(T["project"], T["ref_milestone_type"])
    flows = {
        "in": values(rules.forecast_milestones(T, DAY), "project_id", "forecast_date"),
        "out": values(rules.forecast_suppliers(T, DAY), "expected_cash_out", "forecast_date"),
        "overhead": values(rules.forecast_overhead(T, DAY), "net_cashflow", "project_id"),
    }
    assert flows == {
        "in": [(2, day(0)), (3, day(30))],
        "out": [(money(20), day(0)), (money(30), day(30))],
        "overhead": [(money(-3), None), (money(-2), None)],
    }


def test_settled_milestones_leave_the_forecast(spark):
    T = tables(spark, project=[project(1, 1000)])
    schedule = rules.rule_payment_schedule(T["project"], T["ref_milestone_type"])
    for status, rows in (("Pending", 1), ("Invoiced", 1), ("Overdue", 1), ("Paid", 0)):
        T["payment_schedule"] = schedule.withColumn("status", F.lit(status))
        assert rules.forecast_milestones(T, DAY).count() == rows


def test_the_past_of_the_forecast_survives(spark):
    past = [
        {"project_id": 1, "forecast_date": day(d), "expected_cash_in": money(1), "expected_cash_out": money(0), "net_cashflow": money(1), "flow_source": "old"}
        for d in (-1, 0, 5)
    ]
    T = tables(spark, project=[project(1, 1000)], cashflow_forecast=past)
    T["payment_schedule"] = rules.rule_payment_schedule(T["project"], T["ref_milestone_type"])
    assert values(rules.rule_forecast(T, DAY), "forecast_date", "flow_source") == [
        (day(-1), "old"), (day(14), "customer_milestone"),
    ]


def test_pipeline_twice_is_pipeline_once(spark):
    T = tables(
        spark,
        customer=[customer(1)],
        project=[project(1, 50000), project(2, 1000)],
        invoice=[invoice(1, 1, 9000, 0, "Paid"), invoice(2, 2, 500)],
        purchase_order=[order(1, 700, -3)],
        supplier=[supplier(1, 14)],
    )
    once = rule_pipeline(T, DAY)
    twice = rule_pipeline(once, DAY)
    for name in ("payment_schedule", "invoice", "cashflow_forecast", "fact_daily_cashflow", "dim_date", "dim_project", "dim_customer", "dim_cost_type"):
        columns = once[name].columns
        assert values(twice[name], *columns) == values(once[name], *columns), name


def test_forecast_bounds_reach_the_scans(spark, tmp_path):
    T = tables(spark, project=[project(1, 10000, 0), project(2, 10000, -400)], purchase_order=[order(1, 5, 0), order(2, 5, 90)])
    T["payment_schedule"] = rules.rule_payment_schedule(T["project"], T["ref_milestone_type"])
    for name in ("project", "purchase_order"):
        T[name].write.parquet(str(tmp_path / name))
        T[name] = spark.read.parquet(str(tmp_path / name))
    flows = {"start_date": rules.forecast_milestones(T, DAY), "order_date": rules.forecast_suppliers(T, DAY)}
    for column, flow in flows.items():
        flow.collect()
        plan = flow._jdf.queryExecution().executedPlan().toString()
        pushed = next(line for line in plan.splitlines() if "PushedFilters" in line and f"({column}," in line)
        assert f"GreaterThanOrEqual({column}," in pushed and f"LessThanOrEqual({column}," in pushed


def test_milestone_codes_that_share_a_slot_are_refused(spark):
    T = tables(spark, project=[project(1, 10000)])
    types = T["ref_milestone_type"].filter("is_milestone")
    again = types.unionByName(types.withColumn("milestone_code", F.col("milestone_code")))
    with pytest.raises(Exception, match="share a slot"):
        rules.rule_payment_schedule(T["project"], again).collect()
