"""Boundaries of the views."""

import json

from tables import DAY, customer, day, invoice, money, order, ordered, project, supplier, tables, values

from cashtide.operators import rebase, star, views
from cashtide.operators.pipeline import rule_pipeline


def fact(offset, net):
    key = int(day(offset).strftime("%Y%m%d"))
    net = money(net)
    cash_in, cash_out = (net, 0) if net > 0 else (0, -net)
    return {"date_key": key, "expected_cash_in": money(cash_in), "expected_cash_out": money(cash_out), "net_cashflow": money(net)}


def with_calendar(spark, T):
    return {**T, "dim_date": star.star_dim_date(spark, DAY)}


def test_position_at_the_buffer(spark):
    T = with_calendar(spark, tables(spark, fact_daily_cashflow=[
        fact(0, "-0.01"), fact(1, "0.01"), fact(2, "9999.99"), fact(3, "0.01"), fact(30, "-1"), fact(31, "-99999"), fact(-1, "5")]))
    got = values(views.view_liquidity_alert(T, DAY), "full_date", "cumulative_position", "liquidity_status")
    assert got == [
        (day(0), money("-0.01"), "NEGATIVE"),
        (day(1), money(0), "BELOW_BUFFER"),
        (day(2), money("9999.99"), "BELOW_BUFFER"),
        (day(30), money("9999.00"), "BELOW_BUFFER"),
    ]
    line = views.view_cashflow_30day(T, DAY).collect()
    assert len(line) == 31 and [r.full_date for r in line] == [day(i) for i in range(31)]


def test_due_dates_around_today(spark):
    T = tables(spark, project=[project(1, 1)], purchase_order=[order(i, 1, d - 14) for i, d in enumerate((-1, 0, 7, 8))])
    got = values(views.view_supplier_watch(T, DAY), "order_id", "days_until_due", "alert_level")
    assert got == [(0, -1, "OVERDUE"), (1, 0, "DUE_SOON"), (2, 7, "DUE_SOON"), (3, 8, "SCHEDULED")]


def test_kpi_of_empty_tables_is_zero(spark):
    T = with_calendar(spark, tables(spark))
    assert tuple(views.dash_stats(T, DAY).first()) == (money(0), money(0), money(0), 0, 0)


def test_kpi_counts_overdue_orders_and_full_receivables(spark):
    T = with_calendar(spark, tables(
        spark,
        project=[project(1, 9000), project(2, 9000, status="Completed")],
        invoice=[invoice(i, 1, 100, status=s) for i, s in enumerate(["Issued", "Partially Paid", "Paid", "Overdue", "Cancelled"])],
        purchase_order=[order(1, 10, -30), order(2, 20, -10), order(3, 40, 0), order(4, 80, -30, status="Cancelled")],
    ))
    kpi = views.view_dashboard_kpi(T, DAY).first()
    assert (kpi.outstanding_receivables, kpi.supplier_due_7_days, kpi.active_projects) == (money(300), money(30), 1)


def test_margin_of_a_free_project_is_unknown(spark):
    T = tables(spark, customer=[customer(1)], project=[project(1, 0), project(2, 300), project(3, 8)], purchase_order=[
        order(1, 5, 0), order(2, 400, 0, pid=2), order(3, "7.98", 0, pid=3, status="Cancelled")])
    got = values(views.view_project_profitability(T), "project_id", "gross_margin", "margin_pct")
    assert [(p, m, None if q is None else str(q)) for p, m, q in got] == [
        (1, money(-5), None), (2, money(-100), "-33.3"), (3, money("0.02"), "0.3")]


def test_projects_without_invoices_stay_on_the_dashboard(spark):
    T = tables(spark, customer=[customer(1)], project=[project(1, 9000), project(2, 9000, 5, status="Planned"), project(3, 1, status="Completed")],
               payment_schedule=[{"schedule_id": 1, "project_id": 1, "milestone_code": "STAGE_1_ROOF", "status": "Paid"},
                                 {"schedule_id": 2, "project_id": 1, "milestone_code": "STAGE_2_COMMISSIONING", "status": "Pending"}])
    rows = views.dash_active_projects(T).collect()
    assert [(r.project_id, r.milestone_progress, r.invoiced_to_date) for r in rows] == [(2, "0/0", money(0)), (1, "1/2", money(0))]


def test_export_keeps_customers_without_projects(spark):
    T = tables(spark, customer=[customer(1), customer(2)], project=[project(1, 1), project(2, 1)],
               invoice=[invoice(1, 1, 5), invoice(2, 1, 6)],
               payment=[{"payment_id": i, "invoice_id": 1, "payment_date": day(i), "amount": money(2), "payment_method": "Bank Transfer"} for i in (1, 2)])
    got = values(views.view_customer_data_export(T), "customer_id", "project_id", "invoice_number", "payment_date")
    assert got == ordered([
        (1, 1, "N-0001", day(1)), (1, 1, "N-0001", day(2)), (1, 1, "N-0002", None), (1, 2, None, None), (2, None, None, None)])


def moved_tables(spark):
    return tables(
        spark, customer=[customer(1)], project=[project(1, 20000, -40)], supplier=[supplier(1, 10)],
        purchase_order=[order(1, 10600, -20), order(2, 100, -12)], invoice=[invoice(1, 1, 500, -30)],
        cost=[{"cost_id": 1, "amount": money(3), "cost_date": day(-20), "cost_category": "Operational Overhead"}],
        operational_cost=[{"cost_id": 1, "overhead_category": "Rent", "cost_category": "Operational Overhead"}],
    )


def test_rebase_moves_once(spark):
    moved, report = rebase.rebase_dates(moved_tables(spark), DAY)
    first = json.loads(report.first().report)
    assert first["shiftDays"] == 9 and first["anchorRule"] == "newest purchase order sits 3 days before today"
    assert first["rowsShifted"] == {"project": 1, "purchase_order": 2, "cost": 1, "invoice": 1, "payment": 0}
    assert first["liquidityAlerts"][0]["status"] in ("NEGATIVE", "BELOW_BUFFER")
    assert values(moved["purchase_order"], "order_date") == [(day(-11),), (day(-3),)]
    assert values(moved["project"], "start_date", "expected_completion_date") == [(day(-31), None)]
    again, report = rebase.rebase_dates(moved, DAY)
    second = json.loads(report.first().report)
    assert second["shiftDays"] == 0 and set(second["rowsShifted"].values()) == {0}
    assert second["kpiAfterRebase"] == first["kpiAfterRebase"] and second["liquidityAlerts"] == first["liquidityAlerts"]
    assert values(again["purchase_order"], "order_date") == values(moved["purchase_order"], "order_date")


def test_rebase_without_orders(spark):
    T = tables(spark, project=[project(1, 1)])
    same, report = rebase.rebase_dates(T, DAY)
    assert json.loads(report.first().report) == {"shiftDays": 0, "note": "no purchase orders found; nothing to rebase"}
    assert same["project"].first().start_date == day(0)


def test_dimension_rows_are_overwritten_not_duplicated(spark):
    T = tables(spark, customer=[customer(1, city="New")], project=[project(1, 5)],
               dim_customer=[{"customer_key": 9, "customer_id": 1, "customer_name": "x", "city": "Old", "postal_code": "0"}])
    done = rule_pipeline(T, DAY)
    assert values(done["dim_customer"], "customer_key", "city", "customer_name") == [(9, "New", "First1 Last1")]
