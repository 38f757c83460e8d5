"""Small hand-made tables for the tests."""

import datetime as dt
from decimal import Decimal

from cashtide.seeds import local_table, reference_domains

DAY = dt.date(2026, 3, 10)
NOW = dt.datetime(2026, 3, 10, 9, 30)


def day(offset: int) -> dt.date:
    return DAY + dt.timedelta(days=offset)


def money(value) -> Decimal:
    return Decimal(str(value)).quantize(Decimal("0.01"))


def project(pid, value, start=0, customer=1, status="In Progress"):
    return {
        "project_id": pid,
        "customer_id": customer,
        "project_name": f"Roof {pid}",
        "status": status,
        "total_value": money(value),
        "start_date": day(start),
    }


def invoice(iid, pid, amount, date=0, status="Issued", number=None, **more):
    return {
        "invoice_id": iid,
        "project_id": pid,
        "invoice_number": number or f"N-{iid:04d}",
        "invoice_date": day(date),
        "due_date": day(date + 7),
        "amount": money(amount),
        "status": status,
        "created_by": "seed",
        **more,
    }


def order(oid, amount, date, supplier=1, pid=1, status="Ordered"):
    return {
        "order_id": oid,
        "supplier_id": supplier,
        "project_id": pid,
        "order_date": day(date),
        "expected_delivery_date": day(date + 5),
        "total_amount": money(amount),
        "status": status,
    }


def customer(cid, **more):
    return {
        "customer_id": cid,
        "first_name": f"First{cid}",
        "last_name": f"Last{cid}",
        "email": f"c{cid}@example.invalid",
        "street_name": "Road",
        "house_number": "1",
        "postal_code": "12345",
        "city": "Town",
        "country": "Germany",
        **more,
    }


def tables(spark, **rows):
    """The reference domains and the named tables; the others are empty."""
    names = [
        "customer", "project", "payment_schedule", "invoice", "payment", "supplier", "purchase_order",
        "cost", "project_cost", "operational_cost", "cashflow_forecast", "dim_date", "dim_project",
        "dim_customer", "dim_cost_type", "fact_daily_cashflow",
    ]
    rows.setdefault("supplier", [supplier(1, 14)])
    return {**reference_domains(spark), **{n: local_table(spark, n, rows.get(n, [])) for n in names}}


def supplier(sid, terms):
    return {"supplier_id": sid, "supplier_name": f"S{sid}", "credit_limit": money(1000), "payment_terms_days": terms}


def values(df, *columns):
    return ordered(tuple(r) for r in df.select(*columns).collect())


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, "" if v is None else v) for v in row))
