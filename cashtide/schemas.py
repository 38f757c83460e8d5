"""The data model: 31 tables with types, keys, references and value checks.

Columns are declared as ``name: type``; a trailing ``?`` marks a nullable
column.  Everything else (StructTypes for reading, key audits, functional
dependencies) is derived from these declarations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Type names of the model and their Spark counterparts.
SPARK_TYPES = {
    "id": T.LongType(),
    "int": T.IntegerType(),
    "money": T.DecimalType(12, 2),
    "percent": T.DecimalType(5, 2),
    "date": T.DateType(),
    "instant": T.TimestampType(),
    "flag": T.BooleanType(),
    "text": T.StringType(),
}


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    length: int | None = None
    nullable: bool = False

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES[self.kind]


@dataclass(frozen=True)
class Reference:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...]
    unique_keys: tuple[tuple[str, ...], ...] = ()
    references: tuple[Reference, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def struct(self) -> T.StructType:
        # Files cannot promise NOT NULL, so the read schema is nullable and the
        # promise is checked by the audits.
        return T.StructType([T.StructField(c.name, c.spark_type, True) for c in self.columns])

    @property
    def keys(self) -> list[tuple[str, ...]]:
        return [self.primary_key, *self.unique_keys]

    @property
    def functional_dependencies(self) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
        """Every candidate key determines all the other columns of its table."""
        return [(key, tuple(c for c in self.column_names if c not in key)) for key in self.keys]


def column(name: str, kind: str) -> Column:
    """``"text 100?"`` is a nullable string of at most 100 characters."""
    nullable = kind.endswith("?")
    base, _, length = kind.rstrip("?").partition(" ")
    return Column(name, base, int(length) if length else None, nullable)


# The three audit columns shared by the operational tables.
AUDIT = {"created_at": "instant", "updated_at": "instant", "created_by": "text 100"}


def ref(name: str, to: str, parent_column: str | None = None) -> Reference:
    return Reference((name,), to, (parent_column or name,))


def non_negative(*names: str) -> dict[str, str]:
    return {f"{n}_not_negative": f"{n} >= 0" for n in names}


def table(name, columns, key, unique=(), references=(), checks=None, audited=False) -> Table:
    declared = dict(columns)
    if audited:
        declared.update(AUDIT)
    return Table(
        name,
        tuple(column(n, k) for n, k in declared.items()),
        tuple(key.split()),
        tuple(tuple(u.split()) for u in unique),
        tuple(references),
        checks or {},
    )


def domain(name, code, extra=(), unique=(), checks=None) -> Table:
    """A reference domain: a natural code, what it means, and behaviour flags."""
    width = "text 30" if code == "milestone_code" else "text 50"
    columns = {code: width, "description": "text 200", **dict(extra)}
    return table(name, columns, code, unique, (), checks)


SORTED = {"sort_order": "int"}

_DECLARED = [
    # --- reference domains -------------------------------------------------
    domain("ref_project_status", "status_code", {**SORTED, "is_terminal": "flag"}, ["sort_order"]),
    domain("ref_schedule_status", "status_code", SORTED, ["sort_order"]),
    domain("ref_invoice_status", "status_code", {**SORTED, "counts_as_receivable": "flag"}, ["sort_order"]),
    domain("ref_order_status", "status_code", {**SORTED, "counts_as_payable": "flag"}, ["sort_order"]),
    domain("ref_payment_method", "method_code", {"settlement_days": "int"}, (), non_negative("settlement_days")),
    domain("ref_product_category", "category_code"),
    domain("ref_overhead_category", "category_code"),
    domain("ref_direct_cost_type", "type_code"),
    domain("ref_cost_category", "category_code", {"is_indirect": "flag"}),
    domain(
        "ref_milestone_type",
        "milestone_code",
        {
            "milestone_label": "text 100",
            "percentage": "percent?",
            "default_due_offset_days": "int",
            "part_of_split": "flag",
            "is_milestone": "flag",
        },
        ["milestone_label"],
        {
            "percentage_in_range": "percentage IS NULL OR (percentage > 0 AND percentage <= 100)",
            **non_negative("default_due_offset_days"),
        },
    ),
    # --- business tables ---------------------------------------------------
    table(
        "customer",
        {
            "customer_id": "id",
            "first_name": "text 100",
            "last_name": "text 100",
            "company_name": "text 150?",
            "email": "text 255",
            "phone": "text 50?",
            "street_name": "text 150",
            "house_number": "text 20",
            "postal_code": "text 20",
            "city": "text 100",
            "country": "text 50",
            "pseudonymized_at": "instant?",
        },
        "customer_id",
        ["email"],
        audited=True,
    ),
    table(
        "project",
        {
            "project_id": "id",
            "customer_id": "id",
            "project_name": "text 150",
            "status": "text 50",
            "total_value": "money",
            "start_date": "date",
            "expected_completion_date": "date?",
        },
        "project_id",
        references=[ref("customer_id", "customer"), ref("status", "ref_project_status", "status_code")],
        checks=non_negative("total_value"),
        audited=True,
    ),
    table(
        "payment_schedule",
        {
            "schedule_id": "id",
            "project_id": "id",
            "milestone_code": "text 30",
            "due_offset_days": "int",
            "expected_amount": "money",
            "status": "text 50",
        },
        "schedule_id",
        ["project_id milestone_code"],
        [
            ref("project_id", "project"),
            ref("milestone_code", "ref_milestone_type"),
            ref("status", "ref_schedule_status", "status_code"),
        ],
        non_negative("due_offset_days", "expected_amount"),
        audited=True,
    ),
    table(
        "invoice",
        {
            "invoice_id": "id",
            "project_id": "id",
            "schedule_id": "id?",
            "milestone_code": "text 30?",
            "invoice_number": "text 50",
            "invoice_date": "date",
            "due_date": "date",
            "amount": "money",
            "status": "text 50",
        },
        "invoice_id",
        ["invoice_number"],
        [
            ref("project_id", "project"),
            ref("schedule_id", "payment_schedule"),
            ref("milestone_code", "ref_milestone_type"),
            ref("status", "ref_invoice_status", "status_code"),
        ],
        non_negative("amount"),
        audited=True,
    ),
    table(
        "payment",
        {
            "payment_id": "id",
            "invoice_id": "id",
            "payment_date": "date",
            "amount": "money",
            "payment_method": "text 50",
        },
        "payment_id",
        references=[ref("invoice_id", "invoice"), ref("payment_method", "ref_payment_method", "method_code")],
        checks={"amount_positive": "amount > 0"},
        audited=True,
    ),
    table(
        "supplier",
        {
            "supplier_id": "id",
            "supplier_name": "text 100",
            "credit_limit": "money",
            "payment_terms_days": "int",
            "contact_email": "text 255",
        },
        "supplier_id",
        ["supplier_name"],
        checks=non_negative("credit_limit", "payment_terms_days"),
        audited=True,
    ),
    table(
        "purchase_order",
        {
            "order_id": "id",
            "supplier_id": "id",
            "project_id": "id",
            "order_date": "date",
            "expected_delivery_date": "date",
            "total_amount": "money",
            "status": "text 50",
        },
        "order_id",
        references=[
            ref("supplier_id", "supplier"),
            ref("project_id", "project"),
            ref("status", "ref_order_status", "status_code"),
        ],
        checks=non_negative("total_amount"),
        audited=True,
    ),
    table(
        "product",
        {"product_id": "id", "product_name": "text 150", "category": "text 50", "unit_cost": "money"},
        "product_id",
        references=[ref("category", "ref_product_category", "category_code")],
        checks=non_negative("unit_cost"),
        audited=True,
    ),
    table(
        "project_product",
        {"project_id": "id", "product_id": "id", "quantity": "int", "unit_price_charged": "money"},
        "project_id product_id",
        references=[ref("product_id", "product"), ref("project_id", "project")],
        checks={"quantity_positive": "quantity > 0", **non_negative("unit_price_charged")},
        audited=True,
    ),
    # --- cost supertype and its two subtypes -------------------------------
    table(
        "cost",
        {"cost_id": "id", "amount": "money", "cost_date": "date", "cost_category": "text 50"},
        "cost_id",
        ["cost_id cost_category"],
        [ref("cost_category", "ref_cost_category", "category_code")],
        non_negative("amount"),
        audited=True,
    ),
    table(
        "project_cost",
        {"cost_id": "id", "project_id": "id", "direct_cost_type": "text 50", "cost_category": "text 50"},
        "cost_id",
        references=[
            Reference(("cost_id", "cost_category"), "cost", ("cost_id", "cost_category")),
            ref("project_id", "project"),
            ref("direct_cost_type", "ref_direct_cost_type", "type_code"),
        ],
        checks={"discriminator": "cost_category = 'Direct Project'"},
    ),
    table(
        "operational_cost",
        {"cost_id": "id", "overhead_category": "text 50", "cost_category": "text 50"},
        "cost_id",
        references=[
            Reference(("cost_id", "cost_category"), "cost", ("cost_id", "cost_category")),
            ref("overhead_category", "ref_overhead_category", "category_code"),
        ],
        checks={"discriminator": "cost_category = 'Operational Overhead'"},
    ),
    # --- forecast and star schema ------------------------------------------
    table(
        "cashflow_forecast",
        {
            "forecast_id": "id",
            "project_id": "id?",
            "forecast_date": "date",
            "expected_cash_in": "money",
            "expected_cash_out": "money",
            "net_cashflow": "money",
            "flow_source": "text 30?",
        },
        "forecast_id",
        references=[ref("project_id", "project")],
        checks=non_negative("expected_cash_in", "expected_cash_out"),
        audited=True,
    ),
    table(
        "dim_date",
        {
            "date_key": "int",
            "full_date": "date",
            "day_of_week": "text 15",
            "day_of_month": "int",
            "month_name": "text 15",
            "month_num": "int",
            "quarter": "int",
            "year": "int",
            "is_weekend": "flag",
        },
        "date_key",
        ["full_date"],
    ),
    table(
        "dim_project",
        {
            "project_key": "id",
            "project_id": "id",
            "project_name": "text 150",
            "status": "text 50",
            "total_value": "money",
        },
        "project_key",
        ["project_id"],
    ),
    table(
        "dim_customer",
        {
            "customer_key": "id",
            "customer_id": "id",
            "customer_name": "text 200",
            "city": "text 100",
            "postal_code": "text 20",
        },
        "customer_key",
        ["customer_id"],
    ),
    table(
        "dim_cost_type",
        {
            "cost_type_key": "id",
            "cost_category": "text 50",
            "cost_subcategory": "text 50",
            "is_indirect": "flag",
        },
        "cost_type_key",
        ["cost_category cost_subcategory"],
    ),
    table(
        "fact_daily_cashflow",
        {
            "fact_id": "id",
            "date_key": "int",
            "project_key": "id?",
            "customer_key": "id?",
            "cost_type_key": "id?",
            "expected_cash_in": "money",
            "expected_cash_out": "money",
            "net_cashflow": "money",
        },
        "fact_id",
        references=[
            ref("date_key", "dim_date"),
            ref("project_key", "dim_project"),
            ref("customer_key", "dim_customer"),
            ref("cost_type_key", "dim_cost_type"),
        ],
        checks=non_negative("expected_cash_in", "expected_cash_out"),
    ),
    # --- import staging and logs -------------------------------------------
    table(
        "etl_run",
        {
            "run_id": "id",
            "source_system": "text 50",
            "source_filename": "text 255?",
            "started_at": "instant",
            "finished_at": "instant?",
            "status": "text 20",
            "rows_received": "int",
            "rows_promoted": "int",
            "rows_rejected": "int",
            "error_message": "text?",
            "triggered_by": "text 100",
        },
        "run_id",
        checks={"status_known": "status IN ('Running', 'Succeeded', 'Failed', 'Partial')"},
    ),
    table(
        "stg_sevdesk_invoice",
        {
            "stg_id": "id",
            "run_id": "id",
            "row_number": "int",
            "raw_invoice_number": "text 100?",
            "raw_project_id": "text 100?",
            "raw_invoice_date": "text 100?",
            "raw_due_date": "text 100?",
            "raw_amount": "text 100?",
            "raw_status": "text 100?",
            "is_valid": "flag",
            "rejection_reason": "text?",
            "promoted_at": "instant?",
        },
        "stg_id",
        references=[ref("run_id", "etl_run")],
    ),
    table(
        "data_erasure_log",
        {
            "erasure_id": "id",
            "subject_table": "text 100",
            "subject_id": "id",
            "requested_at": "instant",
            "executed_at": "instant",
            "executed_by": "text 100",
            "legal_basis_note": "text 500",
            "columns_affected": "text",
        },
        "erasure_id",
    ),
]

TABLES: dict[str, Table] = {t.name: t for t in _DECLARED}
