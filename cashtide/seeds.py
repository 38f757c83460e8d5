"""Rows of the reference domains, as local relations of a few rows each.

A local relation has an exact size in the plan, so Catalyst broadcasts it on
its own size check; no hint is needed anywhere.
"""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cashtide.schemas import TABLES

# Codes and flags of the reference domains.
MILESTONE_TYPES = [
    # code, label, percentage, default offset, part of split, is milestone
    ("STAGE_1_ROOF", "Stage 1", Decimal("55.00"), 14, True, True),
    ("STAGE_2_COMMISSIONING", "Stage 2", Decimal("45.00"), 45, True, True),
    ("SINGLE_PAYMENT", "Single payment", Decimal("100.00"), 14, False, True),
    ("ADJUSTMENT", "Adjustment", None, 0, False, False),
]
PROJECT_STATUS = [("Planned", False), ("In Progress", False), ("Completed", True)]
SCHEDULE_STATUS = ["Pending", "Invoiced", "Paid", "Overdue"]
INVOICE_STATUS = [
    ("Issued", True),
    ("Partially Paid", True),
    ("Paid", False),
    ("Overdue", True),
    ("Cancelled", False),
]
ORDER_STATUS = [("Ordered", True), ("Delivered", True), ("Cancelled", False)]
PAYMENT_METHODS = [("Bank Transfer", 1)]
PRODUCT_CATEGORIES = ["Module", "Inverter", "Mounting", "Battery", "Cabling"]
OVERHEAD_CATEGORIES = ["Rent", "Fuel", "Advertising", "Insurance", "Software License"]
DIRECT_COST_TYPES = ["Materials", "Labor"]
COST_CATEGORIES = [("Direct Project", False), ("Operational Overhead", True)]


def _rows() -> dict[str, list[dict]]:
    def flagged(pairs, flag):
        return [
            {"status_code": code, "description": code, "sort_order": i, flag: value}
            for i, (code, value) in enumerate(pairs, start=1)
        ]

    def plain(codes, key):
        return [{key: code, "description": code} for code in codes]

    return {
        "ref_milestone_type": [
            {
                "milestone_code": code,
                "description": label,
                "milestone_label": label,
                "percentage": percentage,
                "default_due_offset_days": offset,
                "part_of_split": split,
                "is_milestone": milestone,
            }
            for code, label, percentage, offset, split, milestone in MILESTONE_TYPES
        ],
        "ref_project_status": flagged(PROJECT_STATUS, "is_terminal"),
        "ref_schedule_status": [
            {"status_code": code, "description": code, "sort_order": i}
            for i, code in enumerate(SCHEDULE_STATUS, start=1)
        ],
        "ref_invoice_status": flagged(INVOICE_STATUS, "counts_as_receivable"),
        "ref_order_status": flagged(ORDER_STATUS, "counts_as_payable"),
        "ref_payment_method": [
            {"method_code": code, "description": code, "settlement_days": days} for code, days in PAYMENT_METHODS
        ],
        "ref_product_category": plain(PRODUCT_CATEGORIES, "category_code"),
        "ref_overhead_category": plain(OVERHEAD_CATEGORIES, "category_code"),
        "ref_direct_cost_type": plain(DIRECT_COST_TYPES, "type_code"),
        "ref_cost_category": [
            {"category_code": code, "description": code, "is_indirect": indirect} for code, indirect in COST_CATEGORIES
        ],
    }


ARROW_TYPES = {
    "id": pa.int64(),
    "int": pa.int32(),
    "money": pa.decimal128(12, 2),
    "percent": pa.decimal128(5, 2),
    "date": pa.date32(),
    "instant": pa.timestamp("us", tz="UTC"),
    "flag": pa.bool_(),
    "text": pa.string(),
}


def local_table(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    """A handful of rows of a declared table as a local relation; columns a row
    leaves out are null."""
    fields = [pa.field(c.name, ARROW_TYPES[c.kind]) for c in TABLES[name].columns]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=pa.schema(fields)))


def reference_domains(spark: SparkSession, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The named reference domains, or all of them."""
    rows = _rows()
    return {name: local_table(spark, name, rows[name]) for name in (rows if names is None else names)}
