"""The star schema: calendar, project, customer and cost type dimensions and
the daily cash-flow fact."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtide.functions.hashing import short_key
from cashtide.functions.numbers import MONEY, date_key
from cashtide.operators.mutate import replace_from_date, upsert
from cashtide.operators.rules import HORIZON_DAYS, MILESTONE_FLOW, SUPPLIER_FLOW, shaped_like, unshared

Tables = Mapping[str, DataFrame]

# Fixed values of the star schema.
LOOKBACK_DAYS = 30
DIRECT_CATEGORY = "Direct Project"
OVERHEAD_CATEGORY = "Operational Overhead"

FACT_KEYS = ["date_key", "project_key", "customer_key", "cost_type_key"]


def calendar_rows(days: DataFrame, column: str = "full_date") -> DataFrame:
    """Calendar attributes of each day."""
    day = F.col(column)
    return days.select(
        date_key(day).alias("date_key"),
        day.alias("full_date"),
        F.date_format(day, "EEEE").alias("day_of_week"),
        F.dayofmonth(day).alias("day_of_month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.month(day).alias("month_num"),
        F.quarter(day).alias("quarter"),
        F.year(day).alias("year"),
        (F.weekday(day) >= 5).alias("is_weekend"),
    )


def star_dim_date(
    spark: SparkSession,
    as_of: dt.date,
    horizon: int = HORIZON_DAYS,
    lookback: int = LOOKBACK_DAYS,
    dim: DataFrame | None = None,
) -> DataFrame:
    """The days around ``as_of``, added to an existing calendar."""
    first, last = as_of - dt.timedelta(days=lookback), as_of + dt.timedelta(days=horizon)
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("full_date"))
    fresh = calendar_rows(days)
    return fresh if dim is None else upsert(dim, fresh, ["date_key"], insert_only=True, unique=True)


def star_dim_project(project: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    fresh = project.select(
        F.col("project_id").alias("project_key"), "project_id", "project_name", "status", "total_value"
    )
    if dim is None:
        return fresh
    return upsert(dim, fresh, ["project_id"], ["project_name", "status", "total_value"], unique=True)


def star_dim_customer(customer: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    fresh = customer.select(
        F.col("customer_id").alias("customer_key"),
        "customer_id",
        F.concat("first_name", F.lit(" "), "last_name").alias("customer_name"),
        "city",
        "postal_code",
    )
    if dim is None:
        return fresh
    return upsert(dim, fresh, ["customer_id"], ["customer_name", "city", "postal_code"], unique=True)


def cost_type_key(category: Column, subcategory: Column) -> Column:
    return short_key(F.concat_ws("|", category, subcategory), 15)


def star_dim_cost_type(
    direct_cost_type: DataFrame, overhead_category: DataFrame, dim: DataFrame | None = None
) -> DataFrame:
    """Every direct cost type and every overhead category, each flagged."""

    def rows(codes: DataFrame, column: str, category: str, indirect: bool) -> DataFrame:
        return codes.select(
            cost_type_key(F.lit(category), F.col(column)).alias("cost_type_key"),
            F.lit(category).alias("cost_category"),
            F.col(column).alias("cost_subcategory"),
            F.lit(indirect).alias("is_indirect"),
        )

    fresh = rows(direct_cost_type, "type_code", DIRECT_CATEGORY, False).unionByName(
        rows(overhead_category, "category_code", OVERHEAD_CATEGORY, True)
    )
    fresh = fresh.withColumn("cost_type_key", unshared(F.col("cost_type_key"), F.lit("cost types share a key")))
    if dim is None:
        return fresh
    return upsert(dim, fresh, ["cost_category", "cost_subcategory"], insert_only=True, unique=True)


def star_fact(T: Tables, as_of: dt.date, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Future cash flow per day, project, customer and cost type.

    Forecast rows are summed per day and project, and overhead per day and
    category, before any join to a dimension.
    """
    flows = (
        T["cashflow_forecast"]
        .filter(F.col("forecast_date") >= F.lit(as_of))
        .filter(F.col("flow_source").isin(MILESTONE_FLOW, SUPPLIER_FLOW))
        .groupBy(date_key(F.col("forecast_date")).alias("date_key"), "project_id")
        .agg(F.sum("expected_cash_in").alias("cash_in"), F.sum("expected_cash_out").alias("cash_out"))
        .join(T["project"].select("project_id", "customer_id"), "project_id", "left")
        .join(T["dim_project"].select("project_id", "project_key"), "project_id", "left")
        .join(T["dim_customer"].select("customer_id", "customer_key"), "customer_id", "left")
        .select(
            "date_key",
            "project_key",
            "customer_key",
            F.lit(None).cast("bigint").alias("cost_type_key"),
            "cash_in",
            "cash_out",
        )
    )
    indirect = (
        T["dim_cost_type"]
        .filter(F.col("cost_category") == OVERHEAD_CATEGORY)
        .select(F.col("cost_subcategory").alias("overhead_category"), "cost_type_key")
    )
    overhead = (
        T["cost"]
        .select("cost_id", "amount", "cost_date")
        .filter(F.col("cost_date").between(F.lit(as_of), F.lit(as_of + dt.timedelta(days=horizon))))
        .join(T["operational_cost"].select("cost_id", "overhead_category"), "cost_id")
        .groupBy(date_key(F.col("cost_date")).alias("date_key"), "overhead_category")
        .agg(F.sum("amount").alias("cash_out"))
        .join(indirect, "overhead_category")
        .select(
            "date_key",
            F.lit(None).cast("bigint").alias("project_key"),
            F.lit(None).cast("bigint").alias("customer_key"),
            "cost_type_key",
            F.lit(0).cast(MONEY).alias("cash_in"),
            "cash_out",
        )
    )
    total_in, total_out = F.sum("cash_in"), F.sum("cash_out")
    fresh = (
        flows.unionByName(overhead)
        .groupBy(*FACT_KEYS)
        .agg(
            total_in.cast(MONEY).alias("expected_cash_in"),
            total_out.cast(MONEY).alias("expected_cash_out"),
            (total_in - total_out).cast(MONEY).alias("net_cashflow"),
        )
    )
    past = T.get("fact_daily_cashflow")
    if past is None:
        return fresh
    first = as_of.year * 10000 + as_of.month * 100 + as_of.day
    fresh = shaped_like(fresh, past, None, "fact_id", FACT_KEYS, past.filter(F.col("date_key") < first))
    return replace_from_date(past, fresh, "date_key", first)


def star_refresh(
    T: Tables, as_of: dt.date, horizon: int = HORIZON_DAYS, store: Callable[[str, DataFrame], DataFrame] | None = None
) -> dict[str, DataFrame]:
    """All dimensions and then the fact, in a new mapping of tables.

    ``store`` takes the name and the rows of a dimension and gives it back as the fact is to read it.
    """
    spark = T["project"].sparkSession
    keep = store or (lambda _, rows: rows)
    T = dict(T)
    T["dim_date"] = keep("dim_date", star_dim_date(spark, as_of, horizon, dim=T.get("dim_date")))
    T["dim_project"] = keep("dim_project", star_dim_project(T["project"], T.get("dim_project")))
    T["dim_customer"] = keep("dim_customer", star_dim_customer(T["customer"], T.get("dim_customer")))
    T["dim_cost_type"] = keep(
        "dim_cost_type", star_dim_cost_type(T["ref_direct_cost_type"], T["ref_overhead_category"], T.get("dim_cost_type"))
    )
    T["fact_daily_cashflow"] = star_fact(T, as_of, horizon)
    return T
