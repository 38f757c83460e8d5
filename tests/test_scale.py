"""Plans and results where one key holds a large share of the rows."""

import datetime as dt
import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F
from tables import values

import __spark_entry__ as entry_module
from cashtide.operators import audit, imports, rules, skew
from cashtide.operators.imports import import_promote
from cashtide.session import materialise

SF = "/root/testdata/sf0.001"


@contextmanager
def settings(spark, **conf):
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


# Settings under which a few thousand rows already count as a skewed partition.
TINY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def tiny(spark):
    defaults = {"spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}
    for key, value in defaults.items():
        spark.conf.set(key, value)
    return settings(spark, **TINY)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    """60,000 invoices of which project 1 holds more than a third."""
    rows = spark.range(0, 60000, numPartitions=8)
    return rows.select(
        F.col("id").alias("invoice_id"),
        F.when(F.col("id") % 5 < 2, 1).otherwise(F.col("id") % 3000 + 2).cast("bigint").alias("project_id"),
        F.concat(F.lit("N-"), F.col("id")).alias("invoice_number"),
        F.date_add(F.lit("2026-01-01").cast("date"), (F.hash("id") % 300).cast("int")).alias("invoice_date"),
        F.lit(5000).cast("decimal(12,2)").alias("amount"),
        F.lit("Issued").alias("status"),
    )


@pytest.fixture(scope="module")
def projects(spark):
    return spark.range(1, 3003, numPartitions=8).select(
        F.col("id").alias("project_id"), F.lit(9000).cast("decimal(12,2)").alias("total_value")
    )


def test_hot_project_is_ranked_before_the_shuffle_and_split_in_the_join(spark, hot, projects):
    ranked = rules._scope(hot, projects, None)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit .*Partial", ranked)
    with tiny(spark):
        coded = rules.rule_classify_invoices(hot, projects)
        plan = executed(coded)
        got = {r.invoice_id: r.milestone_code for r in coded.collect()}
    assert "skew=true" in plan
    by_project = {}
    for r in hot.collect():
        by_project.setdefault(r.project_id, []).append((r.invoice_date, r.invoice_number, r.invoice_id))
    stages = ["STAGE_1_ROOF", "STAGE_2_COMMISSIONING"]
    want = {}
    for members in by_project.values():
        for place, (_, _, i) in enumerate(sorted(members)):
            want[i] = stages[place] if place < 2 else "ADJUSTMENT"
    assert got == want


def test_a_small_unique_side_spares_the_shuffle(spark, hot, projects):
    final = executed(rules.rule_classify_invoices(hot, projects)).split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in final and "Exchange hashpartitioning" not in final


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_hot_and_missing_keys_are_split(spark, hot, projects, how):
    """Hot keys, and a third of the rows without a key, against a grouped side."""
    many = hot.select(
        "invoice_id", "invoice_number", F.when(F.col("invoice_id") % 9 > 2, F.col("project_id")).alias("project_id")
    )
    one = projects.filter("project_id % 7 <> 0").groupBy("project_id").agg(F.max("total_value").alias("v"))
    with tiny(spark):
        joined = skew.join_stored(many, one, ["project_id"], how)
        plan = executed(joined)
        plain = many.join(one, ["project_id"], how).select(*joined.columns)
        assert sorted(joined.collect(), key=str) == sorted(plain.collect(), key=str)
    assert "skew=true" in plan


def test_hot_key_of_a_left_join_is_split(spark, hot, projects):
    with tiny(spark):
        joined = skew.keep_all_left(projects.withColumn("tag", F.lit("x")), hot, ["project_id"])
        plan = executed(joined)
        counts = dict(values(joined.groupBy("project_id").agg(F.count("invoice_id").alias("n")), "project_id", "n"))
    plain = projects.join(hot, "project_id", "left").groupBy("project_id").agg(F.count("invoice_id").alias("n"))
    assert counts == dict(values(plain, "project_id", "n"))
    assert "skew=true" in plan


def test_hot_reference_is_counted_before_the_shuffle(spark, hot, projects):
    orphans = audit.audit_foreign_keys(hot, projects.filter("project_id > 1"), ["project_id"])
    assert values(orphans, "project_id", "orphan_rows") == [(1, 24000)]


def test_small_batch_does_not_shuffle_the_invoices(spark, hot):
    """A stored batch is broadcast on its measured size; the table is only scanned."""
    table = materialise(hot.withColumn("due_date", F.col("invoice_date")).withColumn("created_by", F.lit("x")))
    staged = materialise(
        spark.range(40).select(
            F.lit(1).cast("bigint").alias("run_id"),
            F.col("id").cast("int").alias("row_number"),
            F.concat(F.lit("N-"), F.col("id") + 59980).alias("raw_invoice_number"),
            F.lit("1").alias("raw_project_id"),
            F.lit("2026-01-01").alias("raw_invoice_date"),
            F.lit("2026-01-02").alias("raw_due_date"),
            F.lit("1.00").alias("raw_amount"),
            F.lit("Issued").alias("raw_status"),
            F.lit(True).alias("is_valid"),
        )
    )
    promoted = import_promote(table, staged)
    plan = executed(promoted)
    final = plan.split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in final and "BroadcastHashJoin" in final
    assert promoted.count() == 60020 and promoted.filter("amount = 1").count() == 40


def test_large_batch_meets_the_invoices_in_one_join(spark, monkeypatch):
    """The table is read and shuffled once, with the rows that patching gives, also of repeated and
    missing numbers."""
    table = spark.range(300).select(
        F.col("id").alias("invoice_id"),
        (F.col("id") % 7).alias("project_id"),
        F.when(F.col("id") % 50 > 0, F.concat(F.lit("N-"), F.least("id", F.lit(275)))).alias("invoice_number"),
        F.lit("2026-01-01").cast("date").alias("invoice_date"),
        F.lit("2026-01-08").cast("date").alias("due_date"),
        F.lit(5).cast("decimal(12,2)").alias("amount"),
        F.lit("Issued").alias("status"),
        F.lit("x").alias("created_by"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("updated_at"),
    )
    table = materialise(table)
    raw = {"invoice_number": F.concat(F.lit("N-"), F.col("id") + 200), "project_id": F.lit("3"), "invoice_date": F.lit("2026-02-01")}
    raw |= {"due_date": F.lit("2026-02-02"), "amount": F.lit("1.00"), "status": F.lit("Paid")}
    staged = spark.range(150).select(
        F.col("id").cast("int").alias("row_number"), *[v.alias(f"raw_{c}") for c, v in raw.items()], (F.col("id") % 10 > 0).alias("is_valid")
    )
    now = dt.datetime(2026, 2, 1, 8)
    patched = import_promote(table, staged, now)
    monkeypatch.setattr(imports, "SMALL_BATCH", 100)
    with tiny(spark):
        joined = import_promote(table, staged, now)
        plan = executed(joined).split("== Initial Plan ==")[0]
        assert values(joined, *table.columns) == values(patched, *table.columns)
    assert patched.filter("amount = 1").count() == 159 and patched.filter("invoice_number is null").count() == 6
    assert plan.count("FullOuter") == 1 and "LeftAnti" not in plan and "LeftSemi" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    df = entry_module.queries()["view_supplier_watch"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert scans and all("l_tax" not in s and "l_comment" not in s for s in scans)
    assert "LessThanOrEqual(l_linenumber,2)" in plan
