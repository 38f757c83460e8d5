"""Work that would grow faster than the input: rows grouped anew, sorted groupings, one task per run."""

import os

import pytest
from pyspark.sql import functions as F

from cashtide.operators import audit, views
from cashtide.plans import queries
from cashtide.plans.derived import STORED, Derived
from cashtide.session import materialise, released

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_documents_are_grouped_once(spark):
    d = Derived(spark, SF, STORED)
    plan = plan_of(d["invoice"].join(d["payment"], "invoice_id"))
    assert "lineitem" not in plan and "Aggregate" not in plan
    plain = Derived(spark, SF)["invoice"]
    assert d["invoice"].exceptAll(plain).isEmpty() and plain.exceptAll(d["invoice"]).isEmpty()


def test_line_documents_of_an_order_are_in_few_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = Derived(spark, SF, STORED)["line_doc"].withColumn("file", F.input_file_name())
        found = docs.groupBy("l_orderkey").agg(F.count_distinct("file").alias("files")).agg(F.max("files"), F.sum("files"), F.count("*")).first()
        assert docs.select("file").distinct().count() == 8
        assert found[0] <= 2 and found[1] - found[2] <= 7  # an order is cut at most where two files meet
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_writes_leave_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in manager.getAllFiles().mkString(" ").split() if "/shuffle_" in f}
    before = shuffled()
    stored = materialise(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count().repartition(4, "count"))
    assert stored.count() == 100
    assert {f for f in shuffled() - before if f.endswith(".data") and os.path.getsize(f) > 1000} == set()


def test_released_results_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("cashtide.session.shared_dir", lambda _: str(tmp_path))
    kept = lambda: len(os.listdir(tmp_path / "cashtide"))
    outer = materialise(spark.range(3))
    with pytest.raises(RuntimeError), released(spark):
        first = materialise(outer.selectExpr("id + 1 as id"))
        with released(spark):
            assert materialise(first).count() == 3 and kept() == 3
        assert first.count() == 3 and kept() == 2
        raise RuntimeError
    assert outer.count() == 3 and kept() == 1


def test_postings_are_parsed_once(spark):
    stored, _, live = queries.stored_postings(Derived(spark, SF))
    assert "lineitem" not in plan_of(stored) + plan_of(live)


def test_key_groups_are_hashed_and_exact(spark):
    rows = [(1, "a|b", "c", 1), (1, "a", "b|c", 1), (2, None, "x", 1), (2, "", "x", 1), (3, None, "x", 1), (3, None, "x", 2)]
    df = materialise(spark.createDataFrame(rows, "n bigint, s string, t string, v int"))
    groups = audit.key_groups([(df, [(("s", "n", "t"), ["v"]), (("n",), ["v"]), (("s",), [])])])
    plan = plan_of(groups)
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    found = {(r.rule, r.key_value, r.occurrences, r.differs) for r in groups.collect() if r.rule < 2}
    assert found == {
        (0, "a|b|1|c", 1, False), (0, "a|1|b|c", 1, False), (0, "2|x", 1, False), (0, "|2|x", 1, False), (0, "3|x", 2, True),
        (1, "1", 2, False), (1, "2", 2, False), (1, "3", 2, True),
    }


def test_no_index_beyond_what_is_broadcast(spark):
    parent = spark.range(2000).selectExpr("id * 1000 as pid")
    assert audit.key_index(parent, ["pid"], 100).frame is None
    assert audit.key_index(parent, ["pid"], 100_000).frame.count() == 2000


def test_combinations_are_not_joined_back(spark):
    df = materialise(spark.createDataFrame([(1, None), (1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "d")], "k int, v string"))
    found = audit.audit_functional_dependency(df, ["k"], ["v"])
    assert plan_of(found).count("FileScan") == 1
    assert {(r.k, r.combinations) for r in found.collect()} == {(1, 2), (None, 2)}


def test_rejections_are_not_brought_together_by_run(spark):
    staged = materialise(
        spark.range(100).selectExpr(
            "1L as run_id", "cast(id as int) as row_number", "id % 2 = 0 as is_valid", "'n' as raw_invoice_number",
            "'p' as raw_project_id", "'1' as raw_amount", "'r' as rejection_reason",
        )
    )
    runs = staged.groupBy("run_id").agg(F.lit("f").alias("source_filename"), F.lit("1998-06-15").cast("timestamp").alias("started_at"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")
    try:
        # As large as the input on paper, so only its measured size lets the runs be broadcast.
        wide = spark.range(10**6).selectExpr("id % 1 + 1 as run_id").groupBy("run_id").count().drop("count").join(runs, "run_id")
        found = views.view_etl_rejections({"stg_sevdesk_invoice": staged, "etl_run": wide})
        assert "BroadcastHashJoin" in plan_of(found) and "hashpartitioning(run_id" not in plan_of(found)
        assert found.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
