"""The registered audits reach every declared table, also those the engine itself writes."""

import pytest
from pyspark.sql import functions as F

from cashtide.operators import audit
from cashtide.plans import queries
from cashtide.plans.derived import Derived
from cashtide.schemas import TABLES
from cashtide.session import materialise

SF = "/root/testdata/sf0.001"

# Tables that the engine writes.
WRITTEN = {
    "payment_schedule", "cashflow_forecast", "fact_daily_cashflow", "dim_date", "dim_project", "dim_customer",
    "dim_cost_type", "etl_run", "stg_sevdesk_invoice", "data_erasure_log",
}


@pytest.fixture(scope="module")
def audited(spark):
    return {n: materialise(df) if n in WRITTEN else df for n, df in queries.audited_tables(Derived(spark, SF)).items()}


def found(spark, monkeypatch, name, T):
    monkeypatch.setattr(queries, "audited_tables", lambda d: T)
    return queries.QUERIES[name](spark, SF).collect()


def some(df):
    """One row; of an empty table, a made-up one."""
    row = df.limit(1)
    if not row.isEmpty():
        return row
    return df.sparkSession.range(1).select(*[value(f).alias(f.name) for f in df.schema])


def value(field):
    """A value that any column can have."""
    return F.lit("1970-01-01" if field.dataType.simpleString() in ("date", "timestamp") else "1").cast(field.dataType)


def test_all_tables_keys_and_references(audited):
    assert set(audited) == set(TABLES)
    keys = [(n, k) for n, t in TABLES.items() for k in t.keys]
    assert len(keys) == 45 and [n for n, k in keys if not set(k) <= set(audited[n].columns)] == []
    references = [(n, r) for n, t in TABLES.items() for r in t.references]
    assert len(references) == 29
    assert [(n, r) for n, r in references if not set(r.columns) <= set(audited[n].columns)] == []


@pytest.mark.parametrize("name", ["audit_keys", "audit_functional_dependency"])
def test_repeated_keys(spark, audited, monkeypatch, name):
    spoiled = dict(audited)
    for n in WRITTEN:
        row = some(audited[n])
        other = next(f for f in reversed(row.schema.fields) if not any(f.name in k for k in TABLES[n].keys))
        changed = F.when(F.col(other.name).isNull(), value(other))
        spoiled[n] = row.unionByName(row.withColumn(other.name, changed))
    rows = {(r.table_name, r[1]) for r in found(spark, monkeypatch, name, spoiled)}
    expected = {(n, ", ".join(k)) for n in WRITTEN for k in TABLES[n].keys}
    assert expected <= rows


def test_orphans(spark, audited, monkeypatch):
    parents = {r.parent for n in WRITTEN for r in TABLES[n].references}
    spoiled = {n: df.limit(0) if n in parents else df for n, df in audited.items()}
    rows = {(r.table_name, r.parent) for r in found(spark, monkeypatch, "audit_foreign_keys", spoiled)}
    assert {(n, r.parent) for n in WRITTEN for r in TABLES[n].references} <= rows


def test_orphans_of_the_schedule(spark, audited, monkeypatch):
    spoiled = {**audited, "payment_schedule": audited["payment_schedule"].limit(0)}
    rows = {(r.table_name, r.parent) for r in found(spark, monkeypatch, "audit_foreign_keys", spoiled)}
    assert ("invoice", "payment_schedule") in rows


def test_broken_checks(spark, audited, monkeypatch):
    missing = {
        n: next(c.name for c in reversed(TABLES[n].columns) if not c.nullable and c.name in audited[n].columns)
        for n in WRITTEN
    }
    spoiled = {**audited, **{n: some(audited[n]).withColumn(c, F.lit(None).cast(audited[n].schema[c].dataType)) for n, c in missing.items()}}
    rows = {(r.table_name, r.broken_check) for r in found(spark, monkeypatch, "audit_checks", spoiled)}
    assert {(n, f"{c}_required") for n, c in missing.items()} <= rows


def test_each_table_is_scanned_once_and_grouped_together(spark):
    T = {n: materialise(spark.range(50).selectExpr("id as a", "id % 7 as b", "id % 3 as c")) for n in "xy"}
    groups = audit.key_groups([(df, [(("a",), ["b"]), (("b", "c"), ["a"]), (("c",), [])]) for df in T.values()])
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Exchange hashpartitioning") == 1
    rows = groups.filter("occurrences > 1").collect()
    assert {(r.rule, r.key_value, r.occurrences) for r in rows if r.rule in (2, 5)} == {(i, str(c), 17 - (c == 2)) for i in (2, 5) for c in range(3)}
    assert {r.rule for r in rows if r.differs} == {1, 4}


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_a_clean_child_is_not_shuffled(spark, most):
    parent = materialise(spark.range(1000).selectExpr("(id - 500) * 3 as pid", "concat('k', id) as code", "id % 10 as part"))
    child = spark.range(3000).selectExpr("(id % 1000 - 500) * 3 as pid", "concat('k', id % 1000) as code", "id % 10 as part")
    lost = spark.createDataFrame([(1, "k5", 5), (1, "k1", 1), (2**62, "k2", 2), (None, "none", 3), (0, None, 4), (0, "k7", 8)], child.schema)
    child = materialise(child.unionByName(lost))
    references = [
        ("by id", ["pid"], audit.key_index(parent, ["pid"], most)),
        ("by code", ["code"], audit.key_index(parent, ["code"], most)),
        ("by both", ["code", "part"], audit.key_index(parent, ["code", "part"], most)),
    ]
    found = audit.audit_references(child, references)
    plan = found._jdf.queryExecution().executedPlan().toString()
    got = {(r.reference, r.key_value, r.orphan_rows) for r in found.collect()}
    assert got == {("by id", "1", 2), ("by id", str(2**62), 1), ("by code", "none", 1), ("by both", "none|3", 1), ("by both", "k7|8", 1)}
    if most:
        assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan  # of orphans alone
