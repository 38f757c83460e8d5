"""Imports that touch some partitions against the full run on all tables."""

import datetime as dt
import os
import random

import pytest
from tables import DAY, NOW, customer, day, invoice, money, order, project, supplier, tables, values

from pyspark.sql import functions as F

from cashtide.operators import imports, increment
from cashtide.sources.partitions import BUCKET, bucketed, move_partitions, replace_partitions_from, write_partitions

RAW = "row_number int, " + ", ".join(f"{c} string" for c in imports.RAW_FIELDS)
# Times of change and ids of rows that stay differ between the two ways.
STAMPS = {"created_at", "updated_at"}


def cost(cid, amount, offset):
    return {"cost_id": cid, "amount": money(amount), "cost_date": day(offset), "cost_category": "Operational Overhead"}


def start(spark, draw):
    projects = [project(p, draw.choice([1500, 2900, 12000, 40000]), draw.randint(-40, 25), 1 + p % 5) for p in range(1, 41)]
    invoices = [
        invoice(i, draw.randint(1, 40), draw.choice([800, 3500, 9000]), draw.randint(-60, 5), draw.choice(["Issued", "Paid", "Overdue"]))
        for i in range(1, 121)
    ]
    orders = [order(o, 100 + o, draw.randint(-30, 30), 1 + o % 3, draw.choice([*range(1, 41), 999])) for o in range(1, 80)]
    costs = [cost(c, 10 + c, draw.randint(-5, 60)) for c in range(1, 40)]
    return tables(
        spark,
        customer=[customer(c) for c in range(1, 6)],
        project=projects,
        invoice=invoices,
        supplier=[supplier(s, 7 * s) for s in range(1, 4)],
        purchase_order=orders,
        cost=costs,
        operational_cost=[{"cost_id": c["cost_id"], "overhead_category": "Rent", "cost_category": "Operational Overhead"} for c in costs],
    )


def a_batch(spark, draw, size, numbers):
    rows = []
    for i, number in enumerate(draw.sample(numbers, size)):
        billed = day(draw.randint(-20, 5))
        status = draw.choice(["Issued", "Paid", "Overdue", "Draft" if i == 0 else "Paid"])
        rows.append((i + 2, number, str(draw.randint(1, 40)), str(billed), str(billed + dt.timedelta(7)), f"{draw.choice([500, 4000, 7000])}.00", status))
    return spark.createDataFrame(rows, RAW)


def same(full, live):
    for name in increment.LIVE:
        columns = [c for c in full[name].columns if c not in STAMPS]
        assert values(live[name], *columns) == values(full[name], *columns), name


def files(folder):
    return {os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def test_batches_in_a_row_equal_the_full_run(spark, tmp_path):
    draw = random.Random(11)
    T = start(spark, draw)
    folder = str(tmp_path / "live")
    numbers = [f"N-{i:04d}" for i in range(1, 121)] + [f"X-{i}" for i in range(30)]
    staged = imports.import_stage(a_batch(spark, draw, 0, numbers), 0)
    runs = imports.import_run_open(staged, "x", "x", NOW)
    T |= {"stg_sevdesk_invoice": staged, "etl_run": runs}
    increment.create_live(T, folder, DAY, NOW, buckets=16)
    full = {**T, **increment.read_live(spark, folder)}
    stored = {n: spark.createDataFrame(full[n].collect(), full[n].schema) for n in increment.LIVE}
    full |= stored
    as_of = DAY
    for step, size in enumerate((9, 25)):
        as_of += dt.timedelta(days=(0, 12)[step])
        rows = a_batch(spark, draw, size, numbers)
        at = NOW + dt.timedelta(days=step)
        done = increment.import_live(folder, T, rows, as_of, at, f"{step}.csv", "anna")
        full = imports.import_run(full, rows, as_of, at, f"{step}.csv", "anna")
        same(full, {**done, **increment.read_live(spark, folder)})
        assert [r.text for r in done["report"].collect()] == [r.text for r in full["report"].collect()]
        full = {n: df for n, df in full.items() if n != "report"}
        full |= {n: spark.createDataFrame(full[n].collect(), full[n].schema) for n in increment.LIVE}


def test_only_touched_partitions_change(spark, tmp_path):
    T = start(spark, random.Random(12))
    folder = str(tmp_path / "live")
    increment.create_live(T, folder, DAY, NOW, buckets=32)
    before = {n: files(f"{folder}/{n}") for n in ("invoice", "payment_schedule", "invoice_index", "cashflow_forecast", "dim_customer")}
    rows = spark.createDataFrame([(2, "N-0001", "7", "2026-03-01", "2026-03-08", "4000.00", "Paid")], RAW)
    increment.import_live(folder, T, rows, DAY + dt.timedelta(days=2), NOW)
    after = {n: files(f"{folder}/{n}") for n in before}
    for name in ("invoice", "payment_schedule", "invoice_index"):
        gone = {f.split("/")[0] for f in before[name] - after[name]}
        assert 1 <= len(gone) <= 3, name  # of 32
    assert after["dim_customer"] == before["dim_customer"]
    old = {f for f in before["cashflow_forecast"] if f < f"forecast_date={DAY + dt.timedelta(days=2)}"}
    assert old and old <= after["cashflow_forecast"]


def test_the_invoice_scan_is_pruned(spark, tmp_path, monkeypatch):
    T = start(spark, random.Random(13))
    folder = str(tmp_path / "live")
    increment.create_live(T, folder, DAY, NOW, buckets=32)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plans = []
    real = increment.materialise
    monkeypatch.setattr(increment, "materialise", lambda df, *by: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, *by))[1])
    rows = spark.createDataFrame([(2, "N-0001", "7", "2026-03-01", "2026-03-08", "4000.00", "Paid")], RAW)
    increment.import_live(folder, T, rows, DAY, NOW)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for plan in plans for line in plan.splitlines() if "FileScan parquet" in line and f"{folder}/invoice]" in line.replace("file:", "")]
    assert scans and all("PartitionFilters: []" not in line and "_bucket" in line for line in scans)


def test_a_lost_run_can_be_repeated(spark, tmp_path, monkeypatch):
    draw = random.Random(14)
    T = start(spark, draw)
    numbers = [f"N-{i:04d}" for i in range(1, 121)] + [f"X-{i}" for i in range(30)]
    rows = a_batch(spark, draw, 12, numbers)
    kept = {}
    for name in ("whole", "lost"):
        folder = str(tmp_path / name)
        increment.create_live(T, folder, DAY, NOW, buckets=8)
        if name == "lost":
            with monkeypatch.context() as patch:
                patch.setattr(increment, "replace_partitions_from", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(imports.ImportFailed, match="lost"):
                    increment.import_live(folder, T, rows, DAY, NOW)
        increment.import_live(folder, T, rows, DAY, NOW)
        kept[name] = increment.read_live(spark, folder)
    for name, df in kept["whole"].items():
        columns = [c for c in df.columns if c not in STAMPS]
        assert values(kept["lost"][name], *columns) == values(df, *columns), name


def test_named_changes_and_an_earlier_day(spark, tmp_path):
    draw = random.Random(15)
    T = start(spark, draw)
    folder = str(tmp_path / "live")
    increment.create_live(T, folder, DAY, NOW, buckets=8)
    full = {**T, **increment.read_live(spark, folder)}
    full |= {n: spark.createDataFrame(df.collect(), df.schema) for n, df in full.items() if n in increment.LIVE}
    changed = T["project"].selectExpr("*", "project_id % 4 = 0 as hit").selectExpr(
        *[c if c != "total_value" else "cast(if(hit, total_value * 3, total_value) as decimal(12,2)) as total_value" for c in T["project"].columns]
    )
    T, full = T | {"project": changed}, full | {"project": changed}
    rows = spark.createDataFrame([(2, "N-0001", "7", "2026-03-01", "2026-03-08", "4000.00", "Paid")], RAW)
    ids = changed.filter("project_id % 4 = 0").select("project_id")
    done = increment.import_live(folder, T, rows, DAY, NOW, changed_projects=ids, changed_customers=T["customer"].select("customer_id"))
    expected = imports.import_run({k: v for k, v in full.items() if k not in ("stg_sevdesk_invoice", "etl_run")}, rows, DAY, NOW)
    same(expected, done)
    with pytest.raises(ValueError, match="last import"):
        increment.import_live(folder, T, rows, DAY - dt.timedelta(days=1), NOW)


def test_partitions_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda xs: spark.createDataFrame(xs, "day date, n int")
    write_partitions(rows([(day(i), i) for i in range(5)]), path, "day")
    old = {f for f in files(path) if f < f"day={day(2)}"}
    replace_partitions_from(rows([(day(3), 30), (day(9), 90)]), path, "day", day(2))
    got = values(spark.read.schema("n int, day date").parquet(path), "day", "n")
    assert got == [(day(0), 0), (day(1), 1), (day(3), 30), (day(9), 90)]
    assert len(old) == 2 and old <= files(path)
    replace_partitions_from(rows([]), path, "day", day(1))
    assert values(spark.read.schema("n int, day date").parquet(path), "n") == [(0,)]


def test_numbers_that_repeat_and_invoices_of_no_project(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(increment, "MANY_PROJECTS", 10)
    T = start(spark, random.Random(16))
    odd = [invoice(901, 5, 800, number="D-1"), invoice(902, 6, 9000, number="D-1"), invoice(903, None, 800, number="P-1"), invoice(904, None, 800, number="P-2")]
    T |= {"invoice": T["invoice"].unionByName(tables(spark, invoice=odd)["invoice"])}
    folder = str(tmp_path / "live")
    increment.create_live(T, folder, DAY, NOW, buckets=8)
    full = {**T, **increment.read_live(spark, folder)}
    full |= {n: spark.createDataFrame(df.collect(), df.schema) for n, df in full.items() if n in increment.LIVE}
    rows = [(i + 2, number, pid, "2026-03-01", "2026-03-08", "4000.00", "Paid") for i, (number, pid) in enumerate([("D-1", "7"), ("P-1", "8"), ("N-0001", "9"), ("X-1", "9")])]
    rows = spark.createDataFrame(rows, RAW)
    done = increment.import_live(folder, T, rows, DAY, NOW)
    same(imports.import_run({k: v for k, v in full.items() if k not in ("stg_sevdesk_invoice", "etl_run")}, rows, DAY, NOW), done)
    index = {(r.invoice_number, r.project_id) for r in spark.read.parquet(f"{folder}/invoice_index").collect()}
    assert {("D-1", 7), ("P-1", 8), ("P-2", None), ("N-0001", 9), ("X-1", 9)} <= index
    assert len(index) == len({number for number, _ in index})


def test_steps_are_not_kept(spark, tmp_path, monkeypatch):
    T = start(spark, random.Random(17))
    scratch, folder = tmp_path / "scratch", str(tmp_path / "live")
    monkeypatch.setattr("cashtide.session.shared_dir", lambda _: str(scratch))
    steps = lambda: set(os.listdir(scratch / "cashtide"))
    increment.create_live(T, folder, DAY, NOW, buckets=8)
    assert steps() == set()
    moved = []
    real = increment.move_partitions
    monkeypatch.setattr(increment, "move_partitions", lambda s, staged, path, *a: (moved.append(os.path.basename(path)), real(s, staged, path, *a))[1])
    rows = spark.createDataFrame([(2, "N-0001", "7", "2026-03-01", "2026-03-08", "4000.00", "Paid")], RAW)
    done = increment.import_live(folder, T, rows, DAY, NOW)
    # Left are those that the tables given back read: the staged rows, the run and the report.
    assert len(steps()) <= 4 and not os.path.exists(f"{folder}/_staged")
    assert moved == ["invoice", "payment_schedule", "dim_project", "dim_customer", "invoice_index"]
    assert all(df.count() >= 0 for df in done.values())


def test_another_layout_is_refused(spark, tmp_path):
    row = spark.createDataFrame([(0, DAY, 30, 8, 0)], "run_id bigint, as_of date, horizon int, buckets int, highest bigint")
    row.write.parquet(str(tmp_path / "_runs"))
    rows = spark.createDataFrame([(2, "N-0001", "7", "2026-03-01", "2026-03-08", "4000.00", "Paid")], RAW)
    with pytest.raises(ValueError, match="layout 1"):
        increment.import_live(str(tmp_path), {}, rows, DAY, NOW)


@pytest.mark.parametrize("key", ["cast(id * 77 as bigint)", "concat('N-', id)"])
def test_a_task_of_a_join_has_rows_of_one_bucket(spark, key):
    rows = spark.range(5000).selectExpr(f"{key} as k").repartition(12, "k")
    rows = bucketed(rows, "k", 4).withColumn("task", F.spark_partition_id())
    found = rows.groupBy("task").agg(F.count_distinct(BUCKET).alias("n")).collect()
    assert len(found) == 12 and {r.n for r in found} == {1}
    assert rows.select(BUCKET).distinct().count() == 4


def test_staged_partitions_take_the_place(spark, tmp_path):
    rows = lambda xs: spark.createDataFrame(xs, f"n int, {BUCKET} int")
    path, staged = str(tmp_path / "t"), str(tmp_path / "s")
    write_partitions(rows([(i, i) for i in range(5)]), path, BUCKET)
    old = files(path)
    write_partitions(rows([(10, 1), (11, 1), (70, 7)]), staged, BUCKET, gathered=True)
    move_partitions(spark, staged, path, BUCKET, [1, 2, 7, 9])
    got = values(spark.read.schema(f"n int, {BUCKET} int").parquet(path), BUCKET, "n")
    assert got == [(0, 0), (1, 10), (1, 11), (3, 3), (4, 4), (7, 70)]
    assert {f for f in old if f[:9] in (f"{BUCKET}=0", f"{BUCKET}=3", f"{BUCKET}=4")} <= files(path) and files(staged) == set()
