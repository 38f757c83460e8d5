"""The drop folder: one run per file, nothing twice."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from tables import DAY, NOW, customer, invoice, project, tables, values

from cashtide.operators.imports import RAW_FIELDS
from cashtide.sources.writers import read_history, read_snapshot, write_snapshot
from cashtide.streaming.drop_folder import import_dropped_files


def test_files_are_imported_once(spark, tmp_path):
    T = tables(spark, customer=[customer(1)], project=[project(1, 35000), project(2, 2000)], invoice=[invoice(1, 1, 4000)])
    store, folder, state = str(tmp_path / "store"), tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    names = ["customer", "project", "invoice", "payment", "supplier", "purchase_order", "cost", "operational_cost"]
    write_snapshot({n: T[n] for n in names}, store, 0, NOW)
    header = ",".join(RAW_FIELDS) + "\n"

    def drop(name, *lines):
        (folder / name).write_text(header + "\n".join(lines) + "\n")

    def run():
        query = import_dropped_files(
            spark, str(folder), store, state, lambda b: DAY, lambda b: NOW + dt.timedelta(minutes=b)
        )
        query.awaitTermination()
        assert query.exception() is None

    drop("a.csv", "A-1,1,2026-03-01,2026-03-08,5000.00,Issued", "A-2,9,2026-03-01,2026-03-08,5000.00,Issued")
    run()
    drop("b.csv", "A-1,1,2026-03-01,2026-03-08,5000.00,Paid")
    run()
    run()
    now = read_snapshot(spark, store)
    assert values(now["etl_run"], "run_id", "source_filename", "status") == [(1, "a.csv", "Partial"), (2, "b.csv", "Succeeded")]
    assert values(now["invoice"], "invoice_number", "status") == [("A-1", "Paid"), ("N-0001", "Issued")]


def _store(spark, path, version):
    T = tables(spark, customer=[customer(1)], project=[project(1, 35000)], invoice=[invoice(1, 1, 4000)])
    names = ["customer", "project", "invoice", "payment", "supplier", "purchase_order", "cost", "operational_cost"]
    write_snapshot({n: T[n] for n in names}, path, version, NOW)


def _import(spark, folder, store, state):
    query = import_dropped_files(spark, str(folder), store, state, lambda v: DAY, lambda v: NOW + dt.timedelta(minutes=v))
    query.awaitTermination()


def test_files_count_by_path_whatever_the_versions_and_checkpoints(spark, tmp_path, monkeypatch):
    store, folder = str(tmp_path / "store"), tmp_path / "in"
    folder.mkdir()
    _store(spark, store, 1)  # a load under the number the first batch would have
    header = ",".join(RAW_FIELDS) + "\n"
    (folder / "a.csv").write_text(header + "A-1,1,2026-03-01,2026-03-08,5000.00,Issued\n")

    # A failure before the version is recorded leaves the file for the next run.
    import cashtide.streaming.drop_folder as module

    def fail(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(module, "write_snapshot", fail)
        with pytest.raises(StreamingQueryException):
            _import(spark, folder, store, str(tmp_path / "s1"))
    _import(spark, folder, store, str(tmp_path / "s1"))
    _import(spark, folder, store, str(tmp_path / "s2"))  # a fresh checkpoint over the store
    now = read_snapshot(spark, store)
    assert values(now["etl_run"], "run_id", "source_filename") == [(1, "a.csv")]
    assert {r.version for r in read_history(spark, store, "import_report").collect()} == {2}


def test_a_file_without_rows_fails(spark, tmp_path):
    store, folder = str(tmp_path / "store"), tmp_path / "in"
    folder.mkdir()
    _store(spark, store, 0)
    (folder / "a.csv").write_text(",".join(RAW_FIELDS) + "\n")
    with pytest.raises(StreamingQueryException, match="empty"):
        _import(spark, folder, store, str(tmp_path / "state"))
