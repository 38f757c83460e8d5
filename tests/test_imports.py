"""Invoice batches in the shape of a weekly export, with our own rows."""

import json

import pytest
from pyspark.errors import PySparkException
from tables import DAY, NOW, customer, invoice, money, project, tables, values

from cashtide.operators import imports
from cashtide.operators.views import view_cashflow_30day, view_etl_rejections
from cashtide.sources.readers import read_invoice_csv, read_invoice_json

HEADER = "invoice_number,project_id,invoice_date,due_date,amount,status\n"
CLEAN = [
    "K-100,1,2026-03-01,2026-03-08,19250.00,Issued",
    "K-101,2,2026-03-02,2026-03-09,7560.50,Issued",
    "K-102,3,2026-03-03,2026-03-10,2400.00,Paid",
]
BROKEN = [
    "K-103,1,2026-03-04,2026-03-11,5000.00,Issued",
    "K-104,77,2026-03-04,2026-03-11,5000.00,Issued",
    "K-105,1,04-03-2026,2026-03-11,4300.00,Issued",
    "K-106,2,2026-03-04,2026-03-11,-500.00,Issued",
    "K-107,2,2026-03-04,2026-03-11,8800.00,Draft",
]


def start(spark):
    return tables(
        spark,
        customer=[customer(1)],
        project=[project(1, 35000), project(2, 14000), project(3, 2400), project(4, 31000)],
        invoice=[invoice(1, 1, 4000, -20, number="K-001"), invoice(2, 4, 9000, -5, "Overdue", number="K-002")],
    )


def batch(spark, tmp_path, lines, name="batch.csv"):
    path = tmp_path / name
    path.write_text(HEADER + "\n".join(lines) + "\n")
    return read_invoice_csv(spark, str(path))


def report_of(T):
    return json.loads("".join(r.text for r in T["report"].collect()))


def test_clean_batch(spark, tmp_path):
    T = imports.import_run(start(spark), batch(spark, tmp_path, CLEAN), DAY, NOW, "clean.csv", "anna")
    report = report_of(T)
    assert (report["status"], report["rowsReceived"], report["upsertedCount"], report["rejectedCount"]) == ("Succeeded", 3, 3, 0)
    assert report["rejections"] == [] and report["sourceFile"] == "clean.csv" and report["runId"] == 1
    assert report["kpi"]["outstanding_receivables"] == 4000 + 9000 + 19250 + 7560.5
    ids = dict(values(T["invoice"], "invoice_number", "invoice_id"))
    assert len(set(ids.values())) == 5 and ids["K-001"] == 1
    codes = dict(values(T["invoice"], "invoice_number", "milestone_code"))
    assert codes["K-100"] == "STAGE_2_COMMISSIONING" and codes["K-102"] == "SINGLE_PAYMENT"
    assert set(values(T["invoice"].filter("invoice_id > 2"), "created_by", "created_at")) == {("etl:sevdesk", NOW)}
    assert values(T["stg_sevdesk_invoice"], "row_number", "promoted_at") == [(2, NOW), (3, NOW), (4, NOW)]


def test_broken_rows_do_not_sink_the_batch(spark, tmp_path):
    T = imports.import_run(start(spark), batch(spark, tmp_path, BROKEN), DAY, NOW)
    report = report_of(T)
    assert (report["status"], report["upsertedCount"], report["rejectedCount"]) == ("Partial", 1, 4)
    assert report["rejections"] == [
        {"row": 3, "invoiceNumber": "K-104", "reason": "project_id 77 does not exist"},
        {"row": 4, "invoiceNumber": "K-105", "reason": "invoice_date is not YYYY-MM-DD: 04-03-2026"},
        {"row": 5, "invoiceNumber": "K-106", "reason": "amount is not a positive decimal: -500.00"},
        {"row": 6, "invoiceNumber": "K-107", "reason": "unknown invoice status: Draft"},
    ]
    assert T["invoice"].count() == 3
    assert view_etl_rejections(T).count() == 4


def test_the_same_batch_twice(spark, tmp_path):
    rows = batch(spark, tmp_path, CLEAN)
    once = imports.import_run(start(spark), rows, DAY, NOW)
    twice = imports.import_run({k: v for k, v in once.items() if k != "report"}, rows, DAY, NOW)
    columns = [c for c in once["invoice"].columns if c != "updated_at"]
    assert values(twice["invoice"], *columns) == values(once["invoice"], *columns)
    assert values(twice["etl_run"], "run_id", "status") == [(1, "Succeeded"), (2, "Succeeded")]
    assert twice["stg_sevdesk_invoice"].count() == 6


def test_threshold_batch(spark, tmp_path):
    T = start(spark)
    T["invoice"] = T["invoice"].filter("invoice_number = 'K-001'")
    lines = [
        "K-200,1,2026-03-05,2026-03-12,15750.00,Issued",
        "K-201,1,2026-03-06,2026-03-13,480.00,Issued",
        "K-202,3,2026-03-07,2026-03-14,2400.00,Issued",
        "K-203,4,2026-03-07,2026-03-14,2890.00,Issued",
    ]
    done = imports.import_run(T, batch(spark, tmp_path, lines), DAY, NOW)
    codes = dict(values(done["invoice"], "invoice_number", "milestone_code"))
    assert codes == {
        "K-001": "STAGE_1_ROOF", "K-200": "STAGE_2_COMMISSIONING", "K-201": "ADJUSTMENT",
        "K-202": "SINGLE_PAYMENT", "K-203": "ADJUSTMENT",
    }


def test_only_a_paid_link_moves_the_forecast(spark, tmp_path):
    T = start(spark)
    base = imports.import_run(T, batch(spark, tmp_path, ["K-001,1,2026-02-18,2026-02-25,4000.00,Issued"]), DAY, NOW)
    issued = imports.import_run(T, batch(spark, tmp_path, CLEAN[:2], "b.csv"), DAY, NOW)
    paid = imports.import_run(T, batch(spark, tmp_path, CLEAN, "c.csv"), DAY, NOW)
    lines = [values(view_cashflow_30day(x, DAY), "full_date", "cumulative_position") for x in (base, issued, paid)]
    assert lines[0] == lines[1] and lines[1] != lines[2]


CASES = [
    ("", "1", "2026-03-01", "2026-03-02", "1", "Issued", "invoice_number is empty"),
    ("A", "", "2026-03-01", "2026-03-02", "1", "Issued", "project_id is not a whole number: "),
    ("A", "1x", "2026-03-01", "2026-03-02", "1", "Issued", "project_id is not a whole number: 1x"),
    ("A", "99999999999999999999", "2026-03-01", "2026-03-02", "1", "Issued", "project_id is not a whole number: 99999999999999999999"),
    ("A", "5", "2026-03-01", "2026-03-02", "1", "Issued", "project_id 5 does not exist"),
    ("A", "1", "2026-3-1", "2026-03-02", "1", "Issued", "invoice_date is not YYYY-MM-DD: 2026-3-1"),
    ("A", "1", "2026-02-30", "2026-03-02", "1", "Issued", "invoice_date is not YYYY-MM-DD: 2026-02-30"),
    ("A", "1", "2026-03-01\n", "2026-03-02", "1", "Issued", "invoice_date is not YYYY-MM-DD: 2026-03-01\n"),
    ("A", "1", "2026-03-01", "soon", "1", "Issued", "due_date is not YYYY-MM-DD: soon"),
    ("A", "1", "2026-03-02", "2026-03-01", "1", "Issued", "due_date is before invoice_date"),
    ("A", "1", "2026-03-02", "2026-03-02", "1.234", "Issued", "amount is not a positive decimal: 1.234"),
    ("A", "1", "2026-03-02", "2026-03-02", "12345678901", "Issued", "amount is not a positive decimal: 12345678901"),
    ("A", "1", "2026-03-02", "2026-03-02", "1", "issued", "unknown invoice status: issued"),
    ("A", "1", "2026-03-02", "2026-03-02", "0", "Issued", None),
    ("A", "01", "2026-03-02", "2026-03-02", "0.5", "Paid", None),
    (None, None, None, None, None, None, "invoice_number is empty"),
    ("A", None, None, None, None, None, "project_id is not a whole number: "),
]


def test_first_failing_check_gives_the_reason(spark):
    T = tables(spark, project=[project(1, 5000)])
    schema = "row_number int, " + ", ".join(f"{c} string" for c in imports.RAW_FIELDS)
    raw = spark.createDataFrame([(i, *case[:6]) for i, case in enumerate(CASES)], schema)
    checked = imports.import_validate(imports.import_stage(raw, 1), T["project"], T["ref_invoice_status"])
    got = {r.row_number: (r.is_valid, r.rejection_reason) for r in checked.collect()}
    assert got == {i: (case[6] is None, case[6]) for i, case in enumerate(CASES)}


def test_number_twice_in_a_batch(spark, tmp_path):
    rows = batch(spark, tmp_path, [CLEAN[0], CLEAN[0].replace("19250.00", "20000.00")])
    with pytest.raises(imports.ImportFailed) as failure:
        imports.import_run(start(spark), rows, DAY, NOW, "double.csv")
    run = failure.value.run.first()
    assert run.status == "Failed" and "K-100" in run.error_message and run.rows_received == 2
    done = imports.import_run(start(spark), rows, DAY, NOW, on_duplicate="last")
    assert dict(values(done["invoice"], "invoice_number", "amount"))["K-100"] == money(20000)


def test_empty_batch_and_wrong_header(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        imports.import_run(start(spark), batch(spark, tmp_path, []), DAY, NOW)
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        read_invoice_csv(spark, str(tmp_path / "x.csv"))


def test_json_batch(spark):
    payload = json.dumps([{"invoice_number": " J-1 ", "project_id": 1, "amount": 12345678.9, "extra": [1]}, {"status": None}])
    rows = read_invoice_json(spark.createDataFrame([(payload,)], "payload string")).collect()
    assert [(r.row_number, r.invoice_number, r.project_id, r.amount, r.status) for r in rows] == [
        (2, "J-1", "1", "12345678.9", ""), (3, "", "", "", ""),
    ]
    for bad in ('{"invoice_number": "x"}', "[]", "[ ]", "3", None):
        with pytest.raises(PySparkException, match="records"):
            read_invoice_json(spark.createDataFrame([(bad,)], "payload string")).collect()


def test_report_text_is_escaped(spark, tmp_path):
    lines = ['"K ""x"" \\",1,2026-03-01,2026-03-02,1.00,"no ""such"" status"']
    T = imports.import_run(start(spark), batch(spark, tmp_path, lines), DAY, NOW, 'we"ird.csv')
    report = report_of(T)
    assert report["status"] == "Failed" and report["sourceFile"] == 'we"ird.csv'
