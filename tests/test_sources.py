"""Files in and out."""

import csv
import datetime as dt
import re

import pytest
from tables import NOW, customer, project, tables, values

from cashtide.operators import audit, ledger, mutate
from cashtide.schemas import TABLES
from cashtide.seeds import local_table
from cashtide.sources import readers, writers

FIELDS = list(readers.LEDGER_COLUMNS.values())


def ledger_file(path, rows, sep=",", preamble=None, encoding="utf-8-sig"):
    with open(path, "w", encoding=encoding, newline="") as f:
        if preamble:
            f.write(preamble + "\n")
        out = csv.writer(f, delimiter=sep)
        out.writerow(FIELDS + ["Unused"])
        out.writerows([*r, "x"] for r in rows)
    return str(path)


ROWS = [
    # account, contra, flag, amount, day, document, text, vat, name
    ["4400", "10001", "H", "1.234,56", "105", "R-1", "Sale", "19", "Solar, Dach GmbH"],
    ["4400", " 10001 ", "S", "1.234,56", "3112", "R-2", "Credit", "", ""],
    ["1800", "10002", "H", "50,00", "0203", "R-9", "Zahlung zu R-9 von Frau Beispiel mit sehr langem Text", "", ""],
    ["5400", "70001", "S", "", "0203", "E-1", "Goods", "", ""],
    ["5500", "70001", "S", "7", "0203", "E-2", "Wages", "", "Late Name"],
    ["6020", "70002", "S", "abc", "3002", "E-3", "Rent", "", "Landlord"],
    ["1800", "70001", "S", "1,50", "", "E-4", "Paid", "", ""],
    ["1800", "1200", "S", "1,50", "0101", "X", "Move", "", ""],
    ["4400", "x", "H", "1,50", "0101", "X", "Odd", "", ""],
    ["4400", "99999", "H", "1,50", "0101", "X", "Odd", "", ""],
]


@pytest.fixture()
def raw(spark, tmp_path):
    return readers.read_ledger_csv(spark, ledger_file(tmp_path / "l.csv", ROWS))


def test_ledger_file(raw):
    rows = sorted(raw.collect(), key=lambda r: r.line)
    assert [r.line for r in rows] == list(range(2, 12))
    assert rows[0].konto == "4400" and rows[0].name == "Solar, Dach GmbH" and rows[0].vat == "19"


def test_ledger_file_with_description_line(spark, tmp_path):
    path = ledger_file(tmp_path / "m.csv", ROWS[:3], ";", '"EXTF";700;"Stapel"')
    rows = sorted(readers.read_ledger_csv(spark, path, ";", 1).collect(), key=lambda r: r.line)
    assert [(r.line, r.konto, r.name) for r in rows] == [(2, "4400", "Solar, Dach GmbH"), (3, "4400", None), (4, "1800", None)]


def test_parse_and_classify(raw):
    rows = {r.line: r for r in ledger.ledger_classify(ledger.ledger_parse(raw, 2026)).collect()}
    assert [rows[i].posting_class for i in range(2, 12)] == [
        "revenue", "revenue", "customer_payment", "expense", "expense", "expense", "supplier_payment", "skipped", "skipped", "skipped"]
    assert str(rows[2].amount) == "1234.56" and rows[2].date == dt.date(2026, 5, 1) and rows[3].geg == "10001"
    assert str(rows[5].amount) == "0.00" and not rows[5].quarantined
    assert rows[7].amount is None and rows[7].quarantined and rows[7].date is None and rows[8].date is None


def test_white_space_of_any_kind_is_trimmed(spark):
    from cashtide.functions import numbers
    from pyspark.sql import functions as F

    ends = ["", *numbers.WHITE_SPACE, "\x00", "\x7f", "!", "~", "é", "日", "  \t"]
    texts = [None, *[a + b + c for a in ends for b in ("", "x", "a b", "ö\u2003ö") for c in ends]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(values(df.select("i", numbers.trimmed(F.col("t")).alias("t")), "i", "t"))
    assert got == {i: (t or "").strip(numbers.WHITE_SPACE) for i, t in enumerate(texts)}


def test_numbers_of_documents_lose_leading_zeros_only(spark):
    from cashtide.functions.numbers import document_number
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("RE-0010",), ("000",), ("x",), (None,), ("7-008",)], "doc string")
    assert values(df.select(*[c.alias(n) for n, c in zip("lt", document_number(F.col("doc")))]), "l", "t") == [
        (-1, ""), (0, ""), (1, "7"), (2, "10"), (None, None)]


def test_each_field_is_trimmed_once_and_memos_are_drawn_after_the_sort(spark, raw):
    """A sort reads its rows twice, so what it need not order by is left for after it."""
    parsed = ledger.ledger_parse(raw, 2026)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\btrim\(", plan)) == len(FIELDS)
    classified = ledger.ledger_stored(ledger.ledger_classify(parsed))
    for out in (ledger.ledger_costs_out(classified, "s"), ledger.ledger_supplier_payments_out(classified, "s")):
        above, below = out._jdf.queryExecution().optimizedPlan().toString().split("Sort [", 1)
        assert "sha2" in above and "sha2" not in below


def test_plain_decimal_point_is_a_thousands_mark(spark):
    df = spark.createDataFrame([("1234.56",), ("-5,10",), ("1.000.000,00",)], "umsatz string")
    from cashtide.functions.numbers import german_decimal
    from pyspark.sql import functions as F

    assert sorted(str(r[0]) for r in df.select(german_decimal(F.col("umsatz"))).collect()) == ["-5.10", "1000000.00", "123456.00"]


def test_transform(raw):
    out = ledger.ledger_transform(raw, 2026, keep_names=True)
    assert values(out["customers"], "debtor_account", "first_name", "last_name", "company_name", "email") == [
        ("10001", "Kontakt", "Solar,", "Solar, Dach GmbH", "kontakt.solar,@example.de"),
        ("10002", "Zahlung", "seh", "", "zahlung.seh@example.de"),
    ]
    assert values(out["suppliers"], "creditor_account", "supplier_name", "contact_email") == [
        ("70001", "Goods", "orders@goods.de"), ("70002", "Landlord", "orders@landlord.de")]
    assert values(out["costs"], "skr04_account", "cost_category", "overhead_category") == [
        ("5400", "Direct Project", ""), ("5500", "Operational Overhead", "Software License"), ("6020", "Operational Overhead", "Rent")]
    assert values(out["invoices_for_pipeline"], "invoice_number", "project_id", "status") == []
    assert values(out["unmatched_payments"], "doc") == [("R-9",)]
    figures = {k: str(v) for k, v in values(out["report"], "metric", "value")}
    assert figures["credit_notes_matched"] == "1.00" and figures["gross_revenue"] == "1234.56" and figures["net_revenue"] == "0.00"
    assert [r.metric for r in out["report"].collect()] == ledger.REPORT_LINES
    lines = [(r.section, r.text) for r in out["transform_report"].collect()]
    assert lines == [
        (1, "classified 10 postings: 2 revenue, 1 customer payments, 3 expenses, 1 supplier payments, 3 internal/GL movements"),
        (2, "storno: credit note R-2 reverses R-1 EUR 1,234.56 on debtor 10001"),
        (3, "2 revenue postings -> 0 live invoices (1 reversed in-period, 0 credit notes against earlier periods)"),
        (4, "payment references an invoice not in this period (billed earlier): R-9"),
        (5, "gross credited revenue EUR 1,234.56 -> net of storno EUR 0.00"),
        (6, "customers 2, suppliers 2, invoices 0, customer payments 1, supplier payments 1, cost postings 3"),
    ]


def test_names_need_a_salt(raw):
    with pytest.raises(ValueError, match="salt"):
        ledger.ledger_transform(raw, 2026)


def test_csv_outputs(spark, raw, tmp_path):
    out = ledger.ledger_transform(raw, 2026, salt="s")
    writers.write_csv_outputs({"supplier_payments": out["supplier_payments"], "customers": out["customers"]}, str(tmp_path / "o"))
    text = "".join(p.read_text() for p in (tmp_path / "o" / "supplier_payments").glob("part-*"))
    header, row = text.strip().split("\n")
    writers.write_text_lines(out["transform_report"], str(tmp_path / "o" / "transform_report"))
    report = "".join(p.read_text() for p in sorted((tmp_path / "o" / "transform_report").glob("part-*")))
    assert report.startswith("classified 10 postings") and report.count("\n") == 6
    assert header == "creditor_account,payment_date,amount,memo" and row.startswith("70001,,1.50,")


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    for part in range(3):
        body = "".join(f"K-{part}-{i:05d},1,2026-03-01,2026-03-02,1.00,Issued\n" for i in range(400))
        (tmp_path / f"part-{part}.csv").write_text("invoice_number,project_id,invoice_date,due_date,amount,status\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        rows = readers.read_invoice_csv(spark, str(tmp_path)).select("invoice_number", "row_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [f"K-{part}-{i:05d}" for part in range(3) for i in range(400)]
    assert {r.invoice_number: r.row_number for r in rows} == {n: i + 2 for i, n in enumerate(want)}


def test_tables_and_versions(spark, tmp_path):
    T = tables(spark, customer=[customer(1)], project=[project(1, 5)])
    root = str(tmp_path / "store")
    writers.write_snapshot({"project": T["project"], "customer": T["customer"]}, root, 1, NOW)
    writers.write_snapshot({"project": T["project"].unionByName(local_table(spark, "project", [project(2, 6)]))}, root, 2, NOW)
    now = writers.read_snapshot(spark, root)
    assert (now["project"].count(), now["customer"].count()) == (2, 1)
    T["project"].write.parquet(str(tmp_path / "flat" / "project"))
    loaded = readers.load_tables(spark, str(tmp_path / "flat"), ["project"])
    assert loaded["project"].schema == TABLES["project"].struct and loaded["ref_order_status"].count() == 3
    assert writers.read_snapshot(spark, str(tmp_path / "none")) == {}
    with pytest.raises(ValueError, match="already recorded"):
        writers.write_snapshot({"project": T["project"]}, root, 2, NOW)


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    incoming = spark.createDataFrame([(2, "B", 20), (3, "C", 30)], "k int, v string, n int")
    for small in (False, True):
        assert values(mutate.upsert(target, incoming, ["k"], ["v"], small_batch=small), "k", "v", "n") == [
            (1, "a", 1), (2, "B", 2), (3, "C", 30)]
    assert values(mutate.upsert(target, incoming, ["k"], insert_only=True), "k", "v", "n") == [(1, "a", 1), (2, "b", 2), (3, "C", 30)]
    twice = incoming.unionByName(incoming.withColumn("n", incoming.n + 1))
    for small in (False, True):
        with pytest.raises(Exception, match="more than once"):
            mutate.upsert(target, twice, ["k"], ["v"], small_batch=small).collect()
        last = mutate.upsert(target, twice, ["k"], ["n"], on_duplicate="last", order="n", small_batch=small)
        assert values(last, "k", "n") == [(1, 1), (2, 21), (3, 31)]


def test_duplicate_check_survives_column_pruning(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    twice = spark.createDataFrame([(2, "x"), (2, "y")], "k int, v string")
    with pytest.raises(Exception, match="more than once"):
        mutate.upsert(target, twice, ["k"], ["v"]).select("v").collect()


def test_update_where_distinct_compares_nulls(spark):
    target = spark.createDataFrame([(1, None, None), (2, "b", None), (3, "c", None), (4, "d", None)], "k int, v string, updated_at timestamp")
    source = spark.createDataFrame([(1, "x"), (2, None), (3, "c")], "k int, v string")
    got = mutate.update_where_distinct(target, source, ["k"], "v", NOW)
    assert values(got, "k", "v", "updated_at") == [(1, "x", NOW), (2, None, NOW), (3, "c", None), (4, "d", None)]


def test_audits(spark):
    T = tables(
        spark,
        customer=[customer(1), customer(2, email="c1@example.invalid", house_number="1" * 21)],
        project=[project(1, 5), project(1, 6), project(3, -1, customer=9), project(4, 1, status="Lost")],
        project_cost=[{"cost_id": 1, "project_id": 1, "direct_cost_type": "Labor", "cost_category": "Operational Overhead"}],
    )
    found = {(r.table_name, r.kind, r.rule): r.offenders for r in audit.audit_tables(T).collect()}
    assert found[("customer", "key", "email")] == 1
    assert found[("customer", "check", "house_number_length")] == 1
    assert found[("project", "key", "project_id")] == 1
    assert found[("project", "reference", "customer_id -> customer")] == 1
    assert found[("project", "reference", "status -> ref_project_status")] == 1
    assert found[("project", "check", "total_value_not_negative")] == 1
    assert found[("project", "dependency", "project_id -> rest")] == 1
    assert found[("project_cost", "check", "discriminator")] == 1
    assert found[("project_cost", "reference", "cost_id, cost_category -> cost")] == 1
    assert ("project", "check", "expected_completion_date_required") not in found


def test_model_size():
    assert len(TABLES) == 31
    assert sum(len(t.columns) for t in TABLES.values()) == 206
    assert sum(len(t.unique_keys) for t in TABLES.values()) == 14
    assert sum(len(t.references) for t in TABLES.values()) == 29
    assert sum(len(t.checks) for t in TABLES.values()) == 22
    assert sum(len(t.functional_dependencies) for t in TABLES.values()) == 45


TRICKY = ['Dach "Sued" neu', 'ends in \\', 'a, "b" c', '""', "plain", 'tab\there']


def test_quoted_fields_read_as_a_standard_reader_does(spark, tmp_path):
    rows = [["4400", "10001", "H", "1,00", "0101", f"R-{i}", text, "19", text] for i, text in enumerate(TRICKY)]
    path = ledger_file(tmp_path / "l.csv", rows)
    with open(path, encoding="utf-8-sig", newline="") as f:
        want = [(r[5], r[6].strip(), r[8].strip()) for r in list(csv.reader(f))[1:]]
    found = readers.read_ledger_csv(spark, path).select("belegfeld1", "buchungstext", "name").collect()
    assert [(a, b.strip(), c.strip()) for a, b, c in found] == want


def test_line_breaks_inside_fields_need_the_option(spark, tmp_path):
    rows = [["4400", "10001", "H", "1,00", "0101", "R-1", "two\nlines", "19", "x"], ROWS[0]]
    path = ledger_file(tmp_path / "l.csv", rows)
    found = readers.read_ledger_csv(spark, path, multi_line=True).orderBy("line").collect()
    assert [(r.line, r.buchungstext) for r in found] == [(2, "two\nlines"), (3, "Sale")]


def test_every_file_of_a_folder_has_its_header_checked(spark, tmp_path):
    good = ",".join(readers.RAW_FIELDS)
    other = ",".join(readers.RAW_FIELDS[::-1])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(good + "\nA,1,2026-01-01,2026-01-02,1.00,Paid\n")
    (tmp_path / "in" / "b.csv").write_text(other + "\nPaid,1.00,2026-01-02,2026-01-01,1,B\n")
    with pytest.raises(ValueError, match="b.csv"):
        readers.read_invoice_csv(spark, str(tmp_path / "in"))


def test_written_quotes_are_doubled(spark, tmp_path):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "n int, text string")
    writers.write_csv_outputs({"out": frame.orderBy("n").coalesce(1)}, str(tmp_path))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    with open(part, newline="") as f:
        back = list(csv.reader(f))
    assert back[0] == ["n", "text"] and [r[1] for r in back[1:]] == TRICKY
