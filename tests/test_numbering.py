"""Line numbers over many splits, without a copy of the files."""

import random

import pytest
from pyspark.errors import PySparkException

from cashtide.operators.imports import RAW_FIELDS
from cashtide.sources import numbering, readers

HEADER = ",".join(RAW_FIELDS)


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "64"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def write_folder(tmp_path, draw, files):
    """Files of some lines, with blank lines anywhere; the lines in the order of the files."""
    expected = []
    for k in range(files):
        lines = [f"K-{k}-{i}{'x' * draw.randint(0, 60)},1,2026-03-01,2026-03-08,1.00,Issued" for i in range(draw.choice([0, 1, 30, 90]))]
        text = [HEADER, *lines]
        for _ in range(draw.randint(0, 6)):
            text.insert(draw.randint(0, len(text)), draw.choice(["", "   ", "\t"]))
        (tmp_path / f"{k:03d}.csv").write_text("\n".join(text) + draw.choice(["", "\n"]))
        expected += [x.split(",")[0] for x in lines]
    return expected


def test_numbers_over_many_splits(spark, tmp_path, small_splits):
    expected = write_folder(tmp_path, random.Random(4), 12)
    rows = readers.read_invoice_csv(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 12
    got = sorted((r.row_number, r.invoice_number) for r in rows.collect())
    assert got == [(i + 2, number) for i, number in enumerate(expected)]


def test_the_files_are_not_stored(spark, tmp_path, monkeypatch):
    write_folder(tmp_path, random.Random(5), 3)
    stored = []
    real = numbering.materialise
    monkeypatch.setattr(numbering, "materialise", lambda df: (stored.append(df.columns), real(df))[1])
    rows = readers.read_invoice_csv(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "SortMergeJoin" not in plan
    assert all("invoice_number" not in columns for columns in stored) and len(stored) == 2


def test_files_that_are_cut_otherwise_are_refused(spark, tmp_path, small_splits):
    write_folder(tmp_path, random.Random(6), 6)
    rows = readers.read_invoice_csv(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "90")
    with pytest.raises(PySparkException, match="cut otherwise"):
        rows.collect()


def test_a_differing_file_among_many(spark, tmp_path):
    write_folder(tmp_path, random.Random(7), 5)
    (tmp_path / "900.csv").write_text(HEADER.replace("amount", "total") + "\n")
    with pytest.raises(ValueError, match="900.csv"):
        readers.read_invoice_csv(spark, str(tmp_path))
