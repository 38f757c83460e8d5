"""Headers of the files of a folder are compared whole."""

import pytest

from cashtide.sources import readers

FIELDS = list(readers.LEDGER_COLUMNS.values())


def folder(tmp_path, *headers, row=None):
    for i, header in enumerate(headers):
        values = row or [f"v{k}" for k in range(len(header))]
        (tmp_path / f"{i}.csv").write_text(",".join(header) + "\n" + ",".join(values) + "\n", encoding="utf-8")
    return str(tmp_path)


@pytest.mark.parametrize("multi_line", [False, True])
def test_columns_beyond_the_64th(spark, tmp_path, multi_line):
    wide = [f"x{i}" for i in range(70)]
    path = folder(tmp_path, [*wide, "Konto", "Umsatz"], [*wide, "Umsatz", "Konto"])
    with pytest.raises(ValueError, match="different headers"):
        readers.read_ledger_csv(spark, path, multi_line=multi_line)


def test_place_of_a_blank_header_cell(spark, tmp_path):
    path = folder(tmp_path, ["Konto", "", "Umsatz"], ["", "Konto", "Umsatz"])
    with pytest.raises(ValueError, match="different headers"):
        readers.read_ledger_csv(spark, path)


def test_equal_wide_headers(spark, tmp_path):
    header = [*[f"x{i}" for i in range(70)], "", "Konto", "Umsatz"]
    rows = readers.read_ledger_csv(spark, folder(tmp_path, header, header)).collect()
    assert [(r.konto, r.umsatz) for r in rows] == [("v71", "v72")] * 2


def test_line_break_in_a_header(spark, tmp_path):
    same = ['"a\nb"', "Konto", "Umsatz"]
    path = folder(tmp_path, same, ['"a\nb"', "Umsatz", "Konto"])
    with pytest.raises(ValueError, match="different headers"):
        readers.read_ledger_csv(spark, path, multi_line=True)
