"""Reading invoice batches, ledger exports and table snapshots."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cashtide.functions.numbers import without_spaces
from cashtide.operators.imports import RAW_FIELDS
from cashtide.schemas import TABLES
from cashtide.seeds import reference_domains
from cashtide.sources.numbering import file_splits, not_blank, number_lines, number_whole_files

# The ledger columns that are read, by their name in the file.
LEDGER_COLUMNS = {
    "konto": "Konto",
    "gegenkonto": "Gegenkonto (ohne BU-Schlüssel)",
    "soll_haben": "Soll-/Haben-Kennzeichen",
    "umsatz": "Umsatz",
    "belegdatum": "Belegdatum",
    "belegfeld1": "Belegfeld 1",
    "buchungstext": "Buchungstext",
    "vat": "Beleginfo-Inhalt 2",
    "name": "Beleginfo-Inhalt 3",
}


# A quote inside a quoted field is doubled; a backslash is a letter like any other.
DIALECT = {"quote": '"', "escape": '"'}


MOST_HEADERS = 100  # different first lines that are parsed and compared


def _headers(spark: SparkSession, splits: DataFrame, sep: str) -> list[tuple[str, list[str]]]:
    """The different first lines of files as fields, each with a file that has it.

    Files are compared where their lines were counted; only lines that differ come here.
    """
    first = splits.filter("_start = 0").groupBy("_head").agg(F.min("_path").alias("path"))
    found = first.orderBy("path").take(MOST_HEADERS + 1)
    if len(found) > MOST_HEADERS:
        raise ValueError(f"the files have more than {MOST_HEADERS} different headers")
    return [(r.path, _fields(spark, r["_head"], sep)) for r in found]


def _whole_headers(spark: SparkSession, path: str, sep: str) -> list[tuple[str, list[str]]]:
    """The same for files whose header may go on in the next line: one header per file."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("_n")
    )
    first = {r.path: r.value for r in lines.groupBy("path").agg(F.min_by("value", "_n").alias("value")).collect()}
    n = 1
    while unfinished := [p for p, text in first.items() if text.count('"') % 2]:
        # A quoted field goes on in the next line.
        n *= 16
        place = F.row_number().over(Window.partitionBy("path").orderBy("_n"))
        more = lines.filter(F.col("path").isin(unfinished)).withColumn("_place", place).filter(F.col("_place") <= n)
        found: dict[str, list[str]] = {}
        for r in more.orderBy("path", "_place").collect():
            found.setdefault(r.path, []).append(r.value)
        for file, values in found.items():
            ends = [i + 1 for i in range(len(values)) if "\n".join(values[: i + 1]).count('"') % 2 == 0]
            if not ends and len(values) < n:
                raise ValueError(f"a quoted field of the header does not end in {file}")
            first[file] = "\n".join(values[: ends[0]] if ends else values)
    parsed = {text: _fields(spark, text, sep) for text in set(first.values())}
    return [(file, parsed[text]) for file, text in first.items()]


def _fields(spark: SparkSession, header: str, sep: str) -> list[str]:
    """The fields of a header, however many, without blank ones at the end."""
    if not header.strip():
        return []
    options = {"sep": sep, **DIALECT}
    row = spark.range(1)
    width = len(spark.createDataFrame([], row.select(F.schema_of_csv(F.lit(header), options).alias("s")).first()[0]).columns)
    cells = ", ".join(f"c{i} string" for i in range(width))
    values = row.select(F.from_csv(F.lit(header), F.lit(cells), options).alias("h")).first()[0]
    fields = [(c or "").lstrip("\ufeff").strip() for c in values]
    while fields and not fields[-1]:
        fields.pop()
    return fields


def read_invoice_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """The six columns of a batch as text, with ``row_number``; the header is row 1.

    A header other than the six names in their order is an error, in any file of a folder.
    ``multi_line`` allows line breaks inside quoted fields; each file is one task then.
    """
    splits = None if multi_line else file_splits(spark, path)
    for file, header in _whole_headers(spark, path, sep) if multi_line else _headers(spark, splits, sep):
        if header != RAW_FIELDS:
            raise ValueError(f"expected the header {','.join(RAW_FIELDS)}, found {','.join(header)} in {file}")
    schema = ", ".join(f"{c} string" for c in RAW_FIELDS)
    rows = spark.read.options(**DIALECT).csv(
        path, schema=schema, header=True, sep=sep, enforceSchema=True, multiLine=multi_line
    )
    return number_whole_files(rows, "row_number", 2) if multi_line else number_lines(rows, splits, "row_number", 2)


def read_invoice_json(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row per element of a JSON array of records, numbered from 2 within it.

    Each of the six fields becomes text, a missing one becomes empty, unknown ones
    are ignored.  Numbers keep their digits.  A payload that is no array, or an
    empty one, is an error.
    """
    others = [c for c in payloads.columns if c != column]
    parsed = F.parse_json(F.col(column))
    shape = F.schema_of_variant(parsed)
    problem = (
        F.when(F.col(column).isNull() | ~F.startswith(shape, F.lit("ARRAY<")), F.lit("records must be a JSON array"))
        .when(F.regexp_replace(F.col(column), r"\s", "") == "[]", F.lit("records is empty"))
    )
    checked = payloads.withColumn(
        "_records", F.when(problem.isNotNull(), F.raise_error(problem).cast("variant")).otherwise(parsed)
    )
    elements = checked.lateralJoin(
        checked.sparkSession.tvf.variant_explode(F.col("_records").outer())
    )
    fields = [
        without_spaces(F.variant_get(F.col("value"), f"$.{c}", "string")).alias(c) for c in RAW_FIELDS
    ]
    return elements.select(*others, (F.col("pos") + 2).alias("row_number"), *fields)


def read_ledger_csv(
    spark: SparkSession, path: str, sep: str = ",", skip_lines: int = 0, multi_line: bool = False
) -> DataFrame:
    """The nine ledger columns as text under short names, with ``line``.

    Columns are found by their header; those the file lacks are null.  Postings are
    numbered from 2, the header being line 1.  ``skip_lines`` ignores that many
    lines before the header, for exports that start with a description line.
    ``multi_line`` allows line breaks inside quoted fields; each file is one task then.
    Files of a folder must have one header.
    """
    if skip_lines:
        if multi_line:
            raise ValueError("lines can't be skipped in files whose fields have line breaks")
        return _ledger_columns(_after_preamble(spark, path, sep, skip_lines), "line")
    splits = None if multi_line else file_splits(spark, path)
    headers = _whole_headers(spark, path, sep) if multi_line else _headers(spark, splits, sep)
    if len({tuple(h) for _, h in headers}) > 1:
        raise ValueError(f"the files of {path} have different headers")
    rows = spark.read.options(**DIALECT).csv(path, header=True, sep=sep, encoding="UTF-8", multiLine=multi_line)
    columns = [c.lstrip("\ufeff").strip() for c in rows.columns]
    numbered = number_whole_files(rows, "_line", 2) if multi_line else number_lines(rows, splits, "_line", 2)
    return _ledger_columns(numbered.toDF(*columns, "line"), "line").select("line", *LEDGER_COLUMNS)


def _ledger_columns(rows: DataFrame, *more: str) -> DataFrame:
    """The ledger columns under their short names, missing ones as nulls."""
    return rows.select(
        *more,
        *[
            (F.col(f"`{source}`") if source in rows.columns else F.lit(None).cast("string")).alias(name)
            for name, source in LEDGER_COLUMNS.items()
        ],
    )


def _after_preamble(spark: SparkSession, path: str, sep: str, skip_lines: int) -> DataFrame:
    """Rows of a CSV whose header is not on the first line."""
    numbered = number_lines(spark.read.text(path).filter(not_blank()), file_splits(spark, path), "_text_line", 1, header=False)
    header = numbered.filter(F.col("_text_line") == skip_lines + 1).select("value").first()[0]
    options = {"sep": sep, **DIALECT}
    names_schema = spark.range(1).select(F.schema_of_csv(F.lit(header), options).alias("s")).first()[0]
    width = len(spark.createDataFrame([], names_schema).columns)
    cells = ", ".join(f"_c{i} string" for i in range(width))
    names = spark.range(1).select(F.from_csv(F.lit(header), F.lit(cells), options).alias("h")).select("h.*").first()
    body = numbered.filter(F.col("_text_line") > skip_lines + 1).select(
        (F.col("_text_line") - skip_lines).alias("line"), F.from_csv(F.col("value"), F.lit(cells), options).alias("r")
    )
    return body.select("line", *[F.col(f"r._c{i}").alias(names[i].lstrip("\ufeff").strip()) for i in range(width)])


def load_tables(
    spark: SparkSession, directory: str, names: Iterable[str] | None = None, domains: bool = True
) -> dict[str, DataFrame]:
    """Table snapshots as ``<directory>/<table>`` with their declared types.

    Reference domains the directory does not name come from the built-in rows.
    """
    tables = reference_domains(spark) if domains else {}
    for name in names or [n for n in TABLES if not n.startswith("ref_")]:
        tables[name] = spark.read.schema(TABLES[name].struct).parquet(f"{directory.rstrip('/')}/{name}")
    return tables


def tables_of(frames: Mapping[str, DataFrame], spark: SparkSession) -> dict[str, DataFrame]:
    """Given frames together with the built-in reference domains."""
    return {**reference_domains(spark), **frames}
