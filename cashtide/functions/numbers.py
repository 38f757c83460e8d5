"""Parsing of ledger text into typed values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"


# The characters that count as white space around ledger fields.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _starts_printed(text: Column) -> Column:
    """Whether the first byte is an ASCII character that is printed, so no white space; false if empty."""
    return (text >= F.lit("!")) & (text < F.lit("\x7f"))


def trimmed(col: Column) -> Column:
    """Text without surrounding white space; a missing value counts as empty.

    Most text has none, which its ends tell for less than a search of the white space takes.
    """
    text = F.coalesce(col, F.lit(""))
    bare = _starts_printed(text) & _starts_printed(F.substring(text, -1, 1))
    return F.when(bare, text).otherwise(F.btrim(text, F.lit(WHITE_SPACE)))


def without_spaces(col: Column) -> Column:
    """Text without surrounding spaces only; a missing value counts as empty."""
    return F.btrim(F.coalesce(col, F.lit("")), F.lit(" "))


def german_decimal(col: Column) -> Column:
    """``1.234,56`` as money.  Dots are always thousands marks; empty is zero;
    text that is no number is null."""
    return trimmed_decimal(trimmed(col))


def trimmed_decimal(text: Column) -> Column:
    """The same of text that is trimmed already."""
    number = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(text == "", F.lit(0).cast(MONEY)).otherwise(number.try_cast(MONEY))


def ddmm_date(col: Column, year: int) -> Column:
    """A day and month (``105`` is 1 May) in the given year; null where empty or
    no such day exists."""
    return trimmed_date(trimmed(col), year)


def trimmed_date(text: Column, year: int) -> Column:
    """The same of text that is trimmed already."""
    digits = F.lpad(text, 4, "0")
    day = F.concat_ws("-", F.lit(f"{year:04d}"), F.substring(digits, 3, 2), F.substring(digits, 1, 2))
    return F.when((text != "") & digits.rlike(r"^[0-9]{4}\z"), day.try_cast("date"))


def document_number(col: Column, pattern: str = r"(\d+)") -> tuple[Column, Column]:
    """The number inside a document id as a sortable pair (digits, text).

    Comparing the count of significant digits and then the digits themselves
    orders numbers of any length exactly; an id without a number sorts first.
    """
    digits = F.regexp_extract(col, pattern, 1)
    significant = F.ltrim(digits, F.lit("0"))
    length = F.when(digits == "", F.lit(-1)).otherwise(F.length(significant))
    return length.cast("int"), significant


def date_key(col: Column) -> Column:
    """20260131 for 31 January 2026."""
    return (F.year(col) * 10000 + F.month(col) * 100 + F.day(col)).cast("int")
