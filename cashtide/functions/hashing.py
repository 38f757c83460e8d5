"""Arithmetic on SHA-256 digests read as 256-bit integers.

A digest does not fit any Spark number, but ``(h div d) mod n`` only needs h modulo
a multiple of ``d * n``.  That residue is a sum over pieces of 60 bits, each reduced
and weighted by its place, so plain bigints do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGEST_DIGITS = 64
PIECE_DIGITS = 15


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def hex_number(digits: Column) -> Column:
    """At most 15 hex digits as a bigint."""
    return F.conv(digits, 16, 10).cast("bigint")


def digest_residue(text: Column, modulus: int) -> Column:
    """The digest of a text modulo a small number."""
    hashed = digest(text)
    total = F.lit(0).cast("bigint")
    for start in range(0, DIGEST_DIGITS, PIECE_DIGITS):
        size = min(PIECE_DIGITS, DIGEST_DIGITS - start)
        weight = pow(16, DIGEST_DIGITS - start - size, modulus)
        total = total + hex_number(F.substring(hashed, start + 1, size)) % F.lit(modulus) * F.lit(weight)
    return (total % F.lit(modulus)).cast("int")


def residue_pick(residue: Column, divisor: int, count: int) -> Column:
    """``(h div divisor) mod count`` from a residue modulo a multiple of both."""
    return F.floor(residue % F.lit(divisor * count) / F.lit(divisor)).cast("int")


def short_key(text: Column, hex_digits: int) -> Column:
    """A number from the first hex digits of a digest."""
    return hex_number(F.substring(digest(text), 1, hex_digits))


def pick(values: list[str], index: Column) -> Column:
    """The value at a 0-based index of a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)
