"""Deterministic pseudonyms for names and addresses."""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.functions.hashing import digest_residue, pick, residue_pick

# The pools names and addresses are drawn from.
FIRST_NAMES = [
    "Andreas", "Birgit", "Christoph", "Daniela", "Erik", "Franziska", "Gerd", "Helena", "Ingo", "Johanna", "Klaus",
    "Lena", "Martin", "Nina", "Oliver", "Petra", "Rainer", "Sabine", "Thomas", "Ulrike", "Viktor", "Wiebke",
]
LAST_NAMES = [
    "Albrecht", "Böhm", "Christen", "Dietrich", "Engel", "Falk", "Gruber", "Hartmann", "Ihle", "Jansen", "Köhler",
    "Lindner", "Möller", "Naumann", "Ostermann", "Pfeiffer", "Reuter", "Sander", "Thiele", "Ulrich", "Vogt", "Werner",
]
COMPANY_TRADES = ["Energie", "Solar", "Technik", "Bau", "Handel"]
COMPANY_FORMS = ["GmbH", "GmbH & Co. KG", "e.K.", "AG", "UG (haftungsbeschränkt)"]
PLACES = [
    ("Köln", "50931"),
    ("Stuttgart", "70178"),
    ("Hannover", "30177"),
    ("Dresden", "01099"),
    ("Dortmund", "44139"),
    ("Freiburg", "79104"),
    ("Nürnberg", "90429"),
    ("Hamburg", "20259"),
    ("Leipzig", "04277"),
    ("Bremen", "28195"),
    ("Essen", "45127"),
    ("Bonn", "53111"),
]
STREETS = [
    "Ahornweg", "Birkenallee", "Comeniusstraße", "Domplatz", "Erlenkamp",
    "Feldstraße", "Goethering", "Hafenweg", "Isarstraße", "Jahnplatz",
]
COMPANY_PATTERN = r"(?U)\b(GmbH|AG|KG|e\.K\.|UG|Inc|Ltd|SE)\b"
HOUSE_NUMBERS = 180

CITIES = [city for city, _ in PLACES]
POSTAL_CODES = [code for _, code in PLACES]


# What is drawn from one digest: (pool, divisor) of each part.
COMPANY_PARTS = [(LAST_NAMES, 1), (COMPANY_TRADES, 7), (COMPANY_FORMS, 11)]
PERSON_PARTS = [(FIRST_NAMES, 1), (LAST_NAMES, 13)]
NAME_MODULUS = lcm(*[divisor * len(pool) for pool, divisor in COMPANY_PARTS + PERSON_PARTS])
STREET_DIVISOR = 7
ADDRESS_MODULUS = lcm(len(CITIES), STREET_DIVISOR * len(STREETS), HOUSE_NUMBERS)

_RESIDUE = "_residue"


def _drawn(parts) -> Column:
    return F.concat_ws(" ", *[pick(pool, residue_pick(F.col(_RESIDUE), divisor, len(pool))) for pool, divisor in parts])


def with_pseudonym(df: DataFrame, column: str, name: Column, kind: str, salt: str) -> DataFrame:
    """Set a column to the pseudonym of a name: always a company for
    ``kind='company'``, else a company only where the real name carries a legal form.

    The digest is taken once per row and all parts are drawn from its residue.
    """
    hashed = df.withColumn(_RESIDUE, digest_residue(F.concat(F.lit(salt + "|"), name), NAME_MODULUS))
    if kind == "company":
        drawn = F.when(name.isNotNull(), _drawn(COMPANY_PARTS))
    else:
        is_company = name.rlike(COMPANY_PATTERN)
        drawn = F.when(is_company, _drawn(COMPANY_PARTS)).when(name.isNotNull(), _drawn(PERSON_PARTS))
    return hashed.withColumn(column, drawn).drop(_RESIDUE)


def with_shown_name(
    df: DataFrame, column: str, name: Column, fallback: Column, kind: str, salt: str | None, keep_names: bool
) -> DataFrame:
    """Set a column to the name as it may leave the transform: real if allowed, else a
    pseudonym of the name, or of the account where there is no name."""
    if keep_names:
        return df.withColumn(column, name)
    if salt is None:
        raise ValueError("a salt is required unless keep_names is set")
    return with_pseudonym(df, column, F.coalesce(F.nullif(name, F.lit("")), fallback), kind, salt)


def with_address(df: DataFrame, key: Column) -> DataFrame:
    """Set street, house number, postal code and city as drawn from an account key."""
    residue = F.col(_RESIDUE)
    place = residue_pick(residue, 1, len(CITIES))
    address = {
        "street_name": pick(STREETS, residue_pick(residue, STREET_DIVISOR, len(STREETS))),
        "house_number": (residue_pick(residue, 1, HOUSE_NUMBERS) + 1).cast("string"),
        "postal_code": pick(POSTAL_CODES, place),
        "city": pick(CITIES, place),
    }
    return df.withColumn(_RESIDUE, digest_residue(key, ADDRESS_MODULUS)).withColumns(address).drop(_RESIDUE)


def transliterated(col: Column) -> Column:
    """German letters spelled with ASCII letters."""
    # Umlaut spellings.
    for letter, spelling in {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}.items():
        col = F.replace(col, F.lit(letter), F.lit(spelling))
    return col
