"""Strict reading of event bodies: a missing or malformed number is an error and never 0.

A body is parsed once per row, by ``parsed``, into a struct of strings; the other functions read its fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wideint import fail

BODY = "_body"


def structure(*paths: str) -> Column:
    """The fields of a body, all as text, in a struct; other fields are not read."""
    tree: dict = {}
    for path in paths:
        outer, _, inner = path.partition(".")
        tree.setdefault(outer, []).append(inner)
    kinds = [f"{name} " + (f"struct<{', '.join(f'{x}: string' for x in dict.fromkeys(inner))}>" if inner[0] else "string") for name, inner in tree.items()]
    return F.from_json("body", ", ".join(kinds))


def parsed(ledger: DataFrame, *paths: str) -> DataFrame:
    """The ledger with the fields of its bodies in a struct column."""
    return ledger.withColumn(BODY, structure(*paths))


def text(path: str) -> Column:
    return F.col(f"{BODY}.{path}")


#: Digits of an amount: 256 bits.
MOST_DIGITS = 78
INTEGER, UNSIGNED, ID = f"^-?[0-9]{{1,{MOST_DIGITS}}}$", f"^[0-9]{{1,{MOST_DIGITS}}}$", "^[0-9]{1,18}$"
BOOLEAN, ANY = "^(true|false)$", "(?s)^.*$"


def _strict(path: str, pattern: str) -> Column:
    t = f"{BODY}.{path}"
    return F.expr(f"CASE WHEN {t} RLIKE '{pattern}' THEN {t} ELSE CAST(raise_error('missing, malformed or out of range: {path}') AS string) END")


def integer(path: str) -> Column:
    """The digits of a signed integer of up to 256 bits."""
    return _strict(path, INTEGER)


def unsigned(path: str) -> Column:
    """The digits of an unsigned integer of up to 256 bits."""
    return _strict(path, UNSIGNED)


def minus(digits: Column) -> Column:
    """The negative of unsigned digits."""
    return F.concat(F.lit("-"), digits)


def small(path: str, most: int) -> Column:
    """An unsigned integer up to ``most``."""
    x = _strict(path, ID).cast("long")
    return F.when(x > most, fail(f"{path} out of range", "long")).otherwise(x)


def whole(path: str) -> Column:
    """An id: an integer of 64 bits that is not negative."""
    x = F.coalesce(text(path).cast("long"), fail(f"missing {path}", "long"))
    return F.when(F.startswith(text(path), F.lit("-")), fail(f"{path} out of range", "long")).otherwise(x)


def boolean(path: str) -> Column:
    t = text(path)
    return F.when(t.isin("true", "false"), t == "true").otherwise(F.raise_error(F.lit(f"missing {path}")).cast("boolean"))


def address(path: str) -> Column:
    return F.coalesce(F.lower(text(path)), F.raise_error(F.lit(f"missing {path}")).cast("string"))
