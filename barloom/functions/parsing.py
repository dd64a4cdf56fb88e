"""Lenient-in, strict-out conversions from provider text to typed columns.

Each returns NULL where the text does not convert, so a caller can tell a bad
value (text present, result NULL) from a missing one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted ISO date forms and the ticker forms, matched in full.
# A time may follow a date behind a T or white space; anything else may not.
ISO_EXTENDED = r"(?s)\A[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T\s].*)?\z"
ISO_BASIC = r"(?s)\A[0-9]{8}(?:[T\s].*)?\z"
TICKER = r"\A[A-Z0-9]{1,12}\z"
TICKER_ANY_CASE = r"\A[A-Za-z0-9]{1,12}\z"


def parse_number(text: Column, kind: T.DataType) -> Column:
    """Integer or decimal; ``25.0`` is not an integer, decimals round half up."""
    return text.try_cast(kind)


def parse_iso_date(text: Column) -> Column:
    """Date of an ISO date or date-time; NULL for text of any other form."""
    # The extended form is the one that a cast reads, without a formatter.
    return F.when(text.rlike(ISO_EXTENDED), F.substring(text, 1, 10).try_cast("date")).when(
        text.rlike(ISO_BASIC), F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd")
    )


def finite(value: Column) -> Column:
    """Double, or NULL for anything that is not a finite number."""
    number = value.try_cast("double")
    infinite = F.abs(number) == F.lit(float("inf"))
    return F.when(~(F.isnan(number) | infinite), number)


def strip(text: Column) -> Column:
    """Text without surrounding white space of any kind, not only blanks."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def clipped(text: Column, length: int) -> Column:
    """The first ``length`` characters; NULL for empty text."""
    return F.when(F.length(text) > 0, F.substring(text, 1, length))
