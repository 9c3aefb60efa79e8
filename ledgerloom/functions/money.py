"""Money written as text, and as decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(18,2)"


def to_decimal(c: Column) -> Column:
    """A decimal from text such as ``$1,234.50`` or ``(200)`` (negative); null where there is none."""
    bare = F.regexp_replace(c, r"[$,\s]", "")
    return F.regexp_replace(bare, r"^\((.*)\)$", "-$1").try_cast(DECIMAL)


def plain_decimal(c: Column) -> Column:
    return F.regexp_replace(c, "[$,]", "").try_cast(DECIMAL)


def digits_value(c: Column) -> Column:
    """The number that digits and points alone give."""
    return F.nullif(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9.]", ""), F.lit("")).try_cast("double")


def coerce(c: Column) -> Column:
    """``$`` amounts stay, bare digits get a ``$``; anything else is an error (null)."""
    return F.when(c.rlike(r"^\$[\d,]+(\.\d{2})?$"), c).when(c.rlike(r"^\d+$"), F.concat(F.lit("$"), c))


def first_amount(c: Column) -> Column:
    """The first amount with a ``$``, else the first bare number, without commas."""
    found = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (r"\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)", r"\b(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\b")]
    return F.coalesce(F.regexp_replace(F.coalesce(*found), ",", ""), F.lit(""))


def field_amount(c: Column) -> Column:
    """Digits, points and commas of a labelled amount; zeros and nothing are missing."""
    kept = F.regexp_replace(c, "[^0-9.,]", "")
    return F.when(~kept.isin("", "0", "0.00", ".00"), kept)


def display(c: Column) -> Column:
    return F.concat(F.lit("$"), F.call_function("format_number", c, F.lit("#,##0.00")))


def whole_dollars(c: Column) -> Column:
    """``1000`` and ``$1,000.00`` as ``$1,000``; other text as it is."""
    value = F.regexp_replace(c, r"[$,]", "").try_cast("double")
    return F.when(value.isNotNull(), F.concat(F.lit("$"), F.call_function("format_number", F.floor(value), F.lit("#,##0")))).otherwise(c)


def clamp_confidence(c: Column) -> Column:
    return F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 3)
