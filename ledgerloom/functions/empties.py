"""The four notions of an empty value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each notion treats as empty besides null.
PLACEHOLDERS = ["", "NULL", "null", "N/A", "n/a", "xx/xx/xxxxx", "0"]
ENRICHABLE = ["", "$0", "$0.00", "0"]
MERGEABLE = ["", "$0"]


def is_placeholder(c: Column) -> Column:
    return c.isNull() | F.trim(c).isin(PLACEHOLDERS)


def needs_enrichment(c: Column) -> Column:
    return c.isNull() | c.isin(ENRICHABLE)


def is_empty_merge(c: Column) -> Column:
    return c.isNull() | c.isin(MERGEABLE)


def is_falsy(c: Column) -> Column:
    return c.isNull() | (c == "")


def default(c: Column, value: str) -> Column:
    """The value where the column is null or empty."""
    return F.when(is_falsy(c), F.lit(value)).otherwise(c)
