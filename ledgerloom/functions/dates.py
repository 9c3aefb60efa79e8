"""Dates written as text in several formats.  "Now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats in the order in which they are tried (month before day).
FORMATS = ["yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "d/M/yyyy", "MMMM d, yyyy", "MMM d, yyyy"]
SLASHED = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"


def to_date(c: Column, formats: list[str] | None = None) -> Column:
    return F.coalesce(*[F.try_to_date(F.trim(c), f) for f in formats or FORMATS])


def iso(c: Column) -> Column:
    return F.coalesce(to_date(c).cast("string"), F.lit(""))


def us_text(c: Column) -> Column:
    """MM/DD/YYYY, or nothing; also reads ``25 Dec 2023``."""
    return F.coalesce(F.date_format(to_date(c, [*FORMATS, "d MMM yyyy"]), "MM/dd/yyyy"), F.lit(""))


def first_date(c: Column) -> Column:
    """The first date in a text: with day and slashes, month and year, or a month's name."""
    patterns = [rf"\b({SLASHED})\b", r"\b(\d{1,2}[/-]\d{2,4})\b", r"\b(\w{3}\s+\d{4})\b", r"\b(\w{3}\s+\d{1,2},?\s+\d{4})\b"]
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns], F.lit(""))


def month_start(c: Column) -> Column:
    """``MM/YYYY`` as the first of the month; full dates stay; anything else is an error (null)."""
    return F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), c).when(c.rlike(r"^\d{2}/\d{4}$"), F.regexp_replace(c, "/", "/01/"))


def opened_from_text(c: Column) -> Column:
    """YYYY/MM/DD of the date after "opened"; two-digit years above 50 are of the last century."""
    found = F.regexp_extract(c, rf"(?i)(?:opened|open date|date opened)\s*:?\s*({SLASHED})", 1)
    part = F.split(found, "[/-]")
    year = F.get(part, F.lit(2))
    full = F.when(F.length(year) == 2, F.concat(F.when(year.try_cast("int") > 50, "19").otherwise("20"), year)).otherwise(year)
    return F.when(found == "", "").otherwise(F.concat_ws("/", full, F.lpad(F.get(part, F.lit(0)), 2, "0"), F.lpad(F.get(part, F.lit(1)), 2, "0")))


def plausible(c: Column, as_of: Column) -> Column:
    """The date where its year lies between 1970 and the next one."""
    return F.when(F.year(c).between(1970, F.year(as_of) + 1), c)
