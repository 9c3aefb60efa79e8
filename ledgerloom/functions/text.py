"""Names, account numbers and other strings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations found anywhere in a cleaned name, in this order, and the name they stand for.
ABBREVIATIONS = {"AMEX": "AMERICAN EXPRESS", "BOA": "BANK OF AMERICA", "CAP1": "CAPITAL ONE", "CHASE": "CHASE", "CITI": "CITIBANK", "DISC": "DISCOVER", "WF": "WELLS FARGO", "SYNC": "SYNCHRONY"}
#: Names that are one of these abbreviations as a whole.
WHOLE_NAMES = {
    "boa": "bank of america",
    "bofa": "bank of america",
    "chase": "jp morgan chase",
    "amex": "american express",
    "citi": "citibank",
    "wells": "wells fargo",
    "discover": "discover financial",
    "capital one": "capital one financial",
    "usaa": "united services automobile association",
}
#: Words that say what kind of company it is.
SUFFIXES = ["bank", "credit", "card", "company", "corp", "inc", "llc", "financial", "services", "association"]
NAME_WORDS = ["BANK", "CREDIT", "CARD", "SERVICES", "INC", "LLC", "CORP", "NA"]
#: Words that optical recognition gets wrong.
MISREAD = {"Credltor": "Creditor", "Credlf": "Credit", "Baiance": "Balance", "Lirnit": "Limit", "Payrnent": "Payment", "Accounf": "Account", "Nurnber": "Number", "Arnount": "Amount", "Lirnited": "Limited", "Narne": "Name", "Addi-ess": "Address"}


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_creditor(c: Column) -> Column:
    """Upper case without company words; a known abbreviation anywhere gives its full name."""
    bare = squeeze(F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), rf"\b({'|'.join(NAME_WORDS)})\b", ""))
    return reduce(lambda rest, x: F.when(bare.contains(x[0]), x[1]).otherwise(rest), reversed(ABBREVIATIONS.items()), bare)


def match_creditor(c: Column) -> Column:
    """Lower case, no punctuation; a whole-name abbreviation gives its full name; then company words go."""
    bare = squeeze(F.regexp_replace(squeeze(F.lower(F.coalesce(c, F.lit("")))), r"[^A-Za-z0-9_\s]", ""))
    known = F.coalesce(F.create_map(*[F.lit(x) for pair in WHOLE_NAMES.items() for x in pair])[bare], bare)
    return squeeze(F.regexp_replace(known, rf"\b({'|'.join(SUFFIXES)})\b", ""))


def account_first_4(c: Column) -> Column:
    return F.upper(F.left(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", ""), F.lit(4)))


def account_digits(c: Column) -> Column:
    return F.left(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", ""), F.lit(4))


def mask_account(c: Column) -> Column:
    return F.when(F.length(c) > 4, F.concat(F.lit("****"), F.right(c, F.lit(4)))).otherwise(F.coalesce(F.nullif(c, F.lit("")), F.lit("[Account Number]")))


def mask_ssn(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.concat(F.lit("***-**-"), F.right(c, F.lit(4)))).otherwise("[SSN]")


def detail_hash(creditor: Column, account: Column, opened: Column) -> Column:
    return F.md5(F.concat_ws("_", F.coalesce(creditor, F.lit("")), account_first_4(account), F.coalesce(opened, F.lit(""))))


MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: What a report's machinery adds to its text: dates, times, who made it.
NOISE = [
    r"\b\d{1,2}/\d{1,2}/\d{2,4}(?:, \d{1,2}:\d{2} (?:AM|PM))?\b",
    r"\b\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2}:\d{2})?\b",
    r"(?i)Report Date:\s*\d{1,2}/\d{1,2}/\d{2,4}",
    rf"(?i)\b(?:{'|'.join(m[:3] for m in MONTHS.split('|'))})\s+\d{{1,2}},\s+\d{{4}}\b",
    rf"(?i)\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\b",
    r"(?i)\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|UTC|GMT)?\b",
    r"(?i)\bExperian\b",
    r"(?i)\bTransUnion\b",
    r"(?i)\bEquifax\b",
    r"(?i)\bGenerated by\s+\S+",
    r"(?i)\bPowered by\s+\S+",
]


def sanitize(c: Column) -> Column:
    out = reduce(lambda t, p: F.regexp_replace(t, p, ""), NOISE, c)
    return F.regexp_replace(F.regexp_replace(out, r"[ \t\x0B\f]+", " "), r"[^ -~\r\n]", "")


def fix_misread(c: Column) -> Column:
    return reduce(lambda t, x: F.regexp_replace(t, f"(?i){x[0]}", x[1]), MISREAD.items(), c)


def creditor_from_line(c: Column) -> Column:
    bare = F.upper(squeeze(F.regexp_replace(F.regexp_replace(c, r"(?i)ACCT|ACCOUNT|#|\d+", ""), r"[^A-Za-z0-9_\s&]", " ")))
    return F.when(F.length(bare) > 2, bare).otherwise("")


def company_from_letter(c: Column) -> Column:
    """The company named after "regarding ... account with", up to a full stop, a comma or "on"."""
    found = F.nullif(F.regexp_extract(c, r"(?i)regarding.*?account with\s+(.*?)(?:\.|,|\s+on)", 1), F.lit(""))
    return F.when(F.coalesce(c, F.lit("")) == "", "Unknown Company").otherwise(F.coalesce(found, F.lit("Credit Account")))


def full_address(*parts: Column) -> Column:
    return F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts])


def format_phone(c: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) == 10, F.regexp_replace(digits, r"^(\d{3})(\d{3})(\d{4})$", "$1-$2-$3")).otherwise(digits)


def is_zip(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{5}(-\d{4})?$"), F.lit(False))


#: Titles of the known documents.
TITLES = {"photo_id": "Photo ID / Driver's License", "ssn_card": "Social Security Card", "utility_bill": "Utility Bill / Proof of Address"}


def document_title(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])[c]
    return F.coalesce(known, F.upper(F.regexp_replace(c, "^([^_]*)_", "$1 ")))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")).cast("long")


def word_in(pattern: str) -> str:
    """The longest word outside of groups that every match of a pattern holds, in small letters; empty without one."""
    plain = re.sub(r"\[[^\]]*\]", " ", re.sub(r"\(\?[a-z]+\)|\\.", " ", pattern))
    while "(" in plain:
        plain = re.sub(r"\([^()]*\)", " ", plain)
    words = re.findall("[A-Za-z]+", re.sub("[A-Za-z][?*{]", " ", plain))
    return "" if "|" in plain else max([w.lower() for w in words], key=len, default="")


def first_group(text: Column, low: Column, pattern: str) -> Column:
    """What the first group of a pattern holds, null if that is nothing; ``low`` is the text in small letters.

    A text without the pattern's word is not searched, and the group is read once (``nullif`` would search twice).
    """
    found = F.get(F.filter(F.array(F.regexp_extract(text, pattern, 1)), lambda x: x != ""), F.lit(0))
    word = word_in(pattern)
    return F.when(low.contains(word), found) if word else found
