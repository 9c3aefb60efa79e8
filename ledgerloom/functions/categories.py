"""Ordered category ladders: the first bucket that fits wins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets and the words that lead to them, in order.  Short codes count as whole words only.
TYPE_BUCKETS = {
    "Credit Card": ["credit card", "cc", "visa", "mastercard", "amex", "discover"],
    "Mortgage": ["mortgage", "home loan", "real estate"],
    "Auto Loan": ["auto", "car loan", "vehicle", "automobile"],
    "Student Loan": ["student", "education", "sallie mae"],
    "Personal Loan": ["personal", "signature", "unsecured"],
    "Line Of Credit": ["line of credit", "loc", "credit line", "heloc"],
    "Installment": ["installment", "term loan"],
    "Collection": ["collection", "charged off", "charge off"],
}
PAYMENT_BUCKETS = {
    "current": ["current", "ok", "pays as agreed", "on time"],
    "30 days late": ["30"],
    "60 days late": ["60"],
    "90 days late": ["90"],
    "120+ days late": ["120"],
    "charged off": ["charged off", "charge off", "co"],
    "collection": ["collection"],
    "settled": ["settled", "settlement"],
    "paid": ["paid", "closed"],
}
CREDITOR_TYPES = {
    "Auto Loan": ["FORD", "HONDA", "TOYOTA", "NISSAN", "GM", "CHRYSLER", "ALLY AUTO", "SANTANDER"],
    "Student Loan": ["NAVIENT", "GREAT LAKES", "NELNET", "FEDLOAN", "MOHELA", "DEPT OF EDUCATION", "STUDENT"],
    "Mortgage": ["QUICKEN", "ROCKET", "FREEDOM", "PENNYMAC", "CALIBER", "MORTGAGE"],
    "Personal Loan": ["LENDING CLUB", "PROSPER", "SOFI", "AVANT", "ONEMAIN", "SPRINGLEAF", "PERSONAL"],
}
TEXT_TYPES = {
    "credit_card": "credit card|revolving|visa|mastercard|amex|discover",
    "mortgage": "mortgage|real estate|home loan|mtg",
    "auto_loan": "auto|vehicle|car loan|automotive",
    "student_loan": "student|education|educ",
    "loan": "installment|personal loan|loan",
    "collection": "collection|charged off and sold",
}
TEXT_STATUSES = {
    "open": "open|current|ok|good standing",
    "closed": "closed|terminated|cancelled",
    "in_collection": "collection|charged off and sold|sold",
    "charged_off": "charge off|charged off|chargeoff",
    "disputed": "disputed|dispute|under review",
}
TEXT_BUREAUS = {"experian": "experian|exp", "equifax": "equifax|eqf|efx", "transunion": "transunion|tuc|tu"}
KEYWORD_STATUSES = {"chargedOff": "charged off", "collection": "sent to collections|in collection", "closed": "account closed", "paid": "paid in full", "open": "open account|current"}
CONTEXT_TYPES = {"mortgage": "mortgage|home", "auto_loan": "auto|car", "student_loan": "student", "collection": "collection", "credit_card": "card|credit", "loan": "loan"}
EXACT_TYPES = {"credit card": "credit_card", "installment": "loan", "mortgage": "mortgage", "auto": "auto_loan", "student": "student_loan", "collection": "collection"}
EXACT_STATUSES = {"current": "open", "paid": "closed", "collection": "in_collection", "charge off": "charged_off", "charged off": "charged_off"}
WHOLE_WORDS = {"cc", "co", "ok", "loc"}
#: What marks an account as negative.
NEGATIVE_TERMS = [
    "charged off", "charge off", "collection", "collections", "late", "delinquent", "past due", "default", "bankruptcy", "foreclosure", "repossession", "settlement",
    "30 day late", "60 day late", "90 day late", "120 day late", "closed",
]
CORE_TERMS = [t for t in NEGATIVE_TERMS if "day" not in t]
NEGATIVE_TEXT = r"charge off|collection|delinquent|late payment|\b(?:30|60|90|120)\s*days?\s*late|past due|default|foreclosure|repossession|bankruptcy"
RATES = {"usps": [("firstClass", "$3.99"), ("priorityMail", "$7.99")], "fedex": [("express", "$14.99"), ("ground", "$9.99")]}


def words(terms: list[str]) -> str:
    return "|".join(rf"\b{t}\b" if t in WHOLE_WORDS else re.escape(t) for t in terms)


def ladder(c: Column, buckets: dict[str, str], rest: Column) -> Column:
    """The first bucket whose pattern is found, in either case."""
    out = F
    for name, pattern in buckets.items():
        out = out.when(F.coalesce(c, F.lit("")).rlike(f"(?i){pattern}"), name)
    return out.otherwise(rest)


def ladder_sql(c: str, buckets: dict[str, str], rest: str) -> str:
    """The same ladder in DuckDB's SQL."""
    return "CASE " + " ".join(f"WHEN regexp_matches(coalesce({c}, ''), '(?i){p}') THEN '{name}'" for name, p in buckets.items()) + f" ELSE {rest} END"


TYPE_PATTERNS = {k: words(v) for k, v in TYPE_BUCKETS.items()}
PAYMENT_PATTERNS = {k: words(v) for k, v in PAYMENT_BUCKETS.items()}
CREDITOR_PATTERNS = {k: words(v) for k, v in CREDITOR_TYPES.items()}


def account_type(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "Unknown").otherwise(ladder(c, TYPE_PATTERNS, F.initcap(c)))


def payment_status(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "Unknown").otherwise(ladder(c, PAYMENT_PATTERNS, F.initcap(c)))


def type_of_creditor(c: Column) -> Column:
    return ladder(c, CREDITOR_PATTERNS, F.lit("Credit Card"))


def exact(c: Column, mapping: dict[str, str]) -> Column:
    bare = F.lower(F.trim(c))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[bare], bare)


def is_negative_status(c: Column, terms: list[str] | None = None) -> Column:
    return F.coalesce(F.lower(c), F.lit("")).rlike("|".join(terms or NEGATIVE_TERMS))
