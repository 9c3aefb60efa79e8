"""Readings that are meant where the patterns as they stand miss them, and records that are whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import categories as C
from ..functions.empties import needs_enrichment
from ..plans.registry import query
from ..plans.views import Views
from .entries import EDGES, ENTRY_CREDITORS, ENTRY_NEGATIVE, ENTRY_NUMBERS, entries_of, first_of_sql, line_accounts, lines_sql
from .extraction import CAPITALS_SQL, KNOWN_SQL, PATTERNS, field_sql, fields, title_sql
from .resolution import ENRICH, FIELDS, SPLIT, met

c = F.col

#: A payment status needs its label (else "current" is found in "Current Balance"), and no status runs over a line's end.
MEANT = {
    **PATTERNS,
    "payment_status": [r"status[ \t:]*(current|pays as agreed|ok|good)", r"(pays as agreed)", *PATTERNS["payment_status"][1:]],
    "account_status": [r"status[ \t:]*([a-zA-Z \t]+)", r"account\s*status[ \t:]*([a-zA-Z \t]+)", *PATTERNS["account_status"][2:]],
}
#: Points of an extraction's confidence, and the length from which a section has one more.
POINTS = {"creditor": 3.0, "account_number": 2.0, "account_balance": 1.0, "credit_limit": 1.0, "monthly_payment": 1.0, "date_opened": 0.5, "date_closed": 0.5, "payment_status": 0.5, "account_status": 0.5}
MOST_POINTS, LONG_SECTION = 10.0, 200


def meant_fields(sections: DataFrame) -> DataFrame:
    """Sections (ord, text) to their fields as they are meant, with the bureau they name and their confidence.

    The balance is one field.  The bureau is the first one that the text names, else "Unknown".  Confidence is points over
    ten, one at most; a status that is "Unknown" gives none, a section of more than 200 characters gives one more.
    """
    found = fields(sections, MEANT).withColumnRenamed("current_balance", "account_balance")
    own = sections.select("ord", F.length("text").alias("_length"), C.ladder(c("text"), {b: b for b in ("Experian", "Equifax", "TransUnion")}, F.lit("Unknown")).alias("credit_bureau"))
    both = found.join(own, "ord")
    points = sum(F.when((F.coalesce(c(f), F.lit("")) != "") & (c(f) != "Unknown" if f.endswith("status") else F.lit(True)), p).otherwise(0.0) for f, p in POINTS.items())
    points = points + F.when(c("_length") > LONG_SECTION, 1.0).otherwise(0.0)
    return both.withColumn("confidence", F.least(points / MOST_POINTS, F.lit(1.0))).drop("_length")


POINTS_SQL = " + ".join(f"CASE WHEN coalesce({f}, '') <> ''" + (f" AND {f} <> 'Unknown'" if f.endswith("status") else "") + f" THEN {p} ELSE 0 END" for f, p in POINTS.items())
NAMED_SQL = ", ".join(f"{field_sql(n, MEANT)} AS {'account_balance' if n == 'current_balance' else n}" for n in MEANT)


@query("X6_V4_meant_fields", f"""WITH n AS (SELECT ord, text, coalesce({KNOWN_SQL}, {CAPITALS_SQL}) AS named FROM sections), f AS (SELECT ord, {title_sql('named')} AS creditor, {NAMED_SQL}, length(text) AS size,
    {C.ladder_sql("text", {b: b for b in ("Experian", "Equifax", "TransUnion")}, "'Unknown'")} AS credit_bureau FROM n WHERE named IS NOT NULL)
    SELECT * EXCLUDE (size), CAST(least(({POINTS_SQL} + CASE WHEN size > {LONG_SECTION} THEN 1 ELSE 0 END) / {MOST_POINTS}, 1.0) AS DOUBLE) AS confidence FROM f""")  # fmt: skip
def section_meanings(v: Views) -> DataFrame:
    return meant_fields(v.sections)


@query("X9_meant_lines", lines_sql(2))
def line_meanings(v: Views) -> DataFrame:
    """Accounts on lines, with the number of the last pattern in place of the name."""
    return line_accounts(v.statements, last_group=2)


STATUS_SQL = C.ladder_sql("entry", C.KEYWORD_STATUSES, "'Unknown'")


@query("X8_meant_entries", rf"""WITH p AS (SELECT ord, string_split(regexp_replace(text, '(?im)^({"|".join(ENTRY_CREDITORS)})', chr(1) || '\1', 'g'), chr(1)) AS parts FROM statements), e AS (SELECT ord, unnest(parts) AS entry, generate_subscripts(parts, 1) - 1 AS k, parts[1] = '' AS led FROM p),
    n AS (SELECT ord, entry, CASE WHEN led THEN k - 1 ELSE k END AS n FROM e WHERE regexp_replace(entry, '{EDGES}', '', 'g') <> ''),
    r AS (SELECT ord, CAST(n AS INTEGER) AS n, coalesce(nullif(regexp_replace(regexp_extract(entry, '(?i)^(.*?)(?:\n|Account Number:|Status:)', 1), '{EDGES}', '', 'g'), ''), 'Unknown') AS creditor, coalesce({first_of_sql(ENTRY_NUMBERS)}, 'N/A') AS account, {STATUS_SQL} AS status, nullif(regexp_extract(entry, '{ENTRY_NEGATIVE}', 0), '') AS in_text,
        TRY_CAST(replace(nullif(regexp_extract(entry, '(?i)Balance:\s*\$?([\d,]+\.?\d{{0,2}})', 1), ''), ',', '') AS DECIMAL(38, 2)) AS amount, nullif(regexp_extract(entry, '(?i)Date Opened:\s*(\d{{2}}/\d{{2}}/\d{{4}})', 1), '') AS date_opened,
        {" ".join(["CASE", *(f"WHEN regexp_matches(entry, '(?i){b}') THEN '{b}'" for b in ("Experian", "TransUnion", "Equifax")), "END"])} AS credit_bureau FROM (SELECT ord, n, entry, entry AS text FROM n)),
    w AS (SELECT *, coalesce(in_text, nullif(regexp_extract(status, '{ENTRY_NEGATIVE}', 0), '')) AS reason FROM r)
    SELECT ord, n, creditor, account, status, reason IS NOT NULL AS is_negative, reason, coalesce(regexp_replace(regexp_replace(CAST(amount AS VARCHAR), '(\.\d)0$', '\1'), '\.0$', ''), '0') AS balance, date_opened, CASE WHEN reason IS NOT NULL THEN 'Negative' ELSE 'Good' END AS account_type, credit_bureau,
        array_to_string(list_filter([CASE WHEN length(creditor) < 2 THEN 'Creditor name must be at least 2 characters.' END, CASE WHEN length(account) < 4 THEN 'Account number must be at least 4 characters.' END], lambda x: x IS NOT NULL), '; ') AS errors FROM w""")  # fmt: skip
def entry_meanings(v: Views) -> DataFrame:
    """Entries read before their text is cleaned, so they keep their days and bureaus."""
    return entries_of(v.statements, cleaned=False)


ENRICHED = [*FIELDS, "account_number"]


@query("M4_enriched_record", f"""WITH {SPLIT} SELECT id, e_id AS existing_id, {", ".join(f"CASE WHEN {ENRICH.format(f'e_{x}')} THEN {x} ELSE e_{x} END AS {x}" for x in ENRICHED)} FROM n
    WHERE e_id IS NOT NULL AND creditor_name <> '' AND account_number <> '' AND credit_bureau <> '' AND date_opened <> '' AND ({" OR ".join(ENRICH.format(f"e_{x}") for x in FIELDS)})""")  # fmt: skip
def enriched_record(v: Views) -> DataFrame:
    return enriched(met(v))


def enriched(both: DataFrame) -> DataFrame:
    """Arrivals with the stored record of their key (e_...) to that record after them: it is written if one of five fields
    needs a value, and then six fields that need one take the arrival's, the account number among them, even where the
    arrival has none.  Arrivals that lack a part of their key, and those without a stored record, write nothing."""
    whole = (c("creditor_name") != "") & (c("account_number") != "") & (c("credit_bureau") != "") & (c("date_opened") != "")
    due = F.lit(False)
    for x in FIELDS:
        due = due | needs_enrichment(c(f"e_{x}"))
    taken = [F.when(needs_enrichment(c(f"e_{x}")), c(x)).otherwise(c(f"e_{x}")).alias(x) for x in ENRICHED]
    return both.where(c("e_id").isNotNull() & whole & due).select("id", c("e_id").alias("existing_id"), *taken)


def fixed(records: DataFrame, bureau: Column) -> DataFrame:
    """Records as they are stored: the given bureau is forced, names are capitals, numbers trimmed, missing fields filled.

    Records without a creditor are rejected.  An empty field stays empty; only a null one takes its default.
    """
    number = F.trim("account_number")
    return records.where(F.coalesce("creditor_name", F.lit("")) != "").select(
        "id",
        F.upper(F.trim("creditor_name")).alias("creditor_name"),
        F.when(number.isin("", "NULL", "None"), "").otherwise(F.coalesce(number, F.lit(""))).alias("account_number"),
        bureau.alias("credit_bureau"),
        *[F.coalesce(f, F.lit("")).alias(f) for f in ("account_balance", "credit_limit", "monthly_payment", "date_opened")],
        *[F.coalesce(f, F.lit("other")).alias(f) for f in ("account_type", "account_status")],
        F.coalesce("is_negative", F.lit(False)).alias("is_negative"),
        F.coalesce("dispute_count", F.lit(0)).alias("dispute_count"),
    )


@query("M8_forced_bureau", f"""WITH b AS (SELECT ord, {C.ladder_sql("text", {b: b for b in ("Experian", "Equifax", "TransUnion")}, "'Unknown'")} AS bureau FROM sections)
    SELECT id, upper(trim(creditor_name)) AS creditor_name, CASE WHEN trim(account_number) IN ('', 'NULL', 'None') THEN '' ELSE trim(account_number) END AS account_number, bureau AS credit_bureau, account_balance, credit_limit, monthly_payment, date_opened, nullif(account_type, '#') AS account_type, account_status, is_negative, dispute_count
    FROM tradelines t JOIN b ON t.ord = b.ord WHERE creditor_name <> ''""")  # fmt: skip
def forced_bureau(v: Views) -> DataFrame:
    """Records with the bureau that their section names, whatever they say themselves."""
    named = v.sections.select("ord", C.ladder(c("text"), {b: b for b in ("Experian", "Equifax", "TransUnion")}, F.lit("Unknown")).alias("_bureau"))
    return fixed(v.tradelines.join(named, "ord"), c("_bureau"))
