"""Dispute letters, reasons, suggestions, prompts and insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..plans.views import AS_OF, Views
from .aggregates import CREDITOR_WORDS, KEYWORDS

c = F.col
#: Where letters go.
ADDRESSES = [
    ("Experian", "Experian", "P.O. Box 4000", "Allen, TX 75013"),
    ("Equifax", "Equifax Information Services LLC", "P.O. Box 740256", "Atlanta, GA 30374"),
    ("TransUnion", "TransUnion LLC Consumer Dispute Center", "P.O. Box 2000", "Chester, PA 19016"),
]
#: Wording of reasons.
MISSING = {"account_number": "Account number is missing or incomplete", "date_opened": "Date opened is inaccurate or missing", "account_status": "Account status is inaccurate"}
DEFAULT = ["This account does not belong to me", "The information reported is inaccurate"]
BY_STATUS = {
    "charged off": ["This account was not charged off and should be reported as current", "The charge-off information is inaccurate and unverifiable"],
    "collection": ["This account is not in collection and should be removed", "I never received proper debt validation for this collection account"],
    "late": ["No payments were late on this account", "The late payment information is inaccurate"],
}
REPEATED = "This account has been previously disputed and remains unverified"
UNSURE = ["This account information is inaccurate and should be corrected or removed", "The information cannot be verified and should be deleted"]


def strings(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def or_default(reasons: Column, default: list[str]) -> Column:
    return F.when(F.size(reasons) > 0, reasons).otherwise(strings(default))


@query("L1_missing_field_reasons", f"""WITH r AS (SELECT id, list_filter([{", ".join(f"CASE WHEN trim({f}) = '' THEN '{m}' END" for f, m in MISSING.items())}], lambda x: x IS NOT NULL) AS r FROM tradelines) SELECT id, array_to_string(CASE WHEN len(r) > 0 THEN r ELSE {sql_list(DEFAULT)} END, '; ') AS reasons FROM r""")
def missing_field_reasons(v: Views) -> DataFrame:
    reasons = F.array_compact(F.array(*[F.when(F.trim(f) == "", m) for f, m in MISSING.items()]))
    return v.tradelines.select("id", F.array_join(or_default(reasons, DEFAULT), "; ").alias("reasons"))


@query("L2_status_reasons", f"""WITH r AS (SELECT id, list_concat({", ".join(f"CASE WHEN contains(lower(account_status), '{k}') THEN {sql_list(x)} ELSE [] END" for k, x in BY_STATUS.items())}, CASE WHEN dispute_count > 0 THEN ['{REPEATED}'] ELSE [] END) AS r FROM tradelines)
    SELECT id, array_to_string((CASE WHEN len(r) > 0 THEN r ELSE {sql_list(UNSURE)} END)[1:3], '; ') AS reasons FROM r""")  # fmt: skip
def status_reasons(v: Views) -> DataFrame:
    none = F.array().cast("array<string>")
    parts = [F.when(F.lower("account_status").contains(k), strings(x)).otherwise(none) for k, x in BY_STATUS.items()]
    parts.append(F.when(c("dispute_count") > 0, strings([REPEATED])).otherwise(none))
    return v.tradelines.select("id", F.array_join(F.slice(or_default(F.concat(*parts), UNSURE), 1, 3), "; ").alias("reasons"))


ROW = "coalesce(nullif(creditor_name, ''), '[Creditor]') || ' | ' || CASE WHEN length(account_number) > 4 THEN '****' || right(account_number, 4) ELSE coalesce(nullif(account_number, ''), '[Account Number]') END || ' | ' || coalesce(nullif(date_opened, ''), '[Date]') || ' | Inaccurate Information'"
BUREAU_ROWS = ", ".join(f"('{a}', '{b}', '{x}', '{y}')" for a, b, x, y in ADDRESSES)


def account_row() -> Column:
    return F.concat_ws(" | ", F.coalesce(F.nullif("creditor_name", F.lit("")), F.lit("[Creditor]")), T.mask_account(c("account_number")), F.coalesce(F.nullif("date_opened", F.lit("")), F.lit("[Date]")), F.lit("Inaccurate Information"))


@query("L3_L4_L5_L6_letters", f"""WITH b(bureau, firm, box, town) AS (VALUES {BUREAU_ROWS}), g AS (SELECT user_id, credit_bureau, count(*) AS disputes, string_agg({ROW}, chr(10) ORDER BY ord) AS rows FROM tradelines WHERE is_negative AND credit_bureau <> '' GROUP BY 1, 2)
    SELECT g.user_id, g.credit_bureau AS bureau, disputes, 'August 2, 2001' || chr(10) || chr(10) || first_name || ' ' || last_name || chr(10) || address || chr(10) || city || ', ' || state || ' ' || zip_code || chr(10) || chr(10) || firm || chr(10) || box || chr(10) || town || chr(10) || chr(10)
    || 'Social Security Number: ' || CASE WHEN length(ssn) > 0 THEN '***-**-' || right(ssn, 4) ELSE '[SSN]' END || chr(10) || 'Creditor Name | Account Number | Date Opened | Dispute Reason' || chr(10) || repeat('=', 70) || chr(10) || rows AS letter
    FROM g JOIN b ON b.bureau = g.credit_bureau JOIN profiles p ON p.user_id = g.user_id""")  # fmt: skip
def letters(v: Views) -> DataFrame:
    """One letter for each user and bureau; its table has a line for each disputed account, in order."""
    rows = F.sort_array(F.collect_list(F.struct("ord", account_row().alias("r"))))
    groups = v.tradelines.where("is_negative and credit_bureau <> ''").groupBy("user_id", c("credit_bureau").alias("bureau")).agg(F.count("*").alias("disputes"), rows.alias("x"))
    firms = v.spark.createDataFrame(ADDRESSES, "bureau string, firm string, box string, town string")
    whole = groups.join(F.broadcast(firms), "bureau").join(v.profiles, "user_id")
    body = F.concat_ws(
        "\n",
        F.date_format(F.lit(AS_OF).cast("date"), "MMMM d, yyyy"),
        F.lit(""),
        F.concat_ws(" ", "first_name", "last_name"),
        c("address"),
        F.concat(c("city"), F.lit(", "), c("state"), F.lit(" "), c("zip_code")),
        F.lit(""),
        c("firm"),
        c("box"),
        c("town"),
        F.lit(""),
        F.concat(F.lit("Social Security Number: "), T.mask_ssn(c("ssn"))),
        F.lit("Creditor Name | Account Number | Date Opened | Dispute Reason"),
        F.lit("=" * 70),
        F.array_join(F.transform("x", lambda r: r["r"]), "\n"),
    )
    return whole.select("user_id", "bureau", "disputes", body.alias("letter"))


@query("L7_packet_summary", "SELECT user_id, count(DISTINCT credit_bureau) AS bureau_count, count(*) AS tradeline_count FROM tradelines WHERE is_negative AND credit_bureau <> '' GROUP BY user_id")
def packet_summary(v: Views) -> DataFrame:
    return v.tradelines.where("is_negative and credit_bureau <> ''").groupBy("user_id").agg(F.countDistinct("credit_bureau").alias("bureau_count"), F.count("*").alias("tradeline_count"))


@query("L9_suggestions", """WITH t AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE is_negative) AS bad, bool_or(account_type = 'Credit Card') AS card FROM tradelines GROUP BY 1), d AS (SELECT user_id, count(*) FILTER (WHERE status = 'rejected') AS made FROM disputes GROUP BY 1),
    s AS (SELECT t.user_id, unnest(list_filter([CASE WHEN bad > 0 THEN 'Dispute Negative Items' END, CASE WHEN NOT card AND n < 30 THEN 'Build Credit Mix' END, CASE WHEN coalesce(made, 0) = 0 AND bad > 0 THEN 'Start Dispute Process' END], lambda x: x IS NOT NULL)) AS title FROM t LEFT JOIN d ON t.user_id = d.user_id) SELECT * FROM s""")  # fmt: skip
def suggestions(v: Views) -> DataFrame:
    t = v.tradelines.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("is_negative").alias("bad"), F.bool_or(c("account_type") == "Credit Card").alias("card"))
    d = v.disputes.groupBy("user_id").agg(F.count_if(c("status") == "rejected").alias("made"))
    rules = [(c("bad") > 0, "Dispute Negative Items"), (~c("card") & (c("n") < 30), "Build Credit Mix"), ((F.coalesce("made", F.lit(0)) == 0) & (c("bad") > 0), "Start Dispute Process")]
    return t.join(d, "user_id", "left").select("user_id", F.explode(F.array_compact(F.array(*[F.when(r, m) for r, m in rules]))).alias("title"))


@query("L10_L14_L15_prompts", """SELECT d.doc_id, 'Extract accounts from this report:' || chr(10) || substr(text, 1, 8000) AS prompt FROM files d""")
def prompts(v: Views) -> DataFrame:
    """The limit of a prompt is its feature: a model's window."""
    return v.files.select("doc_id", F.concat(F.lit("Extract accounts from this report:\n"), F.substring("text", 1, 8000)).alias("prompt"))


@query("L11_insights", f"""WITH k AS (SELECT ord, text, len(regexp_extract_all(text, '(?i)account|tradeline')) AS a, len(regexp_extract_all(lower(text), 'late|delinquent|collection|charge|bankruptcy')) AS n, list_slice(list_concat(list_filter({KEYWORDS}, lambda k: contains(lower(text), k)), list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i){CREDITOR_WORDS}'), lambda x: upper(x))))), 1, 8) AS w FROM reports)
    SELECT ord, CASE WHEN length(text) < 100 THEN 'Document appears to be too short or empty for analysis.' ELSE concat_ws(chr(10), 'Credit Report Analysis:', CASE WHEN a > 0 THEN 'Found ' || a || ' potential account references' END, CASE WHEN n > 0 THEN 'Detected ' || n || ' potential negative item indicators' END,
    CASE WHEN contains(lower(text), 'payment') THEN 'Payment history information found' END, CASE WHEN len(w) > 0 THEN 'Key terms identified: ' || array_to_string(w, ', ') END) END AS insight FROM k""")  # fmt: skip
def insights(v: Views) -> DataFrame:
    low = F.lower("text")
    a, n = F.regexp_count("text", F.lit("(?i)account|tradeline")), F.regexp_count(low, F.lit("late|delinquent|collection|charge|bankruptcy"))
    terms = F.array_compact(F.array(*[F.when(low.contains(k), k) for k in KEYWORDS]))
    named = F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(f"(?i){CREDITOR_WORDS}"), F.lit(0)), F.upper)))
    words = F.slice(F.concat(terms, named), 1, 8)
    whole = F.concat_ws(
        "\n",
        F.lit("Credit Report Analysis:"),
        F.when(a > 0, F.concat(F.lit("Found "), a.cast("string"), F.lit(" potential account references"))),
        F.when(n > 0, F.concat(F.lit("Detected "), n.cast("string"), F.lit(" potential negative item indicators"))),
        F.when(low.contains("payment"), "Payment history information found"),
        F.when(F.size(words) > 0, F.concat(F.lit("Key terms identified: "), F.array_join(words, ", "))),
    )
    return v.reports.select("ord", F.when(F.length("text") < 100, "Document appears to be too short or empty for analysis.").otherwise(whole).alias("insight"))
