"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import categories as C
from ..functions.empties import default, is_falsy, is_placeholder, needs_enrichment
from ..plans.registry import query
from ..plans.views import AS_OF, Views

c = F.col
TERMS, CORE = "|".join(C.NEGATIVE_TERMS), "|".join(C.CORE_TERMS)


@query("F1_equality_filters", "SELECT id, user_id, credit_bureau FROM tradelines WHERE user_id = 'U7' AND credit_bureau = 'Experian' AND NOT is_negative")
def equality(v: Views) -> DataFrame:
    return v.tradelines.where((c("user_id") == "U7") & (c("credit_bureau") == "Experian") & ~c("is_negative")).select("id", "user_id", "credit_bureau")


@query("F2_negative_tradelines", f"SELECT id, account_status FROM tradelines WHERE is_negative OR regexp_matches(lower(account_status), '{TERMS}')")
def negative(v: Views) -> DataFrame:
    return v.tradelines.where(c("is_negative") | C.is_negative_status(c("account_status"))).select("id", "account_status")


@query("F3_J4_positive_tradelines", f"SELECT id FROM tradelines WHERE id NOT IN (SELECT id FROM tradelines WHERE is_negative OR regexp_matches(lower(account_status), '{CORE}'))")
def positive(v: Views) -> DataFrame:
    bad = v.tradelines.where(c("is_negative") | C.is_negative_status(c("account_status"), C.CORE_TERMS))
    return v.tradelines.select("id").join(bad.select("id"), "id", "left_anti")


@query("F4_dashboard_negatives", "SELECT id FROM tradelines WHERE regexp_matches(lower(coalesce(account_status, '')), 'charged off|collection|late|delinquent')")
def dashboard_negatives(v: Views) -> DataFrame:
    return v.tradelines.where(F.coalesce(F.lower("account_status"), F.lit("")).rlike("charged off|collection|late|delinquent")).select("id")


@query("F5_F7_F8_negative_text", f"""SELECT ord, regexp_matches(lower(text), 'charged|collection|delinquent|late|past due') AS by_status, regexp_matches(lower(text), 'delinquent|past due|charge off|collection') AS by_context, regexp_matches(text, '(?i){C.NEGATIVE_TEXT}') AS by_pattern,
    nullif(regexp_extract(text, '(?i)collection|charge.?off|late', 0), '') AS reason FROM sections""")  # fmt: skip
def negative_text(v: Views) -> DataFrame:
    low = F.lower("text")
    return v.sections.select("ord", low.rlike("charged|collection|delinquent|late|past due").alias("by_status"), low.rlike("delinquent|past due|charge off|collection").alias("by_context"), c("text").rlike(f"(?i){C.NEGATIVE_TEXT}").alias("by_pattern"), F.nullif(F.regexp_extract("text", "(?i)collection|charge.?off|late", 0), F.lit("")).alias("reason"))


REJECT4 = "list_filter([CASE WHEN creditor_name = '' THEN 'creditor_name' END, CASE WHEN account_number = '' THEN 'account_number' END, CASE WHEN credit_bureau = '' THEN 'credit_bureau' END, CASE WHEN date_opened = '' THEN 'date_opened' END], lambda x: x IS NOT NULL)"


@query("F9_M4_partial_records", f"SELECT id, array_to_string({REJECT4}, ',') AS missing, len({REJECT4}) = 0 AS complete, creditor_name <> '' AND account_number <> '' AS legacy_complete FROM tradelines")
def partial_records(v: Views) -> DataFrame:
    missing = F.array_compact(F.array(*[F.when(is_falsy(c(f)), f) for f in ("creditor_name", "account_number", "credit_bureau", "date_opened")]))
    return v.tradelines.select("id", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("complete"), (~is_falsy(c("creditor_name")) & ~is_falsy(c("account_number"))).alias("legacy_complete"))


@query("F10_status_filter", "SELECT id FROM tradelines WHERE lower(account_status) = lower('cHaRge OFF')")
def status_filter(v: Views) -> DataFrame:
    return v.tradelines.where(F.lower("account_status") == F.lower(F.lit("cHaRge OFF"))).select("id")


def optional(df: DataFrame, **wanted: str) -> DataFrame:
    """Equality filters in which an empty value stands for any."""
    for name, value in wanted.items():
        if value:
            df = df.where(c(name) == value)
    return df


@query("F11_optional_filters", "SELECT id FROM disputes WHERE bureau = 'Equifax' AND status = 'pending'")
def optional_filters(v: Views) -> DataFrame:
    return optional(v.disputes, bureau="Equifax", priority="", status="pending").select("id")


@query("F12_F13_in_and_range", f"SELECT id, document_type, NULL::DATE AS created_on FROM user_documents WHERE document_type IN ('photo_id', 'ssn_card') UNION ALL SELECT id, NULL, created_on FROM disputes WHERE created_on >= DATE '{AS_OF}' - 10")
def in_and_range(v: Views) -> DataFrame:
    documents = v.user_documents.where(c("document_type").isin("photo_id", "ssn_card")).select("id", "document_type", F.lit(None).cast("date").alias("created_on"))
    recent = v.disputes.where(c("created_on") >= F.date_sub(F.lit(AS_OF).cast("date"), 10)).select("id", F.lit(None).cast("string").alias("document_type"), "created_on")
    return documents.unionByName(recent)


KEYWORDS = ["account", "balance", "payment", "credit", "limit", "opened", "status"]


@query("F15_F16_section_quality", f"""WITH p AS (SELECT ord, unnest(regexp_split_to_array(text, chr(10) || '(?:CAPITAL|Account|Charge)')) AS part FROM reports)
    SELECT ord, count(*) AS parts, count(*) FILTER (WHERE length(part) > 30 AND regexp_matches(lower(part), '{"|".join(KEYWORDS)}')) AS good, count(*) FILTER (WHERE length(part) > 50 AND regexp_matches(part, '[A-Z]{{3,}}|[$]')) AS marked FROM p GROUP BY ord""")  # fmt: skip
def section_quality(v: Views) -> DataFrame:
    parts = F.split("text", "\n(?:CAPITAL|Account|Charge)")
    good = F.filter(parts, lambda p: (F.length(p) > 30) & F.lower(p).rlike("|".join(KEYWORDS)))
    marked = F.filter(parts, lambda p: (F.length(p) > 50) & p.rlike("[A-Z]{3,}|[$]"))
    return v.reports.select("ord", F.size(parts).cast("long").alias("parts"), F.size(good).cast("long").alias("good"), F.size(marked).cast("long").alias("marked"))


@query("F17_low_confidence", "SELECT id, (ord % 10) / 10.0::DOUBLE AS confidence FROM tradelines WHERE (ord % 10) / 10.0 >= 0.3")
def low_confidence(v: Views) -> DataFrame:
    return v.tradelines.select("id", ((c("ord") % 10) / 10.0).alias("confidence")).where("confidence >= 0.3")


@query("F18_F19_F28_defaults", """SELECT id, coalesce(nullif(creditor_name, ''), 'Unknown Creditor') AS creditor_name, coalesce(nullif(account_number, ''), 'Unknown') AS account_number, coalesce(nullif(account_balance, ''), '$0') AS account_balance, coalesce(nullif(credit_limit, ''), '$0') AS credit_limit,
    coalesce(nullif(creditor_name, ''), 'NULL') AS api_creditor, coalesce(nullif(date_opened, ''), 'xx/xx/xxxx') AS api_date, regexp_matches(lower(account_status), 'charge|collection|late') AS negative FROM tradelines""")  # fmt: skip
def defaults(v: Views) -> DataFrame:
    t = v.tradelines
    return t.select(
        "id",
        default(c("creditor_name"), "Unknown Creditor").alias("creditor_name"),
        default(c("account_number"), "Unknown").alias("account_number"),
        default(c("account_balance"), "$0").alias("account_balance"),
        default(c("credit_limit"), "$0").alias("credit_limit"),
        default(c("creditor_name"), "NULL").alias("api_creditor"),
        default(c("date_opened"), "xx/xx/xxxx").alias("api_date"),
        F.lower("account_status").rlike("charge|collection|late").alias("negative"),
    )


@query("F20_F21_record_projections", """SELECT id AS "disputeId", user_id AS "userId", CASE WHEN status = 'generated' THEN 'pending' ELSE status END AS status, right(id, 8) AS "shortId", 'medium' AS impact, coalesce(nullif(status, ''), 'Unknown') || ' with ' || bureau AS reason FROM disputes""")
def record_projections(v: Views) -> DataFrame:
    return v.disputes.select(c("id").alias("disputeId"), c("user_id").alias("userId"), F.when(c("status") == "generated", "pending").otherwise(c("status")).alias("status"), F.right("id", F.lit(8)).alias("shortId"), F.lit("medium").alias("impact"), F.concat(default(c("status"), "Unknown"), F.lit(" with "), c("bureau")).alias("reason"))


NEEDED = ["first_name", "last_name", "address", "city", "state", "zip_code"]


@query("F22_missing_fields", f"SELECT user_id, array_to_string(list_filter([{', '.join(f'''CASE WHEN coalesce({f}, '') = '' THEN '{f}' END''' for f in NEEDED)}], lambda x: x IS NOT NULL), ',') AS missing, {' AND '.join(f'''coalesce({f}, '') <> \'\'''' for f in NEEDED)} AS complete FROM profiles")
def missing_fields(v: Views) -> DataFrame:
    missing = F.array_compact(F.array(*[F.when(is_falsy(c(f)), f) for f in NEEDED]))
    return v.profiles.select("user_id", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("complete"))


@query("F23_U6_semi_filter", "SELECT id FROM tradelines WHERE id IN (SELECT tradeline_id FROM disputes WHERE status = 'resolved')")
def semi_filter(v: Views) -> DataFrame:
    return v.tradelines.select("id").join(v.disputes.where(c("status") == "resolved").select(c("tradeline_id").alias("id")), "id", "left_semi")


@query("F24_F26_selection", "SELECT credit_bureau, id FROM tradelines WHERE credit_bureau = 'TransUnion' AND is_negative")
def selection(v: Views) -> DataFrame:
    return v.tradelines.where((c("credit_bureau") == "TransUnion") & c("is_negative")).select("credit_bureau", "id")


@query("F25_J1_admin_disputes", "SELECT d.id, d.status, coalesce(p.email, '') AS email FROM disputes d LEFT JOIN profiles p ON d.user_id = p.user_id")
def admin_disputes(v: Views) -> DataFrame:
    return v.disputes.select("id", "status", "user_id").join(v.profiles.select("user_id", "email"), "user_id", "left").select("id", "status", F.coalesce("email", F.lit("")).alias("email"))


@query("F27_F30_sanitized_uploads", f"SELECT id, coalesce(trim(credit_bureau), '') AS credit_bureau, coalesce(nullif(date_opened, ''), '{AS_OF}') AS date_opened, coalesce(nullif(account_status, ''), 'Open') AS account_status FROM tradelines")
def sanitized_uploads(v: Views) -> DataFrame:
    return v.tradelines.select("id", F.coalesce(F.trim("credit_bureau"), F.lit("")).alias("credit_bureau"), default(c("date_opened"), AS_OF).alias("date_opened"), default(c("account_status"), "Open").alias("account_status"))


NEXT = {"generated": "submitted", "submitted": "sent", "sent": "label_generated"}


@query("F29_status_transitions", "SELECT id, CASE WHEN ord % 5 = 0 THEN CASE status " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in NEXT.items()) + " ELSE 'escalated' END ELSE status END AS status FROM disputes")
def status_transitions(v: Views) -> DataFrame:
    """Selected disputes move on to the next status, or are escalated where there is none."""
    moved = F.coalesce(F.create_map(*[F.lit(x) for pair in NEXT.items() for x in pair])[c("status")], F.lit("escalated"))
    return v.disputes.select("id", F.when(c("ord") % 5 == 0, moved).otherwise(c("status")).alias("status"))


@query("E1_notions_of_empty", """SELECT id, credit_limit IS NULL OR trim(credit_limit) IN ('', 'NULL', 'null', 'N/A', 'n/a', 'xx/xx/xxxxx', '0') AS placeholder, monthly_payment IN ('', '$0', '$0.00', '0') AS enrich, account_balance IN ('', '$0') AS merge_empty, account_type = '' AS falsy FROM tradelines""")
def notions_of_empty(v: Views) -> DataFrame:
    return v.tradelines.select("id", is_placeholder(c("credit_limit")).alias("placeholder"), needs_enrichment(c("monthly_payment")).alias("enrich"), c("account_balance").isin("", "$0").alias("merge_empty"), is_falsy(c("account_type")).alias("falsy"))
