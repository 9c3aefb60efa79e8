"""Scalar functions over the views: names, money, dates, categories, JSON and arrays."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import categories as C
from ..functions import dates as D
from ..functions import money as M
from ..functions import text as T
from ..plans.registry import query
from ..plans.views import AS_OF, Views

c = F.col


def dq(pattern: str) -> str:
    """A pattern inside a single-quoted SQL string."""
    return pattern.replace("'", "''")


SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
BARE = SQUEEZE.format(f"regexp_replace(upper(trim(coalesce(creditor_name, ''))), '\\b({'|'.join(T.NAME_WORDS)})\\b', '', 'g')")
CLEAN_SQL = f"CASE {' '.join(f'''WHEN contains({BARE}, '{k}') THEN '{v}' ''' for k, v in T.ABBREVIATIONS.items())} ELSE {BARE} END"
LOWER = SQUEEZE.format("regexp_replace(" + SQUEEZE.format("lower(coalesce(creditor_name, ''))") + ", '[^A-Za-z0-9_\\s]', '', 'g')")
MATCH_SQL = SQUEEZE.format(f"regexp_replace(CASE {LOWER} {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in T.WHOLE_NAMES.items())} ELSE {LOWER} END, '\\b({'|'.join(T.SUFFIXES)})\\b', '', 'g')")
FIRST4_SQL = "upper(left(regexp_replace(coalesce(account_number, ''), '[^A-Za-z0-9]', '', 'g'), 4))"
DIGITS_SQL = "left(regexp_replace(coalesce(account_number, ''), '[^0-9]', '', 'g'), 4)"


@query("T1_T2_creditor_names", f"SELECT id, {CLEAN_SQL} AS clean_name, {MATCH_SQL} AS match_name FROM tradelines")
def creditor_names(v: Views) -> DataFrame:
    return v.tradelines.select("id", T.clean_creditor(c("creditor_name")).alias("clean_name"), T.match_creditor(c("creditor_name")).alias("match_name"))


@query(
    "T4_T8_account_keys",
    f"""SELECT id, {FIRST4_SQL} AS first4, {DIGITS_SQL} AS digits4,
    CASE WHEN length(account_number) > 4 THEN '****' || right(account_number, 4) ELSE coalesce(nullif(account_number, ''), '[Account Number]') END AS masked,
    md5(coalesce(creditor_name, '') || '_' || {FIRST4_SQL} || '_' || coalesce(date_opened, '')) AS detail_hash FROM tradelines""",
)
def account_keys(v: Views) -> DataFrame:
    return v.tradelines.select("id", T.account_first_4(c("account_number")).alias("first4"), T.account_digits(c("account_number")).alias("digits4"), T.mask_account(c("account_number")).alias("masked"), T.detail_hash(c("creditor_name"), c("account_number"), c("date_opened")).alias("detail_hash"))


@query(
    "T7_T16_T17_person_fields",
    r"""SELECT user_id, CASE WHEN length(ssn) > 0 THEN '***-**-' || right(ssn, 4) ELSE '[SSN]' END AS ssn_masked,
    concat_ws(', ', nullif(address, ''), nullif(city, ''), nullif(state, ''), nullif(zip_code, '')) AS full_address,
    CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) = 10 THEN regexp_replace(regexp_replace(phone, '[^0-9]', '', 'g'), '^(\d{3})(\d{3})(\d{4})$', '\1-\2-\3') ELSE regexp_replace(phone, '[^0-9]', '', 'g') END AS phone,
    regexp_full_match(zip_code, '\d{5}(-\d{4})?') AS zip_ok FROM profiles""",
)
def person_fields(v: Views) -> DataFrame:
    return v.profiles.select("user_id", T.mask_ssn(c("ssn")).alias("ssn_masked"), T.full_address(c("address"), c("city"), c("state"), c("zip_code")).alias("full_address"), T.format_phone(c("phone")).alias("phone"), T.is_zip(c("zip_code")).alias("zip_ok"))


def nested(function: str, start: str, items) -> str:
    out = start
    for pattern, replacement in items:
        out = f"regexp_replace({out}, '{dq(pattern)}', '{replacement}', 'g')"
    return out


@query("T9_sanitize", f"SELECT ord, {nested('', 'text', [(p, '') for p in T.NOISE] + [('[ \\t\\v\\f]+', ' '), ('[^ -~\\r\\n]', '')])} AS clean FROM reports")
def sanitize(v: Views) -> DataFrame:
    return v.reports.select("ord", T.sanitize(c("text")).alias("clean"))


@query("T10_fix_misread", f"SELECT ord, {nested('', '''replace(replace(replace(text, 'Balance', 'Baiance'), 'Limit', 'lirnit'), 'Payment', 'Payrnent')''', [('(?i)' + a, b) for a, b in T.MISREAD.items()])} AS fixed FROM sections")
def fix_misread(v: Views) -> DataFrame:
    spoiled = F.replace(F.replace(F.replace(c("text"), F.lit("Balance"), F.lit("Baiance")), F.lit("Limit"), F.lit("lirnit")), F.lit("Payment"), F.lit("Payrnent"))
    return v.sections.select("ord", T.fix_misread(spoiled).alias("fixed"))


@query(
    "T11_T12_T18_titles",
    """SELECT id, upper(trim(regexp_replace(regexp_replace(regexp_replace(document_type || ' acct 123 #', '(?i)ACCT|ACCOUNT|#|\\d+', '', 'g'), '[^A-Za-z0-9_\\s&]', ' ', 'g'), '\\s+', ' ', 'g'))) AS line_creditor,
    CASE document_type WHEN 'photo_id' THEN 'Photo ID / Driver''s License' WHEN 'ssn_card' THEN 'Social Security Card' WHEN 'utility_bill' THEN 'Utility Bill / Proof of Address' ELSE upper(regexp_replace(document_type, '_', ' ')) END AS title,
    array_to_string(list_transform(string_split(replace(document_type, '_', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title_case FROM user_documents""",
)
def titles(v: Views) -> DataFrame:
    return v.user_documents.select("id", T.creditor_from_line(F.concat(c("document_type"), F.lit(" acct 123 #"))).alias("line_creditor"), T.document_title(c("document_type")).alias("title"), F.initcap(F.replace(c("document_type"), F.lit("_"), F.lit(" "))).alias("title_case"))


@query(
    "T13_T14_T15_letters_and_addresses",
    r"""SELECT id, CASE WHEN regexp_extract('regarding my ' || letter, '(?i)regarding.*?account with\s+(.*?)(?:\.|,|\s+on)', 1) = '' THEN 'Credit Account' ELSE regexp_extract('regarding my ' || letter, '(?i)regarding.*?account with\s+(.*?)(?:\.|,|\s+on)', 1) END AS company,
    split_part(mailing_address, chr(10), 2) AS street, split_part(split_part(mailing_address, chr(10), 3), ', ', 1) AS city, split_part(split_part(split_part(mailing_address, chr(10), 3), ', ', 2), ' ', 1) AS state,
    split_part(split_part(split_part(mailing_address, chr(10), 3), ', ', 2), ' ', 2) AS zip, split_part(split_part(mailing_address, chr(10), 1), ' ', 1) AS first_name, substr(split_part(mailing_address, chr(10), 1), strpos(split_part(mailing_address, chr(10), 1), ' ') + 1) AS last_name FROM disputes""",
)
def letters_and_addresses(v: Views) -> DataFrame:
    lines = F.split("mailing_address", "\n")
    tail = F.split(F.get(F.split(F.get(lines, F.lit(2)), ", "), F.lit(1)), " ")
    name = F.split(F.trim(F.get(lines, F.lit(0))), " ")
    return v.disputes.select(
        "id",
        T.company_from_letter(F.concat(F.lit("regarding my "), c("letter"))).alias("company"),
        F.get(lines, F.lit(1)).alias("street"),
        F.get(F.split(F.get(lines, F.lit(2)), ", "), F.lit(0)).alias("city"),
        F.get(tail, F.lit(0)).alias("state"),
        F.get(tail, F.lit(1)).alias("zip"),
        F.get(name, F.lit(0)).alias("first_name"),
        F.array_join(F.slice(name, 2, 100), " ").alias("last_name"),
    )


@query("T20_K6_text_sizes", "SELECT doc_id, len(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda x: x <> '')) AS words, length(text) AS chars, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM files")
def text_sizes(v: Views) -> DataFrame:
    return v.files.select("doc_id", T.word_count(c("text")).alias("words"), F.length("text").cast("long").alias("chars"), F.floor(F.length("text") / 4).cast("long").alias("tokens"))


def token_set_ratio(a: str, b: str) -> int:
    """100 x the best match of two names as word sets: their common words against each with its own words, and the two.

    The definition for a single pair; ``creditors`` scores whole tables.
    """
    x, y = (set(re.findall(r"[^\W_]+", name.lower())) for name in (a, b))
    if not x or not y:
        return 0
    common, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if common and (not left or not right):
        return 100
    base = " ".join(common)
    one, two = " ".join([*common, *left]), " ".join([*common, *right])

    def ratio(s: str, t: str) -> float:
        # longest common subsequence against both lengths
        row = [0] * (len(t) + 1)
        for ch in s:
            last = 0
            for j, other in enumerate(t, 1):
                keep = row[j]
                row[j] = last + 1 if ch == other else max(row[j], row[j - 1])
                last = keep
        return 2 * row[-1] / (len(s) + len(t)) if s or t else 0.0

    return int(0.5 + 100 * max([ratio(one, two), *([ratio(base, one), ratio(base, two)] if base else [])]))


@query(
    "N1_N6_money",
    r"""SELECT id, TRY_CAST(regexp_replace(regexp_replace(account_balance, '[$,\s]', '', 'g'), '^\((.*)\)$', '-\1') AS DECIMAL(18, 2)) AS as_decimal, TRY_CAST(regexp_replace(credit_limit, '[$,]', '', 'g') AS DECIMAL(18, 2)) AS plain,
    TRY_CAST(nullif(regexp_replace(coalesce(monthly_payment, ''), '[^0-9.]', '', 'g'), '') AS DOUBLE) AS digits,
    CASE WHEN regexp_matches(account_balance, '^\$[\d,]+(\.\d{2})?$') THEN account_balance WHEN regexp_matches(account_balance, '^\d+$') THEN '$' || account_balance END AS coerced,
    CASE WHEN regexp_replace(monthly_payment, '[^0-9.,]', '', 'g') NOT IN ('', '0', '0.00', '.00') THEN regexp_replace(monthly_payment, '[^0-9.,]', '', 'g') END AS field FROM tradelines""",
)
def money(v: Views) -> DataFrame:
    return v.tradelines.select("id", M.to_decimal(c("account_balance")).alias("as_decimal"), M.plain_decimal(c("credit_limit")).alias("plain"), M.digits_value(c("monthly_payment")).alias("digits"), M.coerce(c("account_balance")).alias("coerced"), M.field_amount(c("monthly_payment")).alias("field"))


@query(
    "N5_first_amount",
    r"""SELECT ord, coalesce(replace(coalesce(nullif(regexp_extract(text, '\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)', 1), ''), nullif(regexp_extract(text, '\b(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\b', 1), '')), ',', ''), '') AS amount FROM sections""",
)
def first_amount(v: Views) -> DataFrame:
    return v.sections.select("ord", M.first_amount(c("text")).alias("amount"))


@query(
    "N7_N8_N9_money_display",
    r"""SELECT id, '$' || printf('%,.2f', CAST(floor(amount) AS DOUBLE)) AS shown, CASE WHEN TRY_CAST(regexp_replace(account_balance, '[$,]', '', 'g') AS DOUBLE) IS NOT NULL THEN '$' || printf('%,d', CAST(floor(TRY_CAST(regexp_replace(account_balance, '[$,]', '', 'g') AS DOUBLE)) AS BIGINT)) ELSE account_balance END AS whole,
    round(least(greatest((ord % 15) / 10.0 - 0.2, 0), 1), 3)::DOUBLE AS confidence FROM tradelines""",
)
def money_display(v: Views) -> DataFrame:
    return v.tradelines.select("id", M.display(F.floor("amount").cast("double")).alias("shown"), M.whole_dollars(c("account_balance")).alias("whole"), M.clamp_confidence((c("ord") % 15) / 10.0 - 0.2).alias("confidence"))


PARSE = "CAST(try_strptime(trim(date_opened), ['%Y-%m-%d', '%m/%d/%Y', '%m-%d-%Y', '%Y/%m/%d', '%d/%m/%Y', '%B %d, %Y', '%b %d, %Y']) AS DATE)"


@query(
    "D2_D4_D8_D9_dates",
    f"""SELECT id, {PARSE} AS day, coalesce(CAST({PARSE} AS VARCHAR), '') AS iso, coalesce(strftime({PARSE}, '%m/%d/%Y'), '') AS us,
    CASE WHEN regexp_full_match(date_opened, '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN date_opened WHEN regexp_full_match(date_opened, '\\d{{2}}/\\d{{4}}') THEN replace(date_opened, '/', '/01/') END AS month_start FROM tradelines""",
)
def dates(v: Views) -> DataFrame:
    d = c("date_opened")
    return v.tradelines.select("id", D.to_date(d).alias("day"), D.iso(d).alias("iso"), D.us_text(d).alias("us"), D.month_start(d).alias("month_start"))


@query(
    "D1_D5_dates_in_text",
    r"""WITH f AS (SELECT ord, text, regexp_extract(text, '(?i)(?:opened|open date|date opened)\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})', 1) AS d FROM sections)
    SELECT ord, coalesce(nullif(regexp_extract(text, '\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b', 1), ''), '') AS first_date,
    CASE WHEN d = '' THEN '' ELSE CASE WHEN length(split_part(d, '/', 3)) = 2 THEN CASE WHEN CAST(split_part(d, '/', 3) AS INT) > 50 THEN '19' ELSE '20' END ELSE '' END || split_part(d, '/', 3) || '/' || lpad(split_part(d, '/', 1), 2, '0') || '/' || lpad(split_part(d, '/', 2), 2, '0') END AS opened FROM f""",
)
def dates_in_text(v: Views) -> DataFrame:
    return v.sections.select("ord", D.first_date(c("text")).alias("first_date"), D.opened_from_text(c("text")).alias("opened"))


@query(
    "D6_D10_D11_D12_date_arithmetic",
    f"""SELECT id, CASE WHEN year(created_on) BETWEEN 1970 AND 2002 THEN created_on END AS plausible, created_on + 30 AS deadline, date_diff('day', created_on, DATE '{AS_OF}') AS age_days, date_diff('day', created_on, DATE '{AS_OF}') >= 40 AS overdue,
    status = 'processing' AND date_diff('day', created_on, DATE '{AS_OF}') >= 35 AS escalates, strftime(created_on, '%B %-d, %Y') AS letter_date, user_id || '_' || strftime(created_on, '%Y%m%d') AS session_id FROM disputes""",
)
def date_arithmetic(v: Views) -> DataFrame:
    day = F.lit(AS_OF).cast("date")
    age = F.datediff(day, "created_on")
    return v.disputes.select(
        "id",
        D.plausible(c("created_on"), day).alias("plausible"),
        F.date_add("created_on", 30).alias("deadline"),
        age.cast("long").alias("age_days"),
        (age >= 40).alias("overdue"),
        ((c("status") == "processing") & (age >= 35)).alias("escalates"),
        F.date_format("created_on", "MMMM d, yyyy").alias("letter_date"),
        F.concat("user_id", F.lit("_"), F.date_format("created_on", "yyyyMMdd")).alias("session_id"),
    )


TITLE_SQL = "array_to_string(list_transform(string_split({0}, ' '), lambda x: upper(x[1:1]) || lower(x[2:])), ' ')"


@query(
    "C1_C2_C9_C11_normal_categories",
    f"""SELECT id, CASE WHEN account_type = '' THEN 'Unknown' ELSE {C.ladder_sql("account_type", C.TYPE_PATTERNS, TITLE_SQL.format("account_type"))} END AS account_type,
    CASE WHEN account_status = '' THEN 'Unknown' ELSE {C.ladder_sql("account_status", C.PAYMENT_PATTERNS, TITLE_SQL.format("account_status"))} END AS payment_status, {TITLE_SQL.format("trim(account_status)")} AS status_title FROM tradelines""",
)
def normal_categories(v: Views) -> DataFrame:
    return v.tradelines.select("id", C.account_type(c("account_type")).alias("account_type"), C.payment_status(c("account_status")).alias("payment_status"), F.initcap(F.trim("account_status")).alias("status_title"))


@query(
    "C3_C4_type_of_creditor",
    f"""SELECT id, {C.ladder_sql("creditor_name", C.CREDITOR_PATTERNS, "'Credit Card'")} AS by_creditor, {C.ladder_sql("creditor_name || ' ' || account_type", C.CONTEXT_TYPES, "''")} AS by_context FROM tradelines""",
)
def type_of_creditor(v: Views) -> DataFrame:
    return v.tradelines.select("id", C.type_of_creditor(c("creditor_name")).alias("by_creditor"), C.ladder(F.concat_ws(" ", "creditor_name", "account_type"), C.CONTEXT_TYPES, F.lit("")).alias("by_context"))


@query(
    "C5_C7_C10_C13_text_categories",
    f"""SELECT ord, {C.ladder_sql("text", C.TEXT_TYPES, "''")} AS type, {C.ladder_sql("text", C.TEXT_STATUSES, "'open'")} AS status, {C.ladder_sql("text", C.TEXT_BUREAUS, "''")} AS bureau, {C.ladder_sql("text", C.KEYWORD_STATUSES, "'Unknown'")} AS keyword_status,
    regexp_matches(text, '(?i){C.NEGATIVE_TEXT}') AS negative FROM sections""",
)
def text_categories(v: Views) -> DataFrame:
    t = c("text")
    return v.sections.select("ord", C.ladder(t, C.TEXT_TYPES, F.lit("")).alias("type"), C.ladder(t, C.TEXT_STATUSES, F.lit("open")).alias("status"), C.ladder(t, C.TEXT_BUREAUS, F.lit("")).alias("bureau"), C.ladder(t, C.KEYWORD_STATUSES, F.lit("Unknown")).alias("keyword_status"), t.rlike(f"(?i){C.NEGATIVE_TEXT}").alias("negative"))


def exact_sql(column: str, mapping: dict[str, str]) -> str:
    return f"CASE lower(trim({column})) " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in mapping.items()) + f" ELSE lower(trim({column})) END"


@query(
    "C6_F6_exact_categories",
    f"""WITH m AS (SELECT id, {exact_sql("account_type", C.EXACT_TYPES)} AS type, {exact_sql("account_status", C.EXACT_STATUSES)} AS status, lower(credit_bureau) AS bureau FROM tradelines)
    SELECT *, status IN ('in_collection', 'charged_off', 'disputed') OR type = 'collection' AS negative FROM m""",
)
def exact_categories(v: Views) -> DataFrame:
    known = F.when(F.lower("credit_bureau").contains("equifax"), "equifax").when(F.lower("credit_bureau").contains("transunion"), "transunion").when(F.lower("credit_bureau").contains("experian"), "experian").otherwise(F.lower(F.trim("credit_bureau")))
    mapped = v.tradelines.select("id", C.exact(c("account_type"), C.EXACT_TYPES).alias("type"), C.exact(c("account_status"), C.EXACT_STATUSES).alias("status"), known.alias("bureau"))
    return mapped.withColumn("negative", c("status").isin("in_collection", "charged_off", "disputed") | (c("type") == "collection"))


@query(
    "C8_last_status_line",
    r"""WITH l AS (SELECT ord, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM sections)
    SELECT ord, coalesce(max_by(CASE WHEN regexp_matches(line, '(?i)collection') THEN 'Collection' WHEN regexp_matches(line, '(?i)charge') THEN 'Charged Off' WHEN regexp_matches(line, '(?i)late') THEN 'Late' END, n) FILTER (WHERE regexp_matches(line, '(?i)collection|charge|late')), 'Open') AS status FROM l GROUP BY ord""",
)
def last_status_line(v: Views) -> DataFrame:
    """The last line that speaks of a status wins."""
    lines = v.sections.select("ord", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    status = C.ladder(c("line"), {"Collection": "collection", "Charged Off": "charge", "Late": "late"}, F.lit(None))
    return lines.select("ord", "n", status.alias("status")).groupBy("ord").agg(F.coalesce(F.max_by("status", F.when(c("status").isNotNull(), c("n"))), F.lit("Open")).alias("status"))


RATE_ROWS = ", ".join(f"('{carrier}', '{name}', '{price}')" for carrier, prices in C.RATES.items() for name, price in prices)


@query("C12_shipping_rates", f"SELECT p.user_id, r.service, r.price FROM profiles p JOIN (VALUES {RATE_ROWS}) r(carrier, service, price) ON r.carrier = CASE p.ord % 3 WHEN 0 THEN 'usps' WHEN 1 THEN 'fedex' ELSE 'dhl' END")
def shipping_rates(v: Views) -> DataFrame:
    carrier = F.when(c("ord") % 3 == 0, "usps").when(c("ord") % 3 == 1, "fedex").otherwise("dhl")
    rates = F.create_map(*[x for k, prices in C.RATES.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(n).alias("service"), F.lit(p).alias("price")) for n, p in prices]))])
    return v.profiles.select("user_id", F.explode(rates[carrier]).alias("r")).select("user_id", "r.service", "r.price")


@query(
    "K1_K3_json_in_text",
    """WITH t AS (SELECT id, regexp_extract('```json ' || '{"a": "' || credit_bureau || '", "n": ' || CAST(ord AS VARCHAR) || CASE WHEN ord % 5 = 0 THEN '' ELSE '}' END || ' ``` end', '(?s)\\{.*\\}') AS body FROM tradelines)
    SELECT id, body, json_valid(body) AND body <> '' AS ok, CASE WHEN json_valid(body) AND body <> '' THEN json_extract_string(body, '$.a') END AS a FROM t""",
)
def json_in_text(v: Views) -> DataFrame:
    raw = F.concat(F.lit('```json {"a": "'), c("credit_bureau"), F.lit('", "n": '), c("ord").cast("string"), F.when(c("ord") % 5 == 0, "").otherwise("}"), F.lit(" ``` end"))
    out = v.tradelines.select("id", F.regexp_extract(raw, r"(?s)\{.*\}", 0).alias("body"))
    parsed = F.from_json(F.nullif(c("body"), F.lit("")), "a string, n long")
    return out.select("id", "body", (F.coalesce(parsed["n"].isNotNull(), F.lit(False))).alias("ok"), parsed["a"].alias("a"))


def balanced_json(texts: pd.Series) -> pd.Series:
    """The first object or array with balanced brackets (outside strings) that parses; null where there is none."""

    def find(text):
        for start, opening in ((i, ch) for i, ch in enumerate(text or "") if ch in "{["):
            depth, quoted, skip = 0, False, False
            for i in range(start, len(text)):
                ch = text[i]
                if skip:
                    skip = False
                elif ch == "\\":
                    skip = quoted
                elif ch == '"':
                    quoted = not quoted
                elif not quoted and ch in "{[":
                    depth += 1
                elif not quoted and ch in "}]":
                    depth -= 1
                    if depth == 0:
                        try:
                            json.loads(text[start : i + 1])
                        except ValueError:
                            break
                        return text[start : i + 1]
        return None

    return texts.map(find)


@query(
    "K4_property_map",
    "SELECT id, credit_bureau AS bureau, coalesce(nullif(account_balance, ''), credit_limit) AS amount FROM tradelines",
)
def property_map(v: Views) -> DataFrame:
    """A list of (name, value) properties as a map; the first name of an alias list that has a value counts."""
    entries = F.array(*[F.struct(F.lit(n).alias("k"), F.nullif(c(col), F.lit("")).alias("v")) for n, col in (("balance", "account_balance"), ("limit", "credit_limit"))])
    props = F.map_from_entries(F.filter(entries, lambda x: x["v"].isNotNull()))
    return v.tradelines.select("id", F.col("credit_bureau").alias("bureau"), props.alias("p")).select("id", "bureau", F.coalesce(c("p")["balance"], c("p")["limit"], F.lit("")).alias("amount"))


@query(
    "K5_truncated_prompt",
    """WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM files) SELECT doc_id, CASE WHEN len(w) > 60 THEN array_to_string(w[1:20], ' ') || ' ... ' || array_to_string(w[len(w) - 19:], ' ') ELSE array_to_string(w, ' ') END AS prompt FROM t""",
)
def truncated_prompt(v: Views) -> DataFrame:
    """Texts over the limit keep the first and the last third of it, in words."""
    w = F.split("text", " ")
    return v.files.select("doc_id", F.when(F.size(w) > 60, F.concat_ws(" ... ", F.array_join(F.slice(w, 1, 20), " "), F.array_join(F.slice(w, -20, 20), " "))).otherwise(F.array_join(w, " ")).alias("prompt"))


@query(
    "K7_letters_json",
    """SELECT user_id, count(*) AS n, CAST(to_json(list({'id': id, 'bureau': credit_bureau} ORDER BY id)) AS VARCHAR) AS letters FROM tradelines WHERE is_negative GROUP BY user_id""",
)
def letters_json(v: Views) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("id", c("credit_bureau").alias("bureau"))))
    return v.tradelines.where("is_negative").groupBy("user_id").agg(F.count("*").alias("n"), F.to_json(rows).alias("letters"))
