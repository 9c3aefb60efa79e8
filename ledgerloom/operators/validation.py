"""Field checks, record checks and confidence scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import digits_value
from ..plans.registry import query
from ..plans.views import AS_OF, Views
from .aggregates import NUMBER

c = F.col
#: Values that need no standardizing.
TYPES = ["Credit Card", "credit_card", "Auto Loan", "auto_loan", "Mortgage", "mortgage", "Student Loan", "student_loan", "Personal Loan", "personal_loan", "Store Card", "store_card", "Line of Credit", "line_of_credit", "Installment Loan", "installment", "Business", "business", "Secured", "secured"]
STATUSES = ["Open", "Closed", "Current", "Late", "Charged Off", "Collection", "Paid", "Settled", "Dispute"]
BUREAUS = ["Experian", "Equifax", "TransUnion"]
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split()
#: Formats of amounts, account numbers and dates.
CURRENCY, MASKED, FULL = r"^\$?\d{1,3}(,\d{3})*(\.\d{2})?$|^\$?\d+(\.\d{2})?$", r"^[*xX]{2,}\d{2,}$", r"^[A-Za-z0-9*xX-]{4,}$"
DATE = r"^\d{1,2}/\d{1,2}/\d{4}$|^\d{4}-\d{2}-\d{2}$|^\d{1,2}-\d{1,2}-\d{4}$"


def within(value: Column, known: list[str]) -> Column:
    """Does the value hold a known one, or a known one the value (in either case)?"""
    low = F.lower(value)
    return F.exists(F.array(*[F.lit(k.lower()) for k in known]), lambda k: F.contains(low, k) | F.contains(k, low))


def within_sql(value: str, known: list[str]) -> str:
    items = ", ".join(f"'{k.lower()}'" for k in known)
    return f"len(list_filter([{items}], lambda k: contains(lower({value}), k) OR contains(k, lower({value})))) > 0"


def in_sql(value: str, known: list[str]) -> str:
    return f"{value} IN ({', '.join(repr(k) for k in known)})"


def possible_day(value: Column) -> Column:
    """Of a date in one of the formats: a month of the year, a day up to 31, and a year from 1900 to that of AS_OF."""
    parts = F.split(value, "[/-]")
    iso = F.length(parts[0]) == 4
    year, month, day = (F.when(iso, parts[i]).otherwise(parts[j]).try_cast("int") for i, j in ((0, 2), (1, 0), (2, 1)))
    return month.between(1, 12) & day.between(1, 31) & year.between(1900, int(AS_OF[:4]))


def possible_day_sql(f: str) -> str:
    part = f"string_split_regex({f}, '[/-]')"
    year, month, day = (f"TRY_CAST(CASE WHEN length({part}[1]) = 4 THEN {part}[{i}] ELSE {part}[{j}] END AS INTEGER)" for i, j in ((1, 3), (2, 1), (3, 2)))
    return f"({month} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND 31 AND {year} BETWEEN 1900 AND {AS_OF[:4]})"


def field_score(name: str, value: Column) -> Column:
    """Confidence of one field; below zero where it is invalid."""
    if name == "creditor":
        return F.when(value == "", -0.01).when((F.length(value) >= 3) & value.rlike("[A-Za-z]"), F.when(F.upper(value).rlike("BANK|CREDIT|CAPITAL|CHASE|AMEX"), 0.95).otherwise(0.9)).otherwise(-0.3)
    if name == "currency":
        amount = F.regexp_replace(value, "[$,]", "").try_cast("double")
        return F.when(value == "", 0.5).when(value.rlike(CURRENCY), F.when(amount.between(0, 1_000_000), 0.9).otherwise(-0.3)).when(value.rlike(r"\d"), 0.6).otherwise(-0.1)
    if name == "account":
        return F.when(value == "", 0.4).when(value.rlike(MASKED), 0.9).when(value.rlike(FULL), 0.8).otherwise(-0.2)
    if name == "date":
        return F.when(value == "", 0.3).when(value.rlike(DATE), F.when(possible_day(value), 0.9).otherwise(-0.3)).otherwise(-0.1)
    if name == "type":
        return F.when(value == "", -0.01).when(value.isin(TYPES), 0.95).when(within(value, TYPES), 0.8).otherwise(-0.3)
    if name == "status":
        return F.when(value == "", 0.4).when(value.isin(STATUSES), 0.9).when(within(value, STATUSES), 0.7).otherwise(0.5)
    return F.when(value == "", 0.3).when(value.isin(BUREAUS), 0.95).when(within(value, BUREAUS), 0.8).otherwise(0.4)


def score_sql(name: str, f: str) -> str:
    amount = f"TRY_CAST(regexp_replace({f}, '[$,]', '', 'g') AS DOUBLE)"
    return {
        "creditor": f"CASE WHEN {f} = '' THEN -0.01 WHEN length({f}) >= 3 AND regexp_matches({f}, '[A-Za-z]') THEN CASE WHEN regexp_matches(upper({f}), 'BANK|CREDIT|CAPITAL|CHASE|AMEX') THEN 0.95 ELSE 0.9 END ELSE -0.3 END",
        "currency": f"CASE WHEN {f} = '' THEN 0.5 WHEN regexp_matches({f}, '{CURRENCY}') THEN CASE WHEN {amount} BETWEEN 0 AND 1000000 THEN 0.9 ELSE -0.3 END WHEN regexp_matches({f}, '\\d') THEN 0.6 ELSE -0.1 END",
        "account": f"CASE WHEN {f} = '' THEN 0.4 WHEN regexp_matches({f}, '{MASKED}') THEN 0.9 WHEN regexp_matches({f}, '{FULL}') THEN 0.8 ELSE -0.2 END",
        "date": f"CASE WHEN {f} = '' THEN 0.3 WHEN regexp_matches({f}, '{DATE}') THEN CASE WHEN {possible_day_sql(f)} THEN 0.9 ELSE -0.3 END ELSE -0.1 END",
        "type": f"CASE WHEN {f} = '' THEN -0.01 WHEN {in_sql(f, TYPES)} THEN 0.95 WHEN {within_sql(f, TYPES)} THEN 0.8 ELSE -0.3 END",
        "status": f"CASE WHEN {f} = '' THEN 0.4 WHEN {in_sql(f, STATUSES)} THEN 0.9 WHEN {within_sql(f, STATUSES)} THEN 0.7 ELSE 0.5 END",
        "bureau": f"CASE WHEN {f} = '' THEN 0.3 WHEN {in_sql(f, BUREAUS)} THEN 0.95 WHEN {within_sql(f, BUREAUS)} THEN 0.8 ELSE 0.4 END",
    }[name]


CHECKED = [("creditor", "creditor_name"), ("currency", "account_balance"), ("currency", "credit_limit"), ("currency", "monthly_payment"), ("account", "account_number"), ("date", "date_opened"), ("type", "account_type"), ("status", "account_status"), ("bureau", "credit_bureau")]
SCORES = "[" + ", ".join(f"({score_sql(k, f)})::DOUBLE" for k, f in CHECKED) + "]"
NAMES = "[" + ", ".join(f"'{f}'" for _, f in CHECKED) + "]"


@query("V1_V2_A24_record_scores", f"""WITH s AS (SELECT id, {SCORES} AS x FROM tradelines) SELECT id, round(coalesce(list_sum(list_filter(x, lambda y: y >= 0)), 0) / 9, 6) AS confidence, len(list_filter(x, lambda y: y >= 0)) >= 3 AS is_valid,
    array_to_string(list_filter(list_transform(range(1, 10), lambda i: CASE WHEN x[i] < 0 THEN {NAMES}[i] END), lambda n: n IS NOT NULL), ',') AS invalid_fields FROM s""")  # fmt: skip
def record_scores(v: Views) -> DataFrame:
    """Nine field scores; the record's confidence is the sum of the valid ones over nine."""
    x = F.array(*[F.struct(F.lit(f).alias("f"), field_score(k, c(f)).alias("s")) for k, f in CHECKED])
    scored = v.tradelines.select("id", x.alias("x"))
    valid = F.filter("x", lambda y: y["s"] >= 0)
    total = F.aggregate(valid, F.lit(0.0), lambda a, y: a + y["s"])
    bad = F.transform(F.filter("x", lambda y: y["s"] < 0), lambda y: y["f"])
    return scored.select("id", F.round(total / 9, 6).alias("confidence"), (F.size(valid) >= 3).alias("is_valid"), F.array_join(bad, ",").alias("invalid_fields"))


B, L, P = (NUMBER.format(f) for f in ("account_balance", "credit_limit", "monthly_payment"))


@query("V3_business_warnings", f"""SELECT id, array_to_string(list_filter([CASE WHEN {B} <> 0 AND {L} <> 0 AND {B} > {L} THEN 'balance exceeds limit' END, CASE WHEN {B} <> 0 AND {P} <> 0 AND {P} > {B} THEN 'payment exceeds balance' END,
    CASE WHEN contains(lower(account_type), 'auto') AND NOT regexp_matches(lower(creditor_name), 'ford|honda|toyota|auto|motor') THEN 'not auto-related' END, CASE WHEN contains(lower(account_type), 'student') AND NOT regexp_matches(lower(creditor_name), 'navient|nelnet|education|student') THEN 'not education-related' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM tradelines""")  # fmt: skip
def business_warnings(v: Views) -> DataFrame:
    b, l, p = (digits_value(c(f)) for f in ("account_balance", "credit_limit", "monthly_payment"))
    kind, name = F.lower("account_type"), F.lower("creditor_name")
    rules = [
        ((b != 0) & (l != 0) & (b > l), "balance exceeds limit"),
        ((b != 0) & (p != 0) & (p > b), "payment exceeds balance"),
        (kind.contains("auto") & ~name.rlike("ford|honda|toyota|auto|motor"), "not auto-related"),
        (kind.contains("student") & ~name.rlike("navient|nelnet|education|student"), "not education-related"),
    ]
    return v.tradelines.select("id", F.array_join(F.array_compact(F.array(*[F.when(r, m) for r, m in rules])), "; ").alias("warnings"))


HAS = "CASE WHEN {} THEN {} ELSE 0 END"


@query("V4_V5_confidence", f"""SELECT id, least(({HAS.format("creditor_name <> ''", 3)} + {HAS.format("account_number <> ''", 2)} + {HAS.format("account_balance <> ''", 1)} + {HAS.format("credit_limit <> ''", 1)} + {HAS.format("monthly_payment <> ''", 1)} + {HAS.format("date_opened <> ''", 0.5)} + {HAS.format("account_status <> ''", 0.5)}) / 10.0, 1.0)::DOUBLE AS extraction,
    round(0.4 * least(({HAS.format("creditor_name <> ''", 0.5)} + {HAS.format("account_type <> ''", 0.5)}) + 0.5 * ({HAS.format("account_balance <> ''", 0.25)} + {HAS.format("credit_limit <> ''", 0.25)} + {HAS.format("account_status <> ''", 0.25)} + {HAS.format("date_opened <> ''", 0.25)}), 1.0)
    + 0.3 * (1.0 - CASE WHEN TRY_CAST(account_balance AS DECIMAL(18, 2)) IS NULL THEN 0.2 ELSE 0 END - CASE WHEN date_opened <> '' AND NOT regexp_matches(date_opened, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$|^\\d{{2}}/\\d{{2}}/\\d{{4}}$|^\\d{{2}}-\\d{{2}}-\\d{{4}}$') THEN 0.2 ELSE 0 END) + 0.2 + 0.1, 3)::DOUBLE AS model FROM tradelines""")  # fmt: skip
def confidence(v: Views) -> DataFrame:
    """Confidence of an extraction (points over ten), and of a model's answer (completeness, quality and format)."""

    def has(f: str, points: float) -> Column:
        return F.when(c(f) != "", points).otherwise(0.0)

    extraction = F.least((has("creditor_name", 3.0) + has("account_number", 2.0) + has("account_balance", 1.0) + has("credit_limit", 1.0) + has("monthly_payment", 1.0) + has("date_opened", 0.5) + has("account_status", 0.5)) / 10, F.lit(1.0))
    complete = F.least(has("creditor_name", 0.5) + has("account_type", 0.5) + (has("account_balance", 0.25) + has("credit_limit", 0.25) + has("account_status", 0.25) + has("date_opened", 0.25)) * 0.5, F.lit(1.0))
    dated = c("date_opened").rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{2}/\d{2}/\d{4}$|^\d{2}-\d{2}-\d{4}$")
    quality = F.lit(1.0) - F.when(c("account_balance").try_cast("decimal(18,2)").isNull(), 0.2).otherwise(0.0) - F.when((c("date_opened") != "") & ~dated, 0.2).otherwise(0.0)
    model = (complete.cast("decimal(10,4)") * F.lit(0.4).cast("decimal(4,1)") + quality.cast("decimal(10,4)") * F.lit(0.3).cast("decimal(4,1)") + F.lit(0.3).cast("decimal(4,1)")).cast("decimal(12,6)")
    return v.tradelines.select("id", extraction.alias("extraction"), F.round(model, 3).cast("double").alias("model"))


@query("V6_V7_V8_V11_record_errors", r"""SELECT id, array_to_string(list_filter([CASE WHEN creditor_name = '' THEN 'Missing required field: creditor_name' END, CASE WHEN account_type = '' THEN 'Missing required field: account_type' END, CASE WHEN TRY_CAST(regexp_replace(account_balance, '[$,]', '', 'g') AS DECIMAL(18, 2)) IS NULL THEN 'Invalid balance format' END,
    CASE WHEN date_opened <> '' AND NOT regexp_matches(date_opened, '^\d{4}-\d{2}-\d{2}$|^\d{2}/\d{2}/\d{4}$|^\d{2}-\d{2}-\d{4}$') THEN 'Invalid date_opened format' END], lambda x: x IS NOT NULL), '; ') AS errors, creditor_name <> '' AND account_number <> '' AND credit_bureau <> '' AS has_required,
    length(trim(creditor_name)) BETWEEN 2 AND 100 AND length(trim(account_number)) BETWEEN 1 AND 50 AS manual_ok FROM tradelines""")  # fmt: skip
def record_errors(v: Views) -> DataFrame:
    rules = [
        (c("creditor_name") == "", "Missing required field: creditor_name"),
        (c("account_type") == "", "Missing required field: account_type"),
        (F.regexp_replace("account_balance", "[$,]", "").try_cast("decimal(18,2)").isNull(), "Invalid balance format"),
        ((c("date_opened") != "") & ~c("date_opened").rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{2}/\d{2}/\d{4}$|^\d{2}-\d{2}-\d{4}$"), "Invalid date_opened format"),
    ]
    required = (c("creditor_name") != "") & (c("account_number") != "") & (c("credit_bureau") != "")
    manual = F.length(F.trim("creditor_name")).between(2, 100) & F.length(F.trim("account_number")).between(1, 50)
    return v.tradelines.select("id", F.array_join(F.array_compact(F.array(*[F.when(r, m) for r, m in rules])), "; ").alias("errors"), required.alias("has_required"), manual.alias("manual_ok"))


@query("V9_validation_issues", f"""WITH i AS (SELECT user_id, unnest(list_filter([CASE WHEN first_name = '' THEN 'missing_data' END, CASE WHEN acctbal > 9000 THEN 'data_range' END, CASE WHEN ssn <> '' AND NOT regexp_full_match(ssn, '\\d{{3}}-?\\d{{2}}-?\\d{{4}}') THEN 'format_error' END, CASE WHEN DATE '1980-01-02' + CAST(ord * 60 AS INTEGER) > DATE '{AS_OF}' THEN 'date_error' END], lambda x: x IS NOT NULL)) AS issue FROM profiles) SELECT * FROM i""")
def validation_issues(v: Views) -> DataFrame:
    """A row for each issue; "future" is after the given day."""
    rules = [
        (c("first_name") == "", "missing_data"),
        (c("acctbal") > 9000, "data_range"),
        ((c("ssn") != "") & ~c("ssn").rlike(r"^\d{3}-?\d{2}-?\d{4}$"), "format_error"),
        (F.date_add(F.lit("1980-01-02").cast("date"), (c("ord") * 60).cast("int")) > F.lit(AS_OF).cast("date"), "date_error"),
    ]
    return v.profiles.select("user_id", F.explode(F.array_compact(F.array(*[F.when(r, m) for r, m in rules]))).alias("issue"))


#: Amounts of an account that can be.
LEAST_BALANCE, MOST_BALANCE = 0, 100000


def account_issues(accounts: DataFrame, as_of: str) -> DataFrame:
    """Accounts (id, creditor_name, balance, date_opened, date_closed) to a row for each issue.

    An empty name is missing, an amount beyond the bounds out of range, a day after ``as_of`` an error, and a day of closing
    before that of opening inconsistent. Unknown amounts and days raise no issue.
    """
    today = F.lit(as_of).cast("date")
    rules = [
        (F.coalesce("creditor_name", F.lit("")) == "", "missing_data"),
        (~c("balance").between(LEAST_BALANCE, MOST_BALANCE), "data_range"),
        (F.greatest("date_opened", "date_closed") > today, "date_error"),
        (c("date_closed") < c("date_opened"), "date_inconsistency"),
    ]
    return accounts.select("id", F.explode(F.array_compact(F.array(*[F.when(r, m) for r, m in rules]))).alias("issue"))


@query("V9_account_issues", f"""SELECT id, issue FROM (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id, unnest(list_filter([CASE WHEN l_extendedprice NOT BETWEEN {LEAST_BALANCE} AND {MOST_BALANCE} THEN 'data_range' END, CASE WHEN greatest(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) > DATE '{AS_OF}' THEN 'date_error' END,
    CASE WHEN CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) THEN 'date_inconsistency' END], lambda x: x IS NOT NULL)) AS issue FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")  # fmt: skip
def lineitem_issues(v: Views) -> DataFrame:
    """Line items as accounts: opened when ordered, closed when shipped, which is often before."""
    both = v.table("lineitem").join(v.table("orders"), c("l_orderkey") == c("o_orderkey"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    accounts = both.select(key.alias("id"), F.lit("item").alias("creditor_name"), c("l_extendedprice").alias("balance"), c("o_orderdate").cast("date").alias("date_opened"), c("l_shipdate").cast("date").alias("date_closed"))
    return account_issues(accounts, AS_OF)


@query("V10_report_checks", r"""SELECT id, array_to_string(list_filter([CASE WHEN NOT regexp_full_match(user_id, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') THEN 'Invalid user_id format' END,
    CASE WHEN score NOT BETWEEN 300 AND 850 THEN 'Credit score must be between 300 and 850' END, CASE WHEN report_data = '' THEN 'Report data is required' END], lambda x: x IS NOT NULL), '; ') AS errors FROM credit_reports""")  # fmt: skip
def report_checks(v: Views) -> DataFrame:
    rules = [
        (~c("user_id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), "Invalid user_id format"),
        (~c("score").between(300, 850), "Credit score must be between 300 and 850"),
        (c("report_data") == "", "Report data is required"),
    ]
    return v.credit_reports.select("id", F.array_join(F.array_compact(F.array(*[F.when(r, m) for r, m in rules])), "; ").alias("errors"))


STATES_SQL = ", ".join(f"'{x}'" for x in STATES)


@query("V12_V13_profile_forms", r"""SELECT user_id, length(first_name) BETWEEN 1 AND 50 AS name_ok, state IN ({STATES_SQL}) AS state_ok, regexp_full_match(zip_code, '\d{5}(-\d{4})?') AS zip_ok, ssn = '' OR regexp_full_match(ssn, '\d{3}-?\d{2}-?\d{4}') AS ssn_ok, regexp_full_match(email, '[^@\s]+@[^@\s]+\.[^@\s]+') AS email_ok, regexp_matches(right(ssn, 4), '^\d{4}$') AS last_four_ok FROM profiles""".replace("{STATES_SQL}", STATES_SQL))
def profile_forms(v: Views) -> DataFrame:
    return v.profiles.select(
        "user_id",
        F.length("first_name").between(1, 50).alias("name_ok"),
        c("state").isin(STATES).alias("state_ok"),
        c("zip_code").rlike(r"^\d{5}(-\d{4})?$").alias("zip_ok"),
        ((c("ssn") == "") | c("ssn").rlike(r"^\d{3}-?\d{2}-?\d{4}$")).alias("ssn_ok"),
        c("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$").alias("email_ok"),
        F.right("ssn", F.lit(4)).rlike(r"^\d{4}$").alias("last_four_ok"),
    )


@query("D7_date_checks", rf"""SELECT id, CASE WHEN trim(date_opened) = '' THEN 'empty' WHEN NOT regexp_matches(trim(date_opened), '{DATE}') THEN 'unrecognized' WHEN {possible_day_sql("trim(date_opened)")} THEN 'valid' ELSE 'out of range' END AS verdict FROM tradelines
    UNION ALL SELECT 'X' || CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 32 > 12 OR o_orderkey % 32 = 0 OR o_orderkey % 40 = 0 OR o_orderkey % 40 > 31 THEN 'out of range' ELSE 'valid' END AS verdict FROM orders""")
def date_checks(v: Views) -> DataFrame:
    """Three formats, and a day that can be; the second half checks made-up days, which often cannot."""
    value = F.trim("date_opened")
    verdict = F.when(value == "", "empty").when(~value.rlike(DATE), "unrecognized").when(possible_day(value), "valid").otherwise("out of range")
    made = v.table("orders").select(F.concat(F.lit("X"), "o_orderkey").alias("id"), F.concat_ws("/", c("o_orderkey") % 32, c("o_orderkey") % 40, F.lit("1999")).alias("date_opened"))
    return v.tradelines.select("id", "date_opened").unionByName(made).select("id", verdict.alias("verdict"))
