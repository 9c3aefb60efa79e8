"""Counts, distributions, timelines and pivots.  Spines keep groups without rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import categories as C
from ..functions import dates as D
from ..functions import text as T
from ..functions.money import digits_value
from ..plans.registry import query
from ..plans.views import AS_OF, Views
from .joins import BUREAUS, bureaus
from .scalars import FIRST4_SQL, MATCH_SQL, PARSE

c = F.col
DAY = f"DATE '{AS_OF}'"
ACTIVE = ["pending", "in_progress", "processing", "submitted"]


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def percent(part: Column, whole: Column) -> Column:
    """Half-up whole percent; 0 where there is nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole + 0.5)).otherwise(0).cast("long")


def percent_sql(part: str, whole: str) -> str:
    return f"CAST(CASE WHEN {whole} > 0 THEN floor({part} * 100 / {whole} + 0.5) ELSE 0 END AS BIGINT)"


@query("A1_dashboard_totals", """SELECT coalesce(t.user_id, d.user_id) AS user_id, coalesce(total, 0) AS tradelines, coalesce(negative, 0) AS negative, coalesce(total, 0) - coalesce(negative, 0) AS positive, coalesce(disputes, 0) AS disputes, coalesce(active, 0) AS active, coalesce(resolved, 0) AS resolved
    FROM (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE is_negative) AS negative FROM tradelines GROUP BY 1) t FULL JOIN (SELECT user_id, count(*) AS disputes, count(*) FILTER (WHERE status IN ('pending', 'in_progress', 'processing', 'submitted')) AS active, count(*) FILTER (WHERE status = 'resolved') AS resolved FROM disputes GROUP BY 1) d ON t.user_id = d.user_id""")  # fmt: skip
def dashboard_totals(v: Views) -> DataFrame:
    t = v.tradelines.groupBy("user_id").agg(F.count("*").alias("t"), F.count_if("is_negative").alias("n"))
    d = v.disputes.groupBy("user_id").agg(F.count("*").alias("d"), F.count_if(c("status").isin(ACTIVE)).alias("a"), F.count_if(c("status") == "resolved").alias("r"))
    n = {x: F.coalesce(x, F.lit(0)) for x in "tndar"}
    return t.join(d, "user_id", "full").select("user_id", n["t"].alias("tradelines"), n["n"].alias("negative"), (n["t"] - n["n"]).alias("positive"), n["d"].alias("disputes"), n["a"].alias("active"), n["r"].alias("resolved"))


@query("A2_percentages", f"SELECT user_id, {percent_sql('count(*) FILTER (WHERE is_negative)', 'count(*)')} AS negative_percent, {percent_sql('''count(*) FILTER (WHERE account_status = 'Paid')''', '''count(*) FILTER (WHERE credit_bureau = '')''')} AS paid_percent FROM tradelines GROUP BY user_id")
def percentages(v: Views) -> DataFrame:
    return v.tradelines.groupBy("user_id").agg(percent(F.count_if("is_negative"), F.count("*")).alias("negative_percent"), percent(F.count_if(c("account_status") == "Paid"), F.count_if(c("credit_bureau") == "")).alias("paid_percent"))


@query("A3_bureau_distribution", "SELECT user_id, count(*) FILTER (WHERE credit_bureau = 'Experian') AS experian, count(*) FILTER (WHERE credit_bureau = 'Equifax') AS equifax, count(*) FILTER (WHERE credit_bureau = 'TransUnion') AS transunion FROM tradelines GROUP BY user_id")
def bureau_distribution(v: Views) -> DataFrame:
    return v.tradelines.groupBy("user_id").agg(*[F.count_if(c("credit_bureau") == b).alias(b.lower()) for b in BUREAUS])


@query("A4_recent_activity", f"SELECT user_id, count(*) FILTER (WHERE created_on >= {DAY} - 30) AS new_disputes, count(*) FILTER (WHERE status = 'resolved' AND updated_on >= {DAY} - 30) AS resolved FROM disputes GROUP BY user_id")
def recent_activity(v: Views) -> DataFrame:
    since = F.date_sub(as_of(), 30)
    return v.disputes.groupBy("user_id").agg(F.count_if(c("created_on") >= since).alias("new_disputes"), F.count_if((c("status") == "resolved") & (c("updated_on") >= since)).alias("resolved"))


@query("A5_A9_status_distribution", """WITH b AS (SELECT CASE WHEN status IN ('pending', 'generated') THEN 'pending' WHEN status IN ('in_progress', 'processing', 'submitted') THEN 'in_progress' ELSE status END AS bucket, count(*) AS n FROM disputes GROUP BY 1),
    s AS (SELECT unnest(['pending', 'in_progress', 'resolved', 'rejected', 'escalated']) AS bucket) SELECT s.bucket, coalesce(n, 0) AS n, CAST(floor(coalesce(n, 0) * 100 / (SELECT sum(n) FROM b) + 0.5) AS BIGINT) AS percent FROM s LEFT JOIN b ON s.bucket = b.bucket""")  # fmt: skip
def status_distribution(v: Views) -> DataFrame:
    bucket = F.when(c("status").isin("pending", "generated"), "pending").when(c("status").isin("in_progress", "processing", "submitted"), "in_progress").otherwise(c("status"))
    counts = v.disputes.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    spine = v.spark.createDataFrame([(b,) for b in ("pending", "in_progress", "resolved", "rejected", "escalated")], "bucket string")
    total = counts.agg(F.sum("n").alias("total"))
    n = F.coalesce("n", F.lit(0))
    return spine.join(counts, "bucket", "left").join(F.broadcast(total)).select("bucket", n.alias("n"), percent(n, c("total")).alias("percent"))


@query("A6_monthly_timeline", f"""WITH m AS (SELECT CAST(unnest(generate_series(DATE '2001-03-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS DATE) AS month), n AS (SELECT date_trunc('month', created_on)::DATE AS month, count(*) AS n FROM disputes GROUP BY 1), r AS (SELECT date_trunc('month', updated_on)::DATE AS month, count(*) AS r FROM disputes WHERE status = 'resolved' GROUP BY 1)
    SELECT strftime(m.month, '%Y-%m') AS month, coalesce(n, 0) AS new_disputes, coalesce(r, 0) AS resolved FROM m LEFT JOIN n ON m.month = n.month LEFT JOIN r ON m.month = r.month WHERE m.month <= {DAY}""")  # fmt: skip
def monthly_timeline(v: Views) -> DataFrame:
    spine = v.spark.range(1).select(F.explode(F.sequence(F.add_months(F.trunc(as_of(), "month"), -5), F.trunc(as_of(), "month"), F.expr("interval 1 month"))).alias("month"))
    new = v.disputes.groupBy(F.trunc("created_on", "month").alias("month")).agg(F.count("*").alias("n"))
    done = v.disputes.where(c("status") == "resolved").groupBy(F.trunc("updated_on", "month").alias("month")).agg(F.count("*").alias("r"))
    return spine.join(new, "month", "left").join(done, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("new_disputes"), F.coalesce("r", F.lit(0)).alias("resolved"))


@query("A7_daily_timeline", f"""WITH s AS (SELECT CAST(unnest(generate_series({DAY} - 29, {DAY}, INTERVAL 1 DAY)) AS DATE) AS day), k AS (SELECT created_on AS day, id FROM disputes UNION SELECT updated_on, id FROM disputes)
    SELECT s.day, count(k.id) AS n FROM s LEFT JOIN k ON s.day = k.day GROUP BY s.day""")  # fmt: skip
def daily_timeline(v: Views) -> DataFrame:
    """Created or updated that day: both days as keys, each dispute once a day."""
    spine = v.spark.range(1).select(F.explode(F.sequence(F.date_sub(as_of(), 29), as_of())).alias("day"))
    days = v.disputes.select("id", F.explode(F.array_distinct(F.array("created_on", "updated_on"))).alias("day"))
    counts = days.where(c("day").between(F.date_sub(as_of(), 29), as_of())).groupBy("day").agg(F.count("*").alias("n"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("A8_W8_percent_of_total", "SELECT bureau, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1)::DOUBLE AS percent FROM disputes GROUP BY bureau")
def percent_of_total(v: Views) -> DataFrame:
    counts = v.disputes.groupBy("bureau").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("bureau", "n", F.round(c("n") * 100.0 / c("total"), 1).alias("percent"))


@query("A10_A11_ages_and_potential", f"""SELECT user_id, CAST(floor(avg(CASE WHEN ord % 6 = 0 THEN 18 ELSE (2001 - year(created_on)) * 12 + 8 - month(created_on) END) + 0.5) AS BIGINT) AS average_age, 15 * count(*) FILTER (WHERE is_negative) + 25 * count(*) FILTER (WHERE dispute_count > 0) AS potential FROM tradelines WHERE {DAY} IS NOT NULL GROUP BY user_id""")
def ages_and_potential(v: Views) -> DataFrame:
    """Months since a record was opened (18 where that is unknown), and points that disputes may bring."""
    months = (F.year(as_of()) - F.year("created_on")) * 12 + F.month(as_of()) - F.month("created_on")
    known = F.when(c("ord") % 6 != 0, months)
    return v.tradelines.groupBy("user_id").agg(F.floor(F.avg(F.coalesce(known, F.lit(18))) + 0.5).cast("long").alias("average_age"), (15 * F.count_if("is_negative") + 25 * F.count_if(c("dispute_count") > 0)).alias("potential"))


@query("A12_bureau_summary", "SELECT b.bureau, count(t.id) AS total, count(t.id) FILTER (WHERE is_negative) AS negative, count(t.id) FILTER (WHERE NOT is_negative) AS positive FROM (VALUES ('Experian'), ('Equifax'), ('TransUnion')) b(bureau) LEFT JOIN tradelines t ON t.credit_bureau = b.bureau GROUP BY b.bureau")
def bureau_summary(v: Views) -> DataFrame:
    counts = v.tradelines.groupBy(c("credit_bureau").alias("bureau")).agg(F.count("*").alias("total"), F.count_if("is_negative").alias("negative"))
    zero = F.lit(0)
    return bureaus(v).join(counts, "bureau", "left").select("bureau", F.coalesce("total", zero).alias("total"), F.coalesce("negative", zero).alias("negative"), (F.coalesce("total", zero) - F.coalesce("negative", zero)).alias("positive"))


@query("A13_bureau_discrepancies", """WITH g AS (SELECT user_id, creditor_name || '-' || account_number AS key, list_sort(list(DISTINCT credit_bureau)) AS present FROM tradelines WHERE credit_bureau <> '' GROUP BY 1, 2)
    SELECT user_id, key, array_to_string(present, ',') AS present_on, array_to_string(list_filter(['Experian', 'Equifax', 'TransUnion'], lambda x: NOT list_contains(present, x)), ',') AS missing_from FROM g WHERE len(present) < 3""")  # fmt: skip
def bureau_discrepancies(v: Views) -> DataFrame:
    """The set of a key's bureaus has three values at most, so it may be collected."""
    groups = v.tradelines.where(c("credit_bureau") != "").groupBy("user_id", F.concat("creditor_name", F.lit("-"), "account_number").alias("key")).agg(F.sort_array(F.collect_set("credit_bureau")).alias("present"))
    return groups.where(F.size("present") < 3).select("user_id", "key", F.array_join("present", ",").alias("present_on"), F.array_join(F.array_except(F.array(*[F.lit(b) for b in BUREAUS]), "present"), ",").alias("missing_from"))


@query("A14_pivot_by_account", "SELECT user_id, creditor_name || '|' || account_number AS key, " + ", ".join(f"max_by(account_balance, ord) FILTER (WHERE credit_bureau = '{b}') AS {b.lower()}" for b in BUREAUS) + " FROM tradelines GROUP BY 1, 2")
def pivot_by_account(v: Views) -> DataFrame:
    """One column for each bureau; its last record wins."""
    keyed = v.tradelines.select("user_id", F.concat("creditor_name", F.lit("|"), "account_number").alias("key"), "credit_bureau", "account_balance", "ord")
    pivoted = keyed.groupBy("user_id", "key").pivot("credit_bureau", BUREAUS).agg(F.max_by("account_balance", "ord"))
    return pivoted.select("user_id", "key", *[c(b).alias(b.lower()) for b in BUREAUS])


@query("A15_inconsistent_values", "SELECT user_id, creditor_name, count(DISTINCT nullif(account_balance, '')) > 1 AS balance_differs, count(DISTINCT nullif(account_status, '')) > 1 AS status_differs FROM tradelines GROUP BY user_id, creditor_name")
def inconsistent_values(v: Views) -> DataFrame:
    """Least and greatest tell whether there are several values, without a distinct aggregate."""
    named = {n: F.nullif(c(f), F.lit("")) for n, f in (("balance_differs", "account_balance"), ("status_differs", "account_status"))}
    return v.tradelines.groupBy("user_id", "creditor_name").agg(*[F.coalesce(F.min(x) < F.max(x), F.lit(False)).alias(n) for n, x in named.items()])


@query("A16_letters_by_bureau", "SELECT user_id, credit_bureau, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT user_id, coalesce(nullif(credit_bureau, ''), 'Experian') AS credit_bureau, id FROM tradelines WHERE is_negative) GROUP BY 1, 2")
def letters_by_bureau(v: Views) -> DataFrame:
    rows = v.tradelines.where("is_negative").select("user_id", F.coalesce(F.nullif("credit_bureau", F.lit("")), F.lit("Experian")).alias("credit_bureau"), "id")
    return rows.groupBy("user_id", "credit_bureau").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))


@query("A17_A33_group_unknown", "SELECT coalesce(nullif(credit_bureau, ''), 'Unknown') AS bureau, coalesce(nullif(account_status, ''), 'Unknown') AS condition, count(*) AS n FROM tradelines GROUP BY 1, 2")
def group_unknown(v: Views) -> DataFrame:
    known = [F.coalesce(F.nullif(c(f), F.lit("")), F.lit("Unknown")).alias(n) for f, n in (("credit_bureau", "bureau"), ("account_status", "condition"))]
    return v.tradelines.groupBy(*known).agg(F.count("*").alias("n"))


NUMBER = "TRY_CAST(nullif(regexp_replace(coalesce({}, ''), '[^0-9.]', '', 'g'), '') AS DOUBLE)"


@query("A18_credit_utilization", f"SELECT user_id, CASE WHEN sum({NUMBER.format('credit_limit')}) FILTER (WHERE account_type = 'Credit Card') > 0 THEN round(coalesce(sum({NUMBER.format('account_balance')}) FILTER (WHERE account_type = 'Credit Card'), 0) * 100 / sum({NUMBER.format('credit_limit')}) FILTER (WHERE account_type = 'Credit Card'), 2) ELSE 0 END AS utilization FROM tradelines GROUP BY user_id")
def credit_utilization(v: Views) -> DataFrame:
    card = c("account_type") == "Credit Card"
    limit, balance = (F.sum(F.when(card, digits_value(c(f)))) for f in ("credit_limit", "account_balance"))
    return v.tradelines.groupBy("user_id").agg(F.when(limit > 0, F.round(F.coalesce(balance, F.lit(0.0)) * 100 / limit, 2)).otherwise(0.0).alias("utilization"))


@query("A19_type_histogram", "SELECT user_id, account_type, count(*) AS n, count(*) FILTER (WHERE is_negative) AS negative FROM tradelines GROUP BY 1, 2")
def type_histogram(v: Views) -> DataFrame:
    return v.tradelines.groupBy("user_id", "account_type").agg(F.count("*").alias("n"), F.count_if("is_negative").alias("negative"))


@query("A21_W2_combined_chunks", """WITH k AS (SELECT user_id AS job, ord AS chunk, CAST(ord % 31 AS BIGINT) AS pages, (ord % 10) / 10.0::DOUBLE AS confidence, id AS text FROM disputes)
    SELECT job, sum(pages)::BIGINT AS pages, round(avg(confidence), 6) AS confidence, string_agg(text, chr(10) ORDER BY chunk) AS text, string_agg(CAST("offset" AS VARCHAR), ',' ORDER BY chunk) AS offsets
    FROM (SELECT *, coalesce(sum(pages) OVER (PARTITION BY job ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM k) GROUP BY job""")  # fmt: skip
def combined_chunks(v: Views) -> DataFrame:
    """A job's chunks in order: text joined, pages added, confidences averaged, and the first page of each chunk."""
    k = v.disputes.select(c("user_id").alias("job"), c("ord").alias("chunk"), (c("ord") % 31).alias("pages"), ((c("ord") % 10) / 10.0).alias("confidence"), c("id").alias("text"))
    grouped = k.groupBy("job").agg(F.sum("pages").alias("total"), F.round(F.avg("confidence"), 6).alias("confidence"), F.sort_array(F.collect_list(F.struct("chunk", "pages", "text"))).alias("x"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    offsets = F.aggregate("x", start, lambda acc, p: F.struct((acc["at"] + p["pages"]).alias("at"), F.concat(acc["out"], F.array(acc["at"].cast("string"))).alias("out")), lambda acc: acc["out"])
    return grouped.select("job", c("total").alias("pages"), "confidence", F.array_join(F.transform("x", lambda p: p["text"]), "\n").alias("text"), F.array_join(offsets, ",").alias("offsets"))


@query("A25_token_usage", "SELECT conv_id, sum(CAST(floor(length(text) / 4) AS BIGINT))::BIGINT AS tokens, count(*) AS calls FROM conversations GROUP BY conv_id")
def token_usage(v: Views) -> DataFrame:
    return v.table("conversations").groupBy("conv_id").agg(F.sum(F.floor(F.length("text") / 4).cast("long")).alias("tokens"), F.count("*").alias("calls"))


@query("A26_term_counts", "SELECT ord, len(regexp_extract_all(text, '(?i)account|tradeline')) AS accounts, len(regexp_extract_all(text, '(?i)late|delinquent|collection|charge|bankruptcy')) AS negatives FROM reports")
def term_counts(v: Views) -> DataFrame:
    return v.reports.select("ord", F.regexp_count("text", F.lit("(?i)account|tradeline")).cast("long").alias("accounts"), F.regexp_count("text", F.lit("(?i)late|delinquent|collection|charge|bankruptcy")).cast("long").alias("negatives"))


#: Terms and creditors that keywords are taken from.
KEYWORDS = ["payment history", "credit utilization", "length of credit history", "credit mix", "new credit", "delinquent", "collection", "charge off", "bankruptcy", "foreclosure", "late payment", "credit score", "credit limit", "balance", "minimum payment", "apr", "interest rate"]
CREDITOR_WORDS = "CHASE|CITIBANK|BANK OF AMERICA|CAPITAL ONE|DISCOVER|AMEX|WELLS FARGO"


@query("A27_L12_U5_keywords", f"""SELECT ord, array_to_string(list_slice(list_concat(list_filter({KEYWORDS}, lambda k: contains(lower(text), k)), list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i){CREDITOR_WORDS}'), lambda x: upper(x))))), 1, 15), ',') AS keywords FROM reports""")
def keywords(v: Views) -> DataFrame:
    """Known terms in their order, then the creditors named, 15 at most."""
    low = F.lower("text")
    terms = F.array_compact(F.array(*[F.when(low.contains(k), k) for k in KEYWORDS]))
    creditors = F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(f"(?i){CREDITOR_WORDS}"), F.lit(0)), F.upper)))
    return v.reports.select("ord", F.array_join(F.slice(F.concat(terms, creditors), 1, 15), ",").alias("keywords"))


@query("A28_A29_record_counts", "SELECT user_id, count(*) FILTER (WHERE account_number <> '') AS with_number, count(*) FILTER (WHERE account_number = '') AS without_number, count(DISTINCT credit_bureau) AS bureaus FROM tradelines GROUP BY user_id")
def record_counts(v: Views) -> DataFrame:
    return v.tradelines.groupBy("user_id").agg(F.count_if(c("account_number") != "").alias("with_number"), F.count_if(c("account_number") == "").alias("without_number"), F.countDistinct("credit_bureau").alias("bureaus"))


@query("A31_quality_metrics", """SELECT user_id, round(avg((CASE WHEN creditor_name <> '' THEN 1 ELSE 0 END + CASE WHEN account_number <> '' THEN 1 ELSE 0 END + CASE WHEN account_status <> '' THEN 1 ELSE 0 END + CASE WHEN date_opened <> '' THEN 1 ELSE 0 END) / 4.0), 6)::DOUBLE AS completeness,
    round(avg(CASE WHEN credit_bureau <> '' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS consistency FROM tradelines GROUP BY user_id""")  # fmt: skip
def quality_metrics(v: Views) -> DataFrame:
    """Shares in [0, 1]: completeness, of four needed fields; consistency, of records with a known bureau."""
    filled = sum((c(f) != "").cast("int") for f in ("creditor_name", "account_number", "account_status", "date_opened"))
    return v.tradelines.groupBy("user_id").agg(F.round(F.avg(filled / 4.0), 6).alias("completeness"), F.round(F.avg((c("credit_bureau") != "").cast("double")), 6).alias("consistency"))


@query("A32_A34_page_statistics", f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_on DESC, ord DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS total FROM tradelines)
    SELECT user_id, max(total) AS total, count(*) FILTER (WHERE is_negative OR regexp_matches(lower(account_status), '{"|".join(C.NEGATIVE_TERMS)}')) AS negative_on_page FROM p WHERE rn <= 20 GROUP BY user_id""")  # fmt: skip
def page_statistics(v: Views) -> DataFrame:
    """The total is that of all rows, the negatives those of the first page."""
    total = v.tradelines.groupBy("user_id").agg(F.count("*").alias("total"))
    latest = Window.partitionBy("user_id").orderBy(F.desc("created_on"), F.desc("ord"))
    page = v.tradelines.select("user_id", "created_on", "ord", (c("is_negative") | C.is_negative_status(c("account_status"))).alias("bad")).withColumn("rn", F.row_number().over(latest)).where("rn <= 20")
    return page.groupBy("user_id").agg(F.count_if("bad").alias("negative_on_page")).join(total, "user_id").select("user_id", "total", "negative_on_page")


@query("flagship_ledger", f"""WITH k AS (SELECT user_id, ord, {MATCH_SQL} AS creditor, {FIRST4_SQL} AS first4, {PARSE} AS opened, credit_bureau, account_balance, credit_limit, is_negative FROM tradelines),
    m AS (SELECT user_id, creditor, first4, opened, credit_bureau, min_by(account_balance, ord) FILTER (WHERE account_balance NOT IN ('', '$0', '$0.00', '0')) AS balance, min_by(credit_limit, ord) FILTER (WHERE credit_limit NOT IN ('', '$0', '$0.00', '0')) AS lim, bool_or(is_negative) AS negative FROM k GROUP BY 1, 2, 3, 4, 5)
    SELECT user_id, credit_bureau, count(*) AS accounts, count(*) FILTER (WHERE negative) AS negative, coalesce(sum({NUMBER.format('balance')}), 0) AS balance, coalesce(sum({NUMBER.format('lim')}), 0) AS credit FROM m GROUP BY 1, 2""")  # fmt: skip
def flagship(v: Views) -> DataFrame:
    """Normalize, resolve duplicates with first-non-empty enrichment, then totals of each user and bureau."""
    k = v.tradelines.select("user_id", "ord", T.match_creditor(c("creditor_name")).alias("creditor"), T.account_first_4(c("account_number")).alias("first4"), D.to_date(c("date_opened")).alias("opened"), "credit_bureau", "account_balance", "credit_limit", "is_negative")

    def first_filled(f: str) -> Column:
        return F.min_by(f, F.when(~c(f).isin("", "$0", "$0.00", "0"), c("ord")))

    m = k.groupBy("user_id", "creditor", "first4", "opened", "credit_bureau").agg(first_filled("account_balance").alias("balance"), first_filled("credit_limit").alias("lim"), F.bool_or("is_negative").alias("negative"))
    money = [F.coalesce(F.sum(digits_value(c(f))), F.lit(0.0)).alias(n) for f, n in (("balance", "balance"), ("lim", "credit"))]
    return m.groupBy("user_id", "credit_bureau").agg(F.count("*").alias("accounts"), F.count_if("negative").alias("negative"), *money)
