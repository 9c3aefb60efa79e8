"""Joins: equi-joins with residual predicates; the three bureaus are the only broadcast side, of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..plans.registry import query
from ..plans.views import Views
from .scalars import FIRST4_SQL, MATCH_SQL, PARSE

c = F.col
BUREAUS = ["Experian", "Equifax", "TransUnion"]


def bureaus(v: Views) -> DataFrame:
    return v.spark.createDataFrame([(b,) for b in BUREAUS], "bureau string")


@query("J2_P7_admin_flags", "SELECT p.user_id, r.user_id IS NOT NULL AS is_admin FROM profiles p LEFT JOIN (SELECT DISTINCT user_id FROM user_roles) r ON p.user_id = r.user_id")
def admin_flags(v: Views) -> DataFrame:
    roles = v.user_roles.select("user_id").distinct().withColumn("is_admin", F.lit(True))
    return v.profiles.select("user_id").join(roles, "user_id", "left").select("user_id", F.coalesce("is_admin", F.lit(False)).alias("is_admin"))


@query("J3_selected_tradelines", "SELECT t.id, t.credit_bureau FROM tradelines t JOIN disputes d ON d.tradeline_id = t.id WHERE d.status = 'pending' AND t.credit_bureau <> ''")
def selected(v: Views) -> DataFrame:
    wanted = v.disputes.where(c("status") == "pending").select(c("tradeline_id").alias("id"))
    return v.tradelines.where(c("credit_bureau") != "").select("id", "credit_bureau").join(wanted, "id")


@query("J5_add_new_only", "SELECT id, 'kept' AS origin FROM tradelines WHERE ord % 3 = 0 UNION ALL SELECT id, 'added' FROM tradelines WHERE ord % 2 = 0 AND ord % 3 <> 0")
def add_new_only(v: Views) -> DataFrame:
    t = v.tradelines
    old, new = t.where(c("ord") % 3 == 0).select("id"), t.where(c("ord") % 2 == 0).select("id")
    return old.withColumn("origin", F.lit("kept")).unionByName(new.join(old, "id", "left_anti").withColumn("origin", F.lit("added")))


@query("J6_detailed_key_match", f"""WITH k AS (SELECT id, ord, user_id, creditor_name, date_opened, credit_bureau, {FIRST4_SQL} AS first4 FROM tradelines)
    SELECT i.id, min_by(e.id, e.ord) AS existing_id FROM k i JOIN k e ON i.user_id = e.user_id AND i.creditor_name = e.creditor_name AND i.date_opened = e.date_opened AND i.credit_bureau = e.credit_bureau AND i.first4 = e.first4 AND e.ord < i.ord GROUP BY i.id""")  # fmt: skip
def detailed_key_match(v: Views) -> DataFrame:
    """The first record with the same user, creditor, account prefix, date and bureau that came before.

    The first of a key is an aggregate, so a key's records never meet each other.
    """
    key = ["user_id", "creditor_name", "date_opened", "credit_bureau", "first4"]
    t = v.tradelines.withColumn("first4", T.account_first_4(c("account_number"))).select("id", "ord", *key)
    first = t.groupBy(*key).agg(F.min_by("id", "ord").alias("existing_id"), F.min("ord").alias("existing_ord"))
    return t.join(first, key).where("existing_ord < ord").select("id", "existing_id")


@query("J7_M5_fuzzy_match", f"""WITH k AS (SELECT id, ord, user_id, account_number, credit_bureau, {MATCH_SQL} AS creditor, left(regexp_replace(account_number, '[^0-9]', '', 'g'), 4) AS digits, coalesce(CAST({PARSE} AS VARCHAR), '') AS day FROM tradelines),
    m AS (SELECT i.id, e.id AS existing_id, e.ord AS existing_ord, i.account_number = 'Unknown' AND e.account_number = 'Unknown' AS unknown, i.digits = e.digits AND length(i.digits) = 4 AS account, i.day = e.day AND i.day <> '' AS dated
        FROM k i JOIN k e ON i.user_id = e.user_id AND i.creditor = e.creditor AND i.credit_bureau = e.credit_bureau WHERE e.ord < i.ord)
    SELECT id, min_by(existing_id, existing_ord) AS existing_id, CAST(min_by(50 + CASE WHEN unknown OR account THEN 25 ELSE 0 END + CASE WHEN dated THEN 25 ELSE 0 END, existing_ord) AS INTEGER) AS confidence, true AS creditor_match, min_by(unknown OR account, existing_ord) AS account_match, min_by(dated, existing_ord) AS date_match, true AS bureau_match
    FROM m WHERE unknown OR (account AND dated) GROUP BY id""")  # fmt: skip
def fuzzy_match(v: Views) -> DataFrame:
    """The first record that came before with the same user, normal creditor and bureau, and either the same four digits
    and day, or, like this one, no known number.

    The two ways exclude each other and are equi-joins with the first record of their keys, so the work grows with the
    rows and not with the square of a key's rows.
    """
    key = ["user_id", "creditor", "credit_bureau"]
    t = v.tradelines.select("id", "ord", "account_number", "user_id", "credit_bureau", T.match_creditor(c("creditor_name")).alias("creditor"), T.account_digits(c("account_number")).alias("digits"), D.iso(c("date_opened")).alias("day"))
    unknown, known = t.where("account_number = 'Unknown'"), t.where("length(digits) = 4 and day <> ''")
    first = [F.min("ord").alias("e_ord"), F.min_by("id", "ord").alias("existing_id")]
    blank = unknown.join(unknown.groupBy(*key).agg(*first, F.min_by("day", "ord").alias("e_day")), key).withColumn("date_match", (c("day") == c("e_day")) & (c("day") != ""))
    exact = known.join(known.groupBy(*key, "digits", "day").agg(*first), [*key, "digits", "day"]).withColumn("date_match", F.lit(True))
    both = blank.select("id", "ord", "e_ord", "existing_id", "date_match").unionByName(exact.select("id", "ord", "e_ord", "existing_id", "date_match")).where("e_ord < ord")
    yes = F.lit(True)
    return both.select("id", "existing_id", F.when(c("date_match"), 100).otherwise(75).alias("confidence"), yes.alias("creditor_match"), yes.alias("account_match"), "date_match", yes.alias("bureau_match"))


@query("J9_letters_for_bureaus", "SELECT b.bureau, t.id FROM (VALUES ('Experian'), ('Equifax'), ('TransUnion')) b(bureau) JOIN tradelines t ON t.credit_bureau = '' OR t.credit_bureau = b.bureau WHERE t.is_negative")
def letters_for_bureaus(v: Views) -> DataFrame:
    """A record without a bureau goes to all three: it is exploded, so no theta join is needed."""
    to = F.when(c("credit_bureau") == "", F.array(*[F.lit(b) for b in BUREAUS])).otherwise(F.array("credit_bureau"))
    return v.tradelines.where("is_negative").select(F.explode(to).alias("bureau"), "id")


@query("J10_A30_items_by_bureau", "SELECT bureau, count(DISTINCT id) AS n FROM (SELECT id, unnest(CASE WHEN ord % 3 = 0 THEN ['Experian', 'Equifax'] ELSE ['TransUnion'] END) AS bureau FROM tradelines) GROUP BY bureau")
def items_by_bureau(v: Views) -> DataFrame:
    lists = F.when(c("ord") % 3 == 0, F.array(F.lit("Experian"), F.lit("Equifax"))).otherwise(F.array(F.lit("TransUnion")))
    return v.tradelines.select("id", F.explode(lists).alias("bureau")).join(F.broadcast(bureaus(v)), "bureau").groupBy("bureau").agg(F.countDistinct("id").alias("n"))


@query("J11_A20_U2_U3_coverage", """WITH e AS (SELECT creditor_name, count(*) AS expected FROM tradelines WHERE ord % 3 <> 0 GROUP BY 1), a AS (SELECT creditor_name, count(*) AS actual FROM tradelines WHERE ord % 2 = 0 AND creditor_name <> 'USAA' GROUP BY 1)
    SELECT coalesce(e.creditor_name, a.creditor_name) AS creditor_name, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, least(coalesce(expected, 0), coalesce(actual, 0)) AS covered, a.creditor_name IS NULL AS missing FROM e FULL JOIN a ON e.creditor_name = a.creditor_name""")  # fmt: skip
def coverage(v: Views) -> DataFrame:
    t = v.tradelines
    expected = t.where(c("ord") % 3 != 0).groupBy("creditor_name").agg(F.count("*").alias("expected"))
    actual = t.where((c("ord") % 2 == 0) & (c("creditor_name") != "USAA")).groupBy("creditor_name").agg(F.count("*").alias("actual"))
    both = expected.join(actual, "creditor_name", "full")
    n = [F.coalesce(x, F.lit(0)) for x in ("expected", "actual")]
    return both.select("creditor_name", n[0].alias("expected"), n[1].alias("actual"), F.least(*n).alias("covered"), c("actual").isNull().alias("missing"))


@query("J12_dashboard_bundle", """SELECT p.user_id, coalesce(t.n, 0) AS tradelines, coalesce(d.n, 0) AS disputes, p.email FROM profiles p LEFT JOIN (SELECT user_id, count(*) AS n FROM tradelines GROUP BY 1) t ON p.user_id = t.user_id LEFT JOIN (SELECT user_id, count(*) AS n FROM disputes GROUP BY 1) d ON p.user_id = d.user_id""")
def dashboard_bundle(v: Views) -> DataFrame:
    """Each side is counted before it is joined, so the joins carry one row for each user."""
    t = v.tradelines.groupBy("user_id").agg(F.count("*").alias("t"))
    d = v.disputes.groupBy("user_id").agg(F.count("*").alias("d"))
    return v.profiles.select("user_id", "email").join(t, "user_id", "left").join(d, "user_id", "left").select("user_id", F.coalesce("t", F.lit(0)).alias("tradelines"), F.coalesce("d", F.lit(0)).alias("disputes"), "email")


@query("J13_chat_context", """WITH t AS (SELECT user_id, string_agg(id, ',' ORDER BY created_on DESC, ord DESC) AS tradelines FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_on DESC, ord DESC) AS rn FROM tradelines) WHERE rn <= 10 GROUP BY user_id),
    d AS (SELECT user_id, string_agg(id, ',' ORDER BY created_on DESC, ord DESC) AS disputes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_on DESC, ord DESC) AS rn FROM disputes) WHERE rn <= 5 GROUP BY user_id)
    SELECT p.user_id, first_name, coalesce(t.tradelines, '') AS tradelines, coalesce(d.disputes, '') AS disputes FROM profiles p LEFT JOIN t ON p.user_id = t.user_id LEFT JOIN d ON p.user_id = d.user_id""")  # fmt: skip
def chat_context(v: Views) -> DataFrame:
    latest = Window.partitionBy("user_id").orderBy(F.desc("created_on"), F.desc("ord"))

    def top(df: DataFrame, n: int, name: str) -> DataFrame:
        ranked = df.withColumn("rn", F.row_number().over(latest)).where(c("rn") <= n)
        return ranked.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]), ",").alias(name))

    out = v.profiles.select("user_id", "first_name").join(top(v.tradelines, 10, "tradelines"), "user_id", "left").join(top(v.disputes, 5, "disputes"), "user_id", "left")
    return out.select("user_id", "first_name", F.coalesce("tradelines", F.lit("")).alias("tradelines"), F.coalesce("disputes", F.lit("")).alias("disputes"))


@query("J14_P2_has_role", "SELECT user_id FROM profiles p WHERE EXISTS (SELECT 1 FROM user_roles r WHERE r.user_id = p.user_id AND r.role = 'admin')")
def has_role(v: Views) -> DataFrame:
    return v.profiles.select("user_id").join(v.user_roles.where(c("role") == "admin").select("user_id"), "user_id", "left_semi")
