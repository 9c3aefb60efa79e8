"""Who may see and change what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..plans.views import AS_OF, Views
from .scalars import FIRST4_SQL

c = F.col


@query("P1_sql_function", f"SELECT id, {FIRST4_SQL} AS first4 FROM tradelines")
def sql_function(v: Views) -> DataFrame:
    """The account prefix as a SQL function of the session."""
    v.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION account_first_4(a STRING) RETURNS STRING RETURN upper(left(regexp_replace(coalesce(a, ''), '[^A-Za-z0-9]', ''), 4))")
    return v.tradelines.select("id", F.expr("account_first_4(account_number)").alias("first4"))


@query("P3_P4_triggers", f"""SELECT p.user_id, p.email, DATE '{AS_OF}' AS updated_at, 'kept' AS origin FROM profiles p WHERE ord % 2 = 0 UNION ALL SELECT p.user_id, p.email, DATE '{AS_OF}', 'created' FROM profiles p WHERE ord % 2 = 1""")
def triggers(v: Views) -> DataFrame:
    """New users get a profile, existing ones are left alone; writes stamp the day."""
    have, users = v.profiles.where("ord % 2 = 0").select("user_id", "email"), v.profiles.select("user_id", "email")
    made = users.join(have.select("user_id"), "user_id", "left_anti")
    out = have.withColumn("origin", F.lit("kept")).unionByName(made.withColumn("origin", F.lit("created")))
    return out.withColumn("updated_at", F.lit(AS_OF).cast("date"))


def visible_to(rows: DataFrame, principal: str) -> DataFrame:
    """Row-level security: a principal sees own rows only; the predicate reaches the scan."""
    return rows.where(c("user_id") == principal)


@query("P5_row_security", "SELECT 'row' AS kind, id FROM tradelines WHERE user_id = 'U11' UNION ALL SELECT 'file', id FROM user_documents WHERE split_part(file_path, '/', 1) = 'U11'")
def row_security(v: Views) -> DataFrame:
    own = visible_to(v.tradelines, "U11").select(F.lit("row").alias("kind"), "id")
    files = v.user_documents.where(F.split_part("file_path", F.lit("/"), F.lit(1)) == "U11").select(F.lit("file").alias("kind"), "id")
    return own.unionByName(files)


@query("P6_admin_audit", "SELECT d.id FROM disputes d WHERE status = 'rejected' AND EXISTS (SELECT 1 FROM user_roles r WHERE r.role = 'admin' AND r.user_id = 'U6')")
def admin_audit(v: Views) -> DataFrame:
    admin = v.user_roles.where("role = 'admin' and user_id = 'U6'").select(F.lit(1).alias("one")).limit(1)
    return v.disputes.where("status = 'rejected'").select("id", F.lit(1).alias("one")).join(F.broadcast(admin), "one", "left_semi").select("id")


@query("P7_role_changes", """SELECT user_id, role, 'kept' AS entry FROM user_roles WHERE user_id <> 'U6' UNION ALL SELECT 'U7', 'admin', 'granted' UNION ALL SELECT user_id, role, 'revoked' FROM user_roles WHERE user_id = 'U6'""")
def role_changes(v: Views) -> DataFrame:
    """A grant and a revocation as a new set of rows with the log of both."""
    roles = v.user_roles
    granted = v.spark.createDataFrame([("U7", "admin", "granted")], "user_id string, role string, entry string")
    return roles.where("user_id <> 'U6'").withColumn("entry", F.lit("kept")).unionByName(granted).unionByName(roles.where("user_id = 'U6'").withColumn("entry", F.lit("revoked")))


@query("P8_P9_constraint_checks", f"""SELECT user_id, creditor_name, {FIRST4_SQL} AS first4, date_opened, credit_bureau, count(*) AS n FROM tradelines WHERE creditor_name <> '' AND account_number <> '' AND date_opened <> '' AND credit_bureau <> '' AND regexp_matches('credit-reports/' || user_id, '^credit-reports/.*') GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1""")
def constraint_checks(v: Views) -> DataFrame:
    """Keys that break the partial unique index: rows with an empty part are outside it."""
    rows = v.tradelines.where("creditor_name <> '' and account_number <> '' and date_opened <> '' and credit_bureau <> ''").where(F.concat(F.lit("credit-reports/"), "user_id").rlike("^credit-reports/.*"))
    return rows.groupBy("user_id", "creditor_name", T.account_first_4(c("account_number")).alias("first4"), "date_opened", "credit_bureau").agg(F.count("*").alias("n")).where("n > 1")
