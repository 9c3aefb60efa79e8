"""Keyed changes on immutable tables: inserts, updates, deletes and upserts as joins that return the new state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import Views

c = F.col


def updated(state: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``state`` with the non-null fields of ``changes`` (one row for each key)."""
    fields = [f for f in changes.columns if f not in key]
    renamed = changes.select(*key, *[c(f).alias(f"_{f}") for f in fields])
    return state.join(renamed, key, "left").select(*[F.coalesce(f"_{f}", f).alias(f) if f in fields else c(f) for f in state.columns])


def deleted(state: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return state.join(keys.select(*key), key, "left_anti").select(*state.columns)


def last_of(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key: within one batch the last one wins."""
    latest = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k")


def upserted(state: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """Insert or overwrite by key: incoming rows win."""
    new = last_of(incoming, key, order)
    return deleted(state, new, key).unionByName(new)


@query("S3_R5_job_state", "SELECT user_id AS job_id, max_by(status, ord) AS status, max(ord) AS version, arg_max_null(CASE WHEN status = 'resolved' THEN updated_on END, ord) AS completed_on FROM disputes GROUP BY user_id")
def job_state(v: Views) -> DataFrame:
    """The latest status of each job; only a completed one has a day of completion."""
    done = F.when(c("status") == "resolved", c("updated_on"))
    latest = F.max(F.struct("ord", "status", done.alias("done"))).alias("x")
    return v.disputes.groupBy(c("user_id").alias("job_id")).agg(latest).select("job_id", "x.status", c("x.ord").alias("version"), c("x.done").alias("completed_on"))


@query("S4_S6_chunk_results", "SELECT 'job_' || user_id || '_chunk_' || CAST(ord % 12 AS VARCHAR) || '.json' AS name, CAST(ord % 12 AS INTEGER) AS chunk, count(*) AS n FROM disputes GROUP BY 1, 2")
def chunk_results(v: Views) -> DataFrame:
    """Chunk numbers from result names, as numbers, so that 10 comes after 9."""
    names = v.disputes.select(F.concat(F.lit("job_"), "user_id", F.lit("_chunk_"), (c("ord") % 12).cast("string"), F.lit(".json")).alias("name"))
    return names.groupBy("name", F.regexp_extract("name", r"_chunk_(\d+)\.json$", 1).cast("int").alias("chunk")).agg(F.count("*").alias("n"))


@query("S18_scan", "SELECT id, credit_bureau FROM tradelines WHERE user_id = 'U3'")
def scan(v: Views) -> DataFrame:
    return v.tradelines.where(c("user_id") == "U3").select("id", "credit_bureau")


@query("S19_S20_keyed_changes", "SELECT id, CASE WHEN ord % 4 = 0 THEN 'Closed' ELSE account_status END AS account_status FROM tradelines WHERE ord % 5 <> 0 UNION ALL SELECT 'X' || id, 'New' FROM tradelines WHERE ord % 50 = 0")
def keyed_changes(v: Views) -> DataFrame:
    """Updates, deletes and inserts of one batch."""
    state = v.tradelines.select("id", "account_status")
    changes = v.tradelines.where("ord % 4 = 0").select("id", F.lit("Closed").alias("account_status"))
    gone = v.tradelines.where("ord % 5 = 0").select("id")
    new = v.tradelines.where("ord % 50 = 0").select(F.concat(F.lit("X"), "id").alias("id"), F.lit("New").alias("account_status"))
    return deleted(updated(state, changes, ["id"]), gone, ["id"]).unionByName(new)


@query("S21_S30_upsert", """WITH n AS (SELECT user_id, creditor_name, credit_bureau, max_by(account_balance, ord) AS account_balance, max(ord) AS ord FROM tradelines WHERE ord % 2 = 0 GROUP BY 1, 2, 3), o AS (SELECT user_id, creditor_name, credit_bureau, max_by(account_balance, ord) AS account_balance, max(ord) AS ord FROM tradelines WHERE ord % 2 = 1 GROUP BY 1, 2, 3)
    SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = o.user_id AND n.creditor_name = o.creditor_name AND n.credit_bureau = o.credit_bureau)""")  # fmt: skip
def upsert(v: Views) -> DataFrame:
    key = ["user_id", "creditor_name", "credit_bureau"]
    rows = v.tradelines.select(*key, "account_balance", "ord")
    return upserted(last_of(rows.where("ord % 2 = 1"), key, "ord"), rows.where("ord % 2 = 0"), key, "ord")


def single(rows: DataFrame) -> DataFrame:
    """Exactly one row, or an error when the result is read."""
    n = rows.agg(F.count("*").alias("_n"))
    checked = n.select(F.assert_true(c("_n") == 1, F.lit("expected exactly one row")).alias("_ok"))
    return rows.join(F.broadcast(checked)).where(c("_ok").isNull()).drop("_ok")


def maybe_single(rows: DataFrame) -> DataFrame:
    n = rows.agg(F.count("*").alias("_n"))
    checked = n.select(F.assert_true(c("_n") <= 1, F.lit("expected at most one row")).alias("_ok"))
    return rows.join(F.broadcast(checked)).where(c("_ok").isNull()).drop("_ok")


@query("S29_single", "SELECT user_id, email FROM profiles WHERE user_id = 'U5'")
def single_profile(v: Views) -> DataFrame:
    return single(v.profiles.where(c("user_id") == "U5").select("user_id", "email"))
