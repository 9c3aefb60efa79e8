"""Duplicate resolution and progressive enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.empties import PLACEHOLDERS, is_empty_merge, is_placeholder, needs_enrichment
from ..plans.registry import query
from ..plans.views import Views
from .scalars import FIRST4_SQL

c = F.col
PLACE = "({0} IS NULL OR trim({0}) IN (" + ", ".join(f"'{x}'" for x in PLACEHOLDERS) + "))"
ENRICH = "({0} IS NULL OR {0} IN ('', '$0', '$0.00', '0'))"
KEY = ["user_id", "creditor_name", "first4", "date_opened", "credit_bureau"]
FIELDS = ["account_balance", "credit_limit", "monthly_payment", "account_status", "account_type"]


def keyed(t: DataFrame) -> DataFrame:
    return t.withColumn("first4", T.account_first_4(c("account_number")))


def fill(old: Column, new: Column) -> Column:
    """The old value, unless it is a placeholder and the new one is not."""
    return F.when(is_placeholder(old) & ~is_placeholder(new), new).otherwise(old)


#: Fields of the stored record that merging looks at.
STORED = ["id", "ord", "account_number", "dispute_count", "is_negative", "credit_bureau", "date_opened", *FIELDS]
SPLIT = f"""k AS (SELECT *, {FIRST4_SQL} AS first4 FROM tradelines), f AS (SELECT user_id, creditor_name, first4, date_opened, credit_bureau, min(ord) AS e_ord FROM k GROUP BY 1, 2, 3, 4, 5),
    n AS (SELECT k.*, {", ".join(f"e.{x} AS e_{x}" for x in STORED)} FROM k JOIN f USING (user_id, creditor_name, first4, date_opened, credit_bureau) LEFT JOIN tradelines e ON e.ord = f.e_ord AND f.e_ord < k.ord)"""


def met(v: Views) -> DataFrame:
    """Every record with the stored one: the first of its key, where that came before it (e_...; null where none did)."""
    k = keyed(v.tradelines)
    first = k.groupBy(*KEY).agg(F.min_by(F.struct(*STORED), "ord").alias("e"))
    both = k.join(first, KEY)
    return both.select(*k.columns, *[F.when(c("e.ord") < c("ord"), c(f"e.{x}")).alias(f"e_{x}") for x in STORED])


@query("M1_M2_M3_merge_records", f"""WITH {SPLIT} SELECT id, CASE WHEN {PLACE.format("creditor_name")} OR first4 = '' OR {PLACE.format("credit_bureau")} THEN 'INVALID_DATA' WHEN e_id IS NOT NULL THEN 'MERGED' ELSE 'NEW' END AS action, e_id AS existing_id,
    {", ".join(f"CASE WHEN e_id IS NOT NULL AND {PLACE.format(f'e_{x}')} AND NOT {PLACE.format(x)} THEN {x} ELSE e_{x} END AS {x}" for x in [*FIELDS, "date_opened"])},
    CASE WHEN e_id IS NOT NULL AND ({PLACE.format("e_account_number")} OR length(account_number) > length(e_account_number)) THEN account_number ELSE e_account_number END AS number, CASE WHEN e_id IS NOT NULL THEN greatest(e_dispute_count, dispute_count) END AS disputes FROM n""")  # fmt: skip
def merge_records(v: Views) -> DataFrame:
    """Each incoming record against the stored state: new, merged (placeholders filled) or invalid."""
    stored = c("e_id").isNotNull()
    invalid = is_placeholder(c("creditor_name")) | (c("first4") == "") | is_placeholder(c("credit_bureau"))
    longer = stored & (is_placeholder(c("e_account_number")) | (F.length("account_number") > F.length("e_account_number")))
    return met(v).select(
        "id",
        F.when(invalid, "INVALID_DATA").when(stored, "MERGED").otherwise("NEW").alias("action"),
        c("e_id").alias("existing_id"),
        *[F.when(stored, fill(c(f"e_{x}"), c(x))).alias(x) for x in [*FIELDS, "date_opened"]],
        F.when(longer, c("account_number")).otherwise(c("e_account_number")).alias("number"),
        F.when(stored, F.greatest("e_dispute_count", "dispute_count")).alias("disputes"),
    )


@query("M4_save_outcome", f"""WITH {SPLIT} SELECT id, CASE WHEN creditor_name = '' OR account_number = '' OR credit_bureau = '' OR date_opened = '' THEN 'skipped: partial' WHEN e_id IS NULL THEN 'inserted' WHEN {" OR ".join(f"({ENRICH.format(f'e_{x}')} AND NOT {ENRICH.format(x)})" for x in FIELDS)} THEN 'updated' ELSE 'skipped: complete' END AS outcome,
    array_to_string(list_filter([{", ".join(f"CASE WHEN e_id IS NOT NULL AND {ENRICH.format(f'e_{x}')} AND NOT {ENRICH.format(x)} THEN '{x}' END" for x in FIELDS)}], lambda x: x IS NOT NULL), ',') AS enriched FROM n""")  # fmt: skip
def save_outcome(v: Views) -> DataFrame:
    """What becomes of each record, and the fields of the stored one that it enriches."""
    partial = (c("creditor_name") == "") | (c("account_number") == "") | (c("credit_bureau") == "") | (c("date_opened") == "")
    gains = {x: c("e_id").isNotNull() & needs_enrichment(c(f"e_{x}")) & ~needs_enrichment(c(x)) for x in FIELDS}
    some = F.array_compact(F.array(*[F.when(g, x) for x, g in gains.items()]))
    outcome = F.when(partial, "skipped: partial").when(c("e_id").isNull(), "inserted").when(F.size(some) > 0, "updated").otherwise("skipped: complete")
    return met(v).select("id", outcome.alias("outcome"), F.array_join(some, ",").alias("enriched"))


def fold(field: str, order: str = "ord") -> Column:
    """What a record holds after all arrivals in order: the first value that needs no enrichment, else the last one."""
    value = c(field)
    return F.coalesce(F.min_by(value, F.when(~needs_enrichment(value), c(order))), F.max_by(value, order))


@query("M6_W10_sequential_enrichment", f"""WITH k AS (SELECT *, {FIRST4_SQL} AS first4 FROM tradelines WHERE date_opened <> '' AND credit_bureau <> '') SELECT user_id, creditor_name, first4, date_opened, credit_bureau, min_by(id, ord) AS id, count(*) AS arrivals,
    {", ".join(f"coalesce(min_by({f}, ord) FILTER (WHERE NOT {ENRICH.format(f)}), max_by({f}, ord)) AS {f}" for f in FIELDS)} FROM k GROUP BY 1, 2, 3, 4, 5""")  # fmt: skip
def sequential_enrichment(v: Views) -> DataFrame:
    """The fold over arrivals as an aggregate: it combines map-side, whatever the number of arrivals of a key."""
    k = keyed(v.tradelines.where("date_opened <> '' and credit_bureau <> ''"))
    return k.groupBy(*KEY).agg(F.min_by("id", "ord").alias("id"), F.count("*").alias("arrivals"), *[fold(f).alias(f) for f in FIELDS])


EMPTY = "({0} IS NULL OR {0} IN ('', '$0'))"


CHANGES = [*FIELDS, "credit_bureau"]


@query("M7_sparse_update", f"""WITH {SPLIT} SELECT id, {", ".join(f"CASE WHEN {EMPTY.format(f'e_{x}')} AND NOT {EMPTY.format(x)} THEN {x} END AS set_{x}" for x in CHANGES)}, CASE WHEN is_negative AND NOT e_is_negative THEN true END AS set_negative FROM n WHERE e_id IS NOT NULL""")
def sparse_update(v: Views) -> DataFrame:
    """Only the fields that change; null leaves a field as it is, and negative stays once it is set."""
    changes = [F.when(is_empty_merge(c(f"e_{x}")) & ~is_empty_merge(c(x)), c(x)).alias(f"set_{x}") for x in CHANGES]
    return met(v).where(c("e_id").isNotNull()).select("id", *changes, F.when(c("is_negative") & ~c("e_is_negative"), True).alias("set_negative"))


@query("M8_validate_and_fix", "SELECT id, upper(trim(creditor_name)) AS creditor_name, coalesce(nullif(credit_bureau, ''), 'Unknown') AS credit_bureau, coalesce(nullif(account_type, ''), 'other') AS account_type FROM tradelines WHERE trim(creditor_name) <> ''")
def validate_and_fix(v: Views) -> DataFrame:
    return v.tradelines.where(F.trim("creditor_name") != "").select("id", F.upper(F.trim("creditor_name")).alias("creditor_name"), F.coalesce(F.nullif("credit_bureau", F.lit("")), F.lit("Unknown")).alias("credit_bureau"), F.coalesce(F.nullif("account_type", F.lit("")), F.lit("other")).alias("account_type"))


@query("M10_potential_duplicates", "SELECT user_id, creditor_name, account_number, count(*) AS n, min(id) AS first_id FROM tradelines WHERE creditor_name <> '' AND account_number <> '' GROUP BY 1, 2, 3 HAVING count(*) > 1")
def potential_duplicates(v: Views) -> DataFrame:
    """One row for each group of equal records, never one for each pair."""
    rows = v.tradelines.where("creditor_name <> '' and account_number <> ''")
    return rows.groupBy("user_id", "creditor_name", "account_number").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")
