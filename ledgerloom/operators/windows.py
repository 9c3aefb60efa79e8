"""Windows, order, limits, pages and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import AS_OF, Views

c = F.col


@query("W1_M9_first_per_key", "SELECT creditor_name, account_number, min_by(id, ord) AS id FROM tradelines GROUP BY 1, 2")
def first_per_key(v: Views) -> DataFrame:
    """The first record of a key wins: an aggregate with map-side combining, not a window."""
    return v.tradelines.groupBy("creditor_name", "account_number").agg(F.min_by("id", "ord").alias("id"))


LINES = "SELECT ord, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM reports"


@query("W3_W4_context_lines", f"""WITH l AS ({LINES}) SELECT ord, CAST(n AS INTEGER) AS n, trim(string_agg(line, ' ') OVER (PARTITION BY ord ORDER BY n ROWS BETWEEN 2 PRECEDING AND 4 FOLLOWING)) AS wide, trim(string_agg(line, ' ') OVER (PARTITION BY ord ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS narrow FROM l""")
def context_lines(v: Views) -> DataFrame:
    """Lines around each line, cut from the text's own array: no shuffle."""
    lines = v.reports.select("ord", F.split("text", "\n").alias("x")).select("ord", "x", F.posexplode("x").alias("n", "line"))

    def around(before: int, after: int):
        start = F.greatest(c("n") - before, F.lit(0))
        return F.trim(F.array_join(F.slice("x", start + 1, c("n") + after + 1 - start), " "))

    return lines.select("ord", "n", around(2, 4).alias("wide"), around(1, 1).alias("narrow"))


@query("W5_header_segments", f"""WITH l AS ({LINES}), g AS (SELECT *, sum(CASE WHEN regexp_full_match(line, '[A-Z][A-Z ]{{4,}}') THEN 1 ELSE 0 END) OVER (PARTITION BY ord ORDER BY n) AS seg FROM l)
    SELECT ord, CAST(seg AS BIGINT) AS seg, string_agg(line, chr(10) ORDER BY n) AS body, count(*) AS lines FROM g GROUP BY 1, 2""")  # fmt: skip
def header_segments(v: Views) -> DataFrame:
    """A line in capitals begins a segment; the running number of such lines names it."""
    lines = v.reports.select("ord", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    seg = F.sum(c("line").rlike("^[A-Z][A-Z ]{4,}$").cast("long")).over(Window.partitionBy("ord").orderBy("n"))
    parts = lines.withColumn("seg", seg).groupBy("ord", "seg").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("x"), F.count("*").alias("lines"))
    return parts.select("ord", "seg", F.array_join(F.transform("x", lambda l: l["line"]), "\n").alias("body"), "lines")


@query("W6_section_ends", """SELECT ord, b, s, coalesce(lead(s) OVER (PARTITION BY ord ORDER BY s), length(text) + 1) AS e FROM (SELECT ord, text, b, strpos(text, b) AS s FROM reports, (VALUES ('Experian'), ('Equifax'), ('TransUnion')) v(b)) WHERE s > 0""")
def section_ends(v: Views) -> DataFrame:
    """A section ends where the next one begins, the last with the text."""
    found = v.reports.select("ord", F.length("text").alias("size"), F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.locate(b, "text").cast("long").alias("s")) for b in ("Experian", "Equifax", "TransUnion")])).alias("x")).select("ord", "size", "x.b", "x.s").where("s > 0")
    return found.select("ord", "b", "s", F.coalesce(F.lead("s").over(Window.partitionBy("ord").orderBy("s")), (c("size") + 1).cast("long")).alias("e"))


@query("W7_L13_L16_last_messages", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS rn FROM conversations) SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn, rn DESC) AS history FROM r WHERE rn <= 5 GROUP BY conv_id""")
def last_messages(v: Views) -> DataFrame:
    """The last five messages of each conversation, oldest first."""
    latest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    top = v.table("conversations").withColumn("rn", F.row_number().over(latest)).where("rn <= 5")
    lines = F.sort_array(F.collect_list(F.struct("turn", (-c("rn")).alias("k"), F.concat(F.upper("role"), F.lit(": "), "text").alias("t"))))
    return top.groupBy("conv_id").agg(lines.alias("x")).select("conv_id", F.array_join(F.transform("x", lambda m: m["t"]), "\n").alias("history"))


@query("W9_O1_numbered_items", "SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY credit_bureau, creditor_name, date_opened DESC, ord) AS n FROM tradelines WHERE is_negative")
def numbered_items(v: Views) -> DataFrame:
    """Dates are ordered as text, as they are stored."""
    order = Window.partitionBy("user_id").orderBy("credit_bureau", "creditor_name", F.desc("date_opened"), "ord")
    return v.tradelines.where("is_negative").select("user_id", "id", F.row_number().over(order).cast("long").alias("n"))


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of the ordered rows with the totals of all: a top-k sort up to the page's end and a count."""
    total = rows.agg(F.count("*").alias("total_count"))
    shown = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    pages = F.ceil(c("total_count") / size)
    return shown.join(F.broadcast(total)).withColumns({"total_pages": pages, "has_next": F.lit(number) < pages, "has_previous": F.lit(number > 1)})


@query("O2_O10_page", """WITH p AS (SELECT id, created_on, row_number() OVER (ORDER BY created_on DESC, ord) AS rn, count(*) OVER () AS total_count FROM tradelines) SELECT id, created_on, total_count, CAST(ceil(total_count / 20) AS BIGINT) AS total_pages, 3 < ceil(total_count / 20) AS has_next, true AS has_previous FROM p WHERE rn BETWEEN 41 AND 60""")
def third_page(v: Views) -> DataFrame:
    return page(v.tradelines.select("id", "ord", "created_on"), [F.desc("created_on"), "ord"], 3, 20).drop("ord")


def page_numbers(current: int, total: int, around: int = 2) -> list[int | None]:
    """Page links: the first, those around the current one and the last; None stands for a gap."""
    wanted = sorted({1, total, *range(max(1, current - around), min(total, current + around) + 1)})
    out: list[int | None] = []
    for number in wanted:
        if out and number - out[-1] > 1:
            out.append(None)
        out.append(number)
    return out


def page_links(current: Column, total: Column, around: int = 2) -> Column:
    """``page_numbers`` as a column: numbers of pages, null for a gap; it is as long as the links, however many pages there are."""
    near = F.sequence(F.greatest(F.lit(1), current - around), F.least(total, current + around))
    wanted = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1)), near, F.array(total))))
    before = lambda i: F.get(wanted, i - 1)
    return F.flatten(F.transform(wanted, lambda x, i: F.when((i > 0) & (x - before(i) > 1), F.array(F.lit(None).cast("int"), x)).otherwise(F.array(x))))


@query("O3_page_links", """WITH t AS (SELECT user_id, CAST(ceil(count(*) / 20.0) AS INTEGER) AS total, CAST(max(ord) AS BIGINT) AS last FROM tradelines GROUP BY user_id), u AS (SELECT user_id, total, CAST(1 + last % total AS INTEGER) AS page FROM t),
    w AS (SELECT user_id, page, n, n - lag(n) OVER (PARTITION BY user_id ORDER BY n) > 1 AS gap FROM (SELECT user_id, page, total, unnest(range(1, total + 1)) AS n FROM u) WHERE n IN (1, total) OR abs(n - page) <= 2),
    r AS (SELECT user_id, page, n, n AS number FROM w UNION ALL SELECT user_id, page, n - 0.5, NULL FROM w WHERE gap)
    SELECT user_id, page, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n) - 1 AS INTEGER) AS place, CAST(number AS INTEGER) AS number FROM r""")  # fmt: skip
def page_links_of_users(v: Views) -> DataFrame:
    """The links below each user's list of records, at one of its pages."""
    totals = v.tradelines.groupBy("user_id").agg(F.ceil(F.count("*") / 20).cast("int").alias("total"), F.max("ord").alias("last"))
    pages = totals.select("user_id", "total", (c("last") % c("total") + 1).cast("int").alias("page"))
    return pages.select("user_id", "page", F.posexplode(page_links(c("page"), c("total"))).alias("place", "number"))


@query("O4_recent_disputes", "SELECT id, created_on FROM disputes ORDER BY created_on DESC, ord DESC LIMIT 5")
def recent_disputes(v: Views) -> DataFrame:
    return v.disputes.select("id", "created_on", "ord").orderBy(F.desc("created_on"), F.desc("ord")).limit(5).select("id", "created_on")


@query("O5_upcoming_deadlines", f"SELECT id, created_on + 30 AS deadline, CAST(date_diff('day', DATE '{AS_OF}', created_on + 30) AS INTEGER) AS days_left FROM disputes WHERE status = 'in_progress' AND created_on + 30 >= DATE '{AS_OF}' - 60")
def upcoming_deadlines(v: Views) -> DataFrame:
    deadline, day = F.date_add("created_on", 30), F.lit(AS_OF).cast("date")
    return v.disputes.where((c("status") == "in_progress") & (deadline >= F.date_sub(day, 60))).select("id", deadline.alias("deadline"), F.datediff(deadline, day).alias("days_left"))


@query("O6_O7_O8_best_bureau", """WITH s AS (SELECT user_id, credit_bureau, count(*) AS n FROM tradelines WHERE credit_bureau <> '' GROUP BY 1, 2) SELECT user_id, credit_bureau AS best FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, list_position(['Experian', 'Equifax', 'TransUnion'], credit_bureau)) AS rn FROM s) WHERE rn = 1""")
def best_bureau(v: Views) -> DataFrame:
    """Most rows win; ties go by a fixed order of bureaus."""
    counts = v.tradelines.where(c("credit_bureau") != "").groupBy("user_id", "credit_bureau").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(F.lit("Experian"), F.lit("Equifax"), F.lit("TransUnion")), c("credit_bureau"))
    return counts.groupBy("user_id").agg(F.max_by("credit_bureau", F.struct("n", -place)).alias("best"))


@query("U1_U2_set_operations", """(SELECT creditor_name, 'both' AS side FROM tradelines WHERE ord % 7 = 0 INTERSECT SELECT creditor_name, 'both' FROM tradelines WHERE ord % 5 = 0) UNION ALL (SELECT creditor_name, 'left' FROM tradelines WHERE ord % 19 < 12 EXCEPT SELECT creditor_name, 'left' FROM tradelines WHERE ord % 19 < 6) UNION ALL SELECT DISTINCT credit_bureau, 'distinct' FROM tradelines""")
def set_operations(v: Views) -> DataFrame:
    names = v.tradelines.select("ord", "creditor_name")

    def of(condition: str, side: str) -> DataFrame:
        # distinct first: the set operations are joins, and a name's rows would all meet in one task
        return names.where(condition).select("creditor_name", F.lit(side).alias("side")).distinct()

    both = of("ord % 7 = 0", "both").intersect(of("ord % 5 = 0", "both"))
    left = of("ord % 19 < 12", "left").subtract(of("ord % 19 < 6", "left"))
    return both.unionByName(left).unionByName(v.tradelines.select(c("credit_bureau").alias("creditor_name"), F.lit("distinct").alias("side")).distinct())


@query("U4_L8_missing_documents", """WITH d AS (SELECT user_id, list(DISTINCT document_type) AS types FROM user_documents GROUP BY user_id)
    SELECT user_id, array_to_string(list_filter(['photo_id', 'ssn_card', 'utility_bill'], lambda x: NOT list_contains(types, x)), ',') AS missing, list_contains(types, 'photo_id') AS has_photo, list_has_all(types, ['photo_id', 'ssn_card', 'utility_bill']) AS has_all FROM d""")  # fmt: skip
def missing_documents(v: Views) -> DataFrame:
    needed = ["photo_id", "ssn_card", "utility_bill"]
    has = v.user_documents.groupBy("user_id").agg(*[F.bool_or(c("document_type") == d).alias(d) for d in needed])
    missing = F.array_compact(F.array(*[F.when(~c(d), d) for d in needed]))
    return has.select("user_id", F.array_join(missing, ",").alias("missing"), c("photo_id").alias("has_photo"), (F.size(missing) == 0).alias("has_all"))
