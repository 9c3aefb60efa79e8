"""Accounts and their fields from report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import Views

c = F.col
#: The patterns of each field, in order; the first group is the value, in either case.
PATTERNS = {
    "account_number": [
        r"account\s*(?:number|#|num)[\s:]*([*\dX-]{4,})",
        r"acct\s*(?:number|#|num)[\s:]*([*\dX-]{4,})",
        r"ref\s*(?:number|#|num)[\s:]*([*\dX-]{4,})",
        r"(\*{4,}\d{4}|\d{4}\*{4,}|[*X]{4,}\d{4}|\d{4}[*X]{4,})",
        r"([*X-]{4,}\d{4,}|\d{4,}[*X-]{4,})",
    ],
    "current_balance": [
        r"current\s*balance[\s:]*\$?([\d,]+\.?\d*)",
        r"balance[\s:]*\$?([\d,]+\.?\d*)",
        r"curr\s*bal[\s:]*\$?([\d,]+\.?\d*)",
        r"outstanding[\s:]*\$?([\d,]+\.?\d*)",
        r"amount\s*owed[\s:]*\$?([\d,]+\.?\d*)",
        r"balance\s*due[\s:]*\$?([\d,]+\.?\d*)",
    ],
    "credit_limit": [
        r"credit\s*limit[\s:]*\$?([\d,]+\.?\d*)",
        r"limit[\s:]*\$?([\d,]+\.?\d*)",
        r"credit\s*line[\s:]*\$?([\d,]+\.?\d*)",
        r"high\s*credit[\s:]*\$?([\d,]+\.?\d*)",
        r"high\s*balance[\s:]*\$?([\d,]+\.?\d*)",
        r"max\s*credit[\s:]*\$?([\d,]+\.?\d*)",
        r"available\s*credit[\s:]*\$?([\d,]+\.?\d*)",
    ],
    "monthly_payment": [
        r"monthly\s*payment[\s:]*\$?([\d,]+\.?\d*)",
        r"payment\s*amount[\s:]*\$?([\d,]+\.?\d*)",
        r"min\s*payment[\s:]*\$?([\d,]+\.?\d*)",
        r"minimum\s*payment[\s:]*\$?([\d,]+\.?\d*)",
        r"scheduled\s*payment[\s:]*\$?([\d,]+\.?\d*)",
        r"contract\s*payment[\s:]*\$?([\d,]+\.?\d*)",
    ],
    "date_opened": [
        r"opened[\s:]*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
        r"date\s*opened[\s:]*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
        r"account\s*opened[\s:]*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
        r"open\s*date[\s:]*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
        r"start\s*date[\s:]*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
    ],
    "date_closed": [
        r"closed[\s:]*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
        r"date\s*closed[\s:]*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
        r"account\s*closed[\s:]*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
        r"close\s*date[\s:]*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
        r"end\s*date[\s:]*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
    ],
    "payment_status": [
        r"(current|pays as agreed|ok|good)",
        r"(\d+)\s*days?\s*late",
        r"(past due|delinquent|late)",
        r"(charged off|charge[- ]?off)",
        r"(collection|collections)",
        r"(settled|settlement)",
        r"(bankruptcy|bk)",
    ],
    "account_status": [
        r"status[\s:]*([a-zA-Z\s]+)",
        r"account\s*status[\s:]*([a-zA-Z\s]+)",
        r"(open|closed|transferred|sold)",
        r"(active|inactive)",
    ],
}
#: Creditors in order, in either case.
CREDITORS = [
    r"chase(?:\s+(?:bank|card))?", r"capital\s*one", r"american\s*express|amex", r"bank\s*of\s*america|boa", r"wells\s*fargo", "citi", "discover", "synchrony", "barclay", r"us\s*bank",
    r"amazon(?:\s+(?:store|card))?", r"target(?:\s+(?:card))?", r"home\s*depot", "lowes?", "walmart", "costco", "nordstrom", "macy's|macys", "kohl's|kohls", r"best\s*buy",
    r"ford\s*(?:credit|motor\s*credit)?", r"honda\s*(?:financial|finance)?", r"toyota\s*(?:financial|finance)?", r"nissan\s*(?:motor|financial)?", r"gm\s*financial", r"chrysler\s*capital", r"ally\s*(?:auto|financial)?", "santander",
    "navient", r"great\s*lakes", "nelnet", "fedloan", "mohela", r"dept\.?\s*of\s*education|department\s*of\s*education", r"student\s*loan",
    r"quicken\s*loans|rocket\s*mortgage", r"freedom\s*mortgage", "pennymac", "caliber", "mortgage",
    r"navy\s*federal", "usaa", r"pentagon\s*fcu", r"credit\s*union",
    "paypal", "affirm", "klarna", "sofi", "upstart", r"lending\s*club", "prosper", "avant", "onemain",
]
AMOUNTS, DAYS, STATES = ("current_balance", "credit_limit", "monthly_payment"), ("date_opened", "date_closed"), ("payment_status", "account_status")
CLEAN = {"account_number": "[^0-9*X-]", **dict.fromkeys(AMOUNTS, "[^0-9.,]"), **dict.fromkeys(DAYS, "[^0-9/-]"), **dict.fromkeys(STATES, r"^\s+|\s+$")}
#: What counts as no value, and what a status is called.
NOTHING = {**dict.fromkeys(AMOUNTS, ["", "0", "0.00", ".00"]), **dict.fromkeys(STATES, ["", "none", "n/a", "null"])}
SHORTEST = {"account_number": 4, **dict.fromkeys(DAYS, 6)}
CALLED = {"Current": "^(current|ok|good|pays as agreed)$", "Late": "late|past due", "Charged Off": "charged off|charge off", "Collection": "collection"}


def title(text: Column) -> Column:
    """Every run of letters with a capital first."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0)), F.initcap), "")


def title_sql(text: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({text}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"


def field(text: Column, low: Column, name: str, patterns: dict[str, list[str]] = PATTERNS) -> Column:
    """The value of the first pattern that gives one; amounts of zero and too short values are none.

    Each pattern runs once and only where those before it gave nothing: what it finds is bound by the filter. Values
    whose case does not matter are sought in the text in small letters, where patterns need not fold case.
    """

    def keep(value: Column) -> Column:
        return F.length(value) >= SHORTEST[name] if name in SHORTEST else ~F.lower(value).isin(NOTHING[name])

    found = [F.regexp_extract(text, f"(?i){p}", 1) if name == "account_number" else F.regexp_extract(low, p, 1) for p in patterns[name]]
    found = [F.regexp_replace(x, CLEAN[name], "") for x in found]
    value = F.coalesce(*[F.get(F.filter(F.array(x), keep), F.lit(0)) for x in found])
    if name not in STATES:
        return value
    return F.get(F.transform(F.array(value), lambda x: F.coalesce(*[F.when(x.rlike(p), n) for n, p in CALLED.items()], title(x))), F.lit(0))


def field_sql(name: str, patterns: dict[str, list[str]] = PATTERNS) -> str:
    found = [f"regexp_replace(regexp_extract(text, '(?im){p}', 1), '{CLEAN[name]}', '', 'g')" for p in patterns[name]]
    keep = f"length(x) >= {SHORTEST[name]}" if name in SHORTEST else "lower(x) NOT IN (" + ", ".join(f"'{x}'" for x in NOTHING.get(name, [])) + ")"
    value = f"list_filter([{', '.join(found)}], lambda x: {keep})[1]"
    if name not in STATES:
        return value
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({value}), '{p}') THEN '{n}'" for n, p in CALLED.items()) + f" ELSE {title_sql(f'lower({value})')} END"


def creditor(text: Column, low: Column) -> Column:
    """The first known creditor that is named, else the first of the first five lines that is in capitals."""
    known = F.coalesce(*[F.nullif(F.regexp_extract(low, p, 0), F.lit("")) for p in CREDITORS])
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 5), lambda l: F.regexp_replace(l, r"^\s+|\s+$", ""))
    capitals = F.get(F.filter(lines, lambda l: (F.length(l) > 3) & l.rlike("[A-Z]") & ~l.rlike("[a-z]")), F.lit(0))
    return title(F.coalesce(F.trim(F.regexp_replace(known, r"\s+", " ")), capitals))


QUOTED = [p.replace("'", "''") for p in CREDITORS]
KNOWN_SQL = "trim(regexp_replace(coalesce(" + ", ".join(f"nullif(regexp_extract(text, '(?i){p}', 0), '')" for p in QUOTED) + r"), '\s+', ' ', 'g'))"
CAPITALS_SQL = r"list_filter(list_transform(string_split(text, chr(10))[1:5], lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: length(l) > 3 AND regexp_matches(l, '[A-Z]') AND NOT regexp_matches(l, '[a-z]'))[1]"


@query("X6_section_fields", f"SELECT ord, {title_sql('named')} AS creditor, " + ", ".join(f"{field_sql(n)} AS {n}" for n in PATTERNS) + f" FROM (SELECT ord, text, coalesce({KNOWN_SQL}, {CAPITALS_SQL}) AS named FROM sections) WHERE named IS NOT NULL")
def section_fields(v: Views) -> DataFrame:
    """All fields of the sections that name a creditor, in one pass over their text, as column expressions."""
    return fields(v.sections)


def fields(sections: DataFrame, patterns: dict[str, list[str]] = PATTERNS) -> DataFrame:
    """Sections (ord, text) to their creditor and fields; null where a field is missing, no row without a creditor."""
    both = sections.select("ord", "text", F.lower("text").alias("low"))
    # a generator rather than a filter, which would be pushed down and seek the creditor twice
    named = both.select("ord", "text", "low", F.explode(F.array_compact(F.array(creditor(c("text"), c("low"))))).alias("creditor"))
    return named.select("ord", "creditor", *[field(c("text"), c("low"), n, patterns).alias(n) for n in patterns])


@query("X10_X13_X14_small_extractors", r"""SELECT ord, coalesce(list_last(regexp_extract_all(text, '\d{4,16}')), '') AS last_number, coalesce(nullif(regexp_extract(text, '(?i)(?:Account|Acct)(?:\s*[#:]?\s*)(\d{4,16})', 1), ''), nullif(regexp_extract(text, '(?i)(?:Number|No|#)(?:\s*[:]?\s*)(\d{4,16})', 1), ''), nullif(regexp_extract(text, '\b(\d{4,16})\b', 1), ''), '') AS account,
    regexp_extract(text, '(?i)(?:balance|bal|owe[ds]?)\s*:?\s*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)', 1) AS balance, regexp_extract(text, '(?i)(?:limit|credit limit|cl)\s*:?\s*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)', 1) AS credit_limit,
    regexp_extract(text, '(?i)(?:payment|pmt|monthly)\s*:?\s*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)', 1) AS payment, coalesce(TRY_CAST(nullif(regexp_extract(text, '(?i)dispute[ds]?\s*:?\s*(\d+)', 1), '') AS INTEGER), 0) AS disputes FROM sections""")  # fmt: skip
def small_extractors(v: Views) -> DataFrame:
    amount = r"\s*:?\s*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)"
    ladder = [r"(?i)(?:Account|Acct)(?:\s*[#:]?\s*)(\d{4,16})", r"(?i)(?:Number|No|#)(?:\s*[:]?\s*)(\d{4,16})", r"\b(\d{4,16})\b"]
    return v.sections.select(
        "ord",
        F.coalesce(F.try_element_at(F.regexp_extract_all("text", F.lit(r"\d{4,16}"), F.lit(0)), F.lit(-1)), F.lit("")).alias("last_number"),
        F.coalesce(*[F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in ladder], F.lit("")).alias("account"),
        *[F.regexp_extract("text", f"(?i)(?:{words}){amount}", 1).alias(n) for n, words in (("balance", "balance|bal|owe[ds]?"), ("credit_limit", "limit|credit limit|cl"), ("payment", "payment|pmt|monthly"))],
        F.coalesce(F.nullif(F.regexp_extract("text", r"(?i)dispute[ds]?\s*:?\s*(\d+)", 1), F.lit("")).try_cast("int"), F.lit(0)).alias("disputes"),
    )


NUMBERS = [r"(?i)Account\s+\+\s+(\d{5,})(X{2,}|\d*)", r"(?i)Account Number\s+(\d{4,})(X{2,}|\d*)", r"\b(\d{5,})(X{2,}|\d*)\b"]


@query("X11_account_numbers", "WITH n AS (" + " UNION ALL ".join(f"SELECT ord, unnest(list_transform(range(1, len(regexp_extract_all(text, '{p}', 1)) + 1), lambda i: regexp_extract_all(text, '{p}', 1)[i] || regexp_extract_all(text, '{p}', 2)[i])) AS account FROM reports" for p in NUMBERS) + ") SELECT DISTINCT ord, account FROM n")
def account_numbers(v: Views) -> DataFrame:
    """All account numbers of a report, each once."""
    found = [F.zip_with(F.regexp_extract_all("text", F.lit(p), F.lit(1)), F.regexp_extract_all("text", F.lit(p), F.lit(2)), lambda a, b: F.concat(a, b)) for p in NUMBERS]
    return v.reports.select("ord", F.explode(F.array_distinct(F.concat(*found))).alias("account"))


def records(lines: DataFrame, header: str) -> DataFrame:
    """Lines (ord, n, line) to records (ord, rec, body): a line that fits ``header`` begins one; lines before it go."""
    rec = F.sum(c("line").rlike(header).cast("long")).over(Window.partitionBy("ord").orderBy("n"))
    parts = lines.withColumn("rec", rec).where("rec > 0").groupBy("ord", "rec").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("x"))
    return parts.select("ord", "rec", F.get(F.transform("x", lambda l: l["line"]), F.lit(0)).alias("head"), F.array_join(F.transform("x", lambda l: l["line"]), " ").alias("body"))


#: The line that begins an account.
HEAD = r"^[A-Z][A-Z ]{4,}$"
LINES = "SELECT ord, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM reports"


@query("X2_X3_X4_block_parsers", f"""WITH l AS ({LINES}), g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{HEAD}') THEN 1 ELSE 0 END) OVER (PARTITION BY ord ORDER BY n) AS rec FROM l), b AS (SELECT ord, CAST(rec AS BIGINT) AS rec, first(line ORDER BY n) AS head, string_agg(line, ' ' ORDER BY n) AS body FROM g WHERE rec > 0 GROUP BY 1, 2)
    SELECT ord, rec, head AS creditor, coalesce(nullif(regexp_extract(body, '(?i)account[a-z ]*:?\\s*([0-9X*]{{4,}})', 1), ''), '') AS account, regexp_extract(body, '\\$([0-9,]+)', 1) AS amount, regexp_extract(body, '(?i)status:? *([a-z]+)', 1) AS status, regexp_matches(lower(body), 'collection|charged? off|delinquent|late') AS negative FROM b""")  # fmt: skip
def block_parsers(v: Views) -> DataFrame:
    """A line in capitals begins an account; its fields come from the block's joined lines."""
    lines = v.reports.select("ord", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    found = records(lines, HEAD)
    body = c("body")
    return found.select(
        "ord",
        "rec",
        c("head").alias("creditor"),
        F.regexp_extract(body, r"(?i)account[a-z ]*:?\s*([0-9X*]{4,})", 1).alias("account"),
        F.regexp_extract(body, r"\$([0-9,]+)", 1).alias("amount"),
        F.regexp_extract(body, "(?i)status:? *([a-z]+)", 1).alias("status"),
        F.lower(body).rlike("collection|charged? off|delinquent|late").alias("negative"),
    )


SECTIONS = {"negative": r"(?i)potentially negative|charge off", "good": r"(?i)good standing|satisfactory"}


@query("X1_sectioned_parser")
def sectioned_parser(v: Views) -> DataFrame:
    """Accounts within named sections: the section a line lies in is that of the last section heading before it."""
    lines = v.reports.select("ord", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    name = F.when(c("line").rlike(SECTIONS["negative"]), "negative").when(c("line").rlike(SECTIONS["good"]), "good")
    order = Window.partitionBy("ord").orderBy("n")
    placed = lines.withColumn("section", F.last(name, ignorenulls=True).over(order)).withColumn("rec", F.sum(c("line").rlike(HEAD).cast("long")).over(order)).where("rec > 0")
    number = F.nullif(F.regexp_extract("line", r"(?i)account[a-z ]*:?\s*([0-9X*]{4,})", 1), F.lit(""))
    out = placed.groupBy("ord", "rec").agg(F.min_by("line", "n").alias("creditor"), F.max_by("section", "n").alias("section"), F.min_by(number, F.when(number.isNotNull(), c("n"))).alias("account"))
    return out.where("account is not null").withColumn("negative", F.coalesce(c("section") == "negative", F.lit(False)))


@query("X9_X16_creditor_lines", """WITH l AS (SELECT ord, unnest(string_split(text, chr(10))) AS line FROM reports), k AS (SELECT unnest(['CHASE', 'CAPITAL ONE', 'EQUIFAX', 'EXPERIAN']) AS name) SELECT ord, name, count(*) AS lines FROM l JOIN k ON contains(upper(line), name) GROUP BY 1, 2""")
def creditor_lines(v: Views) -> DataFrame:
    """Lines that mention each expected name; a line may mention several."""
    names = ["CHASE", "CAPITAL ONE", "EQUIFAX", "EXPERIAN"]
    lines = v.reports.select("ord", F.explode(F.split("text", "\n")).alias("line"))
    hits = lines.select("ord", F.explode(F.array_compact(F.array(*[F.when(F.upper("line").contains(n), n) for n in names]))).alias("name"))
    return hits.groupBy("ord", "name").agg(F.count("*").alias("lines"))


#: Creditors that a report is expected to name.
EXPECTED = [
    "UPSTART", "SUNRISE BANK", "SCHOOLSFIRST", "SELF FINANCIAL", "WEBBANK", "FINGERHUT", "DISCOVER", "SYNCB", "CARE CREDIT",
    "CAPITAL ONE", "BANK OF AMERICA", "JPMCB", "CREDIT ONE", "CLIMB", "MOHELA", "LENTEGRITY", "ATLANTIC",
]


@query("X16_expected_creditors", f"SELECT ord, name, mentions FROM (SELECT ord, name, len(string_split(upper(text), name)) - 1 AS mentions FROM sections, (SELECT unnest({EXPECTED}) AS name)) WHERE mentions > 0")
def expected_creditors(v: Views) -> DataFrame:
    """How often a text names each expected creditor, in either case; only those that it names."""
    counts = F.array(*[F.struct(F.lit(n).alias("name"), F.regexp_count(F.upper("text"), F.lit(n)).cast("long").alias("mentions")) for n in EXPECTED])
    return v.sections.select("ord", F.inline(F.filter(counts, lambda x: x["mentions"] > 0)))


@query("X15_page_chunks", "SELECT doc_id, CAST(k AS INTEGER) AS chunk, CAST(k * 30 + 1 AS INTEGER) AS first_page, CAST(least((k + 1) * 30, pages) AS INTEGER) AS last_page FROM (SELECT doc_id, pages, unnest(range(0, CAST(ceil(pages / 30.0) AS INTEGER))) AS k FROM files)")
def page_chunks(v: Views) -> DataFrame:
    """Ranges of at most 30 pages; a document without pages has none."""
    chunks = F.when(c("pages") > 0, F.sequence(F.lit(0), F.ceil(c("pages") / 30).cast("int") - 1))
    return v.files.select("doc_id", "pages", F.explode(chunks).alias("chunk")).select("doc_id", "chunk", (c("chunk") * 30 + 1).alias("first_page"), F.least((c("chunk") + 1) * 30, "pages").alias("last_page"))


#: The patterns of a profile.
PROFILE = {"dollars": r"\$[\d,]+", "dates": r"\d{1,2}/\d{1,2}/\d{2,4}", "masked": r"[*X]{4}", "numbers": r"\b\d{4,16}\b", "labels": r"(?i)balance|limit|payment", "statuses": r"(?i)open|closed|current|late"}


@query("X17_pattern_profile", "SELECT ord, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p in PROFILE.items()) + " FROM sections")
def pattern_profile(v: Views) -> DataFrame:
    return v.sections.select("ord", *[F.regexp_count("text", F.lit(p)).cast("long").alias(n) for n, p in PROFILE.items()])

