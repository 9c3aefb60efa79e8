"""Accounts from report text by sections, entries and lines: readers that need no layout of a bureau."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import categories as C
from ..functions import dates as D
from ..functions import text as T
from ..plans.registry import query
from ..plans.views import Views
from .extraction import CREDITORS

c = F.col
EDGES = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def first_of(text: Column, patterns: list[str], low: Column | None = None) -> Column:
    """What the first pattern that is found holds in its first group, null if none is; ``low`` is the text in small letters."""
    return F.coalesce(*[T.first_group(text, F.lower(text) if low is None else low, p) for p in patterns])


def first_of_sql(patterns: list[str]) -> str:
    quoted = [p.replace("'", "''") for p in patterns]
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in quoted) + ")"


#: Where a section of each bureau's report begins, and words of which a section has one.
BEGINS = {
    "transunion": r"\n\n+|\n\s*(?=[A-Z][A-Z\s,&.]+(?:BANK|CARD|FINANCIAL|CREDIT|AUTO|LOAN))",
    "experian": r"\n\s*(?=[A-Z][A-Z\s]+\s+\*+\d+)",
    "equifax": r"\n\s*(?=[A-Z][A-Z\s&]+\s+Account)",
}
BLANK_LINES = r"\n\s*\n+"
SECTION_WORDS = "ACCOUNT|BANK|CARD|CREDIT|BALANCE|LIMIT|PAYMENT"
SHORTEST_SECTION = 31


def sections_of(reports: DataFrame) -> DataFrame:
    """Reports (ord, bureau, text) to sections (ord, n, section).

    A text is split where its bureau's sections begin; if that leaves one part or the bureau is unknown, before known
    creditors; if that leaves one part too, at blank lines. Short parts and those without a fitting word go; where all
    would go the text stays whole. Null texts have no section.
    """
    by_name = F.split("text", r"(?i)\n\s*(?=" + "|".join(f"(?:{p})" for p in CREDITORS) + ")")
    by_bureau = F.coalesce(*[F.when(F.lower("bureau") == b, F.split("text", p)) for b, p in BEGINS.items()], F.array("text"))
    several = [F.get(F.filter(F.array(x), lambda parts: F.size(parts) > 1), F.lit(0)) for x in (by_bureau, by_name)]
    parts = F.transform(F.coalesce(*several, F.split("text", BLANK_LINES)), strip)
    good = F.filter(parts, lambda p: (F.length(p) >= SHORTEST_SECTION) & F.upper(p).rlike(SECTION_WORDS))
    kept = reports.where("text is not null").select("ord", "text", good.alias("good"))
    return kept.select("ord", F.posexplode(F.when(F.size("good") > 0, c("good")).otherwise(F.array("text"))).alias("n", "section"))


@query("X5_sections_by_lookahead")
def sections_by_lookahead(v: Views) -> DataFrame:
    """Sections of each report by its bureau. The lookaheads have no form in DuckDB; a fixture holds the result."""
    return sections_of(v.statements)


#: What divides blocks, what a block begins with, and the patterns of its fields, in order.
DIVIDERS = r"(?i)\n\s*\n|_{3,}|-{3,}|={3,}|\f|Account\s+Type:"
NAME_ENDS = r"BANK|CARD|CREDIT|FINANCIAL|CORP|INC|LLC|CO|CAPITAL|CHASE|WELLS|CITI|DISCOVER|AMEX|AMERICAN\s+EXPRESS"
MARKERS = [
    r"[A-Z]{2,}",
    r"\$",
    "(?i)account|balance|payment",
    "(?im)^(CREDIT CARD|INSTALLMENT|MORTGAGE|AUTO|STUDENT LOAN|COLLECTION)",
    "(?im)^(Account Type:|Account Name:|Company Name:)",
    rf"(?im)^\s*([A-Z][A-Z\s&'-]+(?:{NAME_ENDS}))",
]
SHORTEST_BLOCK = 51
BLOCK_FIELDS = {
    "creditor": [
        rf"(?i)^([A-Z][A-Z\s&'-]+(?:{NAME_ENDS}))",
        r"(?i)Company Name:\s*([A-Z][A-Z\s&'-]+)",
        r"(?i)Account Name:\s*([A-Z][A-Z\s&'-]+)",
        r"(?i)^([A-Z\s&'-]{4,})\s+(?:Account|Acct)",
    ],
    "account_number": [
        r"(?i)Account\s*(?:Number|#):\s*(\*{4}\d{4}|\d{4}|[X]{4}\d{4})",
        r"(?i)Acct\s*(?:Number|#):\s*(\*{4}\d{4}|\d{4}|[X]{4}\d{4})",
        r"(\*{4}\d{4}|[X]{4}\d{4})",
        r"(?i)ending\s+in\s+(\d{4})",
        r"(?i)last\s+4:\s*(\d{4})",
    ],
    "account_balance": [r"(?i)Balance:\s*\$?([\d,]+\.?\d*)", r"(?i)Current\s+Balance:\s*\$?([\d,]+\.?\d*)", r"(?i)Outstanding:\s*\$?([\d,]+\.?\d*)", r"(?i)Amount\s+Owed:\s*\$?([\d,]+\.?\d*)"],
    "credit_limit": [r"(?i)Credit\s+Limit:\s*\$?([\d,]+\.?\d*)", r"(?i)High\s+Credit:\s*\$?([\d,]+\.?\d*)", r"(?i)Limit:\s*\$?([\d,]+\.?\d*)"],
    "monthly_payment": [r"(?i)Monthly\s+Payment:\s*\$?([\d,]+\.?\d*)", r"(?i)Payment:\s*\$?([\d,]+\.?\d*)", r"(?i)Min\s+Payment:\s*\$?([\d,]+\.?\d*)"],
    "date_opened": [r"(?i)Date\s+Opened:\s*(\d{1,2}\/\d{1,2}\/\d{2,4})", r"(?i)Opened:\s*(\d{1,2}\/\d{1,2}\/\d{2,4})", r"(?i)Open\s+Date:\s*(\d{1,2}\/\d{1,2}\/\d{2,4})"],
    "account_status": [
        r"(?i)Status:\s*(Open|Closed|Charged\s+Off|Collection|Disputed|Current|Delinquent|Past\s+Due)",
        r"(?i)Account\s+Status:\s*(Open|Closed|Charged\s+Off|Collection|Disputed|Current|Delinquent|Past\s+Due)",
        r"(?i)(Charged\s+Off|Collection|Delinquent|Past\s+Due|Late)",
    ],
}
MONEY = ("account_balance", "credit_limit", "monthly_payment")
#: A type, the words of the creditor that lead to it, and those of creditor and text together.
BLOCK_TYPES = [
    ("mortgage", "mortgage|home", "mortgage"),
    ("auto_loan", "auto|car", "auto"),
    ("student_loan", "student", "student"),
    ("collection", "collection", "collection"),
    ("credit_card", "card|credit", "credit card"),
    ("loan", "loan", "loan"),
]
NEGATIVE_STATUS, NEGATIVE_BLOCK = "charged|collection|delinquent|late|past due", "delinquent|past due|charge off|collection"


def text_accounts(reports: DataFrame) -> DataFrame:
    """Reports (ord, text) to one row for each creditor and number: that of the first block that names them.

    Blocks are parted by blank lines, rules, form feeds and "Account Type:". A field is the first group of its first
    pattern that is found; missing ones are empty. Creditors of two letters or fewer, null and empty texts give no row.
    """
    blocks = reports.select("ord", F.posexplode(F.transform(F.split("text", DIVIDERS), strip)).alias("n", "block"))
    marked = reduce(or_, [c("block").rlike(p) for p in MARKERS])
    kept = blocks.where((F.length("block") >= SHORTEST_BLOCK) & marked)
    text = kept.select("ord", "n", F.regexp_replace("block", r"\s+", " ").alias("text")).withColumn("low", F.lower("text"))
    raw = F.struct(*[F.trim(F.coalesce(first_of(c("text"), p, c("low")), F.lit(""))).alias(f) for f, p in BLOCK_FIELDS.items()])
    # in a generator, as a filter on the creditor would be pushed down and seek it twice
    named = text.select("ord", "n", "text", F.inline(F.filter(F.array(raw), lambda x: F.length(x["creditor"]) > 2)))
    status, both = F.lower("account_status"), F.lower(F.concat_ws(" ", "creditor", "text"))
    kind = F.coalesce(*[F.when(F.lower("creditor").rlike(name) | both.rlike(either), k) for k, name, either in BLOCK_TYPES], F.lit(""))
    found = named.select(
        "ord",
        "n",
        "creditor",
        F.when(c("account_number") == "", "").otherwise(F.concat(F.lit("****"), F.regexp_replace("account_number", "^[*X]+", ""))).alias("account_number"),
        *[F.when(c(f) == "", "").otherwise(F.concat(F.lit("$"), f)).alias(f) for f in MONEY],
        "date_opened",
        status.alias("account_status"),
        kind.alias("account_type"),
        (status.rlike(NEGATIVE_STATUS) | F.lower("text").rlike(NEGATIVE_BLOCK)).alias("is_negative"),
    )
    rest = [x for x in found.columns if x not in ("ord", "creditor", "account_number")]
    first = found.groupBy("ord", "creditor", "account_number").agg(F.min(F.struct(*rest)).alias("x"))  # n leads and is unique in its report
    return first.select("ord", "creditor", "account_number", "x.*")


MARKED_SQL = " OR ".join("regexp_matches(block, '{}')".format(p.replace("'", "''")) for p in MARKERS)
TYPES_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(creditor), '{name}') OR regexp_matches(lower(creditor || ' ' || text), '{either}') THEN '{k}'" for k, name, either in BLOCK_TYPES) + " ELSE '' END"


@query("X7_text_parser", rf"""WITH b AS (SELECT ord, unnest(string_split_regex(text, '{DIVIDERS}')) AS raw, generate_subscripts(string_split_regex(text, '{DIVIDERS}'), 1) - 1 AS n FROM statements),
    s AS (SELECT ord, n, regexp_replace(raw, '{EDGES}', '', 'g') AS block FROM b), t AS (SELECT ord, n, regexp_replace(block, '\s+', ' ', 'g') AS text FROM s WHERE length(block) >= {SHORTEST_BLOCK} AND ({MARKED_SQL})),
    r AS (SELECT ord, n, text, {", ".join(f"trim(coalesce({first_of_sql(p)}, '')) AS {f}" for f, p in BLOCK_FIELDS.items())} FROM t),
    f AS (SELECT ord, n, creditor, CASE WHEN account_number = '' THEN '' ELSE '****' || regexp_replace(account_number, '^[*X]+', '') END AS account_number, {", ".join(f"CASE WHEN {x} = '' THEN '' ELSE '$' || {x} END AS {x}" for x in MONEY)}, date_opened,
        lower(account_status) AS account_status, {TYPES_SQL} AS account_type, regexp_matches(lower(account_status), '{NEGATIVE_STATUS}') OR regexp_matches(lower(text), '{NEGATIVE_BLOCK}') AS is_negative FROM r WHERE length(creditor) > 2)
    SELECT ord, creditor, account_number, CAST(n AS INTEGER) AS n, {", ".join(MONEY)}, date_opened, account_status, account_type, is_negative FROM f QUALIFY row_number() OVER (PARTITION BY ord, creditor, account_number ORDER BY n) = 1""")
def text_parser(v: Views) -> DataFrame:
    return text_accounts(v.dealt("statements", "o_orderkey"))


#: Creditors that begin an entry, and the patterns of its number, in order.
ENTRY_CREDITORS = ["CHASE CARD", "SCHOOLSFIRST", "BANK OF AMERICA", "CITIBANK", "CAPITAL ONE", "AMEX", "DISCOVER", "WELLS FARGO", "CLIMB CREDIT", r"CAPITAL ONE N\.A\."]
ENTRY_NUMBERS = [r"(?i)Account\s+[+:]?\s*(\d{4,}[Xx]*)", r"(?i)Account Number\s*[:#]?\s*(\d{4,}[Xx]*)", r"\b(\d{4,})(?:X{2,}|\*+)?\b", r"(?i)Acct\s*#[: ]*\s*(\d{4,}[Xx]*)"]
ENTRY_NEGATIVE = "(?i)collection|charge.?off|late"


def entries_of(reports: DataFrame, cleaned: bool = True) -> DataFrame:
    """Reports (ord, text) to entries, the valid and the rejected ones; ``errors`` says why, and is empty for valid ones.

    An entry begins where a line begins with a known creditor; what stands before the first one is an entry as well. The
    source also asks for the name of the account, which it never fills in, so that none would be valid: that is left out.
    Cleaning takes days and bureaus out of the text; without it (``cleaned``) an entry keeps its own.
    """
    parts = F.split(T.sanitize(c("text")) if cleaned else c("text"), "(?im)^(?=" + "|".join(ENTRY_CREDITORS) + ")")
    entry = reports.select("ord", F.posexplode(parts).alias("n", "entry")).where(strip(c("entry")) != "")
    e = c("entry")
    read = entry.select(
        "ord",
        "n",
        F.coalesce(F.nullif(strip(F.regexp_extract(e, r"(?i)^(.*?)(?:\n|Account Number:|Status:)", 1)), F.lit("")), F.lit("Unknown")).alias("creditor"),
        F.coalesce(first_of(e, ENTRY_NUMBERS), F.lit("N/A")).alias("account"),
        C.ladder(e, C.KEYWORD_STATUSES, F.lit("Unknown")).alias("status"),
        F.nullif(F.regexp_extract(e, ENTRY_NEGATIVE, 0), F.lit("")).alias("in_text"),
        F.regexp_replace(F.regexp_extract(e, r"(?i)Balance:\s*\$?([\d,]+\.?\d{0,2})", 1), ",", "").try_cast("decimal(38,2)").alias("amount"),
        F.nullif(F.regexp_extract(e, r"(?i)Date Opened:\s*(\d{2}/\d{2}/\d{4})", 1), F.lit("")).alias("date_opened"),
        F.coalesce(*[F.when(e.rlike(f"(?i){b}"), b) for b in ("Experian", "TransUnion", "Equifax")]).alias("credit_bureau"),
    )
    reason = F.coalesce("in_text", F.nullif(F.regexp_extract("status", ENTRY_NEGATIVE, 0), F.lit("")))
    short = [F.when(F.length("creditor") < 2, "Creditor name must be at least 2 characters."), F.when(F.length("account") < 4, "Account number must be at least 4 characters.")]
    return read.select(
        "ord",
        "n",
        "creditor",
        "account",
        "status",
        reason.isNotNull().alias("is_negative"),
        reason.alias("reason"),
        F.coalesce(F.regexp_replace(c("amount").cast("string"), r"\.?0+$|(?<=\.\d)0$", ""), F.lit("0")).alias("balance"),
        "date_opened",
        F.when(reason.isNotNull(), "Negative").otherwise("Good").alias("account_type"),
        "credit_bureau",
        F.array_join(F.array_compact(F.array(*short)), "; ").alias("errors"),
    )


@query("X7_X8_entry_parser")
def entry_parser(v: Views) -> DataFrame:
    """Entries of each report with their errors; a fixture holds the result."""
    return entries_of(v.reports)


#: A creditor and its number within a line; the first group counts as the number.
LINE_PATTERNS = [
    r"(?:AMERICAN EXPRESS|AMEX|AM EX)\s*[\#\-\s]*(\d{4,15})",
    r"(?:CAPITAL ONE|CAP ONE|CAPITALONE)\s*[\#\-\s]*(\d{4,16})",
    r"(?:CHASE|JP MORGAN|JPMORGAN)\s*[\#\-\s]*(\d{4,16})",
    r"(?:DISCOVER|DISC)\s*[\#\-\s]*(\d{4,16})",
    r"(?:CITI|CITIBANK|CITIBK)\s*[\#\-\s]*(\d{4,16})",
    r"(?:WELLS FARGO|WF|WFNNB)\s*[\#\-\s]*(\d{4,16})",
    r"(?:BANK OF AMERICA|BOA|BOFA)\s*[\#\-\s]*(\d{4,16})",
    r"(?:SYNCHRONY|SYNC)\s*[\#\-\s]*(\d{4,16})",
    r"(?:BARCLAYS|BARC)\s*[\#\-\s]*(\d{4,16})",
    r"([A-Z\s&]{3,30})\s*(?:ACCT|ACCOUNT|#)\s*[\#\-\s]*(\d{4,16})",
]
AROUND = {
    "account_balance": r"(?i)(?:balance|bal|owe[ds]?)\s*:?\s*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)",
    "credit_limit": r"(?i)(?:limit|credit limit|cl)\s*:?\s*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)",
    "monthly_payment": r"(?i)(?:payment|pmt|monthly)\s*:?\s*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)",
}

HITS = "array<struct<n: int, k: int, found: string, account: string>>"


def line_accounts(reports: DataFrame, last_group: int = 1) -> DataFrame:
    """Reports (ord, text) to a row for each line and pattern that finds a creditor; fields come from the lines around.

    Two lines before to four after count as around; they are cut from the text's own array and only for hits. A creditor
    of two letters or fewer gives no row. For the last pattern the first group is the name, which stands as the number,
    and the second one (``last_group``) is the number.
    """
    lines = reports.select("ord", F.split("text", "\n").alias("x"))

    def hits(line: Column, n: Column) -> Column:
        found = [F.when(line.rlike(f"(?i){p}"), F.struct(n.alias("n"), F.lit(k).alias("k"), F.regexp_extract(line, f"(?i){p}", 0).alias("found"), F.regexp_extract(line, f"(?i){p}", last_group if k == len(LINE_PATTERNS) - 1 else 1).alias("account"))) for k, p in enumerate(LINE_PATTERNS)]
        # every pattern asks for four digits: most lines have none and run no pattern
        return F.when(line.rlike(r"\d{4}"), F.array_compact(F.array(*found))).otherwise(F.array().cast(HITS))

    flat = lines.select("ord", "x", F.flatten(F.transform(F.transform("x", strip), hits)).alias("h"))
    start = lambda h: F.greatest(h["n"] - 2, F.lit(0))
    wide = F.transform("h", lambda h: F.struct(h["n"].alias("n"), h["k"].alias("k"), h["found"].alias("found"), h["account"].alias("account"), F.array_join(F.slice("x", start(h) + 1, h["n"] + 5 - start(h)), " ").alias("t")))
    t = c("t")
    found = flat.select("ord", F.inline(wide)).select(
        "ord",
        "n",
        "k",
        T.creditor_from_line(c("found")).alias("creditor"),
        c("account").alias("account_number"),
        *[F.regexp_extract(t, p, 1).alias(f) for f, p in AROUND.items()],
        D.opened_from_text(t).alias("date_opened"),
        C.ladder(t, C.TEXT_TYPES, F.lit("")).alias("account_type"),
        C.ladder(t, C.TEXT_STATUSES, F.lit("open")).alias("account_status"),
        C.ladder(t, C.TEXT_BUREAUS, F.lit("")).alias("credit_bureau"),
        t.rlike(f"(?i){C.NEGATIVE_TEXT}").alias("is_negative"),
        F.coalesce(F.nullif(F.regexp_extract(t, r"(?i)dispute[ds]?\s*:?\s*(\d+)", 1), F.lit("")).try_cast("int"), F.lit(0)).alias("dispute_count"),
    )
    return found.where("creditor <> ''")




def hits_sql(last_group: int) -> str:
    return " UNION ALL ".join(f"SELECT ord, n, t, {k} AS k, regexp_extract(line, '(?i){p}', 0) AS found, regexp_extract(line, '(?i){p}', {last_group if k == len(LINE_PATTERNS) - 1 else 1}) AS account_number FROM w" for k, p in enumerate(LINE_PATTERNS))


OPENED_SQL = r"regexp_extract(t, '(?i)(?:opened|open date|date opened)\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})', 1)"


def lines_sql(last_group: int) -> str:
    return rf"""WITH l AS (SELECT ord, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM statements),
    w AS (SELECT ord, n, regexp_replace(raw, '{EDGES}', '', 'g') AS line, string_agg(raw, ' ') OVER (PARTITION BY ord ORDER BY n ROWS BETWEEN 2 PRECEDING AND 4 FOLLOWING) AS t FROM l), h AS ({hits_sql(last_group)}),
    f AS (SELECT *, upper(trim(regexp_replace(regexp_replace(regexp_replace(found, '(?i)ACCT|ACCOUNT|#|\d+', '', 'g'), '[^A-Za-z0-9_\s&]', ' ', 'g'), '\s+', ' ', 'g'))) AS creditor, {OPENED_SQL} AS day FROM h WHERE found <> ''),
    p AS (SELECT *, string_split_regex(day, '[/-]') AS part FROM f WHERE length(creditor) > 2)
    SELECT ord, CAST(n AS INTEGER) AS n, k, creditor, account_number, {", ".join(f"regexp_extract(t, '{p}', 1) AS {f}" for f, p in AROUND.items())},
        CASE WHEN day = '' THEN '' ELSE CASE WHEN length(part[3]) = 2 THEN CASE WHEN TRY_CAST(part[3] AS INTEGER) > 50 THEN '19' ELSE '20' END ELSE '' END || part[3] || '/' || lpad(part[1], 2, '0') || '/' || lpad(part[2], 2, '0') END AS date_opened,
        {C.ladder_sql("t", C.TEXT_TYPES, "''")} AS account_type, {C.ladder_sql("t", C.TEXT_STATUSES, "'open'")} AS account_status, {C.ladder_sql("t", C.TEXT_BUREAUS, "''")} AS credit_bureau, regexp_matches(t, '(?i){C.NEGATIVE_TEXT}') AS is_negative,
        coalesce(TRY_CAST(nullif(regexp_extract(t, '(?i)dispute[ds]?\s*:?\s*(\d+)', 1), '') AS INTEGER), 0) AS dispute_count FROM p"""


@query("X9_document_lines", lines_sql(1))
def document_lines(v: Views) -> DataFrame:
    return line_accounts(v.statements)
