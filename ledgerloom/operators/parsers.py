"""Accounts of a bureau's report: each bureau has its own layout, and the report's bureau decides which one is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..plans.views import Views
from .scalars import CLEAN_SQL

c = F.col
EXPERIAN, EQUIFAX, TRANSUNION = "Experian", "Equifax", "TransUnion"

#: Lines that end what came before, and lines that begin an account.
HEADERS = r"(?i)Potentially Negative Items|Accounts in Good Standing|Closed Accounts|Credit Accounts"
SEPARATORS = r"^\s*-{3,}\s*$|^\s*={3,}\s*$|^Account\s+Information\s+Summary|^Satisfactory\s+Accounts|^Potentially\s+Negative\s+Accounts"
STARTS = {
    EXPERIAN: r"(?i)^([A-Z\s&]+)(?:\s+Account|Acct)",
    EQUIFAX: r"^[A-Z\s&]{3,}(?:\s+\d+)?$",
    TRANSUNION: r"^[A-Z][a-z]*(?:\s+[A-Z][a-z]*)*$|^[A-Z\s&]+$",
}
#: For each field the patterns of its value, in order. Experian's are tried line by line.
LINE_NUMBER = [r"(?:Account|Acct)(?:\s*[#:]?\s*)(\d{4,16})", r"(?:Number|No|#)(?:\s*[:]?\s*)(\d{4,16})", r"\b(\d{4,16})\b"]
LINE_DATE = [r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b", r"\b(\d{1,2}[/-]\d{2,4})\b", r"\b(\w{3}\s+\d{4})\b", r"\b(\w{3}\s+\d{1,2},?\s+\d{4})\b"]
LINE_AMOUNT = [r"\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)", r"\b(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\b"]
BLOCK = {
    EQUIFAX: {
        "account_number": [r"Account\s+number:?\s*(\d{4,16})", r"Account:?\s*(\d{4,16})", r"#\s*(\d{4,16})"],
        "account_balance": [
            r"Balance:?\s*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)",
            r"Current\s+balance:?\s*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)",
            r"Amount\s+owed:?\s*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)",
        ],
        "credit_limit": [
            r"Credit\s+limit:?\s*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)",
            r"High\s+credit:?\s*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)",
            r"Limit:?\s*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)",
        ],
        "date_opened": [
            r"Date\s+opened:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
            r"Opened:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
            r"Open\s+date:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
        ],
    },
    TRANSUNION: {
        "account_number": [r"Account\s+Number:?\s*(\d{4,16})", r"Acct\s*#:?\s*(\d{4,16})", r"Account:?\s*(\d{4,16})"],
        "account_balance": [
            r"Current\s+Balance:?\s*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)",
            r"Balance:?\s*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)",
        ],
        "credit_limit": [
            r"Credit\s+Limit:?\s*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)",
            r"High\s+Balance:?\s*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)",
        ],
        "monthly_payment": [r"Monthly\s+Payment:?\s*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)"],
        "date_opened": [r"Date\s+Opened:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"],
    },
}
#: Words of a status, of a type and of a negative account, in order.
STATUS = {
    EXPERIAN: {"open": r"\b(open|current|ok)\b", "closed": r"\b(closed|terminated)\b", "charged_off": r"\b(charge[- ]?off|charged[- ]?off)\b", "in_collection": r"\b(collection|sold)\b"},
    EQUIFAX: {"open": r"\bopen\b|\bcurrent\b|\bgood\s+standing\b", "closed": r"\bclosed\b|\bterminated\b", "charged_off": r"\bcharge\s?off\b|\bcharged\s?off\b", "in_collection": r"\bcollection\b|\bsold\b"},
    TRANSUNION: {"open": r"\bOpen\b|\bCurrent\b", "closed": r"\bClosed\b", "charged_off": r"\bCharge\s?Off\b", "in_collection": r"\bCollection\b"},
}
KIND = {
    EQUIFAX: {"credit_card": r"\bcredit\s+card\b|\brevolving\b", "mortgage": r"\bmortgage\b|\bhome\s+loan\b", "auto_loan": r"\bauto\b|\bcar\b|\bvehicle\b", "installment": r"\binstallment\b"},
    TRANSUNION: {"credit_card": r"\bCredit\s+Card\b|\bRevolving\b", "mortgage": r"\bMortgage\b", "auto_loan": r"\bAuto\b|\bVehicle\b", "installment": r"\bInstallment\b"},
}
NEGATIVE = {EXPERIAN: "negative|collection", EQUIFAX: "collection|charge off|charged off|delinquent|late", TRANSUNION: "potentially negative|collection|charge off|delinquent"}
NO_DATE = "xx/xx/xxxxx"


def first_of(text: Column, low: Column, patterns: list[str]) -> Column:
    """The value of the first pattern that is found, null if none is; ``low`` is the text in small letters."""
    return F.coalesce(*[T.first_group(text, low, f"(?i){p}") for p in patterns])


def first_of_sql(text: str, patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, '(?i){p}', 1), '')" for p in patterns) + ")"


def named(text: Column, words: dict[str, str]) -> Column:
    """The first name whose words occur."""
    return F.coalesce(*[F.when(text.rlike(f"(?i){p}"), n) for n, p in words.items()])


def named_sql(text: str, words: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?i){p}') THEN '{n}'" for n, p in words.items()) + " END"


def by_form(choices: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(c("form") == form, x) for form, x in choices.items()])


def by_form_sql(choices: dict[str, str]) -> str:
    return "CASE form " + " ".join(f"WHEN '{form}' THEN {x}" for form, x in choices.items()) + " END"


FORM_SQL = f"CASE bureau WHEN '{EQUIFAX}' THEN '{EQUIFAX}' WHEN '{TRANSUNION}' THEN '{TRANSUNION}' ELSE '{EXPERIAN}' END"
FIELDS = ["account_number", "account_balance", "credit_limit", "monthly_payment", "date_opened"]
LINE_VALUES = {
    "number_": first_of_sql("line", LINE_NUMBER),
    "opened_": f"CASE WHEN regexp_matches(line, '(?i)opened') THEN {first_of_sql('line', LINE_DATE)} END",
    "balance_": f"CASE WHEN regexp_matches(line, '(?i)balance|owed|owes') THEN {first_of_sql('line', LINE_AMOUNT)} END",
    "limit_": f"CASE WHEN regexp_matches(line, '(?i)limit|credit') THEN {first_of_sql('line', LINE_AMOUNT)} END",
    "status_": named_sql("line", STATUS[EXPERIAN]),
}


def field_sql(name: str) -> str:
    line = {"account_number": "number_", "account_balance": "balance_", "credit_limit": "limit_", "date_opened": "opened_"}
    choices = {form: first_of_sql("body", patterns[name]) for form, patterns in BLOCK.items() if name in patterns}
    if name in line:
        choices[EXPERIAN] = line[name]
    value = by_form_sql(choices)
    return f"coalesce({value}, '{NO_DATE}')" if name == "date_opened" else f"coalesce({value}, '')" if name == "account_number" else f"replace(coalesce({value}, ''), ',', '')"


@query("X1_X2_X3_X4_bureau_parsers", f"""WITH raw_lines AS (SELECT ord, {FORM_SQL} AS form, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM statements),
    l AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM raw_lines),
    e AS (SELECT *, CASE form WHEN '{EXPERIAN}' THEN regexp_matches(line, '{HEADERS}') WHEN '{TRANSUNION}' THEN regexp_matches(raw, '{SEPARATORS}') ELSE false END AS ends,
        {by_form_sql({EXPERIAN: f"regexp_matches(line, '{STARTS[EXPERIAN]}')", EQUIFAX: f"length(line) > 3 AND regexp_matches(line, '{STARTS[EQUIFAX]}')", TRANSUNION: f"length(line) > 3 AND regexp_matches(line, '{STARTS[TRANSUNION]}')"})} AS starts FROM l WHERE line <> ''),
    p AS (SELECT *, last_value(CASE WHEN ends THEN 0 WHEN starts THEN n END IGNORE NULLS) OVER w AS rec, coalesce(last_value(CASE WHEN ends THEN line END IGNORE NULLS) OVER w, 'unknown') AS section, sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER w AS run FROM e WINDOW w AS (PARTITION BY ord ORDER BY n)),
    q AS (SELECT *, max(CASE WHEN NOT ends THEN run END) OVER (PARTITION BY ord, section) AS last_run FROM p),
    v AS (SELECT ord, form, rec, n, line, section, {", ".join(f"CASE WHEN form = '{EXPERIAN}' THEN {x} END AS {name}" for name, x in LINE_VALUES.items())} FROM q WHERE rec > 0 AND (form <> '{EXPERIAN}' OR run = last_run)),
    g AS (SELECT ord, form, rec, min_by(line, n) AS head, string_agg(line, ' ' ORDER BY n) AS body, min(section) AS section, {", ".join(f"{f}({x}, n) FILTER (WHERE {x} IS NOT NULL) AS {x}" for f, x in (("min_by", "number_"), ("min_by", "opened_"), ("max_by", "balance_"), ("max_by", "limit_"), ("max_by", "status_")))} FROM v GROUP BY 1, 2, 3),
    r AS (SELECT ord, form, CAST(rec AS INTEGER) AS line_no, CASE WHEN form = '{EXPERIAN}' THEN regexp_extract(head, '{STARTS[EXPERIAN]}', 1) ELSE head END AS creditor_name, {", ".join(f"{field_sql(f)} AS {f}" for f in FIELDS)},
        coalesce({by_form_sql({f: named_sql("body", w) for f, w in KIND.items()})}, '') AS account_type, coalesce({by_form_sql({EXPERIAN: "status_", **{f: named_sql("body", STATUS[f]) for f in BLOCK}})}, '') AS account_status,
        {by_form_sql({f: f"regexp_matches(lower({'section' if f == EXPERIAN else 'body'}), '{p}')" for f, p in NEGATIVE.items()})} AS is_negative FROM g)
    SELECT ord, line_no, form AS credit_bureau, {CLEAN_SQL} AS creditor, {", ".join(FIELDS)}, account_type, account_status, is_negative FROM r WHERE ({CLEAN_SQL}) <> '' AND (form <> '{EXPERIAN}' OR account_number <> '')""")  # fmt: skip
def bureau_parsers(v: Views) -> DataFrame:
    return accounts(v.dealt("statements", "o_orderkey"))


def accounts(reports: DataFrame) -> DataFrame:
    """Reports (ord, bureau, text) to accounts, one row each; an unknown bureau's report is read as Experian's.

    Experian: an account begins at a line that names creditor and account, and needs a number; it is negative if the
    heading above it says so, and what stands under a heading replaces what stood under the same heading before.
    Equifax: a line in capitals begins an account. TransUnion: a line in capitals or of capitalized words does, and a
    separator ends it. Null and empty texts have no accounts. ``ord`` is unique: rows that share it would be mixed. All
    windows and the grouping need reports dealt by ``ord`` and share that one shuffle.
    """
    form = F.when(c("bureau").isin(EQUIFAX, TRANSUNION), c("bureau")).otherwise(EXPERIAN)
    lines = reports.select("ord", form.alias("form"), F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("raw"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("line")))).alias("n", "x")).where("x.line <> ''")
    lines = lines.select("ord", "form", (c("n") + 1).alias("n"), "x.*")
    ends = F.coalesce(by_form({EXPERIAN: c("line").rlike(HEADERS), TRANSUNION: c("raw").rlike(SEPARATORS)}), F.lit(False))
    long = F.length("line") > 3
    starts = by_form({EXPERIAN: c("line").rlike(STARTS[EXPERIAN]), EQUIFAX: long & c("line").rlike(STARTS[EQUIFAX]), TRANSUNION: long & c("line").rlike(STARTS[TRANSUNION])})
    order = Window.partitionBy("ord").orderBy("n")
    placed = lines.withColumn("ends", ends).withColumn("starts", starts).select(
        "ord", "form", "n", "line", "ends",
        F.last(F.when(c("ends"), 0).when(c("starts"), c("n")), ignorenulls=True).over(order).alias("rec"),
        F.coalesce(F.last(F.when(c("ends"), c("line")), ignorenulls=True).over(order), F.lit("unknown")).alias("section"),
        F.sum(c("ends").cast("int")).over(order).alias("run"),
    )
    last_run = F.max(F.when(~c("ends"), c("run"))).over(Window.partitionBy("ord", "section"))
    kept = placed.withColumn("last_run", last_run).where((c("rec") > 0) & ((c("form") != EXPERIAN) | (c("run") == c("last_run"))))

    def on_line(value: Column) -> Column:
        return F.when(c("form") == EXPERIAN, value)

    line, low = c("line"), c("low")
    kept = kept.withColumn("low", F.lower("line"))
    digits = line.rlike(r"\d{4}")  # every pattern of a number asks for them
    values = {
        "number_": on_line(F.when(digits, first_of(line, low, LINE_NUMBER))),
        "opened_": on_line(F.when(low.contains("opened"), first_of(line, low, LINE_DATE))),
        "balance_": on_line(F.when(line.rlike("(?i)balance|owed|owes"), first_of(line, low, LINE_AMOUNT))),
        "limit_": on_line(F.when(line.rlike("(?i)limit|credit"), first_of(line, low, LINE_AMOUNT))),
        "status_": on_line(named(line, STATUS[EXPERIAN])),
    }
    valued = kept.select("ord", "form", "rec", "n", "line", "section", *[x.alias(k) for k, x in values.items()])
    blocks = valued.groupBy("ord", "form", "rec").agg(
        F.min_by("line", "n").alias("head"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ").alias("body"),
        F.min("section").alias("section"),
        *[F.min_by(k, F.when(c(k).isNotNull(), c("n"))).alias(k) for k in ("number_", "opened_")],
        *[F.max_by(k, F.when(c(k).isNotNull(), c("n"))).alias(k) for k in ("balance_", "limit_", "status_")],
    )
    blocks = blocks.withColumn("low", F.lower("body"))
    body = c("body")

    def field(name: str, line_value: str | None = None) -> Column:
        choices = {form: first_of(body, low, patterns[name]) for form, patterns in BLOCK.items() if name in patterns}
        return by_form(choices | ({EXPERIAN: c(line_value)} if line_value else {}))

    def amount(value: Column, name: str) -> Column:
        return F.replace(F.coalesce(value, F.lit("")), F.lit(","), F.lit("")).alias(name)

    name = F.when(c("form") == EXPERIAN, F.regexp_extract("head", STARTS[EXPERIAN], 1)).otherwise(c("head"))
    found = F.struct(
        "ord",
        c("rec").alias("line_no"),
        c("form").alias("credit_bureau"),
        T.clean_creditor(name).alias("creditor"),
        F.coalesce(field("account_number", "number_"), F.lit("")).alias("account_number"),
        amount(field("account_balance", "balance_"), "account_balance"),
        amount(field("credit_limit", "limit_"), "credit_limit"),
        amount(field("monthly_payment"), "monthly_payment"),
        F.coalesce(field("date_opened", "opened_"), F.lit(NO_DATE)).alias("date_opened"),
        F.coalesce(by_form({f: named(body, w) for f, w in KIND.items()}), F.lit("")).alias("account_type"),
        F.coalesce(by_form({EXPERIAN: c("status_"), **{f: named(body, STATUS[f]) for f in BLOCK}}), F.lit("")).alias("account_status"),
        by_form({f: (F.lower("section") if f == EXPERIAN else low).rlike(p) for f, p in NEGATIVE.items()}).alias("is_negative"),
    )
    # in a generator, as a filter would be pushed down and seek creditor and number twice
    return blocks.select(F.inline(F.filter(F.array(found), lambda x: (x["creditor"] != "") & ((x["credit_bureau"] != EXPERIAN) | (x["account_number"] != "")))))
