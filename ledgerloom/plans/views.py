"""Ledger-shaped views over the star schema, in SQL that Spark and DuckDB both read.

The tables hold no account reports, so every query runs on these projections: accounts and disputes come from orders,
people from customers, files from documents.  They contain blanks, placeholders, duplicates and mixed formats on
purpose.  All are narrow projections of one table: filters and columns are pushed down to its scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: Users grow with the tables: 25 customers' orders are one user's records.  Every date comparison is made against this day, never against the clock.
AS_OF = "2001-08-02"

CREDITORS = [
    "CHASE BANK", "Chase", "Wells Fargo & Company", "Bank of America Corp", "TD Bank, N.A.", "CAPITAL ONE", "AMEX", "Citi Card Services", "DISCOVER FINANCIAL SERVICES", "SYNCHRONY BANK",
    "HONDA FINANCIAL", "ROCKET MORTGAGE", "NAVIENT STUDENT LOAN", "LENDING CLUB", "", "Navy Federal Credit Union", "USAA", "FORD MOTOR CREDIT", "CITIZENS BANK",
]
STATUSES = ["Open", "Closed", "Charged Off", "Collection", "30 days late", "Current", "Paid", "", "Past Due", "Disputed", "charge off", "Transferred"]
TYPES = ["Credit Card", "Mortgage", "Auto Loan", "Student Loan", "credit_card", "", "Personal Loan", "Installment Loan"]


def pick(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


ISO = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
YEAR, MONTH, DAY = f"substr({ISO}, 1, 4)", f"substr({ISO}, 6, 2)", f"substr({ISO}, 9, 2)"
MONTH_NAME = f"substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST({MONTH} AS INT) * 3 - 2, 3)"


def dollars(value: str) -> str:
    return f"'$' || CAST(CAST(floor({value}) AS BIGINT) AS STRING)"


VIEWS = {
    "tradelines": f"""SELECT 'T' || CAST(o_orderkey AS STRING) AS id, o_orderkey AS ord, 'U' || CAST(CAST(floor(o_custkey / 25) AS BIGINT) AS STRING) AS user_id,
        {pick("o_orderkey", CREDITORS)} AS creditor_name,
        CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Unknown' WHEN 2 THEN '****' || CAST(1000 + o_custkey % 37 AS STRING) WHEN 3 THEN CAST(4000 + o_custkey % 37 AS STRING) || '-5678-9012'
            WHEN 4 THEN CAST(1000 + o_custkey % 37 AS STRING) || '****' WHEN 5 THEN 'cba' || CAST(o_custkey % 100 AS STRING) || '****' ELSE CAST(400000000000 + o_custkey AS STRING) END AS account_number,
        CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN '$0' ELSE {dollars("o_totalprice / 100")} END AS account_balance,
        CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN 'N/A' ELSE {dollars("o_totalprice / 60")} END AS credit_limit,
        CASE WHEN o_orderkey % 3 = 0 THEN '$0.00' WHEN o_orderkey % 4 = 0 THEN '' ELSE {dollars("o_totalprice / 3000")} END AS monthly_payment,
        {pick("(o_orderkey + o_custkey)", STATUSES)} AS account_status, {pick("o_custkey", TYPES)} AS account_type,
        CASE o_custkey % 6 WHEN 0 THEN {ISO} WHEN 1 THEN {MONTH} || '/' || {DAY} || '/' || {YEAR} WHEN 2 THEN '' WHEN 3 THEN {YEAR} || '/' || {MONTH} || '/' || {DAY}
            WHEN 4 THEN {MONTH} || '-' || {DAY} || '-' || {YEAR} ELSE {MONTH_NAME} || ' ' || CAST(CAST({DAY} AS INT) AS STRING) || ', ' || {YEAR} END AS date_opened,
        CASE o_orderkey % 4 WHEN 0 THEN 'Experian' WHEN 1 THEN 'Equifax' WHEN 2 THEN 'TransUnion' ELSE '' END AS credit_bureau,
        o_orderkey % 9 = 0 AS is_negative, CAST(o_orderkey % 3 AS INT) AS dispute_count, CAST(o_orderdate AS DATE) AS created_on, o_totalprice AS amount
        FROM orders""",
    "disputes": f"""SELECT 'D' || CAST(o_orderkey AS STRING) AS id, o_orderkey AS ord, 'U' || CAST(CAST(floor(o_custkey / 25) AS BIGINT) AS STRING) AS user_id, 'T' || CAST(o_orderkey AS STRING) AS tradeline_id,
        {pick("(o_orderkey + o_custkey)", ["pending", "in_progress", "resolved", "rejected", "generated", "processing", "submitted"])} AS status,
        {pick("o_orderkey", ["Experian", "Equifax", "TransUnion"])} AS bureau, {pick("o_custkey", ["high", "medium", "low"])} AS priority,
        CAST(o_orderdate AS DATE) AS created_on, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) AS updated_on,
        'Name ' || CAST(o_custkey AS STRING) || chr(10) || CAST(o_orderkey AS STRING) || ' Main St' || chr(10) || 'City' || CAST(o_custkey % 9 AS STRING) || ', ' || {pick("o_custkey", ["TX", "GA", "PA"])} || ' ' || CAST(10000 + o_custkey AS STRING) AS mailing_address,
        'I write regarding my account with ' || {pick("o_orderkey", CREDITORS)} || '.' AS letter
        FROM orders WHERE o_orderkey % 3 <> 1""",
    "profiles": f"""SELECT 'U' || CAST(c_custkey AS STRING) AS user_id, c_custkey AS ord, CASE WHEN c_custkey % 10 = 3 THEN '' ELSE 'First' || CAST(c_custkey AS STRING) END AS first_name, 'Van Last' || CAST(c_custkey % 7 AS STRING) AS last_name,
        CASE WHEN c_custkey % 8 = 1 THEN '' ELSE CAST(c_custkey AS STRING) || ' Oak Ave' END AS address, 'City' || CAST(c_nationkey AS STRING) AS city, {pick("c_custkey", ["TX", "GA", "PA", "ZZ"])} AS state,
        CASE c_custkey % 4 WHEN 0 THEN CAST(10000 + c_custkey AS STRING) WHEN 1 THEN CAST(10000 + c_custkey AS STRING) || '-1234' WHEN 2 THEN '12' ELSE '' END AS zip_code,
        CASE WHEN c_custkey % 5 = 2 THEN '' ELSE '1980-01-02' END AS date_of_birth, CASE c_custkey % 3 WHEN 0 THEN CAST(123450000 + c_custkey AS STRING) WHEN 1 THEN '123-45-' || CAST(1000 + c_custkey % 9000 AS STRING) ELSE '' END AS ssn,
        CASE c_custkey % 3 WHEN 0 THEN '555' || CAST(1000000 + c_custkey AS STRING) WHEN 1 THEN '(555) 123-4567' ELSE 'none' END AS phone, 'user' || CAST(c_custkey AS STRING) || '@example.com' AS email, c_mktsegment AS segment, c_acctbal AS acctbal
        FROM customer""",
    "user_documents": f"""SELECT 'F' || CAST(c_custkey AS STRING) AS id, 'U' || CAST(CAST(floor(c_custkey / 4) AS BIGINT) AS STRING) AS user_id, c_custkey AS ord, {pick("CAST(floor(c_custkey / 3) AS BIGINT)", ["photo_id", "ssn_card", "utility_bill", "tax_form_old"])} AS document_type,
        'U' || CAST(CAST(floor(c_custkey / 4) AS BIGINT) AS STRING) || '/' || CAST(c_custkey AS STRING) || '.pdf' AS file_path, {pick("c_custkey", ["image/png", "application/pdf", "text/plain"])} AS content_type FROM customer""",
    "user_roles": """SELECT 'U' || CAST(c_custkey AS STRING) AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'admin' ELSE 'user' END AS role FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT 'U' || CAST(c_custkey AS STRING) AS user_id, 'user' AS role FROM customer WHERE c_custkey % 9 = 0""",
    "name_readings": f"""SELECT ord, CASE WHEN ord % 3 = 0 THEN left(creditor_name, CAST(customer % 19 AS INT)) || substr(creditor_name, CAST(customer % 19 AS INT) + 2) ELSE creditor_name END AS creditor_name
        FROM (SELECT o_orderkey AS ord, o_custkey AS customer, {pick("o_orderkey", CREDITORS)} AS creditor_name FROM orders) AS named""",
    "model_answers": """SELECT 'T' || CAST(o_orderkey AS STRING) AS id, CASE o_orderkey % 7 WHEN 0 THEN 'answer: {"id": "' || CAST(o_custkey AS STRING) || '", "more": {"ord": [1, 2]}} and } more' WHEN 1 THEN '[note] {"a": "br } ace", "l": [1, {"b": ' || CAST(o_custkey AS STRING) || '}]} done'
        WHEN 2 THEN 'cut {"a": {"b": "q' || chr(92) || '"{", "c": [' || CAST(o_custkey AS STRING) || ', 2]}, "d"' WHEN 3 THEN 'nothing here' WHEN 4 THEN 'a stray } ] and [' || CAST(o_custkey AS STRING) || ', [2, 3]] tail {' WHEN 5 THEN '{bad} then {"k": "' || chr(92) || chr(92) || '", "n": ' || CAST(o_custkey AS STRING) || '} [' ELSE '' END AS text FROM orders""",
    "grid_reports": f"""SELECT o_orderkey AS ord, 'Report of July' || chr(10) || CASE o_orderkey % 4 WHEN 0 THEN 'Creditor   Balance   Status' || chr(10) WHEN 1 THEN 'Account' || chr(9) || 'Payment' || chr(9) || 'Limit' || chr(10) WHEN 2 THEN '' ELSE 'Status' || chr(10) END
        || {pick("o_custkey", CREDITORS)} || '    ' || CAST(o_custkey AS STRING) || '   Open' || chr(10) || CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'end of part' || chr(10) ELSE chr(10) || 'SECOND' || chr(9) || '12' || chr(9) || 'Closed' || chr(10) END
        || 'LAST ONE    ' || CAST(o_orderkey AS STRING) || '     Current' || chr(10) || CASE o_custkey % 5 WHEN 0 THEN 'page 2' || chr(10) WHEN 1 THEN 'two  parts' || chr(10) || 'Creditor   Date   Limit' || chr(10) || 'next' || chr(10) WHEN 2 THEN 'a   b' || chr(10) ELSE '' END
        || 'AFTER    1    2' || CASE o_orderkey % 3 WHEN 0 THEN chr(10) || 'end' || chr(10) || 'x    1    2' || chr(10) || 'note' || chr(10) || 'y    3    4' ELSE '' END AS text FROM orders""",
    # an expected account as CSV and the one found as JSON, some of either broken
    "evaluation_lines": f"""SELECT CAST(ord AS STRING) || ',' || replace(creditor, ',', ' ') || ',' || CASE WHEN ord % 41 = 0 THEN 'n/a' ELSE CAST(ord % 5000 AS STRING) || '.50' END || ',' || CASE WHEN ord % 5 = 0 THEN '' ELSE day END AS expected_line,
        CASE WHEN ord % 37 = 0 THEN 'no json' ELSE '{{"ord": ' || CAST(ord AS STRING) || CASE WHEN ord % 7 = 0 THEN '' ELSE ', "creditor": "' || CASE WHEN ord % 11 = 0 THEN lower(replace(creditor, ',', ' ')) ELSE replace(creditor, ',', ' ') END || '"' END || ', "balance": ' || CAST((ord + CASE WHEN ord % 13 = 0 THEN 1 ELSE 0 END) % 5000 AS STRING) || '.50' || CASE WHEN ord % 3 = 0 THEN '' ELSE ', "opened": "' || day || '"' END || '}}' END AS found_line
        FROM (SELECT o_orderkey AS ord, {pick("o_orderkey", ["CHASE BANK", "TD BANK, N.A.", "USAA", "AMEX"])} AS creditor, {ISO} AS day FROM orders) AS named""",
    "credit_reports": """SELECT 'T' || CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'U' || CAST(o_custkey AS STRING) ELSE concat_ws('-', lpad(lower(hex(o_custkey)), 8, '0'), '12d3', 'a456', '4266', lpad(lower(hex(o_orderkey)), 12, '0')) END AS user_id, o_orderkey % 1000 AS score,
        CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '{"orders": 1}' END AS report_data FROM orders""",
    "scan_responses": """SELECT o_orderkey AS ord, '{"negativeItems": [' || CASE o_orderkey % 3 WHEN 0 THEN '' ELSE '{"id": "N' || CAST(o_orderkey AS STRING) || '", "creditorName": "CHASE", "accountNumber": "' || CAST(o_custkey AS STRING) || '", "amount": ' || CAST(o_orderkey % 900 AS STRING) || ', "bureaus": ["Experian", "Equifax"], "reason": "late", "status": "open", "extra": {"a": 1}}' END
        || CASE o_orderkey % 3 WHEN 2 THEN ', {"id": "M' || CAST(o_orderkey AS STRING) || '", "amount": 12, "dateReported": "2020-01-02", "bureaus": []}' ELSE '' END || '], "summary": "x"}' AS response FROM orders""",
    "sections": f"""SELECT o_orderkey AS ord, {pick("o_orderkey", CREDITORS)} || chr(10) || 'Account Number: ' || CASE o_orderkey % 3 WHEN 0 THEN '****' || CAST(1000 + o_custkey % 9000 AS STRING) WHEN 1 THEN CAST(400000000000 + o_custkey AS STRING) ELSE 'XXXX' || CAST(1000 + o_custkey % 9000 AS STRING) END || chr(10)
        || CASE o_orderkey % 4 WHEN 0 THEN 'Current Balance: $' WHEN 1 THEN 'Bal: $' WHEN 2 THEN 'Amount owed $' ELSE 'Balance $' END || CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING) || ',250.00' || chr(10)
        || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Credit Limit: $5,000.00' || chr(10) END || CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE 'Monthly Payment: $' || CAST(o_custkey % 400 AS STRING) || '.00' || chr(10) END
        || 'Date Opened: ' || {MONTH} || '/' || {DAY} || '/' || CASE WHEN o_orderkey % 2 = 0 THEN {YEAR} ELSE substr({YEAR}, 3, 2) END || chr(10) || 'Account Status: ' || {pick("(o_orderkey + o_custkey)", STATUSES)} || chr(10)
        || CASE o_orderkey % 5 WHEN 0 THEN '30 days late, dispute: 2' WHEN 1 THEN 'pays as agreed' WHEN 2 THEN 'collection via TransUnion' WHEN 3 THEN 'Experian auto loan' ELSE 'charge off, Equifax student' END AS text FROM orders""",
    "reports": f"""SELECT o_custkey AS ord, CASE o_custkey % 5 WHEN 0 THEN 'EXPERIAN' || chr(10) || 'Experian Consumer Services, Allen, TX 75013' || chr(10) || 'Potentially Negative Items' || chr(10) WHEN 1 THEN 'EQUIFAX' || chr(10) || 'Equifax Credit Information Services' || chr(10)
        WHEN 2 THEN 'Credit Report from TransUnion' || chr(10) || 'Satisfactory Accounts' || chr(10) WHEN 3 THEN 'short' ELSE 'Experian Equifax TransUnion combined personal credit file' || chr(10) END
        || CASE WHEN o_custkey % 5 = 3 THEN '' ELSE 'CHASE BANK USA' || chr(10) || 'Account: ' || CAST(40000000 + o_custkey AS STRING) || chr(10) || 'Opened 01/15/2020 Balance $1,250.00' || chr(10) || 'Status: Current' || chr(10) || 'CAPITAL ONE' || chr(10)
        || 'Account Number ' || CAST(627804 + o_custkey AS STRING) || 'XXXX' || chr(10) || 'Charge off in Jan 2019, late payment, limit $500' || chr(10) || 'Generated by Equifax 7/23/24, 3:58 PM' || chr(10) || 'payment history and balance' END AS text, count(*) AS n_orders FROM orders GROUP BY o_custkey""",
    "statements": f"""SELECT o_orderkey AS ord, {pick("o_orderkey", ["Experian", "Equifax", "TransUnion", ""])} AS bureau, CASE o_orderkey % 4
        WHEN 1 THEN 'Accounts with adverse information' || chr(10) || upper({pick("o_custkey", CREDITORS)}) || chr(10) || 'Account number: ' || CAST(40000000 + o_custkey AS STRING) || chr(10) || 'Date opened: ' || {MONTH} || '/' || {DAY} || '/' || {YEAR} || chr(10) || chr(10)
            || 'Current balance: $' || CAST(10 + o_custkey % 90 AS STRING) || ',250.00' || chr(10) || CASE WHEN o_custkey % 2 = 0 THEN 'High credit 900' ELSE 'Credit limit: $5,000' END || chr(10) || 'Revolving, ' || {pick("(o_orderkey + o_custkey)", STATUSES)} || chr(10) || 'DISCOVER 22' || chr(10) || '  # 5555123456  Home loan, terminated'
        WHEN 2 THEN 'Account Information Summary' || chr(10) || {pick("o_custkey", CREDITORS)} || chr(10) || 'Account Number: ' || CAST(40000000 + o_custkey AS STRING) || chr(10) || 'Date Opened: ' || {MONTH} || '-' || {DAY} || '-' || {YEAR} || chr(10)
            || 'Balance: $' || CAST(10 + o_custkey % 90 AS STRING) || ',250.00' || chr(10) || 'High Balance: $5,000; Monthly Payment: $35.00' || chr(10) || {pick("(o_orderkey + o_custkey)", STATUSES)} || ' vehicle' || chr(10) || ' ----- ' || chr(10) || 'Account: 12345678 of nobody' || chr(10) || 'NAVY FEDERAL' || chr(10) || 'Acct #: 5555123456, installment'
        ELSE 'Report of July' || chr(10) || 'Potentially Negative Items' || chr(10) || {pick("o_custkey", CREDITORS)} || ' Account: ' || CAST(40000000 + o_custkey AS STRING) || chr(10) || 'Opened: ' || {MONTH} || '/' || {YEAR} || ' Balance: $' || CAST(10 + o_custkey % 90 AS STRING) || ',250.00' || chr(10)
            || {pick("(o_orderkey + o_custkey)", STATUSES)} || ', limit $5,000' || chr(10) || 'Accounts in Good Standing' || chr(10) || 'WELLS FARGO Account #' || CAST(627804 + o_custkey AS STRING) || chr(10) || 'opened Jan 2019, owes 1,200.00' || chr(10) || 'Current'
            || CASE WHEN o_custkey % 3 = 0 THEN chr(10) || 'Potentially Negative Items' || chr(10) || 'USAA Account: 77771234' || chr(10) || 'balance $90, closed' ELSE '' END END AS text FROM orders""",
    # a job or dispute for every user and tenth of the events' keys, with a row for each change of its status
    "job_log": """SELECT 'J' || CAST(user_id AS STRING) || '-' || CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10 AS STRING) AS id, event_id AS seq, CAST(ts AS TIMESTAMP) AS ts,
        CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status FROM events""",
    "dispute_log": """SELECT 'D' || CAST(user_id AS STRING) || '-' || CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10 AS STRING) AS id, event_id AS seq, CAST(ts AS TIMESTAMP) AS ts,
        CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'in_progress' WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'resolved' ELSE 'deleted' END AS status FROM events""",
    "files": """SELECT doc_id, source, lang, text, n_chars * 700 AS n_bytes, CASE doc_id % 7 WHEN 0 THEN 'scan_' || CAST(doc_id AS STRING) || '.pdf' WHEN 1 THEN 'report.PDF' WHEN 2 THEN 'photo.jpeg' WHEN 3 THEN 'letter.docx' WHEN 4 THEN 'notes.txt' WHEN 5 THEN 'archive.zip' ELSE 'noextension' END AS name,
        CASE WHEN doc_id % 5 = 0 THEN 'application/octet-stream' ELSE 'application/pdf' END AS mime, CAST(doc_id % 400 AS INT) AS pages FROM documents""",
}


#: Rows of a table in one task of a query that makes many rows of each.
ROWS_IN_TASK = 50_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt by ``key`` to as many tasks as they need: what works by this key afterwards needs no other shuffle,
    and a task stays as small when the table grows."""
    number = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_IN_TASK))
    return rows.repartition(number, key)


class Views:
    """The views of one dataset, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return self.over(name, self.table)

    def over(self, name: str, table: Callable[[str], DataFrame]) -> DataFrame:
        """A view over tables that ``table`` gives, such as streams."""
        text = VIEWS[name]
        bases = {b: table(b) for b in ("orders", "customer", "documents", "events") if re.search(rf"FROM {b}\b", text)}
        text = text.replace("{", "{{").replace("}", "}}")
        for b in bases:
            text = re.sub(rf"FROM {b}\b", f"FROM {{{b}}}", text)
        return self.spark.sql(text, **bases)

    def dealt(self, name: str, key: str) -> DataFrame:
        """A view over a table whose rows are dealt by the table's ``key`` before the view makes texts of them."""
        return self.over(name, lambda base: dealt(self.table(base), key))

    @cached_property
    def as_of(self) -> str:
        return AS_OF


def with_views(sql: str) -> str:
    """The SQL with the views it names in front, for DuckDB."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    front = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    start = re.match("WITH (RECURSIVE )?", body)
    return f"WITH {start[1] or ''}{front}, {body[start.end() :]}" if start else f"WITH {front} {body}"
