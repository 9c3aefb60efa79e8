"""Readings as they are meant, whole records and evaluation inputs, worked out by hand."""

from ledgerloom.operators.entries import entries_of, line_accounts
from ledgerloom.operators.meant import ENRICHED, enriched, fixed, meant_fields
from ledgerloom.sources import evaluation
from pyspark.sql import functions as F

BLOCKS = [
    "CHASE BANK USA, N.A.\nAccount Number: ****1234\nCredit Card\nCurrent Balance: $1,250.00\nCredit Limit: $5,000.00\nPayment Status: Current\nDate Opened: 01/15/2020\nMonthly Payment: $35.00",
    "DISCOVER\nCurrent Balance: $10.00\nreported by Equifax and Experian",
    "SYNCB/CARE SHOP\n30 days late\nAccount Status: Charged Off\nClosed: 02-03-2018" + " " * 200,
    "nobody in particular",
    None,
]


def test_fields(spark):
    frame = spark.createDataFrame(list(enumerate(BLOCKS)), "ord long, text string")
    rows = {r["ord"]: r for r in meant_fields(frame).collect()}
    assert rows.keys() == {0, 1, 2}
    assert (rows[0].payment_status, rows[0].account_status, rows[0].account_balance, rows[0].credit_bureau, rows[0].confidence) == ("Current", "Current", "1,250.00", "Unknown", 0.95)
    # "current" in "Current Balance" is no status; the first bureau in the order of the list is taken
    assert (rows[1].payment_status, rows[1].account_status, rows[1].account_balance, rows[1].credit_bureau, rows[1].confidence) == (None, None, "10.00", "Experian", 0.4)
    assert (rows[2].payment_status, rows[2].account_status, rows[2].date_closed, rows[2].confidence) == ("30", "Charged Off", "02-03-2018", 0.55)


def test_entries_keep_days_and_bureaus(spark):
    text = "CHASE CARD\nAccount Number: 4444XXXX\nBalance: $1,250.50\nDate Opened: 01/02/2020\nExperian\nCharged Off\nAMEX Status: open account Balance: 100.00 11112222"
    frame = spark.createDataFrame([(0, text), (1, None)], "ord long, text string")
    got = [(r.creditor, r.account, r.balance, r.date_opened, r.credit_bureau, r.errors) for r in entries_of(frame, cleaned=False).orderBy("n").collect()]
    assert got == [("CHASE CARD", "4444XXXX", "1250.5", "01/02/2020", "Experian", ""), ("AMEX", "11112222", "100", None, None, "")]


def test_lines_have_numbers(spark):
    frame = spark.createDataFrame([(0, "BIG STORE ACCT # 12345678")], "ord long, text string")
    assert [(r.creditor, r.account_number) for r in line_accounts(frame, last_group=2).collect()] == [("BIG STORE", "12345678")]


def test_enriched_records(spark):
    names = ["id", "creditor_name", "credit_bureau", "date_opened", "e_id", *ENRICHED, *[f"e_{x}" for x in ENRICHED]]
    new, full = ["$5", "$6", "$7", "Open", "Card", "12345678"], ["$1", "$2", "$3", "Closed", "Loan", "1234"]
    rows = [
        ("a", "N", "E", "d", "x", *new, *full[:5], ""),  # nothing of the five needs a value
        ("b", "N", "E", "d", "x", *new, "$0", *full[1:]),
        ("c", "N", "E", "d", "x", "", *new[1:], None, *full[1:5], ""),  # an empty value is taken as well
        ("d", "N", "E", "d", None, *new, *[None] * 6),
        ("e", "N", "E", "", "x", *new, "", *full[1:]),
    ]
    got = {r.id: tuple(r[x] for x in ENRICHED) for r in enriched(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))).collect()}
    assert got == {"b": ("$5", *full[1:]), "c": ("", *full[1:5], "12345678")}


def test_fixed_records(spark):
    schema = "id string, creditor_name string, account_number string, credit_bureau string, account_balance string, credit_limit string, monthly_payment string, date_opened string, account_type string, account_status string, is_negative boolean, dispute_count int"
    frame = spark.createDataFrame([("a", " chase ", " NULL", "Equifax", None, "$1", "", None, None, "", None, None), ("b", None, *[None] * 10), ("c", "", *[None] * 10), ("d", "x", " 12 ", *[None] * 9)], schema)
    got = [tuple(r) for r in fixed(frame, F.lit("Experian")).orderBy("id").collect()]
    assert got == [("a", "CHASE", "", "Experian", "", "$1", "", "", "other", "", False, 0), ("d", "X", "12", "Experian", "", "", "", "", "other", "other", False, 0)]


def test_evaluation_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("ord,creditor,balance,opened\n1,CHASE,10.50,2020-01-02\n2,AMEX,abc,2020-01-02\n3,USAA,5.00,\n4,CITI,1.00,2021-01-01\n")
    (tmp_path / "f.json").write_text('{"ord": 1, "creditor": "CHASE", "balance": 10.5, "opened": "2020-01-02"}\nbroken\n{"ord": 3, "creditor": "usaa", "balance": 5.00}\n{"ord": 9, "creditor": "X"}\n')
    expected, found = evaluation.read_expected(spark, str(tmp_path / "e.csv")), evaluation.read_found(spark, str(tmp_path / "f.json"))
    assert [r._bad for r in expected.collect() if r._bad] == ["2,AMEX,abc,2020-01-02"]
    got = {r.field: tuple(r)[1:] for r in evaluation.agreement(expected, found).collect()}
    assert got == {"creditor": (3, 3, 1, 0.333333, 0.333333, 1, 1), "balance": (3, 2, 2, 1.0, 0.666667, 1, 1), "opened": (2, 1, 1, 1.0, 0.5, 1, 1)}
    none = evaluation.agreement(expected.limit(0), found.limit(0)).collect()
    assert all(tuple(r)[1:] == (0, 0, 0, None, None, 0, 0) for r in none)
