"""Sections, entries and lines of small reports, with the accounts worked out by hand."""

from ledgerloom.operators.entries import entries_of, line_accounts, sections_of, text_accounts
from ledgerloom.operators.validation import account_issues

A, B = "CHASE BANK USA ****1234 balance of 1,250.00", "CAPITAL ONE USA ****5678 limit of 2,500.00"
BLOCK = "BIG BANK Account Number: ****1234\nCurrent Balance: $1,250.00 Credit Limit: $5,000.00"


def reports(spark, *rows):
    return spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], "ord long, bureau string, text string")


def test_sections(spark):
    alike = f"Report\n{A}\n{B}"
    rows = reports(spark, ("Experian", alike), (None, alike), ("Equifax", "no sections"), ("TransUnion", f"{A}\n\n{B}\n\nshort"), ("Experian", None), ("Equifax", ""), (None, "nobody's account is on this first page\n \nthe second page has a balance of nothing"))
    found = {n: [] for n in range(7)}
    for r in sections_of(rows).orderBy("ord", "n").collect():
        found[r["ord"]].append(r["section"])
    assert found == {0: [A, B], 1: [A, B], 2: ["no sections"], 3: [A, B], 4: [], 5: [""], 6: ["nobody's account is on this first page", "the second page has a balance of nothing"]}


def test_text_accounts(spark):
    text = f"{BLOCK}\n\n{BLOCK} repeated\n-----\nCompany Name: NOBODY INC. ending in 4321, Status: Past Due, Opened: 1/2/99, car\n\nshort account"
    found = [tuple(r) for r in text_accounts(reports(spark, (None, text), (None, None), (None, ""))).orderBy("n").collect()]
    assert found == [
        # a name runs as far as its last fitting ending, here the "co" of "Account"
        (0, "BIG BANK Acco", "****1234", 0, "$1,250.00", "$5,000.00", "", "", "", "", False),
        (0, "NOBODY INC", "****4321", 2, "", "", "", "1/2/99", "past due", "", True),
    ]


def test_entries(spark):
    text = "preface 12\nCHASE CARD\nAccount Number: 4444XXXX\nBalance: $1,250.50\nDate Opened: 01/02/2020\nExperian\nCharged Off\nAMEX Status: open account Balance: 100.00 11112222"
    found = [tuple(r)[1:] for r in entries_of(reports(spark, (None, text), (None, None), (None, ""))).orderBy("n").collect()]
    assert found == [
        (0, "preface 12", "N/A", "Unknown", False, None, "0", None, "Good", None, "Account number must be at least 4 characters."),
        # cleaning takes days and bureaus out before an entry is read; "Charged Off" is no reason, the name of its status is
        (1, "CHASE CARD", "4444XXXX", "chargedOff", True, "chargedOff", "1250.5", None, "Negative", None, ""),
        (2, "AMEX", "11112222", "open", False, None, "100", None, "Good", None, ""),
    ]


def test_line_accounts(spark):
    text = "Experian\n\n  CHASE #12345678 and CITI 87654321\nBalance: $1,200.00 limit 5,000\nopened 1/2/99\nfar away\nrevolving\ncollection"
    found = [tuple(r) for r in line_accounts(reports(spark, (None, text), (None, None), (None, "WF"))).orderBy("n", "k").collect()]
    rest = ("1,200.00", "5,000", "", "1999/01/02", "credit_card", "open", "experian", False, 0)
    # the general pattern takes the name for the number
    assert found == [(0, 2, 2, "CHASE", "12345678", *rest), (0, 2, 4, "CITI", "87654321", *rest), (0, 2, 9, "CHASE", "CHASE ", *rest)]


def test_account_issues(spark):
    rows = [("a", "", 150000.0, "2027-01-01", "2020-01-01"), ("b", "Bank", 5000.0, "2020-01-01", "2023-01-01"), ("c", None, -100.0, None, None), ("d", "Bank", None, "2023-01-01", "2020-01-01")]
    frame = spark.createDataFrame(rows, "id string, creditor_name string, balance double, date_opened string, date_closed string")
    frame = frame.selectExpr("id", "creditor_name", "balance", "date(date_opened) date_opened", "date(date_closed) date_closed")
    found = sorted(tuple(r) for r in account_issues(frame, "2026-01-01").collect())
    assert found == [("a", "data_range"), ("a", "date_error"), ("a", "date_inconsistency"), ("a", "missing_data"), ("c", "data_range"), ("c", "missing_data"), ("d", "date_inconsistency")]
