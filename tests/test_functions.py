"""Scalar functions on small cases."""

import datetime
from decimal import Decimal

import pytest
from ledgerloom.functions import categories, dates, empties, money, text
from ledgerloom.operators.scalars import balanced_json, token_set_ratio
from ledgerloom.operators.windows import page_numbers
from pyspark.sql import functions as F


def values(spark, function, inputs):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in frame.orderBy("i").select(function(F.col("x"))).collect()]


CASES = [
    (text.account_digits, ["1234-5678-9012", "xxxx-xxxx-xxxx-1234", "ABC1234DEF5678", "123", "ABCD-EFGH", None], ["1234", "1234", "1234", "123", "", ""]),
    (text.account_first_4, ["****1234", "cba0000", "", None], ["1234", "CBA0", "", ""]),
    (text.match_creditor, ["CHASE BANK", "Chase", "Wells Fargo & Company", "Bank of America Corp", "TD Bank, N.A.", "Chase Bank, N.A.", "Navy Federal Credit Union", "Target Corporation", "USAA"], ["chase", "jp morgan chase", "wells fargo", "of america", "td na", "chase na", "navy federal union", "target corporation", "united automobile"]),
    (text.clean_creditor, ["Citizens Bank", "CAP1 CARD", None], ["CITIBANK", "CAPITAL ONE", ""]),
    (text.mask_account, ["1234567890", "12", ""], ["****7890", "12", "[Account Number]"]),
    (text.mask_ssn, ["123456789", ""], ["***-**-6789", "[SSN]"]),
    (text.document_title, ["photo_id", "unknown_type"], ["Photo ID / Driver's License", "UNKNOWN TYPE"]),
    (text.fix_misread, ["Credltor: CHASE BANK, Baiance: $1,250.00, Lirnit: $5,000.00"], ["Creditor: CHASE BANK, Balance: $1,250.00, Limit: $5,000.00"]),
    (text.sanitize, ["a\t\tb 7/23/24, 3:58 PM Experian é"], ["a b "]),
    (dates.iso, ["2020-01-15", "01/15/2020", "1/15/2020", "January 15, 2020", "2020-13-45", "not-a-date", None], ["2020-01-15"] * 4 + ["", "", ""]),
    (dates.us_text, ["12-25-2023", "2023/12/25", "25 Dec 2023", "13/32/2023"], ["12/25/2023"] * 3 + [""]),
    (dates.opened_from_text, ["Date Opened: 3/5/99", "opened 12/01/2004", "none"], ["1999/03/05", "2004/12/01", ""]),
    (money.to_decimal, ["$1,234.50", "(200)", "abc", None], [Decimal("1234.50"), Decimal("-200.00"), None, None]),
    (money.whole_dollars, ["1000", "5000.00", "100", "n/a"], ["$1,000", "$5,000", "$100", "n/a"]),
    (money.coerce, ["$12.50", "12", "abc"], ["$12.50", "$12", None]),
    (categories.type_of_creditor, ["HONDA FINANCIAL", "ROCKET MORTGAGE", "NAVIENT STUDENT LOAN", "LENDING CLUB", "UNKNOWN BANK", "WELLS FARGO AUTO"], ["Auto Loan", "Mortgage", "Student Loan", "Personal Loan", "Credit Card", "Credit Card"]),
    (categories.account_type, ["my account", "CC", None], ["My Account", "Credit Card", "Unknown"]),
    (categories.payment_status, ["In Collection", "CO", "30 days"], ["collection", "charged off", "30 days late"]),
    (empties.is_placeholder, [None, " ", "N/A", "0", "x"], [True, True, True, True, False]),
    (empties.needs_enrichment, [None, "", "$0.00", "$5"], [True, True, True, False]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_scalar(case, spark):
    function, inputs, expected = CASES[case]
    assert values(spark, function, inputs) == expected


def test_plausible_dates(spark):
    frame = spark.createDataFrame([(datetime.date(1969, 1, 1),), (datetime.date(2001, 1, 1),)], "d date")
    got = [r[0] for r in frame.select(dates.plausible(F.col("d"), F.lit("2001-08-02").cast("date"))).collect()]
    assert got == [None, datetime.date(2001, 1, 1)]


def test_token_set_ratio():
    assert token_set_ratio("Chase Bank", "BANK chase") == 100
    assert token_set_ratio("Chase", "Chase Bank USA") == 100
    assert token_set_ratio("abc", "xyz") == 0
    assert token_set_ratio("", "xyz") == 0


def test_balanced_json():
    import pandas as pd

    got = balanced_json(pd.Series(['x {"a": "}"} y', "no", '{bad} [1, 2]', None])).tolist()
    assert got == ['{"a": "}"}', None, "[1, 2]", None]


def test_page_numbers():
    assert page_numbers(1, 3) == [1, 2, 3]
    assert page_numbers(7, 40) == [1, None, 5, 6, 7, 8, 9, None, 40]


def test_bureau_fixture(spark):
    """A heading that names TransUnion: its name twice (0.9) and the phrase with it (0.7), all at the top."""
    from types import SimpleNamespace

    from ledgerloom.operators import bureaus

    text = "TransUnion Credit Report\n\n" + "\n\n".join(f"{name}\nAccount Number: ****{n}\nCredit Card\nBalance: $500.00" for name, n in (("CHASE BANK USA, N.A.", 1234), ("CAPITAL ONE BANK USA, N.A.", 5678), ("WELLS FARGO AUTO", 9012)))
    other = "x" * 60 + "\nThe following accounts are listed on your credit file\nVantageScore by Experian"
    v = SimpleNamespace(reports=spark.createDataFrame([(1, text), (2, other), (3, "Experian")], "ord long, text string"))
    counts = {(r.ord, r.bureau): (r.n, r.best) for r in bureaus.indicator_counts(v).collect()}
    assert counts == {(1, "TransUnion"): (3, 0.9), (2, "Equifax"): (1, 0.5), (2, "Experian"): (2, 0.9), (3, "Experian"): (3, 0.95)}
    found = {r.ord: (r.bureau, r.confidence) for r in bureaus.detected_bureau(v).collect()}
    assert found[1] == ("TransUnion", 0.8772) and found[3][0] == "Unknown"


def test_date_ranges(spark):
    from ledgerloom.operators.validation import field_score

    values = {"01/15/2020": -0.3, "01/15/2000": 0.9, "2000-12-31": 0.9, "99/99/2000": -0.3, "12-31-1899": -0.3, "": 0.3, "May 2000": -0.1}
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", field_score("date", F.col("v")).alias("s")).collect()
    assert {r.v: r.s for r in rows} == values
