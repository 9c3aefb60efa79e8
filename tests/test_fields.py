"""The fields of report sections, worked out by hand."""

from ledgerloom.operators.extraction import fields

BLOCKS = [
    "CHASE BANK USA, N.A.\nAccount Number: ****1234\nCredit Card\nCurrent Balance: $1,250.00\nCredit Limit: $5,000.00\nPayment Status: Current\nDate Opened: 01/15/2020\nMonthly Payment: $35.00",
    "CAPITAL ONE BANK USA, N.A.\nAccount Number: ****5678\nCredit Card\nBalance: $500.00\nHigh Credit: $2,500.00\nPayment Status: Current\nOpened: 03/22/2019",
    "WELLS FARGO AUTO\nAccount Number: ****9012\nAuto Loan\nCurrent Balance: $15,000.00\nHigh Credit: $25,000.00\nPayment Status: Current\nDate Opened: 06/10/2021\nMonthly Payment: $320.00",
    "SYNCB/CARE SHOP\n5243****0039 Balance: 0.00, amount owed $75\n30 days late",
    "macy's store\nClosed: 02-03-2018\nstatus: charged off",
    "nobody in particular",
    None,
    "",
]
EXPECTED = [
    ("Chase Bank", "****1234", "1,250.00", "5,000.00", "35.00", "01/15/2020", None, "Current", "Current\nDate Opened"),
    ("Capital One", "****5678", "500.00", "2,500.00", None, "03/22/2019", None, "Current", "Current\nOpened"),
    ("Wells Fargo", "****9012", "15,000.00", "25,000.00", "320.00", "06/10/2021", None, "Current", "Current\nDate Opened"),
    ("Syncb/Care Shop", "5243****", "75", None, None, None, None, "30", None),
    ("Macy'S", None, None, None, None, None, "02-03-2018", "Charged Off", "Charged Off"),
]


def test_fields(spark):
    frame = spark.createDataFrame(list(enumerate(BLOCKS)), "ord long, text string")
    rows = fields(frame).orderBy("ord").collect()
    assert [r["ord"] for r in rows] == [0, 1, 2, 3, 4]
    assert [tuple(r)[1:] for r in rows] == EXPECTED
