"""Evaluation inputs: expected and found accounts as text, with the rows that cannot be read, and how well they agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import Views

c = F.col
BAD = "_bad"
EXPECTED, FOUND = "ord long, creditor string, balance decimal(18,2), opened date", "ord long, creditor string, balance decimal(18,2), opened date"
FIELDS = ["creditor", "balance", "opened"]


def read_expected(spark: SparkSession, path: str, schema: str = EXPECTED) -> DataFrame:
    """CSV files with a header; a row that does not fit the schema keeps its text in the column ``_bad``."""
    return spark.read.schema(f"{schema}, {BAD} string").option("header", True).option("columnNameOfCorruptRecord", BAD).option("mode", "PERMISSIVE").csv(path)


def read_found(spark: SparkSession, path: str, schema: str = FOUND) -> DataFrame:
    """JSON lines; a line that is no object or does not fit the schema keeps its text in the column ``_bad``."""
    return spark.read.schema(f"{schema}, {BAD} string").option("columnNameOfCorruptRecord", BAD).option("mode", "PERMISSIVE").json(path)


def agreement(expected: DataFrame, found: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """One row for each field: values expected, found and equal, precision and recall, and the bad rows of both sides.

    Rows are aligned by ``ord``, good ones only; of several rows of one key the smallest counts.  A field counts as
    expected or found where it has a value.  Without any value a share is null.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        good = rows.where(c(BAD).isNull() & c("ord").isNotNull())
        return good.groupBy("ord").agg(F.min(F.struct(*fields)).alias(name))

    # whether a row of a file is bad is only known if all its columns are read
    bad = [rows.agg(F.count(F.when(c(BAD).isNotNull(), F.struct(*rows.columns))).alias(n)) for rows, n in ((expected, "bad_expected"), (found, "bad_found"))]
    both = side(expected, "e").join(side(found, "f"), "ord", "full")
    counts = both.agg(*[F.struct(F.count(f"e.{x}").alias("n_expected"), F.count(f"f.{x}").alias("n_found"), F.count(F.when(c(f"e.{x}") == c(f"f.{x}"), 1)).alias("n_equal")).alias(x) for x in fields])
    rows = counts.select(F.inline(F.array(*[F.struct(F.lit(x).alias("field"), *[c(f"{x}.{n}").alias(n) for n in ("n_expected", "n_found", "n_equal")]) for x in fields])))
    # three single rows meet
    rows = rows.join(F.broadcast(bad[0])).join(F.broadcast(bad[1]))
    share = lambda n: F.round(F.try_divide(c("n_equal"), c(n)), 6)
    return rows.select("field", "n_expected", "n_found", "n_equal", share("n_found").alias("precision"), share("n_expected").alias("recall"), "bad_expected", "bad_found")


@query("S22_evaluation", r"""WITH e AS (SELECT string_split(expected_line, ',') AS x FROM evaluation_lines), f AS (SELECT found_line AS y, json_valid(found_line) AS ok FROM evaluation_lines),
    a AS (SELECT TRY_CAST(x[1] AS BIGINT) AS ord, nullif(x[2], '') AS creditor, TRY_CAST(nullif(x[3], '') AS DECIMAL(18, 2)) AS balance, TRY_CAST(nullif(x[4], '') AS DATE) AS opened, len(x) <> 4 OR (x[3] <> '' AND TRY_CAST(x[3] AS DECIMAL(18, 2)) IS NULL) AS bad FROM e),
    b AS (SELECT CAST(json_extract_string(y, '$.ord') AS BIGINT) AS ord, json_extract_string(y, '$.creditor') AS creditor, CAST(json_extract_string(y, '$.balance') AS DECIMAL(18, 2)) AS balance, CAST(json_extract_string(y, '$.opened') AS DATE) AS opened FROM f WHERE ok),
    j AS (SELECT a.creditor AS c1, a.balance AS b1, a.opened AS o1, b.creditor AS c2, b.balance AS b2, b.opened AS o2 FROM (SELECT * FROM a WHERE NOT bad) a FULL JOIN b ON a.ord = b.ord),
    n AS (SELECT 'creditor' AS field, count(c1) AS n_expected, count(c2) AS n_found, count(*) FILTER (WHERE c1 = c2) AS n_equal FROM j UNION ALL SELECT 'balance', count(b1), count(b2), count(*) FILTER (WHERE b1 = b2) FROM j UNION ALL SELECT 'opened', count(o1), count(o2), count(*) FILTER (WHERE o1 = o2) FROM j)
    SELECT *, round(n_equal / n_found, 6) AS precision, round(n_equal / n_expected, 6) AS recall, (SELECT count(*) FROM a WHERE bad) AS bad_expected, (SELECT count(*) FROM f WHERE NOT ok) AS bad_found FROM n""")  # fmt: skip
def evaluation(v: Views) -> DataFrame:
    """Expected accounts as lines of CSV and found ones as lines of JSON, some of which are broken."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    lines = v.evaluation_lines
    expected = lines.select(F.from_csv("expected_line", f"{EXPECTED}, {BAD} string", options).alias("x")).select("x.*")
    found = lines.select(F.from_json("found_line", f"{FOUND}, {BAD} string", options).alias("x")).select("x.*")
    return agreement(expected, found)
