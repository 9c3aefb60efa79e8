"""Tables in report text, as gaps and islands over classes of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import Views

c = F.col
#: Words of a header, what parts columns, what a row of columns holds.
HEADER, PARTS, WIDE = "(?i)(Account|Company|Balance|Status|Date|Creditor|Payment|Limit)", r"\s{2,}|\t", r"\t|\s{3,}"


def tables(reports: DataFrame) -> DataFrame:
    """Reports (ord, text) to the rows of their tables: ord, table_no and row_no from 1, headers and cells.

    A line with a word of a header and three or more columns opens a table and drops one that is still open; other lines
    with such a word and blank lines count for nothing.  Lines of three or more columns are rows; without a header the
    first one stands for it.  Any other line closes a table that has a row.  Null and empty texts have no table.

    What a line does depends on how many rows are open: none, a header alone, or more.  After a header the first row
    makes it more, so the next other line closes.  After that, or before any header, a run of one row leaves a header
    alone, which the next run takes as its own: so runs of one row count by their parity.  All of it is windows over a
    report's lines, so reports that are dealt by ``ord`` need no shuffle, and others one.
    """
    lines = reports.select("ord", F.posexplode(F.transform(F.split("text", "\n"), lambda l: F.regexp_replace(l, r"^\s+|\s+$", ""))).alias("n", "line")).where("line <> ''")
    cells, header = F.split("line", PARTS), c("line").rlike(HEADER)
    wide = F.size(cells) > 2
    kind = F.when(header, F.when(wide, "H")).when(c("line").rlike(WIDE), F.when(wide, "D")).otherwise("O")
    marked = lines.select("ord", "n", kind.alias("kind"), cells.alias("cells")).where("kind is not null")
    order = Window.partitionBy("ord").orderBy("n")
    inside = Window.partitionBy("ord", "block").orderBy("n")
    # blocks begin at headers; runs are rows between other lines
    blocks = marked.withColumn("block", F.sum(F.when(c("kind") == "H", 1).otherwise(0)).over(order))
    runs = blocks.withColumn("run", F.sum(F.when(c("kind") == "O", 1).otherwise(0)).over(inside)).withColumn("last_run", F.max("run").over(Window.partitionBy("ord", "block"))).withColumn("last_block", F.max("block").over(Window.partitionBy("ord")))
    # a block's first line is its header, if it has one
    rows = runs.withColumn("head", F.first(F.when(c("kind") == "H", c("cells"))).over(inside)).where("kind = 'D'")
    of_run, by_run = Window.partitionBy("ord", "block", "run"), Window.partitionBy("ord", "block").orderBy("number")
    # a header that no row follows before other lines waits for the next run
    led = rows.withColumn("number", F.dense_rank().over(Window.partitionBy("ord", "block").orderBy("run"))).withColumn("led", (c("block") > 0) & (c("number") == 1))
    ones = led.withColumn("rows", F.count("*").over(of_run)).withColumn("place", F.row_number().over(of_run.orderBy("n")))
    # of the runs without a header: how many of one row stand right before this one
    ones = ones.withColumn("base", F.coalesce(F.max(F.when(c("led") | (c("rows") > 1), c("number"))).over(by_run.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joins = ~c("led") & ((c("number") - c("base") - 1) % 2 == 1)
    # a run that joins the one before it shares its table
    table = F.sum(F.when(joins | (c("place") > 1), 0).otherwise(1)).over(inside)
    whole = ones.withColumn("table", table).select("ord", "block", "table", "n", "cells", "head", "led", (c("last_run") > c("run")).alias("followed"), (c("block") == c("last_block")).alias("at_end"))
    of_table = Window.partitionBy("ord", "block", "table")
    first = F.max("led").over(of_table)
    numbered = whole.withColumn("headed", first).withColumn("k", F.row_number().over(of_table.orderBy("n"))).withColumn("headers", F.when(c("headed"), c("head")).otherwise(F.first("cells").over(of_table.orderBy("n"))))
    # a table that a new header meets before any other line is dropped; the end of the text closes the last one
    closed = c("at_end") | F.min("followed").over(of_table)
    body = numbered.withColumn("closed", closed).where(c("closed") & (c("headed") | (c("k") > 1)))
    return body.select("ord", F.dense_rank().over(Window.partitionBy("ord").orderBy("block", "table")).alias("table_no"), (c("k") - F.when(c("headed"), 0).otherwise(1)).cast("int").alias("row_no"), "headers", "cells")


SQL = rf"""WITH RECURSIVE l AS (SELECT ord, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM grid_reports),
    s AS (SELECT ord, n, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM l), k AS (SELECT ord, line, string_split_regex(line, '{PARTS}') AS cells, row_number() OVER (PARTITION BY ord ORDER BY n) AS n FROM s WHERE line <> ''),
    m AS (SELECT ord, n, cells, CASE WHEN regexp_matches(line, '{HEADER}') THEN CASE WHEN len(cells) > 2 THEN 'H' ELSE '-' END WHEN regexp_matches(line, '{WIDE}') THEN CASE WHEN len(cells) > 2 THEN 'D' ELSE '-' END ELSE 'O' END AS kind FROM k),
    f AS (SELECT ord, 0 AS n, 0 AS had, 0 AS tab, NULL::VARCHAR[] AS headers, NULL::VARCHAR[] AS cells FROM (SELECT DISTINCT ord FROM m)
        UNION ALL SELECT m.ord, m.n, CASE m.kind WHEN 'H' THEN 1 WHEN 'D' THEN f.had + 1 WHEN 'O' THEN CASE WHEN f.had > 1 THEN 0 ELSE f.had END ELSE f.had END,
            CASE WHEN m.kind = 'H' OR (m.kind = 'D' AND f.had = 0) THEN f.tab + 1 ELSE f.tab END, CASE WHEN m.kind = 'H' OR (m.kind = 'D' AND f.had = 0) THEN m.cells ELSE f.headers END, CASE WHEN m.kind = 'D' AND f.had > 0 THEN m.cells END
        FROM f JOIN m ON m.ord = f.ord AND m.n = f.n + 1),
    g AS (SELECT ord, n, tab, headers, cells FROM f WHERE cells IS NOT NULL),
    lost AS (SELECT f.ord, f.tab FROM f JOIN m ON m.ord = f.ord AND m.n = f.n + 1 WHERE m.kind = 'H' AND f.had > 1)
    SELECT ord, dense_rank() OVER (PARTITION BY ord ORDER BY tab) AS table_no, CAST(row_number() OVER (PARTITION BY ord, tab ORDER BY n) AS INTEGER) AS row_no, headers, cells FROM g WHERE NOT EXISTS (SELECT 1 FROM lost WHERE lost.ord = g.ord AND lost.tab = g.tab)"""


@query("X12_text_tables", SQL)
def text_tables(v: Views) -> DataFrame:
    return tables(v.dealt("grid_reports", "o_orderkey").select("ord", "text"))
