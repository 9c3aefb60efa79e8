"""The first balanced JSON in a text, by depth as a running sum over its tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import Views, dealt

c = F.col
#: What a text is made of from its first bracket on: strings as a whole, brackets, and all that lies between.
TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[{}\[\]]|[^"{}\[\]]++'
VALID = "substring(rest, p.begin, p.end - p.begin + 1)"


def balanced(texts: DataFrame) -> DataFrame:
    """Rows of ``texts`` (id, text) with ``body``: the first object or array that is balanced and parses; null without one.

    Strings are told apart from the first bracket of the text on; brackets inside them do not count, and the two kinds of
    brackets count alike.  An opening bracket belongs to the closing one at which the depth is first lower again: the n-th
    opening and the n-th closing bracket of a level.  Texts are shuffled once, to tasks of a bounded number of rows, and places
    never; the work grows with the number of brackets.  Rows are told apart by their id, which must be unique; null and empty texts have no body.
    """
    dealt_texts = dealt(texts.select("id", "text"), "id")
    rest = dealt_texts.select("id", F.nullif(F.regexp_extract("text", r"(?s)[\[{].*", 0), F.lit("")).alias("rest"))
    tokens = F.transform(F.regexp_extract_all("rest", F.lit(TOKEN), F.lit(0)), lambda t: F.struct(F.length(t).alias("n"), F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0).alias("up")))
    parts = rest.where("rest is not null").select("id", F.posexplode(tokens).alias("at", "t")).select("id", "at", "t.n", "t.up")
    order = Window.partitionBy("id").orderBy("at")
    walked = parts.withColumn("end", F.sum("n").over(order)).withColumn("level", F.sum("up").over(order) + F.when(c("up") < 0, 1).otherwise(0)).where("up <> 0")
    number = F.row_number().over(Window.partitionBy("id", "level", "up").orderBy("at"))
    # below the first bracket's level a closing bracket comes first
    numbered = walked.withColumn("number", number - F.when((c("up") < 0) & (c("level") <= 0), 1).otherwise(0))
    pairs = numbered.groupBy("id", "level", "number").agg(F.max(F.when(c("up") > 0, c("end"))).alias("begin"), F.max(F.when(c("up") < 0, c("end"))).alias("end")).where("begin is not null and end is not null")
    # in order of place; when one has parsed the rest are not tried
    found = pairs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(c("begin").cast("int").alias("begin"), c("end").cast("int").alias("end")))).alias("pairs"))
    # what is carried from pair to pair is a place, not a text: it is copied each time
    first = F.expr(f"aggregate(pairs, 0L, (done, p) -> if(done > 0, done, if(try_parse_json({VALID}) is not null, shiftleft(cast(p.begin as bigint), 32) + p.end, 0L)))")
    placed = rest.join(found, "id", "left").select("id", "rest", first.alias("place"))
    begin, end = F.shiftright("place", 32).cast("int"), c("place").bitwiseAND((1 << 32) - 1).cast("int")
    return placed.select("id", F.when(c("place") > 0, F.substring("rest", begin, end - begin + 1)).alias("body"))


SQL = r"""WITH r AS (SELECT id, nullif(regexp_extract(text, '(?s)[\[{].*', 0), '') AS rest FROM model_answers), t AS (SELECT id, regexp_extract_all(rest, '(?s)"(?:[^"\\]|\\.)*"?|[{}\[\]]|[^"{}\[\]]+') AS tokens FROM r WHERE rest IS NOT NULL),
    e AS (SELECT id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM t), u AS (SELECT id, pos, length(token) AS n, CASE WHEN token IN ('{', '[') THEN 1 WHEN token IN ('}', ']') THEN -1 ELSE 0 END AS up FROM e),
    d AS (SELECT id, pos, up, sum(n) OVER w AS place, sum(up) OVER w AS depth FROM u WINDOW w AS (PARTITION BY id ORDER BY pos)),
    o AS (SELECT a.id, a.place AS b, min_by(z.place, z.pos) AS e FROM d a JOIN d z ON a.id = z.id AND z.pos > a.pos AND z.up = -1 AND z.depth = a.depth - 1 WHERE a.up = 1 GROUP BY ALL),
    k AS (SELECT o.id, o.b, substr(rest, CAST(o.b AS BIGINT), CAST(o.e - o.b + 1 AS BIGINT)) AS body FROM o JOIN r ON o.id = r.id)
    SELECT m.id, x.body FROM model_answers m LEFT JOIN (SELECT id, min_by(body, b) AS body FROM k WHERE json_valid(body) GROUP BY id) x ON m.id = x.id"""


@query("K2_balanced_json", SQL)
def bracketed_json(v: Views) -> DataFrame:
    """Answers of a model, of which some are cut off or hold brackets before, after and inside the strings of their JSON."""
    return balanced(v.model_answers.select("id", "text"))
