"""Vector functions over the embeddings table, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import Views

c = F.col


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


@query("Y1_Y2_Y3_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, len(embedding) AS dims, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first_component FROM embeddings")
def norms(v: Views) -> DataFrame:
    e = v.table("embeddings")
    unit = F.transform("embedding", lambda x: x.cast("double") / c("n"))
    return e.select("vec_id", "embedding", norm(c("embedding")).alias("n")).select("vec_id", F.round("n", 6).alias("norm"), F.size("embedding").cast("long").alias("dims"), F.round(F.get(unit, F.lit(0)), 6).alias("first_component"))


@query("Y4_average_vector", "SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2")
def average_vector(v: Views) -> DataFrame:
    return v.table("embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(c("x").cast("double")), 6).alias("mean"))


@query("Y5_match_documents", """WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * qe[i]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(qe, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS similarity FROM embeddings, q WHERE label = 3 AND vec_id <> 7 ORDER BY 2 DESC, 1 LIMIT 10""")
def match_documents(v: Views) -> DataFrame:
    """The ten rows of a label that are most like one query: a top-k report over all rows, the query being one row."""
    e = v.table("embeddings")
    one = e.where("vec_id = 7").select(c("embedding").alias("q")).limit(1)
    scored = e.where("label = 3 and vec_id <> 7").join(F.broadcast(one)).select("vec_id", F.round(dot(c("embedding"), c("q")) / (norm(c("embedding")) * norm(c("q"))), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "vec_id").limit(10)
