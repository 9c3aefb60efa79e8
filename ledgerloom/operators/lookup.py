"""Substring search between two columns through an index of short substrings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import Views

c = F.col
SIZE = 3


def grams(text: str, sizes: str) -> F.Column:
    """The different substrings of a column that have one of the sizes in an array."""
    return F.expr(f"array_distinct(flatten(transform({sizes}, n -> transform(if(length({text}) >= n, sequence(1, length({text}) - n + 1), cast(array() as array<int>)), i -> substring({text}, i, n)))))")


def contained(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (pattern, text) of the different values of two one-column tables in which the text contains the pattern.

    Texts are listed by their substrings of up to three characters.  A pattern is looked up by the rarest of its own, and
    what is found there is compared.  Null and empty patterns are in no pair.
    """
    p = patterns.toDF("pattern").where("pattern <> ''").distinct()
    t = texts.toDF("text").where("text <> ''").distinct()
    index = t.select("text", F.explode(grams("text", f"sequence(1, {SIZE})")).alias("gram"))
    number = index.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no text has is the rarest: it finds nothing
    own = p.select("pattern", F.explode(grams("pattern", f"array(least({SIZE}, length(pattern)))")).alias("gram")).join(number, "gram", "left")
    rarest = own.groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    return rarest.join(index, "gram").where(F.contains("text", "pattern")).select("pattern", "text")


@query("F14_J8_substring_lookup", """SELECT i.id, min_by(e.id, e.ord) AS existing_id FROM tradelines i JOIN tradelines e ON i.user_id = e.user_id AND i.date_opened = e.date_opened AND i.credit_bureau = e.credit_bureau
    WHERE i.creditor_name <> '' AND i.account_number <> '' AND e.ord < i.ord AND contains(lower(e.creditor_name), lower(i.creditor_name)) AND starts_with(e.account_number, left(i.account_number, 4)) GROUP BY i.id""")  # fmt: skip
def substring_lookup(v: Views) -> DataFrame:
    """The first record that came before with the same user, day and bureau, whose creditor's name contains this one's and
    whose account number begins with this one's first four characters.

    Names are compared as different values, once.  Stored records are reduced to the first of each key and beginning of the
    number, so all joins are on equal keys and no two records of a key meet.
    """
    key = ["user_id", "date_opened", "credit_bureau"]
    t = v.tradelines.select("id", "ord", *key, F.lower("creditor_name").alias("name"), F.left("account_number", F.lit(4)).alias("start"))
    beginnings = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.left("start", n)))
    stored = t.where("name <> '' and start <> ''").withColumn("start", F.explode(beginnings)).groupBy(*key, "start", c("name").alias("text")).agg(F.min("ord").alias("e_ord"), F.min_by("id", "ord").alias("e_id"))
    asked = t.where("name <> '' and start <> ''").withColumnRenamed("name", "pattern")
    met = asked.join(contained(asked.select("pattern"), stored.select("text")), "pattern").join(stored, [*key, "start", "text"]).where("e_ord < ord")
    return met.groupBy("id").agg(F.min_by("e_id", "e_ord").alias("existing_id"))
