"""Which bureau a report comes from: weighted indicators, positions and sections."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import Views

c = F.col
BUREAUS = ["Experian", "Equifax", "TransUnion"]
#: Patterns that point to each bureau.  Searched in either case, line by line.
PRIMARY = {
    "Experian": [r"\bExperian\b", r"\bEXPERIAN\b", r"experian\.com", "Experian Information Solutions", "Experian Consumer Services", r"P\.O\. Box 4000.*Allen.*TX.*75013", r"Allen,?\s*TX\s*75013"],
    "Equifax": [r"\bEquifax\b", r"\bEQUIFAX\b", r"equifax\.com", "Equifax Information Services", "Equifax Credit Information Services", r"P\.O\. Box 740256.*Atlanta.*GA.*30374", r"Atlanta,?\s*GA\s*30374"],
    "TransUnion": [r"\bTransUnion\b", r"\bTRANSUNION\b", r"\bTrans Union\b", r"transunion\.com", "TransUnion LLC", r"P\.O\. Box 2000.*Chester.*PA.*19016", r"Chester,?\s*PA\s*19016"],
}
SECONDARY = {
    "Experian": ["Consumer Disclosure.*Experian", "Credit Profile.*Experian", "Personal Credit Report.*Experian", "FICO.*Score.*Experian", "Experian.*Credit.*Report"],
    "Equifax": ["Consumer Disclosure.*Equifax", "Credit File Disclosure.*Equifax", "Personal Credit Report.*Equifax", "FICO.*Score.*Equifax", "Equifax.*Credit.*Report"],
    "TransUnion": ["Consumer Disclosure.*TransUnion", "Credit Report.*TransUnion", "Personal Credit Report.*TransUnion", "VantageScore.*TransUnion", "TransUnion.*Credit.*Report"],
}
FORMAT = {
    "Experian": [r"Account\s+Name\s+Account\s+Number\s+Date\s+Opened", r"Potentially\s+Negative\s+Items", r"Accounts\s+in\s+Good\s+Standing"],
    "Equifax": [r"Account\s+history\s+as\s+of", r"Credit\s+Accounts\s+Summary", r"The\s+following\s+accounts\s+are\s+listed\s+on\s+your\s+credit\s+file"],
    "TransUnion": [r"Account\s+Information\s+Summary", r"Satisfactory\s+Accounts", r"Potentially\s+Negative\s+Accounts"],
}
HEADER = {
    "Experian": [r"^\s*EXPERIAN\s*$", r"EXPERIAN\s+CONSUMER\s+SERVICES"],
    "Equifax": [r"^\s*EQUIFAX\s*$", r"EQUIFAX\s+CREDIT\s+SERVICES"],
    "TransUnion": [r"^\s*TRANSUNION\s*$", r"^\s*TRANS\s+UNION\s*$"],
}
#: The confidence of each list, and the characters in which headers are looked for.
TIERS = [(PRIMARY, 0.9), (SECONDARY, 0.7), (FORMAT, 0.5), (HEADER, 0.95)]
HEADER_CHARS = 1000


def patterns() -> list[tuple[str, str, float, bool, int]]:
    """Bureau, pattern, confidence, headers only?, and how often the list has it: patterns that differ in case alone have
    the same matches, so they are searched once and counted as often as they stand there."""
    found: Counter = Counter()
    for group, confidence in TIERS:
        for bureau, each in group.items():
            found.update((bureau, p.casefold(), confidence, group is HEADER) for p in each)
    return [(*key, times) for key, times in found.items()]


def weight(position: Column, size: Column) -> Column:
    share = position / size
    return F.when(share <= 0.2, 1.3).when(share <= 0.5, 1.1).otherwise(0.9)


def places(text: Column, pattern: str) -> Column:
    """Offsets of all matches: what lies before them, and their own lengths."""
    p = f"(?im){pattern}"
    pairs = F.arrays_zip(F.split(text, p, -1).alias("gap"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        return F.struct((begin + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"), F.when(x["m"].isNotNull(), F.concat(acc["out"], F.array(begin))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(p), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<int>"))


def indicators(reports: DataFrame) -> DataFrame:
    """ord, bureau, confidence, position and size, a row for each match of each pattern."""
    found = []
    for bureau, p, confidence, header, times in patterns():
        text = F.substring("text", 1, HEADER_CHARS) if header else c("text")
        one = rows_of(places(text, p), bureau, confidence)
        found.append(one if times == 1 else F.flatten(F.array_repeat(one, times)))
    every = F.flatten(F.array(*found))
    return reports.select("ord", F.length("text").alias("size"), F.explode(every).alias("x")).select("ord", "size", "x.*")


def rows_of(at: Column, bureau: str, confidence: float) -> Column:
    return F.transform(at, lambda x: F.struct(F.lit(bureau).alias("bureau"), F.lit(confidence).alias("confidence"), x.alias("position")))


def found_sql() -> str:
    parts = []
    for bureau, p, confidence, header, times in patterns():
        text = f"substr(text, 1, {HEADER_CHARS})" if header else "text"
        q = f"(?im){p}".replace("'", "''")
        one = f"""SELECT ord, length(text) AS size, '{bureau}' AS bureau, {confidence}::DOUBLE AS confidence, unnest(list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER))) AS position
            FROM (SELECT ord, text, string_split_regex({text}, '{q}') AS p, regexp_extract_all({text}, '{q}') AS m FROM reports) WHERE len(m) > 0"""
        parts += [one] * times
    return " UNION ALL ".join(parts)


FOUND = found_sql()
WEIGHT = "CASE WHEN position / size <= 0.2 THEN 1.3 WHEN position / size <= 0.5 THEN 1.1 ELSE 0.9 END"


@query("B1_indicators", f"WITH f AS ({FOUND}) SELECT ord, bureau, count(*) AS n, min(position) AS first_position, round(max(confidence), 3) AS best FROM f GROUP BY 1, 2")
def indicator_counts(v: Views) -> DataFrame:
    return indicators(v.reports).groupBy("ord", "bureau").agg(F.count("*").alias("n"), F.min("position").alias("first_position"), F.round(F.max("confidence"), 3).alias("best"))


@query("B2_B3_B5_A22_detected_bureau", f"""WITH f AS ({FOUND}), s AS (SELECT ord, bureau, sum(confidence * {WEIGHT}) AS score, count(*) AS k FROM f GROUP BY 1, 2), b AS (SELECT ord, sum(k) AS n, arg_max(bureau, score * 1000 - list_position(['Experian', 'Equifax', 'TransUnion'], bureau) * 0.001) AS bureau, max(score) AS score FROM s GROUP BY ord)
    SELECT r.ord, round(coalesce(least(score / (n * 0.95 * 1.3), 1.0), 0), 4) AS confidence, CASE WHEN length(r.text) >= 50 AND score / (n * 0.95 * 1.3) >= 0.6 THEN bureau ELSE 'Unknown' END AS bureau FROM reports r LEFT JOIN b ON r.ord = b.ord""")  # fmt: skip
def detected_bureau(v: Views) -> DataFrame:
    """The best weighted score over that of all indicators; short texts and scores below 0.6 are Unknown."""
    scores = indicators(v.reports).groupBy("ord", "bureau").agg(F.sum(c("confidence") * weight(c("position"), c("size"))).alias("score"), F.count("*").alias("k"))
    place = F.array_position(F.array(*[F.lit(b) for b in BUREAUS]), c("bureau"))
    best = scores.groupBy("ord").agg(F.sum("k").alias("n"), F.max_by("bureau", c("score") * 1000 - place * 0.001).alias("best"), F.max("score").alias("score"))
    level = c("score") / (c("n") * 0.95 * 1.3)
    joined = v.reports.select("ord", F.length("text").alias("size")).join(best, "ord", "left")
    return joined.select("ord", F.round(F.coalesce(F.least(level, F.lit(1.0)), F.lit(0.0)), 4).alias("confidence"), F.when((c("size") >= 50) & (level >= 0.6), c("best")).otherwise("Unknown").alias("bureau"))


@query("B4_A23_bureau_sections", f"""WITH f AS ({FOUND}), s AS (SELECT ord, bureau, least(sum(confidence) / greatest(count(*) * 0.95, 1), 1.0) AS score, min(position) AS s, count(*) AS n FROM f GROUP BY 1, 2)
    SELECT s.ord, bureau, round(score, 4) AS score, n, s AS begins, coalesce(lead(s) OVER (PARTITION BY s.ord ORDER BY s, bureau), length(r.text)) AS ends FROM s JOIN reports r ON r.ord = s.ord WHERE score > 0.3""")  # fmt: skip
def bureau_sections(v: Views) -> DataFrame:
    """Each bureau of a report begins at its first indicator and ends where the next one begins; its score is that of its
    indicators over the best they could have."""
    found = indicators(v.reports).groupBy("ord", "bureau", "size").agg(F.sum("confidence").alias("sum"), F.min("position").alias("begins"), F.count("*").alias("n"))
    scored = found.withColumn("score", F.least(c("sum") / F.greatest(c("n") * 0.95, F.lit(1.0)), F.lit(1.0))).where("score > 0.3")
    after = F.lead("begins").over(Window.partitionBy("ord").orderBy("begins", "bureau"))
    return scored.select("ord", "bureau", F.round("score", 4).alias("score"), "n", "begins", F.coalesce(after, c("size")).cast("long").alias("ends"))
