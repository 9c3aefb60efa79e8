"""Standard names of creditors: the best of a known list by word sets, found through an inverted index.

The score of two names is 100 times the best of three ratios: their common words against each name's words, and the two
names' words against each other, where the ratio of two strings is twice their longest common subsequence over both
lengths.  The first two have a closed form, as the common words stand in front.  Only the third needs the subsequence,
and only of the words that differ.

Candidates come from an index of the known names, and no pair that reaches the cutoff is missed: such a pair has a word in
common, or so many letters (of short names) or pairs of letters (of long ones) that a count of equal ones tells it.  Bounds
from lengths and common words leave few pairs for the exact ratio.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import Views

c = F.col
CUTOFF = 75

#: The known creditors, in this order; of equal scores the first one counts.
KNOWN_CREDITORS = [
    "BANK OF AMERICA", "CHASE", "JPMORGAN CHASE", "WELLS FARGO", "CITIBANK", "US BANK", "PNC BANK", "REGIONS BANK", "TRUIST", "TD BANK", "KEYBANK", "ALLY FINANCIAL", "BMO HARRIS", "FIFTH THIRD BANK",
    "BANK OF THE WEST", "BBVA", "SUNTRUST", "M&T BANK", "FIRST REPUBLIC BANK", "HUNTINGTON NATIONAL BANK", "COMERICA BANK", "SANTANDER BANK", "HSBC", "CAPITAL ONE", "BANK OF NEW YORK MELLON",
    "AMERICAN EXPRESS", "AMEX", "DISCOVER", "VISA", "MASTERCARD", "CITI CARDS", "BARCLAYCARD", "USAA", "NFCU", "SYNCHRONY BANK", "ELAN FINANCIAL SERVICES", "FIRST PREMIER BANK", "MERRICK BANK",
    "INDIGO", "AVANT", "WELLS FARGO CARD SERVICES", "CAPITAL ONE BANK USA", "NAVY FEDERAL CREDIT UNION", "PENFED", "SCHOOLS FIRST FCU", "ALLIANT CREDIT UNION", "VYSTAR",
    "FIRST TECH FEDERAL CREDIT UNION", "BAXTER CREDIT UNION", "MOUNTAIN AMERICA CREDIT UNION", "AMERICA FIRST CREDIT UNION", "STATE EMPLOYEES CREDIT UNION", "GECU", "LOGIX FEDERAL CREDIT UNION",
    "TOYOTA FINANCIAL", "TOYOTA MOTOR CREDIT", "HONDA FINANCIAL", "AMERICAN HONDA FINANCE", "FORD MOTOR CREDIT", "GM FINANCIAL", "ALLY AUTO", "CAPITAL ONE AUTO FINANCE", "NISSAN MOTOR ACCEPTANCE",
    "HYUNDAI MOTOR FINANCE", "CHRYSLER CAPITAL", "KIA MOTORS FINANCE", "VW CREDIT", "MERCEDES-BENZ FINANCIAL", "BMW FINANCIAL SERVICES", "CARMAX AUTO FINANCE", "SANTANDER CONSUMER USA",
    "WESTLAKE FINANCIAL", "DRIVE FINANCIAL", "AMERICREDIT", "CREDIT ACCEPTANCE CORP", "NAVIENT", "SALLIE MAE", "NELNET", "GREAT LAKES", "MOHELA", "FEDLOAN SERVICING", "AES", "DEPARTMENT OF EDUCATION",
    "DEPT OF ED", "OSLA", "EDFINANCIAL", "CITIZENS ONE STUDENT LOANS", "QUICKEN LOANS", "ROCKET MORTGAGE", "WELLS FARGO HOME MORTGAGE", "CHASE HOME LENDING", "BANK OF AMERICA HOME LOANS",
    "CITIMORTGAGE", "CALIBER HOME LOANS", "NATIONSTAR MORTGAGE", "MR COOPER", "LOANDEPOT", "PNC MORTGAGE", "U.S. BANK HOME MORTGAGE", "FREEDOM MORTGAGE", "PHH MORTGAGE", "FIFTH THIRD MORTGAGE",
    "DITECH FINANCIAL", "FLAGSTAR BANK", "SYNCHRONY BANK", "COMENITY BANK", "WELLS FARGO FINANCIAL", "CAPITAL ONE RETAIL SERVICES", "CITI RETAIL SERVICES", "BEST BUY", "AMAZON", "TARGET", "WALMART",
    "MACYS", "NORDSTROM", "KOHL'S", "JCPENNEY", "TJX", "GAP", "LOWES", "HOME DEPOT", "SEARS", "BLOOMINGDALE'S", "DILLARD'S", "NEIMAN MARCUS", "AFIRM", "KLARNA", "AFTERPAY", "ZIP", "SEZZLE",
    "PAYPAL CREDIT", "AT&T", "VERIZON", "T-MOBILE", "SPRINT", "US CELLULAR", "BOOST MOBILE", "METRO PCS", "CRICKET WIRELESS", "COMCAST", "CHARTER", "SPECTRUM", "COX", "DISH NETWORK", "DIRECTV",
    "DUKE ENERGY", "SOUTHERN CALIFORNIA EDISON", "PG&E", "CONEDISON", "FLORIDA POWER & LIGHT", "NATIONAL GRID", "DOMINION ENERGY", "SAN DIEGO GAS & ELECTRIC", "PEPCO", "BGE", "XCEL ENERGY",
    "CARE CREDIT", "WELLS FARGO HEALTH ADVANTAGE", "GREEN SKY PATIENT SOLUTIONS", "MIDLAND CREDIT MANAGEMENT", "PORTFOLIO RECOVERY ASSOCIATES", "LVNV FUNDING", "ENHANCED RECOVERY COMPANY",
    "CREDIT ONE BANK", "CAVALRY PORTFOLIO SERVICES", "NCO FINANCIAL", "ALLIED INTERSTATE", "PRA GROUP", "CONVERGENT OUTSOURCING", "IC SYSTEM", "ONE MAIN FINANCIAL", "LENDMARK FINANCIAL", "UPSTART",
    "SOFI", "LENDINGCLUB", "OPORTUN", "MARCUS BY GOLDMAN SACHS", "DISCOVER PERSONAL LOANS", "LIGHTSTREAM", "AVANT", "EARNEST", "PROSPER", "APPLE CARD", "SAMS CLUB", "COSTCO", "FINGERHUT",
    "RAYMOUR & FLANIGAN", "ASHLEY FURNITURE", "EQUIFAX", "EXPERIAN", "TRANSUNION",]


def words_of(name: Column) -> Column:
    """The different words of a name in small letters, sorted; what is no letter or digit parts words."""
    bare = F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))
    return F.array_sort(F.array_distinct(F.filter(F.split(bare, " "), lambda w: w != "")))


def pieces_of(text: str, size: int) -> Column:
    """All substrings of ``size`` characters of a column, each with the number of equal ones up to it."""
    grams = f"transform(if(length({text}) >= {size}, sequence(1, length({text}) - {size} + 1), cast(array() as array<int>)), i -> substring({text}, i, {size}))"
    return F.expr(f"transform({grams}, (g, i) -> concat_ws('#', g, size(filter({grams}, (h, j) -> j <= i and h = g))))")


def common_letters(one: pd.Series, two: pd.Series) -> pd.Series:
    """The length of the longest common subsequence of each pair, all pairs of a batch at once."""
    if len(one) == 0:
        return pd.Series([], dtype="int32")

    def grid(texts: pd.Series, filler: int) -> np.ndarray:
        out = np.full((len(texts), max(1, texts.str.len().max())), filler, np.int64)
        for row, text in zip(out, texts, strict=True):
            row[: len(text)] = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return out

    a, b = grid(one, -1), grid(two, -2)
    best = np.zeros((b.shape[1] + 1, len(a)), np.int32)
    for i in range(a.shape[1]):
        corner = best[0].copy()
        for j in range(b.shape[1]):
            above = best[j + 1].copy()
            best[j + 1] = np.where(a[:, i] == b[:, j], corner + 1, np.maximum(above, best[j]))
            corner = above
    return pd.Series(best[-1])


def candidates(names: DataFrame, known: DataFrame, cutoff: int) -> DataFrame:
    """Pairs (name, known) that may reach the cutoff.  Both sides have name, words and joined (the words in one string).

    With r the least ratio that rounds to the cutoff, names of a and b letters without a common word need a common
    subsequence of r (a + b) / 2, so at least as many equal letters.  At most (1 - r)(a + b) letters are then left out or
    put in, each of which parts two pairs of neighbours on one side and one on the other: at least
    (a + b)(1/2 - 3/2 (1 - r)) - 1 pairs of neighbours are equal.
    """
    r = (cutoff - 0.5) / 100
    growth = 0.5 - 1.5 * (1 - r)
    short = int(2 / growth) + 1 if growth > 0 else 1 << 30  # up to so many letters of both, pairs of neighbours tell nothing

    def listed(side: DataFrame, name: str, pieces: Column, most: Column) -> DataFrame:
        return side.where(most).select(c("name").alias(name), F.length("joined").alias(f"{name}_size"), F.explode(pieces).alias("piece"))

    def counted(size: int, fits: Column, enough: Column) -> DataFrame:
        pieces = pieces_of("joined", size)
        met = listed(names, "name", pieces, fits).join(F.broadcast(listed(known, "known", pieces, fits)), "piece")
        met = met.where(2 * F.least("name_size", "known_size") >= r * (c("name_size") + c("known_size")))
        return met.groupBy("name", "known", "name_size", "known_size").agg(F.count("*").alias("n")).where(enough).select("name", "known")

    both = c("name_size") + c("known_size")
    by_word = listed(names, "name", c("words"), F.lit(True)).join(F.broadcast(listed(known, "known", c("words"), F.lit(True))), "piece").select("name", "known")
    by_letter = counted(1, F.length("joined") < short, (both <= short) & (2 * c("n") >= r * both))
    by_pair = counted(2, F.lit(True), (both > short) & (c("n") >= growth * both - 1 - 1e-9))
    return by_word.unionByName(by_letter).unionByName(by_pair).distinct()


def scored(names: DataFrame, known: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """Pairs (name, known, score) of which the score is at least ``cutoff``, and whether the exact ratio was needed."""
    pairs = candidates(names, known, cutoff).join(names.select("name", "words"), "name").join(F.broadcast(known.select(c("name").alias("known"), c("words").alias("known_words"))), "known")
    common, left, right = F.array_intersect("words", "known_words"), F.array_except("words", "known_words"), F.array_except("known_words", "words")
    parts = pairs.select("name", "known", *[F.array_join(F.array_sort(x), " ").alias(n) for n, x in (("base", common), ("left", left), ("right", right))])
    # both strings begin with the common words, and a space after them
    base = F.length("base") + F.when((c("base") != "") & (c("left") != "") & (c("right") != ""), 1).otherwise(0)
    one, two = base + F.length("left"), base + F.length("right")
    prefix = F.when(c("base") == "", 0.0).when((c("left") == "") | (c("right") == ""), 1.0).otherwise(2 * F.length("base") / (F.length("base") + F.least(one, two)))
    least = (cutoff - 0.5) / 100
    bound = 2 * (base + F.least(F.length("left"), F.length("right"))) / (one + two)
    open_pairs = parts.select("*", prefix.alias("prefix"), ((bound >= least) & (bound > prefix)).alias("exact"), base.alias("base_size"), (one + two).alias("sizes"))
    # Spark hands Python the pairs that are still open, and no others
    done = open_pairs.where("not exact").select("name", "known", "prefix", "exact")
    lcs = F.pandas_udf(common_letters, "int")("left", "right")
    more = open_pairs.where("exact").select("name", "known", F.greatest(c("prefix"), 2 * (c("base_size") + lcs) / c("sizes")).alias("prefix"), "exact")
    return done.unionByName(more).select("name", "known", F.floor(c("prefix") * 100 + 0.5).cast("int").alias("score"), "exact").where(c("score") >= cutoff)


def known_table(spark, known: list[str]) -> DataFrame:
    rows = spark.createDataFrame(list(zip(range(len(known)), known, strict=True)), "place int, name string").groupBy("name").agg(F.min("place").alias("place"))
    return rows.withColumn("words", words_of(c("name"))).withColumn("joined", F.array_join("words", " "))


def standard_creditors(rows: DataFrame, column: str, known: list[str] = KNOWN_CREDITORS, cutoff: int = CUTOFF) -> DataFrame:
    """The best of the known creditors for each different name, if its score reaches the cutoff; else the name itself.

    Returns the name, ``standard`` and ``score`` (null where none reaches it).  Ties go to the first of the list.  Null and
    empty names, and names without a letter or digit, stay as they are.
    """
    names = rows.select(c(column).alias("name")).distinct().withColumn("words", words_of(c("name"))).withColumn("joined", F.array_join("words", " "))
    listed = known_table(rows.sparkSession, known)
    best = scored(names.where("joined <> ''"), listed, cutoff).join(F.broadcast(listed.select(c("name").alias("known"), "place")), "known")
    best = best.groupBy("name").agg(F.max(F.struct("score", -c("place"), "known")).alias("best"))
    return names.join(best, names["name"].eqNullSafe(best["name"]), "left").select(names["name"].alias(column), F.coalesce("best.known", names["name"]).alias("standard"), c("best.score").alias("score"))


@query("T3_T21_O9_standard_creditor")
def standard_creditor(v: Views) -> DataFrame:
    """Names as a scanner reads them: some have lost a letter."""
    return standard_creditors(v.name_readings, "creditor_name")
