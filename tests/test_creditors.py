"""Creditor names and substring lookup against full scans."""

import random

import pandas as pd
import pytest
from ledgerloom.operators import creditors, lookup
from ledgerloom.operators.scalars import token_set_ratio


@pytest.fixture(scope="module")
def readings():
    draw = random.Random(1)
    out = [None, "", " & ", "AT&T", "at t", "T MOBILE", "KOHLS", "kohl's", "Wells Fargo & Company", "BANK", "CREDIT UNION FIRST", "GAPP", "VSA", "zz", "AMERICAN AMERICAN EXPRESS", "Société Générale"]
    for name in creditors.KNOWN_CREDITORS:
        text = list(name)
        for _ in range(draw.randint(0, 4)):
            at = draw.randrange(len(text)) if text else 0
            text[at : at + draw.randint(0, 1)] = draw.choice(["", "", "x", " ", "E"])
        out.append("".join(text) + draw.choice(["", "", " NA", " BANK", "/CARD"]))
    return out


def test_index_finds_what_a_full_scan_finds(spark, readings):
    frame = spark.createDataFrame([(r,) for r in readings + readings[:9]], "n string")
    got = {r.n: (r.standard, r.score) for r in creditors.standard_creditors(frame, "n").collect()}
    assert got.keys() == set(readings)
    for name in readings:
        scores = [token_set_ratio(name or "", k) for k in creditors.KNOWN_CREDITORS]
        best = max(scores)
        assert got[name] == ((creditors.KNOWN_CREDITORS[scores.index(best)], best) if best >= creditors.CUTOFF else (name, None)), name


def test_few_pairs_need_the_exact_ratio(spark, readings):
    names = spark.createDataFrame([(r,) for r in readings if r], "name string").distinct()
    names = names.withColumn("words", creditors.words_of(names["name"])).selectExpr("name", "words", "array_join(words, ' ') as joined").where("joined <> ''")
    met = creditors.candidates(names, creditors.known_table(spark, creditors.KNOWN_CREDITORS), creditors.CUTOFF).count()
    assert met < 0.15 * names.count() * len(set(creditors.KNOWN_CREDITORS))


def test_common_letters():
    draw = random.Random(2)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                keep = row[j]
                row[j] = last + 1 if x == y else max(row[j], row[j - 1])
                last = keep
        return row[-1]

    pairs = [("".join(draw.choice("abcé ") for _ in range(draw.randint(0, 12))), "".join(draw.choice("abcé ") for _ in range(draw.randint(0, 12)))) for _ in range(200)]
    assert creditors.common_letters(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs])).tolist() == [plain(a, b) for a, b in pairs]


def test_contained(spark):
    draw = random.Random(3)
    texts = ["", None, "a", "ab", "abc", "aaaa", "%_", "x%y"] + ["".join(draw.choice("abc") for _ in range(draw.randint(1, 9))) for _ in range(150)]
    patterns = ["", None, "a", "ba", "%", "_", "zzz", "abca"] + ["".join(draw.choice("abc") for _ in range(draw.randint(1, 6))) for _ in range(60)]
    got = sorted(map(tuple, lookup.contained(*[spark.createDataFrame([(x,) for x in xs], "x string") for xs in (patterns, texts)]).collect()))
    assert got == sorted({(p, t) for p in patterns for t in texts if p and t and p in t})
