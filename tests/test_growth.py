"""Work that must not grow faster than the tables: shuffles, patterns searched twice, blocks of bounded size."""

import numpy as np
import pytest
from ledgerloom.functions import text as T
from ledgerloom.operators import inverted
from ledgerloom.plans import catalog


def plan(spark, sf_dir, name):
    return catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_similar_vectors_meet_in_blocks(spark, monkeypatch):
    """Vectors meet queries in matrices of bounded size, also where one cell holds most of them; copies go by their ids."""
    monkeypatch.setattr(inverted, "BLOCK", 64)
    draw = np.random.default_rng(5)
    x = np.concatenate([np.repeat(draw.normal(size=(1, 8)), 300, axis=0), draw.normal(size=(500, 8))])
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = inverted.similar(frame, frame.where("vec_id % 20 = 0"), visited=1.0)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.similarity))
    unit = [[c / sum(d * d for d in v) ** 0.5 for c in v] for _, v in rows]
    for i in range(0, 800, 20):
        score = [(-sum(a * b for a, b in zip(unit[i], u, strict=True)), j) for j, u in enumerate(unit) if j != i]
        assert [j for j, _ in got[i]] == [j for _, j in sorted(score)[:10]]


def test_cells_in_blocks():
    first, parts = inverted.dealt_cells({0: 5, 1: 6, 2: 25, 3: 1, 5: 9}, 6, 10)
    assert first.tolist() == [0, 1, 2, 5, 5, 5] and parts.tolist() == [1, 1, 3, 1, 1, 1]


def test_names_are_distinct_before_they_meet(spark, sf_dir):
    """Each side of the two set operations is a list of names, not of rows."""
    joins = catalog.QUERIES["U1_U2_set_operations"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert joins.count("Join Left") == 2 and joins.count("Aggregate") >= 5


@pytest.mark.parametrize("name, most", [("X12_text_tables", 1), ("X7_text_parser", 1), ("X1_X2_X3_X4_bureau_parsers", 1), ("K2_balanced_json", 2)])
def test_texts_are_dealt_once(spark, sf_dir, name, most):
    assert plan(spark, sf_dir, name).count("Exchange hashpartitioning") <= most


@pytest.mark.parametrize("name, pattern", [("X7_text_parser", "Company Name:"), ("X1_X2_X3_X4_bureau_parsers", "Amount\\s+owed")])
def test_a_pattern_is_searched_once(spark, sf_dir, name, pattern):
    steps = [line for line in plan(spark, sf_dir, name).splitlines() if "regexp_extract" in line]
    assert sum(line.count(f"(?i){pattern}") for line in steps) == 1


@pytest.mark.parametrize("pattern, word", [(r"(?i)Credit\s+Limit:?\s*\$?(\d{1,3})", "credit"), (r"(?i)(Charged\s+Off|Late)", ""), (r"open|closed", ""), (r"(?i)Lates?\b", "late"), (r"[A-Z]{4}(?:\s+Account|Acct)", ""), (r"#\s*(\d{4,16})", "")])
def test_word_of_a_pattern(pattern, word):
    assert T.word_in(pattern) == word
