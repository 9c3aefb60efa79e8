"""Recall of the inverted lists against a full scan."""

import numpy as np
import pytest
from ledgerloom.operators import inverted


def exact(rows, every, k=10):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = x @ x[i]
        out[int(ids[i])] = [int(ids[j]) for j in np.lexsort((ids, -score)) if j != i][:k]
    return out


@pytest.mark.parametrize("kind, visited, least", [("spread", 0.6, 0.8), ("clustered", 0.2, 0.95), ("spread", 1.0, 1.0)])
def test_recall(spark, kind, visited, least):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(1500, 24)) if kind == "spread" else draw.normal(size=(30, 24))[draw.integers(0, 30, 1500)] + 0.1 * draw.normal(size=(1500, 24))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    frame = spark.createDataFrame([*rows, (None, [1.0] * 24), (9000, None), (9001, [0.0] * 24)], "vec_id long, embedding array<double>")
    got = {}
    for r in inverted.similar(frame, frame.where("vec_id % 20 = 0"), visited=visited).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = exact(rows, 20)
    assert got.keys() == want.keys()
    hits = [v in got[q] for q in want for v in want[q]]
    assert sum(hits) >= least * len(hits), sum(hits) / len(hits)


def test_no_vectors(spark):
    frame = spark.createDataFrame([(1, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert inverted.similar(frame, frame).count() == 0
