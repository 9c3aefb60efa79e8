"""Search for similar vectors through inverted lists: k-means cells, a few of them visited by each query, exact ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import Views, dealt
from .vectors import norm

c = F.col
#: Vectors that cells are fitted on, cells at most, the share of the cells that a query visits, and the fit's seed.
SAMPLE, CELLS, VISITED, SEED = 20_000, 1024, 0.6, 7
#: Vectors that are compared in one task at a time, the numbers of one block of scores, and how far a product of matrices may
#: lie beside a plain sum of two unit vectors.
BLOCK, SCORES, ERROR = 16_384, 1 << 22, 1e-9


def units(vectors: DataFrame) -> DataFrame:
    """vec_id and u, the vector scaled to length one; null and zero vectors and rows without an id are left out."""
    rows = vectors.where("vec_id is not null and embedding is not null").withColumn("_n", norm(c("embedding"))).where("_n > 0 and _n < double('infinity')")
    return rows.withColumn("u", F.transform("embedding", lambda x: x.cast("double") / c("_n"))).drop("_n", "embedding")


def centroids(rows: DataFrame, cells: int, sample: int = SAMPLE, seed: int = SEED) -> np.ndarray:
    """Centres of ``cells`` cells, fitted on about ``sample`` of the vectors that a hash of their ids picks."""
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(max(1, n // sample))) == 0)
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="f").fit(some.select(array_to_vector("u").alias("f")))
    return np.array(model.clusterCenters())


def nearest_cells(u: Column, centres: np.ndarray, number: int) -> Column:
    """The ``number`` cells whose centres are nearest to a vector, the nearest first."""

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(ranked_cells(np.stack(vectors.to_list()), centres, number)))

    return cells(u)


def ranked_cells(vectors: np.ndarray, centres: np.ndarray, number: int) -> np.ndarray:
    away = (centres**2).sum(1) - 2 * vectors @ centres.T
    first = away.argmin(1)[:, None] if number == 1 else np.argsort(away, axis=1, kind="stable")[:, :number]
    return first.astype(np.int32)


def dealt_cells(sizes: dict[int, int], cells: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first block and the number of its blocks: small cells share one, large ones take several."""
    first, parts, last, held = np.zeros(cells, np.int32), np.ones(cells, np.int32), 0, 0
    for cell in range(cells):
        n = sizes.get(cell, 0)
        parts[cell] = max(1, -(-n // block))
        if held and held + n > block:
            last, held = last + 1, 0
        first[cell] = last
        last, held = last + parts[cell] - 1, held + n if parts[cell] == 1 else block
    return first, parts


def visits(queries: DataFrame, centres: np.ndarray, number: int, first: np.ndarray, parts: np.ndarray) -> DataFrame:
    """Each query once for each block that holds one of its ``number`` nearest cells, with those of them that lie there."""

    def run(batches):
        for batch in batches:
            out = []
            if len(batch):
                cells = np.sort(ranked_cells(np.stack(batch["q"].to_list()), centres, number), axis=1)
            for i, (query, q) in enumerate(zip(batch["query_id"], batch["q"], strict=True)):
                own = np.repeat(cells[i], parts[cells[i]])
                again = np.arange(len(own)) - np.repeat(np.cumsum(parts[cells[i]]) - parts[cells[i]], parts[cells[i]])
                blocks = first[own] + again  # rises, as cells do
                cuts = np.flatnonzero(np.diff(blocks)) + 1
                out += [(query, q, int(blocks[s]), part) for s, part in zip([0, *cuts.tolist()], np.split(own, cuts), strict=True)]
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=["query_id", "q", "block", "cells"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["query_id", "q", "block", "cells"])

    return queries.mapInPandas(run, "query_id long, q array<double>, block int, cells array<int>")


def nearest_in_block(asked: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest of a block to each query among the cells it visits.

    A product of matrices picks all that may be among them; their similarity is the plain sum, from the first number on.
    """
    out = []
    if len(asked) and len(block):
        x, ids, cell = np.stack(block["u"].to_list()), block["vec_id"].to_numpy(), block["cell"].to_numpy()
        names, place = np.unique(cell, return_inverse=True)
        step = max(1, SCORES // len(x))
        for s in range(0, len(asked), step):
            some = asked.iloc[s : s + step]
            q, query = np.stack(some["q"].to_list()), some["query_id"].to_numpy()
            visited = np.stack([np.isin(names, cells) for cells in some["cells"]])
            scores = np.where(visited[:, place] & (query[:, None] != ids[None, :]), q @ x.T, -np.inf)
            least = np.partition(scores, -k, axis=1)[:, -k] if len(x) > k else np.full(len(q), -np.inf)
            i, j = np.nonzero((scores >= least[:, None] - ERROR) & (scores > -np.inf))
            for t in range(0, len(i), SCORES):
                a, b = i[t : t + SCORES], j[t : t + SCORES]
                exact = np.zeros(len(a))
                for d in range(x.shape[1]):
                    exact += q[a, d] * x[b, d]
                found = pd.DataFrame({"query_id": query[a], "vec_id": ids[b], "similarity": exact})
                out.append(found.sort_values(["query_id", "similarity", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k))
    return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "similarity": np.zeros(0)})


def similar(vectors: DataFrame, queries: DataFrame, k: int = 10, cells: int | None = None, visited: float = VISITED) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vec_id, embedding) most like each of ``queries`` (vec_id, embedding) by cosine.

    Returns query_id, rank, vec_id and similarity; a query is not its own result, ties go to the smaller id.  All vectors
    have one length.  Every vector is in one list, that of its nearest centre, and is compared exactly with the queries that
    visit it, in blocks of bounded size; an empty table gives no rows.  ``cells`` follows the square root of the rows, and the centres are as many
    rows of numbers.
    """
    vectors = vectors.select("vec_id", "embedding")
    rows = units(vectors)
    if rows.isEmpty() or queries.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, similarity double")
    number = cells or int(min(CELLS, max(2, rows.count() ** 0.5)))
    centres = centroids(rows, number)
    index = units(dealt(vectors, "vec_id")).select("vec_id", "u", F.get(nearest_cells(c("u"), centres, 1), F.lit(0)).alias("cell"))
    first, parts = dealt_cells({r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}, len(centres))
    start, several = [F.array(*[F.lit(int(x)) for x in numbers]) for numbers in (first, parts)]
    blocks = index.withColumn("block", F.get(start, c("cell")) + F.pmod(F.xxhash64("vec_id"), F.get(several, c("cell"))).cast("int"))
    asked = visits(units(queries.select("vec_id", "embedding")).select(c("vec_id").alias("query_id"), c("u").alias("q")), centres, max(1, round(visited * len(centres))), first, parts)
    shares = -(-queries.count() // BLOCK)  # of the queries, so that a task holds a bounded number of them
    asked = asked.withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int"))
    blocks = blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    best = asked.groupBy("block", "share").cogroup(blocks.groupBy("block", "share"))
    met = best.applyInPandas(lambda a, b: nearest_in_block(a, b, k), "query_id long, vec_id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(c("rank") <= k).select("query_id", "rank", "vec_id", "similarity")


@query("Y5_Y6_inverted_search")
def inverted_search(v: Views) -> DataFrame:
    """Every fiftieth vector against all of them."""
    e = v.table("embeddings")
    return similar(e, e.where("vec_id % 50 = 0"))
