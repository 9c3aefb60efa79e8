"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform.  It sends the direction of a vector to
the nearest of the signed axes, which names its bucket; each table has a rotation (or several) of its own.  Queries
look into the buckets of the axes that are nearest next as well (multiprobe).  What lies in a bucket is ranked by the
exact distance of the original vectors, each bucket hands on its best rows for each query, and those are merged.
Queries that found fewer rows than they should are compared with all vectors, part by part.

How many tables and probes that takes depends on the vectors: a cluster needs one probe, evenly spread vectors of many
dimensions have no near buckets at all.  So a pilot of a few queries of each dimension is answered exactly first.  The
places that the buckets of their true neighbours have in the queries' own orders of buckets tell the cheapest number of
tables, axes (fewer make larger buckets) and probes that finds the wanted share of them; all queries of that dimension use
it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage_table

#: Tables at most, and seed.
TABLES, SEED = 8, 20240229
#: Pilot queries of each dimension, and the share of their true neighbours that tables and probes have to find.
PILOT, TARGET = 50, 0.97
#: Vectors to a bucket of one rotation beyond which a table has two, and probes that are looked at in choosing.
TWO_ROTATIONS, MOST_PROBES = 20_000, 4096
#: A visit to a bucket costs as much as so many distances.
VISIT = 50
NEIGHBOURS = 10
#: A bucket is cut into parts of about so many vectors; queries visit all its parts.
PART_ROWS = 8192


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def axis_scores(vectors: np.ndarray, table: int, rotation: int, seed: int, axes: int = 1 << 30) -> np.ndarray:
    """Inner products of the rotated directions with the first signed axes (axis 0, minus axis 0, axis 1, ...)."""
    size = 1 << max(0, int(vectors.shape[1] - 1).bit_length())
    signs = np.random.default_rng([seed, table, rotation, size]).choice([-1.0, 1.0], (3, size))
    x = np.zeros((len(vectors), size))
    # scaling by the largest component first keeps tiny and huge vectors in range
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    x[:, : vectors.shape[1]] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    for row in signs:
        x = hadamard(x * row)
    x = x[:, :axes]
    return np.stack([x, -x], axis=2).reshape(len(x), -1)


def buckets(vectors: np.ndarray, table: int, rotations: int, seed: int, axes: int = 1 << 30) -> np.ndarray:
    out = np.zeros(len(vectors), np.int64)
    for r in range(rotations):
        scores = axis_scores(vectors, table, r, seed, axes)
        out = out * scores.shape[1] + scores.argmax(1)
    return out


def probed(vectors: np.ndarray, table: int, rotations: int, probes: int, seed: int, axes: int = 1 << 30) -> np.ndarray:
    """For each vector the ``probes`` buckets of highest summed scores, its own first."""
    names, sums = np.zeros((len(vectors), 1), np.int64), np.zeros((len(vectors), 1))
    for r in range(rotations):
        scores = axis_scores(vectors, table, r, seed, axes)
        width = scores.shape[1]
        best = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
        total = (sums[:, :, None] + np.take_along_axis(scores, best, 1)[:, None, :]).reshape(len(vectors), -1)
        name = (names[:, :, None] * width + best[:, None, :]).reshape(len(vectors), -1)
        keep = np.argsort(-total, axis=1, kind="stable")[:, :probes]
        names, sums = np.take_along_axis(name, keep, 1), np.take_along_axis(total, keep, 1)
    return names


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles), dim of the vectors that take part: not null, all components finite numbers, not zero."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def by_dimension(batch: pa.RecordBatch):
    dims = np.asarray(batch.column("dim"))
    for dim in np.unique(dims).tolist():
        part = batch.filter(pa.array(dims == dim)) if len(np.unique(dims)) > 1 else batch
        for start in range(0, len(part), 1024):
            yield dim, part.slice(start, 1024)


def fitted(tables: int, seed: int, target: float):
    """From pairs of queries (q) and true neighbours (v) of one dimension to the cheapest tables and probes that find them."""

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        dim, rows = int(pairs["dim"].iloc[0]), int(pairs["rows"].iloc[0])
        q, v = (np.stack(pairs[c].to_list()) for c in ("q", "v"))
        size, best = 1 << max(0, (dim - 1).bit_length()), None
        for axes in [*(a for a in (4, 16, 64, 256) if a < size), size]:
            for rotations in (2, 1) if rows > TWO_ROTATIONS * 2 * axes else (1,):
                place, width = np.full(len(pairs), np.inf), (2 * axes) ** rotations
                for t in range(tables):
                    same = probed(q, t, rotations, min(width, max(2 * axes, MOST_PROBES)), seed, axes) == buckets(v, t, rotations, seed, axes)[:, None]
                    place = np.minimum(place, np.where(same.any(1), same.argmax(1), np.inf))
                    visits = (t + 1) * (np.sort(place)[int(np.ceil(len(place) * target)) - 1] + 1)
                    work = visits * (rows / width + VISIT)
                    if np.isfinite(work) and (best is None or work < best[0]):
                        best = (work, t + 1, rotations, axes, int(visits) // (t + 1))
        return pd.DataFrame([(dim, *best[1:])], columns=["dim", "tabs", "rotations", "axes", "probes"]).astype("int32")

    return run


def planned(base: DataFrame, queries: DataFrame, k: int, tables: int, seed: int, part_rows: int, pilot: int = PILOT, target: float = TARGET) -> DataFrame:
    """dim, tabs, rotations, axes and probes, from a pilot of at most ``pilot`` queries of each dimension (by a hash of their ids)."""
    draw, whole = F.xxhash64("vec_id", F.lit(seed)), 1 << 20
    share = F.lit(4.0 * pilot * whole) / F.col("n")  # some more than the pilot, so that few rows are ranked
    some = queries.join(queries.groupBy("dim").agg(F.count("*").alias("n")), "dim").where(F.pmod(draw, F.lit(whole)) < share)
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy("dim").orderBy(draw, "vec_id", "v"))).where(F.col("_n") <= pilot)
    some = stage_table(some.select("vec_id", "v", "dim"), "pilot")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    exact = scanned(base, some, k, part_rows).distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    pairs = exact.join(some.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dim"), "query_id").join(base.select("vec_id", "v", "dim"), ["vec_id", "dim"])
    rows = base.groupBy("dim").agg(F.count("*").alias("rows"))
    return pairs.join(rows, "dim").select("dim", "rows", "q", "v").groupBy("dim").applyInPandas(fitted(tables, seed, target), "dim int, tabs int, rotations int, axes int, probes int")


def hashed(rows: DataFrame, seed: int, carry: bool) -> DataFrame:
    """A row for each vector and table of its plan (tabs, rotations, axes): tab, bucket, dim and, with ``carry``, vec_id and v."""

    def run(batches):
        for whole in batches:
            for dim, batch in by_dimension(whole):
                vectors, (rotations, axes) = matrix(batch.column("v"), dim), (batch.column(c)[0].as_py() for c in ("rotations", "axes"))
                for t in range(batch.column("tabs")[0].as_py()):
                    named = [pa.array(np.full(len(batch), t, np.int32)), pa.array(buckets(vectors, t, rotations, seed, axes)), batch.column("dim")]
                    yield pa.RecordBatch.from_arrays(named + ([batch.column("vec_id"), batch.column("v")] if carry else []), names=["tab", "bucket", "dim"] + (["vec_id", "v"] if carry else []))

    return rows.mapInArrow(run, "tab int, bucket long, dim int" + (", vec_id long, v array<double>" if carry else ""))


def probes_of(rows: DataFrame, seed: int) -> DataFrame:
    """A row for each query and bucket that its plan (tabs, rotations, axes, probes) has it visit."""

    def run(batches):
        for whole in batches:
            for dim, batch in by_dimension(whole):
                vectors = matrix(batch.column("v"), dim)
                tabs, rotations, axes, probes = (batch.column(c)[0].as_py() for c in ("tabs", "rotations", "axes", "probes"))
                for t in range(tabs):
                    names = probed(vectors, t, rotations, probes, seed, axes)
                    for p in range(names.shape[1]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), t, np.int32)), pa.array(names[:, p].copy()), batch.column("dim"), batch.column("vec_id"), batch.column("v")], names=["tab", "bucket", "dim", "vec_id", "v"])

    return rows.mapInArrow(run, "tab int, bucket long, dim int, vec_id long, v array<double>")


def nearest_in(keep: int):
    """For a part of a bucket and the queries that visit it: each query's ``keep`` nearest rows, by exact distance."""

    def run(base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(base) and len(queries):
            ids = base["vec_id"].to_numpy()
            vectors = np.stack(base["v"].to_list())
            for query, v in zip(queries["vec_id"], queries["v"], strict=True):
                score = np.sqrt(np.square(vectors - v).sum(1))
                score[ids == query] = np.inf
                at = np.flatnonzero(score <= np.partition(score, keep - 1)[keep - 1]) if len(score) > keep else np.arange(len(score))
                at = at[np.isfinite(score[at]) | (ids[at] != query)]
                at = at[np.lexsort((ids[at], score[at]))][:keep]
                out.extend(zip([query] * len(at), ids[at], score[at], strict=True))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def within(index: DataFrame, visits: DataFrame, place: list[str], k: int) -> DataFrame:
    """query_id, vec_id, score: each query's k nearest rows in each place that it visits."""
    return index.select(*place, "vec_id", "v").groupBy(*place).cogroup(visits.select(*place, "vec_id", "v").groupBy(*place)).applyInPandas(nearest_in(k), "query_id long, vec_id long, score double")


def scanned(base: DataFrame, queries: DataFrame, k: int, part_rows: int) -> DataFrame:
    """Exact: each query with all vectors of its dimension, in parts of about ``part_rows`` vectors and queries."""
    cut = lambda n: F.ceil(F.col(n) / part_rows).cast("int")
    sizes = base.groupBy("dim").count().select("dim", cut("count").alias("parts"))
    asked = queries.groupBy("dim").count().select("dim", cut("count").alias("blocks"))
    cuts = stage_table(sizes.join(asked, "dim"), "cuts")
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = base.join(cuts, "dim").withColumn("part", part("parts")).withColumn("block", every("blocks"))
    visits = queries.join(cuts, "dim").withColumn("block", part("blocks")).withColumn("part", every("parts"))
    return within(index, visits, ["dim", "part", "block"], k)


def search(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, tables: int = TABLES, seed: int = SEED, part_rows: int = PART_ROWS, target: float = TARGET) -> DataFrame:
    """The ``k`` nearest found rows of ``vectors`` (vec_id, embedding) for each row of ``queries`` (vec_id, embedding).

    Returns query_id, rank (from 1), vec_id, score (Euclidean distance, doubles); ties go to the smaller vec_id, and a
    query's own vec_id is no candidate.  Null and zero vectors, and those with null or non-finite components, take no
    part, nor do rows without an id; vectors of different dimensions never meet; equal rows count once; fewer candidates
    give fewer rows; other columns are ignored.

    Of equal vectors only the k + 1 smallest ids can be among the k nearest of any query, so no more are indexed.
    """
    rows = usable(vectors)
    equal = Window.partitionBy("v").orderBy("vec_id")
    base = rows.distinct().withColumn("n", F.row_number().over(equal)).where(F.col("n") <= k + 1).drop("n")
    base = stage_table(base, "vectors")
    asked = usable(queries).distinct()
    plan = stage_table(planned(base, asked, k, tables, seed, part_rows, target=target), "probes")
    place = ["tab", "bucket", "dim"]
    # sizes of all buckets and of what visits them: at most tables x (2 dimensions) ** rotations rows for each dimension
    parts = hashed(base.join(plan, "dim"), seed, carry=False).groupBy(*place).count().select(*place, F.ceil(F.col("count") / part_rows).cast("int").alias("parts"))
    visits = stage_table(probes_of(asked.join(plan, "dim"), seed), "visits")
    cuts = visits.groupBy(*place).count().select(*place, F.ceil(F.col("count") / part_rows).cast("int").alias("blocks")).join(parts, place)
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = hashed(base.join(plan, "dim"), seed, carry=True).join(cuts, place).withColumn("part", part("parts")).withColumn("block", every("blocks"))
    visits = visits.join(cuts, place).withColumn("block", part("blocks")).withColumn("part", every("parts"))
    found = stage_table(within(index, visits, [*place, "part", "block"], k), "neighbours")
    # a query has k rows, or as many as there are other ids of its dimension; those with fewer meet all vectors
    n_ids = base.groupBy("dim").agg(F.count_distinct("vec_id").alias("ids"))
    n_found = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).withColumnRenamed("query_id", "vec_id")
    own = base.select("vec_id", "dim").distinct().withColumn("own", F.lit(1))
    due = asked.join(n_found, "vec_id", "left").join(n_ids, "dim").join(own, ["vec_id", "dim"], "left")
    short = stage_table(due.where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), F.col("ids") - F.coalesce("own", F.lit(0)))).select("dim", "vec_id", "v"), "short")
    if not short.isEmpty():
        found = found.unionByName(scanned(base, short, k, part_rows))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def brute_force(rows: list[tuple], every: int = 100, k: int = NEIGHBOURS) -> dict:
    """Exact neighbours, for tests: query to a list of (vec_id, distance)."""
    ids = np.array([r[0] for r in rows])
    vectors = np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = np.sqrt(np.square(vectors - vectors[i]).sum(1))
        order = [j for j in np.lexsort((ids, score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out
