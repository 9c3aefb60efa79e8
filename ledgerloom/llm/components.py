"""Connected components of an edge table, as distributed joins: nodes point to a smaller neighbour, and pointers double."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, sized, stage_table

ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to (node, component): the smallest node that can be reached.  Nodes without an edge are absent.

    Loops and repeated edges are allowed.  Every node points to its smallest neighbour, if that is smaller.  A step moves
    each pointer on to where its end points, and every other edge to where its two ends point; no edge becomes two, and
    what was joined stays joined, as all pointers end at one node that points nowhere.  It takes a number of steps in the
    order of log(nodes).  Every step's edges are a written table.
    """
    state = {"n": F.count("*"), "names": F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))}
    links = stage_table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", **state)
    for _ in range(ROUNDS):
        if not links.observed["n"]:
            break
        low = sized(links.groupBy("u").agg(F.min("v").alias("m")), links.observed["n"])
        # the same side twice: Spark makes it once
        met = links.alias("e").join(low.alias("x"), F.col("e.u") == F.col("x.u")).join(low.alias("y"), F.col("e.v") == F.col("y.u"), "left")
        end, own = F.coalesce("y.m", "e.v"), F.col("x.m")
        start = F.when(F.col("e.v") == own, F.col("e.u")).otherwise(own)
        moved = met.select(F.greatest(start, end).alias("u"), F.least(start, end).alias("v")).where("u <> v").distinct()
        before, links = links, stage_table(moved, "edges", **state)
        discard(before)
        if before.observed == links.observed:
            break
    else:
        raise RuntimeError("components have not settled")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
