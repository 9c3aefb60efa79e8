"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the fractional rank (rank + 1/2) / rows of the source
spreads every source evenly over [0, 1).  Sorting by it interleaves the sources in proportion, and cutting the sorted
rows into equal runs gives shards that all match the mixture, with counts at most one apart.

Both rankings are two-level: a row number within a bucket of bounded size plus the rows in the buckets before it.  So
neither a source with a third of all rows nor the whole table is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS, SEED = 40, "interleave 1"
BUCKET_ROWS = 5_000


def ranked(rows: DataFrame, key: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """Add the 0-based rank ``name`` of each row within ``key`` and the rows of the key ``<name>_of``; ``bucket`` rises with ``order``."""
    sizes = rows.groupBy(*key, bucket).count()
    within = Window.partitionBy(*key)
    before = within.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*key, bucket, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"), F.sum("count").over(within).alias(f"{name}_of"))
    place = F.row_number().over(Window.partitionBy(*key, bucket).orderBy(*order))
    return rows.withColumn("_place", place).join(sizes, [*key, bucket]).withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_before", "_place", bucket)


def shard(documents: DataFrame, shards: int = SHARDS, seed: str = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Place every row of ``documents`` (doc_id, text, source) in a shard.

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32 (null text: that of no bytes), shard and slot
    (gapless from 0 in each shard).  Null sources form a source of their own; repeated rows are placed each for itself;
    fewer rows than shards leave some shards empty; other columns are ignored.
    """
    total = documents.count()
    buckets = max(1, -(-total // bucket_rows))
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = documents.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        draw.alias("_draw"),
        # the top bits of the draw, as a share of its range: equal shares hold about equal rows
        F.floor((F.shiftright(draw, 32).cast("double") + (1 << 31)) * (buckets / (1 << 32))).alias("_bucket"),
    )
    by_source = ranked(rows, ["_source"], "_bucket", ["_draw", "doc_id", "size", "text_crc32"], "_rank")
    share = (F.col("_rank") * 2 + 1).cast("double") / (F.col("_rank_of") * 2).cast("double")
    spread = by_source.withColumn("_share", share).withColumn("_slice", F.floor(share * buckets)).withColumn("_all", F.lit(0)).withColumn("_tie", F.xxhash64("_source"))
    placed = ranked(spread, ["_all"], "_slice", ["_share", "_tie", "_source", "_rank"], "_at")
    exact = F.expr(f"cast((_at * {shards}L) div {max(total, 1)}L as int)")
    first = F.expr(f"((_at * {shards}L) div {max(total, 1)}L * {total}L + {shards - 1}L) div {shards}L")
    return placed.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "text_crc32", exact.alias("shard"), (F.col("_at") - first).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
