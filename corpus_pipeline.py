"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage but the last returns the columns of ``documents``.  Its result is written as Parquet and read again as the
next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language, neardup, packing, secrets
from ledgerloom.llm.common import BATCHES, by_ids, discard, settings, shared_dir, stage_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text that the best language codes in so many bits a byte is in none of them: plain bytes cost no more.
MOST_BITS = 8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identify the language of every row by itself; ``lang`` becomes the prediction.

    Texts without a language go: null and empty ones, those without a letter, and those that no language codes in less
    than ``MOST_BITS`` a byte.  The trees are fitted on labelled rows as in op8_language.  Without any labelled row only
    texts without a letter go, and ``lang`` stays null.
    """
    rows = docs.select(*COLUMNS)
    model = language.train(rows.where(~language.held_out()))
    if not model.languages:
        return rows.where(F.col("text").rlike(language.LETTER))
    found = language.identify(rows, model, ("text", "source", "n_chars"))
    kept = found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("bits_per_byte") < MOST_BITS))
    return kept.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class stays: that of the smallest doc_id, and of its rows (or of those without an
    id, where no row has one) the first.  Texts without words are linked with nothing and stay."""
    rows = stage_table(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    classes = neardup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))["_row"].alias("_row")
    ids = classes.join(rows.select("_row", "doc_id"), "_row")
    gone = stage_table(classes.select("_row").join(ids.groupBy("component_id").agg(first).select("_row"), "_row", "left_anti"), "gone", n=F.count("*"))
    return by_ids(rows, gone, "_row", gone.observed["n"], "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a window of a benchmark item go; equal texts go together, null and empty ones stay."""
    name = F.unhex(F.sha2("text", 256))
    rows = docs.select(*COLUMNS).withColumn("_name", name)
    with settings(spark, **BATCHES):
        found = decontaminate.find_contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("_name",))
        gone = stage_table(found.where(F.size("spans") > 0).select("_name").distinct(), "gone", n=F.count("*"))
    return by_ids(rows, gone, "_name", gone.observed["n"], "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all rows stay, with n_chars of the new text (0 for null)."""
    rows = docs.select(*COLUMNS)
    ledger = secrets.update_ledger(rows, f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")
    clean = secrets.redact(rows, ledger)
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all rows, placed in sequences; null and empty texts are the end id alone, repeated rows count."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Model-based and tokenizer-based stages are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
