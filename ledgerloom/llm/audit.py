"""How corpus filters overlap: what each removes, in every order they can be applied in.

One scan over the Arrow buffers of the texts says which filters a document fails.  NumPy classes the bytes; prefix sums
over the classes count words, capitals, symbols and code points of all documents of a batch at once.  Words are hashed
by prefix sums too and sorted within their document; neighbours with one hash are compared byte by byte, so the number
of distinct words is exact.  What a document fails is a mask of a few bits, and all figures are sums over masks: the
table shrinks to one row for each part, mask and label before any order of the filters is looked at.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SpanHash, pieces, stage_table, utf8, word_spans, word_table

#: Few words, repeated words, capitals, symbols, a text seen before: bit i of a mask is the filter FILTERS[i].
FILTERS = "ABCDE"
WORD = word_table([0x20, *range(0x09, 0x0E)])
CAPITAL = np.isin(np.arange(256), np.arange(0x41, 0x5B))
SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", np.uint8))
FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80
#: A sort key holds a document's number in its batch above so many bits of a word's hash.
HASH_BITS = 44


def in_each(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged, by prefix sums."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def differing(raw: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pairs of spans (starts ``one`` and ``two``, ``size`` bytes) that are not the same bytes."""
    ends = np.cumsum(size)
    step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
    bad = np.flatnonzero(raw[np.repeat(one, size) + step] != raw[np.repeat(two, size) + step])
    return np.unique(np.searchsorted(ends, bad, side="right"))


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many different words each text has; ``first`` are the numbers of the texts' first words."""
    texts = len(first) - 1
    text = np.repeat(np.arange(texts), np.diff(first))
    key = (text.astype(np.uint64) << np.uint64(HASH_BITS)) | (SpanHash(raw).spans(starts, ends) >> np.uint64(64 - HASH_BITS))
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    one, two = order[same], order[same + 1]
    out = np.diff(first) - np.bincount(text[one], minlength=texts)
    size = ends - starts
    short = size[one] != size[two]
    alike = np.flatnonzero(~short)
    clash = np.union1d(text[one[short]], text[one[alike][differing(raw, starts[one[alike]], starts[two[alike]], size[one[alike]])]])
    for i in clash.tolist():  # two words of one hash: such a text is counted by its words
        out[i] = len({raw[starts[j] : ends[j]].tobytes() for j in range(first[i], first[i + 1])})
    return out


def masks(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the filters A to D that it fails."""
    starts, ends, first = word_spans(raw, offsets, WORD)
    words, distinct = np.diff(first), distinct_words(raw, starts, ends, first)
    capitals, symbols, points = (in_each(table[raw], offsets) for table in (CAPITAL, SYMBOL, FIRST_BYTE))
    fails = (words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * points, symbols > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


SCAN = "doc_id long, part string, digest binary, fails int"


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, part (the language, null: empty), SHA-256 of the text and the mask of filters A to D of every row."""

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                raw, offsets = utf8(batch.column("text"))
                view, ends = memoryview(np.ascontiguousarray(raw)), offsets.tolist()
                digest = [hashlib.sha256(view[a:b]).digest() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(digest, pa.binary()), pa.array(masks(raw, offsets), pa.int32())], names=["doc_id", "part", "digest", "fails"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text").mapInArrow(run, SCAN)


def patterns(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (mask of A to E), good, toxic and the number n of rows that share them.

    Filter E fails where a row of a smaller doc_id has the same text.  A group of copies shrinks to a few rows before its
    smallest id is looked for: of each (text, part, labels) the count and the smallest id with its rows are kept.
    """
    seen = stage_table(scan(documents), "audit")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = seen.where("doc_id is not null").groupBy("doc_id", "digest", "part", "fails").agg(F.count("*").alias("n"))
    rows = rows.join(marks, "doc_id", "left").select("doc_id", "digest", "part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")
    groups = rows.groupBy("digest", "part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"))
    original = F.when(F.col("first") == F.min("first").over(Window.partitionBy("digest")), F.col("n_first")).otherwise(0)
    split = groups.withColumn("_kept", original).select(
        "part", "good", "toxic", F.explode(F.array(F.struct("fails", F.col("_kept").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("_kept")).alias("n")))).alias("_x")
    )
    split = split.select("part", "good", "toxic", "_x.fails", "_x.n").where("n > 0")
    # a row without an id follows no other row
    rest = seen.where("doc_id is null").select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "fails", F.lit(1).cast("long").alias("n"))
    return split.unionByName(rest).groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the five filters and step: what is kept, removed, removed before, and what it costs.

    ``documents`` needs doc_id, text and lang, ``labels`` doc_id, quality and toxic; other columns are ignored.  A null
    text is empty, a null language the part ''.  Repeated rows count each for itself and are no copies of each other, as
    their ids are equal; rows without an id are counted, are copies of nothing and have no label.  Several label rows of an
    id count as one that has what any of them has.  An empty table has no part and gives no row.
    """
    found = patterns(documents, labels)
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    # each mask meets the 120 orders and their five steps: a fixed number of rows for each part
    steps = found.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = "shiftleft(1, ascii(substring(filter_order, {0}, 1)) - 65)"
    steps = steps.withColumn("_bit", F.expr(bit.format("step"))).withColumn("_before", F.expr(f"aggregate(sequence(1, {len(FILTERS)}), 0, (m, i) -> if(i < step, m | {bit.format('i')}, m))"))
    fails, earlier = F.col("fails").bitwiseAND(F.col("_bit")) > 0, F.col("fails").bitwiseAND(F.col("_before")) > 0
    count = lambda what: F.sum(F.when(what, F.col("n")).otherwise(0))
    table = steps.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~earlier).alias("kept"),
        count(fails & ~earlier).alias("removed"),
        count(fails & earlier).alias("redundant"),
        count(F.col("fails") == F.col("_bit")).alias("unique_fails"),
        count(fails & ~earlier & F.col("good")).alias("good_lost"),
        count(fails & ~earlier & F.col("toxic")).alias("toxic_lost"),
    )
    own = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return table.withColumn("shapley", F.sum("removed").over(own))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), f AS (
  SELECT w.doc_id, part,
    CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails
  FROM w
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), p AS (
  SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, (1 << (ascii(substr(filter_order, step, 1)) - 65)) AS bit,
    list_sum([0] || [1 << (ascii(y) - 65) FOR y IN string_split(substr(filter_order, 1, step - 1), '') IF y <> '']) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), t AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN fails & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & bit > 0 AND fails & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & bit > 0 AND fails & before > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN good AND fails & bit > 0 AND fails & before = 0 THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN toxic AND fails & bit > 0 AND fails & before = 0 THEN n ELSE 0 END) AS toxic_lost
  FROM p, steps GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM t
"""
