"""Shared helpers: written intermediate tables, UTF-8 buffers and word hashes for Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
#: An odd base has an inverse modulo 2**64, so a prefix sum gives the hash of any span.
BASE = 0x2545F4914F6CDD1D
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (a test) gets a temporary folder; on a cluster that is an error, as a folder of one
    machine is no shared one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            path = current.get()
        elif re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            path = tempfile.mkdtemp(prefix="ledgerloom-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session (dots written as two underscores) that hold for a while."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: While these hold, the shuffle files of a query go when the query has ended, and no side of a join is sent through the
#: driver unless a hint says so.
WRITING = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true", "spark__sql__autoBroadcastJoinThreshold": "-1"}


#: While these hold, a batch for a Python worker ends after so many rows or so many bytes (one row at least).  Spark's own
#: bounds (10,000 rows, 64 MB) are held for each task twice while a vector grows, and once more in the worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
BATCHES = {"spark__sql__execution__arrow__maxRecordsPerBatch": str(BATCH_ROWS), "spark__sql__execution__arrow__maxBytesPerBatch": str(BATCH_BYTES)}


def stage_table(df: DataFrame, name: str, **counts: Column) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that a lost executor costs no recomputation.

    The table is written once, so its shuffle files are of no use afterwards and are given up at once.  ``counts`` are
    aggregates over the rows written; their values are the attribute ``observed`` of the result.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    seen = Observation() if counts else None
    with settings(spark, **WRITING):
        (df.observe(seen, *[c.alias(k) for k, c in counts.items()]) if seen else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.observed = seen.get if seen else {}
    out.staged = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stage_table`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.staged)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Sides of joins are broadcast up to so many ids.
BROADCAST_IDS = 500_000


def by_ids(rows: DataFrame, ids: DataFrame, key: str, number: int, how: str) -> DataFrame:
    """Semi or anti join of ``rows`` with ``number`` ids of one column: a broadcast up to BROADCAST_IDS, else a shuffle."""
    return rows.join(sized(ids, number), key, how)


def sized(side: DataFrame, number: int) -> DataFrame:
    """A narrow side of a join that has ``number`` rows at most: broadcast up to BROADCAST_IDS."""
    return F.broadcast(side) if number <= BROADCAST_IDS else side.hint("merge")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 21):
    """Cut a batch into slices of about ``limit`` bytes of ``column`` (one row at least), to bound memory."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings (null: empty) and the offsets of each."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def fold_table() -> np.ndarray:
    """Byte to byte: A-Z to lower case, the rest as it is."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


FOLD = fold_table()


def word_table(excluded) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(excluded)] = False
    return table


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and the index of each text's first word (and their number)."""
    inside = is_word[raw]
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class SpanHash:
    """64-bit hashes of spans of one byte buffer."""

    powers = np.ones(1, dtype=np.uint64)
    inverses = np.ones(1, dtype=np.uint64)

    @classmethod
    def grow(cls, n: int) -> None:
        if len(cls.powers) < n:
            with np.errstate(over="ignore"):
                for name, base in (("powers", BASE), ("inverses", BASE_INVERSE)):
                    step = np.full(n, base, dtype=np.uint64)
                    step[0] = 1
                    setattr(cls, name, np.multiply.accumulate(step))

    def __init__(self, raw: np.ndarray):
        self.grow(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self.inverses[starts]
        return mix(value + (ends - starts).astype(np.uint64) * GOLDEN)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive word hashes (also those that run across two texts: the caller leaves them out)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out *= np.uint64(BASE)
        out += words[i : i + n]
    return mix(out + np.uint64(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
