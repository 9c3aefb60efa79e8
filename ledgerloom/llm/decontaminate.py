"""Benchmark decontamination by winnowing.

Of each run of consecutive word k-grams the smallest hash is kept as a fingerprint, on the benchmark side and on the
document side.  A shared span of ``window`` words holds ``window - k + 1`` k-grams, so both sides keep a fingerprint
inside it: every such span is found.  Spark joins the fingerprints of both sides; hits are extended word by word, and
only runs of at least ``window`` equal words count.  Items shorter than a window are looked up by the hash of all their
words.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, SpanHash, gram_hashes, mix, pieces, signed, sliding_min, stage_table, utf8, word_spans, word_table

#: Bytes that separate words, after lower-casing: \x00-\x2F, \x3A-\x60, \x7B-\x7F.
SEPARATORS = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
IS_WORD = word_table(SEPARATORS)
WINDOW, GRAM = 10, 5
#: Bits of the table that says which fingerprints the benchmark may have: a fixed size, whatever the benchmark's.
FILTER_BITS = 20
#: Copies of each benchmark fingerprint in the join: a passage may be in a third of all documents.
SALTS = 16
#: Fingerprints of the benchmark are broadcast up to so many; more are dealt by their hash.
BROADCAST_ROWS = 200_000


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the index of each text's first word."""
    raw, offsets = utf8(column)
    raw = FOLD[raw]
    starts, ends, first = word_spans(raw, offsets, IS_WORD)
    return SpanHash(raw).spans(starts, ends), first


def fingerprints(words: np.ndarray, first: np.ndarray, window: int = WINDOW, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the k-grams kept by winnowing, and their hashes; grams and runs never cross texts."""
    grams = gram_hashes(words, k)
    run = window - k + 1
    if len(grams) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding_min(grams, run)
    lengths = np.diff(first)
    text = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.arange(len(least))
    inside = text[starts] == text[np.minimum(starts + window - 1, len(text) - 1)]
    # every gram that attains the minimum of some run is kept: ties then need no rule that both sides share
    kept = np.zeros(len(grams), dtype=bool)
    for j in range(run):
        hit = inside & (grams[j : j + len(least)] == least)
        kept[j : j + len(least)] |= hit
    at = np.flatnonzero(kept)
    return at, grams[at]


def around(words: np.ndarray, first: np.ndarray, text: np.ndarray, at: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that windows with the k-gram at each place can reach; a place outside the text has a name of its own."""
    place = at[:, None] + np.arange(k - window, window)
    inside = (place >= first[text][:, None]) & (place < first[text + 1][:, None])
    return np.where(inside, words[np.clip(place, 0, len(words) - 1)], np.uint64(0)), inside


FINGERPRINT = "struct<at:int,size:int,hash:long,words:array<long>>"
KIND = pa.struct([("at", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()), ("words", pa.list_(pa.int64()))])


def places(words: np.ndarray, first: np.ndarray, window: int, k: int, short: list[int], whole: bool, allowed: np.ndarray | None) -> tuple[np.ndarray, pa.Array]:
    """Fingerprints of texts, and the text of each: the winnowed k-grams with the words around them (null where there is
    none), and the runs of ``short`` many words (``whole``: only texts that are no longer).  ``allowed`` is the filter."""
    lengths = np.diff(first)
    out = []
    for size in [0, *short]:
        if size:
            grams = gram_hashes(words, size)
            at = np.arange(len(grams))
        else:
            at, grams = fingerprints(words, first, window, k)
        hashes = mix(grams ^ np.uint64(size))
        if allowed is not None:
            keep = allowed[hashes & np.uint64((1 << FILTER_BITS) - 1)]
            at, hashes = at[keep], hashes[keep]
        text = np.searchsorted(first, at, side="right") - 1
        if size:
            keep = (lengths[text] == size) if whole else at + size <= first[text + 1]
            at, hashes, text = at[keep], hashes[keep], text[keep]
        around_words, inside = around(words, first, text, at, window, k) if not size else (np.zeros((len(at), 0), np.uint64), None)
        flat = pa.array(signed(around_words.ravel()), pa.int64(), mask=None if inside is None else ~inside.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * around_words.shape[1], pa.int32()), flat)
        columns = [pa.array((at - first[text]).astype(np.int32)), pa.array(np.full(len(at), size, np.int32)), pa.array(signed(hashes)), lists]
        out.append((text, pa.StructArray.from_arrays(columns, fields=list(KIND))))
    text = np.concatenate([t for t, _ in out])
    order = np.argsort(text, kind="stable")
    return text[order], pa.concat_arrays([x for _, x in out]).take(pa.array(order))


def fingerprinted(rows: DataFrame, window: int, k: int, short: list[int], whole: bool, allowed=None) -> DataFrame:
    """``rows`` (text and others) with n_words and fingerprints instead of the text."""
    others = [f for f in rows.schema if f.name != "text"]

    def run(batches):
        for all_rows in batches:
            for batch in pieces(all_rows, "text", 1 << 19):
                words, first = words_of(batch.column("text"))
                text, found = places(words, first, window, k, short, whole, None if allowed is None else allowed.value)
                offsets = pa.array(np.searchsorted(text, np.arange(len(batch) + 1)).astype(np.int32))
                kept = [batch.column(f.name) for f in others]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(offsets, found)], names=[*(f.name for f in others), "n_words", "fingerprints"])

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)
    return rows.mapInArrow(run, f"{ddl}n_words long, fingerprints array<{FINGERPRINT}>")


def hits_of(documents: DataFrame, items: DataFrame, number: int, window: int, k: int, broadcast_rows: int) -> DataFrame:
    """row, s, e, item: runs of at least ``window`` equal words around equal fingerprints, and whole short items."""
    left = documents.select("row", F.explode("fingerprints").alias("f")).select("row", "f.*")
    right = items.select("item", F.explode("fingerprints").alias("f")).select("item", F.col("f.hash").alias("hash"), F.col("f.size").alias("size"), F.col("f.words").alias("other")).distinct()
    if number <= broadcast_rows:
        met = left.join(F.broadcast(right), ["hash", "size"])
    else:
        right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = left.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int")).join(right, ["hash", "size", "salt"])
    reach = window - k
    same = [f"(get(words, {i}) = get(other, {i}))" for i in range(2 * window - k)]

    def run(order):  # how many words are equal, from the k-gram outwards
        return " + ".join(f"cast(coalesce({' and '.join(same[i] for i in order[: n + 1])}, false) as int)" for n in range(len(order)))

    equal = " and ".join(same[reach:window])
    met = met.where(F.expr(f"size > 0 or coalesce({equal}, false)"))
    before = F.when(F.col("size") > 0, 0).otherwise(F.expr(run(list(range(reach - 1, -1, -1)))))
    after = F.when(F.col("size") > 0, F.col("size")).otherwise(k + F.expr(run(list(range(window, 2 * window - k)))))
    spans = met.select("row", "item", "size", (F.col("at") - before).alias("s"), (F.col("at") + after).alias("e"))
    return spans.where((F.col("size") > 0) | (F.col("e") - F.col("s") >= window)).select("row", "item", "s", "e")


def merged(spans) -> list[tuple[int, int]]:
    """Disjoint runs that cover the same words."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def by_row(hits: DataFrame) -> DataFrame:
    """row, spans (disjoint runs), items (sorted)."""

    def run(batches):
        for batch in batches:
            spans = [[{"s": s, "e": e} for s, e in merged((x["s"], x["e"]) for x in row)] for row in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), batch.column("items")], names=["row", "spans", "items"])

    rows = hits.groupBy("row").agg(F.collect_set(F.struct("s", "e")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    return rows.mapInArrow(run, "row long, spans array<struct<s:int,e:int>>, items array<string>")


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM, keep: tuple[str, ...] = (), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Word runs of ``documents`` (doc_id, text) that occur as windows of ``benchmark`` (item_id, text).

    Returns doc_id, the columns ``keep``, n_words, spans (disjoint runs of word indexes, end exclusive), items (item ids as
    sorted strings).  Null and empty texts have no words and no hits; every row is judged for itself, also where ids
    repeat or are null; an empty benchmark gives no hits; other columns are ignored.

    Fingerprints of both sides carry the words around them, so a join by their hash extends a hit without the texts.  A
    bit table of fixed size keeps most fingerprints that the benchmark lacks out of the join.
    """
    spark = documents.sparkSession
    texts = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null and item_id is not null")
    items = stage_table(fingerprinted(texts, window, k, list(range(1, window)), True), "items", n=F.sum(F.size("fingerprints")))
    place = F.explode(F.transform("fingerprints", lambda x: F.struct(x["hash"].bitwiseAND((1 << FILTER_BITS) - 1).cast("int").alias("bit"), x["size"].alias("size"))))
    known = items.select(place.alias("x")).select("x.bit", "x.size").distinct().toArrow()  # at most a row for each bit and short length
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[known.column("bit").to_numpy()] = True
    short = sorted(set(known.column("size").to_pylist()) - {0})
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    read = fingerprinted(source, window, k, short, False, spark.sparkContext.broadcast(bits))
    rows = stage_table(read.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    hits = stage_table(by_row(hits_of(rows, items, items.observed["n"] or 0, window, k, broadcast_rows)), "hits", n=F.count("*"))
    none = [F.coalesce(c, F.expr(f"cast(array() as {t})")).alias(c) for c, t in (("spans", "array<struct<s:int,e:int>>"), ("items", "array<string>"))]
    return rows.join(hits, "row", "left").select("doc_id", *keep, "n_words", *none)


def digest(found: DataFrame) -> DataFrame:
    """The columns that the query reports."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x.e - x.s).cast("long"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def brute_force(documents: list[tuple], benchmark: list[tuple], window: int = WINDOW) -> dict:
    """Plain definition, for tests: doc_id to (n_words, n_hit, items)."""
    import re

    def split(text):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    windows = defaultdict(set)
    for item, text in benchmark:
        w = split(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[i : i + window])].add(str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in documents:
        w, hit, items = split(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        out[doc] = len(w), len(hit), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return out

