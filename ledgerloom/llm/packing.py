"""Packing of token pieces into sequences of fixed length by a configuration linear program.

The program has one variable for each configuration (a multiset of piece lengths that fits a sequence) and one covering
row for each length: use every length at least as often as it occurs, with the fewest sequences.  It depends only on
the histogram of lengths, which has as many entries as a sequence has tokens whatever the corpus.  Multiplicative
weights solve it: each row's weight falls as its length is covered, and a knapsack dynamic program over the sequence
prices the configuration of most weight.  The solution is rounded as it grows: a step takes a whole number of sequences
of its configuration and only pieces that are left, so steps go on until every row is covered and nothing is covered
twice.  Prices lean to long pieces, so what is left towards the end is short and fits anywhere; best fit may place what
the last tenth of the tokens is, where that needs fewer sequences.  The weights are a dual solution as well, and the
bound that follows from them ends the search.  The result is a table of slots: ranks of each length to sequences and
places.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCHES, pieces, settings, stage_table
from .encoder import default_encoder

SEQUENCE, END_ID = 1024, 2
BUCKET_ROWS = 50_000
#: How fast weights fall, how much prices lean to long pieces (each is tried until the number of sequences is within GAP of
#: the bound), the share of all sequences that a step takes at most, and the share of the tokens and the number of pieces
#: that best fit may place, and how near to the best price a configuration has to be to be taken in one step with it.
ETA, LEANS, GAP, UNIT, REST, FEW, NEAR = 0.5, (0.5, 1.0, 0.2, 2.0), 0.001, 0.01, 0.1, 8, 0.98


def priced(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to ``capacity`` the highest total price of lengths that fit it (unbounded knapsack), and one length of
    such a choice (0: the same as with one token less)."""
    value, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(price > 0)
    gains, fit = price[lengths], np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        n, value[c] = fit[c], value[c - 1]
        if n:
            total = value[c - lengths[:n]] + gains[:n]
            at = int(total.argmax())
            if total[at] > value[c]:
                value[c], last[c] = total[at], lengths[at]
    return value, last


def choices(price: np.ndarray, capacity: int, near: float):
    """Configurations with their total prices, the best one of each length that is within ``near`` of the best of all."""
    value, last = priced(price, capacity)
    lengths = np.flatnonzero(price > 0)
    worth = price[lengths] + value[capacity - lengths]
    for i in np.argsort(-worth, kind="stable").tolist():
        if worth[i] < near * value[capacity]:
            return
        config, room = Counter([int(lengths[i])]), capacity - int(lengths[i])
        while room > 0:
            n = int(last[room])
            if n:
                config[n] += 1
            room -= n or 1
        yield config, float(value[capacity])


def topped(config: Counter, left: np.ndarray, capacity: int) -> Counter:
    """A configuration with the longest pieces added that are there and fit what it leaves free."""
    room = capacity - sum(n * k for n, k in config.items())
    for n in np.flatnonzero(left[: room + 1])[::-1].tolist():
        more = min(room // n, int(left[n]) - config[n])
        if more > 0:
            config[n] += more
            room -= more * n
    return config


def covering(counts: np.ndarray, capacity: int, lean: float, eta: float = ETA, unit: float = UNIT) -> tuple[Counter, int, int]:
    """A rounded solution of the program for ``counts`` (pieces by length), how many of its sequences best fit filled, and a
    lower bound from the first weights.

    A length's price is its tokens, more for long ones, times the exponential of its covered share.  Each step takes as
    many sequences of the configuration priced highest as the pieces left allow, ``unit`` of the volume bound at most.
    """
    lengths, left, out = np.arange(len(counts)), counts.copy(), Counter()
    tokens = int((lengths * counts).sum())
    most, bound, best, by_fit, mark = max(1, int(tokens / capacity * unit)), -(-tokens // capacity), None, 0, REST * tokens
    while left.any():
        share = np.divide(counts - left, counts, out=np.zeros(len(counts)), where=counts > 0)
        price = np.where(left > 0, lengths * (1 + lean * lengths / capacity) * np.exp(-eta * share), 0.0)
        if (lengths * left).sum() <= mark or left.sum() <= FEW:  # each time that half as much is left
            rest, mark = best_fit(left, capacity), (lengths * left).sum() / 2
            if best is None or sum(out.values()) + sum(rest.values()) <= sum(best.values()):
                best, by_fit = out + rest, sum(rest.values())
        used: set[int] = set()
        for config, value in choices(price, capacity, NEAR):
            if not out:  # every packing of these pieces pays at most this for a sequence
                bound = max(bound, math.ceil(float(price @ counts) / value - 1e-9))
            if used & config.keys():
                continue
            if any(k > left[n] for n, k in config.items()):
                if used:
                    continue
                config = topped(Counter({n: min(k, int(left[n])) for n, k in config.items()}), left, capacity)
            number = max(1, min([most, *(int(left[n]) // k for n, k in config.items())]))
            for n, k in config.items():
                left[n] -= number * k
            used |= config.keys()
            out[tuple(sorted(config.items()))] += number
    return (out, 0, bound) if best is None or sum(out.values()) <= sum(best.values()) else (best, by_fit, bound)


def best_fit(counts: np.ndarray, capacity: int) -> Counter:
    """Best fit by falling length over a histogram: groups of equal sequences are filled together."""
    groups: dict[int, Counter] = defaultdict(Counter)  # free tokens to contents to number
    free = np.zeros(capacity + 1, bool)
    for n in range(len(counts) - 1, 0, -1):
        left = int(counts[n])
        while left:
            fits = np.flatnonzero(free[n:])
            if len(fits) == 0:
                each = capacity // n
                whole, rest = divmod(left, each)
                for number, times in ((whole, each), (1, rest)):
                    if number and times:
                        groups[capacity - n * times][((n, times),)] += number
                        free[capacity - n * times] = True
                break
            room = n + int(fits[0])
            content, number = groups[room].popitem()
            # fill as many of these sequences as there are pieces, each with as many as go in
            times = min(room // n, left)
            used = min(number, left // times)
            if used < number:
                groups[room][content] = number - used
            free[room] = bool(groups[room])
            left -= used * times
            merged = Counter(dict(content))
            merged[n] += times
            groups[room - n * times][tuple(sorted(merged.items()))] += used
            free[room - n * times] = True
    return sum(groups.values(), Counter())


def solve(counts: np.ndarray, capacity: int) -> Counter:
    """Configurations and how many sequences take each; every piece of ``counts`` is placed."""
    counts, best = counts.astype(np.int64), None
    counts[0] = 0
    for lean in LEANS if counts.any() else ():
        found, _, bound = covering(counts, capacity, lean)
        if best is None or sum(found.values()) < sum(best.values()):
            best = found
        if sum(best.values()) <= bound * (1 + GAP):
            break
    return best or Counter()


class Slots:
    """From a length and a rank among the pieces of that length to a sequence and a place in it."""

    def __init__(self, configurations: Counter, capacity: int):
        starts, bases, places = defaultdict(list), defaultdict(list), defaultdict(list)
        rank, sequence = np.zeros(capacity + 1, np.int64), 0
        for config, number in sorted(configurations.items()):
            place = 0
            for n, k in config:
                for _ in range(k):
                    starts[n].append(int(rank[n]))
                    bases[n].append(sequence)
                    places[n].append(place)
                    rank[n] += number
                    place += n
            sequence += number
        self.sequences = sequence
        self.rows = {n: (np.array(starts[n]), np.array(bases[n]), np.array(places[n])) for n in starts}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            starts, bases, places = self.rows[n]
            row = np.searchsorted(starts, rank[at], side="right") - 1
            sequence[at], offset[at] = bases[row] + rank[at] - starts[row], places[row]
        return sequence, offset


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(documents: DataFrame, sequence: int = SEQUENCE, encoder=default_encoder) -> DataFrame:
    """Token pieces of ``documents`` (doc_id, text): ids and the end id; longer ones are cut, the first piece being the short one."""

    def run(batches):
        encode = encoder().ids
        for whole in batches:
            for batch in pieces(whole, "text"):
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = encode(text) if text else []
                    raw = np.array([*ids, END_ID], dtype="<u4")
                    start, number = 0, 0
                    end = (len(raw) - 1) % sequence + 1
                    while start < len(raw):
                        rows.append((doc, number, start, end - start, zlib.crc32(raw[start:end].tobytes())))
                        start, end, number = end, end + sequence, number + 1
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack(documents: DataFrame, sequence: int = SEQUENCE, encoder=default_encoder, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pack all ``documents`` (doc_id, text) into sequences of at most ``sequence`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset.  Null and empty texts are the end id alone;
    repeated rows are packed each for itself; an empty table gives no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    with settings(spark, **BATCHES):
        cut = stage_table(cut_pieces(documents, sequence, encoder), "pieces")
    histogram = cut.groupBy("length").count().collect()  # at most one row for each length up to a sequence
    counts = np.zeros(sequence + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["count"]
    short = counts.copy()
    short[sequence] = 0
    configurations = solve(short, sequence)
    if counts[sequence]:
        configurations[((sequence, 1),)] += int(counts[sequence])
    slots = spark.sparkContext.broadcast(Slots(configurations, sequence))
    buckets = max(1, -(-int(counts.sum()) // bucket_rows))
    # the rank of a piece among those of its length: its number in a bucket and the pieces of the buckets before it
    rows = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = rows.groupBy("length", "_bucket").count()
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    number = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranks = rows.withColumn("_number", number).join(sizes, ["length", "_bucket"])
    ranks = ranks.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_number") - 1).alias("rank"))

    def run(batches):
        for batch in batches:
            length, rank = (np.asarray(pc.cast(batch.column(c), pa.int64())) for c in ("length", "rank"))
            sequence_id, offset = slots.value.place(length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence_id), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranks.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
