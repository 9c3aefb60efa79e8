"""Packing by balanced cost: sequences get about the same estimated work, and none is padded.

A piece of n tokens costs ``LINEAR * n + n * n``: the dense layers are linear in the tokens, attention inside a document
is quadratic.  Documents are dealt by falling cost, each to the sequence of lowest cost that has room for it.  This needs
the histogram of lengths only: sequences that were filled alike are one group (a range of ids), a group gives way to the
next one when each of its sequences has got a piece, and a length splits at most one group.  So the driver holds at most
one group and one histogram row for each length, whatever the corpus.

There are just as many places as tokens: as many whole sequences as the tokens fill, and one of a power of two for each
bit of what is left.  Pieces that no sequence has room for are laid end to end along the places that stayed free and cut
there.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, stage_table
from .sharding import ranked

SEQUENCE, END_ID = 2048, 1
#: Tokens at which attention costs as much as the dense layers: six times the width of a model of 1024.
LINEAR = 6 * 1024
BUCKET_ROWS = 50_000


class Chunks(dict):
    """Packed ids by a run of characters without white space; a new one is encoded when it is asked for."""

    MOST, LONGEST = 500_000, 100

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        out = self.encode(chunk)
        if len(chunk) <= self.LONGEST:
            self[chunk] = out
        return out


class WordEncoder:
    """Ids of texts under a vocabulary of lower-cased words, as ``tokenizers`` gives them.

    The vocabulary drops white space and splits a text into words before it merges, so what stands between white space has
    the same ids wherever it stands.  In texts of plain European script such chunks are looked up.  New ones go to
    ``tiktoken`` with the vocabulary as ranks: the end of a word is one more byte there, which plain text does not hold, and
    merges with the last letter first.  All other texts, and those that may hold a special token, go to ``tokenizers``.  The
    tests compare both ways.
    """

    LETTER, NUMBER, END = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾", "\0"
    other = re.compile("[^\t\n\r -~\xa0-įı-ſ]")
    words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\\s{LETTER}{NUMBER}]+")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.slow = Tokenizer.from_file(path)
        level = {c: i for i, c in enumerate(self.byte_letters(pre_tokenizers.ByteLevel.alphabet()))}
        ranks = {}
        for token, rank in self.slow.get_vocab(with_added_tokens=False).items():
            stem = token.removesuffix("</w>")
            raw = bytes(level.get(c, 0) for c in stem)
            if len(token) == 1 or 0 not in raw:  # a token that holds the byte of the end is not met in plain text
                ranks[raw + bytes(stem != token)] = rank
        self.ranked = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})
        self.known = Chunks(self.chunk)

    @staticmethod
    def byte_letters(alphabet: list[str]) -> list[str]:
        """The letter that stands for each byte: itself if it is printed, else the next free one from U+0100 on."""
        shown = {c for c in alphabet if ord(c) < 256}
        rest = iter(sorted(c for c in alphabet if ord(c) > 255))
        return [chr(i) if chr(i) in shown else next(rest) for i in range(256)]

    def chunk(self, chunk: str) -> bytes:
        return array("I", self.ranked.encode_ordinary("".join(w + self.END for w in self.words.findall(chunk)))).tobytes()

    def ids(self, text: str) -> np.ndarray:
        if "<|" in text or not (text.isascii() and text.isprintable()) and self.other.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        if len(self.known) > Chunks.MOST:
            self.known.clear()
        return np.frombuffer(b"".join(map(self.known.__getitem__, text.lower().split())), "<u4")


_encoders: dict[str, WordEncoder] = {}


def word_encoder() -> WordEncoder:
    """One for each Python worker, whose words are kept from task to task."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Deal:
    """Where the pieces of a histogram go: ``counts[n]`` pieces of n tokens, each shorter than ``capacity``."""

    def __init__(self, counts: np.ndarray, capacity: int, linear: int = LINEAR):
        counts = counts.astype(np.int64)
        total = int((np.arange(len(counts)) * counts).sum())
        whole, rest = divmod(total, capacity)
        sizes = [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.sequences = whole + len(sizes)
        #: by the room that is left: groups (cost, first sequence, number, used, capacity) that the current length does not fit in
        waiting: dict[int, list[tuple]] = defaultdict(list)
        for group in [(0, 0, whole, 0, capacity)] * (whole > 0) + [(0, whole + i, 1, 0, s) for i, s in enumerate(sizes)]:
            waiting[group[4]].append(group)
        open_groups: list[tuple] = []
        self.rows: dict[int, tuple[np.ndarray, ...]] = {}
        self.placed = np.zeros(len(counts), np.int64)
        for n in np.flatnonzero(counts)[::-1].tolist():
            for room in [r for r in waiting if r >= n]:
                for group in waiting.pop(room):
                    heapq.heappush(open_groups, group)
            rank, rows = 0, []
            while rank < counts[n] and open_groups:
                cost, first, number, used, size = heapq.heappop(open_groups)
                take = min(number, int(counts[n]) - rank)
                rows.append((rank, first, used))
                if take < number:
                    heapq.heappush(open_groups, (cost, first + take, number - take, used, size))
                group, room = (cost + linear * n + n * n, first, take, used + n, size), size - used - n
                if room >= n:
                    heapq.heappush(open_groups, group)
                elif room:
                    waiting[room].append(group)
                rank += take
            self.placed[n] = rank
            if rows:
                self.rows[n] = tuple(np.array(x, np.int64) for x in zip(*rows, strict=True))
        #: pieces without a place lie end to end, the longest first; so do the places that stayed free
        self.left = counts - self.placed
        tokens = np.arange(len(counts)) * self.left
        self.line = np.cumsum(tokens[::-1])[::-1] - tokens
        free = sorted(((g[4] - g[3], *g) for g in chain(open_groups, *waiting.values())), key=lambda g: (-g[0], g[2]))
        room, _, first, number, used, _ = np.array(free, np.int64).reshape(-1, 6).T
        self.gaps = (np.cumsum(room * number) - room * number, room, first, used)

    def place(self, n: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and places of pieces of n tokens with a rank below ``placed[n]``."""
        start, first, used = self.rows[n]
        at = np.searchsorted(start, ranks, side="right") - 1
        return first[at] + ranks - start[at], used[at]

    def cuts(self, n: int, rank: int):
        """Tokens before, tokens, sequence and place of each part of a piece that is cut."""
        begin, room, first, used = self.gaps
        at, done = int(self.line[n] + (rank - self.placed[n]) * n), 0
        while done < n:
            g = int(np.searchsorted(begin, at, side="right")) - 1
            number, inside = divmod(at - int(begin[g]), int(room[g]))
            take = min(int(room[g]) - inside, n - done)
            yield done, take, int(first[g]) + number, int(used[g]) + inside
            done, at = done + take, at + take


RAW = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary"
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_documents(documents: DataFrame, sequence: int, encoder: Callable, end_id: int) -> DataFrame:
    """Pieces of at most ``sequence`` tokens, the last of a document being the short one; short ones with their ids."""

    def run(batches):
        encode = encoder().ids
        for whole in batches:
            for batch in pieces(whole, "text"):
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    raw = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(raw), sequence):
                        piece = raw[start : start + sequence]
                        rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(raw), None if len(piece) == sequence else piece.astype("<u2" if piece.max() < 1 << 16 else "<u4").tobytes()))
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RAW)


def pack(documents: DataFrame, sequence: int = SEQUENCE, encoder: Callable = word_encoder, end_id: int = END_ID, linear: int = LINEAR, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pack all ``documents`` (doc_id, text) into sequences of at most ``sequence`` tokens, a power of two.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset for each piece.  Every sequence is full
    or has a power of two of tokens.  Null and empty texts are the end id alone; repeated rows are packed each for itself;
    long texts are cut into whole sequences and a rest; an empty table gives no rows; other columns are ignored.
    """
    if sequence & (sequence - 1):
        raise ValueError("sequence must be a power of two")
    spark = documents.sparkSession
    cut = stage_table(cut_documents(documents, sequence, encoder, end_id).withColumn("_piece", F.monotonically_increasing_id()), "balanced")
    counts = np.zeros(sequence + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most one row for each length up to a sequence
        counts[row["length"]] = row["count"]
    short = counts.copy()
    short[sequence] = 0
    deal = spark.sparkContext.broadcast(Deal(short, sequence, linear))
    buckets = max(1, -(-int(counts.sum()) // bucket_rows))
    # ids go along only where a length has pieces to cut
    open_lengths = [int(n) for n in np.flatnonzero(deal.value.left)]
    ids = F.when(F.array_contains(F.lit(open_lengths or [0]), F.col("length")), F.col("ids"))
    rows = cut.withColumn("ids", ids).withColumn("_bucket", F.pmod(F.xxhash64("_piece"), F.lit(buckets)))
    ranks = ranked(rows, ["length"], "_bucket", ["_piece"], "rank").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "rank")

    def run(batches):
        plan = deal.value
        for batch in batches:
            doc, start, crc, tokens = (batch.column(c) for c in ("doc_id", "start", "ids_crc32", "doc_tokens"))
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            sequence_id, offset, lost = np.empty(len(rank), np.int64), np.zeros(len(rank), np.int64), []
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                if n == sequence:
                    sequence_id[at] = plan.sequences + rank[at]
                    continue
                stays = rank[at] < plan.placed[n]
                lost.append(at[~stays])
                if stays.any():
                    sequence_id[at[stays]], offset[at[stays]] = plan.place(n, rank[at[stays]])
            lost = np.concatenate(lost) if lost else np.zeros(0, np.int64)
            keep = pa.array(np.setdiff1d(np.arange(len(rank)), lost))
            whole = [doc, start, pa.array(length), crc, tokens, pa.array(sequence_id), pa.array(offset)]
            yield pa.RecordBatch.from_arrays([c.take(keep) for c in whole], names=names)
            parts = []
            for i in lost.tolist():
                raw, n = batch.column("ids")[i].as_py(), int(length[i])
                raw = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                for before, take, seq, place in plan.cuts(n, int(rank[i])):
                    parts.append((doc[i].as_py(), start[i].as_py() + before, take, zlib.crc32(raw[before : before + take].tobytes()), tokens[i].as_py(), seq, place))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*parts, strict=True)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return ranks.mapInArrow(run, OUT)


def op11_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
