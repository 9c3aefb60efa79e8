"""Alignment of two tokenizers: minimal groups of tokens that cover the same bytes, and how often ids are linked.

Tokens of both vocabularies are the nodes of a bipartite graph, overlaps of their byte ranges its edges.  Union-find
over the edges gives components, which are exactly the minimal groups: between two neighbouring components both
tokenizers end at one byte, and inside a component they never do.  The members of a component are then expanded to links.

Neither vocabulary has a token that goes on across a space or a line end which follows another character.  So a text is
cut there into units that can be aligned each for itself, and a worker aligns a unit once however often it occurs.  Spark counts in how
many documents each pair of ids is linked and joins the counts back to the documents' pairs.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, stage_table
from .encoder import Encoder

#: A pair of ids is one long: the first id above so many bits.
ID_BITS = 20
#: Counts of pairs are broadcast up to so many (two longs each); beyond that both sides of the join are shuffled.
BROADCAST_PAIRS = 2_000_000


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of tokens (a, b) whose bytes overlap, of two tilings of the same bytes given by their ends."""
    low = np.searchsorted(b_ends, np.concatenate(([0], a_ends))[:-1], side="right")
    number = np.searchsorted(b_ends, a_ends, side="left") - low + 1
    a = np.repeat(np.arange(len(a_ends)), number)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(low, number)


def union_find(nodes: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component under the edges (one, two).

    All edges are worked off at once: the larger root of each goes below the smaller one, then paths are halved until
    every node points at a root; as long as an edge joins two roots, the same again.
    """
    root = np.arange(nodes)
    while True:
        a, b = root[one], root[two]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


class Aligner:
    """Aligned units of one Python worker, by their text; at most MOST are kept."""

    MOST = 400_000
    #: a unit ends where a space or a line end follows a character that is no white space
    units = re.compile(r"[ \n]\s*(?:\S+(?:(?![ \n])\s+\S+)*(?:(?![ \n])\s+\Z)?)?")
    #: texts without it are cut before every space and line end
    odd = re.compile(r"^\s|\s\s|[^\S \n]|\0")

    def __init__(self, a_json: str, a_ranks: str, b_model: str):
        import base64

        from sentencepiece import SentencePieceProcessor

        self.a = Encoder(a_json, a_ranks)
        self.a.slow.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_model)
        with open(a_ranks, "rb") as file:
            ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, file)}
        top = self.a.slow.get_vocab_size()
        self.a_bytes = [ranks.get(i) or (self.a.slow.id_to_token(i) or "").encode() for i in range(top)]
        self.b_bytes = [self.piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        self.written = [[f"{i}{sign}" for i in range(max(top, len(self.b_bytes)))] for sign in (",", "|", ";", "")]
        self.clear()

    @staticmethod
    def piece_bytes(piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.names: list[bytes] = []  # groups as text
        self.sizes = array("q")  # tokens of a, tokens of b, groups and links of each unit; -1 where the bytes differ
        self.pairs = array("q")  # of all units, one after another
        self.ends = array("q", [0])

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        if self.odd.search(text):
            return self.units.findall(f" {text}")
        return f" {text}".replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]

    def first_ids(self, units: list[str], number: int) -> list[int]:
        """Ids of the first tokenizer for all units, one after another; the first ``number`` are plain and end in no white space."""
        ids = self.a.fast.encode_ordinary("".join(units[:number]))
        for unit in units[number:]:
            ids.extend(self.a.ids(unit))
        return ids

    def second_ids(self, units: list[str]) -> list[list[int]]:
        """Ids of the second tokenizer for each unit.

        It puts a space before what it gets: that stands for the space of a unit, or is taken off again.
        """
        ids = self.b.encode([u[u[0] == " " :] or "x" for u in units], num_threads=1)
        return [[self.space] if u == " " else i if u[0] == " " else i[1:] for u, i in zip(units, ids, strict=True)]

    def learn(self, units: list[str]) -> None:
        """Align units that are not known yet."""
        plain = [not self.a.other.search(u) and not u[-1].isspace() for u in units]
        units = [u for u, p in zip(units, plain, strict=True) if p] + [u for u, p in zip(units, plain, strict=True) if not p]
        self.known.update(zip(units, range(len(self.names), len(self.names) + len(units)), strict=True))
        raw = [u.encode() for u in units]
        b_lists = self.second_ids(units)
        good = np.array([b"".join(map(self.b_bytes.__getitem__, b)) == r for b, r in zip(b_lists, raw, strict=True)])
        a, size = np.array(self.first_ids(units, sum(plain)), np.int64), np.array(list(map(len, raw)))
        # the tokens of units that both tokenizers give back, and the bytes at which they end
        a_unit = np.searchsorted(np.cumsum(size), np.cumsum(self.a_size[a]), side="left")
        a, a_unit = a[good[a_unit]], a_unit[good[a_unit]]
        b = np.fromiter(chain.from_iterable(x for x, g in zip(b_lists, good, strict=True) if g), np.int64)
        b_unit = np.repeat(np.flatnonzero(good), [len(x) for x, g in zip(b_lists, good, strict=True) if g])
        one, two = overlaps(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
        root = union_find(len(a) + len(b), one, two + len(a))
        # a component's smallest node is a token of the first tokenizer, so components are numbered by place
        component = (np.cumsum(root[: len(a)] == np.arange(len(a))) - 1)[root]
        totals = [np.bincount(x, minlength=len(units)) for x in (a_unit, b_unit, a_unit[root[: len(a)] == np.arange(len(a))], a_unit[one])]
        # tokens by component, those of the first tokenizer before those of the second, each with the sign that follows it
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(component * 2 + side, kind="stable")
        side, component, ids, unit = side[order], component[order], np.concatenate((a, b))[order], np.concatenate((a_unit, b_unit))[order]
        follows = np.where(component[1:] != component[:-1], 2, side[1:] != side[:-1])
        follows = np.append(np.where(unit[1:] != unit[:-1], 3, follows), 3)[: len(ids)]
        words = [self.written[f][i] for f, i in zip(follows.tolist(), ids.tolist(), strict=True)]
        ends = np.cumsum(totals[0] + totals[1]).tolist()
        self.names.extend("".join(words[i:j]).encode() for i, j in zip([0, *ends], ends, strict=False))
        self.sizes.frombytes(np.where(good[:, None], np.stack(totals, axis=1), -1).astype(np.int64).tobytes())
        self.ends.frombytes((len(self.pairs) + np.cumsum(totals[3])).astype(np.int64).tobytes())
        self.pairs.frombytes((a[one] << ID_BITS | b[two]).tobytes())

    def align(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of the units of each text that is not empty; a space is put before it."""
        if len(self.known) > self.MOST:
            self.clear()
        split = list(map(self.split, texts))
        new = list(set(chain.from_iterable(split)) - self.known.keys())
        if new:
            self.learn(new)
        return [np.fromiter(map(self.known.__getitem__, s), np.int64, len(s)) for s in split]


_aligners: dict[tuple, Aligner] = {}


def default_aligner() -> Aligner:
    """One for each Python worker, whose units are kept from task to task."""
    import public_tokenizers

    paths = tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


def summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and the sum of the weights of each."""
    order = np.argsort(key)
    key, total = key[order], np.cumsum(weight[order])
    last = np.flatnonzero(np.append(key[1:] != key[:-1], len(key) > 0))
    return key[last], np.diff(total[last], prepend=0)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def align(documents: DataFrame, aligner=default_aligner) -> DataFrame:
    """Every row of ``documents`` (doc_id, text) with its counts, the hash of its groups, and its linked pairs of ids with how
    often each is linked (0 tokens and no pairs where the text has none or either tokenizer does not give back its bytes)."""

    def run(batches):
        tool = aligner()
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                found = tool.align(batch.column("text").to_pylist())
                sizes, ends, links = (np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in (tool.sizes, tool.ends, tool.pairs))
                sizes = sizes.reshape(-1, 4)
                totals, hashes, doc_of, unit_of = [], [], [], []
                for k, units in enumerate(found):
                    mine = sizes[units]
                    if len(units) == 0 or (mine[:, 3] < 0).any():
                        totals.append((0, 0, 0, 0))
                        hashes.append("")
                        continue
                    totals.append(mine.sum(axis=0))
                    hashes.append(hashlib.sha256(b";".join(map(tool.names.__getitem__, units.tolist()))).hexdigest())
                    doc_of.append(np.full(len(units), k))
                    unit_of.append(units)
                doc, unit = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc_of, unit_of))
                # a unit of a document once, with how often it stands there; then its pairs once for each document
                key, times = summed(doc * (len(sizes) + 1) + unit, np.ones(len(unit), np.int64))
                doc, unit = np.divmod(key, len(sizes) + 1)
                number = ends[unit + 1] - ends[unit]
                at = np.repeat(ends[unit] - np.cumsum(number) + number, number) + np.arange(int(number.sum()))
                names, place = np.unique(links[at], return_inverse=True)
                key, times = summed(np.repeat(doc, number) * (len(names) + 1) + place, np.repeat(times, number))
                doc, place = np.divmod(key, len(names) + 1)
                lists = pa.array(np.searchsorted(doc, np.arange(len(found) + 1)).astype(np.int32))
                totals = np.array(totals, np.int64).reshape(-1, 4)
                del sizes, ends, links  # the arrays below them can grow again
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(totals[:, c]) for c in range(4)), pa.array(hashes, pa.string()), pa.ListArray.from_arrays(lists, pa.array(names[place])), pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32)))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """How many documents hold each pair of ids linked, and whether no other pair of its first id is held by more."""
    counts = stage_table(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pair-counts", n=F.count("*"))
    first = F.shiftright("pair", ID_BITS)
    most = counts.groupBy(first.alias("_a")).agg(F.max("count").alias("_most"))
    out = counts.join(most, first == F.col("_a")).select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))
    out.observed = counts.observed
    return out


def link_counts(documents: DataFrame, aligner=default_aligner, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Align the two tokenizers on every row of ``documents`` (doc_id, text).

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.  Null and empty texts, and those that
    a tokenizer does not give back byte by byte, have zeros and an empty hash.  Repeated rows count each as a document; an
    empty table gives no rows; other columns are ignored.
    """
    aligned = stage_table(align(documents, aligner).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(aligned)
    side = F.broadcast(counts) if counts.observed["n"] <= broadcast_pairs else counts.hint("merge")
    links = aligned.select("_row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    totals = links.join(side, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    rows = aligned.select("_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(totals, "_row", "left")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
