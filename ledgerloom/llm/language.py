"""Language identification by prediction by partial matching.

For each language a context tree of orders 0 to ``ORDER`` counts which byte follows which context.  The statistics are
then frozen: a byte costs the code length of its symbol in the longest context that has seen it, and each longer
context on the way costs an escape (method C: distinct symbols against all).  A text goes to the language that codes it
in the fewest bits.  Bytes the training text never shows share one symbol; a context no tree has costs nothing.

Spark counts the byte strings of a sample of labelled rows, whole texts; only the counts come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, pieces, utf8

ORDER = 4
#: Bound of the labelled sample: rows expected for each language.
SAMPLE_TEXTS = 400
#: Code lengths are held in 1/256 bit, so that sums are exact whatever the partitioning.
SCALE = 256
UNDETERMINED = "und"
LETTER = r"\p{L}"


def whole_bits(cost: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(cost * SCALE), 32767).astype(np.int16)


def grams(raw: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """The strings of k bytes of each text, as numbers; none crosses two texts."""
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for i in range(k):
        out = (out << 8) | raw[i : i + n]
    inside = np.ones(n, bool)
    for cut in offsets[1:-1].tolist():
        inside[max(0, cut - k + 1) : cut] = False
    return out[inside]


def gram_counts(batch: pa.RecordBatch, language: np.ndarray, order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Language, length, strings and their counts of a batch of texts."""
    for j in np.unique(language).tolist():
        raw, offsets = utf8(batch.column("text").filter(pa.array(language == j)))
        for k in range(1, order + 2):
            yield j, k, *np.unique(grams(FOLD[raw], offsets, k), return_counts=True)


class ContextTrees:
    """Frozen trees of all languages.

    A context of order k is a string of k bytes that some language has; the string with a symbol after it is a context of
    order k + 1.  ``cost[k]`` has the code length of the last byte of each string of k + 1 bytes after the others, in every
    language; ``escape[k]`` has that of leaving a context of order k for the next shorter one.
    """

    def __init__(self, languages: list[str], counts: list[tuple[int, int, np.ndarray, np.ndarray]], order: int = ORDER):
        """``counts``: language number, length of the strings, strings (each once for each language), how often they occur."""
        self.languages, self.order = languages, order
        n = len(languages)
        if not n:
            return
        self.grams = [np.zeros(1, np.int64)] + [np.unique(np.concatenate([g for _, length, g, _ in counts if length == k] or [np.zeros(0, np.int64)])) for k in range(1, order + 2)]
        self.cost, self.escape = [], []
        width = len(self.grams[1]) + 1
        for k in range(order + 1):
            known, longer = self.grams[k], self.grams[k + 1]
            count = np.zeros((len(longer), n))
            for j, length, strings, times in counts:
                if length == k + 1:
                    np.add.at(count, (np.searchsorted(longer, strings), j), times)
            parent = np.searchsorted(known, longer >> 8)
            total, distinct = np.zeros((len(known), n)), np.zeros((len(known), n))
            np.add.at(total, parent, count)
            np.add.at(distinct, parent, count > 0)
            if k == 0:  # a last escape leads to equal chances for all symbols
                bottom = total + distinct + 1
                self.floor = whole_bits(-np.log2((distinct + 1) / bottom / width))[0]
                self.escape.append(np.zeros((1, n), np.int16))
                self.cost.append(np.where(count > 0, whole_bits(-np.log2(np.maximum(count, 1) / bottom)), self.floor))
                continue
            bottom = np.where(total > 0, total + distinct, 1)
            self.escape.append(whole_bits(np.where(total > 0, -np.log2(np.maximum(distinct, 1) / bottom), 0)))
            shorter = np.searchsorted(longer_before := self.grams[k], longer & ((1 << 8 * k) - 1))
            assert len(longer_before) == len(self.cost[k - 1])
            left = self.cost[k - 1][shorter].astype(np.int32) + self.escape[k][parent]
            self.cost.append(np.where(count > 0, whole_bits(-np.log2(np.maximum(count, 1) / bottom[parent])), np.minimum(left, 32767)).astype(np.int16))
        self.index()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("symbol", "child")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        if self.languages:
            self.index()

    def index(self) -> None:
        """``child[k]``: from a context of order k and a symbol to the number of the longer string, its count for none."""
        self.symbol = np.zeros(256, np.int64)
        self.symbol[self.grams[1]] = np.arange(1, len(self.grams[1]) + 1)
        width = len(self.grams[1]) + 1
        self.child = []
        for known, longer in zip(self.grams[:-1], self.grams[1:], strict=True):
            step = np.full((len(known) + 1) * width, len(longer), np.int32)
            step[np.searchsorted(known, longer >> 8) * width + self.symbol[longer & 255]] = np.arange(len(longer))
            self.child.append(step)

    def bits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code length of every text in every language (in 1/SCALE bit), and the texts' bytes."""
        raw, offsets = utf8(column)
        lengths, out = np.diff(offsets), np.zeros((len(offsets) - 1, len(self.languages)), np.int64)
        full = np.flatnonzero(lengths)
        if len(full) == 0 or not self.languages:
            return out, lengths
        width, begins = len(self.grams[1]) + 1, offsets[:-1][full]
        symbols = self.symbol[FOLD[raw]]
        contexts, longer = [np.zeros(len(symbols), np.int32)], []
        for k, child in enumerate(self.child):
            longer.append(child[contexts[k].astype(np.int64) * width + symbols])
            # the context of the next place: this one's with the symbol after it
            following = np.empty_like(contexts[0])
            following[1:] = longer[k][:-1]
            following[begins] = len(self.grams[k + 1])
            contexts.append(following)
        bits, left = np.zeros((len(symbols), len(self.languages)), np.int32), np.arange(len(symbols))
        for k in range(self.order, -1, -1):
            known = contexts[k][left] < len(self.grams[k])
            at, short = left[known], left[~known]
            string = longer[k][at]
            hit = string < len(self.grams[k + 1])
            bits[at[hit]] += self.cost[k][string[hit]]
            at = at[~hit]
            bits[at] += self.escape[k][contexts[k][at]] if k else self.floor
            left = np.concatenate([short, at])
        out[full] = np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
        return out, lengths


def train(documents: DataFrame, order: int = ORDER, texts: int = SAMPLE_TEXTS) -> ContextTrees:
    """Fit the trees on rows of ``documents`` (doc_id, text, lang): every label, about ``texts`` rows of each, whole.

    The rows are drawn by a hash of doc_id; rows without a label or a text take no part.
    """
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30))
    labelled = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", draw.alias("draw"))
    rows = sorted((row["lang"], row["count"]) for row in labelled.groupBy("lang").count().collect())
    languages = [lang for lang, _ in rows]
    if not languages:
        return ContextTrees([], [], order)
    share = F.create_map(*[F.lit(x) for lang, n in rows for x in (lang, int((1 << 30) * min(1.0, texts / n)))])
    number = F.create_map(*[F.lit(x) for j, lang in enumerate(languages) for x in (lang, j)])

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                for j, k, strings, times in gram_counts(batch, np.asarray(batch.column("j")), order):
                    columns = [pa.array(np.full(len(strings), j, np.int32)), pa.array(np.full(len(strings), k, np.int32)), pa.array(strings), pa.array(times.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["j", "k", "gram", "n"])

    sample = labelled.where(F.col("draw") < share[F.col("lang")]).select(number[F.col("lang")].alias("j"), "text")
    found = sample.mapInArrow(run, "j int, k int, gram long, n long").groupBy("j", "k", "gram").agg(F.sum("n").alias("n")).toArrow()
    j, k, gram, n = (found.column(c).to_numpy() for c in ("j", "k", "gram", "n"))
    return ContextTrees(languages, [(a, b, gram[own], n[own]) for a in range(len(languages)) for b in range(1, order + 2) for own in [(j == a) & (k == b)]], order)


FOUND = "lang_pred string, score double, bits_per_byte double"


def identify(documents: DataFrame, model: ContextTrees, keep: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of every whole text of ``documents`` (doc_id, text).

    Returns doc_id, lang_pred, score (the winner's share of the languages' chances for a mean byte, 0 to 1) and
    bits_per_byte (the winner's code length).  Null texts and texts without a letter give ``und`` with score 0, and so
    does a model without languages.  The columns ``keep`` come through as they are, after doc_id.  Equal code lengths go to the first language in alphabetical order.  Repeated rows
    are predicted each for itself; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        trees: ContextTrees = shared.value
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 18):
                bits, sizes = trees.bits(batch.column("text"))
                known = np.asarray(batch.column("known").to_numpy(zero_copy_only=False), bool) & (len(trees.languages) > 0)
                names, score, rate = np.array([*trees.languages, UNDETERMINED], object), np.zeros(len(batch)), np.zeros(len(batch))
                best = np.full(len(batch), len(trees.languages))
                if known.any():
                    best[known] = bits[known].argmin(1)
                    mean = bits[known] / SCALE / np.maximum(sizes[known], 1)[:, None]
                    least = mean.min(1)
                    score[known], rate[known] = 1 / np.exp2(least[:, None] - mean).sum(1), least
                columns = [batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score), pa.array(rate), *(batch.column(c) for c in carried)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "bits_per_byte", *carried])

    known = F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("known")
    # a text that is kept goes to the workers once, as it is what they read
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), known, F.struct(F.lit(0).alias("_none"), *(c for c in keep if c != "text")).alias("kept"))
    carried = ["kept", "text"] if "text" in keep else ["kept"]
    kept = "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema["kept"].dataType) + ">"
    out = rows.mapInArrow(run, f"doc_id long, {FOUND}, kept {kept}" + (", text string" if "text" in keep else ""))
    return out.select("doc_id", *["text" if c == "text" else F.col("kept")[c].alias(c) for c in keep], "lang_pred", "score", "bits_per_byte")


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(documents, train(documents.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
