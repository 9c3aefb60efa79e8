"""Removal of long repeated byte strings with a run-length index.

Spark brings together the places that can hold a repeat; a run-length index finds the repeats among them.

1.  Of every window of ``LENGTH`` bytes the leftmost smallest hash of its ``GRAM``-byte strings is kept as an anchor.
    Equal windows keep the same anchor at the same place, so a repeat needs an anchor that occurs twice: anchors are
    dealt by their hash, and single ones go.
2.  Around each remaining anchor the bytes of all windows that can have chosen it are cut out (a context).  Equal contexts
    of an anchor are merged before they are dealt: all but the earliest are repeats as a whole.  Each window starts in one
    of two halves of the range before its anchor and holds the bytes from there to its shortest reach (a core).  Different
    contexts that share no core with another one go; the rest are dealt by their anchor, those of an anchor that has many
    by their cores, and go to an index.  A core of many contexts is hot: it is not gathered, Spark counts the hashes of
    its windows instead.
3.  The index is the run-compressed Burrows-Wheeler transform of the contexts.  Text positions are sampled where a run
    begins; there the neighbour in suffix order and the length of the match with it are stored.  Between samples both
    follow by counting, so the matching statistics of all positions stream from the samples.  Matches of at least
    ``LENGTH`` bytes chain the occurrences of a window together; all but the earliest are marked.
4.  Marks go back to their documents, where the bytes are cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHash, discard, pieces, signed, sliding_min, stage_table, utf8

LENGTH, GRAM = 100, 32
#: Contexts are gathered up to so many bytes before an index is built over them.
INDEX_BYTES = 1 << 20
PLACE_BITS = 22
#: Copies of the first place of each repeated window in the join with its occurrences.
SALTS = 16
#: The contexts of an anchor that has more are dealt by their cores; those of a core that has more are compared by the
#: hashes of their windows.
HOT_CONTEXTS = 512


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows; windows never cross texts."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.arange(len(raw) - gram + 1)
    hashes = SpanHash(raw).spans(starts, starts + gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_min((hashes & ~low) | starts.astype(np.uint64), length - gram + 1)
    inside = np.zeros(len(least), bool)
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        inside[s : max(s, e - length + 1)] = True
    at = (least[inside] & low).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    return at, hashes[at]


def find_anchors(documents: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                raw, offsets = utf8(batch.column("text"))
                yield from rows(np.asarray(batch.column("doc_id")), raw, offsets)

    def rows(docs, raw, offsets):
        # a text longer than the place bits reach is read in overlapping parts
        reach = (1 << PLACE_BITS) - 1
        if len(raw) > reach:
            raws = [(int(offsets[0]) + s, raw[s : s + reach]) for s in range(0, len(raw) - length + 1, reach - length + 1)]
            for shift, part in raws:
                at, hashes = anchors(part, np.array([0, len(part)]), length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), docs[0])), pa.array((at + shift).astype(np.int32)), pa.array(signed(hashes))], names=["doc_id", "at", "anchor"])
            return
        at, hashes = anchors(raw, offsets, length, gram)
        doc = np.searchsorted(offsets, at, side="right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(docs[doc]), pa.array((at - offsets[doc]).astype(np.int32)), pa.array(signed(hashes))], names=["doc_id", "at", "anchor"])

    return documents.mapInArrow(run, "doc_id long, at int, anchor long")


def repeated(found: DataFrame) -> DataFrame:
    """Rows whose anchor occurs more than once: dealt and sorted by the anchor, then streamed."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, last, known = None, None, False  # a single row of the anchor last seen; whether that anchor has repeated
        for batch in batches:
            anchor = np.asarray(batch.column("anchor"))
            n = len(anchor)
            if n == 0:
                continue
            new = np.concatenate([[last is None or anchor[0] != last], anchor[1:] != anchor[:-1]])
            run_of = np.cumsum(new)
            sizes = np.bincount(run_of, minlength=run_of[-1] + 1)
            keep = sizes[run_of] > 1
            if not new[0]:
                keep[run_of == 0] = True  # it goes on with the anchor of the batch before
                if held is not None:
                    yield held
                known, held = True, None
            elif held is not None:
                held, known = None, False
            tail_single = sizes[run_of[-1]] == 1 and not (run_of[-1] == 0)
            if keep.any():
                yield batch.filter(pa.array(keep))
            if run_of[-1] > 0 or new[0]:
                known = not tail_single if run_of[-1] > 0 else sizes[run_of[-1]] > 1
                held = batch.slice(n - 1, 1) if not known else None
            last = anchor[-1]

    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc_id long, at int, anchor long")


def contexts(documents: DataFrame, places: DataFrame, length: int, gram: int) -> DataFrame:
    """``places`` has doc_id and its places (at, anchor).  The bytes around each anchor that windows holding it can reach: anchor, ctx (their hash), doc_id, lo (where they
    begin), size, bytes, cores (their hashes); only those that hold a window."""
    before, after, half = length - gram, length, (length - gram) // 2

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                raw, offsets = utf8(batch.column("text"))
                lists = batch.column("places")
                flat = lists.flatten()
                sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, int)
                at, anchor = np.asarray(flat.field("at")).astype(np.int64), flat.field("anchor")
                doc = np.repeat(np.arange(len(batch)), sizes)
                lo = np.maximum(at - before, 0)
                hi = np.minimum(at + after, (offsets[1:] - offsets[:-1])[doc])
                keep = hi - lo >= length
                lo, hi, doc, anchor = lo[keep], hi[keep], doc[keep], anchor.filter(pa.array(keep))
                begin, size = offsets[doc] + lo, hi - lo
                spans = SpanHash(raw)
                names, origin, middle = signed(spans.spans(begin, begin + size)), offsets[doc], at[keep]
                # a window that starts up to half a range before the anchor holds the first core, any other the second one
                held, cores = [], []
                for back, ahead in ((0, length - half), (half, gram)):
                    fits = np.flatnonzero((middle - back >= lo) & (middle + ahead <= hi))
                    held.append(fits)
                    cores.append(spans.spans((origin + middle)[fits] - back, (origin + middle)[fits] + ahead) ^ np.asarray(anchor)[fits].view(np.uint64))
                order = np.argsort(np.concatenate(held), kind="stable")
                number = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(held), minlength=len(lo)))]).astype(np.int32)
                cores = pa.ListArray.from_arrays(pa.array(number), pa.array(signed(np.concatenate(cores)[order])))
                ends = np.concatenate([[0], np.cumsum(size)])
                cut = raw[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
                data = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(cut)])
                yield pa.RecordBatch.from_arrays([anchor, pa.array(names), pa.array(np.asarray(batch.column("doc_id"))[doc]), pa.array(lo.astype(np.int32)), pa.array(size.astype(np.int32)), data, cores], names=["anchor", "ctx", "doc_id", "lo", "size", "bytes", "cores"])

    return documents.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(run, "anchor long, ctx long, doc_id long, lo int, size int, bytes binary, cores array<long>")


def merged_contexts(found: DataFrame) -> DataFrame:
    """The different contexts of each anchor, each at its earliest place, and how often it occurs.  A written table."""
    first = F.min(F.struct("doc_id", "lo", "bytes", "cores")).alias("x")
    return stage_table(found.groupBy("anchor", "ctx").agg(first, F.count("*").alias("n")).select("anchor", "ctx", "n", "x.*"), "contexts")


def equal_runs(found: DataFrame, merged: DataFrame) -> DataFrame:
    """Byte runs (doc_id, s, e) that equal an earlier context as a whole."""
    # the commonest context may be a third of all: Spark splits a partition that stands out in a join of two tables
    again = merged.where("n > 1").select("anchor", "ctx", F.col("doc_id").alias("d0"), F.col("lo").alias("l0"))
    rows = found.select("anchor", "ctx", "doc_id", "lo", "size")
    return rows.join(again, ["anchor", "ctx"]).where("doc_id <> d0 or lo <> l0").select("doc_id", F.col("lo").alias("s"), (F.col("lo") + F.col("size")).alias("e"))


def shared_cores(merged: DataFrame, hot_contexts: int) -> DataFrame:
    """The contexts that share a core, a written table: doc_id, lo, bytes, cores (what to deal it by), hot (does it have a hot one?).

    Up to ``hot_contexts`` contexts of an anchor meet by their anchor, those of other anchors by each of their cores.
    """
    each = merged.select("anchor", "ctx", F.explode(F.concat("cores", F.array("anchor"))).alias("core"))
    # a hot core may have a third of all rows: with the counts as a table Spark splits its partition in the join
    counts = stage_table(each.groupBy("core").agg(F.count("*").alias("m")).where("m > 1"), "counts")
    known = each.join(counts, "core")
    own, m = F.col("core") == F.col("anchor"), F.col("m")
    shared = known.groupBy("anchor", "ctx").agg(
        F.collect_set(F.when(~own & (m <= hot_contexts), F.col("core"))).alias("cores"),
        F.count_if(~own).alias("shares"),
        F.max(F.when(own, m > hot_contexts)).alias("many"),
        F.max(~own & (m > hot_contexts)).alias("hot"),
    )
    dealt = shared.where("shares > 0").select("anchor", "ctx", F.when(F.col("many"), F.col("cores")).otherwise(F.array("anchor")).alias("cores"), "hot")
    out = stage_table(merged.select("anchor", "ctx", "doc_id", "lo", "bytes").join(dealt, ["anchor", "ctx"]).drop("anchor", "ctx"), "contexts", hot=F.count_if("hot"))
    discard(counts)
    return out


def window_runs(rows: DataFrame, length: int) -> DataFrame:
    """Byte runs (doc_id, s, e) of all windows of contexts that also start earlier in another one, by counting their hashes."""

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "bytes", 1 << 17):
                sizes = np.asarray(pc.binary_length(batch.column("bytes"))).astype(np.int64)
                raw = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8)
                many = np.maximum(sizes - length + 1, 0)
                which = np.repeat(np.arange(len(batch)), many)
                inner = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                begin = (np.cumsum(sizes) - sizes)[which] + inner
                at = np.asarray(batch.column("lo")).astype(np.int64)[which] + inner
                yield pa.RecordBatch.from_arrays([pa.array(signed(SpanHash(raw).spans(begin, begin + length))), pa.array(np.asarray(batch.column("doc_id"))[which]), pa.array(at.astype(np.int32))], names=["window", "doc_id", "at"])

    # contexts of one text overlap, so a place may come from several of them
    each = rows.mapInArrow(run, "window long, doc_id long, at int").withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int"))
    firsts = each.groupBy("window").agg(F.min(F.struct("doc_id", "at")).alias("x"), F.count("*").alias("n")).where("n > 1")
    salted = firsts.select("window", F.col("x.doc_id").alias("d0"), F.col("x.at").alias("a0"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    later = each.join(salted, ["window", "salt"]).where("doc_id <> d0 or at <> a0")
    # windows that start within ``length`` bytes of each other touch, so all of a block of so many starts are one run
    return later.groupBy("doc_id", F.floor(F.col("at") / length).alias("block")).agg(F.min("at").alias("s"), (F.max("at") + length).alias("e")).drop("block")


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of texts (each ends with a terminator of its own), with sampled runs.

    Only suffixes of ``length`` bytes or more are rows: shorter ones have no match that counts.
    """

    def __init__(self, texts: list[bytes], length: int):
        sizes = np.array([len(t) + 1 for t in texts])
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        n = int(self.ends[-1])
        # bytes are 1 to 256; the terminator of text i counts as smaller than all bytes, and than those of later texts
        symbols = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.ends - 1] = False
        symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        self.symbols, self.text_of = symbols, np.repeat(np.arange(len(texts)), sizes)
        end = self.ends[self.text_of] - 1
        self.long = np.flatnonzero(np.arange(n) + length <= end)
        suffixes = self.sort(symbols, end, int(sizes.max()))
        before = np.where(suffixes > 0, symbols[suffixes - 1], 0)
        # a terminator equals no other symbol, so it is a run of its own
        head = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)])
        self.runs = int(head.sum())
        # the last row of a text has none to its right, and comes in between rows that move on from others
        last = ~np.isin(suffixes + 1, self.long, kind="table") if len(suffixes) else np.zeros(0, bool)
        begins = suffixes[head] - 1
        chosen = np.zeros(n + 1, bool)
        chosen[begins[(begins >= 0) & (symbols[begins] > 0)]] = True
        chosen[suffixes[last]] = True
        chosen[suffixes[1:][last[:-1]]] = True
        rows = np.zeros(n, np.int64)
        rows[suffixes] = np.arange(len(suffixes))
        self.sampled = np.flatnonzero(chosen)
        row = rows[self.sampled]
        self.neighbour = np.where(row > 0, suffixes[row - 1], -1)
        self.match = self.compare(self.sampled, self.neighbour)

    def sort(self, symbols: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
        """The rows in suffix order, by doubling; those that are equal up to their terminators are ordered by their texts."""
        n = len(symbols)
        place = np.arange(n)
        used = np.flatnonzero(np.bincount(symbols, minlength=258))
        code = np.searchsorted(used, np.arange(258)) + 1
        key, have = np.zeros(n, np.int64), 6
        for t in range(have):
            key = key * (len(used) + 2) + np.where(place + t < end, code[symbols[np.minimum(place + t, n - 1)]], 0)
        while have < longest:
            rank = self.ranks(key)
            last = 2 * have >= longest
            at = self.long if last else place
            key = rank[at] * (n + 2) + np.where(at + have < end[at], rank[np.minimum(at + have, n - 1)] + 1, 0)
            have *= 2
        return self.long[self.order(key[self.long] if len(key) == n else key)[0]]

    @staticmethod
    def order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stable order of the keys, and the sorted keys."""
        n = len(key)
        bits = max(1, n.bit_length())
        if n and int(key.max()) < 1 << (63 - bits):  # a key and its place in one number sort faster
            both = np.sort((key << bits) | np.arange(n))
            return both & ((1 << bits) - 1), both >> bits
        at = np.argsort(key, kind="stable")
        return at, key[at]

    @classmethod
    def ranks(cls, key: np.ndarray) -> np.ndarray:
        at, ordered = cls.order(key)
        out = np.empty(len(key), np.int64)
        out[at] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        return out

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b (-1: none)."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(b >= 0)
        n, step = len(self.symbols), 0
        while len(live):
            x, y = np.minimum(a[live] + step, n - 1), np.minimum(b[live] + step, n - 1)
            same = (self.symbols[x] == self.symbols[y]) & (self.symbols[x] > 0)
            live = live[same]
            step += 1
            out[live] = step
        return out

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every row's text position that before it in suffix order and the length of their match.

        From a position to the one left of it both move by one, unless a run begins at its row: so they follow from the
        next sample to the right.
        """
        sample = np.searchsorted(self.sampled, self.long)
        back = self.sampled[sample] - self.long
        return np.where(self.neighbour[sample] >= 0, self.neighbour[sample] - back, -1), self.match[sample] + back


def repeats(texts: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte runs (documents, starts, ends) of the texts covered by windows that also start earlier in another text."""
    index = RunIndex(texts, length)
    at, (neighbour, match) = index.long, index.statistics()
    row = np.zeros(len(index.symbols), np.int64)
    row[at] = np.arange(len(at))
    linked = (match >= length) & (neighbour >= 0)
    head = np.where(linked, row[neighbour], np.arange(len(at)))
    while True:
        further = head[head]
        if (further == head).all():
            break
        head = further
    text = index.text_of[at]
    where = at - index.begins[text] + starts[text]
    names = np.unique(docs, return_inverse=True)[1]
    key = (names[text].astype(np.int64) << 40) | where
    first = np.full(len(match), np.iinfo(np.int64).max)
    in_chain = linked.copy()
    in_chain[head[linked]] = True
    np.minimum.at(first, head[in_chain], key[in_chain])
    gone = np.flatnonzero(in_chain & (key > first[head]))
    new = np.concatenate([[True], np.diff(at[gone]) != 1]) if len(gone) else np.zeros(0, bool)
    begin, end = gone[new], gone[np.concatenate([new[1:], [True]])] if len(gone) else gone
    return docs[text[begin]], where[begin], where[end] + length


def mark(found: DataFrame, length: int, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Byte runs (doc_id, s, e) to remove, from different contexts dealt by their anchor or cores, whole ones share an index."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, size, core = [], 0, None

        def index():
            rows = pa.Table.from_batches(held)
            docs, los = np.asarray(rows.column("doc_id")), np.asarray(rows.column("lo")).astype(np.int64)
            texts = rows.column("bytes").to_pylist()
            doc, s, e = repeats(texts, docs, los, length)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["doc_id", "s", "e"])

        for batch in batches:
            names = np.asarray(batch.column("core"))
            sizes = np.asarray(pc.binary_length(batch.column("bytes"))).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else []
            begin = 0
            for at in [*starts, len(names)]:
                # what is held ends with a core here, unless the batch goes on with the core of the last one
                if at > begin:
                    held.append(batch.slice(begin, at - begin))
                    size += int(sizes[begin:at].sum())
                    begin = at
                if size >= index_bytes and at < len(names) and (at > 0 or names[0] != core):
                    yield index()
                    held, size = [], 0
            core = names[-1] if len(names) else core
        if held:
            yield index()

    dealt = found.select("doc_id", "lo", "bytes", F.explode("cores").alias("core"))
    return dealt.repartition("core").sortWithinPartitions("core").mapInArrow(run, "doc_id long, s int, e int")


def repeated_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """Byte runs (doc_id, s, e; they may overlap) that are covered by strings of ``length`` bytes that also start earlier.

    Earlier: in a smaller doc_id, or before in the same text.  ``documents`` has doc_id (unique) and text.  Whole copies
    of an earlier text are found by their digest and need no index.
    """
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    named = source.select("doc_id", F.octet_length("text").alias("size"), F.unhex(F.sha2("text", 256)).alias("name"))
    firsts = named.groupBy("name").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("name", "first")
    copies = stage_table(named.join(firsts, "name").where("doc_id > first").select("doc_id", F.lit(0).alias("s"), F.col("size").alias("e")), "copies")
    places = repeated(find_anchors(source, length, gram)).join(copies.select("doc_id"), "doc_id", "left_anti")
    grouped = stage_table(places.groupBy("doc_id").agg(F.collect_list(F.struct("at", "anchor")).alias("places")), "places")
    found = stage_table(contexts(source, grouped, length, gram), "occurrences")
    discard(grouped)
    merged = merged_contexts(found)
    whole = stage_table(equal_runs(found, merged), "marks")
    discard(found)
    shared = shared_cores(merged, hot_contexts)
    discard(merged)
    marks = stage_table(mark(shared, length), "marks")
    out = copies.unionByName(marks).unionByName(whole)
    if shared.observed["hot"]:
        out = out.unionByName(stage_table(window_runs(shared.where("hot"), length), "marks"))
    discard(shared)
    return out


def removed(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal runs), kept (the remaining bytes) of every row of ``documents``."""

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                raw, offsets = utf8(batch.column("text"))
                cover = np.zeros(len(raw) + 1, np.int32)
                sizes = np.diff(offsets)
                lists = batch.column("spans")
                flat, bounds = lists.flatten(), np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
                base = np.repeat(offsets[:-1], bounds)
                limit = np.repeat(offsets[1:], bounds)
                np.add.at(cover, np.minimum(np.asarray(flat.field("s")) + base, limit), 1)
                np.add.at(cover, np.minimum(np.asarray(flat.field("e")) + base, limit), -1)
                gone = np.cumsum(cover[:-1]) > 0
                number, spans, kept = [], [], []
                for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = gone[s:e]
                    number.append(int(own.sum()))
                    spans.append(int(np.count_nonzero(own[1:] & ~own[:-1])) + int(own[:1].sum()))
                    kept.append(raw[s:e][~own].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(number, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    grouped = spans.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    whole = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(grouped, "doc_id", "left")
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    return whole.select("doc_id", "text", F.coalesce("spans", none).alias("spans")).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Remove each byte of ``documents`` (doc_id, text) that a repeated string of ``length`` bytes covers.

    Null texts are empty; texts shorter than ``length`` keep all bytes; an empty table gives no rows; other columns are
    ignored.  Rows without a doc_id keep all bytes.  Equal rows of one doc_id count as one text and get equal rows;
    different texts must not share a doc_id.
    """
    return removed(documents, repeated_spans(documents, length, gram))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(documents: list[tuple], length: int = LENGTH) -> dict:
    """Plain definition, for tests."""
    seen, out = set(), {}
    for doc, text in sorted(documents):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            else:
                seen.add(window)
        runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
        out[doc] = len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()
    return out
