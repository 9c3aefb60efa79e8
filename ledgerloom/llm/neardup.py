"""Near-duplicate classes by a chosen-path set similarity join.

Documents are sets of word shingles.  Each of several independent trees starts with all documents in one node.  A node
branches by a few minwise tokens that its name draws: every document goes to one child for each of them, so two documents
meet in a child with a chance equal to their Jaccard similarity.  A node with few documents is compared exhaustively;
every larger one branches again by tokens of its own.  The trees repeat until the chance to miss a pair at the threshold
is negligible.

Equal sets are one representative from the start.  A first look at the trees holds every document of a larger node
against a few pivots, and the links to the nearest ones make classes.  A node whose documents are one class needs no more
comparisons, and one where few documents stand outside its largest class compares only those with the rest.  So does one
that branching hardly makes smaller, as its documents are alike: a child that holds most of its node, or a root whose
documents came near one class in the first look.  Pairs that meet in small nodes are first held against a sketch (all
minwise tokens), then confirmed on the full sets; larger nodes are compared on the full sets, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, BATCHES, FOLD, SpanHash, by_ids, discard, gram_hashes, mix, pieces, settings, signed, sized, stage_table, utf8, word_spans, word_table
from .components import connected_components

#: Bytes between words: space and \x09-\x0D.
IS_WORD = word_table([0x20, *range(0x09, 0x0E)])
SHINGLE, PERCENT = 5, 80
#: Minwise tokens of a sketch, and how many must agree: at similarity 0.8 fewer agree with a chance of 3.4e-6.
SKETCH, AGREE = 48, 25
#: Trees, tokens by which a node branches, and levels.  A pair at 0.8 loses a branching with a chance of 0.04 and a tree
#: of any depth with 0.0625, all trees with 2.4e-10.
TREES, BRANCHES, LEVELS = 8, 2, 8
#: A node with so many documents is compared exhaustively, also one with so many documents outside its largest class.
LEAF = 24
#: A node that holds so large a share of the documents of the node above it is compared as it is.
DENSE = 0.5
#: A root with so large a share of documents whose nearest pivots are of one class is compared as it is.
ALIKE = 0.75
#: Pivots of a larger node.
PIVOTS = 2
#: Larger nodes are compared in blocks of about so many tokens (distinct shingles of their documents, added up).
BLOCK_TOKENS = 500_000
#: Bytes of texts that are hashed at once.
HASHED_BYTES = 1 << 19
#: Copies of each group of equal sets in the join with its documents, which may be a third of all rows.
SALTS = 16


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = utf8(column)
    raw = FOLD[raw]
    starts, ends, first = word_spans(raw, offsets, IS_WORD)
    return SpanHash(raw).spans(starts, ends), first


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted; with fewer words than a shingle has, the whole sequence as one.

    Texts are hashed ``HASHED_BYTES`` at a time: hashing takes some 30 bytes of memory for each, half of which the worker
    keeps (the powers of ``SpanHash``).
    """
    return [own for part in pieces(pa.record_batch([column], names=["text"]), "text", HASHED_BYTES) for own in few_shingle_sets(part.column("text"), k)]


def few_shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    words, first = word_hashes(column)
    grams, bounds, out = gram_hashes(words, k), first.tolist(), []
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        own = grams[s : e - k + 1] if e - s >= k else gram_hashes(words[s:e], e - s) if e > s else grams[:0]
        own = np.sort(own)
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own)
    return out


def factors(n: int) -> np.ndarray:
    return mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def sketches(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), two words that name the set, and its minwise tokens (none for an empty set)."""

    def run(batches):
        odd = factors(SKETCH)
        for whole in batches:
            for batch in pieces(whole, "text", HASHED_BYTES):
                sets = shingle_sets(batch.column("text"), k)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                tokens = np.zeros((len(full), SKETCH), np.uint64)
                names = np.zeros((len(sets), 2), np.uint64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    begins = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for t in range(SKETCH):
                        tokens[:, t] = np.minimum.reduceat(flat * odd[2 * t] + odd[2 * t + 1], begins)
                    names[full, 0] = np.add.reduceat(mix(flat), begins)
                    names[full, 1] = np.bitwise_xor.reduceat(mix(flat ^ np.uint64(BASE)), begins)
                place = np.full(len(sets), -1)
                place[full] = np.arange(len(full))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(place >= 0, SKETCH, 0))]), pa.int32()), pa.array((mix(tokens) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32).ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(signed(names[:, 0].copy())), pa.array(signed(names[:, 1].copy())), lists], names=["doc_id", "n", "d1", "d2", "sketch"])

    return documents.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sketch array<int>")


def can_be_similar(a: str, b: str, percent: int) -> Column:
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def agreeing(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose sketches agree often enough, with the number that agrees."""
    left = reps.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = reps.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    same = F.expr(" + ".join(f"cast(get(sa, {i}) = get(sb, {i}) as int)" for i in range(SKETCH)))
    met = pairs.join(left, "a").join(right, "b").where(can_be_similar("na", "nb", percent))
    return met.select("a", "b", same.alias("same")).where(F.col("same") >= AGREE)


def confirmed(pairs: DataFrame, most: int, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``most`` pairs (a, b) or less whose full sets are similar: 100 x intersection >= percent x union."""

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for batch in pieces(whole, "text_a", HASHED_BYTES):
                sets_a, sets_b = shingle_sets(batch.column("text_a"), k), shingle_sets(batch.column("text_b"), k)
                common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(sets_a, sets_b, strict=True)]
                keep = [100 * c >= percent * (len(x) + len(y) - c) for c, x, y in zip(common, sets_a, sets_b, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    held = by_ids(texts, ids, "doc_id", 2 * most, "left_semi").dropDuplicates(["doc_id"])
    whole = pairs.select("a", "b").join(held.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    whole = whole.join(held.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return whole.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def roots(reps: DataFrame, *columns: str) -> DataFrame:
    """The children of the roots: one row for each document, tree and token of the tree's root."""
    nodes = ", ".join(f"xxhash64({t}, get(sketch, {t}))" for t in range(TREES * BRANCHES))
    return reps.select(*columns, F.expr(f"explode(array({nodes}))").alias("node"))


def children(rows: DataFrame, level: int) -> DataFrame:
    """The rows (node, doc_id, n, class, size, sketch) in the children of their nodes; a node's name draws its tokens."""
    first = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(SKETCH)).cast("int")
    step = F.pmod(F.xxhash64("node", F.lit(-1 - level)), F.lit(SKETCH // BRANCHES)).cast("int") + 1
    drawn = [F.pmod(first + i * step, F.lit(SKETCH)) for i in range(BRANCHES)]
    child = F.explode(F.array(*[F.xxhash64("node", F.lit(i), F.get("sketch", t)) for i, t in enumerate(drawn)])).alias("child")
    return rows.select("doc_id", "n", "class", F.col("size").alias("above"), child).withColumnRenamed("child", "node")


def stars(nodes: DataFrame, percent: int) -> DataFrame:
    """Each document of a larger node with the node's pivots, which are drawn by hashes."""
    drawn = [F.min(F.struct(F.xxhash64("doc_id", "node", F.lit(i)), F.col("doc_id").alias("pivot"), F.col("n").alias("pivot_n"))) for i in range(PIVOTS)]
    pivots = nodes.groupBy("node").agg(F.array(*drawn).alias("p"), F.count("*").alias("size")).where("size > 4")
    pivots = pivots.select("node", F.explode(F.array_distinct(F.transform("p", lambda p: F.struct(p["pivot"], p["pivot_n"])))).alias("p")).select("node", "p.*")
    met = nodes.join(pivots, "node").where((F.col("doc_id") != F.col("pivot")) & can_be_similar("n", "pivot_n", percent))
    return met.select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()


def undecided(rows: DataFrame) -> DataFrame:
    """Rows (node, doc_id, n, class, above) of nodes that hold documents of more than one class, with the node's size and
    tokens, its largest class, and those outside it."""
    each = rows.groupBy("node", "class").agg(F.count("*").alias("c"), F.sum("n").alias("t"), F.max("above").alias("above"))
    largest = F.max(F.struct("c", "t", F.col("class").alias("top"))).alias("m")
    mixed = each.groupBy("node").agg(F.sum("c").alias("size"), F.sum("t").alias("tokens"), F.max("above").alias("above"), largest, F.count("*").alias("classes")).where("classes > 1")
    outside = [(F.col("size") - F.col("m.c")).alias("outsiders"), (F.col("tokens") - F.col("m.t")).alias("out_tokens")]
    return rows.drop("above").join(mixed.select("node", "size", "tokens", "above", "m.top", *outside), "node")


def exhaustive(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of documents of different classes within a node: of every such two one lies outside the largest class."""
    out = nodes.where("class <> top").select("node", F.col("doc_id").alias("d2"), F.col("n").alias("n2"), F.col("class").alias("c2"))
    once = (F.col("class") == F.col("top")) | (F.col("doc_id") < F.col("d2"))
    met = nodes.join(out, "node").where((F.col("class") != F.col("c2")) & once & can_be_similar("n", "n2", percent))
    return met.select(*ordered("doc_id", "d2"))


def in_blocks(nodes: DataFrame) -> DataFrame:
    """Larger nodes as groups of bounded size: each block of all documents with each block of the outsiders."""
    def own(n):
        return F.pmod(F.xxhash64("doc_id", "node"), n).cast("int")

    blocks, out = F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int"), F.ceil(F.col("out_tokens") / BLOCK_TOKENS).cast("int")
    every = nodes.select("*", own(blocks).alias("i"), F.explode(F.sequence(F.lit(0), out - 1)).alias("o"), F.lit(False).alias("outside"))
    outsiders = nodes.where("class <> top").select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"), own(out).alias("o"), F.lit(True).alias("outside"))
    return every.unionByName(outsiders).select(F.xxhash64("node", "i", "o").alias("node"), "doc_id", "class", "outside")


def links_between(base: list[np.ndarray], base_class: np.ndarray, sets: list[np.ndarray], set_class: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (of ``base``, of ``sets``) between similar sets of different classes, as few as join all that can be joined."""
    names = np.unique(np.concatenate([base_class, set_class]), return_inverse=True)[1]
    root, own_root = names[: len(base)], names[len(base) :]
    sizes = np.array([len(s) for s in base])
    flat = np.concatenate(base)
    order = np.argsort(flat, kind="stable")
    tokens, holders, out = flat[order], np.repeat(np.arange(len(base)), sizes)[order], []
    for j, own in enumerate(sets):
        low, high = np.searchsorted(tokens, own), np.searchsorted(tokens, own, side="right")
        common = np.bincount(np.concatenate([holders[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]), minlength=len(base))
        for i in np.flatnonzero((root != own_root[j]) & (100 * common >= percent * (sizes + len(own) - common))).tolist():
            if root[i] != own_root[j]:
                out.append((i, j))
                old, new = root[i], own_root[j]
                root[root == old], own_root[own_root == old] = new, new
    return out


def compare_groups(groups: DataFrame, number: int, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) within the ``number`` rows of ``in_blocks``, each group compared on the full sets in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, base = rows[rows["outside"]], rows[~rows["outside"]]
        links = []
        if len(out) and len(base):
            sets = [shingle_sets(pa.array(x["text"], pa.large_string()), k) for x in (base, out)]
            links = links_between(sets[0], base["class"].to_numpy(), sets[1], out["class"].to_numpy(), percent)
        a, b = base["doc_id"].to_numpy(), out["doc_id"].to_numpy()
        return pd.DataFrame([(min(a[i], b[j]), max(a[i], b[j])) for i, j in links], columns=["a", "b"]).astype("int64")

    held = by_ids(texts, groups.select("doc_id").distinct(), "doc_id", number, "left_semi").dropDuplicates(["doc_id"])
    # a document meets its text once and goes to its groups from there
    at = groups.groupBy("doc_id").agg(F.collect_list(F.struct("node", "class", "outside")).alias("at"))
    whole = at.join(held, "doc_id").select("doc_id", "text", F.inline("at"))
    return whole.groupBy("node").applyInPandas(run, "a long, b long").distinct()


def alike(nodes: DataFrame, kin: DataFrame, number: int) -> DataFrame:
    """The names of nodes most of whose documents have one kin; ``kin`` (doc_id, kin) has ``number`` rows at most, and a
    document without one is its class."""
    held = nodes.select("node", "doc_id", "class").join(sized(kin, number), "doc_id", "left")
    each = held.groupBy("node", F.coalesce("kin", "class").alias("kin")).agg(F.count("*").alias("c"))
    return each.groupBy("node").agg(F.max("c").alias("c"), F.sum("c").alias("size")).where(F.col("c") >= F.col("size") * ALIKE).select("node")


def branched(placed: DataFrame, levels: int = LEVELS, kin: DataFrame | None = None, number: int = 0) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Nodes in which documents are compared, small ones and larger ones; and the tables they are read from.

    ``placed`` has doc_id, n, class and sketch.  A node above the leaf size branches, unless few of its documents stand
    outside its largest class or it holds most of the node above; what the last level leaves is compared as it is.  No
    node is above a root: it does not branch if its documents are ``alike`` by the ``number`` rows of ``kin``.
    """
    small, final = F.col("size") <= LEAF, (F.col("outsiders") <= LEAF) | (F.col("size") >= F.col("above") * DENSE)
    counts = {"open": F.count(F.when(~small & ~final, 1)), "larger": F.count(F.when(~small, 1))}
    root = roots(placed, "doc_id", "n", "class").withColumn("above", F.lit(1 << 60))
    nodes = stage_table(undecided(root), "nodes", **counts)
    tables, names, whole = [nodes], [], []
    for level in range(levels):
        if not nodes.observed["open"]:
            break
        opened = nodes.where(~small & ~final)
        if kin is not None and not level:
            name = stage_table(alike(opened, kin, number), "alike", n=F.count("*"))
            names, whole = [name], [by_ids(opened, name, "node", name.observed["n"], "left_semi")]
            opened = by_ids(opened, name, "node", name.observed["n"], "left_anti")
        # a document meets its sketch once, however many of its nodes branch
        at = opened.groupBy("doc_id").agg(F.collect_list(F.struct("node", "size")).alias("at"))
        below = at.join(placed, "doc_id").select("doc_id", "n", "class", "sketch", F.inline("at"))
        # written, as the counts of the nodes and their rows would each join and branch again
        rows = stage_table(children(below, level), "children")
        nodes = stage_table(undecided(rows), "nodes", **counts)
        discard(rows)
        tables.append(nodes)

    def read(parts):  # one scan of all: a union would plan every table for itself
        return nodes.sparkSession.read.schema(nodes.schema).parquet(*[t.staged for t in parts])

    larger = nodes.where(~small)
    if tables[:-1]:
        larger = larger.unionByName(read(tables[:-1]).where(~small & final))
    for rows in whole:
        larger = larger.unionByName(rows.select(larger.columns))
    return read(tables).where(small), larger, tables + names


class Classes:
    """doc_id, class of the documents that have a link, from a growing set of links."""

    def __init__(self):
        self.table, self.most = None, 0

    def add(self, links: DataFrame, number: int) -> None:
        """Join the classes that ``number`` links (a, b) at most link."""
        if self.table is not None:  # the classes so far stand for the links that made them
            links = links.unionByName(self.table.where("doc_id <> class").select(F.col("doc_id").alias("a"), F.col("class").alias("b")))
        self.most += 2 * number
        self.table = connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("class"))

    def of(self, rows: DataFrame, key: str = "doc_id", name: str = "class") -> DataFrame:
        found = self.table.select(F.col("doc_id").alias(key), F.col("class").alias(name))
        return rows.join(sized(found, self.most), key, "left").withColumn(name, F.coalesce(name, key))


def linked_classes(reps: DataFrame, texts: DataFrame, k: int, percent: int, levels: int = LEVELS) -> Classes:
    """Classes of the representatives that are similar to another one, directly or over others."""
    classes, count = Classes(), {"n": F.count("*")}
    near = agreeing(stars(roots(reps, "doc_id", "n"), percent), reps, percent).groupBy("a").agg(F.max(F.struct("same", "b"))["b"].alias("b"))
    near = stage_table(near, "near", **count)
    pairs = stage_table(near.select(*ordered("a", "b")).distinct(), "pairs", **count)
    links = stage_table(confirmed(pairs, pairs.observed["n"], texts, k, percent), "links", **count)
    classes.add(links, links.observed["n"])
    placed = stage_table(classes.of(reps), "placed")
    kin = classes.of(near, "b", "kin").select(F.col("a").alias("doc_id"), "kin")
    small, larger, tables = branched(placed, levels, kin, near.observed["n"])
    rest = stage_table(agreeing(exhaustive(small, percent).distinct(), reps, percent), "pairs", **count)
    links = confirmed(rest, rest.observed["n"], texts, k, percent)
    number = sum(t.observed.get("larger", 0) for t in tables)
    if number:
        groups = stage_table(in_blocks(larger), "groups")
        tables.append(groups)
        links = links.unionByName(compare_groups(groups, number, texts, k, percent))
    links = stage_table(links, "links", **count)
    if links.observed["n"]:
        classes.add(links, links.observed["n"])
    discard(near, pairs, rest, placed, *tables)
    return classes


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, levels: int = LEVELS) -> DataFrame:
    """Near-duplicate classes of ``documents`` (doc_id, text) at a Jaccard similarity of ``percent`` / 100 or more.

    Returns doc_id, n_shingles, component_id (the smallest doc_id of the class) and kept (doc_id = component_id).
    Words are runs of bytes other than white space, A-Z in lower case.  Null and empty texts and texts without words
    have an empty set and stand alone; equal sets are one class whatever their size; other columns are ignored.
    Repeated rows of one doc_id with equal texts get equal rows; different texts must not share a doc_id.  Rows without a
    doc_id are linked with nothing: component_id and kept are null.
    """
    spark = documents.sparkSession
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", **BATCHES):
        sets = stage_table(sketches(source, shingle), "sketches")
        full, name = sets.where("n > 0 and doc_id is not null"), ["d1", "d2", "n"]
        groups = stage_table(full.groupBy(*name).agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.count("*").alias("size")), "groups")
        classes = linked_classes(groups.select("doc_id", "n", "sketch"), source.where("doc_id is not null"), shingle, percent, levels)
        # only groups of several rows and those of a class need a join with their documents
        named = classes.of(groups.select(*name, "size", "doc_id")).where("size > 1 or class <> doc_id")
        named = named.select(*name, "class", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = sets.where("n > 0 and doc_id is not null").select("doc_id", *name, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
        found = salted.join(named, [*name, "salt"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class", "doc_id").alias("component_id"))
        alone = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return stage_table(found.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id")), "classes")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=4)


def brute_force(documents: list[tuple], k: int, percent: int = PERCENT) -> dict:
    """Plain definition, for tests: doc_id to (set size, component)."""
    import re
    from collections import defaultdict

    sets = {}
    for doc, text in documents:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
    holders = defaultdict(list)
    for doc in sorted(sets):
        for shingle in sets[doc]:
            holders[shingle].append(doc)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for doc in sorted(sets):
        common = defaultdict(int)
        for shingle in sets[doc]:
            for other in holders[shingle]:
                if other < doc:
                    common[other] += 1
        for other, c in common.items():
            if 100 * c >= percent * (len(sets[doc]) + len(sets[other]) - c):
                a, b = root(doc), root(other)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}
