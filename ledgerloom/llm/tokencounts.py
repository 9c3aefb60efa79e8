"""Edit-aware token counts.

A text is cut into segments where white space follows another character: no pre-token crosses such a place, whatever
stands before or after it, so the token count of a text is the sum over its segments.  Each document keeps a binary
tree over its segments with the sums of tokens and characters.  An edit re-encodes only the segments it touches and the
one that holds the character before it; the rest of the tree is shared, and sums change on one path.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces
from .encoder import default_encoder

SEGMENT = 192
#: A cut lies between the two characters of a match.
CUT = re.compile(r"\S[ \n]")


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Parts of the text of about ``size`` characters, longer where there is no place to cut."""
    out, start = [], 0
    while len(text) - start > size:
        found = CUT.search(text, start + size - 1)
        if found is None:
            break
        out.append(text[start : found.start() + 1])
        start = found.start() + 1
    out.append(text[start:])
    return [s for s in out if s]


class Node:
    """A segment, or the concatenation of two trees."""

    __slots__ = ("chars", "left", "right", "text", "tokens")

    def __init__(self, text: str | None, tokens: int, left: Node | None = None, right: Node | None = None):
        self.text, self.left, self.right = text, left, right
        self.tokens = tokens if text is not None else left.tokens + right.tokens
        self.chars = len(text) if text is not None else left.chars + right.chars


def join(left: Node | None, right: Node | None) -> Node | None:
    return left if right is None else right if left is None else Node(None, 0, left, right)


def build(leaves: list[Node]) -> Node | None:
    """A balanced tree over the segments."""
    while len(leaves) > 1:
        leaves = [join(leaves[i], leaves[i + 1] if i + 1 < len(leaves) else None) for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else None


def part(node: Node | None, start: int, end: int) -> tuple[Node | None, list[Node], Node | None]:
    """The segments that hold a character of [start, end), and what lies before and after them."""
    if node is None or end <= 0:
        return None, [], node
    if start >= node.chars:
        return node, [], None
    if node.text is not None:
        return None, [node], None
    before, found, after = part(node.left, start, end)
    more_before, more, more_after = part(node.right, start - node.left.chars, end - node.left.chars)
    return join(before, more_before), found + more, join(after, more_after)


def edited(root: Node | None, start: int, end: int, replacement: str, count: Callable[[str], int], size: int) -> tuple[Node | None, int]:
    """The tree after [start, end) is replaced, and how many characters were encoded again."""
    total = root.chars if root else 0
    start = min(max(start, 0), total)
    end = min(max(end, start), total)
    # one character on each side is kept inside the region, so the cuts around the region still hold
    before, touched, after = part(root, max(start - 1, 0), end + 1)
    at = before.chars if before else 0
    old = "".join(n.text for n in touched)
    new = old[: start - at] + replacement + old[end - at :]
    inner = build([Node(s, count(s)) for s in segments(new, size)])
    return join(join(before, inner), after), len(new)


def text_of(root: Node | None) -> str:
    out, stack = [], [root] if root else []
    while stack:
        node = stack.pop()
        if node.text is not None:
            out.append(node.text)
        else:
            stack += [node.right, node.left]
    return "".join(out)


STATE = "array<struct<chars:int,tokens:int>>"


def counted(documents: DataFrame, size: int = SEGMENT, encoder=default_encoder) -> DataFrame:
    """``documents`` (doc_id, text and others) with n_tokens and segments, the leaves of the tree: the state to keep.

    Null and empty texts have no tokens and no segments.
    """
    fields = documents.schema

    def run(batches: Iterator[pa.RecordBatch]):
        ids = encoder().ids
        for whole in batches:
            for batch in pieces(whole, "text"):
                rows = [[(len(s), len(ids(s))) for s in segments(t or "", size)] for t in batch.column("text").to_pylist()]
                kind = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))
                state = pa.array([[{"chars": c, "tokens": n} for c, n in r] for r in rows], kind)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sum(n for _, n in r) for r in rows], pa.int64()), state], names=[*batch.schema.names, "n_tokens", "segments"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return documents.mapInArrow(run, f"{ddl}, n_tokens long, segments {STATE}")


def recounted(states: DataFrame, size: int = SEGMENT, encoder=default_encoder) -> DataFrame:
    """Apply each row's ``edits`` (array of start, end, replacement; in order, places in the text as edited so far).

    ``states`` has doc_id, text, segments and edits.  Returns doc_id, n_tokens (before), n_tokens_after, n_chars_after,
    n_edits, n_encoded (characters encoded again), text_after.  Places beyond the text are moved to its end.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        ids = encoder().ids
        for whole in batches:
            for batch in pieces(whole, "text"):
                rows = []
                for doc, text, state, edits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "segments", "edits")), strict=True):
                    leaves, at = [], 0
                    for s in state or []:
                        leaves.append(Node(text[at : at + s["chars"]], s["tokens"]))
                        at += s["chars"]
                    root = build(leaves)
                    before, again = root.tokens if root else 0, 0
                    for e in edits or []:
                        root, n = edited(root, e["start"], e["end"], e["replacement"] or "", lambda s: len(ids(s)), size)
                        again += n
                    rows.append((doc, before, root.tokens if root else 0, root.chars if root else 0, len(edits or []), again, text_of(root)))
                kinds = (pa.int64(),) * 6 + (pa.string(),)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "n_edits", "n_encoded", "text_after"])

    return states.select("doc_id", "text", "segments", "edits").mapInArrow(run, "doc_id long, n_tokens long, n_tokens_after long, n_chars_after long, n_edits long, n_encoded long, text_after string")


def with_edits(states: DataFrame, edits: DataFrame) -> DataFrame:
    """Attach an edit log (doc_id, seq, start, end, replacement) to the states of its documents."""
    log = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "replacement"))).alias("edits"))
    return states.join(log, "doc_id")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and after three edits drawn from its id: a deletion, an insertion and a replacement."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    place = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.coalesce(F.length("text"), F.lit(0)) + 1).cast("int") for i in range(3)]

    def edit(start, width, replacement):
        return F.struct(start.alias("start"), (start + width).alias("end"), replacement.alias("replacement"))

    drawn = F.array(
        edit(place[0], 40, F.lit("")),
        edit(place[1], 0, F.concat(F.lit(" revision "), F.col("doc_id").cast("string"), F.lit(" "))),
        edit(place[2], 3, F.lit("\n\nÉdité  ")),
    )
    out = recounted(counted(documents).withColumn("edits", drawn))
    return out.select("doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "n_edits", "n_encoded", F.sha2("text_after", 256).alias("text_sha256"))
