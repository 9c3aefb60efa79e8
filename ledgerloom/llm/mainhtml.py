"""Main text of web pages by removing site templates.

Each page is parsed once.  Every element subtree is hashed (tag, text and children), and the page is staged as its text
without elements that are no article by their kind (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments), with the hashes and the places of its subtrees.  Spark counts in how many pages of a host each
hash occurs; subtrees that recur across many pages of the host are its template.  Extraction cuts template subtrees by
their places, inside the article as well as on pages without one, and returns the blocks that are left.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, pieces, settings, stage_table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: An open element of the second kind ends where one of the first begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SENTENCE = frozenset("p h1 h2 h3 h4 h5 h6 figcaption caption summary dt".split())
SCOPES = frozenset("article aside body button div footer form header main nav ol section table td th ul".split())
ARTICLE = frozenset({"article", "main"})
NEVER = frozenset("head script style noscript template nav aside footer form iframe object svg canvas button select textarea datalist dialog menu audio video search title".split())
#: What holds no text of the page, whatever is in it.
HIDDEN = frozenset("head script style noscript template iframe object svg canvas audio video title".split())
#: Names in class, id or role of what is no article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pagination popup promo promotion related replies respond sidebar sidenav share sharing skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: Reader comments are often longer than the article.
READERS = frozenset("comment comments disqus replies respond".split())
#: Words that a name may have besides.
PLAIN = frozenset("area bar block bottom box container content inner left list outer right section site top wrap wrapper".split())
#: A template subtree occurs in so many distinct pages of its host, inside an article in so many.  One that is bare or of
#: less than WORDS words may be a shared sentence: it also occurs in LEAST_SHARE of the pages, or it is not both and
#: occurs in so many (outside, inside).
LEAST_PAGES, INSIDE_PAGES, LEAST_SHARE = 3, 10, 0.3
WORDS, SENTENCE_PAGES, SENTENCE_PAGES_INSIDE = 5, 10, 30
#: A template is sure in this share of the pages; others stay where they are most of a page's text and more than this
#: many characters, as they show a near copy there.
SURE_SHARE, COPY_CHARS = 0.5, 400
#: Lowest bits of a hash: a bare subtree (no block in it), one of WORDS or more.  Levels of a template.
BARE, LONG = 1, 2
OUTSIDE, INSIDE, SURE = 1, 2, 4
#: Stands for a page in the counts.
PAGE = 0
#: Templates of all hosts are broadcast up to this many; beyond it they are joined page by page.
BROADCAST_ROWS, SALTS = 200_000, 16
SPACES = re.compile(r"\s+")


class Element:
    __slots__ = ("children", "names", "tag")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names, self.children = tag, names, []


class Builder(HTMLParser):
    """A tree from markup that may be cut off or wrongly nested."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#page")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK and tag not in ("html", "body", "head"):
            self.leave({"p"}, SCOPES)
        if tag in ENDS:
            self.leave(ENDS[tag], frozenset({"ul", "ol", "dl", "table", "select"}))
        if tag == "body":
            self.leave({"head"}, frozenset())
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        element = Element(tag, names)
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        stop = frozenset() if tag in SCOPES or tag == "html" else SCOPES
        self.leave({tag}, stop)

    def leave(self, tags, stop):
        """Close the nearest open element of these tags, unless one of ``stop`` is nearer."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Element:
    builder = Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def walk_up(root: Element) -> list[Element]:
    """All elements, children before their parents, without recursion."""
    order, stack = [], [root]
    while stack:
        element = stack.pop()
        order.append(element)
        stack.extend(c for c in element.children if isinstance(c, Element))
    return order[::-1]


def subtree_hashes(order: list[Element]) -> dict[int, int]:
    """id(element) to a hash of its tag, text and children, BARE and LONG in its lowest bits; only subtrees that hold text get one.

    ``order`` has all elements, children before their parents.
    """
    out: dict[int, int] = {}
    words: dict[int, int] = {}
    blocks: set[int] = set()
    for element in order:
        parts, full, count = [element.tag], False, 0
        for child in element.children:
            if isinstance(child, str):
                found = child.split()
                if found:
                    parts.append(" ".join(found))
                    full = True
                    count += len(found)
                continue
            if child.tag in BLOCK or id(child) in blocks:
                blocks.add(id(element))
            if id(child) in out:
                parts.append(str(out[id(child)]))
                full = True
                count += words[id(child)]
        if full:
            value = int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
            out[id(element)] = value & ~(BARE | LONG) | (0 if id(element) in blocks else BARE) | (LONG if count >= WORDS else 0)
            words[id(element)] = count
    return out


@lru_cache(maxsize=1 << 14)
def named(token: str, inside: bool) -> bool:
    """Is each word of a class, id or role a name of what is no article, or plain?  In an article, headers are its own."""
    words = set(re.split(r"[^a-z]+", token)) - {""}
    found = words & NAMES
    return bool(found) and words <= NAMES | PLAIN and not (inside and found <= {"header", "masthead"})


def holders(order: list[Element]) -> set[int]:
    """ids of the elements that hold the largest article of the page, or most of its text and are no menu, footer, aside or reader comments."""
    size: dict[int, int] = {}
    parent: dict[int, Element] = {}
    root = order[-1]
    for element in order:
        size[id(element)] = 0 if element.tag in HIDDEN else sum(len("".join(c.split())) if isinstance(c, str) else size[id(c)] for c in element.children)
        parent.update((id(c), element) for c in element.children if isinstance(c, Element))
    out = {id(e) for e in order if 2 * size[id(e)] > size[id(root)] and e.tag not in ("nav", "menu", "footer", "aside") and READERS.isdisjoint(e.names.lower().split())}
    above = max((e for e in order if e.tag in ARTICLE), key=lambda e: size[id(e)], default=None)
    while above is not None:
        out.add(id(above))
        above = parent.get(id(above))
    return out


def unwanted(element: Element, inside: bool, holds: set[int]) -> bool:
    """Is the element no article by its kind?  An article's own header holds its title."""
    if element.tag in HIDDEN:
        return True
    if id(element) in holds:
        return False
    if element.tag in NEVER or (element.tag == "header" and not inside):
        return True
    return bool(element.names) and element.tag not in ("html", "body", *ARTICLE) and any(named(x, inside) for x in element.names.lower().split())


def template_hashes(order: list[Element]) -> dict[int, int]:
    """id(element) to the hash of the subtrees that may be a template: they hold no article and are no part of a sentence."""
    hashes, holds = subtree_hashes(order), set()
    for element in order:
        if element.tag in ARTICLE or any(id(c) in holds for c in element.children if isinstance(c, Element)):
            holds.add(id(element))
    out: dict[int, int] = {}
    # (element, is it within running text)
    stack = [(order[-1], False)]
    while stack:
        element, running = stack.pop()
        if id(element) in hashes and id(element) not in holds and element.tag != "#page" and (element.tag in BLOCK or not running):
            out[id(element)] = hashes[id(element)]
        flows = (running and element.tag not in BLOCK) or element.tag in SENTENCE or any(isinstance(c, str) and c.strip() for c in element.children)
        stack.extend((c, flows) for c in element.children if isinstance(c, Element))
    return out


class Page:
    """The text of a page's article (of the page, where it has none) without unwanted elements, and its subtrees.

    ``text`` has a line end at each begin and end of a block.  ``marks`` has the subtrees in it that may be a template, in
    page order: place of its hash in ``hashes``, first and last place in the text, characters of its markup's text, index of
    the next mark that is not inside it.
    """

    __slots__ = ("hashes", "marks", "text", "whole")

    def __init__(self, html: str | None):
        order = walk_up(parse(html))
        holds, found = holders(order), template_hashes(order)
        size: dict[int, int] = {}
        for element in order:
            size[id(element)] = sum(len(c) if isinstance(c, str) else size[id(c)] for c in element.children)
        self.hashes = sorted({PAGE, *found.values()})
        place = {h: i for i, h in enumerate(self.hashes)}
        self.whole = not any(e.tag in ARTICLE for e in order)
        self.marks: list[list[int]] = []
        out: list[str] = []
        at = 0
        # depth first with an explicit stack: (element or text, inside an article), None where a block ends, or the mark that ends
        stack: list = [(order[-1], self.whole)]
        while stack:
            item = stack.pop()
            if isinstance(item, list):
                item[2], item[4] = at, len(self.marks)
                continue
            node, inside = item or ("\n", True)
            if isinstance(node, str):
                if inside:
                    out.append(SPACES.sub(" ", node) if item else node)
                    at += len(out[-1])
                continue
            if unwanted(node, inside and not self.whole, holds):
                continue
            if inside and id(node) in found:
                self.marks.append([place[found[id(node)]], at, at, size[id(node)], 0])
                stack.append(self.marks[-1])
            if node.tag == "br":
                out.append(" ")
                at += 1
                continue
            if node.tag in BLOCK:
                out.append("\n")
                at += 1
                stack.append(None)
            stack.extend((child, inside or node.tag in ARTICLE) for child in reversed(node.children))
        self.text = "".join(out)


def blocks(text: str) -> str:
    """The lines of a text, white space inside each turned into one space, without empty ones."""
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def cut(text: str, marks, levels: list[int], here: int) -> tuple[str, int]:
    """The blocks without the marked subtrees that are templates at the level ``here``, and how many characters went with templates that are not sure."""
    kept, at, unsure, i = [], 0, 0, 0
    while i < len(marks):
        of, first, last, size, after = marks[i]
        level = levels[of]
        if not level & here:
            i += 1
            continue
        kept.append(text[at:first])
        at, i = last, after
        if not level & SURE:
            unsure += size
    return blocks("".join([*kept, text[at:]])), unsure


def without_templates(text: str, whole: bool, hashes: list[int], marks, template: dict[int, int]) -> str:
    """The text of a page without the host's templates; ``template`` has the levels of the host's hashes."""
    here, levels = OUTSIDE if whole else INSIDE, [template.get(h, 0) for h in hashes]
    out, unsure = cut(text, marks, levels, here)
    if unsure > COPY_CHARS and unsure > len(out):
        out, _ = cut(text, marks, [level if level & SURE else 0 for level in levels], here)
    return out


def main_text(html: str | None, template: dict[int, int]) -> str:
    page = Page(html)
    return without_templates(page.text, page.whole, page.hashes, page.marks, template)


def host_of(url):
    """The host of an address in lower case, without user and port ('' where there is none)."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


MARK = {"of": pa.int32(), "first": pa.int32(), "last": pa.int32(), "size": pa.int32(), "after": pa.int32()}
PARSED = "row long, page_id long, url string, host string, page long, hashes array<long>, text string, whole boolean, marks array<struct<of:int,first:int,last:int,size:int,after:int>>"


def lists(values: list, item) -> pa.ListArray:
    """A list array from the lengths of ``values`` and the array of all their items."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), item)


def parsed_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PARSED; ``page`` is the hash of a page's text without unwanted elements, which copies share."""
    for whole in batches:
        for batch in pieces(whole, "html"):
            found = [Page(h) for h in batch.column("html").to_pylist()]
            own = [int.from_bytes(hashlib.blake2b(blocks(p.text).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for p in found]
            marks = list(zip(*(m for p in found for m in p.marks), strict=True)) or [()] * len(MARK)
            marks = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(marks, MARK.values(), strict=True)], names=list(MARK))
            columns = {name: batch.column(name) for name in ("row", "page_id", "url", "host")}
            columns["page"] = pa.array(own, pa.int64())
            columns["hashes"] = lists([p.hashes for p in found], pa.array([h for p in found for h in p.hashes], pa.int64()))
            columns["text"] = pa.array([p.text for p in found], pa.string())
            columns["whole"] = pa.array([p.whole for p in found], pa.bool_())
            columns["marks"] = lists([p.marks for p in found], marks)
            yield pa.RecordBatch.from_pydict(columns)


def host_templates(parsed: DataFrame, least_pages: int, least_share: float) -> DataFrame:
    """host, hash, level of the subtrees that recur across many distinct pages of their host, as a staged table."""
    each = parsed.select("host", "page", F.explode("hashes").alias("hash")).distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    counts = stage_table(each.where((F.col("n") >= least_pages) | (F.col("hash") == PAGE)), "counts")
    sizes = counts.where(F.col("hash") == PAGE).select("host", F.col("n").alias("pages"))
    n, bare, long = F.col("n"), F.col("hash").bitwiseAND(BARE) != 0, F.col("hash").bitwiseAND(LONG) != 0
    common = n >= F.col("pages") * least_share
    block, some = common | (long & ~bare), long | ~bare
    outside = block | (some & (n >= SENTENCE_PAGES))
    inside = (n >= INSIDE_PAGES) & (block | (some & (n >= SENTENCE_PAGES_INSIDE)))
    level = F.when(outside, OUTSIDE).otherwise(0) + F.when(inside, INSIDE).otherwise(0) + F.when(n >= F.col("pages") * SURE_SHARE, SURE).otherwise(0)
    known = counts.where((F.col("hash") != PAGE) & (F.col("n") >= least_pages)).join(sizes, "host")
    out = stage_table(known.select("host", "hash", level.alias("level")).where(F.col("level").bitwiseAND(OUTSIDE | INSIDE) != 0), "templates")
    discard(counts)
    return out


OUT = "page_id long, url string, text string"


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The main text of every row of ``pages`` (page_id, url, html): page_id, url, text.

    Null and empty html give an empty text.  Pages without a host are one host of their own.  Repeated rows and
    copies count as one page of their host and are extracted each for itself; other columns are ignored.  The parsed pages
    stay in the shared folder, as the result is read from them.
    """
    source = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    with settings(pages.sparkSession, spark__sql__parquet__compression__codec="zstd"):
        parsed = stage_table(source.mapInArrow(parsed_pages, PARSED), "pages")
    templates = host_templates(parsed, least_pages, least_share)
    need = ["page_id", "url", "text", "whole", "hashes", "marks"]
    if templates.count() <= broadcast_rows:
        by_host = defaultdict(dict)
        for row in templates.toLocalIterator():
            by_host[row["host"]][row["hash"]] = row["level"]
        discard(templates)
        shared = parsed.sparkSession.sparkContext.broadcast(dict(by_host))
        return parsed.select("host", *need).mapInArrow(lambda batches: texts(batches, lambda batch: [shared.value.get(h, {}) for h in batch.column("host").to_pylist()]), OUT)
    # a host may have a third of all pages, so its templates are repeated and its pages dealt over the copies; each row is
    # joined by a key of its own, as ids may be null or repeat
    salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = parsed.select("row", "host", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.array_distinct(F.transform("marks.of", lambda i: F.get("hashes", i)))).alias("hash"))
    found = own.join(salted, ["host", "hash", "salt"]).groupBy("row").agg(F.collect_list(F.struct("hash", "level")).alias("template"))
    joined = parsed.select("row", *need).join(found, "row", "left")
    return joined.mapInArrow(lambda batches: texts(batches, lambda batch: [{e["hash"]: e["level"] for e in x or ()} for x in batch.column("template").to_pylist()]), OUT)


def texts(batches: Iterator[pa.RecordBatch], templates) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            each = batch.column("marks")
            flat = list(zip(*(x.to_pylist() for x in each.flatten().flatten()), strict=True))
            ends = np.cumsum([0, *each.value_lengths().to_pylist()]).tolist()
            marks = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            rows = zip(batch.column("text").to_pylist(), batch.column("whole").to_pylist(), batch.column("hashes").to_pylist(), marks, templates(batch), strict=True)
            out = [without_templates(*row) for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
