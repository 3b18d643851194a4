"""Problem 1: the main body of web pages.

Composite text density: every DOM node gets its link-adjusted characters per tag, a node's
density sum is the sum over its children, and the subtree with the largest sum is the body.
Nested boxes that are sparser than the threshold taken from the path to ``body`` are left
out.  What the sites themselves repeat (bylines, share prompts, legal notices, labels of
related-document boxes) is known by counting every block over the distinct pages of its source,
inside and outside the chosen subtrees: a block that stands outside bodies on a share of a
source's pages is no body text inside one.  The share does not move with the number of pages, so
a title that recurs as a teaser never gets there.  A block of one source is left out in the others
too where most places it stands in, over all sources, agree (copied legal notices).
A box opened by such a label ends with the last block that looks like its items.

Lines of plain text pages are judged by the same counts.

Defined results: NULL, empty and other formats give no rows; a page whose body holds no text
gives no rows; a page delivered twice counts once and gives its rows once per delivery
(queries take distinct rows); extra columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bit_filter, hash64, may_contain, md5, sliced, written  # noqa: F401 - tests set BROADCAST_ROWS
from .hashing import mix

INLINE = frozenset("a b strong em i span sup sub u".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LISTED = frozenset("ul ol dl table tbody thead tfoot tr td th pre blockquote".split())
MIN_SUM = 40.0  # density sum a page must reach to have a body at all
LEAST_OUTSIDE = 3  # pages of a source a block must stand on outside bodies to count as the site's own
PAGE_SHARE = 0.03  # their share of all the source's html pages
OUTSIDE_SHARE = 0.25  # and of all pages the block stands on
LABEL_CHARS = 40  # longest label of a related-document box
_HIDDEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript)\b.*?(?:</\1\s*>|$)", re.S | re.I)
_BLANKS = re.compile(r"[ \t\n\r\xa0]+")
_ODD_BLANK = re.compile(r"[\t\n\r\xa0]|  ")
_DIGITS = re.compile(r"[0-9]+")
_MARK = re.compile(r"^(?:[-*•·–—] )")
_SENTENCE_END = tuple(".!?।;:…")


class Node:
    __slots__ = ("chars", "children", "density", "inner", "link_chars", "link_tags", "own", "parent", "sig", "tag", "tags", "texts")

    def __init__(self, tag, parent, sig=""):
        self.tag, self.parent, self.sig = tag, parent, sig
        self.chars = self.tags = self.link_chars = self.link_tags = self.texts = self.own = 0
        self.children = []
        self.inner = False


def collapse(text: str) -> str:
    return _BLANKS.sub(" ", text).strip(" ") if _ODD_BLANK.search(text) else text.strip(" ")


def read_html(html: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """All nodes from body down in document order (parents first), and the visible blocks with their nodes."""
    if "<!--" in html or "<s" in html or "<S" in html or "<n" in html or "<N" in html:
        html = _HIDDEN.sub("", html)
    pieces = html.split("<")
    has_body = "<body" in html or "<BODY" in html or re.search("<body", html, re.I)
    in_body, skip = not has_body, False
    root = node = Node("body", None)
    nodes, blocks, parts = [root], [], []
    links = link_chars = 0
    if in_body and pieces[0]:
        parts.append(pieces[0])

    def flush():
        nonlocal parts, link_chars
        text = "".join(parts) if len(parts) > 1 else parts[0]
        if "&" in text:
            text = unescape(text)
        text = collapse(text)
        if text:
            blocks.append((node, text))
            n = len(text)
            node.chars += n
            node.own += n
            node.texts += 1
            node.link_chars += min(link_chars, n)
        parts, link_chars = [], 0

    for piece in pieces[1:]:
        head, closed, text = piece.partition(">")
        name = head.split(None, 1)[0].lower() if head and not head[0].isspace() else ""
        closing = name[:1] == "/"
        tag = name[1:] if closing else name.rstrip("/")
        if not closed or not (tag[:1].isalpha() or tag[:1] in ("!", "?")):
            text, tag = "<" + piece, None
        if tag is not None and tag[:1] not in ("!", "?"):
            if tag == "body":
                if parts:
                    flush()
                in_body = not closing
            elif tag == "head" or tag == "title":
                skip = not closing
            elif in_body and tag != "html":
                if tag in INLINE:
                    if tag == "a":
                        links = max(0, links + (-1 if closing else 1))
                        node.link_tags += not closing
                    node.tags += not closing
                else:
                    if parts:
                        flush()
                    if closing:
                        up = node
                        while up is not root and up.tag != tag:
                            up = up.parent
                        if up is not root:
                            node = up.parent
                        links = 0
                    elif tag in VOID:
                        node.tags += 1
                    else:
                        if tag in ("p", "li") and node.tag == tag:
                            node = node.parent
                        child = Node(tag, node, head)
                        node.children.append(child)
                        nodes.append(child)
                        node = child
        if text and in_body and not skip:
            parts.append(text)
            if links:
                link_chars += len(text)
    if parts:
        flush()
    return nodes, blocks


def composite_density(chars, tags, link_chars, link_tags, ratio) -> float:
    """Characters per tag, damped by the share of link text; ratio is link characters per character of the page."""
    if not chars:
        return 0.0
    tags = tags or 1
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + ratio * chars + math.e)
    x = chars / (link_chars or 1) * tags / (link_tags or 1)
    return chars / tags * (math.log(x) / math.log(base) if x > 1 and base > 1 else 0.01)


def split_page(html: str) -> tuple[list[tuple[str, str]], list[str]]:
    """(blocks inside the densest subtree with their elements, blocks outside it)."""
    nodes, blocks = read_html(html)
    for n in reversed(nodes):  # children come after their parents
        p = n.parent
        if p is not None:
            p.chars += n.chars
            p.tags += n.tags + 1
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags
            p.texts += n.texts
    body = nodes[0]
    ratio = body.link_chars / max(body.chars, 1)
    best, most = None, 0.0
    for n in nodes:
        n.density = composite_density(n.chars, n.tags, n.link_chars, n.link_tags, ratio)
    for n in nodes:
        total = n.density if n.own else 0.0
        for c in n.children:
            total += c.density
        if total > most:
            best, most = n, total
    if best is None or most < MIN_SUM:
        return [], [text for _, text in blocks]
    while best.tag in LISTED and best.tag not in ("td", "th") and best.parent not in (None, body):
        best = best.parent  # a list or table is part of the body that holds it
    limit, up = best.density, best
    while up is not body:
        up = up.parent
        limit = min(limit, up.density)
    best.inner = True
    for n in nodes:
        if n.parent is not None and n.parent.inner:
            boxed = n.tag not in LISTED and len(n.children) > 1 and not n.own and n.chars < 0.5 * best.chars
            n.inner = not (boxed and n.density < limit)
    inside = [(text, n.sig) for n, text in blocks if n.inner]
    return inside, [text for n, text in blocks if not n.inner]


def block_key(text: str) -> int:
    return hash64(_DIGITS.sub("0", text.lower()))


def _pages(batches):
    for batch in batches:
        out = {k: [] for k in ("id", "source_id", "html", "blocks", "sigs", "inside", "outside")}
        for id_, source, fmt, content in zip(*(c.to_pylist() for c in batch.columns)):
            if not content:
                continue
            if fmt == "html":
                found, rest = split_page(content)
                blocks, sigs = [t for t, _ in found], [s for _, s in found]
                inside, outside = {block_key(t) for t in blocks}, {block_key(t) for t in rest}
            else:
                blocks = [t for t in map(collapse, content.split("\n")) if t]
                sigs, inside, outside = [], (), ()
            for k, v in zip(out, (id_, source, fmt == "html", blocks, sigs, list(inside), list(outside))):
                out[k].append(v)
        types = (pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))


def _keys_of(block: str) -> list[str]:
    """What of a line must be a site's own for the line to be so: the line, or all entries of a menu or trail."""
    for bar in (" | ", " > ", " » ", " · ", " / "):
        if bar in block:
            return [x for x in map(str.strip, block.split(bar)) if x]
    return [block]


def _is_title(block: str) -> bool:
    return not block.endswith(_SENTENCE_END) and len(block) <= 160 and not _MARK.match(block)


def _is_teaser(block: str) -> bool:
    """One sentence."""
    return block.endswith((".", "।", "!", "?")) and not re.search(r"[.!?।] +[^\W\d_a-zß-ÿ]", block[:-1])


def body_of(html: bool, blocks: list[str], sigs: list[str], own) -> list[str]:
    """The blocks without the site's own (``own`` tells them) and without related-document boxes."""
    body, i = [], 0
    while i < len(blocks):
        block = blocks[i]
        taken = 1
        if not (mine := own(block)) and not html:
            for more, line in zip((2, 3), _wrapped(blocks, i)):
                if own(line):
                    mine, taken = True, more
                    break
        if not mine:
            body.append(block)
            i += 1
            continue
        j = i + taken
        if len(block) <= LABEL_CHARS and not block.endswith(_SENTENCE_END):
            alike = (lambda k: sigs[k] == sigs[i]) if html else (lambda k: True)
            marked = html and " " in sigs[i]
            titles = 0
            while j < len(blocks) and alike(j) and not own(blocks[j]):
                if marked or (_is_title(blocks[j]) and titles < 4):
                    titles += 1
                    j += 1
                    if not marked and j < len(blocks) and alike(j) and _is_teaser(blocks[j]):
                        j += 1
                else:
                    break
            if not titles or (not html and not body):  # a menu entry before the title of the page
                j = i + taken
        i = j
    return body


def own_blocks(read: DataFrame) -> DataFrame:
    """(source_id, key): the blocks that are a site's own; source_id is NULL where they are so on every site."""
    once = read.where("html").select("id", "source_id", "inside", "outside").dropDuplicates(["id"])
    counts = (
        once.select("source_id", F.explode("outside").alias("key"), F.lit(1).alias("o"))
        .unionAll(once.select("source_id", F.explode("inside").alias("key"), F.lit(0).alias("o")))
        .groupBy("source_id", "key")
        .agg(F.sum("o").alias("n_outside"), F.count("*").alias("n"))
    )
    pages = read.where("html").groupBy("source_id").agg(F.count_distinct("id").alias("n_pages"))
    often = counts.where(f"n_outside >= {LEAST_OUTSIDE} and n_outside >= {OUTSIDE_SHARE} * n").join(pages, "source_id")
    own = often.where(f"n_outside >= {PAGE_SHARE} * n_pages").select("source_id", "key")
    over_all = counts.groupBy("key").agg(F.sum("n_outside").alias("n_outside"), F.sum("n").alias("n"))
    own = own.join(over_all, "key").withColumn("all", F.expr(f"n_outside >= {OUTSIDE_SHARE} * n"))
    return own.select(F.when(~F.col("all"), F.col("source_id")).alias("source_id"), "key").distinct()


def _wrapped(blocks: list[str], i: int) -> list[str]:
    """The lines of a plain text page that one of its lines may be the first part of."""
    return [" ".join(blocks[i : i + more]) for more in (2, 3)]


def _probes(sources: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One number for a key of one source."""
    return mix(keys.view(np.uint64) + sources.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _own_probes(batches):
    """``probe`` of the rows of ``own_blocks``: the key where it holds on every site, else that of its source."""
    for batch in batches:
        sources, keys = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        of_source = _probes(np.array([0 if s is None else hash64(s) for s in sources], np.int64), keys)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(np.array([s is None for s in sources], bool), keys, of_source))], names=["probe"])


def _line_probes(bits):
    """(row, key, probe) of all lines of a page that the bitmap says may be a site's own."""

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            rows, sources, keys = [], [], []
            for row, source, html, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                lines = set(blocks)
                if not html:
                    lines.update(t for i in range(len(blocks)) for t in _wrapped(blocks, i))
                lines.update([part for t in lines for part in _keys_of(t)])
                at = hash64(source)
                for text in lines:
                    key = known.get(text)
                    if key is None:
                        key = known[text] = block_key(text)
                    rows.append(row), sources.append(at), keys.append(key)
                if len(known) > 100_000:
                    known.clear()
            row, source, key = np.array(rows, np.int64), np.array(sources, np.int64), np.array(keys, np.int64)
            row, key, probe = np.tile(row, 2), np.tile(key, 2), np.concatenate([key, _probes(source, key)])
            some = may_contain(bits.value, probe.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(row[some]), pa.array(key[some]), pa.array(probe[some])], names=["row", "key", "probe"])

    return run


def main_body(pages: DataFrame) -> DataFrame:
    """(id, block_no, block, block_md5): the blocks of the main body of each page, in order.

    Each page is joined with those of its own lines that are a site's own, at every size; a bitmap
    of these lines keeps all but a few others out of the join.
    """
    slim = pages.where("content_format in ('html', 'text')").select("id", F.coalesce("source_id", F.lit("")).alias("source_id"), "content_format", "content")
    read = slim.mapInArrow(sliced(_pages), "id string, source_id string, html boolean, blocks array<string>, sigs array<string>, inside array<bigint>, outside array<bigint>")
    read = written(read.withColumn("row", F.monotonically_increasing_id()), "main-body")  # numbers each delivery once and for all
    own = written(own_blocks(read).mapInArrow(_own_probes, "probe bigint").distinct(), "main-body-own")
    bits = pages.sparkSession.sparkContext.broadcast(bit_filter(own.select(F.col("probe").alias("key")), own.count()))
    lines = read.select("row", "source_id", "html", "blocks").mapInArrow(sliced(_line_probes(bits)), "row bigint, key bigint, probe bigint")
    mine = lines.join(own, "probe", "left_semi").groupBy("row").agg(F.collect_set("key").alias("own"))
    flagged = read.select("row", "id", "html", "blocks", "sigs").join(mine, "row", "left").select("id", "html", "blocks", "sigs", "own")

    def run(batches):
        for batch in batches:
            ids, nos, texts, hashes = [], [], [], []
            for id_, html, blocks, sigs, keys in zip(*(c.to_pylist() for c in batch.columns)):
                mine = frozenset(keys or ())

                def own(text: str, mine=mine) -> bool:
                    return bool(mine) and (block_key(text) in mine or (len(parts := _keys_of(text)) > 1 and all(block_key(p) in mine for p in parts)))

                for no, text in enumerate(body_of(html, blocks, sigs or [], own)):
                    ids.append(id_), nos.append(no), texts.append(text), hashes.append(md5(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(nos, pa.int32()), pa.array(texts, pa.string()), pa.array(hashes, pa.string())],
                names=["id", "block_no", "block", "block_md5"],
            )

    return flagged.mapInArrow(sliced(run), "id string, block_no int, block string, block_md5 string")
