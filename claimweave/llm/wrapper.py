"""Operator 3. Main text of web pages by wrapper induction.

Pages become trees of block elements (label: tag with class, id and role). Paragraphs, list items and the like of one element are one
repeated node. Each host has a reference tree, a page of the shape of the most different pages,
and every page is aligned with it by simple tree matching (the largest order-preserving
match of equal-labelled nodes, a node of equal text counting twice, below two nodes where their trees have one shape); it is one matching at every size, whose memory
is the longer list of children times the root of the other one; what has no counterpart is known by its path below the last node that has one. A slot is a node with text. A slot
that ``least`` different pages have is template where its text is always the same or mostly links; slots that vary are content, unless they stand in a menu, header, footer, sidebar, notice, advert,
form or comment element. Where a page has content in article or main elements, its text is what stands in them.

Three passes: shapes are counted by host, slots are summed up by host and slot, pages are read with what was found. The reference and the sums do not depend on
how pages are dealt to tasks, a host's slots are summed apart, and no page travels while the templates are small enough to broadcast.

Defined results: null and empty html give the empty text; a slot needs ``least`` pages that differ before it is judged by all its pages,
so lone pages and copies of one page, however many, are judged by their elements and links alone, as are pages without a host;
pages differ by their texts outside menus, headers, footers, adverts and the like; truncated
tags and unclosed elements end with the page; repeated rows give repeated results; other columns are kept, whatever their names, and
columns called text or n_chars are replaced (the page's own column may have such a name).
"""

from __future__ import annotations

import marshal
import re
import sys
from collections.abc import Iterator
from functools import cache, lru_cache
from html import unescape
from math import isqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from claimweave.llm.common import bounded, fresh, materialize
from claimweave.llm.urlfilter import host_path

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")
# fixed values: what the elements of HTML are
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "svg", "math", "object", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "nobr", "center"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "aside", "nav", "footer", "header", "form", "body", "html", "blockquote"}
#: Elements that are one repeated node with all their siblings of the same label.
FOLDED = {"p", "li", "tr", "td", "th", "dt", "dd", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "#text"}
BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "button", "fieldset", "dialog", "menu", "head", "frameset"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
BOILER_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "promo", "promotion", "sponsor", "sponsored", "sponsors", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert",
    "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "sidebar", "side", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "share", "sharing", "social", "related",
    "recommended", "footer", "header", "masthead", "topbar", "subscribe", "subscription", "newsletter", "popup", "modal", "overlay", "login", "signup", "search", "pagination", "pager", "widget", "widgets", "toolbar", "paywall",
}
#: Children from which a row of a match is computed in arrays; the numbers are the same either way.
WIDE = 48
#: Hosts whose templates a worker keeps unpacked, slots that it sums up before it hands them on, parts that a slot's sums are dealt to.
HELD, SLOTS, PARTS = 2000, 100_000, 64


class Node:
    """An element of a folded page. runs: (place, text, characters in links); mark: a hash of its text (0: none); number: its place in a reference tree.

    shape, size: a hash of the labels of its tree, and how many nodes that has (from shaped()); marks: those of its tree, when asked for.
    """

    __slots__ = ("label", "kids", "runs", "mark", "number", "shape", "size", "marks")

    def __init__(self, label: str, mark: int = 0, number: int = 0):
        self.label, self.kids, self.runs, self.mark, self.number = label, [], [], mark, number
        self.shape, self.size, self.marks = 0, 1, None


def preorder(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        yield (node := stack.pop())
        stack.extend(reversed(node.kids))


def shaped(root: Node) -> Node:
    for node in reversed(list(preorder(root))):
        node.shape = hash((node.label, *[kid.shape for kid in node.kids]))
        node.size = 1 + sum(kid.size for kid in node.kids)
    return root


def packed(root: Node) -> tuple[bytes, int]:
    """The labels and marks of a tree, each with the number of its parent; a hash of its shape."""
    labels, parents, marks, stack = [], [], [], [(root, -1)]
    while stack:
        node, parent = stack.pop()
        labels.append(node.label), parents.append(parent), marks.append(node.mark)
        stack.extend((kid, len(labels) - 1) for kid in reversed(node.kids))
    return marshal.dumps((labels, parents, marks), 2), xxhash.xxh3_64_intdigest(marshal.dumps((labels, parents), 2)) >> 1


def unpacked(tree: bytes) -> Node:
    nodes: list[Node] = []
    for label, parent, mark in zip(*marshal.loads(tree), strict=True):
        nodes.append(node := Node(label, mark, len(nodes)))
        if parent >= 0:
            nodes[parent].kids.append(node)
    return shaped(nodes[0])


def label_of(tag: str, attrs: str) -> str:
    """tag.words of class and id#role; digits fall away, so that numbered names are one."""
    if not attrs:
        return tag
    words, role = set(), ""
    for name, *values in ATTR.findall(attrs):
        value = unescape("".join(values)).lower()
        if (name := name.lower()) == "role":
            role = value
        elif name in ("hidden", "aria-hidden"):
            role = role or ("" if value == "false" else "dialog")
        else:
            words.update(w for w in re.split(r"[^a-z]+", value) if w)
    return tag + ("." + ".".join(sorted(words)) if words else "") + ("#" + role if role else "")


def parse(html: str) -> Node:
    """The tree of the page's block elements, folded, with its texts in page order."""
    root, seq = Node("#page"), 0
    stack: list[tuple[str, Node]] = [("#page", root)]
    text: list[str] = []
    links = in_link = 0

    def flush() -> None:
        nonlocal seq, links
        if text:
            run = SPACE.sub(" ", unescape("".join(text))).strip()
            if run:
                leaf = Node("#text")
                leaf.runs.append((seq, run, min(links, len(run))))
                stack[-1][1].kids.append(leaf)
                seq += 1
            text.clear()
        links = 0

    def close(upto: int) -> None:
        flush()
        del stack[upto:]

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            text.append(piece)
            if in_link:
                links += len(piece)
        if not m:
            break
        at = m.end()
        shut, tag, attrs = m.group(1), m.group(2), m.group(3)
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = int(not shut)
        elif tag in INLINE:
            continue
        elif shut:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            else:
                flush()
        elif tag in RAW:
            flush()
            stop = end_of(tag).search(html, at)
            at = stop.end() if stop else end
        elif tag in VOID:
            if tag == "hr":
                flush()
        else:
            flush()
            in_link = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSED_BY.get(tag, ()) or stack[i][0] == "p":
                    close(i)
                elif stack[i][0] in SCOPE:
                    break
            node = Node(label_of(tag, attrs))
            stack[-1][1].kids.append(node)
            stack.append((tag, node))
    close(1)
    fold(root)
    for node in preorder(root):
        if node.runs:
            node.mark = hashed("\n".join(r[1] for r in node.runs))
    return shaped(root)


@lru_cache(4096)
def foldable(label: str) -> bool:
    return label == "#text" or re.split(r"[.#]", label)[0] in FOLDED


@cache
def end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


def fold(root: Node) -> None:
    """Siblings of one foldable label become one, as does an element that holds nothing but one of its own label."""
    for node in preorder(root):
        while len(node.kids) == 1 and not node.runs and node.kids[0].label == node.label:
            node.runs, node.kids = node.kids[0].runs, node.kids[0].kids
        out: list[Node] = []
        places: dict[str, Node] = {}
        for kid in node.kids:
            same = places.get(kid.label) if foldable(kid.label) else None
            if same is None:
                out.append(kid)
                places[kid.label] = kid
            else:
                same.kids += kid.kids
                same.runs += kid.runs
        node.kids = out


class Matching:
    """Simple tree matching of a page with a reference tree."""

    #: Nodes of the largest match of two trees of labels, by their shapes.
    shapes: dict[tuple[int, int], int] = {}

    def pairs(self, a: list[Node], b: list[Node], weight=None) -> list[tuple[int, int]]:
        """The order-preserving pairs of equal labels with the most nodes matched below them; of equal ones the earliest.

        Of the table of best sums from (i, j) on, every so many-th row is kept; the others are made again, a block at a time, as the walk comes to them.
        """
        if len(a) == len(b) and all(x.label == y.label for x, y in zip(a, b, strict=True)):
            return [(i, i) for i in range(len(a))]
        weight = weight or self.weight
        step = isqrt(len(a)) + 1
        row, kept = [0] * (len(b) + 1), {}
        for i in range(len(a) - 1, -1, -1):
            if (i + 1) % step == 0 or i + 1 == len(a):
                kept[i + 1] = row
            row = self.row(a[i], b, row, weight)[0]
        i = j = 0
        found: list[tuple[int, int]] = []
        block: dict[int, tuple] = {}
        while i < len(a) and j < len(b):
            if i not in block or block[i][1] is None:
                last = min((i // step + 1) * step, len(a))
                block = {last: (kept[last], None)}
                for k in range(last - 1, i - 1, -1):
                    block[k] = self.row(a[k], b, block[k + 1][0], weight)
            (best, own), (below, _) = block[i], block[i + 1]
            if own[j] and best[j] == below[j + 1] + own[j]:
                found.append((i, j))
                i, j = i + 1, j + 1
            elif best[j] == below[j]:
                i += 1
            else:
                j += 1
        return found

    def row(self, x: Node, b: list[Node], below, weight) -> tuple:
        """(best sums from x on, weights of x with each of b), given the best sums after x."""
        own = [weight(x, y) if x.label == y.label else 0 for y in b]
        if len(b) < WIDE:
            best = [0] * (len(b) + 1)
            for j in range(len(b) - 1, -1, -1):
                best[j] = max(below[j], best[j + 1], below[j + 1] + own[j] if own[j] else 0)
            return best, own
        under, add = np.asarray(below), np.array(own)
        best = np.maximum(under[:-1], np.where(add > 0, under[1:] + add, 0))
        return np.append(np.maximum.accumulate(best[::-1])[::-1], 0), own

    def weight(self, a: Node, b: Node) -> int:
        """The nodes of the largest match of two trees of one label; those of equal text count twice, at the top or where both have one shape."""
        if a.shape != b.shape:
            return self.common(a, b) + (a.mark == b.mark != 0)
        if a.size == 1:
            return 1 + (a.mark == b.mark != 0)
        for x in (a, b):
            if x.marks is None:
                x.marks = [n.mark for n in preorder(x)]
        return a.size + sum([p == q != 0 for p, q in zip(a.marks, b.marks, strict=True)])

    def common(self, a: Node, b: Node) -> int:
        """The nodes of the largest match of two trees of one label, whatever their texts."""
        if a.shape == b.shape:
            return a.size
        if not a.kids or not b.kids:
            return 1
        if (n := self.shapes.get((a.shape, b.shape))) is None:
            if len(self.shapes) > SLOTS:
                self.shapes.clear()
            n = 1 + sum(self.common(a.kids[i], b.kids[j]) for i, j in self.pairs(a.kids, b.kids, self.common))
            self.shapes[a.shape, b.shape] = n
        return n


@lru_cache(4096)
def boiler(label: str) -> bool:
    name, _, role = label.partition("#")
    tag, *words = name.split(".")
    return tag in BOILER_TAGS or role in BOILER_ROLES or any(w in BOILER_WORDS for w in words) and tag not in ("body", "html")


@lru_cache(4096)
def main_label(label: str) -> bool:
    return re.split(r"[.#]", label)[0] in ("article", "main") or label.endswith("#main")


def hashed(text: str, seed: int = 0) -> int:
    """63 bits."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed) >> 1


def slots(page: Node, reference: Node | None) -> list[tuple[int, Node, bool]]:
    """(key, node, whether in an article) of the page's slots outside menus and the like. key: the number of the counterpart, or a hash of the path below the last one."""
    found, match = [], Matching()
    stack: list[tuple[Node, Node | None, int, bool]] = [(page, reference, 0, False)]
    while stack:
        node, other, key, inside = stack.pop()
        if boiler(node.label):
            continue
        inside = inside or main_label(node.label)
        if node.runs:
            found.append((key, node, inside))
        pairs = dict(match.pairs(node.kids, other.kids)) if other is not None and node.kids and other.kids else {}
        for i, kid in enumerate(node.kids):
            if (j := pairs.get(i)) is not None:
                stack.append((kid, other.kids[j], other.kids[j].number, inside))
            else:
                stack.append((kid, None, hashed(kid.label, key) | 1 << 62, inside))
    return found


def page_hash(found: list[tuple[int, Node, bool]]) -> int:
    """What makes two pages copies: their texts in page order, but those of menus, headers, footers, adverts and the like."""
    return hashed("\n".join(text for _, text in sorted((seq, text) for _, node, _ in found for seq, text, _ in node.runs)))


def mostly_links(chars: int, links: int) -> bool:
    return 2 * links > chars


def read(page: Node, reference: Node | None, judged: dict[int, bool]) -> str:
    """The page's content: its slots as the template judges them, or, where it does not know them, by their links."""
    found: list[tuple[bool, int, str]] = []
    for key, node, inside in slots(page, reference):
        drop = judged.get(key)
        if drop is None:
            drop = mostly_links(sum(len(r[1]) for r in node.runs), sum(r[2] for r in node.runs))
        if not drop:
            found.extend((inside, seq, text) for seq, text, _ in node.runs)
    if any(inside for inside, _, _ in found):
        found = [x for x in found if x[0]]
    return "\n".join(text for _, _, text in sorted(found, key=lambda x: x[1]))


def deep() -> None:
    """Matching goes as deep as the pages do."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, html) to (host, shape, page, tree): the tree where no page before has a smaller hash, so that of the smallest is always there."""
    seen: dict[tuple[str, int], int] = {}
    for pdf in batches:
        out = []
        for host, html in zip(pdf["host"], pdf["html"], strict=True):
            root = parse(html)
            page, (tree, shape) = page_hash(slots(root, None)), packed(root)
            new = page < seen.get((host, shape), 1 << 63)
            if new:
                if len(seen) > SLOTS:
                    seen.clear()
                seen[host, shape] = page
            out.append((host, shape, page, tree if new else None))
        yield pd.DataFrame(out, columns=["host", "shape", "page", "tree"])


def sums(batches: Iterator[pd.DataFrame], references, least: int) -> Iterator[pd.DataFrame]:
    """(host, html, tree) to sums by host and slot: least and greatest hash of its text, up to ``least`` different pages, characters, and those in links."""
    deep()
    part = TaskContext.get().partitionId() % PARTS
    held: dict[tuple[str, int], list] = {}

    def out() -> pd.DataFrame:
        rows = [(host, key, part, low, high, sorted(pages), chars, links) for (host, key), (low, high, pages, chars, links) in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["host", "key", "part", "low", "high", "pages", "chars", "links"])

    for pdf in batches:
        for host, html, tree in zip(pdf["host"], pdf["html"], pdf["tree"], strict=True):
            found = slots(parse(html), references(host, tree)[0])
            page = page_hash(found)
            for key, node, _ in found:
                mark, chars, links = node.mark, sum(len(r[1]) for r in node.runs), sum(r[2] for r in node.runs)
                if (own := held.get((host, key))) is None:
                    held[host, key] = [mark, mark, {page}, chars, links]
                    continue
                own[0], own[1], own[3], own[4] = min(own[0], mark), max(own[1], mark), own[3] + chars, own[4] + links
                if page not in own[2]:
                    own[2].add(page)
                    if len(own[2]) > least:
                        own[2].remove(max(own[2]))
        if len(held) > SLOTS:
            yield out()
    if held:
        yield out()


class Templates:
    """The templates of hosts as a worker asks for them: from the broadcast table, or from what stands with the page."""

    def __init__(self, shared):
        self.shared, self.known = shared, {}

    def __call__(self, host: str, own: bytes | None) -> tuple[Node | None, dict[int, bool]]:
        if own is None and self.shared is not None:
            own = self.shared.value.get(host)
        if own is None:
            return None, {}
        if (t := self.known.get(host)) is None:
            if len(self.known) > HELD:
                self.known.clear()
            tree, keys, drops = marshal.loads(own)
            t = self.known[host] = unpacked(tree), dict(zip(keys, drops, strict=True))
        return t


def beside(rows: DataFrame, found: DataFrame, host: str, name: str) -> tuple[DataFrame, object]:
    """rows with the template of their host as column ``name``, or with null there and the templates broadcast, where their counted size allows."""
    if bounded(found, row_bytes=F.octet_length("template") + F.octet_length("host")):
        shared = found.sparkSession.sparkContext.broadcast({r["host"]: bytes(r["template"]) for r in found.collect()})
        return rows.withColumn(name, F.lit(None).cast("binary")), shared
    (of,) = fresh(rows, "of")
    return rows.join(found.select(F.col("host").alias(of), F.col("template").alias(name)), F.col(host) == F.col(of), "left").drop(of), None


@F.pandas_udf(BinaryType())
def as_template(tree: pd.Series, keys: pd.Series, drops: pd.Series) -> pd.Series:
    return pd.Series([marshal.dumps((t, k.tolist(), d.tolist()), 2) for t, k, d in zip(tree, keys, drops, strict=True)], dtype=object)


def templates(pages: DataFrame, html_col: str = "html", url_col: str = "url", least: int = 4) -> DataFrame:
    """(host, template): the wrappers that the pages of each host induce."""
    host = host_path(F.col(f"`{url_col}`"))[0]
    rows = pages.select(host.alias("host"), F.col(f"`{html_col}`").cast("string").alias("html")).where("html is not null and host <> ''")
    found = rows.mapInPandas(shapes, "host string, shape long, page long, tree binary").groupBy("host", "shape").agg(F.approx_count_distinct("page").alias("n"), F.min_by("tree", F.when(F.col("tree").isNotNull(), F.col("page"))).alias("tree"))
    found = found.groupBy("host").agg(F.max_by("tree", F.struct("n", "shape")).alias("tree"))
    none = F.array().cast("array<bigint>"), F.array().cast("array<boolean>")
    found = materialize(found.select("host", "tree", as_template("tree", *none).alias("template")), "references")
    seen, shared = beside(rows, found.select("host", "template"), "host", "tree")
    made = seen.mapInPandas(lambda batches: sums(batches, Templates(shared), least), "host string, key long, part int, low long, high long, pages array<long>, chars long, links long")
    some = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))), 1, least).alias("pages")
    for keys in (["host", "key", "part"], ["host", "key"]):  # the sums of a slot of a hot host come together in two steps
        made = made.groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high"), some, F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    judged = made.where(F.size("pages") >= least).select("host", F.struct("key", ((F.col("low") == F.col("high")) | (2 * F.col("links") > F.col("chars"))).alias("drop")).alias("j"))
    judged = judged.groupBy("host").agg(F.sort_array(F.collect_list("j")).alias("j")).select(F.col("host").alias("of"), F.col("j.key").alias("keys"), F.col("j.drop").alias("drops"))
    both = found.join(judged, F.col("host") == F.col("of"), "left")
    return both.select("host", as_template("tree", F.coalesce("keys", none[0]), F.coalesce("drops", none[1])).alias("template"))


def main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", least: int = 4) -> DataFrame:
    """pages with text and n_chars."""
    found = materialize(templates(pages, html_col, url_col, least), "templates")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("text", "n_chars")]
    host, html, template = fresh(pages, "host", "html_text", "template")
    rows = pages.select(*kept, host_path(F.col(f"`{url_col}`"))[0].alias(host), F.col(f"`{html_col}`").cast("string").alias(html))
    rows, shared = beside(rows, found, host, template)

    @F.pandas_udf("string")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        deep()
        of = Templates(shared)
        for pages, hosts, own in batches:
            yield pd.Series([read(parse(p), *of(h, t)) if p else "" for p, h, t in zip(pages, hosts, own, strict=True)], dtype=object)

    rows = rows.withColumn("text", extract(html, host, template)).drop(host, html, template)
    return rows.withColumn("n_chars", F.length("text").cast("long"))
