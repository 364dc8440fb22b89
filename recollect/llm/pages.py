"""Operator 2: the main text of web pages, by site style trees.

The pages of one host are merged into a style tree: elements at the same path of styles (tag, class words, role) are one node of
it, and the node keeps how many pages have it, which sequences of child styles it shows (its presentations) and which contents
its text blocks have.  Pages that agree in their ``TELLING`` longest blocks are copies and count as one page of the tree.  A node's
importance is high if its presentations or its contents differ from page to page (high entropy of presentations; each content on few
pages) and low if they repeat:

    presentation   -sum of p log_m p over the node's presentations (m pages)
    content        1 - mean of log_m n over the distinct contents below the node (content on n of m pages)
    entropy part   e = (1 - g^l) presentation + g^l content, with l kinds of children and g = 0.9
    importance     1 - (1 - e) m / (m + 1), as few pages say little: one page says nothing (e = 1)

What the markup says weighs on it, as entropy alone can't tell an advert that is new on each page from an article:

    declared to be a menu, footer, advert, form, comment and the like, or within such      importance 0
    within an article or main that isn't declared such                                     ``INSIDE`` + (1 - ``INSIDE``) importance
    outside of these on a page that has one                                                ``BESIDE`` importance

A branch below ``LOW`` is removed with all below it.  So on each page the entropy decides: within an article a branch goes if (almost) the
same stands there on all pages of the host, such as a notice or a line about the author; on a page without an article any branch of low
entropy goes.  Text beside an article goes at any entropy, as ``BESIDE`` is less than ``LOW``.

Trees are counted by Spark's aggregates over (host, path), so a host with a third of all pages is no hot spot; a page is parsed
alone, and only the paths of low entropy are joined to the pages of their host.  Nodes deeper than ``DEPTH`` belong to their ancestor at
this depth in the tree, which bounds the tree's paths; their text is kept or removed with that ancestor.

Parsing follows HTML's rules where they matter for text: raw-text elements, void elements, end tags that may be left out, references
without a semicolon.  An unfinished tag at the end is dropped.

Defined results: null html counts as empty and gives an empty text; a null or odd url belongs to the host ''; repeated pages are
pages like others; columns with an output's name are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .shared import arrow_column, bounded_batches, text_or_empty, written

#: Nodes deeper than this belong to their ancestor at this depth in the style tree.
DEPTH = 32
#: A branch of less importance is removed; what the markup adds to it within an article, and leaves of it outside.
LOW, INSIDE, BESIDE = 0.25, 0.15, 0.2
DAMPING = 0.9
#: Pages that agree in so many of their longest blocks are copies.
TELLING = 3
#: So many rows are sent to all tasks at most; more are joined by a shuffle.
SENT_ROWS = 50_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that never hold main text.
DECLARED = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea dialog menu object canvas video audio math".split())
#: Words in a class, id or role that declare the same.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer"
    " comment comments disqus reply replies respond cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription signup login share sharing"
    " social related recommended recommendations widget pagination pager masthead toolbar skip copyright contentinfo complementary search alert dialog hidden".split()
)
#: A class with one of these names a layout ("with-sidebar"), not what it holds.
LAYOUT = frozenset("has with without no layout wrapper page grid columns".split())
#: These do outside an article alone.
OUTSIDE = frozenset("header topbar banner".split())
#: An open element that a start tag of these ends.
ENDS = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"]),
}
#: Open elements that a start tag ends.
ENDED = defaultdict(tuple, {tag: tuple(o for o, ends in ENDS.items() if tag in ends) for tag in set().union(*ENDS.values())})
#: Elements beyond which a left-out end tag isn't looked for.
FENCES = frozenset("ul ol dl table td th article section div main body button object".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element that is more than a stretch of inline text.  ``parts`` are child nodes and strings in order."""

    __slots__ = ("above", "article", "declared", "depth", "links", "parts", "path", "style", "tag")

    def __init__(self, tag: str, above: Node | None, attributes: str = ""):
        self.tag, self.above, self.parts, self.links = tag, above, [], []
        words: set[str] = set()
        shown, style, hidden = [], tag, False
        if attributes.strip():
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), a or b or c
                if name in ("class", "id", "role"):
                    found = []
                    for one in value.split():
                        parts = [w.lower() for w in CAMEL.findall(one)]
                        found += parts
                        if not LAYOUT.intersection(parts):
                            words.update(parts, ["".join(parts)])
                    if name != "id":
                        shown += sorted(set(found))
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                    hidden = True
            style = ".".join([tag, *shown])
        self.style = style
        self.depth = above.depth + 1 if above else 0
        self.path = style if above is None else f"{above.path}/{style}" if self.depth <= DEPTH else above.path
        inside = above is not None and above.article
        own = tag not in ("html", "body", "article", "main")
        self.declared = bool(
            (above is not None and above.declared)
            or tag in DECLARED
            or hidden
            or (own and words & WORDS)
            or (tag == "article" and words & {"comment", "comments", "reply", "replies"})
            or (own and not inside and (tag == "header" or words & OUTSIDE))
        )
        self.article = inside or (tag in ("article", "main") and not self.declared)


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("html", None)
    now, at, n = root, 0, len(page)
    opened = {"html": 1}  # open elements by name, so that an end tag without one isn't looked for
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            now.parts.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            continue
        if m.group(5) and not m.group(0).endswith(">"):
            break  # unfinished at the end
        tag, closes, attributes = tag.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
        if tag in INLINE:
            if tag == "a" and not closes:
                now.links.append(attributes)
            continue
        if closes:
            if opened.get(tag) and tag != "html":
                while now.tag != tag:
                    opened[now.tag] -= 1
                    now = now.above
                opened[tag] -= 1
                now = now.above
            elif tag == "br":
                now.parts.append(" ")
            continue
        if tag == "html":
            continue
        if tag in VOID:
            now.parts.append("\n" if tag in ("br", "hr") else "")
            continue
        ends = now
        while ends is not None:
            if tag in ENDS.get(ends.tag, ()):
                while now is not ends.above:
                    opened[now.tag] -= 1
                    now = now.above
                if ends.tag in ("td", "th", "tr") and tag in ("tr", "tbody", "tfoot", "thead"):
                    ends = now
                    continue
                break
            if ends.tag in FENCES or not any(opened.get(t) for t in ENDED[tag]):
                break
            ends = ends.above
        node = Node(tag, now, attributes)
        now.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if end is None:
                at = n
            else:
                at = end.end()
            continue
        if not attributes.rstrip().endswith("/") or tag not in ("path", "circle", "rect", "line", "use"):
            now = node
            opened[tag] = opened.get(tag, 0) + 1
    else:
        return root
    if m is None:
        now.parts.append(page[at:])
    return root


def clean(text: str) -> str:
    return " ".join(references.unescape(text).split()) if "&" in text else " ".join(text.split())


def blocks(node: Node) -> Iterator[tuple[Node, str]]:
    """Text blocks in page order with the node that they are in."""
    stack: list[tuple[Node, int, list[str]]] = [(node, 0, [])]
    while stack:
        node, k, open_text = stack.pop()
        parts = node.parts
        while k < len(parts) and isinstance(parts[k], str):
            open_text.append(parts[k])
            k += 1
        text = clean("".join(open_text))
        if text:
            yield node, text
        if k < len(parts):
            stack.append((node, k + 1, []))
            stack.append((parts[k], 0, []))


def nodes(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [p for p in node.parts if not isinstance(p, str)]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def number(text: str) -> int:
    """A 63-bit hash."""
    data = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 31 ^ zlib.adler32(data) ^ len(data) << 16


PRESENTATION, CONTENT = 0, 1
SEEN = StructType().add("host", "string").add("path", "string").add("what", "integer").add("feature", "long").add("kinds", "integer").add("page", "long")


def seen(root: Node) -> list[tuple[str, int, int, int, int]]:
    """Rows of a page for its host's style tree: one for each path's presentation, one for each different content of a path.

    The last column tells the page from others, but not from its copies.
    """
    shows: dict[str, set[tuple[str, ...]]] = {}
    for node in nodes(root):
        if not node.declared:
            children = [p.style for p in node.parts if not isinstance(p, str)]
            shows.setdefault(node.path, set()).add(tuple(c for k, c in enumerate(children) if not k or c != children[k - 1]))
    texts = [(node.path, text) for node, text in blocks(root) if not node.declared]
    page = number("\n".join(sorted({t for _, t in texts}, key=lambda t: (-len(t), t))[:TELLING]))
    rows = [(path, PRESENTATION, number(repr(sorted(s))), len({c for one in s for c in one}), page) for path, s in shows.items()]
    return rows + [(path, CONTENT, feature, 0, page) for path, feature in {(path, number(text)) for path, text in texts}]


def style_tree(pages: DataFrame) -> DataFrame:
    """``host``, ``path``, ``pages`` and ``importance`` (without the markup's weights) of the style trees of ``pages`` (``url``, ``html``)."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (host_of(url), *row)
                for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for row in seen(parse(page or ""))
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=SEEN.names)

    each = pages.select("url", "html").mapInArrow(run, SEEN).groupBy("host", "path", "what", "feature", "page").agg(F.max("kinds").alias("kinds"))
    each = written(each.groupBy("host", "path", "what", "feature").agg(F.count("*").alias("n"), F.max("kinds").alias("kinds")), "styles")
    shown = each.filter(F.col("what") == PRESENTATION).groupBy("host", "path")
    # -sum p ln p = ln m - (sum n ln n) / m
    shown = shown.agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.max("kinds").alias("kinds"))
    entropy = F.when(F.col("pages") > 1, (F.log("pages") - F.col("nlogn") / F.col("pages")) / F.log("pages")).otherwise(1.0)
    shown = shown.select("host", "path", "pages", "kinds", entropy.alias("presentation"))
    leaves = each.filter(F.col("what") == CONTENT).groupBy("host", "path").agg(F.sum(F.log("n")).alias("logs"), F.count("*").alias("features"))
    leaves = leaves.join(shown.select("host", "path", "pages"), ["host", "path"])
    spread = F.when(F.col("pages") > 1, F.least(F.col("logs") / F.log("pages"), F.col("features"))).otherwise(0.0)
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    below = leaves.select("host", F.explode(above).alias("path"), spread.alias("spread"), "features").groupBy("host", "path")
    below = below.agg(F.sum("spread").alias("spread"), F.sum("features").alias("features"))
    weight = F.pow(F.lit(DAMPING), F.col("kinds"))
    content = F.lit(1.0) - F.col("spread") / F.col("features")
    out = shown.join(below, ["host", "path"])  # a node without text below has nothing to remove
    told = (1 - weight) * F.col("presentation") + weight * content
    return out.select("host", "path", "pages", (1 - (1 - told) * F.col("pages") / (F.col("pages") + 1)).alias("importance"))


def main_text(page: str, entropy: dict[str, float]) -> str:
    """The main text of a page; ``entropy`` tells the importance of paths, without the markup's weights, 1 if it doesn't."""
    root = parse(page)
    found = [node for node in nodes(root) if node.article and not node.declared]
    main = any(node.tag == "article" for node in found)  # an article within main is nearer the text than main
    removed: dict[int, tuple[bool, bool]] = {}

    def state(node: Node | None) -> tuple[bool, bool]:
        """Whether ``node`` or what it is in is removed, and whether it is within the article."""
        chain = []
        while node is not None and id(node) not in removed:
            chain.append(node)
            node = node.above
        gone, inside = removed[id(node)] if node is not None else (False, False)
        for x in reversed(chain):
            inside = inside or (x.tag == "article" if main else x.tag == "main") and x.article and not x.declared
            importance = 0.0 if x.declared else entropy.get(x.path, 1.0)
            if inside and not x.declared:
                importance = INSIDE + (1 - INSIDE) * importance
            gone = gone or importance < LOW
            removed[id(x)] = gone, inside
        return gone, inside

    out = []
    for node, text in blocks(root):
        gone, inside = state(node)
        # the branch of a block outside is that block alone: what is around it may hold the article
        beside = bool(found) and not inside and BESIDE * entropy.get(node.path, 1.0) < LOW
        if not gone and not beside:
            out.append(text)
    return " ".join(out)


def extract(df: DataFrame, url: str = "url", html: str = "html", name: str = "text") -> DataFrame:
    """``df`` with ``name``, the main text of each page."""
    base = df.select(F.col(url).alias("url"), text_or_empty(html).alias("html"))
    # paths of a higher entropy are kept within an article and without one
    tree = style_tree(base).filter(F.col("importance") < LOW)
    low = F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "importance"))))
    by_host = written(tree.groupBy("host").agg(low.alias("__low")), "unimportant")
    few = by_host.agg(F.coalesce(F.sum(F.size("__low")), F.lit(0))).first()[0] <= SENT_ROWS

    def hosts():
        return lambda urls: pa.array(map(host_of, urls), pa.string())

    def texts():
        return lambda pages, paths: pa.array([main_text(p, dict(x or ())) for p, x in zip(pages, paths, strict=True)], pa.string())

    hosted = df.withColumn("__host", arrow_column(df, hosts, StringType(), F.col(url)))
    by_host = by_host.withColumnRenamed("host", "__tree")
    joined = hosted.join(F.broadcast(by_host) if few else by_host, F.col("__host") == F.col("__tree"), "left")
    text: Column = arrow_column(df, texts, StringType(), text_or_empty(html), F.col("__low"))
    return joined.withColumn("__text", text).select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()], F.col("__text").alias(name))
