"""HTML extraction by composite text density.

A page's nodes get a density: characters per tag, adjusted for the part of
them that are links. A node's density sum adds up those of its blocks, the text
that stands in it directly being one more. The node with the largest density
sum is the anchor; the smallest density on its path up to the body is the
threshold. From the body down, wherever a node is at or above the threshold,
the node with the largest density sum under it is text. Of nodes with equal
sums an ``article`` or ``main`` comes first; these names decide nothing else
here. What elements and their names declare as furniture (menus, headers,
footers, sidebars, notices, adverts, scripts, styles, comments of readers, and
forms but for one that holds most of the page's text) is taken out first.

Edge cases: a null or empty page, and one without text, give an empty text;
broken markup (tags that don't end, stray ends, a cut page) is read as
browsers do, as far as blocks go; pages of any length are read whole; repeated
rows give repeated results; an empty table gives an empty result; other
columns are ignored; null ids and addresses are kept.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm import arrowtext as at

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe xmp noembed noframes title".split())
FURNITURE = frozenset("nav footer aside script style noscript template iframe svg canvas button select option input textarea dialog menu head title object embed audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul details".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
CONTAINERS = frozenset("body html article main section div table td th ul ol dl blockquote nav footer aside header form".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?<!with[_-])(?<!has[_-])(?<!no[_-])(?:ad|ads|adv|advert\w*|advertisement|banner|sponsor\w*|promo\w*|breadcrumbs?|comments?|commentlist|respond|replies|reply|disqus|cookies?\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|navbar|nav|navigation|menu|sidebar|side|widget|related|recommend\w*|share|sharing|social|pagination|pager|toolbar|skip|copyright|legal|search\w*)(?:$|[\s_-])"
)
#: Names that tell furniture only outside an article.
OUTER_NAMES = re.compile(r"(?:^|[\s_-])(?<!with[_-])(?<!has[_-])(?<!no[_-])(?:header|masthead|footer|foot|topbar|top)(?:$|[\s_-])")
#: Names of things that may hold articles of their own: others' texts about this one, or other ones.
FIRM_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|replies|reply|disqus|related|recommend\w*)(?:$|[\s_-])")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar alert".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "block", "drop", "named")

    def __init__(self, tag: str, parent: Node | None, drop: bool, named: int = 0):
        self.tag, self.parent, self.children, self.drop, self.named = tag, parent, [], drop, named
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.block = tag not in INLINE


def in_article(node: Node | None) -> bool:
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.parent
    return False


def is_furniture(tag: str, attributes: str, inside: Node) -> tuple[bool, int]:
    """Whether an element is not part of the article by what it is, and whether by how it is named (2: whatever it holds)."""
    if tag in FURNITURE:
        return True, 0
    if tag == "header":  # an article may have its own
        return not in_article(inside), 0
    if not attributes or tag in ("body", "html", "article", "main"):
        return False, 0
    named = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            if FIRM_NAMES.search(value):
                named = 2
            elif NAMES.search(value) or OUTER_NAMES.search(value) and not in_article(inside):
                named = max(named, 1)
        elif name == "role":
            if value in ROLES:
                return True, 0
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True, 0
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, 0
    return False, named


def parse(page: str) -> Node:
    """The tree of a page; children are nodes and strings."""
    root = Node("html", None, False)
    by_name: list[Node] = []
    forms: list[Node] = []
    node, at_char, end = root, 0, len(page)
    while at_char < end:
        m = _TOKEN.search(page, at_char)
        if m is None:
            node.children.append(page[at_char:])
            break
        if m.start() > at_char:
            node.children.append(page[at_char : m.start()])
        at_char = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            up = node
            while up is not root and up.tag != tag:
                # An inline end tag doesn't reach out of its block.
                if tag in INLINE and up.tag in CONTAINERS:
                    up = root
                    break
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if tag in ("html", "body"):
            if tag == "body":
                node = Node("body", root, False)
                root.children.append(node)
            continue
        if tag in CLOSES_P:
            node = closed(node, ("p",))
        if tag in CLOSES:
            node = closed(node, CLOSES[tag])
        furniture, named = is_furniture(tag, attributes, node)
        child = Node(tag, node, node.drop or furniture, named)
        node.children.append(child)
        if tag == "form":
            forms.append(child)
        if named:
            by_name.append(child)
        elif tag in ("article", "main", "h1") and not child.drop:
            up = node  # what holds the article is not furniture, whatever its name
            while up is not None:
                up.named = 0 if up.named == 1 else up.named
                up = up.parent
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at_char)
            if tag not in ("noscript", "template"):
                child.children.append(page[at_char : stop.start() if stop else end])
                at_char = stop.end() if stop else end
                continue
        if tag not in VOID and not attributes.endswith("/"):
            node = child
    for named in by_name:
        named.drop = named.drop or named.named > 0
    if forms:
        whole = plain_chars(root)
        for form in forms:
            form.drop = form.drop or 2 * plain_chars(form) <= whole
    return root


def plain_chars(node: Node) -> int:
    """Characters under a node that are neither in links nor in furniture."""
    n, stack = 0, [node]
    while stack:
        for child in stack.pop().children:
            if isinstance(child, str):
                n += len(_SPACE.sub("", child))
            elif not child.drop and child.tag != "a":
                stack.append(child)
    return n


def closed(node: Node, tags: tuple[str, ...]) -> Node:
    """Where to go on after open elements of these names have ended by themselves."""
    up = node
    while up.parent is not None and up.tag not in tags:
        if up.tag in CONTAINERS and up.tag not in ("section", "article", "main"):
            return node
        if up.tag in ("article", "main", "section"):
            return node
        up = up.parent
    return up.parent if up.parent is not None and up.tag in tags else node


def measure(root: Node) -> list[Node]:
    """Counts, densities and density sums, from the leaves up; the nodes in page order."""
    order, stack = [], [(root, False)]
    while stack:
        node, inside_link = stack.pop()
        order.append(node)
        link = inside_link or node.tag == "a"
        node.link_tags = int(link)
        for child in node.children:
            if isinstance(child, str):
                n = len(_SPACE.sub("", child))
                node.chars += n
                node.link_chars += n if link else 0
        stack += [(c, link) for c in reversed(node.children) if not isinstance(c, str) and not c.drop]
    for node in reversed(order):
        node.tags = 1
        for child in node.children:
            if not isinstance(child, str) and not child.drop:
                node.chars += child.chars
                node.tags += child.tags
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags
                node.block = node.block or child.block and child.chars > 0
    body = next((n for n in order if n.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for node in order:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in order:
        blocks = [c for c in node.children if not isinstance(c, str) and not c.drop and c.block and c.chars]
        if not blocks:
            node.total = node.density
            continue
        # What stands in the node itself, with the inline elements there, is one block more.
        chars, tags, link_chars, link_tags = (getattr(node, x) - sum(getattr(c, x) for c in blocks) for x in ("chars", "tags", "link_chars", "link_tags"))
        node.total = sum(c.density for c in blocks) + density(chars, tags, link_chars, link_tags, share)
    return order


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density; ``share`` is the part of the body's characters that are in links."""
    if not chars:
        return 0.0
    plain = max(1, chars - link_chars)
    base = math.log(chars / plain * link_chars + share * chars + math.e)
    return chars / tags * math.log(chars / max(1, link_chars) * tags / max(1, link_tags) + 1) / base


def main_nodes(root: Node) -> list[Node]:
    """The nodes that hold the article, in page order, none inside another."""
    order = measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    rank = lambda n: (n.total, n.tag in ("article", "main"))
    # For each block, the first of those with the largest density sum under it.
    best: dict[Node, Node] = {}
    for node in reversed(order):
        if not node.chars or not node.block:
            continue
        own = best.get(node)
        best[node] = own = node if own is None or rank(node) >= rank(own) else own
        up = node.parent
        if up is not None and (up not in best or rank(own) >= rank(best[up])):
            best[up] = own
    if root not in best:
        return [body]
    anchor = best[root]
    above = path(anchor)
    above = above[: above.index(body) + 1] if body in above else above
    threshold = min([anchor.density, *(n.density for n in above)])
    marked: set[Node] = set()
    stack = [root]
    while stack:
        node = stack.pop()
        if node is root or node in best and node.density >= threshold:
            marked.add(best[node])
            stack += [c for c in node.children if not isinstance(c, str) and not c.drop]
    found: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node in marked:
            found.append(node)
        else:
            stack += [c for c in reversed(node.children) if not isinstance(c, str) and not c.drop]
    return found


def path(node: Node) -> list[Node]:
    found, up = [], node.parent
    while up is not None:
        found.append(up)
        up = up.parent
    return found


def blocks_of(node: Node) -> list[str]:
    """Texts of the blocks under a node, in page order."""
    found: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                found.append(text)
            held.clear()

    stack: list = [node]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            held.append(item)
        elif item.drop:
            if item.tag not in INLINE:
                flush()
        elif item.tag == "br" or item.tag == "hr":
            flush()
        elif item.tag in INLINE:
            stack += reversed(item.children)
        else:
            flush()
            stack.append(None)
            stack += reversed(item.children)
    flush()
    return found


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, joined by one space."""
    if not page:
        return ""
    return " ".join(b for n in main_nodes(parse(page)) for b in blocks_of(n))


def extract_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.slices(batch, "html"):
                texts = [main_text(p) for p in part.column("html").to_pylist()]
                yield pa.record_batch({"id": part.column("id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")
