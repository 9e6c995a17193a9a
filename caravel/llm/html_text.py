"""Main text of web pages by composite text density.

A page's nodes get a density: characters per tag, adjusted by the share of linked
characters and tags. The sum of a node's children's densities finds the subtree that
holds most dense text; the smallest density on the path from body to it is the page's
threshold. Of every other subtree that reaches the threshold, the part with the largest
sum is main text too. An article or main element around such a part, and headings just
before it, are taken with it; blocks of links within are not. Elements that are never
article (by tag, role, name or heading) leave the tree before anything is counted.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.llm.shared import rows_per_batch

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
#: Opening one of the keys ends an open one of the values, up to the nearest scope.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "select", "body", "html"}
#: Over these, the end of an inline element has no effect.
CELLS = {"table", "td", "th"}
NEVER = {
    "head", "script", "style", "noscript", "template", "title", "iframe", "nav", "menu", "header", "footer", "aside", "form", "button", "select", "textarea",
    "input", "svg", "canvas", "object", "embed", "dialog",
}
NEVER_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
#: What class and id names call elements that are no article: alone or as the last word
#: of a name (reader-comments), or before a word for a container (comment-list).
NEVER_NAME = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts",
    "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup",
    "modal", "overlay", "newsletter", "subscribe", "signup", "login", "comment", "comments", "disqus", "respond", "reply", "replies", "related",
    "recommended", "share", "sharing", "social", "pagination", "pager", "widget", "toolbar", "copyright", "legal", "disclaimer",
}
CONTAINER = {
    "area", "articles", "bar", "block", "body", "box", "button", "buttons", "card", "column", "container", "content", "footer", "form", "group", "header", "icons",
    "inner", "item", "items", "link", "links", "list", "main", "message", "module", "outer", "panel", "posts", "region", "row", "section", "slot", "stories", "text",
    "thread", "title", "top", "unit", "wrap", "wrapper",
}
#: First words of names that say what an element or page has, not what it is.
STATE = {"has", "is", "no", "not", "show", "with", "without"}
COMMENTS_HEADING = re.compile(r"\s*(?:\d+\s+)?(?:(?:reader|user)\s+)?(?:comments?|kommentare?|commentaires?|comentarios?|leave a (?:comment|reply))\b[\s\d():]*", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("scope", "cell", "block", "in_scope", "in_cell", "tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "sum", "best", "no_article", "in_article")

    def __init__(self, tag: str, parent: Node | None, no_article: bool):
        self.tag, self.parent, self.no_article = tag, parent, no_article
        self.in_article = tag in ("article", "main") or parent is not None and parent.in_article
        # the nearest of each kind upwards, and what is open under it before the next one
        self.scope = self if parent is None or tag in SCOPE else parent.scope
        self.cell = self if parent is None or tag in CELLS else parent.cell
        self.block = self if parent is None or tag not in INLINE else parent.block
        self.in_scope = Counter() if self.scope is self else None
        self.in_cell = Counter() if self.cell is self else None
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.best = self

    @property
    def mostly_links(self) -> bool:
        return self.link_chars * 2 > self.chars


def names_no_article(name: str, never: set[str]) -> bool:
    """Whether one class or id name calls its element one of `never`."""
    words = [w.lower() for w in NAME_WORDS.findall(name)]
    if not words or words[0] in STATE:
        return False
    return words[-1] in never or words[-1] in CONTAINER and not never.isdisjoint(words[:-1])


def is_no_article(tag: str, attrs: str, parent: Node) -> bool:
    if tag in NEVER:
        return tag != "header" or not parent.in_article  # an article's own header holds its title
    if tag == "a" or not attrs.strip():
        return False
    never = NEVER_NAME - {"header", "banner", "masthead"} if parent.in_article else NEVER_NAME
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" and value.lower() not in ("false", "until-found") or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name == "role" and value.lower() in NEVER_ROLE:
            return True
        if name in ("class", "id") and tag not in ("body", "html", "main") and any(names_no_article(v, never) for v in value.split()):
            return True
    return False


def entered(child: Node, opened: Counter[str]) -> Node:
    opened[child.tag] += 1
    child.parent.scope.in_scope[child.tag] += 1
    child.parent.cell.in_cell[child.tag] += 1
    return child


def left(node: Node, upto: Node, opened: Counter[str]) -> Node:
    """`upto`, with all that is open below it closed."""
    while node is not upto:
        opened[node.tag] -= 1
        node.parent.scope.in_scope[node.tag] -= 1
        node.parent.cell.in_cell[node.tag] -= 1
        node = node.parent
    return upto


def above(node: Node, tags: set[str]) -> Node:
    """The nearest of `tags` upwards, of which one is open."""
    while node.tag not in tags:
        node = node.parent
    return node


def parse(page: str) -> Node:
    """A tree by the main rules of HTML: void and raw elements, ends that may be left out,
    blocks that close an open paragraph with the inline elements in it.

    What is open is counted by name, in each scope and cell, so an element is only looked
    for where one is open; finding it closes all that was passed.
    """
    root = node = Node("html", None, False)
    opened: Counter[str] = Counter()
    at = 0
    match = MARKUP.search(page)
    while match:
        if match.start() > at:
            node.children.append(page[at : match.start()])
        at = match.end()
        tag = (match["tag"] or "").lower()
        if match["cdata"]:
            node.children.append(html.escape(match["cdata"]))
        if not tag:
            pass
        elif match["close"]:
            if (node.cell.in_cell if tag in INLINE else opened)[tag] > 0:
                node = left(node, above(node, {tag}).parent, opened)
        elif tag == "html" or tag == "body" and any(isinstance(c, Node) and c.tag == "body" for c in root.children):
            pass
        else:
            if tag == "body":
                node = left(node, root, opened)
            if tag in CLOSES_P:
                if node.block.tag == "p":
                    node = left(node, node.block.parent, opened)
            elif any(node.scope.in_scope[t] > 0 for t in ENDS.get(tag, ())):
                found = above(node, ENDS[tag])
                node = left(node, found.parent, opened)
                if tag == "tr" and node.tag == "tr":
                    node = left(node, node.parent, opened)
            child = Node(tag, node, is_no_article(tag, match["attrs"], node))
            node.children.append(child)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                if not child.no_article:
                    child.children.append(page[at : end.start() if end else len(page)])
                at = end.end() if end else len(page)
            elif tag not in VOID and not match["attrs"].endswith("/"):
                node = entered(child, opened)
        match = MARKUP.search(page, at)
    if at < len(page):
        node.children.append(page[at:])
    return root


def heads_comments(node: Node) -> bool:
    """Whether the first heading among a block's children says that comments follow."""
    if node.tag not in ("div", "section", "ol", "ul"):
        return False
    first = next((c for c in node.children if isinstance(c, Node) or c.strip()), None)
    if not isinstance(first, Node) or first.tag not in HEADINGS:
        return False
    return COMMENTS_HEADING.fullmatch("".join(c for c in first.children if isinstance(c, str))) is not None


def text_chars(text: str) -> int:
    return len(SPACE.sub(" ", html.unescape(text)).strip())


def measured(root: Node) -> list[Node]:
    """All nodes in page order, without those that are no article, with their counts,
    densities, sums and the best (largest sum) of their subtree.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or not (c.no_article or heads_comments(c))]
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    own = {}
    for node in reversed(order):
        own[node] = sum(text_chars(c) for c in node.children if isinstance(c, str))
        node.chars = own[node]
        for c in node.children:
            if isinstance(c, Node):
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.chars if c.tag == "a" else c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
    body = next((n for n in order if n.tag == "body"), root)
    ratio = body.link_chars / max(1, body.chars)
    for node in reversed(order):
        if node.chars:
            free = max(1, node.chars - node.link_chars)
            base = math.log(node.chars / free * node.link_chars + ratio * node.chars + math.e)
            inner = node.chars / max(1, node.link_chars) * max(1, node.tags) / max(1, node.link_tags)
            node.density = node.chars / max(1, node.tags) * max(0.0, math.log(inner) / base if inner > 1 else 0.0)
        # characters of the node's own text count with its children
        inside = [c for c in node.children if isinstance(c, Node)]
        node.sum = own[node] + sum(c.density for c in inside)
        node.best = max([node, *(c.best for c in inside if c.tag not in INLINE)], key=lambda n: n.sum)
    return order


def up_to(node: Node, top: Node) -> list[Node]:
    path = [node]
    while path[-1] is not top and path[-1].parent is not None:
        path.append(path[-1].parent)
    return path


def content(root: Node) -> tuple[set[Node], set[Node]]:
    """The nodes whose subtrees are the main text, and those within that are blocks of
    links. Marks are the part of the largest density sum and, of every other subtree as
    dense as the threshold, its part of the largest sum.
    """
    order = measured(root)
    body = next((n for n in order if n.tag == "body"), root)
    threshold = min(n.density for n in up_to(body.best, body))
    marks, stack = [], [body]
    while stack:
        node = stack.pop()
        inside = [node]
        if node.chars and node.density >= threshold and (node is body or not node.mostly_links) and node.tag not in INLINE:
            marks.append(node.best)
            inside = up_to(node.best, node)[1:]
        on_path = {node.best, *inside}
        stack += [c for n in inside for c in n.children if isinstance(c, Node) and c not in on_path]
    chosen, of_articles = set(), any(n.tag == "article" for m in marks for n in up_to(m, body))
    for mark in marks:
        path = up_to(mark, body)
        around = next((n for n in path if n.tag == "article"), None) or next((n for n in path if n.tag == "main"), mark)
        if around.tag == "main" and of_articles:
            around = mark
        chosen.add(around)
        for node in up_to(around, body)[:-1]:
            before = node.parent.children[: node.parent.children.index(node)]
            chosen.update(c for c in before if isinstance(c, Node) and c.tag in HEADINGS | {"header", "hgroup"} and not c.mostly_links)
    links = {n for n in order if n.tag in ("div", "section", "ul", "ol", "dl", "table") and n.link_tags > 1 and n.mostly_links and n.density < threshold}
    return chosen, links


def main_text(page: str) -> str:
    """The blocks of the main text in page order, joined by two new lines."""
    root = parse(page)
    chosen, links = content(root)
    blocks, line = [], []

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(line))).strip()
        if text:
            blocks.append(text)
        line.clear()

    stack: list[tuple[Node | str | None, bool]] = [(root, False)]
    while stack:
        node, within = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            if within:
                line.append(node)
        elif node not in links:
            block, within = node.tag not in INLINE, within or node in chosen
            if block:
                flush()
                stack.append((None, within))
            if node.tag == "br" and within:
                line.append(" ")
            stack.extend((c, within) for c in reversed(node.children))
    flush()
    return "\n\n".join(blocks)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of `pages` (page_id, url, html; further
    columns are left alone), repeated rows and null ids too; no rows give none. Null or
    empty html, and pages of nothing but menus and the like, have an empty text.
    """
    rows_per_batch(pages.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(
        extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    )
