"""Main text of web pages by scoring the tree.

A page is read into a tree of elements, forgiving the usual faults: paragraphs and list items that
nothing closes, end tags without a start, quotes that stay open, text cut off in a tag. Elements that
are never the article by their kind, role or name are left out, but none by role or name that holds an
article element or the bulk of the points; a name that only has such a word in it counts against its element. Paragraphs pass points, for their
length and commas, to their ancestors, less with each level, and each ancestor's sum is discounted by its
share of text in links. The best container is kept, with those of its siblings that score alike; outside
article elements also with all beside it that is not mostly links: headings, short paragraphs, lists, loose text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelflot.llm.common import extend, table

RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed", "noframes", "svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
#: Elements that are never the article.
LEFT_OUT = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "audio", "video", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "toolbar", "form", "alertdialog"}
#: Kinds that are left out unless they hold the article, as where a form is wrapped around a whole page.
WRAPPERS = {"form", "fieldset"}
#: Words of a class or id that say that an element is none of the article if its other words are neutral.
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adsense", "banner", "breadcrumb", "breadcrumbs",
    "combx", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "form", "gdpr", "header", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pagination", "pager", "popup", "privacy", "promo",
    "promoted", "recommended", "related", "remark", "replies", "respond", "rss", "share", "sharing", "shoutbox", "sidebar", "signup", "skyscraper",
    "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
#: Words that take nothing from what the other words of a name say: places, containers, kinds of list.
NEUTRAL = {
    "area", "bar", "block", "body", "bottom", "box", "container", "content", "group", "holder", "inner", "item", "items", "left", "list", "main",
    "outer", "page", "panel", "post", "posts", "reader", "right", "section", "site", "slot", "sticky", "thread", "top", "unit", "user", "wrap", "wrapper",
}
#: What :func:`left_out` says of an element: for good; unless it holds the article; only where it is full of links.
FOR_GOOD, UNLESS_HOLDING, DOUBTFUL = 1, 2, 3
#: Share of the points of its article, or else of the page, from which an element is not left out.
BULK = 0.75
#: Share of links from which a doubtful element is left out, and what its name leaves of its worth.
LINKED, DOUBT = 0.25, 0.25
ARTICLE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An element of the first kind ends an open one of the second kinds, unless a third lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
SCOPE = {"article", "main", "section", "div", "body", "td", "th", "li", "blockquote", "table", "aside", "nav", "header", "footer", "form"}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/]|$)""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "inside", "skip", "doubt", "points", "text", "linked")

    def __init__(self, tag: str, parent: Node | None, skip: bool = False):
        self.tag, self.parent, self.skip, self.doubt = tag, parent, skip, False
        self.inside: list[Node | str] = []
        self.points, self.text, self.linked = 0.0, 0, 0


def left_out(tag: str, attributes: str) -> int:
    """Whether an element is none of the article by its kind, role, names or because it is hidden; 0 if not."""
    if tag in LEFT_OUT and tag not in WRAPPERS:
        return FOR_GOOD
    said = UNLESS_HOLDING if tag in WRAPPERS else 0
    if not attributes or tag in ARTICLE or tag in ("html", "body"):
        return said
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return FOR_GOOD
        if key == "role" and value.lower() in ROLES:
            said = UNLESS_HOLDING
        if key in ("class", "id") and said != UNLESS_HOLDING:
            for name in value.split():
                words = {w.lower() for w in _WORD.findall(name) if not w.isdigit()}
                if not words & NAMES:
                    continue
                if words <= NAMES | NEUTRAL:
                    said = UNLESS_HOLDING
                    break
                said = DOUBTFUL
    return said


def _judged(root: Node, judged: list[tuple[Node, int]]) -> None:
    """Mark which of the elements that may be left out are, in page order; nothing is where the article is."""
    points, sizes, links, holding = {}, {}, {}, set()
    wanted = {id(n) for n, _ in judged}
    for element, text, linked in blocks(root):
        value = 0.0 if element.tag in HEADINGS else _points(text, linked)
        node, article = element, False
        while node:
            key = id(node)
            if key in wanted or node.tag in ARTICLE or node is root:
                points[key] = points.get(key, 0.0) + value
                sizes[key] = sizes.get(key, 0) + len(text)
                links[key] = links.get(key, 0) + linked
                if article:
                    holding.add(key)
                article = article or node.tag in ARTICLE
            node = node.parent
    for node, said in judged:
        key, around = id(node), node.parent
        while around is not root and around.tag not in ARTICLE:
            around = around.parent
        bulk = points.get(key, 0.0) > BULK * points.get(id(around), 0.0)
        node.doubt = True
        if bulk or key in holding and around is root:
            continue
        node.skip = said == UNLESS_HOLDING or links.get(key, 0) >= LINKED * max(sizes.get(key, 0), 1)


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("#root", None)
    here, at, end = root, 0, len(page)
    judged: list[tuple[Node, int]] = []
    endless: set[str] = set()
    while at < end:
        begin = page.find("<", at)
        if begin < 0:
            begin = end
        if begin > at:
            here.inside.append(html.unescape(page[at:begin]))
        if begin == end:
            break
        if page.startswith("<!--", begin):
            close = page.find("-->", begin + 4)
            at = end if close < 0 else close + 3
            continue
        if page[begin + 1 : begin + 2] in ("!", "?"):
            close = page.find(">", begin)
            at = end if close < 0 else close + 1
            continue
        found = _TAG.match(page, begin) or _LOOSE.match(page, begin)
        if not found:
            follows = page[begin + 1 : begin + 3].lstrip("/")
            if follows[:1].isalpha():  # cut off inside a tag
                break
            here.inside.append("<")
            at = begin + 1
            continue
        closing, tag, attributes = found.group(1), found.group(2).lower(), found.group(3)
        at = found.end()
        if closing:
            here = _closed(here, tag)
        elif tag in RAW:
            if tag in ("svg", "math") and attributes.endswith("/") or tag in endless:
                continue
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if close:
                stop = page.find(">", close.end())
                at = end if stop < 0 else stop + 1
            elif tag in ("script", "style"):
                at = end
            else:  # no end follows: only the start tag is passed over
                endless.add(tag)
        elif tag in VOID:
            here.inside.append(" ")
        else:
            here = _opened(here, tag)
            said = left_out(tag, attributes)
            child = Node(tag, here, said == FOR_GOOD)
            if tag == "header" and said and _inside(here, ARTICLE):
                child.skip = False  # its headings belong to the article
            elif said > FOR_GOOD:
                judged.append((child, said))
            here.inside.append(child)
            if not attributes.endswith("/"):
                here = child
    if judged:
        _judged(root, judged)
    return root


def _inside(node: Node | None, tags: set[str]) -> bool:
    while node:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def _opened(here: Node, tag: str) -> Node:
    """Where a new element goes: an open paragraph ends at the next block, a list item at the next."""
    kinds, limit = ENDS.get(tag, (set(), set()))
    if tag not in INLINE:
        node = here
        while node.parent and node.tag not in SCOPE:
            if node.tag == "p" or node.tag in HEADINGS and tag in HEADINGS:
                here = node.parent
                break
            node = node.parent
    if kinds:
        node, found = here, None
        while node.parent and node.tag not in limit:
            if node.tag in kinds:
                found = node
            node = node.parent
        if found:
            here = found.parent
    return here


def _closed(here: Node, tag: str) -> Node:
    """Where text goes on after an end tag; one without a start changes nothing."""
    node = here
    while node.parent:
        if node.tag == tag:
            return node.parent
        if tag in INLINE and node.tag not in INLINE or tag == "p" and node.tag in SCOPE:
            return here
        node = node.parent
    return here


def blocks(node: Node) -> Iterator[tuple[Node, str, int]]:
    """Every block of text below a node in page order: its element, its text, its length in links."""
    parts: list[str] = []
    owner, linked = node, 0
    stack: list[tuple[Node, Iterator, bool, Node]] = [(node, iter(node.inside), False, node)]

    def block():
        text = _SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        return text

    while stack:
        current, inside, in_link, element = stack[-1]
        child = next(inside, None)
        if child is None:
            stack.pop()
            if current.tag not in INLINE:
                if text := block():
                    yield owner, text, linked
                linked = 0
        elif isinstance(child, str):
            if not parts or not linked and not "".join(parts).strip():
                owner = element
            if not (element.tag == "header"):
                parts.append(child)
                if in_link:
                    linked += len(child.strip())
        elif not child.skip:
            if child.tag not in INLINE:
                if text := block():
                    yield owner, text, linked
                linked = 0
            stack.append((child, iter(child.inside), in_link or child.tag == "a", element if child.tag in INLINE else child))


def _points(text: str, linked: int) -> float:
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - min(linked / len(text), 1))


def extract(page: str | None) -> str:
    """The main text of a page, one line for each block; empty for NULL and for pages without text."""
    if not page:
        return ""
    root = parse(page)
    found = list(blocks(root))
    candidates: dict[int, Node] = {}
    for element, text, linked in found:
        node = element
        while node:  # how much of an element's text lies in links
            node.text += len(text)
            node.linked += linked
            node = node.parent
        if element.tag in HEADINGS:
            continue
        points = _points(text, linked)
        share, node, level = 1.0, element.parent or element, 0
        while node and level < 5:
            if node.tag != "#root" or node is element:
                node.points += points * share
                candidates[id(node)] = node
            level += 1
            share = 1 / (2 * level)
            node = node.parent
    if not candidates:
        return "\n".join(text for _, text, _ in found)

    def worth(node: Node) -> float:
        return node.points * (1 - node.linked / max(node.text, 1)) * (DOUBT if node.doubt else 1)

    best = max(candidates.values(), key=worth)  # of equals the first on the page
    node, article = best, False
    while node:
        if node.tag in ARTICLE:
            best, article = node, True
            break
        node = node.parent
    while not article and best.parent and best.parent.text == best.text and best.parent.tag not in ("body", "html", "#root"):
        best = best.parent  # all text of a wrapper: what is beside it counts
    kept, loose = {id(best)}, None
    if best.parent and best.tag != "body":
        least = max(3.0, 0.2 * worth(best))
        loose = None if article else best.parent
        for other in best.parent.inside:
            if isinstance(other, Node) and not other.skip and other is not best:
                dense = other.linked / max(other.text, 1)
                long = other.tag == "p" and dense < 0.25 and other.text >= 80
                beside = not article and not other.doubt and dense < LINKED
                if worth(other) >= least and dense < 0.5 or long or beside:
                    kept.add(id(other))
    lines = []
    for element, text, linked in found:
        if element is loose and linked < LINKED * len(text):
            lines.append(text)
            continue
        node = element
        while node:
            if id(node) in kept:
                lines.append(text)
                break
            node = node.parent
    return "\n".join(lines)


def main_text(df: DataFrame, html_column: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``, the main text of each page; empty for NULL or empty pages and pages without text.

    All rows and columns are kept, repeated rows too; a column named as ``out`` is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            yield [pa.array([extract(p) for p in batch.column(0).to_pylist()], pa.string())]

    return extend(df, [html_column], [T.StructField(out, T.StringType())], run)


def op1_html_text(spark: SparkSession, directory: str) -> DataFrame:
    """The main text of every page."""
    found = main_text(table(spark, directory, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
