"""Main-text extraction by tree scoring.

Markup is parsed into a tree with the usual implied ends (a paragraph ends where
the next block starts; unclosed inline tags end with their block).  Page
furniture is cut first: by element (nav, footer, aside, script, …), by role, or
as a form or by a word of its class or id (menu, sidebar, advert, cookie,
comments, …).  A name may also tell the layout of what is around the article
("with-sidebar", a page-wide form): such an element stays if it holds most of the
page's unlinked text together with an article, main or first heading, or two
thirds of it in three paragraphs; comments stay only with their page's main
element or first heading.  Every paragraph then scores one point, one per comma and one per 100
characters up to three, and passes the points to its ancestors: whole up to the
enclosing article or main element, halved and then divided by the distance
beyond, up to 256 levels.  A container's points are discounted by its link density; the best
container is kept, with siblings that score at least a fifth of it or that are
paragraphs of mostly unlinked text.

A null, empty or text-free page gives an empty text.  Pages are independent, so
repeated rows give repeated results; truncated pages are read as far as they
go; nesting of any depth is handled without recursion.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "script style noscript template head title nav footer aside button select option textarea input label fieldset "
    "iframe object embed svg math canvas audio video map dialog menu datalist progress meter".split()
)
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 header hgroup ul ol li dl dt dd blockquote pre table thead "
    "tbody tfoot tr td th caption figure figcaption address details summary center hr".split()
)
PARAGRAPHS = frozenset("p pre blockquote td li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
LANDMARKS = frozenset("article main".split())
ENDS_PARAGRAPH = BLOCKS - {"html", "body"} | {"nav", "footer", "aside", "form", "fieldset", "menu", "dialog"}
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar navigation menu "
    "menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond replies disqus share sharing "
    "social related recommended recommendations pagination pager skip widget widgets".split()
)
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
COMMENTS = frozenset("comment comments commentlist respond replies disqus".split())
SIBLING_SHARE = 0.2
#: levels beyond the landmark at which a container is no longer given points
FAR = 256
LAYOUT_SHARE, LAYOUT_PARAGRAPHS, LAYOUT_ALONE = 0.5, 3, 2 / 3
_WORDS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "landmark", "score", "chars", "linked", "named")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, landmark: bool = False, named: frozenset | set = frozenset()):
        self.tag, self.parent, self.dropped, self.landmark, self.named = tag, parent, dropped, landmark, named
        self.parts: list = []
        self.score, self.chars, self.linked = 0.0, 0, 0


def _furniture(tag: str, attrs: dict, in_landmark: bool) -> bool:
    """Whether an element is cut wherever it stands."""
    if tag in HIDDEN or tag == "header" and not in_landmark:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in FURNITURE_ROLES:
        return True
    if "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
        return True
    # only a comment's own article goes; other names of page-wide elements tell their layout
    return tag == "article" and not {"comment", "comments"}.isdisjoint(_WORDS.findall((attrs.get("class") or "").lower()))


def _named(tag: str, attrs: dict) -> set | frozenset:
    """The words for which an element is cut unless it proves to be the layout around the text."""
    if tag in ("html", "body", "article", "main"):
        return frozenset()
    found = FURNITURE.intersection(_WORDS.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower())) if attrs else frozenset()
    return found | {"form"} if tag == "form" else found


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.nodes: list[Node] = []
        self.open: dict[str, int] = {}

    def _close(self, tags: frozenset, stop: frozenset = frozenset()) -> None:
        """Close the nearest open element of ``tags`` unless one of ``stop`` is in between."""
        if not any(self.open.get(tag) for tag in tags):
            return
        node = self.at
        while node.parent is not None and node.tag not in tags:
            if node.tag in stop:
                return
            node = node.parent
        if node.parent is not None:
            while self.at is not node.parent:
                self.open[self.at.tag] -= 1
                self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._close(frozenset(["p"]), frozenset(["table", "button", "object"]))
        if tag in CLOSED_BY:
            self._close(CLOSED_BY[tag], frozenset(["ul", "ol", "dl", "table", "select"]) if tag != "tr" else frozenset(["table"]))
        if tag in VOID:
            if tag in ("br", "hr"):  # others stand inside a word without cutting it
                self.at.parts.append(" ")
            return
        landmark = tag in LANDMARKS
        inside = self.at.landmark or self.at.tag in LANDMARKS
        values = dict(attrs)
        node = Node(tag, self.at, self.at.dropped or _furniture(tag, values, inside), inside or landmark, _named(tag, values))
        self.at.parts.append(node)
        self.at = node
        self.nodes.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and tag not in ("script", "style", "a", "b", "i", "span"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._close(frozenset([tag]), frozenset() if tag in BLOCKS or tag in HIDDEN else BLOCKS)

    def handle_data(self, data):
        if not self.at.dropped:
            self.at.parts.append(data)

    def settle(self) -> None:
        """Cut the named elements but those that are the layout around the text."""
        if not any(node.named for node in self.nodes):
            return
        links: dict[int, bool] = {}
        free: dict[int, int] = {}
        marks: dict[int, int] = {}  # articles, main elements and first headings
        prose: dict[int, int] = {}
        every = [self.root, *self.nodes]
        for node in every:
            linked = links[id(node)] = node.tag == "a" or node.parent is not None and links[id(node.parent)]
            own = 0 if linked or node.dropped else sum(len(" ".join(p.split())) for p in node.parts if isinstance(p, str))
            free[id(node)], marks[id(node)] = own, int(node.tag in ("article", "main", "h1") and not node.dropped)
            prose[id(node)] = int(node.tag == "p" and not node.dropped)
        for node in reversed(self.nodes):
            if node.dropped or not COMMENTS.isdisjoint(node.named) and not marks[id(node)]:
                free[id(node)] = 0
                continue
            for count in (free, marks, prose):
                count[id(node.parent)] += count[id(node)]
        total = free[id(self.root)]
        for node in self.nodes:
            if node.parent.dropped:
                node.dropped = True
            elif node.named and not node.dropped:
                share = free[id(node)] / total if total else 0.0
                around = share > LAYOUT_SHARE and marks[id(node)] or share > LAYOUT_ALONE and prose[id(node)] >= LAYOUT_PARAGRAPHS
                node.dropped = not around


def _walk(root: Node):
    """Nodes that are not furniture, each before (True) and after (False) its parts, and texts."""
    stack: list = [(root, True)]
    while stack:
        item, opening = stack.pop()
        if isinstance(item, str):
            yield item, None
        elif not item.dropped:
            yield item, opening
            if opening:
                stack.append((item, False))
                stack.extend((part, True) for part in reversed(item.parts))


def _measure(root: Node) -> list[Node]:
    """Set characters, linked characters and points of every node; nodes in page order."""
    open_nodes, open_blocks, nodes, own, links = [], [], [], {}, 0
    for item, opening in _walk(root):
        if opening is None:
            text = " ".join(item.split())
            if text:
                open_nodes[-1].chars += len(text)
                if links:
                    open_nodes[-1].linked += len(text)
                own.setdefault(id(open_blocks[-1]), []).append(text)
        elif opening:
            open_nodes.append(item)
            if item.tag in BLOCKS or item.tag == "#root":
                open_blocks.append(item)
            nodes.append(item)
            links += item.tag == "a"
        else:
            open_nodes.pop()
            if open_blocks[-1] is item:
                open_blocks.pop()
            links -= item.tag == "a"
            if open_nodes:
                open_nodes[-1].chars += item.chars
                open_nodes[-1].linked += item.linked
    for node in nodes:
        text = " ".join(own.get(id(node), ()))
        if not text:
            continue
        points = 1 + text.count(",") + text.count("，") + min(len(text) // 100, 3)
        up = node.parent if node.tag in PARAGRAPHS else node
        whole, distance = True, 0
        while up is not None and distance < FAR:
            up.score += points if whole else points / (2 if distance == 1 else 3 * distance)
            whole = whole and up.tag not in LANDMARKS and up.landmark
            distance += not whole
            up = up.parent
    return nodes


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _blocks(node: Node) -> list[str]:
    """Texts of the blocks inside a node, in page order, white space folded."""
    out, run = [], []

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    for item, opening in _walk(node):
        if opening is None:
            run.append(item)
        elif item.tag in BLOCKS:
            flush()
    flush()
    return out


def main_text(html: str | None) -> str:
    """The main text of one page: blocks joined by line feeds."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    tree.settle()
    nodes = [n for n in _measure(tree.root) if n.score > 0]
    if not nodes:
        return "\n".join(_blocks(tree.root))
    best = max(nodes, key=lambda n: n.score * (1 - _density(n)))
    top = best.score * (1 - _density(best))
    kept = []
    for part in best.parent.parts if best.parent else [best]:
        if isinstance(part, str) or part.dropped:
            continue
        prose = part.tag == "p" and part.chars > 80 and _density(part) < 0.25
        if part is best or prose or part.score * (1 - _density(part)) >= max(SIBLING_SHARE * top, 1.0):
            kept.append(part)
    return "\n".join(b for node in kept for b in _blocks(node))


@F.pandas_udf(T.StringType())
def main_texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = pages.select("page_id", "url", main_texts(F.coalesce("html", F.lit(""))).alias("text"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
