"""Main text of web pages by composite text density.

A page becomes a tree of elements.  Elements that are no text of an article by
what they are (scripts, menus, forms) or are named (class, id or role of a
sidebar, notice, advert or comments) go first.  Of every node that is left the
density is its characters for each tag, adjusted by how many of them stand in
links.  The node whose children's densities have the largest sum is the text;
the least density on the way from the body to it is the threshold that decides
which nodes beside that way belong to it as well.  Pages are independent: Spark
deals them, and each batch is parsed where it is.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.llm.common import own, packed, text_of

_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+|=)*+"""
#: Comments, declarations, and tags as browsers tell them; what is left open ends with the page.
_MARKUP = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|</(?:[^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
#: Attributes that tell what an element is.
_OF_NOTE = re.compile(r"class|\bid|role|hidden|style", re.I)

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_RAW_ENDS = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are no text of an article, whatever is in them.
NEVER = frozenset("script style head title template noscript iframe noembed noframes object embed applet svg math canvas audio video map button select option optgroup datalist textarea input meter progress dialog menu nav aside footer rp".split())
#: An opening tag on the left closes an open one of those on the right, up to an element that holds them.
_PARAGRAPH_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul dd dt li".split())
_CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "optgroup": ("option optgroup", "select")}
_CLOSES |= {t: ("tr td th thead tbody tfoot caption", "table") for t in ("thead", "tbody", "tfoot")}
_CLOSES = {t: (frozenset(ends.split()), frozenset(scopes.split())) for t, (ends, scopes) in _CLOSES.items()}
_P, _IN_HEAD = frozenset({"p"}), frozenset("title style script meta link base basefont bgsound noscript template noframes".split())
_SCOPES = frozenset("body table td th caption button object template".split())

#: Words of a class or id that name what surrounds an article.
NAMES = frozenset(
    "ad ads adbox adslot adsense adsbygoogle advert adverts advertisement advertisements advertising advertorial sponsor sponsored sponsors promo promos promotion promotions banner banners "
    "nav navbar navigation navigations menu menus submenu breadcrumb breadcrumbs crumbs pagination pager paginator toolbar topbar skip skiplink header masthead footer footnav colophon copyright "
    "sidebar sidebars rail aside widget widgets related recommended recommendations share sharing shares social addthis newsletter subscribe subscription signup login signin search searchform "
    "cookie cookies consent gdpr ccpa notice notices notification notifications alert alerts popup popups popover modal overlay lightbox tooltip paywall form forms werbung anzeige publicite publicidad".split()
)
COMMENTS = frozenset("comment comments commentlist respond responses replies reply disqus discussion kommentar kommentare commentaire commentaires comentario comentarios".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist tooltip status log".split())
#: Such a word before another tells how the page looks, not what the element is.
_HAS = frozenset("has with without no is not".split())
_STATE = frozenset("open closed enabled disabled on off".split())
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
#: Elements that their names don't condemn.
_KEPT = _HEADINGS | {"article", "h1"}
#: A heading that opens readers' comments.
_COMMENT_HEADING = re.compile(r"\W*(?:\d+\s+(?:comments?|responses?|replies|kommentare?|commentaires?|comentarios?)\b.{0,80}|(?:(?:reader|user)s?['’]?s?\s+)?comments?(?:\s*\(?\d+\)?)?|leave a (?:comment|reply)|kommentare|commentaires|comentarios)\W*", re.I | re.S)
#: Characters outside links of a node beside the way, at least.
BESIDE = 80


class Node:
    """An element; its children are nodes and strings."""

    __slots__ = ("blocks", "chars", "density", "inside", "link_chars", "link_tags", "names", "own", "parent", "role", "hidden", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None = None):
        self.tag, self.parent, self.inside = tag, parent, []
        self.names, self.role, self.hidden = (), "", False
        self.chars = self.own = self.link_chars = self.tags = self.link_tags = 0
        self.blocks = False


def _spaced(text: str) -> str:
    """White space as one space, none at the ends."""
    return " ".join(text.split())


def _described(node: Node, attributes: str) -> None:
    """Names of a node: the words of its class and id, but for tokens like has-sidebar or comments-closed."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    node.role = found.get("role", "").strip().lower()
    node.hidden = "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or bool(_HIDDEN.search(found.get("style", "")))
    words = [[w.lower() for w in _PIECES.findall(token)] for token in f"{found.get('class', '')} {found.get('id', '')}".split()]
    node.names = tuple(w for token in words if token and token[0] not in _HAS and _STATE.isdisjoint(token) for w in token)


def parse(page: str) -> list[Node]:
    """The elements of a page's body, which is the first, parents before children; tags that are left open or closed too often are mended as browsers do.

    Nesting goes no deeper than 500 elements: beyond that, an element's text is
    its ancestor's.  Time grows with the page's length.
    """
    root = Node("body")
    stack, at, size, order = [root], 0, len(page), [root]

    def text(until: int) -> None:
        if until > at:
            found = page[at:until]
            if stack[-1].tag == "head":
                if not found.strip():
                    return
                stack.pop()
            found = html.unescape(found)
            whole = _spaced(found)
            stack[-1].own += len(whole)
            # White space at the ends may part this text from what an inline element beside it holds.
            stack[-1].inside.append(f"{' ' * found[0].isspace()}{whole}{' ' * found[-1].isspace()}" if whole else " ")

    def close(tags: frozenset[str], scopes: frozenset[str]) -> bool:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return True
            if stack[k].tag in scopes:
                return False
        return False

    for m in iter(lambda: _MARKUP.search(page, at), None):
        text(m.start())
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in ("html", "body"):
            if tag == "body" and not m[1]:
                close(frozenset({"head"}), frozenset())
            continue
        if m[1]:
            if tag == "br":
                stack[-1].inside.append(Node("br", stack[-1]))
            else:
                close(frozenset({tag}), frozenset() if tag in ("table", "template") else _SCOPES - {tag})
            continue
        if stack[-1].tag == "head" and tag not in _IN_HEAD:
            stack.pop()
        if tag in _PARAGRAPH_ENDS:
            close(_P, _SCOPES)
        if tag in _CLOSES:
            while close(*_CLOSES[tag]):
                pass
        node = Node(tag, stack[-1])
        if m[3] and _OF_NOTE.search(m[3]):
            _described(node, m[3])
        stack[-1].inside.append(node)
        order.append(node)
        if tag in RAW:
            end = _RAW_ENDS[tag].search(page, at)
            at = end.start() if end else size
        elif tag not in VOID and len(stack) < 500:
            stack.append(node)
    text(size)
    return order


def _nodes(top: Node) -> Iterator[Node]:
    """All elements, parents first."""
    open_ = [top]
    while open_:
        node = open_.pop()
        yield node
        open_.extend(c for c in reversed(node.inside) if isinstance(c, Node))


def _within(node: Node | None, tags: set[str]) -> Node | None:
    """The outermost element of these tags that holds the node or is it."""
    found = None
    while node:
        found, node = (node if node.tag in tags else found), node.parent
    return found


def blocks(top: Node) -> Iterator[str]:
    """The text of each block in page order, white space as one space; empty ones are left out."""
    held: list[str] = []
    open_: list[Node | str | None] = [top]
    while open_:
        x = open_.pop()
        if isinstance(x, str):
            held.append(x)
            continue
        if x is None or x.tag not in INLINE:
            if whole := _spaced("".join(held)):
                yield whole
            held = []
        if x is not None:
            if x.tag not in INLINE:
                open_.append(None)
            open_.extend(reversed(x.inside))
    if whole := _spaced("".join(held)):
        yield whole


def _measure(order: list[Node]) -> None:
    """Characters, tags, and both within links, of every node with all that is in it."""
    for node in reversed(order):
        node.chars += node.own
        if node.tag == "a":
            node.link_chars = node.chars
        if above := node.parent:
            above.blocks |= node.tag not in INLINE
            above.chars += node.chars
            above.link_chars += node.link_chars
            above.tags += node.tags + 1
            above.link_tags += node.link_tags + (node.tag == "a")


def _remove(node: Node) -> None:
    """Empty a node, as if a line ended there; what it held counts no more."""
    above = node.parent
    while above:
        above.chars -= node.chars
        above.link_chars -= node.link_chars
        above.tags -= node.tags
        above.link_tags -= node.link_tags + (node.tag == "a")
        above = above.parent
    node.tag, node.inside = "br", []
    node.chars = node.own = node.link_chars = node.tags = node.link_tags = 0


def _weigh(order: list[Node]) -> None:
    """Composite text density of every node, and the sum of its children's."""
    body = order[0]
    share = body.link_chars / max(1, body.chars)
    for node in order:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
        if not c:
            node.density = 0.0
        else:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            node.density = c / t * max(0.0, math.log(c / max(1, lc) * t / max(1, lt)) / base)
        # Text beside blocks counts as a block of its own.
        node.sum = node.own if node is body or node.blocks else 0.0
    for node in order[1:]:
        node.parent.sum += node.density


def _surrounds(node: Node, whole: int, holds: bool, titled: bool) -> bool:
    """Whether a node is no part of an article, by its tag, role or names.

    holds: an article or the main element is in it; titled: a first heading is.
    """
    if not COMMENTS.isdisjoint(node.names):
        return not titled
    if node.tag in NEVER or node.hidden:
        return not (holds and node.tag in ("aside", "footer", "nav"))
    if holds or node.tag == "main" or node.chars - node.link_chars > 0.6 * whole:
        return False
    if node.tag == "form" or node.role in ROLES:
        return True
    if node.tag == "header":
        return _within(node, {"article"}) is None
    return node.tag not in _KEPT and not NAMES.isdisjoint(node.names)


def _clean(order: list[Node]) -> None:
    """Take out what surrounds an article."""
    body, order = order[0], order[1:]
    holds: set[int] = set()
    titled: set[int] = set()
    for node in reversed(order):
        comments = not COMMENTS.isdisjoint(node.names)
        if id(node) in holds or node.tag in ("main", "article") or node.role == "main":
            if not comments and node.tag not in ("aside", "nav", "footer"):
                holds.add(id(node.parent))
        if node.tag == "h1" or id(node) in titled:
            titled.add(id(node.parent))
    whole, gone = body.chars - body.link_chars, set()
    for node in order:
        if id(node.parent) in gone:
            gone.add(id(node))
        elif _surrounds(node, whole, id(node) in holds, node.tag == "h1" or id(node) in titled):
            gone.add(id(node))
            _remove(node)
    for node in order:
        if id(node.parent) in gone:
            gone.add(id(node))
        elif node.tag in _HEADINGS and _COMMENT_HEADING.fullmatch(" ".join(blocks(node))):
            around = node.parent
            # Comments are all of an element that the heading opens, or else what follows in it.
            first = next(x for x in around.inside if (x.strip() if isinstance(x, str) else x.tag != "br"))
            if first is node and around.tag in ("div", "section"):
                gone.add(id(around))
                _remove(around)
                continue
            at = around.inside.index(node)
            for x in around.inside[at:]:
                if isinstance(x, Node):
                    gone.add(id(x))
                    _remove(x)
                else:
                    around.own -= len(x.strip())
                    around.chars -= len(x.strip())
            del around.inside[at:]


def _chosen(order: list[Node]) -> list[Node]:
    """The nodes that hold the main text, in page order; order: all nodes."""
    body, best = order[0], max(order, key=lambda n: n.sum)
    if not best.sum:
        return [body]
    around = _within(best, {"article"})
    if around is None:
        around = _within(best, {"main"})
    if around is not None:
        return [around]
    way = [best]
    while way[-1] is not body and way[-1].parent is not None:
        way.append(way[-1].parent)
    threshold = min(n.density for n in way)
    chosen = [best]
    for node, above in zip(way, way[1:]):
        at = next(k for k, x in enumerate(above.inside) if x is node)
        before = [x for x in above.inside[:at] if isinstance(x, Node) and _beside(x, threshold, True)]
        after = [x for x in above.inside[at + 1 :] if isinstance(x, Node) and _beside(x, threshold, False)]
        chosen = before + chosen + after
    return chosen


def _beside(node: Node, threshold: float, before: bool) -> bool:
    """Whether a node beside the way is text as well: dense and long, or a heading of what follows."""
    if not node.chars or node.link_chars > node.chars / 3:
        return False
    if before and node.tag in ("h1", "h2"):
        return True
    return node.density >= threshold and node.chars - node.link_chars >= BESIDE


def main_text(page: str) -> str:
    """The article of a page, its blocks joined by one space; empty if it has no text."""
    order = parse(page)
    _measure(order)
    _clean(order)
    order = list(_nodes(order[0]))
    _weigh(order)
    return " ".join(b for node in _chosen(order) for b in blocks(node))


def _texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([main_text(x) for x in batch], dtype=object)


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``row`` (all columns of ``pages`` as a struct, so no names clash) and ``text``, the main text of each page.

    Null and empty pages give an empty text; a page without tags is its own
    text.  Repeated rows are each extracted, an empty table gives no rows, and
    a page is read whole whatever its length.
    """
    text = F.pandas_udf(_texts, "string")
    return packed(pages, __html=text_of(html_column) if html_column.isidentifier() else F.coalesce(own(html_column), F.lit(""))).select("row", text("__html").alias("text"))


def op13_html(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every page; see ``extract`` for nulls, empty tables and the like."""
    rows = pages.select("page_id", "url", "html")
    return extract(rows).select("row.page_id", "row.url", "text").withColumn("n_chars", F.char_length("text").cast("long"))
