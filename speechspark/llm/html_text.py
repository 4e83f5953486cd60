"""Main text of web pages by composite text density.

A page becomes a tree of elements.  Parts that are never article text (by element, role or a word of
their class or id) are pruned.  Each element's *density* is its characters per tag, adjusted by its
links: many linked characters or linked tags lower it.  Densities of an element's children are summed; the element with the
largest sum is the core.  The least density on the path from the body to the core is the threshold: the
core is widened to the outermost article or main element on that path, or else to the topmost ancestor
below the body whose density reaches the body's; parts of it that are mostly links and lie
below the threshold are left out, but for lists and tables between paragraphs and all of an article.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split())
#: Elements whose content is no text of the article.
DROPPED = frozenset(
    "head title nav header footer aside form script style noscript template iframe object embed applet button select option "
    "textarea input label fieldset svg math canvas audio video map menu dialog frame frameset noframes datalist".split())
#: Elements that hold raw text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class or id that mark boilerplate.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adsense banner banners sponsor sponsored sponsors promo "
    "promos promotion promotions nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead footer "
    "sidebar sidebars aside widget widgets comment comments commentlist reply replies respond disqus discussion cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations toolbar disclaimer skip hidden".split())
#: Elements whose id is a mark left by their own heading, such as "related-work", and not a kind of part.
HEADED = frozenset("h1 h2 h3 h4 h5 h6 p dt dd li td th blockquote pre figure".split())
#: Whole ids that mark a section all the same.
SECTION_IDS = frozenset("comments commentlist respond disqus sidebar navigation nav navbar breadcrumbs pagination newsletter subscribe footer header".split())
#: Elements with no end tag of their own inside which an article ends the part that is left out.
LOST_ENDS = frozenset("head nav header form p li ul".split())
#: What a head may hold.
HEAD = frozenset("title meta link script style base noscript template".split())
#: An open element of the first kind ends when one of the second begins.
ENDS = {
    "p": BLOCKS - frozenset("body html td th tr tbody thead tfoot caption legend option optgroup summary".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
#: An implied end doesn't reach beyond these.
WALLS = frozenset("table ul ol dl div article section main aside body html blockquote form nav header footer td th".split())

#: Quotes have a meaning behind an equals sign alone.
_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"'][^\s>]*)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: A class with one of these describes a layout around the text, such as "content-with-sidebar".
LAYOUT = frozenset("with has no without layout".split())
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "parts", "cut", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, pruned: bool = False):
        self.name, self.parent, self.parts = name, parent, []
        #: The outermost pruned element around this one, itself included.
        self.cut = parent.cut if parent is not None and parent.cut is not None else self if pruned else None
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _boilerplate(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, raw = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        value = raw.lower()
        if key == "id" and (name in HEADED or name == "section"):
            if name == "section" and value.strip() in SECTION_IDS:
                return True
        elif key in ("class", "id"):
            for one in raw.split():
                parts = {one.lower(), *(x.lower() for x in _NAME.findall(one))}
                if not MARKED.isdisjoint(parts) and LAYOUT.isdisjoint(parts):
                    return True
        elif key == "role":
            if value.strip() in ROLES:
                return True
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _UNSEEN.search(value)):
            return True
    return False


def _opener(here: Node, name: str) -> Node | None:
    """The open element that an end tag closes.

    An end tag of a phrase closes nothing beyond a wall.  Inside a pruned element it finds its opener at any
    depth, but none around the pruned one.
    """
    node = here
    while node is not None and node.name != name:
        if name not in BLOCKS and (node is node.cut or (node.cut is None and node.name in WALLS)):
            return None
        node = node.parent
    return node


def parse(page: str) -> Node:
    """The tree of a page without its boilerplate; tolerant of missing, wrong and implied end tags.

    A pruned element is opened and closed like any other, by its own end tag, by one of an element around it or
    by what implies its end; only nothing in it is kept.
    """
    root = Node("html", None)
    here, at, n = root, 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        stop = m.start() if m else n
        if here.cut is None and stop > at:
            here.parts.append(html.unescape(page[at:stop]) if "&" in page[at:stop] else page[at:stop])
        elif here.name == "head" and page[at:stop].strip():
            here = here.parent  # text ends a head
            continue
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if closing:
            node = _opener(here, name)
            if node is not None and node.parent is not None:
                here = node.parent
            elif name == "p" and here.cut is None:
                here.parts.append(Node("p", here))
            continue
        cut = here.cut
        if cut is not None and (
            (name in ("article", "main") and cut.name in LOST_ENDS) or (cut.name == "head" and (name == "body" or (here is cut and name not in HEAD)))
        ):
            here = cut.parent  # its end tag is missing
        if name in VOID:
            if name in ("br", "hr") and here.cut is None:
                here.parts.append(Node(name, here))
            continue
        if name in ("html", "body"):
            if name == "body" and here is root:
                here = Node("body", root)
                root.parts.append(here)
            continue
        if name in BLOCKS or name in ENDS:
            node = here
            while node.parent is not None:
                if name in ENDS.get(node.name, ()):
                    here = node.parent
                    node = here
                    continue
                if node.name in WALLS:
                    break
                node = node.parent
        attributes = m[3]
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            if name in ("textarea", "title", "script", "style", "iframe", "noembed", "noframes"):
                continue
        pruned = _boilerplate(name, attributes)
        if pruned and attributes.endswith("/") and name in ("svg", "math"):
            continue
        child = Node(name, here, pruned)
        if child.cut is None:
            here.parts.append(child)
        here = child
    return root


def _in_order(root: Node) -> list[Node]:
    """Every node, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in reversed(node.parts) if x.__class__ is Node)
    return out


def measure(root: Node) -> list[Node]:
    """Fill in counts, densities and sums of the children's densities; all nodes, parents first."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        own = sum(len(x) - x.count(" ") - x.count("\n") for x in node.parts if x.__class__ is str)
        kids = [x for x in node.parts if x.__class__ is Node]
        node.chars = own + sum(k.chars for k in kids)
        node.tags = sum(k.tags + 1 for k in kids)
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        else:
            node.link_chars, node.link_tags = sum(k.link_chars for k in kids), sum(k.link_tags for k in kids)
    all_chars, all_links = max(root.chars, 1), root.link_chars
    for node in nodes:
        c, lc = node.chars, node.link_chars
        if not c:
            continue
        tags, lt = max(node.tags, 1), max(node.link_tags, 1)
        plain = max(c - lc, 1)
        base = math.log(c / plain * lc + all_links / all_chars * c + math.e)
        node.density = c / tags * math.log(max(c / max(lc, 1) * tags / lt, 1.0) + 1.0) / math.log(base + 1.0)
    for node in nodes:
        node.total = sum(x.density for x in node.parts if x.__class__ is Node)
    return nodes


def _core(root: Node) -> tuple[Node, float]:
    """The subtree to read and the threshold for its parts."""
    nodes = measure(root)
    body = next((x for x in nodes if x.name == "body"), root)
    best = max(nodes, key=lambda x: x.total)  # the first of equals
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    marked = [x for x in path if x.name in ("article", "main")]
    if marked:
        return marked[-1], threshold
    inner = [x for x in path if x is not body and x is not root]
    wide = [x for x in inner if x.density >= body.density]
    top = wide[-1] if wide else best
    # Paragraphs straight below the chosen part's parents belong to the text as well.
    loose = [x for x in path if any(y.__class__ is Node and y.name in ("p", "h1", "h2") and y.chars and y.link_chars * 2 < y.chars for y in x.parts)]
    if loose and path.index(loose[-1]) > (path.index(top) if top in path else -1):
        top = loose[-1]
    return top, threshold


def _linked(x: Node, threshold: float) -> bool:
    """Mostly links, below the threshold, and no plain block of text by its kind."""
    return x.link_chars * 2 > x.chars and x.density < threshold and x.name not in ("p", "td", "th", "h1", "h2", "h3", "li")


def _between(parent: Node) -> set[int]:
    """Of an element's parts, the lists and tables (by identity) between its text paragraphs or headings."""
    kin = [y for y in parent.parts if y.__class__ is Node]
    plain = [k for k, y in enumerate(kin) if y.name in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and y.link_chars * 2 < y.chars]
    return {id(y) for y in kin[plain[0]:plain[-1]] if y.name in ("ul", "ol", "dl", "table")} if plain else set()


def _text(top: Node, threshold: float) -> str:
    """Blocks of a subtree in page order; an article or main element loses no lists of links."""
    whole = top.name in ("article", "main")
    blocks: list[str] = []
    run: list[str] = []
    kept: dict[int, set[int]] = {}

    def between(parent: Node) -> set[int]:
        if id(parent) not in kept:
            kept[id(parent)] = _between(parent)
        return kept[id(parent)]

    def flush() -> None:
        if run:
            block = _WHITE.sub(" ", "".join(run)).strip()
            if block:
                blocks.append(block)
            run.clear()

    todo: list = [top]
    while todo:
        x = todo.pop()
        if x.__class__ is str:
            run.append(x)
        elif x is None:
            flush()
        else:
            if x.name == "br":
                run.append(" ")
                continue
            block = x.name in BLOCKS
            if block and x is not top and not whole and _linked(x, threshold) and id(x) not in between(x.parent):
                flush()
                continue
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(x.parts))
    flush()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    """Main text of one page; empty for a null or empty page and for pages of boilerplate only."""
    if not page:
        return ""
    root = parse(page)
    return _text(*_core(root))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Id, url, ``text`` (empty if none) and ``n_chars`` (code points) of every row.

    Pages are handled one by one, whole, in batches; the work is linear in a page's length but for missing end
    tags, which cost a walk up the open elements.  A pruned element without an end tag ends where HTML implies
    its end or an element around it ends.  Null ids and
    urls stay null, repeated rows repeat, other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x.as_py()) for x in b.column(2)]
            text = [x if x.isascii() else x.encode("utf-8", "replace").decode() for x in text]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                names=["i", "u", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("h"))
    kind = rows.schema["i"].dataType.simpleString()
    return rows.mapInArrow(run, f"i {kind}, u string, text string, n_chars long").withColumnsRenamed({"i": id_col, "u": url_col})
