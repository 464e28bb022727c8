"""Main text of web pages by composite text density.

A page becomes a tree of its block elements. Text density of a node is its
characters per tag, adjusted for links: characters in links count against it by
the logarithm of a base that grows with the page's own share of link text. The
density sum of a node adds the densities of its children (its own loose text
counts as a child). The subtree with the largest sum is the main text; further
parts of the body join it where their density reaches the threshold, the least
density on the path from the body to that subtree.

Elements that a page itself names as something else (navigation, footer, aside,
forms, scripts, styles) are left out of the tree. Class, id and role names such as
"cookie", "advert" or "comments" count only as whole known names ("comment-list",
not "related-work") and never on articles, headings and paragraphs. Elements they
name are measured first: one that is mostly links goes; one that is not goes only
by a name that no text has for itself, and not where it holds most of the page's
text, unless articles outside it hold text in some proportion to it.

Defined cases: null and empty html and pages without text give an empty text;
markup that is never closed or cut off ends with the page; repeated rows are
returned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
                     "main menu nav ol p pre section table ul".split())
#: An open element of the second kind ends where one of the first begins (up to the nearest list or table).
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "thead": ("thead", "tbody"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table select article section main div body html".split())
#: Elements that are no part of an article.
OUT = frozenset("head script style noscript template iframe noembed noframes object svg canvas math nav footer aside form fieldset button select "
                "option textarea input dialog menu xmp audio video map".split())
#: Words of class names for such parts; the element goes unless it holds most of the page's text (``_Tree.gone``) ...
SURE = frozenset("ad ads adv advert adverts advertisement advertisements adsense sponsored promo cookie cookies gdpr popup newsletter nav navbar menubar "
                 "breadcrumb breadcrumbs pagination pager sidebar complementary contentinfo footer masthead topbar toolbar comment comments commentlist "
                 "disqus sharebar searchbox".split())
#: ... of ids, which often name the subject of a section ...
SURE_IDS = frozenset("ad ads advert adverts adsense nav navbar pagination sidebar footer masthead topbar comments commentlist disqus".split())
#: ... of roles. Further words may as well be a text's own: the element goes only where it is mostly links.
SURE_ROLES = frozenset("alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
DOUBTFUL = frozenset("advertising sponsor promotion banner consent notice notices alert modal overlay toast subscribe subscription paywall navigation menu "
                     "aside header respond reply replies discussion social share sharing related recommended recommendations widget widgets login "
                     "signup search skip hidden".split()) | SURE
SURE_NAMES = frozenset("site-header global-header".split())
#: Words that may stand beside them in a name; any other makes it a name of its own ("tag-search", "related-work").
FRAME = frozenset("area article bar block bottom box button buttons container entry form global inner item items left link links list main outer "
                  "page panel post primary right secondary section site slot thread top unit wrap wrapper".split())
#: Elements that class words never leave out.
TEXT = frozenset("html body main article h1 h2 h3 h4 h5 h6 p blockquote pre code figure figcaption dt dd".split())
#: A whole tag without another "<" in it, by far the most frequent case; it looks no further than to the next "<".
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*)((?:[^<>\"']|\"[^<\"]*\"|'[^<']*')*)>")
_SPECIAL, _NAME_END = re.compile("[>\"']"), re.compile(r"[\s/>]")
#: Decimal references so long that no character has their number (and Python does not read them).
_HUGE = re.compile(r"&#[0-9]{1000,};?")
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.I)
_WORD = re.compile(r"[^-_:]+")


class Node:
    __slots__ = ("children", "density", "inline_tags", "link", "link_tags", "name", "parent", "size", "sum", "tags")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent = name, parent
        self.children: list[Node | str] = []
        self.size = self.link = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0


class _Markup:
    """The tags, comments and CDATA sections of a page in order.

    What begins like a tag and has an open quote up to the page's end is text. Every search remembers where it came to, so
    the whole page takes a time in proportion to its length, whatever it holds.
    """

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.next_special = self.next_name_end = self.next_cdata_end = -1
        self.tag_end: dict[int, int] = {}  # from a ">" or quote outside of quotes to the end of its tag; -1: none

    def _first(self, pattern: re.Pattern, at: int) -> int:
        m = pattern.search(self.page, at)
        return m.start() if m else self.size

    def _end_of_tag(self, at: int) -> int:
        """Behind the tag whose attributes begin at ``at``, or -1."""
        if self.next_special < at:
            self.next_special = self._first(_SPECIAL, at)
        place, passed = self.next_special, []
        while place not in self.tag_end:
            passed.append(place)
            if place == self.size:
                end = self.size
                break
            if self.page[place] == ">":
                end = place + 1
                break
            close = self.page.find(self.page[place], place + 1)
            if close < 0:
                end = -1
                break
            place = self._first(_SPECIAL, close + 1)
        else:
            end = self.tag_end[place]
        self.tag_end.update(dict.fromkeys(passed, end))
        return end

    def __iter__(self) -> Iterator[tuple[int, str, str, str]]:
        """(start, end, kind, name or text, attributes); kind is "open", "close", "cdata" or "" (nothing that shows).

        The receiver may send a place from which to go on.
        """
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            plain = _PLAIN.match(page, at)
            if plain:
                close, name, attrs = plain.groups()
                found = ("close" if close else "open", name.lower(), attrs, plain.end())
            elif page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                found = ("", "", "", self.size if end < 0 else end + 3)
            elif page.startswith("<![CDATA[", at) and self._cdata_end(at) < self.size:
                found = ("cdata", page[at + 9:self.next_cdata_end], "", self.next_cdata_end + 3)
            elif page.startswith(("<!", "<?"), at):
                end = page.find(">", at + 2)
                found = ("", "", "", self.size if end < 0 else end + 1)
            else:
                begin = at + 1 + page.startswith("/", at + 1)
                letter = page[begin:begin + 1]
                end = -1
                if letter.isascii() and letter.isalpha():
                    if self.next_name_end < begin:
                        self.next_name_end = self._first(_NAME_END, begin)
                    end = self._end_of_tag(self.next_name_end)
                if end < 0:
                    at += 1
                    continue
                stop = end - 1 if page[end - 1] == ">" else end
                found = ("open" if begin == at + 1 else "close", page[begin:self.next_name_end].lower(), page[self.next_name_end:stop], end)
            go_on = yield at, found[3], *found[:3]
            at = found[3] if go_on is None else go_on

    def _cdata_end(self, at: int) -> int:
        if self.next_cdata_end < at + 9:
            end = self.page.find("]]>", at + 9)
            self.next_cdata_end = self.size if end < 0 else end
        return self.next_cdata_end


def _left_out(name: str, attrs: str, in_article: bool) -> bool:
    """Is the element no part of an article, whatever it holds?"""
    if name in OUT:
        return True
    if name == "header":  # an article's own head stays
        return not in_article
    if not attrs or name in ("html", "body", "main"):
        return False
    return any(kind.lower() == "hidden" or kind.lower() == "aria-hidden" and "true" in (v.lower() for v in values)
               for kind, *values in _ATTR.findall(attrs))


def _named(name: str, attrs: str, in_code: bool) -> str | None:
    """"sure" or "doubtful" where a class, id or role names the element as no part of an article."""
    if not attrs or name in TEXT or name == "header" or in_code:
        return None
    found = None
    for kind, *values in _ATTR.findall(attrs):
        sure = {"class": SURE, "id": SURE_IDS, "role": SURE_ROLES}.get(kind.lower(), frozenset())
        for token in next((v for v in values if v), "").lower().split():
            words = {w for w in _WORD.findall(token) if not any(c.isdigit() for c in w)}  # "ad-300x250"
            if words <= DOUBTFUL | FRAME | sure and words & (DOUBTFUL | sure):
                if words & sure or token in SURE_NAMES:
                    return "sure"
                found = "doubtful"
    return found


class _Tree:
    """Block elements, and texts with their link parts, of one page.

    A first reading keeps the elements that class words name and measures them;
    the next leaves out those of ``gone``.
    """

    def __init__(self, page: str, gone: frozenset[int] = frozenset()):
        self.out, self.number = gone, 0
        self.named: list[list] = []  # [number, kind, characters, in links, in articles] of the elements that class words name
        self.watched: list[tuple[int, list]] = []  # those open, with their depth
        self.articles = 0
        self.seen = [0, 0, 0]  # characters so far, in links, in articles
        self.root = Node("html", None)
        self.stack: list[tuple[str, Node | None]] = [("html", self.root)]  # None: left out
        self.places: dict[str, list[int]] = {}  # where in the stack the open elements of each name are
        self.blocks: list[int] = []  # ... those that are not inline
        self.scopes: list[int] = []  # ... and those that shut others in
        self.links = 0
        self.pieces: list[str] = []
        self.linked = 0
        at = 0
        lower = None
        markup = iter(_Markup(page))
        found = next(markup, None)
        while found is not None:
            start, end, kind, name, attrs = found
            self.text(page[at:start])
            at = end
            go_on = None
            if kind == "cdata":
                self.text(name)
            elif kind == "close":
                self.close(name)
            elif kind == "open":
                self.open(name, attrs)
                if name in RAW:
                    lower = page.lower() if lower is None else lower
                    if len(lower) != len(page):  # lower case of few characters is longer
                        lower = re.sub("[A-Z]", lambda x: x.group().lower(), page)
                    stop = lower.find(f"</{name}", at)
                    stop = len(page) if stop < 0 else stop
                    self.text(page[at:stop])
                    at = go_on = stop
            try:
                found = markup.send(go_on)
            except StopIteration:
                found = None
        self.text(page[at:])
        self.flush()
        while self.watched:
            self.measured()

    def push(self, name: str, node: Node | None) -> None:
        place = len(self.stack)
        self.places.setdefault(name, []).append(place)
        if name not in INLINE:
            self.blocks.append(place)
        if name in SCOPE:
            self.scopes.append(place)
        self.stack.append((name, node))

    def within(self, *names: str) -> bool:
        return any(self.places.get(n) for n in names)

    def node(self) -> Node | None:
        return self.stack[-1][1]

    def text(self, raw: str) -> None:
        node = self.node()
        if raw and node is not None:
            self.pieces.append(raw)
            size = len("".join(raw.split()))
            self.seen[0] += size
            if self.links:
                self.linked += size
                self.seen[1] += size
            if self.articles:
                self.seen[2] += size

    def gone(self) -> frozenset[int]:
        """The named elements to leave out: mostly links, or surely named and not most of the page's text.

        Most of the text goes only where articles outside hold text in some proportion to it.
        """
        total, _, in_articles = self.seen
        return frozenset(number for number, kind, size, link, inside in self.named
                         if 2 * link > size or kind == "sure" and (2 * size <= total or 4 * (in_articles - inside) >= size))

    def flush(self, node: Node | None = None) -> None:
        """The text so far is a block of the node that is open."""
        node = node or self.node()
        if self.pieces:
            words = " ".join(html.unescape(_HUGE.sub("\ufffd", "".join(self.pieces))).split())
            if words and node is not None:
                node.children.append(words)
                node.link += min(self.linked, len(words))
            self.pieces, self.linked = [], 0

    def open(self, name: str, attrs: str) -> None:
        self.number += 1
        if name in CLOSES_P:
            self.until("p")
        for other in SIBLINGS.get(name, ()):
            self.until(other)
        if name == "br":
            self.pieces.append(" ")
        if name in VOID:
            if name == "hr":
                self.flush()
            return
        here = self.node()
        out = here is None or self.number in self.out or _left_out(name, attrs, self.within("article", "main"))
        if name == "body" and here is not None and not out and self.within("body"):
            return
        kind = None if out or self.out else _named(name, attrs, self.within("pre", "code"))
        if kind:
            self.named.append([self.number, kind, *self.seen])
            self.watched.append((len(self.stack), self.named[-1]))
        self.articles += name == "article"
        if name in INLINE and not out:
            if name == "a":
                self.links += 1
                here.link_tags += 1
            self.push(name, here)
            return
        if not out:
            self.flush()
            node = Node(name, here)
            here.children.append(node)
            self.push(name, node)
        else:
            if here is not None and name not in INLINE:
                self.flush()
            self.push(name, None)
            if attrs.rstrip().endswith("/") and name in ("svg", "math"):
                self.pop()

    def pop(self) -> None:
        name, node = self.stack[-1]
        below = self.stack[-2][1] if len(self.stack) > 1 else None
        if node is not None and node is not below:
            self.flush()
        if name == "a" and node is not None:
            self.links = max(0, self.links - 1)
        self.articles -= name == "article"
        self.stack.pop()
        place = self.places[name].pop()
        if self.blocks and self.blocks[-1] == place:
            self.blocks.pop()
        if self.scopes and self.scopes[-1] == place:
            self.scopes.pop()
        if self.watched and self.watched[-1][0] == len(self.stack):
            self.measured()

    def measured(self) -> None:
        element = self.watched.pop()[1]
        element[2:] = [now - before for now, before in zip(self.seen, element[2:], strict=True)]

    def down_to(self, place: int) -> None:
        while len(self.stack) > place:
            self.pop()

    def until(self, name: str) -> None:
        """Close up to the nearest open ``name`` that no element of ``SCOPE`` shuts in."""
        own = self.places.get(name)
        if own and (not self.scopes or own[-1] >= self.scopes[-1]):
            self.down_to(own[-1])

    def close(self, name: str) -> None:
        """Close up to the nearest open ``name``; a stray inline end tag does not end a block."""
        own = self.places.get(name)
        if own and not (name in INLINE and self.blocks and own[-1] < self.blocks[-1]):
            self.down_to(own[-1])


def _ordered(root: Node) -> list[Node]:
    """All nodes, parents first, without recursion (pages can be deep)."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in n.children if isinstance(c, Node)]
    return out


def measure(root: Node) -> list[Node]:
    """Composite text density and density sum of every node."""
    nodes = _ordered(root)
    for n in reversed(nodes):
        n.size = sum(len(c) if isinstance(c, str) else c.size for c in n.children)
        kids = [c for c in n.children if isinstance(c, Node)]
        n.link += sum(c.link for c in kids)
        n.link_tags += sum(c.link_tags for c in kids)
        n.tags = sum(1 + c.tags for c in kids)
    page_share = root.link / max(1, root.size)
    for n in nodes:
        if n.size:
            size, link, tags, link_tags = n.size, max(1, n.link), max(1, n.tags), max(1, n.link_tags)
            base = math.log(size / max(1, size - n.link) * n.link + page_share * size + math.e)
            n.density = size / tags * math.log(max(math.e, size / link * tags / link_tags)) / math.log(max(math.e, base))
    for n in nodes:
        n.sum = sum(c.density if isinstance(c, Node) else float(len(c)) for c in n.children)
    return nodes


def _densest(nodes: list[Node]) -> dict[int, Node]:
    """For every node the subtree in it with the largest density sum; of equal ones the deepest, then the first."""
    best: dict[int, Node] = {}
    for n in reversed(nodes):
        top = n
        for c in reversed(n.children):
            if isinstance(c, Node) and best[id(c)].sum >= top.sum:
                top = best[id(c)]
        best[id(n)] = top
    return best


def _select(nodes: list[Node]) -> tuple[set[int], set[int], float]:
    """(nodes whose whole text is taken, articles or mains they lie in, threshold)."""
    densest = _densest(nodes)
    best = n = densest[id(nodes[0])]
    threshold = best.density
    while n.parent is not None:
        n = n.parent
        threshold = min(threshold, n.density)
    marked = {id(best)}
    # Where a part of the body is as dense as the path, its own densest subtree belongs to the text too.
    for n in nodes:
        if n.parent is not None and n.density >= threshold and n.density > 0:
            marked.add(id(densest[id(n)]))
    # The outermost article around a node, without one the outermost main.
    around: dict[int, Node | None] = {}
    units = set()
    for n in nodes:
        unit = around[id(n.parent)] if n.parent is not None else None
        if n.name == "article" and (unit is None or unit.name == "main") or n.name == "main" and unit is None:
            unit = n
        around[id(n)] = unit
        if unit is not None and id(n) in marked:
            units.add(id(unit))
    return marked, units, threshold


def main_text(page: str | None) -> str:
    """The blocks of the main text in page order, joined by line feeds."""
    if not page:
        return ""
    tree = _Tree(page)
    root, gone = tree.root, tree.gone()
    nodes = []
    if gone:
        less = _Tree(page, gone).root
        nodes = measure(less)
        root = less if less.size else root
    if not gone or root is tree.root:  # no names, or nothing would be left
        nodes = measure(root)
    if not root.size:
        return ""
    marked, units, threshold = _select(nodes)
    out: list[str] = []
    todo: list[tuple[Node | str, bool, bool]] = [(root, False, False)]  # (part, in a marked node, in an article of one)
    while todo:
        c, chosen, inside = todo.pop()
        if isinstance(c, str):
            if chosen or inside:
                out.append(c)
            continue
        chosen = chosen or id(c) in marked
        inside = id(c) in units or inside and not (2 * c.link > c.size and c.density < threshold)
        todo += [(x, chosen, inside) for x in reversed(c.children)]
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()),
                                              "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars."""
    shipped(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
