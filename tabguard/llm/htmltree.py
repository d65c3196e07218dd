"""A page as a flat list of elements and text blocks: enough of HTML for text extraction."""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import cache
from hashlib import blake2b
from heapq import heapify, heappop, heappush

#: always ends, at the latest with the page, so no part of a page is scanned twice: quotes only count behind =
_MARKUP = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)(?:>|\Z)|<!--.*?(?:-->|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "html body p div section article main header footer nav aside form fieldset h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr details summary center hgroup menu dialog legend option".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
#: a start tag that ends an open element of these names, up to the given boundary
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
HOLDS = frozenset("html div section article main td body blockquote center figure details".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe object embed svg canvas button select textarea title dialog menu audio video map applet".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tablist form".split())
# fixed values: what class names and ids are made of where they name no article text, and what may stand beside that
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond replies share sharing social related recommended recommendations widget pagination pager skip tags byline hidden".split()
)
BESIDE = frozenset("area bar block box btn button buttons col column container content form group holder icons inner item items left line link links list main module msg panel post posts right row section site slot small sub text top unit widget wrap wrapper zone".split())
#: of more depth than that, elements lie beside each other, as browsers have it
DEPTH = 512
NESTED_NAMES = frozenset("comment comments reply ad advert promo sponsored related teaser".split())
MAIN_NAMES = frozenset("article content post entry story main text body".split())
HEADER = frozenset({"header"})
ALWAYS, FORM, NAMED = "always", "form", "named"
#: a form or named block is a wrapper if it has so much plain text, and the text of the page beside it is less than this share
WRAPS, BESIDE_IT = 200, 0.1


NOTHING: dict[str, str] = {}


@cache
def parts(name: str) -> frozenset[str]:
    """What a class name or id is made of: relatedPosts, related-posts and related_posts are related and posts."""
    return frozenset(x.lower() for x in _PART.findall(name) if not x.isdigit())


def named(names: list[str], wanted: frozenset[str]) -> bool:
    """Whether a whole name says so: ad-box does, related-work does not."""
    return any(own & wanted and own <= wanted | BESIDE for own in map(parts, names))


class Element:
    __slots__ = ("cls", "depth", "dropped", "good", "hard", "links", "names", "parent", "place", "segment", "soft", "tag")

    def __init__(self, tag: str, parent: Element | None, attributes: str, in_article: bool):
        self.tag, self.parent, self.good, self.links = tag, parent, 0, 0
        self.depth = parent.depth + 1 if parent else 0
        found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes)} if attributes else NOTHING
        self.cls = found.get("class", "")
        self.names = f"{self.cls} {found.get('id', '')}".split() if found else []
        why = self.drops(found, in_article)
        # a form, or a block that its name alone drops, may turn out to be a wrapper of the page
        self.soft = why in (FORM, NAMED) and tag in BLOCK
        self.hard = bool(why) and not self.soft or (parent.hard if parent else False)
        self.dropped = False  # told by Page.settle
        above = parent.place if parent else b""
        if tag in BLOCK:
            self.segment = f"{tag}{'.' + '.'.join(sorted(_DIGITS.sub('N', self.cls).split())) if self.cls.strip() else ''}"
            self.place = blake2b(above + self.segment.encode("utf-8", "replace"), digest_size=8).digest()
        else:
            self.segment, self.place = "", above

    @property
    def path(self) -> str:
        """Tags and classes from the root, digits generalised; ``place`` is its digest."""
        out, e = [], self
        while e is not None:
            if e.segment:
                out.append(e.segment)
            e = e.parent
        return "/".join(["", *reversed(out)])

    def drops(self, found: dict[str, str], in_article: bool) -> str:
        """Why the element holds no article text, if so."""
        if self.tag in ("html", "body"):
            return ""
        if self.tag in DROPPED:
            hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
            return FORM if self.tag == "form" and not hidden else ALWAYS
        if not found and self.tag != "header":
            return ""
        role = found.get("role", "").lower()
        if role in DROPPED_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            return ALWAYS
        if self.tag == "header":
            return "" if in_article else ALWAYS
        if self.tag in ("article", "main"):
            return ALWAYS if in_article and named(self.names, NESTED_NAMES) else ""
        if named(self.names, DROPPED_NAMES):
            return NAMED
        return ALWAYS if not in_article and self.tag in ("div", "section") and named(self.names, HEADER) else ""

    @property
    def weight(self) -> float:
        if self.tag == "article":
            return 1.5
        if self.tag == "main":
            return 1.4
        if self.tag in ("html", "body"):
            return 0.7
        return 1.25 if any(parts(n) & MAIN_NAMES for n in self.names) else 0.9 if self.tag == "td" else 1.0


def _end_of(source: str, tag: str, at: int) -> int | None:
    """Where the element that was opened before ``at`` is over; None if it is not closed.

    What script and its like hold is text, others may hold their own kind.
    """
    if tag in RAW:
        over = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
        return over.end() if over else len(source)
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(source, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return None


class Page:
    """``blocks``: (innermost block element, text), in page order; ``elements``: all, parents first."""

    def __init__(self, source: str):
        self.elements: list[Element] = []
        self.blocks: list[tuple[Element, str]] = []
        self.measured: list[tuple[Element, int, int]] = []
        self.stack: list[Element] = []
        self.pieces: list[str] = []
        self.linked = 0
        self.in_link = False
        self.unclosed: set[str] = set()
        self.open: Counter[str] = Counter()
        self._open("html", "")
        at, end = 0, len(source)
        while at < end:
            m = _MARKUP.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if (start := m.start()) > at:
                self._text(source[at:start])
            at = self._tag(source, m)
        self._flush()
        self.settle()
        for e, plain, linked in self.measured:
            if not e.dropped:
                e.good += plain
                e.links += linked
        self.blocks = [(e, text) for e, text in self.blocks if not e.dropped]
        for e in reversed(self.elements):
            if e.parent:
                e.parent.good += e.good
                e.parent.links += e.links

    def settle(self) -> None:
        """Which elements are dropped: all within a form or a block of such a name, but not what wraps the article.

        Of those that lie in no other, the one with most text is looked at
        first.  If the page has next to nothing without it, it is a wrapper: it
        stays, and those within it are looked at in its place.
        """
        whole, own = {id(e): 0 for e in self.elements}, {id(e): 0 for e in self.elements}
        for e, plain, _ in self.measured:
            whole[id(e)] += plain
            own[id(e)] += plain
        within: dict[int, list[Element]] = {}
        prose = {id(e) for e in self.elements if e.tag in ("p", "h1", "article", "main")}
        for e in reversed(self.elements):
            if e.parent:
                whole[id(e.parent)] += whole[id(e)]
                own[id(e.parent)] += 0 if e.soft else own[id(e)]
                if id(e) in prose:
                    prose.add(id(e.parent))
        nearest: dict[int, Element | None] = {}
        for e in self.elements:  # the innermost soft element above each
            up = e.parent
            nearest[id(e)] = None if up is None else up if up.soft else nearest[id(up)]
            if e.soft and not e.hard:
                within.setdefault(id(nearest[id(e)]), []).append(e)
        rest, wrappers = own[id(self.elements[0])], set()
        order = [(-whole[id(e)], i, e) for i, e in enumerate(within.get(id(None), []))]
        heapify(order)
        n = len(order)
        while order:
            size, _, e = heappop(order)
            if -size < WRAPS or rest >= BESIDE_IT * -size:
                break  # the others hold less, and are beside more
            if id(e) not in prose:
                continue
            wrappers.add(id(e))
            rest += own[id(e)]
            for inner in within.get(id(e), []):
                n += 1
                heappush(order, (-whole[id(inner)], n, inner))
        for e in self.elements:
            e.dropped = e.hard or e.soft and id(e) not in wrappers or (e.parent.dropped if e.parent else False)

    def _tag(self, source: str, m: re.Match) -> int:
        at, (slash, tag, attributes) = m.end(), m.groups()
        if tag is None:
            return at
        tag = tag.lower()
        if tag == "a":
            self.in_link = not slash
        elif tag == "br" or tag == "html":
            self.pieces.append(" ")
        elif slash:
            if self.open[tag]:
                self._close(tag)
        elif tag in BLOCK or tag in DROPPED or attributes and tag not in VOID:  # other inline elements change nothing
            self._open(tag, attributes)
            if tag in DROPPED and self.stack[-1].tag == tag and self.stack[-1].hard and tag not in self.unclosed:
                over = _end_of(source, tag, at)
                if over is not None:
                    self._close(tag)
                    return over
                self.unclosed.add(tag)
        return at

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._flush()
        if tag in VOID:
            return
        if self.open["p"] and tag in CLOSES_P:
            self._pop("p", {"td", "th", "article", "section", "main", "aside", "button"})
        if tag in ENDS:
            names, bounds = ENDS[tag]
            for e in reversed(self.stack) if any(self.open[n] for n in names) else ():
                if e.tag in bounds:
                    break
                if e.tag in names:
                    self._cut(self.stack.index(e))
        if tag == "body" and self.open["head"]:
            self._pop("head", set())
        if len(self.stack) >= DEPTH:
            self._cut(DEPTH - 1)
        e = Element(tag, self.stack[-1] if self.stack else None, attributes, bool(self.open["article"] or self.open["main"]))
        self.elements.append(e)
        if not attributes.rstrip().endswith("/") or tag in BLOCK:
            self.stack.append(e)
            self.open[tag] += 1

    def _cut(self, i: int) -> None:
        self._flush()
        for e in self.stack[i:]:
            self.open[e.tag] -= 1
        del self.stack[i:]

    def _pop(self, tag: str, bounds: set[str] | frozenset[str]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._cut(i)
                return
            if self.stack[i].tag in bounds:
                return

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
            self._pop(tag, set() if tag in ("body", "table", "article", "main") else {"td", "th"} - {tag})
        else:
            self._pop(tag, BLOCK)

    def _text(self, raw: str) -> None:
        if self.stack[-1].hard:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self.pieces.append(text)
        if self.in_link:
            self.linked += len(text.strip())

    def _flush(self) -> None:
        if not self.pieces:
            return
        text, linked = " ".join("".join(self.pieces).split()), self.linked
        self.pieces, self.linked = [], 0
        if not text:
            return
        e = self.stack[-1]
        while e.tag not in BLOCK:
            e = e.parent
        self.measured.append((e, max(0, len(text) - linked), linked))
        self.blocks.append((e, text))

    def containers(self) -> list[tuple[float, Element]]:
        """Elements that may hold the article, best first."""
        found = [(e.weight * (e.good - 0.5 * e.links), e) for e in self.elements if e.tag in HOLDS and not e.dropped and e.good > 0]
        found.sort(key=lambda x: (-x[0], -x[1].depth))
        return found

    def outermost(self, some: list[Element]) -> list[Element]:
        """Those that lie in no other of them."""
        own = {id(e) for e in some}

        def inside(e: Element) -> bool:
            up = e.parent
            while up is not None and id(up) not in own:
                up = up.parent
            return up is not None

        return [e for e in {id(e): e for e in some}.values() if not inside(e)]

    def text_below(self, roots: set[int]) -> str:
        def below(e: Element | None) -> bool:
            while e is not None:
                if id(e) in roots:
                    return True
                e = e.parent
            return False

        return "\n".join(text for e, text in self.blocks if not e.dropped and below(e))
