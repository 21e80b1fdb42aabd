"""Text blocks of an HTML page with the node of its site's tree on which each lies.

A node is known by a hash of its parent's and its own tag and names, so that a page takes time
and memory in proportion to its length however deep its elements nest.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import accumulate

import xxhash

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:[\"'][^>]*)?>?|<[!?][^>]*>?", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Za-z]+")

#: Elements whose content is text up to their own end tag, none of it part of an article.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp svg template annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small "
    "span strike strong sub sup time tt u var wbr br "
    # of formulas; an annotation repeats the formula in another notation, which isn't shown
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace "
    "msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: Which open elements a start tag ends, up to the nearest of the elements that hold them.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_SECTIONS = frozenset("article main section div aside nav header footer form body table ul ol dl td th li blockquote".split())
#: Elements that never hold main text, and roles and names that say so of others.
NOISE_TAGS = frozenset("nav footer aside script style noscript template button select dialog menu head title object canvas".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbox sponsor sponsored sponsors promo promos promotion banner "
    "nav navbar navigation menu menubar submenu topbar toolbar header masthead footer sidebar sidenav aside widget widgets "
    "breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices notification notifications popup "
    "modal overlay newsletter subscribe subscription signup signin login register search share sharing social related "
    "recommended recommendations trending comment comments commentlist disqus reply replies respond copyright disclaimer "
    "tracking skip".split()
)
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_ROLES = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: How sure it is that an element is noise: its name only has a noise word among others, or more than that.
DOUBT, NOISE = 1, 2
_PREFIXES = ("has", "with", "without", "no", "is", "js")


#: Elements nested deeper than this share the node of the one that holds them.
MOST_DEPTH = 32
#: Labels above readers' comments; of the words for answers only with their number.
_COMMENTS = re.compile(
    r"(?:(?:reader |all )?(?:\d+ )?(?:comments?|kommentare?|commentaires?|comentarios?|commenti|reacties)|\d+ (?:repl(?:y|ies)|responses?)"
    r"|(?:leave|post|write|add) a (?:comment|reply))\W*(?:\d+\W*)?",
    re.I,
)
_LABEL_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 legend summary header hgroup strong".split())


@dataclass(slots=True)
class Block:
    node: int  # position in Page.keys
    text: str
    #: Whether a landmark (article, main) stands above it, and how sure (0, DOUBT, NOISE) an element of noise does.
    content: bool
    noise: int


@dataclass(slots=True)
class _Open:
    tag: str
    node: int
    holder: int  # position in the stack of the nearest element that isn't inline, itself included
    content: bool
    noise: int
    blocks: int = 0  # of the page when it was opened
    children: list[str] | None = None
    #: What the end of the page decides about: a form, a name in doubt within a landmark, or a landmark.
    kind: str = ""
    inside: int = 0  # landmarks of the page when it was opened
    nested: bool = False  # whether an article stands above it


@dataclass
class _Span:
    kind: str
    first: int  # its blocks
    last: int
    landmarks: int  # those within it
    nested: bool  # whether an article stands above it


def _decide(blocks: list[Block], spans: list[_Span], landmarks: int) -> None:
    """Marks what only the whole page tells to be noise.

    A form goes unless it holds a landmark or, on a page without any, half of the words or more.
    An element whose name leaves a doubt within a landmark goes if it holds less than half of the
    landmarks' words. Of several articles side by side the largest is the main one, and those go that
    have less than half of its words.
    """
    words = [len(b.text.split()) for b in blocks]

    def sums() -> Callable[[_Span], int]:
        """Words of a span outside noise, as it stands now."""
        upto = [0, *accumulate(w if b.noise < NOISE else 0 for b, w in zip(blocks, words))]
        return lambda s: upto[s.last] - upto[s.first]

    def drop(these: list[_Span]) -> None:
        """Each block once: spans lie within each other or apart, and the outer ones come first."""
        gone = [False] * len(blocks)
        for s in sorted(these, key=lambda s: s.first - s.last):
            if s.first < s.last and not (gone[s.first] and gone[s.last - 1]):
                for k in range(s.first, s.last):
                    gone[k], blocks[k].noise = True, NOISE

    size, page = sums(), _Span("", 0, len(blocks), 0, False)
    drop([s for s in spans if s.kind == "form" and not s.landmarks and (landmarks or 2 * size(s) < size(page))])
    articles = [s for s in spans if s.kind == "article" and not s.nested]
    if len(articles) > 1:
        size = sums()
        most = max(map(size, articles))
        drop([s for s in articles if 2 * size(s) < most])
    doubts = [s for s in spans if s.kind == "doubt"]
    if doubts:
        size = sums()
        held = sum(w for b, w in zip(blocks, words) if b.content and b.noise < NOISE)
        drop([s for s in doubts if 2 * size(s) < held])


@dataclass
class Page:
    root: int
    blocks: list[Block] = field(default_factory=list)
    #: Of each node: its key, its parent's position (-1: none) and its depth.
    keys: list[int] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    #: Node of each element that holds others, with their tags, one after another.
    styles: list[tuple[int, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.keys, self.parents, self.depths = [self.root], [-1], [0]

    def node(self, parent: int, name: str) -> int:
        if self.depths[parent] >= MOST_DEPTH:
            return parent
        self.keys.append(child_key(self.keys[parent], name))
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        return len(self.keys) - 1


def child_key(parent: int, name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), parent)


def _names(attributes: dict[str, str]) -> list[list[str]]:
    both = attributes.get("class", "").split() + attributes.get("id", "").split()
    return [[w.lower() for w in _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", one))] for one in both]


def _is_landmark(tag: str, attributes: dict[str, str]) -> bool:
    return tag in CONTENT_TAGS or attributes.get("role", "").lower() in CONTENT_ROLES


def _noise(tag: str, attributes: dict[str, str], in_content: bool) -> int:
    """0, DOUBT or NOISE. Names say nothing of landmarks and headings, which are named by their topics.

    A name that holds other words too, as post-sidebar-left, leaves a doubt. An article within
    another one may be a comment on it, so there its name counts.
    """
    if tag in NOISE_TAGS or tag == "header" and not in_content:
        return NOISE
    if attributes.get("role", "").lower() in NOISE_ROLES or attributes.get("aria-hidden") == "true":
        return NOISE
    if "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return NOISE
    if tag in ("html", "body") or tag in _HEADINGS or _is_landmark(tag, attributes) and not (in_content and tag == "article"):
        return 0
    found = 0
    for words in _names(attributes):
        if words and words[0] not in _PREFIXES:
            hits = NOISE_NAMES.intersection(words)
            if hits and not (in_content and hits <= {"header"}):
                found = max(found, NOISE if hits.issuperset(words) else DOUBT)
    return found


def parse(page: str | None, root: int = 0) -> Page:
    """Blocks in page order; text in no element, or in elements never closed, counts too.

    root: the key of the tree's root. A quote in a tag that nothing closes ends with the tag, so
    the text after it is kept. An element outside whose first text is a label of readers'
    comments is noise with all it holds.
    """
    page, out = page or "", Page(root)
    stack = [_Open("#", 0, 0, False, 0)]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag in the stack
    sections: list[int] = []  # those of _SECTIONS
    held: list[str] = []
    blocks = out.blocks
    spans: list[_Span] = []
    landmarks = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            top = stack[stack[-1].holder]
            if len(text) < 48 and _COMMENTS.fullmatch(text):
                mark_comments(top)
            blocks.append(Block(top.node, text, top.content, stack[-1].noise))

    def mark_comments(top: _Open) -> None:
        at = top.holder
        if top.tag in _LABEL_TAGS and at:
            at = stack[at - 1].holder
        box = stack[at]
        if at and box.blocks == len(blocks) and box.tag not in ("html", "body", "main", "article") and not places["h1"]:
            for x in stack[at:]:
                x.noise = NOISE

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            x = stack.pop()
            places[x.tag].pop()
            if sections and sections[-1] == len(stack):
                sections.pop()
            if x.children:
                out.styles.append((x.node, " ".join(x.children)))
            if x.kind:
                spans.append(_Span(x.kind, x.blocks, len(blocks), landmarks - x.inside - (x.kind == "article"), x.nested))

    def first_above(tags: set[str], limit: int) -> int:
        """Place of the outermost open element of the tags above a place, 0 if none."""
        found = (p[k] for p in map(places.__getitem__, tags) if (k := bisect_right(p, limit)) < len(p))
        return min(found, default=0)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        held.append(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            held.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if m[1]:
            where = places[tag][-1] if tag in places and places[tag] else 0
            if inline and sections and sections[-1] > where:
                where = 0
            if where:
                if inline and any(x.noise != stack[where - 1].noise for x in stack[where:]):
                    flush()
                close(where)
            continue
        if tag == "p" or tag in _SECTIONS and tag != "li":
            where = first_above({"p"}, sections[-1] if sections else 0)
            if where:
                close(where)
        if tag in _ENDS:
            ends, holders = _ENDS[tag]
            where = first_above(ends, max((places[h][-1] for h in holders if places[h]), default=0))
            if where:
                close(where)
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(m[3])} if m[3].strip(" /") else {}
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or m[3].rstrip().endswith("/") and inline:
            continue
        up = stack[-1]
        own = _noise(tag, attributes, up.content)
        kind = "form" if tag == "form" else "doubt" if own == DOUBT and up.content else ""
        noise = max(up.noise, 0 if kind == "doubt" else own)
        if inline:
            if noise > up.noise:
                flush()
            new = _Open(tag, up.node, up.holder, up.content, noise, len(blocks))
        else:
            landmark = noise < NOISE and _is_landmark(tag, attributes)
            content = up.content or landmark
            in_article = bool(places["article"])
            if landmark and tag == "article" and not kind:
                kind = "article"
            name = "".join("." + "-".join(w) for w in _names(attributes) if w) if attributes else ""
            holder = stack[up.holder]
            if holder.children is None:
                holder.children = []
            if not holder.children or holder.children[-1] != tag:
                holder.children.append(tag)
            new = _Open(tag, out.node(holder.node, tag + name), len(stack), content, noise, len(blocks), None, kind, landmarks, in_article)
            landmarks += landmark
            if tag in _SECTIONS:
                sections.append(len(stack))
        places[tag].append(len(stack))
        stack.append(new)
    flush()
    while len(stack) > 1:
        close(1)
    if stack[0].children:
        out.styles.append((0, " ".join(stack[0].children)))
    _decide(blocks, spans, landmarks)
    return out
