"""A page's block elements as a tree of labelled nodes with the text blocks below them.

The reader follows HTML's rules where they decide what a reader sees: implied ends of paragraphs, list
items and table rows, raw text of scripts and styles, tags that end late, twice or never. Inline markup
is no node: its text belongs to the block around it. Work is linear in the page.
"""

from __future__ import annotations

import re
from html import unescape

import xxhash

# Element names by their part in the tree.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output picture "
    "progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_PARAGRAPH = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header "
    "hgroup hr li main menu nav ol p pre search section summary table ul dd dt".split()
)
#: a start tag of the first ends an open element of the second, unless one of the third is between
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
}
CELLS = frozenset(["td", "th"])
#: names of elements that never hold the article
TEMPLATE_TAGS = frozenset(
    "nav footer aside form dialog search menu svg math object audio video canvas select button datalist noscript template".split()
)
TEMPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: words in a class or id that name a part of the page's template
TEMPLATE_WORDS = frozenset(
    "nav navbar navigation navi menu menubar breadcrumb breadcrumbs footer sidebar aside widget widgets ad ads adv advert adverts "
    "advertisement advertising adsense adbox banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice "
    "notices popup modal overlay newsletter subscribe subscription signup login search searchbox form comment comments commentlist "
    "reply replies respond disqus share sharing social related recommended recommendations pagination pager toolbar copyright "
    "masthead topbar skip".split()
)
#: a class that only says whether such a part is there
MODIFIERS = frozenset("has with without no hide".split())
CONTENT_CLASSES = frozenset(
    "content article main-content article-body article-content post post-content post-body entry-content entry story story-body".split()
)

PLAIN, ARTICLE, MAIN, HEADER, TEMPLATE, NAMED = range(6)

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
_NUMBER = re.compile(r"\d{3,}")  # shorter ones tell classes apart


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes from ``at`` on and where the tag ends; -1 when it never does."""
    found: dict[str, str] = {}
    close = html.find(">", at)
    if close == at or close < 0:
        return found, close
    while True:
        m = _ATTRIBUTE.match(html, at)
        if m is None:
            break
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        at = m.end()
    return found, html.find(">", at)


def _label(name: str, attributes: dict[str, str]) -> str:
    """What makes two elements of one kind: name, class, id and role, without running numbers."""
    if not attributes:
        return name
    classes = _NUMBER.sub("#", " ".join(sorted(attributes.get("class", "").split())))
    marks = [classes, _DIGITS.sub("#", attributes.get("id", "")), attributes.get("role", "")]
    return "|".join([name, *marks]) if any(marks) else name


def _role(name: str, attributes: dict[str, str], inside: bool) -> int:
    """The part an element has by its name; ``inside`` an article already."""
    if name in TEMPLATE_TAGS:
        return TEMPLATE
    if attributes:
        role = attributes.get("role", "").lower()
        style = attributes.get("style", "").replace(" ", "").lower()
        if role in TEMPLATE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style:
            return TEMPLATE
        classes = [*attributes.get("class", "").split(), *attributes.get("id", "").split()]
        for c in classes:
            words = {w.lower() for w in _WORDS.findall(c)}
            if words & TEMPLATE_WORDS and not words & MODIFIERS or "header" in words and not inside and name != "article":
                return NAMED
        if role == "main":
            return MAIN
        if role == "article" or attributes.get("itemprop") == "articleBody" or any(c.lower() in CONTENT_CLASSES for c in classes):
            return ARTICLE
    if name == "header":
        return PLAIN if inside else TEMPLATE
    if name == "article":
        return TEMPLATE if inside else ARTICLE  # an article in an article is a comment on it
    return MAIN if name == "main" else PLAIN


class Page:
    """``parent``, ``path``, ``role`` and ``plain`` (no class, id or role) of the nodes in page order; ``texts`` of the leaves.

    Node 0 is the body. A leaf stands for the text directly in an element, its path is odd; the path
    of an element is even. ``style`` is a hash of an element's children in order, runs of equal ones as one.
    """

    def __init__(self, html: str) -> None:
        self.parent, self.path, self.role, self.plain, self.name = [-1], [2], [PLAIN], [True], ["body"]
        self.style, self._last = [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._leaves: dict[tuple[int, bool], int] = {}
        self._open = [0]
        self._depth = {ARTICLE: 0, MAIN: 0, TEMPLATE: 0}  # open elements of a role
        self._hidden: list[str] = []  # open inline elements whose text nobody sees
        self._links = 0
        self._pieces: list[str] = []
        self._owner, self._owner_set, self._linked = 0, False, True
        self._read(html)

    def _add(self, parent: int, label: str, role: int, plain: bool, name: str, leaf: bool = False) -> int:
        path = xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), self.path[parent]) & ~1 | leaf
        if self._last[parent] != path:
            self._last[parent] = path
            self.style[parent] = (self.style[parent] * 0x9E3779B97F4A7C15 + path) & 0xFFFFFFFFFFFFFFFF
        for column, value in (
            (self.parent, parent), (self.path, path), (self.role, role), (self.plain, plain), (self.name, name), (self.style, 0), (self._last, 0),
        ):
            column.append(value)
        return len(self.path) - 1

    def _text(self, piece: str) -> None:
        if self._hidden or not piece:
            return
        if "&" in piece:
            piece = unescape(piece)
        if not piece.isspace():
            if not self._owner_set:
                self._owner, self._owner_set, self._linked = self._open[-1], True, True
            self._linked = self._linked and self._links > 0
        self._pieces.append(piece)

    def _flush(self) -> None:
        """The end of a block."""
        if self._owner_set:
            text = " ".join("".join(self._pieces).split())
            if text:
                key = (self._owner, self._linked)
                if key not in self._leaves:
                    mark = "#links" if self._linked else "#text"
                    self._leaves[key] = self._add(self._owner, mark, PLAIN, True, mark, leaf=True)
                self.blocks.append((self._leaves[key], text))
        self._pieces, self._owner_set = [], False

    def _pop(self) -> None:
        node = self._open.pop()
        role = self.role[node]
        if role in self._depth:
            self._depth[role] -= 1

    def _end(self, names: frozenset[str], barrier: frozenset[str] = frozenset()) -> bool:
        """Close the innermost open element of these names; nothing happens if there is none before a barrier."""
        for k in range(len(self._open) - 1, 0, -1):
            name = self.name[self._open[k]]
            if name in names:
                if name not in CELLS:
                    self._flush()
                while len(self._open) > k:
                    self._pop()
                return True
            if name in barrier:
                return False
        return False

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        inside = self._depth[ARTICLE] > 0 or (name == "header" and self._depth[MAIN] > 0)
        role = _role(name, attributes, inside)
        if name in INLINE:
            if name == "a":
                self._links = 1
            if name not in VOID and (role in (TEMPLATE, NAMED) or name in self._hidden):
                self._hidden.append(name)
            return
        if name in ENDS_PARAGRAPH and self.name[self._open[-1]] == "p":
            self._flush()
            self._pop()
            self._hidden = []
        if self._hidden:
            role = TEMPLATE
        if name in IMPLIED:
            self._end(*IMPLIED[name])
        if name in CELLS and role == PLAIN:
            self._pieces.append(" ")
        else:
            self._flush()
        self._hidden, self._links = [], 0
        if name in VOID:
            return
        label = _label(name, attributes)
        node = self._add(self._open[-1], label, role, label == name, name)
        self._open.append(node)
        if role in self._depth:
            self._depth[role] += 1

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            mark = html.find("<", at)
            if mark < 0:
                self._text(html[at:])
                break
            if mark > at:
                self._text(html[at:mark])
            following = html[mark + 1 : mark + 2]
            if following.isascii() and following.isalpha():
                name = _NAME.match(html, mark + 1)[0].lower()
                attributes, close = _attributes(html, mark + 1 + len(name))
                if close < 0:
                    break  # a tag cut off by the end of the page
                at = close + 1
                if name in RAW:
                    end = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
                    if end is None:
                        break
                    at = end.start()
                elif name == "br":
                    self._text(" ")
                elif name not in ("html", "head", "body"):
                    self._start(name, attributes)
            elif following == "/" and html[mark + 2 : mark + 3].isascii() and html[mark + 2 : mark + 3].isalpha():
                name = _NAME.match(html, mark + 2)[0].lower()
                _, close = _attributes(html, mark + 2 + len(name))
                if close < 0:
                    break
                at = close + 1
                if name in INLINE:
                    if self._hidden and name in self._hidden:
                        while self._hidden.pop() != name:
                            pass
                    if name == "a":
                        self._links = 0
                elif name in CELLS:
                    if self._end(frozenset([name]), frozenset(["table"])):
                        self._pieces.append(" ")
                elif name not in VOID and name not in RAW and name not in ("html", "head", "body"):
                    self._end(HEADINGS if name in HEADINGS else frozenset([name]), frozenset(["td", "th"]) if name == "p" else frozenset())
            elif html.startswith("!--", mark + 1):
                end = html.find("-->", mark + 2)
                if end < 0:
                    break
                at = end + 3
            elif following in ("!", "?", "/"):
                close = html.find(">", mark)
                if close < 0:
                    break
                at = close + 1
            else:
                self._text("<")
                at = mark + 1
        self._flush()
