"""One web page as its visible text blocks, each with what the mark-up says about it.

A small scan with an element stack: it follows the rules of HTML that decide where a block begins and ends (implied
end tags, raw text elements, void elements, character references) and knows which elements are the article and which
are menus, notices, forms and the like, by element, role, or class and id. Work is linear in the length of the page."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

#: What the mark-up says of a block.
GONE, OPEN, KEEP = 0, 1, 2

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)""",
                    re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")
_DEPTH = 512  # deeper elements are read as text of the element at this depth, as browsers do

#: Fixed by the HTML standard: elements without an end tag, elements whose content is not markup, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes template svg math object canvas audio video".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
    search section summary table tbody td tfoot th thead tr ul""".split())
#: An element that ends an open one of the same list, unless one of the second list is open in between.
_ENDS = {n: (own, stop) for own, stop in ((("li",), ("ul", "ol", "menu", "dir")), (("dt", "dd"), ("dl",)),
                                          (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
                                          (("option", "optgroup"), ("select",))) for n in own}
_CELLS = ("td", "th")

#: Elements, roles, and parts of class and id names that mark what is not the article.
_TAGS = frozenset("nav aside footer header form dialog menu button select noscript search fieldset label".split())
_ROLES = frozenset("""navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar
    tooltip status""".split())
_PARTS = frozenset("""nav navbar navigation navigations menu menus submenu sidenav breadcrumb breadcrumbs pagination pager toolbar
    topbar header masthead footer colophon copyright legal imprint disclaimer sidebar sidebars aside rail widget widgets related
    recommended recommendations trending popular comment comments reply replies respond disqus discussion login signin signup
    register search searchbox form share sharing social skip hidden donate paywall""".split())
_LEAVES = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle banner banners promo
    promos promotion sponsor sponsored sponsors outbrain taboola cookie cookies consent gdpr ccpa notice notices alert alerts
    newsletter newsletters subscribe subscription popup modal overlay lightbox interstitial toast snackbar""".split())
_WITHIN = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo related widget".split())
_CONTENT = frozenset("""content main main-content maincontent page-content site-content content-body body-content article
    article-body article-content article-text post post-body post-content post-text entry entry-content entry-body story
    story-body story-content""".split())


@dataclass
class Block:
    text: str
    state: int
    linked: bool = False  # all of its text is link text


@dataclass
class _Open:
    name: str
    mark: int  # 0 none, 1 of an advert or notice, 2 of any other part that is not the article
    level: int  # 3 in an article, 2 in the main part, 1 in what a class calls content
    inline: bool


def _attributes(raw: str) -> dict[str, str]:
    out = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape("".join(values)))
    return out


def _name_parts(names: str) -> set[str]:
    """Parts of class names; what follows has, with, no or without says something about another element."""
    out = set()
    for name in names.split():
        parts = [x.lower() for x in _NAME_PART.findall(name)]
        out |= {x for x, before in zip(parts, [""] + parts) if before not in ("has", "with", "no", "without", "is", "not")}
    return out


def _opened(name: str, raw: str, parent: _Open) -> _Open:
    a = _attributes(raw) if raw.strip(" /") else {}
    names = f"{a.get('class', '')} {a.get('id', '')}"
    role = a.get("role", "").lower()
    mark, level = parent.mark, parent.level
    whole = {x.lower() for x in names.split()}
    parts = _name_parts(names) if whole else set()
    if name in ("html", "body"):
        return _Open(name, mark, level, False)
    if name in ("article", "main") or a.get("itemprop", "").lower() == "articlebody" or role in ("article", "main"):
        own = 2 if name == "main" or role == "main" else 3
        if parts & _WITHIN or "hidden" in a:
            return _Open(name, 2, level, False)
        return _Open(name, 0 if mark == 1 else mark, max(level, own), False)
    if name in ("div", "section") and whole & _CONTENT:
        return _Open(name, mark, max(level, 1), False)
    heading = level == 3  # the header of an article is its title
    parts = parts - {"header"} if heading else parts
    if (name in _TAGS and not (name == "header" and heading)) or (role in _ROLES and not (role == "banner" and heading)):
        mark = 2
    elif "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        mark = 2
    elif parts & _PARTS:
        mark = 2
    elif parts & _LEAVES:
        mark = max(mark, 1)
    return _Open(name, mark, level, name not in BLOCK)


class _Scan:
    def __init__(self) -> None:
        self.stack = [_Open("", 0, 0, False)]
        self.names: Counter = Counter()
        self.found: list[tuple[str, _Open, bool, bool]] = []  # text, where, all linked, in an h1
        self.pieces: list[str] = []
        self.unlinked = False

    def text(self, raw: str) -> None:
        if raw:
            s = unescape(raw) if "&" in raw else raw
            self.pieces.append(s)
            self.unlinked = self.unlinked or (not self.names["a"] and not s.isspace())

    def flush(self) -> None:
        if self.pieces:
            s = " ".join("".join(self.pieces).split())
            if s:
                self.found.append((s, self.stack[-1], not self.unlinked, self.names["h1"] > 0))
            self.pieces.clear()
        self.unlinked = False

    def pop(self, name: str) -> None:
        while True:
            top = self.stack.pop()
            self.names[top.name] -= 1
            if top.name == name:
                return

    def start(self, name: str, raw: str) -> None:
        block = name in BLOCK
        if block:
            self.flush()
            if self.names["p"]:
                self.pop("p")
            if name in _ENDS:
                self.imply(name)
        elif name == "br":
            self.pieces.append(" ")
        if name in VOID or raw.endswith("/") and not block:
            return
        if len(self.stack) < _DEPTH:
            new = _opened(name, raw, self.stack[-1])
            if not block and (new.mark != self.stack[-1].mark or new.level != self.stack[-1].level):
                self.flush()  # text of another kind is a block of its own
            self.stack.append(new)
            self.names[name] += 1

    def imply(self, name: str) -> None:
        own, stops = _ENDS[name]
        own = _CELLS if name in _CELLS else own
        for e in reversed(self.stack):
            if e.name in own:
                return self.pop(e.name)
            if e.name in stops or (name in _CELLS and e.name == "tr"):
                return None

    def end(self, name: str) -> None:
        block = name in BLOCK
        if block:
            self.flush()
        if not self.names[name]:
            return
        if not block:
            for e in reversed(self.stack):  # an inline end tag does not reach out of its block
                if e.name == name:
                    below = self.stack[self.stack.index(e) - 1]
                    if below.mark != e.mark or below.level != e.level:
                        self.flush()
                    break
                if not e.inline:
                    return
        self.pop(name)


def blocks(html: str) -> list[Block]:
    """Visible blocks in page order. KEEP: in the article (or, without one, the main part) and not marked as something
    else; GONE: marked as something else, or outside an article that the page has; OPEN: the mark-up does not say.

    The last first-level heading ahead of an article without one is its title. White space is one space inside a
    block, character references are decoded; scripts, styles, comments and empty blocks are left out."""
    scan, at, html = _Scan(), 0, html or ""
    while True:
        m = _TOKEN.search(html, at)
        scan.text(html[at: m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        closing, name, raw = m[1], (m[2] or "").lower(), m[3] or ""
        if not name or not m[4]:  # a tag that the page's end cuts off is none
            continue
        if closing:
            scan.end(name)
        elif name in RAW:
            if not raw.endswith("/"):
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
                at = close.end() if close else len(html)
        else:
            scan.start(name, raw)
    scan.flush()
    return _stated(scan.found)


def _stated(found: list[tuple[str, _Open, bool, bool]]) -> list[Block]:
    best = max((w.level for _, w, _, _ in found if not w.mark), default=0)
    inside = [not w.mark and w.level == best for _, w, _, _ in found]
    title = -1
    if best:
        first = inside.index(True)
        if not any(h1 for (_, _, _, h1), i in zip(found, inside) if i):
            title = max((i for i in range(first) if found[i][3] and not found[i][1].mark), default=-1)
    out = []
    for i, (text, where, linked, _) in enumerate(found):
        if i == title or inside[i]:
            out.append(Block(text, KEEP if best > 1 else OPEN, linked))
        else:
            out.append(Block(text, GONE, linked))
    return out
