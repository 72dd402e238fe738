"""HTML in linear time: a scanner of tags, and a tree with implied and missing end tags.

The scanner goes over a page once and never back: an end that is missing (of a comment, a tag, a script) is the page's end. The
tree knows, for every open name, where it is open last, so that a tag asks for what it closes without a walk; an element has its
parent and the range of elements and text pieces within it, and no copies of either.

What a tree does not do is move misnested parts: formatting ends with the block that it stands in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape
from html.entities import html5

_TAG = re.compile(r"""(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=]++|=[^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*+);")

# Elements of HTML by how they behave.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = {name: re.compile(rf"(?i)</{name}(?=[\s/>])") for name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = ("html", "table", "td", "th", "caption", "template", "object", "marquee", "applet")
# What a start tag ends, and within what it looks for it.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", *_SCOPE)), "dt": (("dt", "dd"), ("dl", *_SCOPE)), "dd": (("dt", "dd"), ("dl", *_SCOPE)), "a": (("a",), _SCOPE), "button": (("button",), _SCOPE),
    "option": (("option",), ("select", "datalist", *_SCOPE)), "optgroup": (("option", "optgroup"), ("select", *_SCOPE)), "tr": (("td", "th", "tr"), ("table", "template", "html")),
    "td": (("td", "th"), ("tr", "table", "template", "html")), "th": (("td", "th"), ("tr", "table", "template", "html")),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"), ("table", "template", "html"))),
}


@dataclass(slots=True)
class Token:
    kind: str  # text, raw (text of a script and the like), open, close
    name: str  # of a tag, in lower case
    inner: str  # the text, or a tag's attributes as they stand
    start: int
    end: int


def scan(html: str) -> Iterator[Token]:
    """Texts and tags in order. Comments, declarations and instructions are left out."""
    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            yield Token("text", "", html[at:], at, size)
            return
        if lt > at:
            yield Token("text", "", html[at:lt], at, lt)
        after = html[lt + 1 : lt + 2]
        if after in ("!", "?"):
            comment = html.startswith("!--", lt + 1)
            end = -1 if comment and html.find("-->", lt + 2) < 0 else html.find("-->", lt + 2) + 3 if comment else html.find(">", lt) + 1
            if end <= 0:
                return
            at = end
            continue
        if not (after.isascii() and after.isalpha()) and not (after == "/" and html[lt + 2 : lt + 3].isascii() and html[lt + 2 : lt + 3].isalpha()):
            yield Token("text", "", "<", lt, lt + 1)
            at = lt + 1
            continue
        m = _TAG.match(html, lt + 1)
        if not m:
            return
        name, at = m[2].lower(), m.end()
        yield Token("close" if m[1] else "open", name, m[3], lt, at)
        if not m[1] and name in RAW:
            close = RAW[name].search(html, at)
            end = close.start() if close else size
            if end > at:
                yield Token("raw", name, html[at:end], at, end)
            at = end


def ended_references(text: str) -> str:
    """Decodes what a semicolon ends. Without one, as where a text was cut, even the old names stay as they are."""
    return _REFERENCE.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def attributes(inner: str, decode: Callable[[str], str] = unescape) -> dict[str, str]:
    """Names in lower case with decoded values; of a repeated name the first counts, one without a value is empty."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(inner):
        value = double or single or bare
        found.setdefault(name.lower(), decode(value) if "&" in value else value)
    return found


@dataclass(slots=True)
class Element:
    tag: str
    inner: str
    parent: int  # -1 for none
    first_piece: int
    last_piece: int = -1  # behind the last
    last: int = -1  # behind the last element within
    known: dict[str, str] | None = None

    @property
    def attrs(self) -> dict[str, str]:
        if self.known is None:
            self.known = attributes(self.inner)
        return self.known


@dataclass
class Tree:
    """Elements in the order of their start tags; those within element i are i + 1 up to ``elements[i].last``."""

    elements: list[Element] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    steps: list[tuple[str, int]] = field(default_factory=list)  # open and close of elements, text of pieces, in order

    def text(self, i: int) -> str:
        e = self.elements[i]
        return "".join(self.pieces[e.first_piece : e.last_piece])


class _Open:
    """The elements that are open, and where each name is open last."""

    def __init__(self, tree: Tree) -> None:
        self.tree = tree
        self.stack: list[int] = []
        self.at: dict[str, list[int]] = {}

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def push(self, i: int) -> None:
        self.at.setdefault(self.tree.elements[i].tag, []).append(len(self.stack))
        self.stack.append(i)

    def close_from(self, height: int) -> None:
        t = self.tree
        while len(self.stack) > height:
            i = self.stack.pop()
            e = t.elements[i]
            self.at[e.tag].pop()
            e.last, e.last_piece = len(t.elements), len(t.pieces)
            t.steps.append(("close", i))

    def close_in(self, names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """Ends the outermost run of the names that are open within the scope."""
        edge = self.last(scope)
        found = [self.at[n][-1] for n in names if self.at.get(n) and self.at[n][-1] > edge]
        if found:
            self.close_from(min(found))


def tree(html: str | None, decode: Callable[[str], str] = unescape) -> Tree:
    """decode: for the character references in texts."""
    t = Tree()
    up = _Open(t)
    for token in scan(html or ""):
        if token.kind in ("text", "raw"):
            text = token.inner
            if token.kind == "text" and up.at.get("head") and not text.isspace():
                head = up.at["head"][-1]
                if head == len(up.stack) - 1:
                    up.close_from(head)
            if "&" in text and (token.kind == "text" or token.name in ("title", "textarea")):
                text = decode(text)
            t.steps.append(("text", len(t.pieces)))
            t.pieces.append(text)
        elif token.kind == "open":
            tag = token.name
            if tag == "form" and up.at.get("form"):
                continue  # forms do not nest
            if up.at.get("head") and tag not in IN_HEAD and tag != "head" and not up.at.get("template"):
                up.close_from(up.at["head"][-1])
            if tag in ENDS_P and up.at.get("p"):
                up.close_in(("p",), ("button", *_SCOPE))
            if tag in HEADINGS and up.stack and t.elements[up.stack[-1]].tag in HEADINGS:
                up.close_from(len(up.stack) - 1)
            if tag in _ENDS:
                up.close_in(*_ENDS[tag])
            i = len(t.elements)
            t.elements.append(Element(tag, token.inner, up.stack[-1] if up.stack else -1, len(t.pieces)))
            t.steps.append(("open", i))
            up.push(i)
            if tag in VOID:
                up.close_from(len(up.stack) - 1)
        else:
            places = up.at.get(token.name)
            # An end tag without its element, or beyond a cell or table that it does not belong to, is nothing.
            if places and (token.name in _SCOPE or places[-1] > up.last(_SCOPE)):
                up.close_from(places[-1])
    up.close_from(0)
    return t


# --- what pages are asked for ---------------------------------------------------------------------------------------


def links(html: str | None) -> list[tuple[str, str]]:
    """(text with its tags, href) of the links of a page, in order. A link ends at its end tag, at the next link, or with the page."""
    found, href, begin = [], None, 0
    html = html or ""
    for token in scan(html):
        if token.name != "a" or token.kind not in ("open", "close"):
            continue
        if href is not None:
            found.append((html[begin : token.start], href))
            href = None
        if token.kind == "open":
            href, begin = attributes(token.inner).get("href"), token.end
    if href is not None:
        found.append((html[begin:], href))
    return found


def scripts(html: str | None) -> list[tuple[dict[str, str], str]]:
    """(attributes, text) of the scripts of a page; an unclosed one goes to the page's end."""
    found: list[tuple[dict[str, str], str]] = []
    for token in scan(html or ""):
        if token.name == "script":
            if token.kind == "open":
                found.append((attributes(token.inner), ""))
            elif token.kind == "raw":
                found[-1] = (found[-1][0], token.inner)
    return found


def tags(html: str | None, name: str) -> list[dict[str, str]]:
    """The attributes of the start tags of a name."""
    return [attributes(x.inner) for x in scan(html or "") if x.kind == "open" and x.name == name]
