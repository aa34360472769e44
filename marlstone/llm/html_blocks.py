"""Leaf blocks of HTML: the text between block-level tags, with its ancestors.

A tolerant reader: it never fails on a page, closes what the next tag implies
is over, and treats inline tags and line breaks as part of a block.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Elements that hold no text of the page (fixed values of HTML).
RAW = {"script", "style", "iframe", "textarea", "title"}
#: Elements that may stand in a paragraph, with text of their own.
EMBEDDED = {"template", "noscript", "svg", "math", "select", "object", "canvas", "audio", "video"}
#: Elements within a line; every other element begins and ends blocks.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split()
)
VOID = {"area", "base", "basefont", "bgsound", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What a tag closes when it begins, up to the element that bounds the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "body": ({"head"}, {"html"}),
}
LANDMARKS = {"main", "article", "header", "footer", "nav", "aside", "form", "figure", "table", "blockquote", "dialog"}

TOKENS = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Styles that hide an element; the attribute that does, outside quoted values.
HIDING = re.compile(r"""display\s*:\s*none|visibility\s*:\s*hidden|\baria-hidden\s*=\s*["']?true""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)(?!\s*=\s*false)""", re.I)
QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
PARTS = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Element:
    """An open element, with what its ancestors and its own names say."""

    tag: str
    features: frozenset[str]
    landmarks: tuple[str, ...]
    #: Names of the nearest element that has some.
    nearest: frozenset[str] = frozenset()


@dataclass(slots=True)
class Leaf:
    text: str
    element: Element
    linked: int = 0
    marks: list[str] = field(default_factory=list)


ROOT = Element("", frozenset(), ())


def enter(parent: Element, tag: str, attributes: str) -> Element:
    """An element inside ``parent``."""
    own, words = {f"in:{tag}"}, set()
    if attributes:
        for m in NAMES.finditer(attributes):
            words.update(PARTS.findall((m[2] or m[3] or m[4] or "").lower()))
        own.update(f"name:{w}" for w in words)
        if HIDING.search(attributes) or HIDDEN.search(QUOTED.sub("=", attributes)):
            own.add("hidden")
    landmarks = parent.landmarks
    if tag in LANDMARKS and (not landmarks or landmarks[-1] != tag):
        landmarks = (*landmarks[-1:], tag)
    return Element(tag, parent.features | own, landmarks, frozenset(f"nearest:{w}" for w in words) or parent.nearest)


def leaves(page: str) -> list[Leaf]:
    """The blocks of a page, in page order, character references decoded and
    white space made single spaces."""
    out: list[Leaf] = []
    stack = [ROOT]
    parts: list[str] = []
    linked, in_link, at, n = 0, False, 0, len(page)
    known: dict[tuple[int, str, str], Element] = {}

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Leaf(text, stack[-1], linked))
            parts.clear()
        linked = 0

    while at < n:
        m = TOKENS.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(m[1] or m[4])
        if tag in RAW:
            if not closing and not (m[3] or m[6] or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            elif tag in ("br", "img"):
                parts.append(" ")
            continue
        flush()
        if closing:
            in_link = False
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        over, bound = CLOSES.get(tag, ((), ()))
        if stack[-1].tag == "p" and tag not in EMBEDDED:
            stack.pop()
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in bound:
                break
            if stack[k].tag in over:
                del stack[k:]
                break
        attributes = m[3] or m[6] or ""
        if tag not in VOID and not (tag in EMBEDDED and attributes.rstrip().endswith("/")):
            key = (id(stack[-1]), tag, attributes)
            element = known.get(key)
            if element is None:
                element = known[key] = enter(stack[-1], tag, attributes)
            stack.append(element)
    flush()
    return out
