"""Leaf blocks of HTML pages: the text between two block-level tags, with the elements around it.

A tolerant scan in one pass: comments, scripts, styles, the head and the like are never text, tags that are left open are closed by what
follows them, a page that ends too early ends all that is open. Inline tags don't end a block, a line break is white space.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# fixed values: element names of HTML
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav "
    "ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open one of the second kind, unless one of the third kind lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
}
#: Block elements that may stand inside a paragraph without ending it.
IN_PARAGRAPH = frozenset("button label option optgroup select".split())

#: Of deeper paths only the outermost fifth and the innermost rest of so many elements are kept.
DEEP = 50

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z)"""
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<raw>script|style|title|textarea|template|noscript|iframe|svg|math|object|canvas|audio|video)(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*+(?:>|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>{_ATTRIBUTES})",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_MAIN = re.compile(r"\bdata-main\b")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element(NamedTuple):
    tag: str
    words: tuple[str, ...]  # of class, id and role
    main: bool  # marked by a labelled page


class Block(NamedTuple):
    text: str
    path: tuple[Element, ...]  # outermost first
    link: int  # characters inside links


_elements: dict[tuple[str, str], Element] = {}


def element(tag: str, attributes: str) -> Element:
    known = _elements.get((tag, attributes))
    if known is None:
        words = [w.lower() for _, *values in _NAMES.findall(attributes) for value in values for w in _WORD.findall(value)]
        known = Element(tag, tuple(dict.fromkeys(words[:20])), bool(_MAIN.search(attributes)))
        if len(_elements) > 50_000:
            _elements.clear()
        if len(attributes) < 300:
            _elements[tag, attributes] = known
    return known


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order, none empty: character references decoded, white space turned into single spaces."""
    out: list[Block] = []
    stack: list[Element] = []
    pieces: list[str] = []
    linked: list[str] = []
    path: tuple[Element, ...] | None = ()  # None: to be taken from the stack again
    links = head = 0
    at = 0

    def end_block() -> None:
        nonlocal path
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                if path is None:
                    path = tuple(stack) if len(stack) <= DEEP else (*stack[: DEEP // 5], *stack[DEEP // 5 - DEEP :])
                out.append(Block(text, path, min(len(text), sum(len(x.strip()) for x in linked))))
            pieces.clear()
            linked.clear()

    for m in _TAG.finditer(page):
        if m.start() > at and not head:
            pieces.append(page[at : m.start()])
            if links:
                linked.append(pieces[-1])
        at = m.end()
        tag = m["name"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            links = 0 if m["end"] else 1
        elif tag == "head":
            head = 0 if m["end"] else 1
        elif tag in BLOCK:
            head = 0
            end_block()
            if m["end"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        path, links = None, 0
                        break
                continue
            if tag not in IN_PARAGRAPH and stack and any(e.tag == "p" for e in stack[-4:]):
                for k in range(len(stack) - 1, max(-1, len(stack) - 5), -1):
                    if stack[k].tag == "p":
                        del stack[k:]
                        break
            if tag in CLOSES:
                ends, bounds = CLOSES[tag]
                k, low = len(stack) - 1, len(stack)
                while k >= 0 and stack[k].tag not in bounds:
                    if stack[k].tag in ends:
                        low = k
                    k -= 1
                del stack[low:]
            path = None
            if tag not in VOID:
                stack.append(element(tag, m["attributes"]))
    if at < len(page) and not head:
        pieces.append(page[at:])
        if links:
            linked.append(pieces[-1])
    end_block()
    return out
