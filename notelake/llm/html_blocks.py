"""HTML to leaf blocks: runs of text between block boundaries, with the path of tags above them.

Time and memory grow in proportion to the page, however deeply its elements nest and however broken its markup is:
a block's path is its innermost element, which knows the one it stands in, and no stretch of markup is scanned
anew from each of its places.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass

# Elements by how they part text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe legend li main menu nav noscript ol option p pre section select summary svg table tbody td textarea tfoot th thead title tr ul video audio".split()
)
RAW = frozenset(("script", "style", "template", "xmp"))
ESCAPABLE = frozenset(("title", "textarea"))
# An opening tag of the key ends an open element of the value, unless a boundary lies between.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
_CLOSES_P = BLOCK - {"br", "button", "option", "select", "body", "html", "head", "title", "svg", "video", "audio", "iframe", "noscript", "textarea", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "dialog"}
_BOUNDARY = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}, "body": {"html"}}

_NAME_END = re.compile(r"[\s/>]")
_SPECIAL = re.compile("[>\"']")
_TOKENS = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(hidden|aria-hidden|display\s*:\s*none)", re.I)
_NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Element:
    """An open element: its tag and the words of its class, id and role, and the element it stands in."""

    __slots__ = ("above", "depth", "marks", "names")

    def __init__(self, names: tuple[str, ...], above: Element | None) -> None:
        self.names, self.above = names, above
        self.depth: int = above.depth + 1 if above else 1
        #: What a labeller makes of the path to here, once it has.
        self.marks: int | None = None


@dataclass
class Block:
    #: The innermost open element; None outside all.
    path: Element | None
    text: str
    #: Characters of the text inside links.
    linked: int


_names_memo: dict[tuple[str, str], tuple[str, ...]] = {}


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return (tag,)
    key = (tag, attributes)
    if (found := _names_memo.get(key)) is not None:
        return found
    words: list[str] = []
    for m in _TOKENS.finditer(attributes):
        if m[4]:
            words.append("hidden")
        else:
            words += [w.lower() for w in _NAME_PARTS.findall(m[1] or m[2] or m[3] or "")]
    out = (tag, *dict.fromkeys(w for w in words if len(w) > 1))
    if len(attributes) <= 400:  # long ones would fill the memo
        if len(_names_memo) > 20_000:
            _names_memo.clear()
        _names_memo[key] = out
    return out


class _Next:
    """The next match's place from a position on; a stretch known to hold none is not read again."""

    def __init__(self, source: str, pattern: re.Pattern) -> None:
        self.source, self.pattern, self.lo, self.hi = source, pattern, 0, -1

    def __call__(self, at: int) -> int:
        if not self.lo <= at <= self.hi:
            m = self.pattern.search(self.source, at)
            self.lo, self.hi = at, m.start() if m else len(self.source)
        return self.hi


class _Markup:
    """Reads a page's markup piece by piece."""

    def __init__(self, source: str) -> None:
        self.source, self.n = source, len(source)
        self.name_end, self.special = _Next(source, _NAME_END), _Next(source, _SPECIAL)
        #: Quotes outside quotes from which on no tag ends, and whether any ``>`` is left.
        self.open_ended: set[int] = set()
        self.closes = True

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, tag, whether an end tag, attributes) of the next markup; the tag is empty for comments and the like. None if there is none."""
        s = self.source
        while (lo := s.find("<", at)) >= 0:
            at = lo + 1
            c = s[at : at + 1]
            if c == "!" or c == "?":
                if s.startswith("!--", at):
                    end, size = s.find("-->", at + 3), 3
                elif s.startswith("![CDATA[", at):
                    end, size = s.find("]]>", at + 8), 3
                else:
                    end, size = s.find(">", at), 1
                return lo, end + size if end >= 0 else self.n, "", False, ""
            ends = c == "/"
            first = at + ends
            if s[first : first + 1].isascii() and s[first : first + 1].isalpha():
                name = self.name_end(first)
                stop = self._tag_end(name)
                if stop is not None:
                    return lo, stop + 1, s[first:name].lower(), ends, s[name:stop]
            if ends and self.closes:
                stop = s.find(">", at)
                self.closes = stop >= 0
                if self.closes:
                    return lo, stop + 1, "", False, ""
        return None

    def _tag_end(self, at: int) -> int | None:
        """Where the tag closes whose attributes begin at ``at``: the first ``>`` outside quotes."""
        passed = []
        while (at := self.special(at)) < self.n and at not in self.open_ended:
            if self.source[at] == ">":
                return at
            passed.append(at)
            at = self.source.find(self.source[at], at + 1) + 1
            if not at:
                break
        self.open_ended.update(passed)
        return None


class _Stack:
    """The open elements, innermost last, with the places of each tag."""

    def __init__(self) -> None:
        self.elements: list[Element] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.links = 0

    def push(self, names: tuple[str, ...]) -> None:
        tag = names[0]
        self.places[tag].append(len(self.elements))
        if tag in BLOCK:
            self.blocks.append(len(self.elements))
        self.links += tag == "a"
        self.elements.append(Element(names, self.elements[-1] if self.elements else None))

    def cut(self, size: int) -> None:
        """Closes all elements from place ``size`` on."""
        while len(self.elements) > size:
            tag = self.elements.pop().names[0]
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            self.links -= tag == "a"

    def last(self, tag: str) -> int:
        held = self.places.get(tag)
        return held[-1] if held else -1

    def first_after(self, tag: str, place: int) -> int | None:
        held = self.places.get(tag, ())
        k = bisect_right(held, place)
        return held[k] if k < len(held) else None

    def close_implied(self, tag: str) -> None:
        """Closes what an opening block tag ends without an end tag of its own."""
        if tag not in ENDS:
            if tag in _CLOSES_P and self.blocks and self.elements[self.blocks[-1]].names[0] == "p":
                self.cut(self.blocks[-1])
            return
        ends = ENDS[tag] | ({"p"} if tag in _CLOSES_P else set())
        stop = max(map(self.last, (_BOUNDARY.get(tag, set()) | {"body", "html"}) - ends))
        found = [k for e in ends if (k := self.first_after(e, stop)) is not None]
        if found:
            self.cut(min(found))


def blocks(source: str) -> list[Block]:
    """The blocks of a page that hold any text, in page order; white space in each is one space, character references are decoded."""
    out: list[Block] = []
    stack, markup = _Stack(), _Markup(source)
    parts: list[str] = []
    linked: list[str] = []
    path: Element | None = None
    placed = False

    def close() -> None:
        nonlocal placed
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(path if placed else None, text, min(len(text), len(" ".join("".join(linked).split())))))
            parts.clear()
            linked.clear()
        placed = False

    def add(text: str) -> None:
        nonlocal path, placed
        if not placed and not text.isspace():
            path, placed = stack.elements[-1] if stack.elements else None, True
        parts.append(text)
        if stack.links:
            linked.append(text)

    at, n = 0, len(source)
    while at < n:
        m = markup.next(at)
        lo, hi = m[:2] if m else (n, n)
        if lo > at:
            add(source[at:lo])
        at = hi
        if not m or not m[2]:
            continue
        _, _, tag, ends, attributes = m
        if ends:
            if tag in BLOCK:
                close()
            place = stack.last(tag)
            # An inline end tag does not reach out of the block it stands in.
            if place >= 0 and (tag in BLOCK or not stack.blocks or place > stack.blocks[-1]):
                stack.cut(place)
            continue
        if tag in RAW or tag in ESCAPABLE:
            end = re.compile(rf"</{tag}\b", re.I).search(source, at)
            over = source.find(">", end.end()) if end else -1
            if tag in ESCAPABLE:
                close()
                stack.push(_names(tag, attributes))
                add(source[at : end.start() if over >= 0 else n])
                close()
                stack.cut(len(stack.elements) - 1)
            at = over + 1 if over >= 0 else n
            continue
        if tag in BLOCK:
            close()
            stack.close_implied(tag)
        if tag not in VOID and not attributes.endswith("/"):
            stack.push(_names(tag, attributes))
        elif tag in VOID and tag not in BLOCK and tag != "wbr":
            parts.append(" " if parts else "")
    close()
    return out
