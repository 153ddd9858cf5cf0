"""Main text of web pages by wrappers inferred per host.

A wrapper is a union-free regular expression over a page's token stream: elements, text slots,
repeated groups and optional groups, no alternatives. It starts as the first page and is aligned with
one page after another: equal tokens stay, texts become slots, a mismatch where siblings of one kind
follow each other becomes a repeated group, and any other mismatch an optional group. Wrappers of the
same host align with each other in the same way, so hosts are folded in tasks and merged after.

Slots keep how much text the host's pages have there, how much of it in links, and whether it is the
same on all pages. The wrapper decides once per host which elements hold the article and what in them
isn't of it: texts that are the same whatever the article, repeated groups and lists of links that are
named as comments, adverts or the like. Names alone decide nothing. Pages are then matched with the
wrapper, and a page that has none of its elements is read by the wrapper that it makes by itself.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: Wrappers of more bytes in all are joined to the pages by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Hosts that a task folds before it hands on what it has.
HOSTS_HELD = 500
PARTS = 32
#: Elements nest so deep in a page's tree; what is deeper are blocks of the deepest.
DEPTH = 100
#: Cells of the table that finds a longest common subsequence; longer sequences are matched at the heads
#: that both have once. Bytes of a wrapper, beyond which optional groups of few pages leave it.
CELLS = 250_000
WRAPPER_BYTES = 1 << 20
#: Different pages on which a text must be the same to be no part of the articles, and the most of an
#: article's text that such texts may be (pages that are nearly copies of each other have more).
EVIDENCE = 3
FIXED_SHARE = 0.3
#: Least characters of a text times pages that all have it: short words may meet by chance.
EVIDENT = 60

# Element names and the words of classes and ids.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - frozenset("head html body option optgroup legend caption tbody td tfoot th thead tr".split())
DROPPED = frozenset("head nav header footer aside form script style noscript template iframe button select textarea input label fieldset svg canvas object audio video dialog menu search title map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form".split())
#: Names (whole words of a class or an id) that ask the wrapper whether an element is of the article.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie-notice cookie-banner cookies consent newsletter subscribe paywall sidebar side-bar menu navbar "
    "breadcrumb breadcrumbs pager pagination share sharing share-buttons comment comments comment-list commentlist comment-section disqus reply replies respond related related-posts "
    "related-articles related-stories recommended recommendations trending popular teaser notice banner popup modal author-bio tag-list tag-cloud".split()
)
# the end of these closes what is open in them; another of the first kind closes an open one
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table select article section div main body html menu".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*)>|</?[A-Za-z][^>]*\Z|</[^>]*>?", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class Element:
    """A block element of a page: label (name with class and id), children (elements and texts). Too
    deep ones share the children of the element that they stand in."""

    __slots__ = ("children", "dropped", "label", "main", "name")

    def __init__(self, name: str, attributes: str, children: list | None = None):
        self.name, self.children, self.main = name, [] if children is None else children, name == "main"
        self.dropped, self.label = name in DROPPED, name
        if attributes and not attributes.isspace():
            values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            style = values.get("style", "").lower().replace(" ", "")
            named = f"{values.get('class', '')} {values.get('id', '')}".lower()
            role = values.get("role", "").lower()
            if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style or role in ROLES:
                self.dropped = True
            self.main |= role == "main"
            key = ".".join(sorted(re.sub(r"\d+", "0", named).split()))
            self.label = name + ("." + key if key else "") + (":x" if self.dropped else "") + (":m" if self.main else "")


def parse(page: str) -> Element:
    """The page's block elements and texts. Inline elements only mark their text as linked; inline
    elements that are dropped (buttons, labels, hidden or marked ones) are elements too."""
    root = Element("html", "")
    stack, links, at = [root], 0, 0
    match = TOKEN.search
    while True:
        hit = match(page, at)
        text = page[at : hit.start()] if hit else page[at:]
        if text:
            stack[-1].children.append((text, links > 0))
        if not hit:
            return root
        at = hit.end()
        name = hit[2] or hit[5]
        if not name:
            if hit[0].startswith("<![CDATA["):
                stack[-1].children.append((hit[0][9:].removesuffix("]]>").replace("&", "&amp;"), links > 0))
            continue
        name, closing, attributes = name.lower(), bool(hit[1] or hit[4]), hit[3] or hit[6] or ""
        if closing:
            if name == "a":
                links = max(0, links - 1)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    if name in BLOCK:
                        links = 0
                    _end(stack, i)
                    break
                if name not in BLOCK and stack[i].name in BLOCK:
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in ("br", "wbr"):
            if name == "br":
                stack[-1].children.append((" ", False))
            continue
        if name == "a":
            links += 1
            continue
        if name == "html" or (name == "body" and any(e.name == "body" for e in stack)):
            continue
        if name in BLOCK:
            if name in ENDS_PARAGRAPH:
                _close(stack, ("p",))
            if name in SIBLING:
                _close(stack, SIBLING[name])
            if name[0] == "h" and name[1:].isdigit() and stack[-1].name[0] == "h" and stack[-1].name[1:].isdigit():
                _end(stack, len(stack) - 1)
            if name == "body":
                _close(stack, ("head",))
            within = stack[-1].children
            deep = len(stack) > DEPTH and not (name in DROPPED or stack[-1].dropped)
            element = Element(name, "" if deep else attributes, within if deep else None)
            within.append(Element("hr", "") if deep else element)
            if name != "hr":
                stack.append(element)
        elif name not in VOID:
            element = Element(name, attributes) if attributes or name in DROPPED else None
            if element and element.dropped and not attributes.rstrip().endswith("/"):
                stack[-1].children.append(element)
                stack.append(element)


def _end(stack: list[Element], i: int) -> None:
    """Ends the open elements from place `i` on; the end of a too deep one ends a block."""
    if len(stack) > DEPTH + 1:
        stack[-1].children.append(Element("hr", ""))
    del stack[i:]


def _close(stack: list[Element], names: tuple[str, ...]) -> None:
    """Ends the nearest open element of the names, unless a container stands between."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in names:
            _end(stack, i)
            if names == ("p",) or len(names) == 1:
                return
            return _close(stack, names)
        if stack[i].name in SCOPE:
            return


# Wrapper nodes as JSON lists: ["e", label, children], ["#", pages, chars, link chars, marks, same], ["+",
# children], ["?", children]. A slot's marks are those of its texts that all pages have there, in order;
# same says whether no page has others.


def shape(element: Element) -> list:
    """The element as a wrapper that only it matches."""
    out, chars, linked, text = [], 0, 0, []

    def slot():
        nonlocal chars, linked, text
        if text:
            words = " ".join(text)
            out.append(["#", 1, chars, linked, [mark(words)], 1])
            chars, linked, text = 0, 0, []

    for child in element.children:
        if isinstance(child, Element):
            if child.dropped and child.name not in BLOCK:
                continue
            slot()
            out.append(["e", child.label, shape(child)])
        elif not child[0].isspace():
            words = child[0].split()
            size = sum(map(len, words))
            chars, linked = chars + size, linked + size * child[1]
            text += words
    slot()
    return folded(out, PAGE)


def mark(words: str) -> int:
    """A text's checksum and length in one number."""
    return zlib.crc32(words.encode("utf-8", "replace")) << 24 | min(len(words), 0xFFFFFF)


#: What is merged: siblings on one page, one place on several pages, or siblings over several pages.
PAGE, PLACE, SIBLINGS = range(3)
#: Elements that hold text rather than blocks; share of an element's text that one below must hold to
#: take its place.
TEXT_LEVEL = frozenset("p pre blockquote li dt dd td th h1 h2 h3 h4 h5 h6".split())
SHARE_BELOW = 0.7
#: The first element of a page's wrapper, whose slot counts pages.
COUNTER = "^"


def page_shape(page: Element) -> list:
    """The page's wrapper; its first slot counts pages and keeps up to EVIDENCE different ones."""
    nodes = shape(page)
    return [["e", COUNTER, [["#", 1, 0, 0, [mark(json.dumps(nodes))], 1]]], *nodes]


def head(node: list) -> str:
    kind = node[0]
    if kind == "e":
        return node[1]
    return "#" if kind == "#" else head(node[1][0])


def heads(nodes: list) -> list[str]:
    return [head(n) for n in nodes]


def merged(a: list, b: list, mode: int = PLACE) -> list:
    """One node for two of the same head. Siblings on one page lengthen the first one's marks."""
    if a[0] == "#" and b[0] == "#":
        if mode == PAGE:
            a[4].extend(b[4])
            marks, same = a[4], 1
        else:
            same, theirs = int(a[5] and b[5] and a[4] == b[4]), set(b[4])
            marks = a[4] if same else [m for m in a[4] if m in theirs]
        return ["#", a[1] + b[1] if mode == PLACE else max(a[1], b[1]), a[2] + b[2], a[3] + b[3], marks, same]
    if a[0] == "e" and b[0] == "e":
        if a[1] == COUNTER:
            x, y = a[2][0], b[2][0]
            return ["e", COUNTER, [["#", x[1] + y[1], 0, 0, sorted({*x[4], *y[4]})[:EVIDENCE], 1]]]
        return ["e", a[1], aligned(a[2], b[2], mode)]
    kind = "+" if "+" in (a[0], b[0]) else "?"
    inner = aligned(a[1] if a[0] in "+?" else [a], b[1] if b[0] in "+?" else [b], mode)
    return [kind, inner]


def aligned(a: list, b: list, mode: int = PLACE) -> list:
    """The sequence that matches both: longest common subsequence of heads merged, the rest optional."""
    if not a or not b:
        return [_optional(n) for n in a or b]
    x, y = heads(a), heads(b)
    if x == y:
        return [merged(p, q, mode) for p, q in zip(a, b)]
    out, i, k = [], 0, 0
    for p, q in common(x, y):
        out += [_optional(n) for n in a[i:p] + b[k:q]]
        out.append(merged(a[p], b[q], mode))
        i, k = p + 1, q + 1
    return folded(out + [_optional(c) for c in a[i:] + b[k:]], mode if mode == PAGE else SIBLINGS)


def common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence: the longest one where the table for it has at most CELLS cells
    besides a common begin and end, else one of the heads that both sequences have once."""
    begin = 0
    while begin < min(len(x), len(y)) and x[begin] == y[begin]:
        begin += 1
    end = 0
    while end < min(len(x), len(y)) - begin and x[-1 - end] == y[-1 - end]:
        end += 1
    n, m = len(x) - begin - end, len(y) - begin - end
    u, v = x[begin : begin + n], y[begin : begin + m]
    middle = []
    if n * m <= CELLS:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for k in range(m - 1, -1, -1):
                best[i][k] = best[i + 1][k + 1] + 1 if u[i] == v[k] else max(best[i + 1][k], best[i][k + 1])
        i = k = 0
        while i < n and k < m:
            if u[i] == v[k]:
                middle.append((i, k))
                i, k = i + 1, k + 1
            elif best[i + 1][k] >= best[i][k + 1]:
                i += 1
            else:
                k += 1
    else:
        once_u, once_v = ({h: i for i, h in enumerate(z) if counts[h] == 1} for z, counts in ((u, Counter(u)), (v, Counter(v))))
        middle = _rising([(i, once_v[h]) for h, i in once_u.items() if h in once_v])
    return [(i, i) for i in range(begin)] + [(i + begin, k + begin) for i, k in middle] + [(len(x) - e, len(y) - e) for e in range(end, 0, -1)]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that rises in both places."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    pairs = sorted(pairs)
    for n, (_, k) in enumerate(pairs):
        at = bisect_left(tops, k)
        before[n] = ends[at - 1] if at else -1
        tops[at : at + 1], ends[at : at + 1] = [k], [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def bounded(nodes: list) -> list:
    """The wrapper without the optional groups of the fewest pages, where it has over WRAPPER_BYTES.
    Pages match without them too: what no node of the wrapper speaks of stays."""
    text = json.dumps(nodes, separators=(",", ":"))
    least = 1
    while len(text) > WRAPPER_BYTES:
        kept = _supported(nodes, least)
        shorter = json.dumps(kept, separators=(",", ":"))
        if least > 1 << 40:
            break
        nodes, text, least = kept, shorter, 2 * least
    return nodes


def _supported(nodes: list, least: int) -> list:
    """The nodes without optional groups whose slots all have at most `least` pages."""
    out = []
    for n in nodes:
        if n[0] == "#":
            out.append(n)
        elif n[0] == "e":
            out.append(["e", n[1], _supported(n[2], least)])
        elif n[0] == "+" or _pages(n) > least:
            out.append([n[0], _supported(n[1], least)])
    return [n for n in out if n[0] in "#e" or n[1]]


def _pages(node: list) -> int:
    return node[1] if node[0] == "#" else max(map(_pages, node[2] if node[0] == "e" else node[1]), default=0)


def _optional(node: list) -> list:
    return node if node[0] == "?" else ["?", [node]]


def folded(nodes: list, mode: int) -> list:
    """Neighbouring groups of one to three heads that repeat become repeated groups."""
    for period in (1, 2, 3):
        out, i = [], 0
        while i < len(nodes):
            group = nodes[i : i + period]
            names, k = heads(group), i + period
            if len(group) == period and (period > 1 or names[0] != "#"):
                while len(nodes) - k >= period and heads(nodes[k : k + period]) == names:
                    group = [merged(p, q, mode) for p, q in zip(group, nodes[k : k + period])]
                    k += period
            if k > i + period:
                inner = group[0][1] if period == 1 and group[0][0] in "+?" else group
                out.append(["+", inner])
                i = k
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


class Wrapper:
    """What a host's pages tell of their articles: `roots`, the label paths of the elements that hold
    them; `skipped`, by path, the marks of texts in them that all pages have there; `left_out`,
    the paths of elements in them that are named as something else and bear it out."""

    def __init__(self, nodes: list):
        self.nodes = nodes
        counter = next((n[2][0] for n in nodes if n[0] == "e" and n[1] == COUNTER), None)
        self.pages, self.different = (counter[1], len(counter[4])) if counter else (1, 1)
        self.elements: list[tuple[tuple, list]] = []
        self.repeated: set[tuple] = set()
        self._read([n for n in nodes if n[0] != "e" or n[1] != COUNTER], (), False)
        self.slots: dict[tuple, list] = {}
        for path, slots in self.elements:
            self.slots.setdefault(path, []).extend(slots)
        self.own = {path: sum(s[2] for s in slots if not self._is_fixed(s) and 2 * s[3] <= s[2]) for path, slots in self.slots.items()}
        self.varying, self.chars, self.linked = (self._totals(f) for f in (self.own, *({p: sum(s[k] for s in slots) for p, slots in self.slots.items()} for k in (2, 3))))
        self.roots = self._articles() or self._widest()
        self.left_out = {p for p in self.slots if any(self._is_left_out(p, r) for r in self.roots)}
        self.skipped: dict[tuple, set[int]] = {}
        for root in self.roots:
            inside = [(p, slots) for p, slots in self.elements if p[: len(root)] == root and not any(p[:k] in self.left_out for k in range(len(root) + 1, len(p) + 1))]
            # an article's title stays even where all pages have the same
            gone = [(p, marks) for p, slots in inside if not (self._named_root(root) and _name(p[-1]) == "h1") and (marks := self._gone(slots))]
            share = self.pages * sum(m & 0xFFFFFF for _, marks in gone for m in marks)
            if not self._named_root(root) or share <= FIXED_SHARE * sum(s[2] for _, slots in inside for s in slots):
                for p, marks in gone:
                    self.skipped.setdefault(p, set()).update(marks)

    def _read(self, nodes: list, path: tuple, repeats: bool) -> None:
        """Each element's path and slots, and the paths of repeated elements."""
        slots: list = []
        self.elements.append((path, slots))
        waiting = [(n, repeats) for n in reversed(nodes)]
        while waiting:
            n, again = waiting.pop()
            if n[0] == "#":
                slots.append(n)
            elif n[0] == "e":
                if not _is_dropped(n[1]):
                    if again:
                        self.repeated.add((*path, n[1]))
                    self._read(n[2], (*path, n[1]), False)
            else:
                waiting += [(x, again or n[0] == "+") for x in reversed(n[1])]

    def _is_everywhere(self, slot: list) -> bool:
        return self.different >= EVIDENCE and bool(slot[4]) and slot[1] >= self.pages

    def _is_fixed(self, slot: list) -> bool:
        return self._is_everywhere(slot) and bool(slot[5])

    def _gone(self, slots: list) -> list[int]:
        """The marks of an element's own texts that go: those that all pages have beside others, if that
        is evident; where they have no others, links, or one text."""
        evident = lambda marks: [m for m in marks if (m & 0xFFFFFF) * self.pages >= EVIDENT]
        if slots and all(map(self._is_fixed, slots)):
            if 2 * sum(s[3] for s in slots) > sum(s[2] for s in slots):
                return [m for s in slots for m in s[4]]
            return evident(m for s in slots for m in s[4]) if all(len(set(s[4])) == 1 for s in slots) else []
        return evident(m for s in slots if self._is_everywhere(s) and not s[5] for m in s[4])

    def _totals(self, own: dict[tuple, int]) -> dict[tuple, int]:
        total: dict[tuple, int] = {}
        for path, n in own.items():
            for k in range(len(path) + 1):
                total[path[:k]] = total.get(path[:k], 0) + n
        return total

    def _named_root(self, root: tuple) -> bool:
        return bool(root) and (_name(root[-1]) in ("article", "main") or root[-1].endswith(":m"))

    def _articles(self) -> set[tuple]:
        """The outermost article elements, else main ones: those with text of their pages' own beside
        links where any has, and none that is named as a comment or the like where another isn't. One
        inside that holds nearly all of its text takes an element's place."""
        for test in (lambda p: _name(p) == "article", lambda p: p.endswith(":m") or _name(p) == "main"):
            found = {p for p in self.slots if p and test(p[-1]) and not any(test(x) for x in p[:-1])}
            found = {p for p in found if not _is_named(p[-1])} or found
            found = {p for p in found if self.varying[p]} or found
            if found:
                return {self._inner(p, test) for p in found}
        return set()

    def _inner(self, path: tuple, test) -> tuple:
        while True:
            below = [p for p in self.slots if len(p) > len(path) and p[: len(path)] == path and test(p[-1]) and not any(test(x) for x in p[len(path) : -1])]
            below = [p for p in below if p not in self.repeated and self.varying[p] >= SHARE_BELOW * max(self.varying[path], 1)]
            if not below:
                return path
            path = min(below)

    def _widest(self) -> set[tuple]:
        """Without article elements: the deepest element that still holds most of the text that varies
        and isn't linked, a heading beside it included."""
        total, at = {p: n for p, n in self.varying.items() if not any(_is_named(x) for x in p)}, ()
        total = total if any(total.values()) else self.varying
        while True:
            below = sorted((p for p in total if len(p) == len(at) + 1 and p[: len(at)] == at), key=lambda p: (-total[p], p))
            whole = sum(total[p] for p in below) + self.own.get(at, 0)
            if not below or _name(below[0][-1]) in TEXT_LEVEL or total[below[0]] < SHARE_BELOW * whole:
                break
            if any(_name(p[-1]) in ("h1", "h2", "h3") and self.own.get(p) for p in below[1:]):
                break
            at = below[0]
        return {at} if self.varying.get(at) else set()

    def _is_left_out(self, path: tuple, root: tuple) -> bool:
        """Whether an element inside a root isn't of the article: an article in an article is a reader's
        comment unless it has a heading of its own, as parts have; one that is named so must bear it
        out by texts that are fixed or mostly links, by repeating, or by holding less than half of what
        varies."""
        if len(path) <= len(root) or path[: len(root)] != root:
            return False
        if _name(path[-1]) == "article" and any(_name(x) == "article" for x in root[-1:]):
            if not any(p[: len(path)] == path and _name(p[-1]) in ("h1", "h2", "h3", "hgroup") for p in self.slots):
                return True
        if not _is_named(path[-1]):
            return False
        inside = [s for p, slots in self.slots.items() if p[: len(path)] == path for s in slots]
        fixed, links = all(self._is_fixed(s) for s in inside), 2 * self.linked[path] > self.chars[path]
        repeats = path in self.repeated or any(p[: len(path)] == path for p in self.repeated if len(p) == len(path) + 1)
        return fixed or links or repeats or 2 * self.varying[path] < self.varying[root]


def _name(label: str) -> str:
    return re.split(r"[.:]", label, maxsplit=1)[0]


def _is_dropped(label: str) -> bool:
    # an article's own header holds its title; the page's does not stand inside an article
    return label.endswith((":x", ":x:m")) or _name(label) in DROPPED


def _is_named(label: str) -> bool:
    return any(w in NAMED for w in re.split(r"[.:]", label)[1:])


@lru_cache(4096)
def wrapper_of(text: str) -> Wrapper:
    return Wrapper(json.loads(text))


def blocks_of(element: Element, out: list[str], path: tuple, wrapper: Wrapper) -> None:
    """The element's blocks of text, in order, but for those that the wrapper skips or leaves out."""
    run: list[str] = []
    fixed = wrapper.skipped.get(path)

    def block():
        if run and not (fixed and mark(" ".join(" ".join(run).split())) in fixed):
            words = " ".join(html.unescape("".join(run)).split())
            if words:
                out.append(words)
        run.clear()

    for child in element.children:
        if not isinstance(child, Element):
            run.append(child[0])
        elif child.name not in BLOCK:
            continue
        else:
            block()
            if (not child.dropped and (*path, child.label) not in wrapper.left_out) or (child.name == "header" and element.name in ("article", "main") and _has_heading(child)):
                blocks_of(child, out, (*path, child.label), wrapper)
    block()


def _has_heading(element: Element) -> bool:
    """Whether a header is the article's own: the page's stands outside of it and names the site."""
    return any(isinstance(c, Element) and (c.name in ("h1", "h2", "h3", "hgroup") or (c.name == "div" and _has_heading(c))) for c in element.children)


def article_text(page: Element, wrapper: Wrapper) -> str | None:
    """The blocks of the elements that the wrapper names, one a line; None if the page has none."""
    out: list[str] = []
    found = False

    def visit(element: Element, path: tuple) -> None:
        nonlocal found
        for child in element.children:
            if isinstance(child, Element) and child.name in BLOCK and not child.dropped:
                at = (*path, child.label)
                if at in wrapper.roots:
                    found = True
                    blocks_of(child, out, at, wrapper)
                else:
                    visit(child, at)

    if () in wrapper.roots:
        found = True
        blocks_of(page, out, (), wrapper)
    else:
        visit(page, ())
    return "\n".join(out) if found else None


def main_text(page: str, wrapper: str | None) -> str:
    tree = parse(page)
    text = article_text(tree, wrapper_of(wrapper)) if wrapper else None
    if text is None:
        text = article_text(tree, Wrapper(page_shape(tree)))
    return text or ""


def host_of(url: Column) -> Column:
    """The lower-case host of an address, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) for each host: its pages folded in the tasks that read them, then in PARTS
    groups a host, then together. A host's rows in one task are at most PARTS. Null pages teach nothing,
    repeated ones nothing new; an empty table has no wrappers; other columns are not read."""

    def fold(batches):
        held: dict[str, list] = {}

        def flush():
            names = list(held)
            rows = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([json.dumps(held[h], separators=(",", ":")) for h in names], pa.string())], ["host", "wrapper"])
            held.clear()
            return rows

        for batch in slices(batches, "html"):
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                nodes = page_shape(parse(page))
                held[host] = bounded(aligned(held[host], nodes)) if host in held else nodes
                if len(held) >= HOSTS_HELD:
                    yield flush()
        if held:
            yield flush()

    def merge(batches):
        host, nodes = None, None
        for batch in batches:
            for name, wrapper in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist()):
                new = json.loads(wrapper)
                if nodes is not None and name == host:
                    nodes = bounded(aligned(nodes, new))
                else:
                    if nodes is not None:
                        yield _row(host, nodes)
                    host, nodes = name, new
        if nodes is not None:
            yield _row(host, nodes)

    schema = "host string, wrapper string"
    rows = pages.filter(F.col(html_col).isNotNull()).select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(fold, schema)
    part = F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)).alias("part")
    some = rows.select("host", part, "wrapper").repartition("host", "part").sortWithinPartitions("host", "wrapper").select("host", "wrapper").mapInArrow(merge, schema)
    return some.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(merge, schema)


def _row(host: str, nodes: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([json.dumps(nodes, separators=(",", ":"))], pa.string())], ["host", "wrapper"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: `id_col`, `url_col`, text, n_chars. Null and empty pages, and pages
    without an article, give the empty text; pages without a host share one wrapper; repeated rows
    give equal rows; an empty table gives no rows; other columns are not read. An id or address column of
    a result's name gives way to the result."""
    wrappers = written(infer_wrappers(pages, url_col, html_col), "wrappers")
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    keyed = pages.select(F.col(id_col).alias("k"), F.col(url_col).alias("u"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = keyed.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left")
    key, url = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batches):
        for batch in slices(batches, "html"):
            texts = [main_text(p or "", w) for p, w in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("u"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["k", "u", "text", "n_chars"])

    out = joined.select("k", "u", "html", "wrapper").mapInArrow(run, f"k {key}, u {url}, text string, n_chars long")
    carried = [F.col(x).alias(c) for x, c in (("k", id_col), ("u", url_col)) if c not in ("text", "n_chars")]
    return out.select(*carried, "text", "n_chars")
