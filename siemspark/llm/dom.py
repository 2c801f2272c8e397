"""A small tolerant HTML tree: tags, their class words, and text between them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")

# Fixed values of HTML: elements without content, raw-text elements, block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
_RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
#: Ids of sections and headings name a topic, not a part of the layout.
NAMED = frozenset("section h1 h2 h3 h4 h5 h6".split())
#: What the start of an element ends: the elements, and those that shield them.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "option": ({"option"}, {"select", "datalist"})}
_P_SHIELD = {"table", "td", "th", "button", "caption", "object"}


@dataclass(slots=True)
class Node:
    tag: str
    words: frozenset[str] = frozenset()
    role: str = ""
    children: list = field(default_factory=list)  # nodes and texts in order

    @property
    def label(self) -> str:
        return ".".join([self.tag, *sorted(self.words)]) if self.words else self.tag


class _Scanner:
    """Finds the markup of a source from left to right.  No part is read more than a few times, however broken it is."""

    def __init__(self, source: str):
        self.source = source
        # Behind these nothing of the kind follows.
        self.last = {c: source.rfind(c) for c in ('>', '"', "'")}

    def tag_end(self, at: int) -> int:
        """The position of the ``>`` that ends a tag, -1 if there is none.  Quotes hide it; one that is not closed does not."""
        source, last, start = self.source, self.last, at
        if at > last[">"]:
            return -1
        while True:
            m = _STOP.search(source, at)
            if not m:
                # All that is left is quoted: the tag ends as if there were no quotes.
                return source.find(">", start)
            c = m[0]
            if c == ">":
                return m.start()
            at = m.end()
            if at <= last[c]:
                at = source.index(c, at) + 1

    def next(self, at: int):
        """(start of the markup, its end, whether it is an end tag, tag, attributes) from ``at`` on; the tag is empty for
        comments and the like.  None behind the last one."""
        source, size = self.source, len(self.source)
        while True:
            m = _OPEN.search(source, at)
            if not m:
                return None
            if m[1] or m[2]:
                mark = "-->" if m[1] else "]]>"
                end = source.find(mark, m.end())
                return m.start(), size if end < 0 else end + 3, False, "", ""
            if m[3]:
                end = source.find(">", m.end()) if m.end() <= self.last[">"] else -1
            else:
                end = self.tag_end(m.end())
            if end >= 0:
                return (m.start(), end + 1, bool(m[4]), m[5].lower(), source[m.end():end]) if m[5] else (
                    m.start(), end + 1, False, "", "")
            # A tag that does not end is text, as is everything behind it.
            at = m.end()
            if at > self.last[">"]:
                rest = source.find("<!--", at)
                if rest < 0:
                    rest = source.find("<![CDATA[", at)
                if rest < 0:
                    return None
                at = rest


class _Stack:
    """Open elements, and where those of each tag are."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        for node in self.nodes[at:]:
            self.places[node.tag].pop()
        del self.nodes[at:]

    def top(self, tags) -> int:
        """The place of the innermost element with one of some tags, -1 if none is open."""
        return max([p[-1] for p in map(self.places.get, tags) if p], default=-1)

    def close(self, tags: set[str], shield: set[str]) -> None:
        """Ends the innermost of ``tags``, unless one of ``shield`` is inside it."""
        at = self.top(tags)
        if at > 0 and at > self.top(shield - tags):
            self.cut(at)


def parse(source: str | None) -> Node:
    """The tree of a page; whatever the source, every text ends up in it once."""
    root = Node("#root")
    stack = _Stack(root)
    source = source or ""
    scanner, at = _Scanner(source), 0
    while True:
        found = scanner.next(at)
        text = source[at:found[0] if found else len(source)]
        if text:
            stack.nodes[-1].children.append(html.unescape(text))
        if not found:
            return root
        _, at, ends, tag, attributes = found
        if not tag:
            continue
        if ends:
            place = stack.top((tag,))
            if place > 0 and not (tag in ("p", "li", "b", "i", "a", "span") and stack.top(_P_SHIELD) > place):
                stack.cut(place)
            continue
        if tag in BLOCK:
            stack.close({"p"}, _P_SHIELD)
        if tag in _ENDS:
            stack.close(*_ENDS[tag])
        words, role = frozenset(), ""
        if attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                name = name.lower()
                if name == "class" or name == "id" and tag not in NAMED:
                    words |= {w.lower() for w in _WORD.findall("".join(values))}
                elif name == "role":
                    role = "".join(values).lower()
        node = Node(tag, words, role)
        stack.nodes[-1].children.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            if not end:
                return root  # raw text up to the end of the page
            close = source.find(">", end.start())
            at = len(source) if close < 0 else close + 1
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.push(node)
        elif tag not in VOID and tag in BLOCK:
            stack.push(node)  # a slash ends no block element


def blocks(node: Node, skip) -> list[str]:
    """Texts of the blocks below ``node`` in page order, white space collapsed, empty ones left out."""
    out: list[str] = []
    parts: list[str] = []

    def flush():
        text = " ".join("".join(parts).split())
        if text:
            out.append(text)
        parts.clear()

    # An own stack, because pages may nest deeper than Python calls.
    todo = [iter(node.children)]
    ends = [True]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            if ends.pop():
                flush()
        elif isinstance(child, str):
            parts.append(child)
        elif child.tag == "br":
            parts.append(" ")
        elif child.tag in RAW or skip(child):
            if child.tag in BLOCK:
                flush()
        else:
            block = child.tag in BLOCK
            if block:
                flush()
            todo.append(iter(child.children))
            ends.append(block)
    return out
