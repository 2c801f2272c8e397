"""Main text of web pages by wrapper induction.

The DOM trees of the pages of a host are aligned by simple tree matching: the
largest set of node pairs with equal labels that keeps order and ancestors.
Aligned pages are merged into one wrapper tree, in which runs of equally labelled
siblings are one slot.  The way to the article goes down as long as one container
holds all text that varies; elements on it are never taken for menus and the like.
Every page of a host takes part: equal trees are merged as one, ``FAN`` at a time, and
so are the wrappers that come out, until a host has one.  A wrapper above ``SLOTS`` nodes
loses its rarest nodes off the way; they only weigh on how siblings are aligned.

Texts are counted by host, path and layout over all pages.  A text that is the same
on nine tenths of the pages that have its slot is template, unless those pages are
copies of one article; it goes, also inside marked articles.  The rest of what the
markup calls the article, or else of the page, stays but for menus, adverts and
the like: by tag or role, and where words of class and id say so, if all other text
there is short.

Defined results: null and empty pages give an empty text, as do pages without text
outside boilerplate.  A null or odd url is a host of its own name.  Repeated rows are
extracted alike; null page ids are carried along.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siemspark.llm.common import mix64, stage
from siemspark.llm.dom import BLOCK, RAW, Node, blocks, parse
from siemspark.llm.minhash import shingles

FAN = 16  # trees that one task aligns with each other
SLOTS = 2_000  # nodes of a wrapper
ROWS = 256
SHORT = 100  # characters of a block that elements marked by words may lose
CONTENT_WORDS = 5  # that pages must hold besides constant text, to be more than copies
WIDE = 2_500  # pairs of siblings that are all compared
COPIES = 3  # samples that near copies must differ in

# Elements, roles and class words of what is not the article.
CHROME_TAGS = frozenset("nav footer aside form button select input dialog menu svg object embed canvas head map "
                        "audio video fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu "
                         "menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion "
    "banner sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commenting "
    "commentlist reply replies respond disqus discussion cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations trending toolbar pagination pager search masthead topbar skip paywall disclaimer teaser".split())
COMMENT_WORDS = frozenset({"comment", "comments"})
MAIN_TAGS = ("article", "main")
WRAPPING_TAGS = frozenset("form fieldset object".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("#root html body div section article main td tr tbody table center".split())


def is_chrome(node: Node, inside_article: bool = False) -> bool:
    """Whether tag or role say that an element is not part of the article."""
    if node.tag in ("html", "body", *MAIN_TAGS):
        return False
    if node.tag in WRAPPING_TAGS and _holds(node, ("article", "main", "h1")):
        return False
    if node.tag == "header":
        return not inside_article
    return node.tag in CHROME_TAGS or node.role in CHROME_ROLES


def is_hinted(node: Node, inside_article: bool = False) -> bool:
    """Whether words of class or id hint that an element is not part of the article; its text decides (``cuts``)."""
    if node.tag in ("html", "body") or node.tag in MAIN_TAGS and not node.words & COMMENT_WORDS:
        return False
    if node.words & {"header", "masthead"}:
        return not inside_article
    return bool(node.words & CHROME_WORDS) and not node.words & {"has", "with", "no"}


def _holds(node: Node, tags: tuple[str, ...]) -> bool:
    """Whether one of some elements is below a node, comments aside."""
    todo = [node]
    while todo:
        for c in todo.pop().children:
            if not isinstance(c, str):
                if (c.tag in tags or c.role in tags) and not c.words & COMMENT_WORDS:
                    return True
                todo.append(c)
    return False


def _holding(root: Node, tags: tuple[str, ...]) -> set[int]:
    """Ids of all nodes for which ``_holds``."""
    out, todo = set(), [(root, None)]
    way: list[Node] = []
    depth = {id(root): 0}
    while todo:
        node, parent = todo.pop()
        del way[depth[id(node)]:]
        way.append(node)
        for c in reversed(node.children):
            if not isinstance(c, str):
                depth[id(c)] = len(way)
                todo.append((c, node))
        if parent is not None and (node.tag in tags or node.role in tags) and not node.words & COMMENT_WORDS:
            for above in reversed(way[:-1]):
                if id(above) in out:
                    break
                out.add(id(above))
    return out


def _step(path: int, label: str) -> int:
    return xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), path)


def _walk(root: Node, inside_article: bool, stop=lambda node, path: False):
    """(node, path) of all elements outside chrome, in page order; a path goes through block elements.

    Nothing below a node that ``stop`` holds for is visited.
    """
    todo = [(root, _step(0, root.label))]
    while todo:
        node, path = todo.pop()
        yield node, path
        if stop(node, path):
            continue
        for c in reversed(node.children):
            if not isinstance(c, str) and c.tag not in RAW and not is_chrome(c, inside_article):
                todo.append((c, _step(path, c.label) if c.tag in BLOCK else path))


def located(node: Node, path: int, skip, cut: set[int] | frozenset[int] = frozenset(),
            spans: dict[int, tuple[int, int]] | None = None) -> list[tuple[int, str, str]]:
    """(path, text, text without cut inline elements) of the blocks below ``node``, as ``blocks`` finds them.

    ``spans`` receives, for every block element visited, which of these blocks are below it.
    """
    inside: list[tuple[int, int]] = []
    out: list[tuple[int, str, str]] = []
    parts: list[str] = []
    left: list[str] = []
    todo, ends, at = [iter(node.children)], [True], [path]

    def flush():
        text = " ".join("".join(parts).split())
        if text:
            out.append((at[-1], text, " ".join("".join(left).split())))
        parts.clear()
        left.clear()

    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            if ends.pop():
                flush()
                if inside:
                    key, first = inside.pop()
                    spans[key] = first, len(out)
            at.pop()
        elif isinstance(child, str):
            parts.append(child)
            left.append(child)
        elif child.tag == "br":
            parts.append(" ")
            left.append(" ")
        elif child.tag in RAW or skip(child) or child.tag in BLOCK and id(child) in cut:
            if child.tag in BLOCK:
                flush()
        elif id(child) in cut:
            parts.append(" ".join(blocks(child, skip)))
        else:
            block = child.tag in BLOCK
            if block:
                flush()
                if spans is not None:
                    inside.append((id(child), len(out)))
            todo.append(iter(child.children))
            ends.append(block)
            at.append(_step(at[-1], child.label) if block else at[-1])
    return out


class Page:
    """A parsed page: where its article may be, and the keys of its blocks in the counts of its host."""

    def __init__(self, source: str | None):
        self.root = parse(source)
        marked = _marked(self.root)
        self.scope = marked if marked is not None else self.root
        self.article = marked is not None
        self.hard = lambda c: is_chrome(c, self.article)
        self.base = _step(0, self.scope.label)
        self.spans: dict[int, tuple[int, int]] = {}
        self.blocks = [(p, t) for p, t, _ in located(self.scope, self.base, self.hard, spans=self.spans)]
        shape = sorted({p for n, p in _walk(self.scope, self.article) if n.tag in CONTAINERS})
        self.layout = xxhash.xxh3_64_intdigest(str(shape).encode())

    def slots(self, path: int, host: str) -> tuple[int, int]:
        """Keys of a slot on all pages of a host, and on those of this layout."""
        name = host.encode("utf-8", "surrogatepass")
        return (xxhash.xxh3_64_intdigest(name, path), xxhash.xxh3_64_intdigest(name, path ^ self.layout))

    def keys(self, host: str) -> set[tuple[int, int]]:
        """(slot, text) of every distinct block; text 0 counts the pages that have the slot."""
        out = set()
        for path, text in self.blocks:
            for slot in self.slots(path, host):
                out.add((slot, 0))
                out.add((slot, text_key(slot, text)))
        return out

    def constant(self, path: int, text: str, host: str, template: frozenset[int]) -> bool:
        return bool(template) and any(text_key(s, text) in template for s in self.slots(path, host))

    def contents(self, host: str, candidates: frozenset[int]) -> list[int]:
        """What a page holds besides constant text, as ``COPIES`` samples that near copies have in common."""
        rest = " ".join(t for p, t in self.blocks if not self.constant(p, t, host, candidates))
        if len(rest.split()) < CONTENT_WORDS:
            return [0] * COPIES
        found = shingles(rest, CONTENT_WORDS)
        return [int(mix64(found ^ mix64(np.uint64(j + 1))).min() | np.uint64(1)) for j in range(COPIES)]

    def cuts(self, host: str = "", template: frozenset[int] = frozenset(), way: frozenset[int] = frozenset()) -> set[int]:
        """Elements off the way to the article that words mark as chrome and that hold short or constant text only."""
        spans = self.spans
        sizes = [0 if self.constant(p, t, host, template) else len(t) for p, t in self.blocks]
        total, long = [0, *accumulate(sizes)], [0, *accumulate(n >= SHORT for n in sizes)]
        varying, holding = total[-1], _holding(self.scope, ("article", "main", "h1"))
        out: set[int] = set()

        def cut(node: Node, path: int) -> bool:
            if node is self.scope or node.tag in HEADINGS or not is_hinted(node, self.article):
                return False
            if path in way and node.tag in BLOCK or id(node) in holding:
                return False
            if id(node) in spans:
                first, end = spans[id(node)]
                own, far = total[end] - total[first], long[end] - long[first]
            else:
                # An inline element is part of a block.
                texts = [len(t) for p, t, _ in located(node, path, self.hard) if not self.constant(p, t, host, template)]
                own, far = sum(texts), sum(n >= SHORT for n in texts)
            if not far and 2 * own <= varying:
                out.add(id(node))
            # Nothing inside an inline element is looked at again.
            return id(node) in out or id(node) not in spans

        for _ in _walk(self.scope, self.article, cut):
            pass
        return out

    def text(self, host: str = "", template: frozenset[int] = frozenset(), way: frozenset[int] = frozenset()) -> str:
        """The article as blocks joined by line ends."""
        cut = self.cuts(host, template, way)
        if not cut:
            return "\n".join(t for p, t in self.blocks if not self.constant(p, t, host, template))
        return "\n".join(left for path, text, left in located(self.scope, self.base, self.hard, cut)
                         if left and not self.constant(path, text, host, template))

    def tree(self, host: str = "", template: frozenset[int] = frozenset()) -> Slot:
        """The page for matching: what varies is text outside chrome that is not constant."""
        cut = self.cuts(host, template)
        fixed = {t for p, t in self.blocks if self.constant(p, t, host, template)}
        return folded(self.root, skip=lambda c: is_chrome(c) or id(c) in cut, fixed=fixed)


def text_key(slot: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), slot) | 1


def often(n: int, of: int) -> bool:
    """Whether a text on ``n`` of the ``of`` pages that have its slot is constant."""
    return n >= 2 and 10 * n >= 9 * of


def template_keys(pages: list[Page], host: str = "") -> frozenset[int]:
    """Keys of the template texts of some pages: the plain version of ``templates``."""
    count = Counter(k for p in pages for k in p.keys(host))
    candidates = frozenset(t for (s, t), n in count.items() if t and often(n, count[s, 0]))
    seen: dict[tuple[int, int, int], set[int]] = {}
    for page in pages:
        found = page.contents(host, candidates)
        for slot, text in page.keys(host):
            if not text or text in candidates:
                for j, c in enumerate(found):
                    seen.setdefault((slot, text, j), set()).add(c)
    failed = {t for (s, t, j), c in seen.items() if t and not often(len(c), len(seen[s, 0, j]))}
    return candidates - failed


def own_text(node: Node, skip=is_chrome) -> str:
    """Text of a node and its inline children, as one block."""
    parts, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.tag == "br":
            parts.append(" ")
        elif c.tag not in BLOCK and not skip(c):
            todo.extend(reversed(c.children))
    return " ".join("".join(parts).split())


def _has_text(node: Node, skip=is_chrome) -> bool:
    """Whether ``own_text`` is not empty."""
    todo = list(node.children)
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            if c and not c.isspace():
                return True
        elif c.tag not in BLOCK and c.tag != "br" and not skip(c):
            todo.extend(c.children)
    return False


CONTAINER, MAIN, VARIES, ENDS = 1, 2, 4, 8


class Slot:
    """A node of a tree for matching: block elements only, runs of equal siblings folded.

    ``flags`` say what the tag is, whether own text varies, and whether the way to the article is known to end here;
    ``texts`` are own texts that are constant, ``pages`` the merged trees that have the node.
    """

    __slots__ = ("children", "flags", "label", "pages", "texts")

    def __init__(self, label: str, flags: int, pages: int = 1, children: list[Slot] | None = None):
        self.label, self.flags, self.pages = label, flags, pages
        self.children, self.texts = children or [], frozenset()

    def packed(self) -> list:
        return [self.label, self.flags, self.pages, [c.packed() for c in self.children]]


def unpacked(data: list) -> Slot:
    label, flags, pages, children = data
    return Slot(label, flags, pages, [unpacked(c) for c in children])


def folded(node: Node, depth: int = 40, chrome: bool = False, skip=is_chrome, fixed: set[str] | frozenset[str] = frozenset()) -> Slot:
    """The matching tree of one page; nesting beyond ``depth`` counts as text of its ancestor."""
    chrome = chrome or skip(node)
    slot = Slot(node.label, (node.tag in CONTAINERS) * CONTAINER | (node.tag in MAIN_TAGS) * MAIN)
    if not chrome:
        if depth and not fixed:
            varies = _has_text(node, skip)
        else:
            text = own_text(node, skip) if depth else "\n".join(blocks(node, skip))
            varies = bool(text) and text not in fixed
            if text in fixed:
                slot.texts = frozenset([text])
        slot.flags |= varies * VARIES
    if depth:
        todo, found = list(reversed(node.children)), []
        while todo:
            c = todo.pop()
            if not isinstance(c, str):
                if c.tag in BLOCK:
                    found.append(folded(c, depth - 1, chrome, skip, fixed))
                else:
                    todo.extend(reversed(c.children))
        for child in found:
            last = slot.children[-1] if slot.children else None
            if last is not None and last.label == child.label and not last.children and not child.children:
                last.texts |= child.texts
                last.flags |= child.flags
            else:
                slot.children.append(child)
    return slot


def matching(a: Slot, b: Slot, memo: dict) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: the most node pairs below two roots of equal label, and the children matched."""
    if a.label != b.label:
        return 0, []
    key = (id(a), id(b))
    if key not in memo:
        left, right = a.children, b.children
        if len(left) * len(right) <= WIDE:
            pairs = _best_pairs(left, right, memo)
        else:
            # Siblings alike from both ends are the same slots; what is between them is matched if it is little.
            n = min(len(left), len(right))
            head = next((i for i in range(n) if left[i].label != right[i].label), n)
            tail = next((i for i in range(n - head) if left[-1 - i].label != right[-1 - i].label), n - head)
            inner = left[head:len(left) - tail], right[head:len(right) - tail]
            within = _best_pairs(*inner, memo) if len(inner[0]) * len(inner[1]) <= WIDE else _in_turn(*inner)
            pairs = [*zip(left[:head], right[:head], strict=True), *within,
                     *(zip(left[-tail:], right[-tail:], strict=True) if tail else ())]
        memo[key] = 1 + sum(matching(x, y, memo)[0] for x, y in pairs), pairs
    return memo[key]


def _best_pairs(left: list[Slot], right: list[Slot], memo: dict) -> list[tuple[Slot, Slot]]:
    """Pairs in order with the most matched nodes below them."""
    m, n = len(left), len(right)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            w = matching(left[i - 1], right[j - 1], memo)[0]
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w if w else 0)
    pairs, i, j = [], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((left[i], right[j]))
    return pairs[::-1]


def _in_turn(left: list[Slot], right: list[Slot]) -> list[tuple[Slot, Slot]]:
    """Each with the next equal label on the other side: for very long lists of siblings."""
    places: dict[str, list[int]] = {}
    for j, b in enumerate(right):
        places.setdefault(b.label, []).append(j)
    pairs, at = [], 0
    for a in left:
        found = places.get(a.label, [])
        k = bisect_left(found, at)
        if k < len(found):
            pairs.append((a, right[found[k]]))
            at = found[k] + 1
    return pairs


def merge(wrapper: Slot, page: Slot, memo: dict) -> None:
    """Adds an aligned page: matched nodes share texts, others become optional nodes of the wrapper."""
    _, pairs = matching(wrapper, page, memo)
    wrapper.pages += page.pages
    wrapper.flags |= page.flags
    wrapper.texts |= page.texts
    partner = {id(b): a for a, b in pairs}
    # The wrapper's nodes up to the next twin come first, then the page's own ones.
    out, rest = [], iter(wrapper.children)
    for child in page.children:
        twin = partner.get(id(child))
        if twin is None:
            out.append(child)
            continue
        merge(twin, child, memo)
        for x in rest:
            out.append(x)
            if x is twin:
                break
    out.extend(rest)
    wrapper.children = out


def _mass(root: Slot) -> set[int]:
    """Ids of all slots with varying text at or below them."""
    out: set[int] = set()

    def holds(slot: Slot) -> bool:
        below = [holds(c) for c in slot.children]
        if any(below) or slot.flags & (VARIES | ENDS):
            out.add(id(slot))
            return True
        return False

    holds(root)
    return out


def way(wrapper: Slot) -> list[Slot]:
    """The slots on the way to the article; the last is marked if more pages cannot lead the way on below it."""
    path, mass = [wrapper], _mass(wrapper)
    while True:
        at = path[-1]
        # Down only where nothing that varies is left behind: own text, and siblings of another label.
        held = [c for c in at.children if id(c) in mass]
        if at.flags & (MAIN | VARIES | ENDS) or len(held) > 1 or held and not held[0].flags & CONTAINER:
            at.flags |= ENDS
            return path
        if not held:
            return path
        path.append(held[0])


def trimmed(wrapper: Slot, limit: int = SLOTS) -> Slot:
    """Without the rarest slots off the way, if there are too many.  The way stays, whatever is merged later."""
    path = {id(x) for x in way(wrapper)}

    def size(slot: Slot) -> int:
        return 1 + sum(map(size, slot.children))

    def drop(slot: Slot, least: int) -> None:
        slot.children = [c for c in slot.children if c.pages >= least or id(c) in path]
        for c in slot.children:
            drop(c, least)

    least = 1
    while size(wrapper) > limit and least <= wrapper.pages:
        least *= 2
        drop(wrapper, least)
    return wrapper


def aligned(trees: list[Slot]) -> Slot:
    """One wrapper of some trees, aligned one after the other."""
    wrapper = trees[0]
    for tree in trees[1:]:
        merge(wrapper, tree, {})
    return wrapper


def induce(pages: list[str]) -> dict | None:
    """The wrapper of some pages: the labels on the way to the article, and template texts."""
    if len(pages) < 2:
        return None
    read = [Page(p) for p in pages]
    keys = template_keys(read)
    path = way(aligned([page.tree("", keys) for page in read]))
    return {"path": [x.label for x in path], "template": sorted(_inside(path[-1]))}


def _inside(slot: Slot) -> set[str]:
    """Constant texts below a slot, outside chrome."""
    found, todo = set(), [slot]
    while todo:
        at = todo.pop()
        found |= at.texts
        todo.extend(at.children)
    return found


def way_of(labels: list[str]) -> frozenset[int]:
    """Paths of all nodes on a wrapper's way to the article."""
    return frozenset(accumulate(labels, _step, initial=0))


def _marked(root: Node) -> Node | None:
    """The largest element that its markup calls the article; those inside another of their kind are smaller."""
    found, todo = [], [(root, frozenset())]
    while todo:
        node, inside = todo.pop()
        for c in node.children:
            if not isinstance(c, str) and not is_chrome(c):
                kinds = inside
                if (c.tag in MAIN_TAGS or c.role in MAIN_TAGS) and not c.words & COMMENT_WORDS:
                    kinds = inside | {c.tag, c.role}
                    found.append((c, kinds - inside))
                todo.append((c, kinds))
    for tag in MAIN_TAGS:
        own = [x for x, kinds in found if tag in kinds]
        if own:
            return max(own, key=lambda x: sum(map(len, blocks(x, is_chrome))))
    return None


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _merge(table: pa.Table) -> pa.Table:
    trees = [unpacked(json.loads(t)) for t in sorted(table["tree"].to_pylist())]
    return pa.table({"host_id": table["host_id"][:1],
                     "tree": pa.array([json.dumps(trimmed(aligned(trees)).packed())], pa.string())})


def _way(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        paths = [json.dumps([x.label for x in way(unpacked(json.loads(t)))]) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["host_id", "wrapper"])


def wrappers(trees: DataFrame, fan: int = FAN) -> DataFrame:
    """(host_id, wrapper): the way to the article on every host with different pages, from the trees of all its pages.

    Equal trees are one, then ``fan`` of a host at a time, by hash, become one wrapper, until there is one.  Neither the
    order of rows nor how they are partitioned matters.
    """
    trees = stage(trees.groupBy("host_id", "tree").agg(F.min("page").alias("lo"), F.max("page").alias("hi")), "trees")
    different = trees.groupBy("host_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
    left = trees.select("host_id", "tree").join(different.select("host_id"), "host_id")
    while True:
        count = left.groupBy("host_id").agg(F.count("*").alias("n"))
        if (count.agg(F.max("n").alias("n")).first()["n"] or 0) <= 1:
            return left.mapInArrow(_way, "host_id long, wrapper string")
        part = F.pmod(F.xxhash64("tree"), F.ceil(F.col("n") / fan))
        left = stage(left.join(count, "host_id").groupBy("host_id", part.alias("part"))
                     .applyInArrow(_merge, "host_id long, tree string"), "wrappers")


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


class _Trees:
    """Trees of pages as rows: each tree of a host once, and two of its pages if they differ, while the memo lasts."""

    def __init__(self):
        self.trees: set[tuple[int, int]] = set()
        self.pages: dict[int, set[int]] = {}

    def __call__(self, key: int, source: str | None, tree: Slot) -> list[tuple[int, int, str]]:
        if not source:
            return []
        if len(self.trees) > 10_000 or len(self.pages) > 100_000:
            self.trees.clear()
            self.pages.clear()
        text, page = json.dumps(tree.packed()), xxhash.xxh3_64_intdigest(source.encode("utf-8", "surrogatepass"))
        pages, known = self.pages.setdefault(key, set()), (key, xxhash.xxh3_128_intdigest(text.encode()))
        if known in self.trees and (page in pages or len(pages) > 1):
            return []
        self.trees.add(known)
        pages.add(page)
        return [(key, page, text)]


def _count(batches: Iterator[pa.RecordBatch]):
    """Keys of the blocks of all pages, and the trees of the pages as they are if nothing is template."""
    trees_of = _Trees()
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part, rows = batch.slice(at, ROWS), []
            for key, host, source in zip(*(c.to_pylist() for c in part.columns), strict=True):
                page = Page(source)
                rows.extend((key, *k, None) for k in page.keys(host))
                rows.extend((k, p, 0, t) for k, p, t in trees_of(key, source, page.tree()))
            if rows:
                key, slot, text, tree = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), _signed(slot), _signed(text), pa.array(tree, pa.string())],
                    names=["host_id", "slot", "text", "tree"])


def _trees(batches: Iterator[pa.RecordBatch]):
    """Trees of pages of hosts with template texts."""
    texts_of, trees_of = _Keys(), _Trees()
    for batch in batches:
        rows = []
        for i, (key, host, source) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            rows.extend(trees_of(key, source, Page(source).tree(host, texts_of(host, batch.column(3)[i]))))
        if rows:
            key, page, tree = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), _signed(page), pa.array(tree, pa.string())],
                                             names=["host_id", "page", "tree"])


class _Keys:
    """Packed keys of hosts, unpacked once per host."""

    def __init__(self):
        self.memo: dict[str, frozenset[int]] = {}

    def __call__(self, host: str, packed: pa.Scalar) -> frozenset[int]:
        if host not in self.memo:
            if len(self.memo) > 1000:
                self.memo.clear()
            data = packed.as_py()
            self.memo[host] = frozenset(np.array(data, np.int64).view(np.uint64).tolist()) if data else frozenset()
        return self.memo[host]


def _contents(batches: Iterator[pa.RecordBatch]):
    texts_of, slots_of = _Keys(), _Keys()
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part, rows = batch.slice(at, ROWS), set()
            for i, (host, source) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                texts, slots = texts_of(host, part.column(2)[i]), slots_of(host, part.column(3)[i])
                page = Page(source)
                found = page.contents(host, texts)
                for slot, text in page.keys(host):
                    if text in texts or not text and slot in slots:
                        rows.update((slot, text, j, c) for j, c in enumerate(found))
            if rows:
                slot, text, j, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([_signed(slot), _signed(text), pa.array(j, pa.int32()), _signed(c)],
                                                 names=["slot", "text", "j", "content"])


def read(pages: DataFrame) -> DataFrame:
    """Of all pages: (host_id, slot, text) of every block, and (host_id, slot, tree), the slot being a hash of the page."""
    return stage(pages.select("host_id", "host", "html").mapInArrow(
        _count, "host_id long, slot long, text long, tree string"), "read")


def page_trees(pages: DataFrame, found: DataFrame, constant: DataFrame) -> DataFrame:
    """(host_id, page, tree) of all pages: as ``read``, but of hosts with template texts with regard to these."""
    plain = (found.where("tree IS NOT NULL").join(constant, "host_id", "left_anti")
             .select("host_id", F.col("slot").alias("page"), "tree"))
    return plain.union(pages.join(constant, "host_id").select("host_id", "host", "html", "template")
                       .mapInArrow(_trees, "host_id long, page long, tree string"))


def templates(pages: DataFrame, blocks_of: DataFrame) -> DataFrame:
    """(host_id, template): keys of the constant texts of every host, from all its pages.

    A text is constant if nine tenths of the pages that have its slot, on the host or in one layout,
    hold it.  Copies of an article share all their text too, so the same must hold for the different
    contents of those pages.
    """
    count = (blocks_of.where("tree IS NULL").groupBy("slot", "text").agg(F.count("*").alias("n"), F.min("host_id").alias("host_id"))
             .where(F.col("n") >= 2))
    count = stage(count, "slots")

    def constant(rows: DataFrame, *by: str) -> DataFrame:
        whole = rows.where("text = 0").select("slot", *by, F.col("n").alias("of"))
        return rows.where("text <> 0").join(whole, ["slot", *by]).where("n >= 2 AND 10 * n >= 9 * of")

    found = stage(constant(count).select("host_id", "slot", "text"), "candidates")
    lists = stage(found.groupBy("host_id").agg(F.collect_set("text").alias("texts"), F.collect_set("slot").alias("slots")),
                  "candidate-lists")
    seen = (pages.join(lists, "host_id").select("host", "html", "texts", "slots")
            .mapInArrow(_contents, "slot long, text long, j int, content long").distinct()
            .groupBy("slot", "text", "j").agg(F.count("*").alias("n")))
    sure = (constant(stage(seen, "contents"), "j").groupBy("text").agg(F.count("*").alias("n"))
            .where(F.col("n") == COPIES).select("text"))
    return stage(found.join(sure, "text").groupBy("host_id").agg(F.collect_set("text").alias("template")), "templates")


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    host = F.lower(F.coalesce(F.nullif(F.regexp_extract("url", HOST, 1), F.lit("")), "url", F.lit("")))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"), host.alias("host"),
                         F.xxhash64(host).alias("host_id"))
    known = read(pages)
    constant = templates(pages, known)
    found = stage(wrappers(page_trees(pages, known, constant)), "ways")

    def run(batches: Iterator[pa.RecordBatch]):
        template_of = _Keys()
        memo: dict[str | None, frozenset[int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = []
                for i, (host, source, rule) in enumerate(zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                    if rule not in memo:
                        if len(memo) > 1000:
                            memo.clear()
                        memo[rule] = way_of(json.loads(rule)) if rule else frozenset()
                    out.append(Page(source).text(host, template_of(host, part.column(5)[i]), memo[rule]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return (pages.join(found, "host_id", "left").join(constant, "host_id", "left")
            .select("page_id", "url", "host", "html", "wrapper", "template")
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
