"""Plain versions of the operators, and documents with odd rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = re.compile("[\x20\x09-\x0D]+")
PASSAGE = " ".join(f"passage{i}" for i in range(30))
LONG = " ".join(f"w{i % 7919}x{i % 13}" for i in range(60_000))
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog " * 8),
    (2, None), (3, ""), (4, " \n\t "), (None, "no id " + PASSAGE), (5, f"alpha beta {PASSAGE} gamma"),
    (6, f"delta {PASSAGE} epsilon zeta"), (7, LONG), (8, LONG + " tail"), (9, "Ünïcode wörds 日本語 \U0001f642"),
    (10, "one"), (11, "ONE"), (12, "a a a a a a a a"), (12, "a a a a a a a a"), (13, "x\x1cy\x85z \x0b end"),
    (-14, f"{PASSAGE} {PASSAGE}"), (15, "same line\nsame line\n\nother #*$ line\nsame line"), (15, "the id of another text"),
]
# Names that operators use inside.
EXTRA = {"chunk": 7, "bucket": "b", "kept": False, "key": "k", "rep": 1, "n": 2, "_llm_chunk": 3, "held_out": True, "block": 4}


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width=5):
    w = words(lower(text))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def near(rows, percent):
    """(n_shingles, component, kept) by id; rows of one id are one node."""
    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in rows}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in rows)


def cut(rows, width=13):
    owner = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for p in range(len(w) - width + 1):
                g = tuple(w[p:p + width])
                owner[g] = min(owner.get(g, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        if i is not None:
            for p in range(len(w) - width + 1):
                if owner[tuple(w[p:p + width])] < i:
                    gone[p:p + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def katz(rows, held, order, cut_at, discounts):
    """(held, tokens, known, N, base, score) per row, by dictionaries and recursion."""
    tokens = [["<s>", *words(lower(t)), "</s>"] for _, t in rows]
    count = [Counter() for _ in range(order + 1)]
    for x, h in zip(tokens, held, strict=True):
        if not h:
            for k in range(1, order + 1):
                for p in range(max(1, k - 1), len(x)):
                    count[k][tuple(x[p - k + 1:p + 1])] += 1
    total, kinds = sum(count[1].values()), len(count[1])
    d = [None] + [discounts([list(c.values()).count(r) for r in range(1, cut_at + 2)]) for c in count[1:]]

    def less(k, c):
        return c * d[k][min(c, cut_at + 1)]

    small = any(c <= cut_at for c in count[1].values())
    whole = total + (0 if small else 0.5)
    unknown = 1 - sum(less(1, c) for c in count[1].values()) / whole if total else 1.0
    after = [defaultdict(list) for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g in count[k]:
            after[k][g[:-1]].append(g)
    known = {}

    def prob(g):
        k, c = len(g), count[len(g)][g]
        if k == 1:
            return less(1, c) / whole if c else unknown
        f = after[k].get(g[:-1])
        if not f:
            return prob(g[1:])
        if g[:-1] not in known:
            n = sum(count[k][x] for x in f)
            known[g[:-1]] = n, 1 - sum(less(k, count[k][x]) for x in f) / n, 1 - sum(prob(x[1:]) for x in f)
        n, left, rest = known[g[:-1]]
        if rest < 1e-12:
            return c / n
        if left < 1e-12:
            return c / (n + 0.5) if c else 0.5 / (n + 0.5) / rest * prob(g[1:])
        return less(k, c) / n if c else left / rest * prob(g[1:])

    out = []
    for (i, _), x, h in zip(rows, tokens, held, strict=True):
        own = [count[1][(t,)] for t in x[1:]]
        base = sum(math.log10((c + 0.1) / (total + 0.1 * (kinds + 1))) for c in own)
        score = sum(math.log10(prob(tuple(x[max(0, p - order + 1):p + 1]))) for p in range(1, len(x)))
        out.append((i, h, len(own), sum(c > 0 for c in own), total, base, score))
    sums = [sum(prob((*h, w)) for w in [g[0] for g in count[1]] + ["never seen"])
            for k in range(2, order + 1) for h in list(after[k])[:10]]
    return out, sums


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def statistics(text):
    text = text or ""
    w = words(text)
    n = len(w)
    seen = Counter(tuple(w[i:i + 3]) for i in range(n - 2))
    covered = set()
    for i in range(n - 2):
        if seen[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(words(line)) and line in lines
        lines.add(line)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)
