"""Quality rules: document statistics judged by gradient-boosted trees.

Statistics of every document come from one pass over its whole text.  The trees
are fitted on the driver with a bounded sample of labelled documents (logistic
loss, histogram splits) and may be told that the verdict must not rise with a
feature: a split on it is only taken if the side with smaller values scores at
least as high, and the midpoint bounds both sides further down.  All trees are
flattened into node arrays and every batch of documents walks them at once.

Defined results: null and empty texts have no words, all statistics 0, and fail
the base rule.  Without usable labels the base rule alone decides.  Repeated rows
are judged alike, a null ``doc_id`` is carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siemspark.llm.common import id_text, rolling, word_hashes
from siemspark.llm.labels import SAMPLE_ROWS, labelled

# Symbols counted, and white space between words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
FEATURES = ("n_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_word_share",
            "distinct_word_share", "lines_per_word")
FALLING = ("symbols_per_word", "dup_line_share", "repeat_word_share")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of ``COUNTS`` and the features of ``FEATURES`` of one text."""
    text = text or ""
    parts = text.encode("utf-8", "surrogatepass").split()
    n = len(parts)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    seen, dup = set(), 0
    for line in lines:
        if line in seen:
            dup += bool(line.strip(SPACES))
        else:
            seen.add(line)
    h = word_hashes(parts)
    repeat = 0
    if n >= 3:
        keys = rolling(h, 3)
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        if twice.any():
            covered = np.zeros(n, bool)
            for i in range(3):
                covered[i:i + len(twice)] |= twice
            repeat = int(covered.sum())
    d = max(n, 1)
    return ([n, chars, symbols, dup, repeat],
            [n, chars / d, symbols / d, dup / len(lines), repeat / d, len(np.unique(h)) / d, len(lines) / d])


@dataclass
class Trees:
    """Node arrays of all trees; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total


@dataclass
class _Builder:
    x: np.ndarray  # binned
    edges: list[np.ndarray]
    falling: np.ndarray
    depth: int
    rate: float
    least: float = 1.0
    nodes: list[list[float]] = field(default_factory=list)

    def grow(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, lo: float, hi: float) -> int:
        at = len(self.nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = float(np.clip(-gs / (hs + 1.0), lo, hi))
        self.nodes.append([0, np.inf, at, at, self.rate * leaf])
        if depth == self.depth or len(rows) < 20:
            return at
        best = (1e-6, -1, 0, 0.0)
        for f, edges in enumerate(self.edges):
            if not len(edges):
                continue
            gb = np.cumsum(np.bincount(self.x[rows, f], g[rows], len(edges) + 1))[:-1]
            hb = np.cumsum(np.bincount(self.x[rows, f], h[rows], len(edges) + 1))[:-1]
            left, right = -gb / (hb + 1.0), -(gs - gb) / (hs - hb + 1.0)
            gain = gb ** 2 / (hb + 1.0) + (gs - gb) ** 2 / (hs - hb + 1.0) - gs ** 2 / (hs + 1.0)
            gain[(hb < self.least) | (hs - hb < self.least)] = 0
            if self.falling[f]:
                gain[np.clip(left, lo, hi) < np.clip(right, lo, hi)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], f, i, float(np.clip(left[i], lo, hi) + np.clip(right[i], lo, hi)) / 2)
        _, f, i, middle = best
        if f < 0:
            return at
        go = self.x[rows, f] <= i
        bounds = ((middle, hi), (lo, middle)) if self.falling[f] else ((lo, hi), (lo, hi))
        a = self.grow(rows[go], g, h, depth + 1, *bounds[0])
        b = self.grow(rows[~go], g, h, depth + 1, *bounds[1])
        self.nodes[at][:4] = [f, self.edges[f][i], a, b]
        return at


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64,
        falling: tuple[str, ...] = FALLING, names: tuple[str, ...] = FEATURES) -> Trees | None:
    """Boosted trees for 0/1 targets; None if only one class is there."""
    if not len(y) or y.min() == y.max():
        return None
    edges = [np.unique(np.quantile(c, np.arange(1, bins) / bins, method="lower")) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    score, roots = np.full(len(y), base), []
    grower = _Builder(binned, edges, np.array([n in falling for n in names]), depth, rate)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grower.grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        one = _arrays(grower.nodes, roots[-1:], depth, 0.0)
        score += one.score(x)
    return _arrays(grower.nodes, roots, depth, base)


def _arrays(nodes: list[list[float]], roots: list[int], depth: int, base: float) -> Trees:
    f, t, a, b, v = (np.array(c) for c in zip(*nodes, strict=True))
    return Trees(f.astype(int), t.astype(float), a.astype(int), b.astype(int), v.astype(float),
                 np.array(roots), depth, base)


def _sample(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        x = [statistics(t)[1] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(2)], names=["x", "y"])


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Trees | None:
    """Trees that tell good from bad documents, from at most ``limit`` labelled ones."""
    rows = labelled(docs, labels, limit).select("doc_id", "text", "quality").mapInArrow(
        _sample, "x array<double>, y int").collect()
    # In an order of their own, so that sums do not depend on the order of arrival.
    rows.sort(key=lambda r: (r["x"], r["y"]))
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows], float))


def _judge(texts: list[str | None], trees: Trees | None, threshold: float):
    """Counts, base failures, scores and verdicts."""
    both = [statistics(t) for t in texts]
    counts = np.array([c for c, _ in both], np.int64).reshape(-1, len(COUNTS))
    x = np.array([f for _, f in both], float).reshape(-1, len(FEATURES))
    failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
    p = 1 / (1 + np.exp(-trees.score(x))) if trees else np.ones(len(x))
    return counts, failed, p, ~failed & (p >= threshold)


def judge(docs: DataFrame, trees: Trees | None, threshold: float = 0.5) -> DataFrame:
    """Statistics, base_failed, score and kept of every document."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            counts, failed, p, kept = _judge(batch.column(1).to_pylist(), trees, threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(p), pa.array(kept)],
                names=["doc_id", *COUNTS, "base_failed", "score", "kept"])

    return id_text(docs).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean")


def keep(docs: DataFrame, trees: Trees | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch.filter(pa.array(_judge(batch.column(at).to_pylist(), trees, threshold)[3]))

    return docs.mapInArrow(run, docs.schema)
