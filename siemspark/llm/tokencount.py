"""Token counts of a unigram vocabulary by dynamic programming over a trie.

A text's pre-tokens are cut into the vocabulary pieces of largest total score.  The
best score of a prefix depends on the prefix alone, so distinct pre-tokens are inserted
in a trie and every node holds the forward score and piece count of its prefix, computed
once for all pre-tokens that share it; terminals keep the counts.  Tries and terminals
live in the Python worker, are bounded, and start anew when full.  A pre-token of more than
``LONG`` bytes gets no nodes: the same recurrence runs over a ring of the last scores.

Scores are fixed by the vocabulary: piece of rank r has -log(r + 1), as ranks follow
frequency; no tokenizer is trained.  All single bytes are pieces, so every text has a
count.  Equal scores take fewer pieces.

Defined results: null and empty texts have no tokens and score 0.  Repeated rows are
counted alike, a null ``doc_id`` is carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siemspark.llm.bpe import read_ranks
from siemspark.llm.common import id_text, worker_store

NODES = 500_000
LONG = 2_000  # bytes of a pre-token above which no nodes are made
ROWS = 512
COUNTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_pretokens", T.LongType()),
                       T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])


class Trie:
    """Forward scores by prefix."""

    def __init__(self, entries: list[bytes]):
        self.scores = {e: -math.log(r + 1) for r, e in enumerate(entries)}
        self.longest = max(map(len, entries), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.pieces = [0.0], [0]

    def insert(self, token: bytes) -> tuple[int, float]:
        """Piece count and score of a pre-token."""
        if len(token) > LONG:
            return self.ring(token)
        if len(self.best) > NODES:
            self.clear()
        path, node, child = [0], 0, self.child
        best, pieces, scores = self.best, self.pieces, self.scores
        for end in range(1, len(token) + 1):
            key = node << 8 | token[end - 1]
            node = child.get(key)
            if node is None:
                top, least = -math.inf, 0
                for start in range(max(0, end - self.longest), end):
                    gain = scores.get(token[start:end])
                    if gain is not None:
                        before = path[start]
                        total, n = best[before] + gain, pieces[before] + 1
                        if total > top or total == top and n < least:
                            top, least = total, n
                node = child[key] = len(best)
                best.append(top)
                pieces.append(least)
            path.append(node)
        return pieces[node], best[node]

    def ring(self, token: bytes) -> tuple[int, float]:
        """The same for a long pre-token, whose prefixes nobody shares: only the last scores are kept, no nodes."""
        size = self.longest + 1
        best, pieces, scores = [0.0] * size, [0] * size, self.scores
        for end in range(1, len(token) + 1):
            top, least = -math.inf, 0
            for start in range(max(0, end - self.longest), end):
                gain = scores.get(token[start:end])
                if gain is not None:
                    total, n = best[start % size] + gain, pieces[start % size] + 1
                    if total > top or total == top and n < least:
                        top, least = total, n
            best[end % size], pieces[end % size] = top, least
        return pieces[len(token) % size], best[len(token) % size]


class Counter:
    """Terminals of the trie by pre-token."""

    def __init__(self, entries: list[bytes], pattern: str):
        import regex

        self.trie, self.find = Trie(entries), regex.compile(pattern).findall
        self.pieces: dict[str, int] = {}
        self.scores: dict[str, float] = {}

    def __call__(self, text: str | None) -> tuple[int, int, float]:
        parts = self.find(text) if text else []
        pieces, scores = self.pieces, self.scores
        if len(pieces) > NODES:
            pieces.clear()
            scores.clear()
        long = []
        for part in set(parts):
            if part not in pieces:
                pieces[part], scores[part] = self.trie.insert(part.encode("utf-8", "surrogatepass"))
                if len(part) > LONG:
                    long.append(part)
        out = len(parts), sum(map(pieces.__getitem__, parts)), math.fsum(map(scores.__getitem__, parts))
        for part in long:
            # Terminals hold short pre-tokens only.
            del pieces[part], scores[part]
        return out


def token_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, score) of every whole text."""
    # As large as the vocabulary file, whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]):
        store = worker_store("token counts")
        if path not in store:
            store[path] = Counter(shared.value, pattern)
        count = store[path]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [count(t) for t in part.column(1).to_pylist()]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                     pa.array(columns[2], pa.float64())], names=COUNTS.names)

    return id_text(docs).mapInArrow(run, COUNTS)
