"""Removal of word sequences that an earlier document holds, by fixed-block anchors.

A window of ``width`` words always contains one of its document's blocks of
``(width + 1) // 2`` words that start at multiples of that length.  So only these
non-overlapping blocks are indexed, and every rolling window of the block length
probes them.  Hits are extended: all windows of full width around a hit are
looked up with 128-bit fingerprints and the smallest document that has each is
found; overlapping windows with a smaller owner merge into maximal exact repeats.

Three passes over chunks of documents: ask for blocks, ask for windows, remove.
A passage that very many documents share is one entry per chunk in both
exchanges, and no pair of documents is ever formed.

Defined results: null and empty texts have no words.  Rows that repeat a
``doc_id`` never cover each other.  A row with null ``doc_id`` takes no part and
keeps all its words.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from siemspark.llm.common import (bucket_count, fixed_bytes, from_fixed_bytes, id_text, mix64, rolling, stage,
                                  text_bytes, word_hashes, words)
from siemspark.llm.exchange import (ANSWER, answer_rows, chunk_count, chunk_of, in_order, key_bytes, pack_rows, slices,
                                    starts, with_chunk)

KEY_BITS = 40  # of a block below its bucket; a false hit only costs a lookup
SECOND = 0xC2B2AE3D27D4EB4F


class _Chunk:
    """Word hashes of the documents of a chunk, and the keys its windows have."""

    def __init__(self, table: pa.Table, width: int):
        # Rows in a fixed order, so that each pass sees the same chunk.
        self.ids = table["doc_id"].to_pylist()
        self.texts = table["text"].to_pylist()
        self.width, self.block = width, (width + 1) // 2
        self.hashes = [word_hashes(words(t)) for t in self.texts]
        self.parts = [d for d, h in enumerate(self.hashes) if self.ids[d] is not None and len(h) >= width]

    def block_keys(self):
        """Distinct keys of all block-long windows, whether one is an anchor, whether documents share it."""
        keys = [rolling(self.hashes[d], self.block) for d in self.parts]
        self.at = starts([len(k) for k in keys])
        flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        uniq, self.inverse = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(self.parts)), np.diff(self.at))
        place = np.arange(len(flat)) - self.at[owner]
        anchor = np.zeros(len(uniq), bool)
        anchor[self.inverse[place % self.block == 0]] = True
        first = np.zeros(len(uniq), np.int64)
        first[self.inverse[::-1]] = owner[::-1]
        shared = np.zeros(len(uniq), bool)
        shared[self.inverse[owner != first[self.inverse]]] = True
        return uniq, anchor, shared

    def window_keys(self, hit: np.ndarray):
        """Fingerprints of the full windows around hits: (high, low, document, start)."""
        marked = hit[self.inverse]
        high, low, owner, begin = [], [], [], []
        for i, d in enumerate(self.parts):
            here = marked[self.at[i]:self.at[i + 1]]
            if not here.any():
                continue
            total = np.concatenate([[0], np.cumsum(here)])
            n = len(self.hashes[d]) - self.width + 1
            span = self.width - self.block + 1
            s = np.flatnonzero(total[span:span + n] > total[:n])
            high.append(rolling(self.hashes[d], self.width)[s])
            low.append(rolling(mix64(self.hashes[d]), self.width, SECOND)[s])
            owner.append(np.full(len(s), d))
            begin.append(s)
        if not high:
            return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in (high, low, owner, begin))

    def windows(self, hit: np.ndarray):
        """Distinct fingerprints in order, their smallest document here, and where each window goes."""
        high, low, owner, begin = self.window_keys(hit)
        order = np.lexsort((low, high))
        high, low, owner, begin = high[order], low[order], owner[order], begin[order]
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        group = np.cumsum(new) - 1
        ids = np.array([x if x is not None else 0 for x in self.ids], np.int64)[owner] if len(owner) else owner
        least = np.minimum.reduceat(ids, np.flatnonzero(new)) if len(ids) else ids
        return high[new], low[new], least, group, owner, begin


def _sorted(table: pa.Table) -> pa.Table:
    return table.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _ask_blocks(width: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        uniq, anchor, shared = _Chunk(_sorted(table), width).block_keys()
        size, shift = key_bytes(buckets, KEY_BITS)
        return pack_rows(table["chunk"][0].as_py(), uniq, buckets, {
            "keys": lambda s: fixed_bytes(uniq[s] >> shift, size),
            "anchor": lambda s: np.packbits(anchor[s]).tobytes(),
            "shared": lambda s: np.packbits(shared[s]).tobytes()})

    return run


def _answer_blocks(buckets: int):
    """For each entry whether another document has the block and one holds it as an anchor."""

    def run(table: pa.Table) -> pa.Table:
        size, _ = key_bytes(buckets, KEY_BITS)
        keys = [from_fixed_bytes(b, size) for b in table["keys"].to_pylist()]
        at = starts([len(k) for k in keys])

        def bits(name):
            return np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(k))
                                   for b, k in zip(table[name].to_pylist(), keys, strict=True)])

        uniq, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        anchored, common = np.zeros(len(uniq), bool), count > 1
        anchored[inverse[bits("anchor") == 1]] = True
        common[inverse[bits("shared") == 1]] = True
        hit = (anchored & common)[inverse]
        return answer_rows(table["bucket"][0].as_py(), table["chunk"].to_pylist(),
                           [np.packbits(hit[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])

    return run


def _hits(chunk: _Chunk, answers: pa.Table, buckets: int) -> np.ndarray:
    uniq, _, _ = chunk.block_keys()
    _, lo, hi = slices(uniq, buckets)
    found = [np.unpackbits(np.frombuffer(b, np.uint8), count=int(n))
             for b, n in zip(in_order(answers), hi - lo, strict=True)]
    return np.concatenate(found).astype(bool) if found else np.empty(0, bool)


def _ask_windows(width: int, buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(_sorted(table), width)
        high, low, least, *_ = chunk.windows(_hits(chunk, answers, buckets))
        return pack_rows(table["chunk"][0].as_py(), high, buckets, {
            "high": lambda s: fixed_bytes(high[s], 8), "low": lambda s: fixed_bytes(low[s], 8),
            "least": lambda s: fixed_bytes(least[s].view(np.uint64), 8)})

    return run


def _answer_windows(table: pa.Table) -> pa.Table:
    """The smallest document of all chunks, for each fingerprint asked for."""
    high, low, least = ([from_fixed_bytes(b, 8) for b in table[c].to_pylist()] for c in ("high", "low", "least"))
    at = starts([len(h) for h in high])
    high, low, least = np.concatenate(high), np.concatenate(low), np.concatenate(least).view(np.int64)
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    h, lo = high[order], low[order]
    new[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
    best = np.minimum.reduceat(least[order], np.flatnonzero(new))
    out = np.empty(len(order), np.int64)
    out[order] = best[np.cumsum(new) - 1]
    return answer_rows(table["bucket"][0].as_py(), table["chunk"].to_pylist(),
                       [fixed_bytes(out[a:b].view(np.uint64), 8) for a, b in zip(at[:-1], at[1:], strict=True)])


def _kept(table: pa.Table, answers: pa.Table, width: int, buckets: int):
    """Per document of a chunk: words, words removed, stretches removed, and the text that is left."""
    chunk = _Chunk(table, width)
    kind = answers["kind"].to_numpy()
    hit = _hits(chunk, answers.filter(pa.array(kind == 0)), buckets)
    _, _, _, group, owner, begin = chunk.windows(hit)
    gone: dict[int, np.ndarray] = {}
    if len(group):
        best = [from_fixed_bytes(b, 8) for b in in_order(answers.filter(pa.array(kind == 1)))]
        smallest = np.concatenate(best).view(np.int64)[group]
        ids = np.array([x if x is not None else 0 for x in chunk.ids], np.int64)[owner]
        covered = smallest < ids
        owner, begin = owner[covered], begin[covered]
        order = np.lexsort((begin, owner))
        owner, begin = owner[order], begin[order]
        which, first = np.unique(owner, return_index=True)
        gone = dict(zip(which.tolist(), np.split(begin, first[1:]), strict=False))
    for d, text in enumerate(chunk.texts):
        tokens = words(text)
        n = len(tokens)
        if d not in gone:
            yield n, 0, [], b" ".join(tokens)
            continue
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, gone[d], 1)
        np.add.at(step, gone[d] + width, -1)
        stay = np.cumsum(step)[:n] == 0
        edge = np.flatnonzero(np.diff(np.concatenate([[True], stay, [True]])))
        yield n, int(n - stay.sum()), edge.tolist(), b" ".join(compress(tokens, stay.tolist()))


KEPT = "doc_id long, n_words long, n_removed long, repeats array<long>, kept string"


def _remove(width: int, buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _sorted(table)
        total, removed, spans, kept = zip(*_kept(table, answers, width, buckets), strict=True)
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(total, pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()),
                         "repeats": pa.array(spans, pa.list_(pa.int64())),
                         "kept": pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string())})

    return run


def _replace(width: int, buckets: int, names: list[str], columns: list[str], chars: str | None):
    """``names``: the added key and text; ``columns``: what the rows had."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([(n, "ascending") for n in names])
        plain = pa.table({"doc_id": table[names[0]], "text": table[names[1]]})
        texts, kinds = table["text"].to_pylist(), {n: table.schema.field(n).type for n in columns}
        counts = table[chars].to_pylist() if chars else None
        for d, (_, n, _, kept) in enumerate(_kept(plain, answers, width, buckets)):
            if n:
                texts[d] = kept.decode("utf-8", "surrogatepass")
                if chars:
                    counts[d] = len(texts[d])
        new = {"text": pa.array(texts, kinds["text"])}
        if chars:
            new[chars] = pa.array(counts, kinds[chars])
        return pa.table([new.get(n, table[n]) for n in columns], names=columns)

    return run


def _asked(docs: DataFrame, width: int) -> tuple[DataFrame, int, int]:
    """Answers to all questions of the chunks of ``docs``, and the numbers of chunks and buckets."""
    docs = id_text(docs)
    size = text_bytes(docs)
    buckets, n = bucket_count(size // 5), chunk_count(size)
    docs = with_chunk(docs, n)
    asked = docs.groupBy("chunk").applyInArrow(
        _ask_blocks(width, buckets), "bucket int, chunk int, keys binary, anchor binary, shared binary")
    blocks = stage(asked.groupBy("bucket").applyInArrow(_answer_blocks(buckets), ANSWER), "block-answers")
    wide = docs.groupBy("chunk").cogroup(blocks.groupBy("chunk")).applyInArrow(
        _ask_windows(width, buckets), "bucket int, chunk int, high binary, low binary, least binary")
    windows = stage(wide.groupBy("bucket").applyInArrow(_answer_windows, ANSWER), "window-answers")
    return blocks.selectExpr("*", "0 as kind").union(windows.selectExpr("*", "1 as kind")), n, buckets


def remove_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, repeats, kept) of every row of ``docs``.

    ``repeats`` lists the maximal removed stretches as word offsets, start and end
    in turn; ``kept`` holds the other words, joined by one space.
    """
    answers, n, buckets = _asked(docs, width)
    return with_chunk(id_text(docs), n).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _remove(width, buckets), KEPT)


def clean(docs: DataFrame, width: int = 13) -> DataFrame:
    """The rows of ``docs`` with all their columns; texts with repeats keep their other words, others stay as they are.

    ``n_chars`` follows the text where it is a whole number; any other column of that name is left alone.
    Ids and texts may have any type that casts to a long and a string.
    """
    answers, n, buckets = _asked(docs, width)
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in ("key", "string", "chunk"):
        while name in taken:
            name = "_" + name
        taken.add(name)
        names.append(name)
    chars = next((f.name for f in docs.schema if f.name == "n_chars" and isinstance(f.dataType, IntegralType)), None)
    # The same casts as in the passes before, so every row is in the chunk that asked for it.
    mine = docs.withColumns({names[0]: F.col("doc_id").cast("long"), names[1]: F.col("text").cast("string")})
    mine = mine.withColumn(names[2], chunk_of(n, *names[:2]))
    return mine.groupBy(names[2]).cogroup(answers.groupBy("chunk")).applyInArrow(
        _replace(width, buckets, names[:2], docs.columns, chars), docs.schema)
