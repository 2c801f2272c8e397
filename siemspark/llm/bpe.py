"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is
itself an entry gets its id with one probe.  Tier two merges the bytes of all
other pre-tokens with a heap over a linked list of parts; the ids of pairs come
from the same hash.  Pieces of text between white space repeat often, so each
worker keeps the ids of recent pieces in a bounded memo.

Null texts count as empty; empty texts have no ids.  Ids of a row keep their
order, rows are independent, so ties and repeated rows need no rule.  A null
``doc_id`` is carried along.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import random
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siemspark.llm.common import TwoGenerationCache, id_text, worker_store


def read_ranks(path: str) -> list[bytes]:
    """Entries of a rank file by id; ids must run from 0 without gaps."""
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    out = [b""] * len(pairs)
    for entry, rank in pairs:
        out[int(rank)] = base64.b64decode(entry)
    return out


class PerfectHash:
    """A minimal perfect hash by displacement: n keys, n slots, one probe.

    Keys are dealt to about n/3 groups.  Groups of several keys, largest first,
    take the first of a row of drawn displacements (a, b) that sends all members to free slots;
    groups of one key take the free slots that remain.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.groups = max(1, (n + 2) // 3)
        self.keys: list[bytes | None] = [None] * n
        self.ids = np.full(n, -1, np.int32)
        self.shift = np.zeros((self.groups, 2), np.int64)
        members: list[list[tuple[int, int, int]]] = [[] for _ in range(self.groups)]
        for i, key in enumerate(keys):
            g, f, s = self._parts(key)
            members[g].append((f, s, i))
        free = np.ones(n, bool)
        order = sorted(range(self.groups), key=lambda g: -len(members[g]))
        spare: Iterator[int] | None = None
        draw = random.Random(n)  # the same displacements in every run
        for g in order:
            if not members[g]:
                break
            if len(members[g]) == 1:
                if spare is None:
                    spare = iter(np.flatnonzero(free).tolist())
                f, _, i = members[g][0]
                slot = next(spare)
                self.shift[g] = 0, (slot - f) % n
                self.keys[slot], self.ids[slot] = keys[i], i
                continue
            for _ in range(10_000_000):
                a, b = draw.randrange(n), draw.randrange(n)
                slots = [(f + a * s + b) % n for f, s, _ in members[g]]
                if len(set(slots)) == len(slots) and all(free[x] for x in slots):
                    break
            else:
                raise ValueError("keys repeat")
            self.shift[g] = a, b
            for slot, (_, _, i) in zip(slots, members[g], strict=True):
                free[slot] = False
                self.keys[slot], self.ids[slot] = keys[i], i
        self.ids = self.ids.tolist()
        self.shift = [tuple(x) for x in self.shift.tolist()]

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        import xxhash

        h = xxhash.xxh3_64_intdigest(key)
        return h % self.groups, (h >> 16) % self.n, (h >> 37) % self.n

    def get(self, key: bytes) -> int:
        """The id of a key, or -1."""
        g, f, s = self._parts(key)
        a, b = self.shift[g]
        slot = (f + a * s + b) % self.n
        return self.ids[slot] if self.keys[slot] == key else -1


class Codec:
    """Encodes and decodes single texts with one vocabulary and pattern."""

    def __init__(self, entries: list[bytes], index: PerfectHash, pattern: str, memo: int = 400_000):
        import regex

        self.entries, self.index = entries, index
        self.pattern = regex.compile(pattern)
        # Splits of the pattern never cross from white space into the next piece.
        self.pieces = regex.compile(r" ?\S+|\s+(?!\S)|\s+")
        self.bytes = [index.get(bytes([b])) for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.memo = TwoGenerationCache(self._piece, memo)

    def _piece(self, piece: str) -> bytes:
        ids: list[int] = []
        for part in self.pattern.findall(piece):
            raw = part.encode("utf-8", "surrogatepass")
            at = self.index.get(raw)
            ids.extend((at,) if at >= 0 else self.merge(raw))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pair(self, left: int, right: int) -> int:
        key = left << 32 | right
        at = self.pairs.get(key)
        if at is None:
            if len(self.pairs) >= 400_000:
                self.pairs.clear()
            at = self.pairs[key] = self.index.get(self.entries[left] + self.entries[right])
        return at

    def merge(self, raw: bytes) -> list[int]:
        """Ids of a pre-token that is no entry: lowest rank first, leftmost among equals."""
        ids = [self.bytes[b] for b in raw]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known, pair, heap = self.pairs.get, self._pair, []
        for i in range(n - 1):
            at = known(ids[i] << 32 | ids[i + 1])
            if at is None:
                at = pair(ids[i], ids[i + 1])
            if at >= 0:
                heap.append((at, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            at, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two parts is gone by now
            ids[i], ids[j] = at, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = known(at << 32 | ids[k])
                if new is None:
                    new = pair(at, ids[k])
                if new >= 0:
                    heapq.heappush(heap, (new, i, at, ids[k]))
            h = before[i]
            if h >= 0:
                new = known(ids[h] << 32 | at)
                if new is None:
                    new = pair(ids[h], at)
                if new >= 0:
                    heapq.heappush(heap, (new, h, ids[h], at))
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> np.ndarray:
        memo = self.memo
        return np.frombuffer(b"".join([memo[p] for p in self.pieces.findall(text or "")]), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids.tolist()))


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids", T.ArrayType(T.IntegerType()))])
DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
ROWS = 512


def _codec(shared, pattern: str, path: str) -> Codec:
    store = worker_store("bpe")
    key = (path, pattern)
    if key not in store:
        entries, state = shared.value
        index = PerfectHash.__new__(PerfectHash)
        index.__dict__.update(state)
        store[key] = Codec(entries, index, pattern)
    return store[key]


@functools.lru_cache(maxsize=4)
def _vocabulary(path: str) -> tuple[list[bytes], PerfectHash]:
    entries = read_ranks(path)
    return entries, PerfectHash(entries)


def _shared(docs: DataFrame, path: str):
    """The vocabulary and its hash, as plain data; as large as the vocabulary file, whatever the corpus."""
    entries, index = _vocabulary(path)
    return docs.sparkSession.sparkContext.broadcast((entries, vars(index)))


def _rows(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column(0), part.column(1).to_pylist()


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document."""
    shared = _shared(docs, path)

    def run(batches):
        codec = _codec(shared, pattern, path)
        for keys, texts in _rows(batches):
            ids = [codec.encode(t) for t in texts]
            lengths = [len(x) for x in ids]
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                names=ENCODED.names)

    return id_text(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) from (doc_id, ids); null ids give no bytes."""
    shared = _shared(encoded, path)

    def run(batches):
        codec = _codec(shared, pattern, path)
        for batch in batches:
            out = [codec.decode(np.asarray(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes decoded from them.

    Encoding and decoding run in one pass, so ids never leave the task.
    """
    shared = _shared(docs, path)

    def run(batches):
        codec = _codec(shared, pattern, path)
        for keys, texts in _rows(batches):
            count, sha, back = [], [], []
            for t in texts:
                ids = codec.encode(t)
                count.append(len(ids))
                sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([keys, pa.array(count, pa.int64()), pa.array(sha), pa.array(back)],
                                             names=DIGESTS.names)

    return id_text(docs).mapInArrow(run, DIGESTS)
