"""Questions from groups of documents to a table dealt by key, and the answers.

Documents are dealt into chunks of bounded size.  A chunk asks for its distinct
keys once, however often they occur in it, so a key that a third of all
documents hold costs one entry per chunk.  Entries are cut into buckets by the
top bits of the key and shuffled as packed arrays; answers keep the order of the
entries, so they need no keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 8_000_000
LEAST_CHUNKS = 96


def chunk_count(size: int) -> int:
    return max(LEAST_CHUNKS, -(-size // CHUNK_BYTES))


def with_chunk(docs: DataFrame, n: int) -> DataFrame:
    """Adds the chunk of a document, the same in every pass over the same rows."""
    return docs.withColumn("chunk", chunk_of(n))


def chunk_of(n: int, key: str = "doc_id", text: str = "text"):
    return F.pmod(F.xxhash64(key, text), F.lit(n)).cast("int")


def slices(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty buckets of ascending keys and where each begins and ends."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    edges = np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) << shift)
    ends = np.append(edges[1:], len(keys))
    full = np.flatnonzero(ends > edges)
    return full, edges[full], ends[full]


def key_bytes(buckets: int, bits: int) -> tuple[int, np.uint64]:
    """Bytes kept of a key, and the shift that brings them to the low end."""
    width = -(-bits // 8)
    top = buckets.bit_length() - 1
    return width, np.uint64(max(0, 64 - top - 8 * width))


def pack_rows(chunk: int, keys: np.ndarray, buckets: int, columns: dict) -> pa.Table:
    """One row per bucket; ``columns`` maps a name to f(slice) -> bytes."""
    full, lo, hi = slices(keys, buckets)
    data = {"bucket": pa.array(full, pa.int32()), "chunk": pa.array(np.full(len(full), chunk), pa.int32())}
    for name, cut in columns.items():
        data[name] = pa.array([cut(slice(a, b)) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
    return pa.table(data)


def answer_rows(bucket: int, chunks: list[int], answers: list[bytes]) -> pa.Table:
    return pa.table({"bucket": pa.array(np.full(len(chunks), bucket), pa.int32()),
                     "chunk": pa.array(chunks, pa.int32()), "answer": pa.array(answers, pa.binary())})


ANSWER = "bucket int, chunk int, answer binary"


def in_order(answers: pa.Table) -> list[bytes]:
    """Answers of one chunk by ascending bucket, which is the order of its keys."""
    order = np.argsort(answers["bucket"].to_numpy(), kind="stable")
    found = answers["answer"].to_pylist()
    return [found[i] for i in order]


def starts(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
