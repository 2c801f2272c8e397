"""What the operators of this subpackage share: tokens, hashes, staged tables."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siemspark.session import ensure_settings, shared_dir

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table.  Queries hand texts to Python in batches of a few megabytes, unless the session says otherwise."""
    ensure_settings(spark)
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Shuffle files of the jobs inside go when each job has ended."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), group_bytes: int = 0) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    The copy outlives lost executors, and nothing behind it is computed twice.  ``group_bytes``, for rows of megabytes,
    bounds row groups; else a writer holds at least a hundred rows and a reader thousands.
    """
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{name}")
    options = {"compression": "zstd"}
    if group_bytes:
        options |= {"parquet.block.size": str(group_bytes), "parquet.page.size.row.check.min": "1",
                    "parquet.page.size.row.check.max": "1"}
    with shuffle_cleanup(spark):
        df.write.partitionBy(*partition_by).options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts: sizes the exchanges, never the result."""
    return docs.agg(F.sum(F.octet_length(F.col(column).cast("string"))).alias("n")).first()["n"] or 0


def bucket_count(items: int, per_bucket: int = 4_000_000, least: int = 1024) -> int:
    """A power of two of exchange buckets with about ``per_bucket`` items each at most."""
    n = least
    while n * per_bucket < items:
        n *= 2
    return n


def worker_store(name: str) -> dict:
    """A dict that lives in the Python worker, shared by its tasks, until another name is asked for."""
    holder = sys.modules.setdefault("_siemspark_worker", types.ModuleType("_siemspark_worker"))
    for other in [k for k, v in holder.__dict__.items() if isinstance(v, dict) and k not in (name, "__builtins__")]:
        del holder.__dict__[other]
    return holder.__dict__.setdefault(name, {})


class TwoGenerationCache:
    """A bounded memo: the younger half is kept when the limit is reached.  Keys longer than ``longest`` are not kept."""

    def __init__(self, make, limit: int, longest: int = 4_000):
        self.make, self.limit, self.longest, self.new, self.old = make, limit, longest, {}, {}

    def __getitem__(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.make(key)
                if len(key) > self.longest:
                    return value
            if len(self.new) >= self.limit:
                self.old, self.new = self.new, {}
            self.new[key] = value
        return value


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(parts: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    store = worker_store("words")
    memo = store.get("memo")
    if memo is None:
        memo = store["memo"] = _WordHashes()
    return np.fromiter(map(memo.__getitem__, parts), np.uint64, len(parts))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64 finaliser)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out *= np.uint64(base)
            out += h[i:i + n]
    return mix64(out)


def chunks(batches: Iterator[pa.RecordBatch], limit: int, size) -> Iterator[tuple[list, list]]:
    """Rows of (id, text) batches, gathered until ``size`` of their texts adds up to ``limit``."""
    ids, texts, total = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(key)
            texts.append(text)
            total += size(text)
            if total >= limit:
                yield ids, texts
                ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def id_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that no other name can clash."""
    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))


def fixed_bytes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned 64-bit integers, one plane per byte."""
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(planes.T).tobytes()


def from_fixed_bytes(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8").astype(np.uint64)
