"""Importance resampling: documents drawn by how much likelier the target makes them.

Texts are bags of hashed words and word pairs.  Three generative models come from
labelled documents: the target (good, not toxic), low quality, and toxic.  Raw text
is their mixture in the labelled shares.  A bucket's probability in one of the other
groups is the target's times a ratio.  Buckets whose counts do not differ clearly
share one ratio, the one that makes probabilities sum to 1, so chance and mere
differences of language do not add up over a long text.  A group is judged by the whole
text or by its most telling passage of ``PASSAGE`` words, whichever says more, so that
length clears no document.  The log weight is the log ratio of the document's
probability in the target model to that in raw text.

As many documents are drawn as may well be target documents (``LEAST_TARGET``), and Gumbel
top-k draws them without replacement: the largest sums of log weight and scaled Gumbel
noise stay.  Noise comes from the document's id, so a repeated task draws the same.
Only the labelled sample is bounded: weights, their number and the k-th largest key
cover all documents.

Defined results: null and empty texts have log weight 0 and take part like others.
Rows that tie with the last one drawn stay too, so repeated rows share their fate.
A null ``doc_id`` draws the noise of 0.  Without labels of a good document all
weights are 0 and everything stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siemspark.llm.common import chunks, id_text, mix64, stage, word_hashes
from siemspark.llm.labels import SAMPLE_ROWS, labelled

BITS = 20
SHRINK, SHRINK_SHARE = 2.0, 5e-6  # pseudo-count of a bucket: the larger of both, the second of a group's n-grams
MARGIN, SIGMAS = 1.5, 6.0  # least log ratio, and least deviation, of a bucket with a ratio of its own
PASSAGE = 100  # words
LEAST_TARGET = 0.3  # probability of being a target document from which one counts towards the number drawn
CHUNK = 2_000_000
GROUPS = ("target", "low", "toxic")
_SYMBOLS = b"#*$%&|<>"
# Letters in lower case, sentence marks as white space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b".,;:!?\"()" else c for c in range(256))
_SAME = np.uint64(0x51)


def ngrams(text: str | None, bits: int = BITS) -> np.ndarray:
    """Buckets of the words and word pairs of a text; all pairs of equal words share one."""
    if not text:
        return np.empty(0, np.int64)
    raw = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    for c in _SYMBOLS:
        mark = bytes([c])
        if mark in raw:
            raw = raw.replace(mark, b" " + mark + b" ")
    h = word_hashes(raw.split())
    with np.errstate(over="ignore"):
        pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    pair[h[:-1] == h[1:]] = _SAME
    return (mix64(np.concatenate([h, pair])) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Weights:
    """Log ratios of the other groups to the target by bucket, and the groups' log shares."""

    ratio: np.ndarray
    share: np.ndarray

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log weight and probability of being a target document, per text."""
        if not np.isfinite(self.share[0]):
            return np.zeros(len(texts)), np.ones(len(texts))
        total = np.zeros((len(GROUPS), len(texts)))
        for i, text in enumerate(texts):
            bag = ngrams(text)
            n = (len(bag) + 1) // 2  # words; pairs follow
            for c in range(1, len(GROUPS) if n else 1):
                found = self.ratio[c - 1][bag].astype(float)
                found[1:n] += found[n:]
                total[c, i] = _telling(found[:n])
        weight = -np.logaddexp.reduce(total + self.share[:, None], axis=0)
        return weight, np.exp(weight + self.share[0])


def _telling(ratios: np.ndarray) -> float:
    """The sum over all words, or over the passage that has the largest."""
    if len(ratios) <= PASSAGE:
        return ratios.sum()
    total = np.concatenate([[0.0], np.cumsum(ratios)])
    return max(total[-1], (total[PASSAGE:] - total[:-PASSAGE]).max())


def _tally(batches: Iterator[pa.RecordBatch]):
    counts = np.zeros((len(GROUPS), 1 << BITS), np.int64)
    for batch in batches:
        for text, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            np.add.at(counts[g], ngrams(text), 1)
    bucket = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *(pa.array(c[bucket]) for c in counts)],
                                     names=["bucket", "n0", "n1", "n2"])


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Weights:
    """The models, from at most ``limit`` labelled documents."""
    group = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 0).when(F.col("quality") == 0, 1).otherwise(2)
    known = labelled(docs, labels, limit).select("doc_id", "text", group.alias("grp"))
    counts = stage(known.mapInArrow(_tally, "bucket int, n0 long, n1 long, n2 long")
                   .groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "n2"))), "ngrams")
    total = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1", "n2"))).first()
    size = np.zeros(len(GROUPS))
    for r in labelled(docs.select("doc_id", F.lit("").alias("text")), labels, limit).groupBy(group).count().collect():
        size[r[0]] = r[1]
    ratio = np.zeros((len(GROUPS) - 1, 1 << BITS), np.float32)
    if not size[0] or not total["n0"]:
        return Weights(ratio, np.full(len(GROUPS), -np.inf))
    for c in (1, 2):
        if not total[f"n{c}"]:
            continue
        expected = F.col("n0") * (total[f"n{c}"] / total["n0"])
        shrink = max(SHRINK, SHRINK_SHARE * total[f"n{c}"])
        lift = F.log((F.col(f"n{c}") + shrink) / (expected + shrink))
        clear = F.abs(F.col(f"n{c}") - expected) >= SIGMAS * F.sqrt(expected + 1)
        # Only buckets that differ clearly, of which a bounded sample has few.
        found = (counts.select("bucket", "n0", F.col(f"n{c}").alias("n"), lift.alias("r"), clear.alias("clear"))
                 .where((F.abs("r") >= MARGIN) & F.col("clear")).toArrow())
        rest = [1 - found[n].to_numpy().sum() / all_ for n, all_ in (("n", total[f"n{c}"]), ("n0", total["n0"]))]
        ratio[c - 1] = np.log(max(rest[0], 1e-9) / max(rest[1], 1e-9))
        ratio[c - 1, found["bucket"].to_numpy()] = found["r"].to_numpy()
    with np.errstate(divide="ignore"):
        return Weights(ratio, np.log(size / size.sum()))


def _keys(ids: list[int | None], weight: np.ndarray, temperature: float, seed: int) -> np.ndarray:
    """Integers in the order of log weight plus Gumbel noise."""
    h = mix64(np.array([i or 0 for i in ids], np.int64).view(np.uint64) + mix64(np.uint64(seed)))
    u = ((h >> np.uint64(12)).astype(float) + 0.5) / 2.0 ** 52
    bits = (weight - temperature * np.log(-np.log(u))).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The exact k-th largest of the column ``key``, by counts of 16 binary digits at a time."""
    if k <= 0:
        return None
    prefix = None
    for shift in (48, 32, 16, 0):
        part = keys if prefix is None else keys.where(F.shiftright("key", shift + 16) == prefix)
        found = part.groupBy(F.shiftright("key", shift).alias("p")).count().toArrow()  # 65,536 rows at most
        p, n = found["p"].to_numpy(), found["count"].to_numpy()
        order = np.argsort(-p)
        total = np.cumsum(n[order])
        at = int(np.searchsorted(total, k))
        if at == len(total):
            return int(p.min()) if shift == 0 else -(1 << 63)  # fewer than k rows: all of them
        k -= int(total[at] - n[order[at]])
        prefix = int(p[order[at]])
    return prefix


def _score(batches, model: Weights, temperature: float, seed: int):
    for ids, texts in chunks(batches, CHUNK, lambda t: len(t or "")):
        weight, target = model(texts)
        yield ids, weight, target, _keys(ids, weight, temperature, seed)


def resample(docs: DataFrame, model: Weights, temperature: float = 0.1, seed: int = 1) -> tuple[DataFrame, int | None]:
    """(doc_id, log_weight, target, key) of every document, and the smallest key that is drawn."""

    def run(batches: Iterator[pa.RecordBatch]):
        for ids, weight, target, key in _score(batches, model, temperature, seed):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(weight), pa.array(target), pa.array(key)],
                                             names=["doc_id", "log_weight", "target", "key"])

    scored = stage(id_text(docs).mapInArrow(run, "doc_id long, log_weight double, target double, key long"), "weights")
    return scored, kth_largest(scored, scored.where(F.col("target") >= LEAST_TARGET).count())


def classify(docs: DataFrame, labels: DataFrame, temperature: float = 0.1, seed: int = 1,
             limit: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, log_weight, target, key, kept) of every document."""
    scored, least = resample(docs, train(docs, labels, limit), temperature, seed)
    return scored.withColumn("kept", F.col("key") >= F.lit(least) if least is not None else F.lit(False))


def keep(docs: DataFrame, labels: DataFrame, temperature: float = 0.1, seed: int = 1,
         limit: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns."""
    model = train(docs, labels, limit)
    _, least = resample(docs, model, temperature, seed)
    key, text = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            weight, _ = model(batch.column(text).to_pylist())
            keys = _keys(batch.column(key).to_pylist(), weight, temperature, seed)
            yield batch.filter(pa.array(keys >= least if least is not None else np.zeros(len(keys), bool)))

    return docs.mapInArrow(run, docs.schema)
