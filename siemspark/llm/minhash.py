"""MinHash near-duplicate detection by fast similarity sketching.

A document is the set of its distinct shingles: runs of ``width`` lower-cased
words, or the whole sequence where it has fewer words.  Rounds of hashed bin
placement fill the coordinates of a sketch: in round i every shingle falls into
one bin and the smallest value of the earliest round stays, and after ``t``
rounds the bins left are filled one by one, so each coordinate is filled for any
set and equal coordinates estimate the similarity with the concentration of
independent samples.  Bands of coordinates propose candidates, the full sets
decide.

Documents with equal sets form a class first, so copies meet as one row.  In a
bucket each member is compared with the smallest id.  Members that are not in
one component after that are compared across components, in blocks, once per
pair; pairs whose sketches agree far less than the threshold needs (six standard
deviations) are not read again, all others are decided on their full sets.
Nothing is capped.

Defined results: documents without words (null or empty text) have an empty set,
no links, and their own id as component.  Rows that repeat a ``doc_id`` belong to
one node, which has the links of all its texts.  A null ``doc_id`` takes no part: component null, kept true.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siemspark.llm.common import chunks, id_text, mix64, rolling, stage, word_hashes
from siemspark.llm.components import components

COORDINATES = 1024
BANDS = 42
ROWS = 6  # coordinates per band
CHUNK = 2_000_000  # characters worked on at once
BLOCK = 512  # members of a bucket compared in one task with as many others
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    if not text:
        return np.empty(0, np.uint64)
    h = word_hashes(text.encode("utf-8", "surrogatepass").translate(_LOWER).split())
    return np.unique(rolling(h, min(width, len(h)))) if len(h) else h


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """One row of ``t`` coordinates, 8 bits of each, per non-empty set."""
    out = np.full((len(sets), t), _FULL)
    flat = out.reshape(-1)
    values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for turn in range(2 * t):
        if turn % 4 == 1:
            keep = (out == _FULL).any(axis=1)[owner]
            values, owner = values[keep], owner[keep]
        if not len(values):
            break
        h = mix64(values + mix64(np.uint64(turn + 1)))
        place = h & np.uint64(t - 1) if turn < t else np.full(len(h), turn - t, np.uint64)
        np.minimum.at(flat, owner * t + place.astype(np.int64),
                      np.uint64(turn) << np.uint64(32) | h >> np.uint64(32))
    return mix64(out).astype(np.uint8)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; the band number is part of the key."""
    cut = rows[:, :BANDS * ROWS].reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), cut.shape[:2]).copy()
    for i in range(ROWS):
        key = mix64(key ^ cut[:, :, i])
    return key


def _print(found: np.ndarray) -> bytes | None:
    """128 bits of a set; none for the empty one."""
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def _number(print_: bytes | None) -> int | None:
    return int.from_bytes(print_[:8], "little", signed=True) if print_ else None


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for ids, texts in chunks(batches, CHUNK, lambda t: len(t or "")):
            sets = [shingles(t, width) for t in texts]
            full = [s for s in sets if len(s)]
            marks = iter(sketches(full))
            prints = [_print(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(prints, pa.binary()), pa.array(map(_number, prints), pa.int64()),
                 pa.array([next(marks).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "print", "number", "sketch"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, COORDINATES)
        keys = band_keys(rows).astype(np.int64).reshape(-1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["key", "rep"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for ids, texts in chunks(batches, CHUNK, lambda t: len(t or "")):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([shingles(t, width).tobytes() for t in texts], pa.binary())],
                names=["id", "set"])

    return run


def _printed_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for ids, texts in chunks(batches, CHUNK, lambda t: len(t or "")):
            sets = [shingles(t, width) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([_print(s) for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "print", "set"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _across(percent: int):
    """Pairs of one block pair that are not joined yet and may be links."""
    j = percent / 100
    # A little below: equal low bits of different coordinates only add to the count.
    least = COORDINATES * j - 6 * np.sqrt(COORDINATES * j * (1 - j))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rep, comp, size, block = (group[c].to_numpy() for c in ("rep", "component", "n_shingles", "block"))
        marks = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
        keys = band_keys(marks)
        here = int(np.flatnonzero(keys[0].astype(np.int64) == group["key"][0].as_py())[0])
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        found = []
        for i in left:
            # Sizes must allow the similarity, and an earlier band must not have shown the pair.
            js = right[(comp[right] != comp[i]) & ((rep[right] > rep[i]) | (lo != hi))]
            small, large = np.minimum(size[js], size[i]), np.maximum(size[js], size[i])
            js = js[100 * small >= percent * large]
            js = js[~(keys[js, :here] == keys[i, :here]).any(axis=1)]
            js = js[(marks[js] == marks[i]).sum(axis=1) >= least]
            found.append(np.column_stack([np.maximum(rep[js], rep[i]), np.minimum(rep[js], rep[i])]))
        out = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        return pa.table({"a": out[:, 0], "b": out[:, 1]})

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    pairs = stage(pairs, "pairs")
    left, right = (sets.select(F.col("id").alias(k), F.col("set").alias(f"set_{k}")) for k in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return stage(both.mapInArrow(_verify(percent), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Two documents are linked when ``100 * intersection >= percent * union``.
    """
    docs = id_text(docs)
    marks = stage(docs.mapInArrow(_signatures(width), "doc_id long, n_shingles long, print binary, number long, "
                                  "sketch binary"), "sketches")
    named = marks.where(F.col("doc_id").isNotNull() & F.col("print").isNotNull())
    # Ids with several texts: a class is numbered by its smallest id, or by its print if that id has another class.
    repeated = stage(named.groupBy("doc_id").agg(F.min("print").alias("p"), F.max("print").alias("q")).where("p <> q")
                     .select("doc_id", "p"), "repeated")
    classes = named.groupBy("print").agg(F.min("doc_id").alias("least"), F.min("number").alias("number"))
    classes = stage(classes.join(repeated, classes["least"] == repeated["doc_id"], "left").select(
        "print", "least", F.when(F.coalesce("p", "print") == F.col("print"), F.col("least")).otherwise(F.col("number"))
        .alias("rep")), "classes")
    reps = stage(named.join(classes, (named["doc_id"] == classes["least"]) & (named["print"] == classes["print"]))
                 .select("rep", "n_shingles", "sketch"), "reps")
    # Rows that share an id but not a text are one node: their classes are linked as they stand.
    own = (named.join(repeated.select("doc_id"), "doc_id", "left_semi").select("doc_id", "print").distinct()
           .join(classes, "print").select("doc_id", "rep"))
    own = stage(own, "own")
    same = (own.join(own.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").where(F.col("rep") != F.col("b"))
            .select(F.col("rep").alias("a"), "b"))

    bands = stage(reps.select("rep", "sketch").mapInArrow(_bands, "key long, rep long"), "bands")
    heads = stage(bands.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last"))
                  .where(F.col("head") != F.col("last")).select("key", "head"), "heads")
    met = stage(bands.join(heads, "key"), "met")
    sizes = reps.groupBy("rep").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    stars = met.where(F.col("rep") != F.col("head")).select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()
    for key in ("a", "b"):
        stars = stars.join(sizes.select(F.col("rep").alias(key), F.col("least").alias(f"least_{key}"),
                                        F.col("most").alias(f"most_{key}")), key)
    stars = stars.where((100 * F.col("most_a") >= percent * F.col("least_b"))
                        & (100 * F.col("most_b") >= percent * F.col("least_a"))).select("a", "b")
    # The full sets of whatever met another document, read once for both rounds.
    ids = met.select(F.col("rep").alias("doc_id")).distinct().join(repeated, "doc_id", "left_anti")
    texts = docs.join(ids.hint("merge"), "doc_id", "left_semi").select("doc_id", "text")
    # Texts of one id differ in case and white space here; the smallest stands for them.
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    once = texts.mapInArrow(_sets(width), "id long, set binary")
    # A repeated id has a set for each class it stands for.
    several = (docs.join(repeated, "doc_id", "left_semi").select("doc_id", "text").distinct()
               .mapInArrow(_printed_sets(width), "doc_id long, print binary, set binary"))
    several = (several.join(classes, (several["doc_id"] == classes["least"]) & (several["print"] == classes["print"]))
               .select(F.col("rep").alias("id"), "set").dropDuplicates(["id"]))
    sets = stage(once.union(several), "sets")
    links = _links(stars, sets, percent).union(same)
    labels = stage(components(links), "labels")

    placed = met.join(labels, met["rep"] == labels["node"], "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component"))
    split = (placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                       F.count("*").alias("n"))
             .where("lo <> hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    left_over = placed.join(split, "key").join(reps, "rep")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (left_over.withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                     "rep", "component", "n_shingles", "sketch", "block"))
    more = dealt.groupBy("key", "lo", "hi").applyInArrow(_across(percent), "a long, b long").distinct()
    late = _links(more, sets, percent)
    labels = stage(components(links.union(late)), "labels")

    grouped = stage(classes.join(labels, classes["rep"] == labels["node"], "left").select(
        "print", "least", F.coalesce("component", "rep").alias("component")), "grouped")
    # Numbers may be smaller than ids: a component is named by its smallest id.
    names = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named_by = grouped.join(names, "component").select("print", "component_id")
    # Rows without words belong to the node of their id, if that has other texts.
    blank = marks.where(F.col("doc_id").isNotNull() & F.col("print").isNull()).select("doc_id").distinct()
    by_id = stage(named.select("doc_id", "print").join(blank, "doc_id", "left_semi").join(named_by, "print")
                  .groupBy("doc_id").agg(F.min("component_id").alias("of_id")), "blank")
    out = marks.select("doc_id", "n_shingles", "print").join(named_by, "print", "left").join(by_id, "doc_id", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "of_id", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
