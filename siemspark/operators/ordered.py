"""Order inside groups without making a group one task.

Rows are dealt by ranges of (keys, order), so a key with a third of all rows is cut into as many chunks as its
share asks for, even if all of its rows have one time.  Work inside a chunk is an ordinary window.  What a
chunk needs from its neighbours is carried by a scan over summaries, one row per key and chunk; a key has at
most as many of them as the exchange has partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siemspark.functions.scalars import floor_div
from siemspark.session import cut_lineage

CHUNK = "_chunk"
CHUNK_ROWS = 1_000_000


def in_chunks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], purpose: str) -> DataFrame:
    """The rows with the number of their chunk, which grows along ``order`` within a key."""
    return dealt_in_chunks(rows, keys, order, purpose)[0]


def dealt_in_chunks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], purpose: str) -> tuple[DataFrame, int]:
    """``in_chunks`` and the number of chunks: as many as the rows ask for, ``CHUNK_ROWS`` each.

    The rows are written before they are dealt, as ranges are found by sampling them, and again with their chunk, as
    every reader must see the same ranges.
    """
    staged = cut_lineage(rows, purpose)
    chunks = max(1, -(-staged.count() // CHUNK_ROWS))
    if chunks == 1:
        return staged.withColumn(CHUNK, F.lit(0)), 1
    dealt = staged.repartitionByRange(chunks, *keys, *order).withColumn(CHUNK, F.spark_partition_id())
    return cut_lineage(dealt, purpose), chunks


def backwards(keys: Sequence[str], order: Sequence[str]):
    """The later rows of the same chunk, nearest last."""
    return (Window.partitionBy(*keys, CHUNK).orderBy(*[F.desc(c) for c in order])
            .rowsBetween(Window.unboundedPreceding, -1))


def later_chunks(keys: Sequence[str]):
    """Summaries of later chunks of the same key, nearest last."""
    return (Window.partitionBy(*keys).orderBy(F.desc(CHUNK))
            .rowsBetween(Window.unboundedPreceding, -1))


def with_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the carried columns of their chunk."""
    on = [*keys, CHUNK]
    named = carry.select(*[F.col(c).alias(f"_c_{c}") for c in on], *[c for c in carry.columns if c not in on])
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(named[f"_c_{c}"]) for c in on])
    return rows.join(named, same, "left").drop(*[f"_c_{c}" for c in on])


def first_ranks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], limit: Column, purpose: str) -> DataFrame:
    """The first rows of every key with ``_rank`` from 1, and ``_limit``: the value of ``limit`` in the key's first row,
    which says how many they are.

    Counts of chunks give the rank at which each begins; chunks that begin beyond the limit are not sorted at all.
    """
    chunked, chunks = dealt_in_chunks(rows, keys, order, purpose)
    if chunks == 1:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return (chunked.withColumn("_rank", F.count(F.lit(1)).over(whole)).withColumn("_limit", F.first(limit).over(whole))
                .where("_rank <= _limit").drop(CHUNK))
    sizes = chunked.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_size"),
                                              F.min_by(limit, F.struct(*order)).alias("_own"))
    along = Window.partitionBy(*keys).orderBy(CHUNK)
    begins = F.coalesce(F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = sizes.select(*keys, CHUNK, begins.alias("_begins"), F.first("_own").over(
        along.rowsBetween(Window.unboundedPreceding, 0)).alias("_limit")).where("_begins < _limit")
    inside = F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*order))
    return (with_carry(chunked, carry, keys).where(F.col("_limit").isNotNull())
            .withColumn("_rank", (F.col("_begins") + inside).cast("long")).where("_rank <= _limit").drop("_begins", CHUNK))


def running_max(values: DataFrame, keys: Sequence[str], at: str, value: str, fan: int = 1_000) -> DataFrame:
    """(keys, at, before): the highest ``value`` at smaller ``at`` of the key; ``values`` has a row per key and ``at``.

    A scan of scans: ``fan`` neighbours are scanned together, then their maxima, so a key with ten million
    rows is ten thousand tasks' worth of windows and one of ten thousand rows.
    """
    def earlier(*by):
        return Window.partitionBy(*keys, *by).rowsBetween(Window.unboundedPreceding, -1)

    grouped = values.withColumn("_up", floor_div(at, fan))
    tops = (grouped.groupBy(*keys, "_up").agg(F.max(value).alias("_top"))
            .withColumn("_before_up", F.max("_top").over(earlier().orderBy("_up"))).drop("_top"))
    inside = F.max(value).over(earlier("_up").orderBy(at))
    named = tops.select(*[F.col(c).alias(f"_c_{c}") for c in [*keys, "_up"]], "_before_up")
    scanned = grouped.withColumn("_inside", inside)
    same: Column = reduce(lambda a, b: a & b, [scanned[c].eqNullSafe(named[f"_c_{c}"]) for c in [*keys, "_up"]])
    return scanned.join(named, same).select(*keys, at, F.greatest("_before_up", "_inside").alias("before"))
