"""Mixing of sources to target weights by capped water-filling, in DataFrame functions only.

Sources share ``share`` times all words by weight.  A source whose share lies above ``epochs`` times its words is
clamped there and what it leaves is dealt to the others by weight, round after round until no source is above.  Every round clamps
all sources above the level of that round; only three sums of it reach the driver.

A target of 1.4 epochs takes each document once as a whole; the rest is a fractional repetition: documents are put in
the order of a seeded hash and taken once more until the rest is used up, the last one in part.  Thus a
source's words meet its target to the word, in every run.  A document that occurs m times is one entry of that order and each
copy takes the same number of words, so a target may be missed by less than m.

No source is handled as a whole: its documents are dealt to 65,536 buckets by their hash, the sums of buckets are added up, and
only within a bucket are documents put in order.  Sources are numbered by a range exchange and the counts of its parts.

Defined results: a null text has no words.  A null source is a source of its own, the last one.  Documents with a null ``doc_id`` of
equal source and size count as copies of each other.  Sources without words have the target 0.
Extra columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siemspark.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 4  # hexadecimal digits of the hash that make a bucket
COPIES = 10_000  # copies of a document that one task writes


def sizes(docs: DataFrame, seed: str) -> DataFrame:
    """(doc_id, source, size, draw): words of every document and its place in the seeded order."""
    text, key = F.col("text").cast("string"), F.col("doc_id").cast("long")
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))))
    return docs.select(key.alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       draw.alias("draw"))


def numbered(sources: DataFrame, by: str) -> DataFrame:
    """Adds ``number``, from 0, in the order of ``by`` (nulls last); values differ.

    Rows are dealt by ranges and numbered inside their part; the sizes of the parts before are added.
    """
    # The hidden first key puts nulls last; ranges follow both.
    parts = (sources.withColumn("_last", F.col(by).isNull()).repartitionByRange("_last", by)
             .withColumn("_part", F.spark_partition_id()))
    parts = stage(parts, "ranges")
    # One row per part.
    before = (parts.groupBy("_part").agg(F.count("*").alias("_rows"))
              .withColumn("_before", F.coalesce(F.sum("_rows").over(
                  Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_rows"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_last", by)) - 1
    return (parts.withColumn("_inside", inside).join(before, "_part")
            .withColumn("number", F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside", "_last"))


def water_level(sources: DataFrame, total: float, epochs: float) -> float:
    """The words per weight at which all sources, clamped at ``epochs`` times their words, share ``total``.

    Each round deals what the clamped sources leave to the others.  Levels rise, so a source once clamped stays so.
    """
    level = -1.0
    while True:
        above = F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(epochs)
        row = sources.agg(F.sum(F.when(above, F.col("source_size") * F.lit(epochs))).alias("clamped"),
                          F.sum(F.when(~above, F.col("weight"))).alias("weights"),
                          F.sum(above.cast("long")).alias("n")).first()
        if not row["weights"]:
            # Nothing is left to raise: every source is clamped, or there is none.
            return level
        found = (total - (row["clamped"] or 0.0)) / row["weights"]
        if found <= level:
            return level
        level = found


def targets(counted: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """(source, source_size, target) of sources with their sizes; weights go round in the order of code points."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    listed = numbered(counted, "source").withColumn(
        "weight", F.element_at(cycle, (F.col("number") % len(weights) + 1).cast("int")))
    listed = stage(listed.select("source", "source_size", "weight"), "sources")
    total = listed.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level = water_level(listed, share * total, epochs)
    return listed.select("source", "source_size",
                         F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(epochs)).alias("target"))


def words_before(buckets: DataFrame) -> DataFrame:
    """(source, bucket, before): words of a source's earlier buckets.

    Summed up in two steps of 256, so that a source is 256 groups and not one.
    """
    def earlier(*by):
        return Window.partitionBy("source", *by).rowsBetween(Window.unboundedPreceding, -1)

    none, high = F.lit(0), F.substring("bucket", 1, BUCKET_DIGITS // 2)
    fine = buckets.withColumn("high", high)
    fine = fine.withColumn("inside", F.coalesce(F.sum("words").over(earlier("high").orderBy("bucket")), none))
    coarse = buckets.groupBy(F.col("source").alias("of"), high.alias("part")).agg(F.sum("words").alias("words"))
    above = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("above", F.coalesce(F.sum("words").over(above), none)).drop("words")
    both = fine.join(coarse, F.col("source").eqNullSafe(F.col("of")) & (F.col("high") == F.col("part")))
    return both.select("source", "bucket", (F.col("above") + F.col("inside")).alias("before"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0,
        seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document."""
    if not weights or min(weights) <= 0 or share < 0 or epochs < 0 or share > epochs:
        raise ValueError("weights must be positive and share at most the epochs")
    # The texts are read once.
    rows = sizes(docs, seed).withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS))
    entry = ["source", "bucket", "draw", "doc_id", "size"]
    entries = stage(rows.groupBy(*entry).agg(F.count("*").alias("copies")), "entries")

    buckets = entries.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    buckets = stage(buckets, "buckets")
    counted = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    wanted = targets(counted, weights, share, epochs)

    buckets = words_before(buckets)
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    wanted = (wanted.withColumn("whole", whole)
              .withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")))
    buckets = (buckets.withColumnRenamed("source", "_source").join(wanted, F.col("_source").eqNullSafe(F.col("source")))
               .drop("source").withColumnRenamed("bucket", "_bucket"))

    # Both sides are dealt by source and bucket, so a hot source is many tasks.
    placed = entries.join(buckets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    inside = (Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    words = F.col("size") * F.col("copies")
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum(words).over(inside), F.lit(0))
    again = F.floor(F.greatest(F.lit(0), F.least(left, words)) / F.col("copies"))
    placed = placed.select("doc_id", "source", "size", "source_size", "target",
                           (F.col("whole") * F.col("size") + again).cast("long").alias("taken"), "copies")
    placed = stage(placed, "placed")

    names = [c for c in placed.columns if c != "copies"]
    few = placed.where(F.col("copies") <= COPIES).select(*names, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    # Copies of one document beyond that are written by several tasks.
    lots = (placed.where(F.col("copies") > COPIES)
            .withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))))
            .withColumn("n", F.least(F.lit(COPIES), F.col("copies") - F.col("lot") * COPIES).cast("int"))
            .repartition("doc_id", "lot").select(*names, F.explode(F.sequence(F.lit(1), F.col("n")))))
    return few.select(*names).unionByName(lots.select(*names))
