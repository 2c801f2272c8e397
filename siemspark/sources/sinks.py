"""Idempotent appends: a rerun adds nothing that is already stored.

Plain Parquet tables have no transactions, so one writer per table is
assumed.  A failed append may leave rows behind; repeating it adds only the
rows still missing, because the key decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siemspark.session import cut_lineage


def table_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The stored table, empty before the first append."""
    if not table_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def digest(value) -> Column:
    """16 bytes of SHA-256, in the order of the whole; empty, not null, for null.  Travels instead of long texts."""
    return F.coalesce(F.substring(F.unhex(F.sha2(F.col(value).cast("string") if isinstance(value, str) else value, 256)), 1, 16),
                      F.lit(b""))


def one_per_key(new: DataFrame, key: str) -> DataFrame:
    """Repeats inside one batch: the row with the smallest content stays."""
    rest = [c for c in new.columns if c != key]
    content = digest(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}))
    pick = F.min_by(F.struct(*rest), content)
    return new.groupBy(key).agg(pick.alias("_r")).select(key, "_r.*").select(*new.columns)


def missing_rows(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return one_per_key(new, key).join(stored.select(key), key, "left_anti").select(*new.columns)


def stored_or_new(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """For each key of ``new`` the stored row if there is one, else the new row."""
    left = one_per_key(new, key).select(key, F.struct(*new.columns).alias("_n"))
    right = stored.select(key, F.struct(*new.columns).alias("_s"))
    return (left.join(right, key, "left").select(F.coalesce("_s", "_n").alias("_r"))
            .select("_r.*"))


def touched(stored: DataFrame, rows: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """The partitions of ``stored`` that ``rows`` fall into.

    The partition values are a table of their own that the scan of ``stored`` is
    pruned by when it runs, however many there are.
    """
    wanted = rows.select(*[F.col(c).alias(f"_p_{c}") for c in partition_by]).distinct()
    same = [stored[c].eqNullSafe(wanted[f"_p_{c}"]) for c in partition_by]
    return stored.join(wanted, same, "left_semi")


def append_missing(new: DataFrame, path: str, key: str, partition_by: Sequence[str] = (),
                   sort_by: Sequence[str] = ()) -> DataFrame:
    """Appends the rows whose key is not stored yet and returns the table.

    Keys come first: once the table exists, digests of the batch's keys are compared with those of the stored ones, and
    only rows whose key is missing travel and are reduced to one per key.  So ``new`` is read twice then, and a costly input is
    best written or persisted by the caller.  Of the stored table only the key column is read.

    With ``partition_by`` a key must determine its partition: then only the
    partitions the new rows fall into are searched for their keys.  Rows are
    rebalanced by partition when they are written: a tenant with a third of the
    data is split over tasks, and small partitions get one file.
    """
    spark = new.sparkSession
    rows = new
    if table_exists(spark, path):
        missing = cut_lineage(missing_keys(new, read_table(spark, path, new.schema), key, partition_by), "missing")
        if missing.isEmpty():
            return spark.read.schema(new.schema).parquet(path)
        rows = new.withColumn("_k", digest(key)).join(missing, "_k", "left_semi").drop("_k")
    rows = one_per_key(rows, key)
    if partition_by:
        rows = rows.hint("rebalance", *map(F.col, partition_by))
        rows = rows.sortWithinPartitions(*partition_by, *(sort_by or (key,)))
    # Keys and digests are long hexadecimal texts, which this compression halves.
    rows.write.mode("append").partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return spark.read.schema(new.schema).parquet(path)


def missing_keys(new: DataFrame, stored: DataFrame, key: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """The digests (``_k``) of the keys of ``new`` that are not stored; a null key never is.

    The stored keys that are among the new ones are found first: where the new ones are few enough to be sent to all
    tasks, the table is not shuffled.
    """
    new = new.select(digest(key).alias("_k"), *partition_by).distinct()
    if partition_by:
        # Their partitions and their keys are both looked up, so they are written once.
        new = cut_lineage(new, "keys")
        stored, new = touched(stored, new, partition_by), new.select("_k").distinct()
    known = stored.select(digest(key).alias("_s")).join(new, F.col("_s") == F.col("_k"), "left_semi")
    # Not an anti join, which would be moved below the distinct keys and meet every row.
    met = new.join(known.withColumn("_f", F.lit(True)), F.col("_k") == F.col("_s"), "left")
    return met.where(F.col("_f").isNull() | (F.col("_k") == F.lit(b""))).select("_k")


def key_conflicts(new: DataFrame, stored: DataFrame, key: str, compare: Sequence[str]) -> DataFrame:
    """Keys stored earlier with other content, and the columns that differ."""
    old = stored.select(key, *[F.col(c).alias("_s_" + c) for c in compare])
    joined = new.select(key, *compare).join(old, key)
    differs = [F.when(~F.col(c).eqNullSafe(F.col("_s_" + c)), F.lit(c)) for c in compare]
    return (joined.withColumn("differs", F.concat_ws(",", *differs))
            .where(F.col("differs") != "").select(key, "differs"))
