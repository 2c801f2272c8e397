"""Stateful stream operators built from the batch operators.

Each micro-batch runs the skew-safe batch operator over its rows plus a small
carried state.  State lives in tables under a shared folder, one version per
batch id: a batch that is run again reads the version before it and writes
the same result, so a lost executor or a restarted driver changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siemspark.operators.raw import source_gaps

LATE_POLICIES = ("ACCEPT_WITH_LIMIT", "IGNORE_FOR_STREAM")
_TAIL, _PENDING = "TAIL", "PENDING"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_versions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows written by any batch, the technical ``batch`` column left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(path).drop("batch")


class Matcher:
    """Runs a windowed matcher on a stream: one first match per group.

    ``match(rows)`` is a batch matcher returning ``keys`` plus its result.
    Rows wait until the watermark (largest event time minus ``lateness_ms``)
    has passed them, so they are matched in event-time order; rows older than
    the watermark are dropped.  ACCEPT_WITH_LIMIT waits ``lateness_ms``,
    IGNORE_FOR_STREAM waits not at all.  Only rows of the last window and the
    waiting rows are carried.
    """

    def __init__(self, root: str, match: Callable[[DataFrame], DataFrame], keys: Sequence[str],
                 time_col: str, id_col: str, window_ms: int, lateness_ms: int = 0,
                 late_policy: str = "ACCEPT_WITH_LIMIT"):
        if late_policy not in LATE_POLICIES:
            raise ValueError("a stream takes ACCEPT_WITH_LIMIT or IGNORE_FOR_STREAM")
        self.root, self.match, self.keys = root.rstrip("/"), match, list(keys)
        self.time_col, self.id_col, self.window_ms = time_col, id_col, window_ms
        self.lateness_ms = lateness_ms if late_policy == "ACCEPT_WITH_LIMIT" else 0
        self.last_batch: int | None = None
        self.schema: T.StructType | None = None

    def _path(self, name: str, batch: int) -> str:
        return f"{self.root}/{name}/batch={batch}"

    def _previous(self, spark: SparkSession, batch: int):
        """State rows and watermark left by the batch before."""
        path = self._path("state", batch - 1)
        if batch == 0 or not exists(spark, path):
            full = T.StructType([*self.schema.fields, T.StructField("_part", T.StringType())])
            return spark.createDataFrame([], full), None
        mark = spark.read.parquet(self._path("watermark", batch - 1)).first()[0]
        return spark.read.parquet(path), mark

    def process(self, rows: DataFrame, batch: int) -> None:
        self._advance(rows, batch, flush=False)

    def flush(self, spark: SparkSession) -> None:
        """End of the stream: matches what is still waiting."""
        if self.last_batch is not None:
            self._advance(spark.createDataFrame([], self.schema), self.last_batch + 1, flush=True)

    def _advance(self, rows: DataFrame, batch: int, flush: bool) -> None:
        spark = rows.sparkSession
        self.schema, self.last_batch = T.StructType(rows.schema.fields), batch
        carried, mark = self._previous(spark, batch)
        t = F.col(self.time_col)
        fresh = rows if mark is None else rows.where(t > mark)
        pool = carried.unionByName(fresh.withColumn("_part", F.lit(_PENDING)))
        pool = pool.dropDuplicates([self.id_col])  # a repeated delivery changes nothing
        top = rows.agg(F.max(t)).first()[0]  # one number
        new_mark = max([x for x in (mark, None if top is None else top - self.lateness_ms) if x is not None],
                       default=None)
        ready = F.lit(True) if flush else (F.lit(False) if new_mark is None else t <= new_mark)
        fired = self._fired(spark)
        known = pool.where((F.col("_part") == _TAIL) | ready).drop("_part")
        if fired is not None:
            known = known.join(fired, self.keys, "left_anti")
        self.match(known).write.mode("overwrite").parquet(self._path("matches", batch))
        keep = (F.col("_part") == _PENDING) & ~ready
        if new_mark is not None and not flush:
            keep = keep | (t > new_mark - self.window_ms - 1)
        state = pool.where(keep).withColumn("_part", F.when(ready, _TAIL).otherwise(F.col("_part")))
        state.write.mode("overwrite").parquet(self._path("state", batch))
        spark.createDataFrame([(new_mark,)], "mark long").write.mode("overwrite").parquet(
            self._path("watermark", batch))

    def _fired(self, spark: SparkSession) -> DataFrame | None:
        """Groups that matched in an earlier batch."""
        path = f"{self.root}/matches"
        if self.last_batch == 0 or not exists(spark, path):
            return None
        return spark.read.parquet(path).where(F.col("batch") < self.last_batch).select(*self.keys)

    def matches(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/matches").drop("batch")


class GapTracker:
    """Sequence gaps on a stream; carries the highest number per source."""

    def __init__(self, root: str, keys: Sequence[str], sequence: str, order: Sequence[str], chunk):
        self.root, self.keys, self.sequence = root.rstrip("/"), list(keys), sequence
        self.order, self.chunk = list(order), chunk

    def process(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        path = f"{self.root}/top/batch={batch - 1}"
        gaps = source_gaps(rows, self.keys, self.sequence, self.order, self.chunk())
        tops = rows.groupBy(*self.keys).agg(F.max(self.sequence).alias("_top"))
        if batch > 0 and exists(spark, path):
            before = spark.read.parquet(path)
            seen = rows.join(before, self.keys, "left")
            # Numbers up to the carried one are old news for their source.
            fresh = seen.where(F.col("_top").isNull() | (F.col(self.sequence) > F.col("_top"))).drop("_top")
            inner = source_gaps(fresh, self.keys, self.sequence, self.order, self.chunk())
            first = (fresh.groupBy(*self.keys)
                     .agg(F.min_by(self.sequence, F.struct(*self.order)).alias("observed_sequence"))
                     .join(before, self.keys).where(F.col("observed_sequence") > F.col("_top") + 1)
                     .select(*self.keys, (F.col("_top") + 1).alias("expected_sequence"), "observed_sequence"))
            gaps = inner.unionByName(first)
            tops = (before.unionByName(tops).groupBy(*self.keys).agg(F.max("_top").alias("_top")))
        gaps.write.mode("overwrite").parquet(f"{self.root}/gaps/batch={batch}")
        tops.write.mode("overwrite").parquet(f"{self.root}/top/batch={batch}")

    def gaps(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/gaps").drop("batch")
