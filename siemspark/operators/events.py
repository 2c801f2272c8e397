"""Bounded scans of normalized events and removal of repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siemspark.functions.scalars import millis


def batch_scan(events: DataFrame, tenant_id: str | None, mode: str,
               start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Events of one mode (and tenant) whose event time lies in [start, end].

    Both ends are closed and in milliseconds.  The exact test is preceded by
    plain comparisons on the stored seconds (and the date partition), which
    reach the Parquet scan.
    """
    if start_ms is not None and end_ms is not None and start_ms > end_ms:
        raise ValueError("start_ms must be <= end_ms")
    out = events.where((F.col("execution_mode") == mode) & (F.col("event_time_present") == 1))
    if tenant_id is not None:
        out = out.where(F.col("tenant_id") == tenant_id)
    ms = millis("event_time_seconds", "event_time_nanos")
    has_date = "event_date" in events.columns
    if start_ms is not None:
        first = start_ms // 1000
        out = out.where((F.col("event_time_seconds") >= first) & (ms >= start_ms))
        if has_date:
            out = out.where(F.col("event_date") >= F.to_date(F.timestamp_seconds(F.lit(first))))
    if end_ms is not None:
        last = end_ms // 1000
        out = out.where((F.col("event_time_seconds") <= last) & (ms <= end_ms))
        if has_date:
            out = out.where(F.col("event_date") <= F.to_date(F.timestamp_seconds(F.lit(last))))
    return out


def _orderable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.StructType):
        return all(_orderable(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return _orderable(data_type.elementType)
    return not isinstance(data_type, (T.MapType, T.VariantType))


def _collapse(df: DataFrame, id_col: str) -> DataFrame:
    """One row per id plus ``_conflict``.

    The aggregate combines map-side, so a third of all rows being copies of
    one event costs one row per map task, not one huge group.  Copies are
    compared as whole rows; only where a column has no order (maps) by hash.
    """
    rest = [c for c in df.columns if c != id_col]
    row = F.struct(*rest)
    copies = F.count(F.lit(1)).alias("_copies")
    if all(_orderable(df.schema[c].dataType) for c in rest):
        grouped = (df.select(id_col, row.alias("_row")).groupBy(id_col)
                   .agg(F.min("_row").alias("_row"), F.max("_row").alias("_last"), copies)
                   .withColumn("_conflict", F.col("_row") != F.col("_last")))
    else:
        content = F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)
        grouped = (df.select(id_col, row.alias("_row"), content.alias("_h")).groupBy(id_col)
                   .agg(F.min_by("_row", "_h").alias("_row"), copies,
                        (F.min("_h") != F.max("_h")).alias("_conflict")))
    return grouped.select(id_col, *[F.col("_row")[c].alias(c) for c in rest],
                          "_copies", "_conflict").select(*df.columns, "_copies", "_conflict")


def dedup_events(df: DataFrame, id_col: str = "normalized_event_id",
                 on_conflict: str = "raise") -> DataFrame:
    """Identical copies collapse to one row.

    Copies that differ are an error: ``raise`` fails the job as soon as such
    a row is read, ``quarantine`` leaves those ids out (list them with
    ``conflicting_ids``).
    """
    grouped = _collapse(df, id_col)
    if on_conflict == "quarantine":
        return grouped.where(~F.col("_conflict")).select(*df.columns)
    if on_conflict != "raise":
        raise ValueError("on_conflict must be 'raise' or 'quarantine'")
    message = F.concat(F.lit(f"conflicting copies of {id_col} "), F.col(id_col).cast("string"))
    checked = F.when(F.col("_conflict"), F.raise_error(message)).otherwise(F.col(id_col))
    return grouped.withColumn(id_col, checked).select(*df.columns)


def conflicting_ids(df: DataFrame, id_col: str = "normalized_event_id") -> DataFrame:
    return (_collapse(df, id_col).where("_conflict")
            .select(id_col, F.col("_copies").alias("copies")))
