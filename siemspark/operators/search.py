"""Bounded search over normalized events and keyset paging."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siemspark.functions.predicates import search_predicate
from siemspark.functions.scalars import rfc3339

MAX_RANGE_SECONDS = 24 * 3600
DEFAULT_LIMIT, MAX_LIMIT = 50, 200

EVENT_VIEW = ["normalized_event_id", "raw_event_id", "tenant_id", "event_time", "ingest_time",
              "ocsf_version", "class_uid", "category_uid", "activity_id", "severity_id",
              "parser_id", "parser_version", "mapping_id", "mapping_version", "normalized_hash",
              "execution_mode", "ocsf_event"]


def event_view(events: DataFrame) -> DataFrame:
    """Presentation columns: times as RFC 3339 text, '' for no event time."""
    normalized_hash = (F.col("normalized_hash") if "normalized_hash" in events.columns
                       else F.sha2("ocsf_event_json", 256))
    return events.select(
        "normalized_event_id", "raw_event_id", "tenant_id",
        F.when(F.col("event_time_present") == 1, rfc3339("event_time_seconds", "event_time_nanos"))
        .otherwise("").alias("event_time"),
        rfc3339("ingest_time_seconds", "ingest_time_nanos").alias("ingest_time"),
        "ocsf_version", "class_uid", "category_uid", "activity_id",
        F.col("severity").alias("severity_id"), "parser_id", "parser_version", "mapping_id",
        "mapping_version", normalized_hash.alias("normalized_hash"), "execution_mode",
        F.col("ocsf_event_json").alias("ocsf_event"))


def _at_least(seconds: int, nanos: int) -> Column:
    s, n = F.col("event_time_seconds"), F.col("event_time_nanos")
    return (s >= seconds) & ((s > seconds) | (n >= nanos))


def _before(seconds: int, nanos: int) -> Column:
    s, n = F.col("event_time_seconds"), F.col("event_time_nanos")
    return (s <= seconds) & ((s < seconds) | (n < nanos))


def time_range(events: DataFrame, start: tuple[int, int], end: tuple[int, int],
               max_seconds: int | None = None) -> DataFrame:
    """Half-open range [start, end) on (seconds, nanos).

    ``max_seconds`` bounds the length where a service wants that; the engine
    itself needs no bound.  Each side starts with a plain comparison on the
    stored seconds, which the scan can use.
    """
    if not start < end:
        raise ValueError("start must be before end")
    if max_seconds is not None and \
            (end[0] - start[0], end[1] - start[1]) > (max_seconds, 0):
        raise ValueError("time range is too long")
    out = events.where((F.col("event_time_present") == 1) & _at_least(*start) & _before(*end))
    if "event_date" in events.columns:
        day = [F.to_date(F.timestamp_seconds(F.lit(t[0]))) for t in (start, end)]
        out = out.where(F.col("event_date").between(*day))
    return out


def search(events: DataFrame, tenant_id: str, start, end, predicate: dict | None = None,
           max_seconds: int | None = None) -> DataFrame:
    """All events of a tenant in [start, end) that satisfy ``predicate``."""
    out = time_range(events.where(F.col("tenant_id") == tenant_id), start, end, max_seconds)
    return out.where(search_predicate(predicate)) if predicate else out


# --- paging ----------------------------------------------------------------

@dataclass(frozen=True)
class Cursor:
    seconds: int
    nanos: int
    event_id: str
    direction: str
    fingerprint: str

    def encode(self) -> str:
        text = json.dumps(self.__dict__, separators=(",", ":"))
        return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")

    @staticmethod
    def decode(text: str, fingerprint: str) -> "Cursor":
        try:
            raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
            cursor = Cursor(**json.loads(raw))
        except (ValueError, TypeError) as error:
            raise ValueError("invalid cursor") from error
        if cursor.fingerprint != fingerprint:
            raise ValueError("cursor belongs to another request")
        return cursor


def fingerprint(predicate: dict | None, start, end, direction: str) -> str:
    """Binds a cursor to the request it came from."""
    text = json.dumps([predicate, list(start), list(end), direction], sort_keys=True,
                      separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def _order(direction: str):
    if direction not in ("asc", "desc"):
        raise ValueError("direction must be asc or desc")
    pick = F.asc if direction == "asc" else F.desc
    return [pick("event_time_seconds"), pick("event_time_nanos"), pick("normalized_event_id")]


def after_cursor(events: DataFrame, seconds: int, nanos: int, event_id: str,
                 direction: str = "desc") -> DataFrame:
    """Rows strictly behind the cursor in the page order."""
    s, n, i = (F.col(c) for c in ("event_time_seconds", "event_time_nanos", "normalized_event_id"))
    if direction == "asc":
        return events.where((s >= seconds) & ((s > seconds) | (n > nanos)
                                              | ((n == nanos) & (i > event_id))))
    return events.where((s <= seconds) & ((s < seconds) | (n < nanos)
                                          | ((n == nanos) & (i < event_id))))


def page(events: DataFrame, limit: int = DEFAULT_LIMIT, direction: str = "desc") -> DataFrame:
    """First ``limit`` rows of the total order, with their position.

    One row more is fetched to learn whether more follow (``has_more``).
    Catalyst turns order + limit into a top-k per partition, not a sort.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1..{MAX_LIMIT}")
    from pyspark.sql import Window

    top = events.orderBy(*_order(direction)).limit(limit + 1)
    # At most limit + 1 rows are left here, so one partition is fine.
    numbered = top.withColumn("position", F.row_number().over(Window.orderBy(*_order(direction))))
    more = F.max("position").over(Window.partitionBy(F.lit(1))) > limit
    return numbered.withColumn("has_more", more).where(F.col("position") <= limit)


def keyset_list(df: DataFrame, key: str, after: str | None = None, limit: int = DEFAULT_LIMIT
                ) -> DataFrame:
    """Next ``limit`` + 1 rows behind ``after`` in key order."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1..{MAX_LIMIT}")
    out = df if after is None else df.where(F.col(key) > after)
    return out.orderBy(key).limit(limit + 1)


def lookup(events: DataFrame, tenant_id: str, event_id: str) -> DataFrame:
    return events.where((F.col("tenant_id") == tenant_id)
                        & (F.col("normalized_event_id") == event_id)).limit(1)
