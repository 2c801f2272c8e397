"""Raw evidence: intake, contract checks, delivery bookkeeping, manifests, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siemspark.functions.scalars import (col, first_failure, in_timestamp_range,
                                         is_sha256, is_uuid_v7, rfc3339)
from siemspark.functions.text import strict_json
from siemspark.operators.detect import id_from_key
from siemspark.operators.ordered import running_max

DEFAULT_MAX_PAYLOAD = 1_048_576

# Message contracts of the raw boundary.
RECEIVED_TYPE, RECEIVED_SCHEMA = "RawEvent", "raw_event.v1"
PERSISTED_TYPE, PERSISTED_SCHEMA = "RawEventPersisted", "raw_event_persisted.v1"


# --- intake ----------------------------------------------------------------

def admission_reason(max_payload: int = DEFAULT_MAX_PAYLOAD, require_sensor: bool = True) -> Column:
    """Why a record is refused, NULL when it is accepted."""
    checks = [(name, F.coalesce(F.col(name) != "", F.lit(False)))
              for name in ("tenant_id", "source_id", "remote_identity", "transport")]
    if require_sensor:
        checks.append(("sensor_id", F.coalesce(F.col("sensor_id") != "", F.lit(False))))
    checks.append(("raw_payload", F.octet_length("payload") <= max_payload))
    return first_failure(checks)


def raw_intake(df: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Exact bytes plus size, hash and a reproducible id.

    ``identity`` names the columns that tell two records apart (source,
    position, arrival time ...); a rerun over the same input gives the same
    ids, so retried tasks cannot invent new events.
    """
    key = F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity],
                             F.sha2("payload", 256)), 256)
    return df.select("*", id_from_key(key).alias("event_id"),
                     F.lit("sha256").alias("raw_hash_algorithm"),
                     F.sha2("payload", 256).alias("raw_hash"),
                     F.octet_length("payload").cast("long").alias("raw_size"))


def json_reason(media_type, payload, max_payload: int = DEFAULT_MAX_PAYLOAD) -> Column:
    """Why a JSON submission is refused: media type, size, then syntax."""
    base = F.lower(F.trim(F.substring_index(col(media_type), ";", 1)))
    return (F.when(F.coalesce(base, F.lit("")) != "application/json", "unsupported_media_type")
            .when(F.octet_length(payload) > max_payload, "payload_too_large")
            .when(strict_json(col(payload).cast("string")).isNull(), "invalid_json"))


def framed_lines(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Newline-framed messages as raw payloads, bytes untouched, with position."""
    return (df.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
            .select(*keep, "line_no", F.encode("line", "UTF-8").alias("payload")))


# --- contracts -------------------------------------------------------------

def raw_violation() -> Column:
    return first_failure([
        ("event_id", is_uuid_v7("event_id")),
        ("event_time", F.col("event_time_seconds").isNull()
         | in_timestamp_range("event_time_seconds", "event_time_nanos")),
        ("ingest_time", in_timestamp_range("ingest_time_seconds", "ingest_time_nanos")),
        ("raw_size", F.col("raw_size") == F.octet_length("payload")),
        ("raw_hash_algorithm", F.col("raw_hash_algorithm") == "sha256"),
        ("raw_hash", F.col("raw_hash") == F.sha2("payload", 256)),
    ])


def persisted_violation() -> Column:
    return first_failure([
        ("event_id", is_uuid_v7("event_id")),
        *[(c, F.col(c) != "") for c in ("tenant_id", "source_id", "pipeline_version",
                                       "storage_uri", "segment_id")],
        ("event_time", F.col("event_time_seconds").isNull()
         | in_timestamp_range("event_time_seconds", "event_time_nanos")),
        ("ingest_time", in_timestamp_range("ingest_time_seconds", "ingest_time_nanos")),
        ("persisted_at", in_timestamp_range("persisted_at_seconds", "persisted_at_nanos")),
        ("raw_hash_algorithm", F.col("raw_hash_algorithm") == "sha256"),
        ("raw_hash", is_sha256("raw_hash")),
        ("length", F.col("length") == F.col("raw_size")),
    ])


def envelope_violation() -> Column:
    return first_failure([
        ("contract_version", F.col("contract_version") == "1"),
        ("message_id", is_uuid_v7("message_id")),
        ("message_type", F.col("message_type") != ""),
        ("producer", F.col("producer").isNotNull()),
        ("producer.component", F.col("producer.component") != ""),
        ("producer.component_version", F.col("producer.component_version") != ""),
        ("emitted_at", in_timestamp_range("emitted_at_seconds", "emitted_at_nanos")),
        ("payload_schema", F.col("payload_schema") != ""),
        ("payload", F.col("has_payload")),
    ])


def handoff_violation(message_type: str = RECEIVED_TYPE, schema: str = RECEIVED_SCHEMA) -> Column:
    """Envelope and event must agree on type, schema and tenant."""
    return first_failure([
        ("message_type", F.col("message_type") == message_type),
        ("payload_schema", F.col("payload_schema") == schema),
        ("envelope_tenant", F.col("envelope_tenant_id") != ""),
        ("event_tenant", F.col("tenant_id") != ""),
        ("tenant_differs", F.col("envelope_tenant_id") == F.col("tenant_id")),
    ])


# --- delivery --------------------------------------------------------------

def delivery_disposition(deliveries: DataFrame, processed: DataFrame) -> DataFrame:
    """What to do with each delivery of one consumer.

    ``processed`` holds one row per (consumer, message_id).  Known and
    published: ACK; known and not published: REPUBLISH; known with another
    event or hash: ISOLATE; unknown: PRESERVE.
    """
    known = processed.select("consumer", "message_id", F.col("event_id").alias("_e"),
                             F.col("raw_hash").alias("_h"), "published")
    joined = deliveries.join(known, ["consumer", "message_id"], "left")
    differs = ~(F.col("_e").eqNullSafe(F.col("event_id")) & F.col("_h").eqNullSafe(F.col("raw_hash")))
    return joined.select(
        *deliveries.columns,
        F.when(F.col("published").isNull(), "PRESERVE").when(differs, "ISOLATE")
        .when(F.col("published"), "ACK").otherwise("REPUBLISH").alias("disposition"))


def locator_conflicts(locators: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Ids that were stored under more than one locator (combined map-side)."""
    rest = [c for c in locators.columns if c != id_col]
    print_ = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    return (locators.groupBy(id_col)
            .agg(F.min(print_).alias("_a"), F.max(print_).alias("_b"), F.count(F.lit(1)).alias("rows"))
            .where(F.col("_a") != F.col("_b")).select(id_col, "rows"))


_PERSISTED_KEEP = ["event_id", "tenant_id", "source_id", "sensor_id", "event_time_seconds",
                   "event_time_nanos", "ingest_time_seconds", "ingest_time_nanos", "content_type",
                   "raw_size", "raw_hash_algorithm", "raw_hash", "transport", "remote_identity"]


def raw_persisted(raw: DataFrame, objects: DataFrame, pipeline_version: str = "1") -> DataFrame:
    """Handoff rows: the raw metadata without its bytes, plus where they lie."""
    place = objects.select("event_id", "storage_uri", "segment_id", "offset", "length",
                           "persisted_at_seconds", "persisted_at_nanos")
    return (raw.select(*_PERSISTED_KEEP, F.col("message_id").alias("causation_id"))
            .join(place, "event_id")
            .withColumn("pipeline_version", F.lit(pipeline_version)))


RAW_URI = "^raw:///(?!\\.\\.?(/|$))[^/]+(/(?!\\.\\.?(/|$))[^/]+)*$"


def raw_fetch(locators: DataFrame, store: DataFrame) -> DataFrame:
    """Bytes [offset, offset + length) of each locator, or a reason.

    ``store`` is (storage_uri, object); the join is on the URI.
    """
    joined = locators.join(store, "storage_uri", "left")
    end = F.col("offset") + F.col("length")
    reason = (F.when(~F.coalesce(F.col("storage_uri").rlike(RAW_URI), F.lit(False)), "NORM-RAW-URI")
              .when(F.col("object").isNull() | (F.octet_length("object") < end), "NORM-RAW-READ"))
    cut = F.substring(F.col("object"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return (joined.withColumn("error_code", reason)
            .withColumn("payload", F.when(F.col("error_code").isNull(), cut))
            .select(*locators.columns, "payload", "error_code"))


def reverify_code(payload="payload") -> Column:
    """Bytes read back against the handoff: length first, then hash."""
    return (F.when(F.octet_length(payload) != F.col("raw_size"), "NORM-RAW-LENGTH")
            .when(F.sha2(payload, 256) != F.col("raw_hash"), "NORM-RAW-HASH"))


# --- manifests -------------------------------------------------------------

MANIFEST_SCHEMA = ("manifest_version int, segment_id string, tenant_id string, event_count bigint, "
                   "first_event_id string, last_event_id string, created_at string, "
                   "previous_segment_hash string, content_hash string")


def manifest_text(struct: Column) -> Column:
    """Exact stored bytes: compact JSON in field order and one line feed."""
    return F.concat(F.to_json(struct, {"ignoreNullFields": "false"}), F.lit("\n"))


def segment_manifests(raw: DataFrame) -> DataFrame:
    """One closed segment per event, as the store writes them."""
    manifest = F.struct(
        F.lit(1).alias("manifest_version"), F.col("event_id").alias("segment_id"), F.col("tenant_id"),
        F.lit(1).cast("long").alias("event_count"), F.col("event_id").alias("first_event_id"),
        F.col("event_id").alias("last_event_id"),
        rfc3339("persisted_at_seconds", "persisted_at_nanos").alias("created_at"),
        F.lit(None).cast("string").alias("previous_segment_hash"),
        F.concat(F.lit("sha256:"), "raw_hash").alias("content_hash"))
    return (raw.select("tenant_id", F.col("event_id").alias("segment_id"), "raw_hash",
                       manifest_text(manifest).alias("manifest"))
            .withColumn("manifest_hash", F.sha2("manifest", 256)))


def manifest_violation() -> Column:
    """First failed check of a stored manifest against its event.

    Needs ``manifest``, ``manifest_hash``, ``event_id``, ``tenant_id``,
    ``raw_hash``.
    """
    m = F.from_json("manifest", MANIFEST_SCHEMA)
    utc = F.coalesce(m["created_at"].endswith("Z")
                     & F.try_to_timestamp(m["created_at"]).isNotNull(), F.lit(False))
    return first_failure([
        ("line_feed", F.col("manifest").endswith("\n") & ~F.col("manifest").endswith("\n\n")),
        ("canonical_form", manifest_text(m) == F.col("manifest")),
        ("manifest_version", m["manifest_version"] == 1),
        ("identity", (m["segment_id"] == F.col("event_id")) & (m["tenant_id"] == F.col("tenant_id"))),
        ("event_range", (m["event_count"] == 1) & (m["first_event_id"] == F.col("event_id"))
         & (m["last_event_id"] == F.col("event_id"))),
        ("previous_segment_hash", m["previous_segment_hash"].isNull()),
        ("content_hash", m["content_hash"] == F.concat(F.lit("sha256:"), "raw_hash")),
        ("created_at", utc),
        ("manifest_hash", F.col("manifest_hash") == F.sha2("manifest", 256)),
    ])


# --- sequence gaps ---------------------------------------------------------

def source_gaps(rows: DataFrame, keys: Sequence[str], sequence: str, order: Sequence[str],
                chunk: Column) -> DataFrame:
    """Forward jumps of a source's own numbering, in arrival order.

    A number at most one above the highest seen so far is no gap; repeats and
    steps back are ignored.  ``chunk`` must not decrease along ``order``: a
    source with a third of all rows is cut into chunks, each chunk gets the
    highest number before it from a scan over chunks and chunks of chunks, and only then
    are rows compared inside their chunk.
    """
    seen = rows.where(F.col(sequence).isNotNull()).withColumn("_chunk", chunk)
    tops = seen.groupBy(*keys, "_chunk").agg(F.max(sequence).alias("_top"))
    carry = running_max(tops, keys, "_chunk", "_top").withColumnRenamed("before", "_carry")
    inside = (Window.partitionBy(*keys, "_chunk").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    highest = F.greatest("_carry", F.max(sequence).over(inside))
    return (seen.join(carry, [*keys, "_chunk"]).withColumn("_prev", highest)
            .where(F.col(sequence) > F.col("_prev") + 1)
            .select(*keys, (F.col("_prev") + 1).alias("expected_sequence"),
                    F.col(sequence).alias("observed_sequence")))


# --- counters --------------------------------------------------------------

def ingest_metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counters from admission results (``reason`` NULL means accepted)."""
    refused = F.col("reason").isNotNull()
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("received"), F.count_if(~refused).alias("accepted"),
        F.count_if(refused).alias("rejected"),
        F.sum(F.octet_length("payload").cast("long")).alias("bytes_received"),
        F.count_if(F.col("reason") == "raw_payload").alias("payload_too_large"),
        F.count_if(refused & (F.col("reason") != "raw_payload")).alias("invalid_metadata"))


# --- outbox ----------------------------------------------------------------

def outbox_rows(objects: DataFrame, subject: str, message_type: str, schema: str, key: str,
                component: str = "siemspark", component_version: str = "1") -> DataFrame:
    """One lifecycle message per created object; its id follows from the key."""
    return objects.select(
        id_from_key(F.sha2(F.concat(F.lit(subject + "|"), F.col(key)), 256)).alias("message_id"),
        F.lit(subject).alias("subject"), F.lit("1").alias("contract_version"),
        F.lit(message_type).alias("message_type"), "tenant_id",
        F.struct(F.lit(component).alias("component"),
                 F.lit(component_version).alias("component_version")).alias("producer"),
        F.lit(schema).alias("payload_schema"), F.col(key).alias("object_key"))


def outbox_state(outbox: DataFrame, publications: DataFrame) -> DataFrame:
    """First publication time per message; NULL means still pending."""
    first = publications.groupBy("message_id").agg(F.min("published_ms").alias("published_ms"))
    return outbox.join(first, "message_id", "left")


def preservation_records(processed: DataFrame, objects: DataFrame, outbox: DataFrame) -> DataFrame:
    """What was preserved for each processed delivery."""
    return (processed.join(objects, "event_id")
            .join(outbox.withColumnRenamed("message_id", "outgoing_message_id"), "outgoing_message_id"))


