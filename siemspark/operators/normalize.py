"""Parsed records to common-schema events with reproducible derivation keys."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siemspark.functions.scalars import (MODE_CODES, col, first_failure, in_timestamp_range,
                                         is_uuid_v7, millis, settle)
from siemspark.functions.fields import strict_string
from siemspark.operators.detect import id_from_key
from siemspark.operators.parse import MONTHS, RFC3164, SSHD, column_name

OCSF_VERSION = "1.9.0"
PIPELINE_VERSION = "1"
FALLBACK = "ingest_time_fallback"

_OFFSET = re.compile(r"^([+-])(\d\d):([0-5]\d)$")
OFFSET_PATTERN = "^[+-]([01][0-9]|2[0-5]):[0-5][0-9]$"


# --- source time -----------------------------------------------------------

def offset_seconds(text: str) -> int:
    m = _OFFSET.match(text)
    if not m or int(m[2]) > 25:
        raise ValueError(f"UTC offset {text!r} must be +HH:MM or -HH:MM")
    return (1 if m[1] == "+" else -1) * (int(m[2]) * 3600 + int(m[3]) * 60)


def policies_from_spec(spec: str) -> dict[str, str]:
    """``source=+HH:MM,...`` as a dict; a source may be named once."""
    out: dict[str, str] = {}
    for entry in filter(None, [x.strip() for x in spec.split(",")]):
        source, sep, offset = (x.strip() for x in entry.partition("="))
        if not sep or not source or "=" in offset:
            raise ValueError("entries must read source_id=+HH:MM")
        if source in out:
            raise ValueError(f"duplicate policy for {source}")
        offset_seconds(offset)
        out[source] = offset
    return out


def policy_errors(policies: DataFrame) -> DataFrame:
    """Rows of a (source_id, utc_offset) table that cannot be used, with a reason."""
    names = policies.groupBy("source_id").agg(F.count(F.lit(1)).alias("entries"),
                                              F.min("utc_offset").alias("utc_offset"))
    reason = (F.when(F.coalesce(F.trim("source_id"), F.lit("")) == "", "empty source")
              .when(F.col("source_id").rlike("[,=]"), "source has ',' or '='")
              .when(F.col("entries") > 1, "duplicate source")
              .when(~F.coalesce(F.col("utc_offset").rlike(OFFSET_PATTERN), F.lit(False)), "bad offset"))
    return (names.withColumn("reason", reason).where(F.col("reason").isNotNull())
            .select("source_id", "entries", "reason"))


def nearest_year_seconds(text, ingest_seconds, offset_sec: Column) -> Column:
    """Epoch seconds of a year-less local time, in the year closest to ingest.

    Years around the local ingest year are tried; dates that do not exist are
    skipped; on equal distance the earlier year wins.
    """
    text, ingest = col(text), col(ingest_seconds)
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)])
    month = F.try_element_at(months, F.substring(text, 1, 3))

    def two(start: int) -> Column:
        return F.trim(F.substring(text, start, 2)).try_cast("int")

    year = F.year(F.timestamp_seconds(ingest + offset_sec))

    def attempt(shift: int) -> Column:
        made = F.try_make_timestamp(year + shift, month, two(5), two(8), two(11), two(14))
        seconds = F.unix_seconds(made) - offset_sec
        return F.when(made.isNotNull(), F.struct(F.abs(seconds - ingest).alias("distance"),
                                                 F.lit(shift).alias("shift"),
                                                 seconds.alias("seconds")))

    tries = F.array_compact(F.array(attempt(-1), attempt(0), attempt(1)))
    return F.array_min(tries)["seconds"]


def resolve_event_time(df: DataFrame, policies: dict[str, str] | None = None) -> DataFrame:
    """Adds ``resolved_seconds``, ``resolved_nanos``, ``time_source``, ``time_assumption``.

    A declared event time wins; a year-less syslog time is resolved only
    under the policy of its source; otherwise the time stays unresolved.
    """
    policies = policies or {}
    declared = F.col("event_time_seconds").isNotNull()
    if policies:
        table = F.create_map(*[F.lit(x) for s, o in policies.items() for x in (s, offset_seconds(o))])
        texts = F.create_map(*[F.lit(x) for kv in policies.items() for x in kv])
        offset = F.try_element_at(table, F.col("source_id"))
        text = F.try_element_at(texts, F.col("source_id"))
    else:
        offset, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    wanted = F.filter("time_candidates", lambda c: c["precision"] == "second_without_year_or_timezone")
    stamp = F.when(F.col("parser_id") == RFC3164, F.get(wanted, F.lit(0))["value"])
    out = df.withColumn("_offset", offset).withColumn("_stamp", stamp)
    out = out.withColumn("_nearest", F.when(~declared & F.col("_offset").isNotNull(),
                                            nearest_year_seconds("_stamp", "ingest_time_seconds", F.col("_offset"))))
    by_policy = F.col("_nearest").isNotNull()
    return (out.withColumn("resolved_seconds", F.coalesce("event_time_seconds", "_nearest"))
            .withColumn("resolved_nanos", F.when(declared, F.col("event_time_nanos"))
                        .when(by_policy, F.lit(0)))
            .withColumn("time_source", F.when(declared, "event_time")
                        .when(by_policy, "source_time_policy").otherwise(FALLBACK))
            .withColumn("time_assumption", F.when(~declared & by_policy, F.concat(
                F.lit("fixed_utc_offset="), text,
                F.lit(";rfc3164_year=nearest_ingest_year;candidate=timestamp"))))
            .drop("_offset", "_stamp", "_nearest"))


# --- mapping ---------------------------------------------------------------

@dataclass(frozen=True)
class Mapping:
    """How rows of one parser become an event object.

    ``event(parsed, context)`` returns the object as a column;
    ``required(parsed)`` lists the conditions that must hold.
    """

    id: str
    version: str
    parser_id: str
    event: Callable[[Column, "MapContext"], Column]
    required: Callable[[Column], Sequence[Column]]
    class_uid: int
    category_uid: int
    activity_id: int | None
    severity: int | None


@dataclass(frozen=True)
class MapContext:
    time_ms: Column
    logged_ms: Column
    processed_ms: Column
    time_source: Column
    time_assumption: Column
    product: str = "siemspark"
    vendor: str = "siemspark"
    extension_prefix: str = "x_"


def _object(**values) -> Column:
    """A struct with its fields in key order, so its JSON is canonical."""
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k)
                      for k, v in sorted(values.items())])


def ssh_authentication(parsed: Column, ctx: MapContext) -> Column:
    """The authentication class of the common event schema."""
    metadata = {
        "logged_time": ctx.logged_ms, "processed_time": ctx.processed_ms,
        "product": _object(name=ctx.product, vendor_name=ctx.vendor), "version": OCSF_VERSION,
        ctx.extension_prefix + "time_source": ctx.time_source,
        ctx.extension_prefix + "time_assumption": ctx.time_assumption}
    return _object(
        activity_id=1, activity_name="Logon", auth_protocol="SSH", auth_protocol_id=99,
        category_name="Identity & Access Management", category_uid=3, class_name="Authentication",
        class_uid=3002, is_remote=True, message=parsed["message"], metadata=_object(**metadata),
        service=_object(name="sshd"), severity="Low", severity_id=2,
        src_endpoint=_object(ip=parsed["source_ip"], port=parsed["source_port"]),
        status="Failure", status_id=2,
        status_detail=F.when(parsed["invalid_user"], "Invalid user").otherwise("Authentication failed"),
        time=ctx.time_ms, type_name="Authentication: Logon", type_uid=300201,
        user=_object(name=parsed["username"]))


SSH_MAPPING = Mapping(
    "linux.ssh.authentication", "1", SSHD, ssh_authentication,
    lambda p: [p["username"].isNotNull(), p["source_ip"].isNotNull(),
               p["source_port"].between(0, 65535), p["invalid_user"].isNotNull(),
               p["message"].isNotNull()],
    class_uid=3002, category_uid=3, activity_id=1, severity=2)


class MappingRegistry:
    def __init__(self, mappings: Sequence[Mapping] = (SSH_MAPPING,)):
        self.by_parser = {m.parser_id: m for m in mappings}

    def register(self, mapping: Mapping) -> "MappingRegistry":
        self.by_parser[mapping.parser_id] = mapping
        return self


def configuration_hash(parser_id, parser_version, mapping_id, mapping_version, mode: str,
                       policy: Column | None = None, pipeline: str = PIPELINE_VERSION) -> Column:
    """Hash of everything that shaped a derivation.

    ``policy`` (NULL where none applied) is added on top of the base hash.
    """
    base = F.sha2(F.concat(
        F.lit("parser="), col(parser_id), F.lit("@"), col(parser_version), F.lit("\nmapping="),
        col(mapping_id), F.lit("@"), col(mapping_version),
        F.lit(f"\nocsf={OCSF_VERSION}\npipeline={pipeline}\nmode=EXECUTION_MODE_{mode}\n")), 256)
    if policy is None:
        return base
    return F.when(policy.isNull(), base).otherwise(F.sha2(F.concat(
        F.lit("base_configuration="), base, F.lit("\nsource_time_policy="), policy, F.lit("\n")), 256))


def logical_key(raw_event_id, parser_id, parser_version, mapping_id, mapping_version, configuration,
                mode: str, pipeline: str = PIPELINE_VERSION) -> Column:
    """Identity of one derivation of one raw event."""
    return F.sha2(F.concat(
        F.lit("raw_event_id="), col(raw_event_id), F.lit("\nparser="), col(parser_id), F.lit("@"),
        col(parser_version), F.lit("\nmapping="), col(mapping_id), F.lit("@"), col(mapping_version),
        F.lit(f"\nocsf={OCSF_VERSION}\npipeline={pipeline}\nconfiguration="), col(configuration),
        F.lit(f"\nexecution_mode=EXECUTION_MODE_{mode}\n")), 256)


def map_events(parsed: DataFrame, mode: str, normalized_ms: int,
               policies: dict[str, str] | None = None, registry: MappingRegistry | None = None,
               extension_prefix: str = "x_") -> DataFrame:
    """Parsed rows to derivation rows; failures keep their code.

    ``error_code`` of the parser is kept; a missing mapping gives
    NORM-MAPPING-UNSUPPORTED, a missing field NORM-MISSING-REQUIRED-FIELD.
    """
    if mode not in MODE_CODES:
        raise ValueError("mode must be LIVE, REPLAY or TEST")
    registry = registry or MappingRegistry()
    df = resolve_event_time(parsed, policies)
    logged = millis("ingest_time_seconds", "ingest_time_nanos")
    resolved = millis("resolved_seconds", "resolved_nanos")
    ctx = MapContext(F.coalesce(resolved, logged), logged, F.lit(normalized_ms).cast("long"),
                     F.col("time_source"), F.col("time_assumption"), extension_prefix=extension_prefix)

    def per_mapping(value) -> Column:
        out = [F.when(F.col("parser_id") == m.parser_id, value(m)) for m in registry.by_parser.values()]
        return F.coalesce(*out) if out else F.lit(None).cast("string")

    complete = per_mapping(lambda m: first_failure(
        [("required", c) for c in m.required(F.col(column_name(m.parser_id)))]).isNull())
    mapped_id = per_mapping(lambda m: F.lit(m.id))
    df = (df.withColumn("mapping_id", mapped_id)
          .withColumn("mapping_version", per_mapping(lambda m: F.lit(m.version)))
          .withColumn("error_code", F.when(F.col("error_code").isNotNull(), F.col("error_code"))
                      .when(F.col("mapping_id").isNull(), "NORM-MAPPING-UNSUPPORTED")
                      .when(~complete, "NORM-MISSING-REQUIRED-FIELD")))
    ok = F.col("error_code").isNull()
    body = per_mapping(lambda m: F.to_json(m.event(F.col(column_name(m.parser_id)), ctx)))
    policy = None
    if policies:
        texts = F.create_map(*[F.lit(x) for kv in policies.items() for x in kv])
        found = F.try_element_at(texts, F.col("source_id"))
        policy = F.when(F.col("event_time_seconds").isNull() & found.isNotNull(), F.concat(
            F.lit("fixed_utc_offset="), found, F.lit(";rfc3164_year=nearest_ingest_year")))
    df = (df.withColumn("ocsf_event_json", F.when(ok, body))
          .withColumn("configuration_hash", F.when(ok, configuration_hash(
              "parser_id", "parser_version", "mapping_id", "mapping_version", mode, policy))))
    df = df.withColumn("logical_key", F.when(ok, logical_key(
        "raw_event_id", "parser_id", "parser_version", "mapping_id", "mapping_version",
        "configuration_hash", mode)))

    def number(attr):
        return F.when(ok, per_mapping(lambda m: F.lit(getattr(m, attr)).cast("long")))

    added = {
        "normalized_event_id": id_from_key(F.col("logical_key")),
        "normalized_hash": F.sha2("ocsf_event_json", 256),
        "normalization_status": F.when(ok, F.when(F.col("time_source") == FALLBACK, "PARTIAL")
                                       .otherwise("SUCCESS")),
        "class_uid": number("class_uid"), "category_uid": number("category_uid"),
        "activity_id": number("activity_id"), "severity": number("severity"),
    }
    df = settle(df.withColumns(added), ["mapping_id", "mapping_version", "error_code", "ocsf_event_json",
                                        "configuration_hash", "logical_key", *added])
    # Constants stay in sight, so that a filter on the mode is decided before any line is parsed.
    return df.withColumns({
        "execution_mode": F.lit(mode), "ocsf_version": F.lit(OCSF_VERSION),
        "pipeline_version": F.lit(PIPELINE_VERSION), "normalized_ms": F.lit(normalized_ms).cast("long")})


NORMALIZED_COLUMNS = [
    "tenant_id", "normalized_event_id", "raw_event_id", "logical_key", "event_time_present",
    "event_time_seconds", "event_time_nanos", "ingest_time_seconds", "ingest_time_nanos",
    "ocsf_version", "class_uid", "category_uid", "activity_id", "severity", "activity_name",
    "status", "user_name", "src_ip", "service_name", "message", "parser_id", "parser_version",
    "mapping_id", "mapping_version", "configuration_hash", "normalization_status",
    "normalized_hash", "execution_mode", "pipeline_version", "normalized_ms", "ocsf_event_json",
    "event_date"]

# Fields searched and matched most, stored as plain columns next to the JSON.
PROMOTED = {"activity_name": "activity_name", "status": "status", "user_name": "user.name",
            "src_ip": "src_endpoint.ip", "service_name": "service.name", "message": "message"}


def normalized_rows(mapped: DataFrame) -> DataFrame:
    """The normalized table: one row per successful derivation.

    A promoted column is set only where the JSON value is a string; other kinds are
    errors that the bounded run finds in the JSON itself.
    """
    ok = mapped.where(F.col("error_code").isNull())
    v = ok.withColumn("_v", F.try_parse_json("ocsf_event_json"))
    v = v.select(*[c for c in v.columns if c not in PROMOTED],
                 *[strict_string(F.col("_v"), path).alias(c) for c, path in PROMOTED.items()])
    return (v.withColumn("event_time_present", F.col("resolved_seconds").isNotNull().cast("int"))
            .withColumn("event_time_seconds", F.coalesce("resolved_seconds", F.lit(0)))
            .withColumn("event_time_nanos", F.coalesce("resolved_nanos", F.lit(0)))
            .withColumn("event_date", F.to_date(F.timestamp_seconds("event_time_seconds")))
            .select(*NORMALIZED_COLUMNS))


def transformation_rows(mapped: DataFrame, component: str = "normalizer") -> DataFrame:
    """Provenance of each derivation: input, output, component, configuration."""
    ok = mapped.where(F.col("error_code").isNull())
    return ok.select(
        id_from_key(F.sha2(F.concat(F.lit("transformation|"), "logical_key"), 256)).alias("transformation_id"),
        F.col("raw_event_id").alias("input_object_id"), F.lit("RawEvent").alias("input_object_type"),
        F.col("normalized_event_id").alias("output_object_id"),
        F.lit("NormalizedEvent").alias("output_object_type"),
        F.concat(F.lit(component + ":"), "mapping_id").alias("component"),
        F.col("mapping_version").alias("component_version"), "configuration_hash",
        F.col("normalized_ms").alias("started_ms"), F.col("normalized_ms").alias("completed_ms"),
        F.lit("SUCCESS").alias("status"), "execution_mode")


def normalized_violation() -> Column:
    return first_failure([
        ("normalized_event_id", is_uuid_v7("normalized_event_id")),
        ("raw_event_id", is_uuid_v7("raw_event_id")),
        ("normalized_at", in_timestamp_range("normalized_at_seconds", "normalized_at_nanos"))])


def transformation_violation() -> Column:
    return first_failure([
        ("transformation_id", is_uuid_v7("transformation_id")),
        ("started_at", in_timestamp_range("started_at_seconds", F.lit(0))),
        ("completed_at", in_timestamp_range("completed_at_seconds", F.lit(0))),
        ("status", F.col("status").isin("SUCCESS", "FAILED")),
        ("execution_mode", F.col("execution_mode").isin(*MODE_CODES)),
        ("error", (F.col("status") != "FAILED") | F.col("error").isNotNull())])


# --- history ---------------------------------------------------------------

def current_derivation(normalized: DataFrame, mode: str = "LIVE") -> DataFrame:
    """Newest derivation per raw event in one mode.

    ``max_by`` combines map-side, so many derivations of one event cost one
    row per task.
    """
    rest = [c for c in normalized.columns if c != "raw_event_id"]
    newest = F.max_by(F.struct(*rest), F.struct(
        F.col("parser_version").try_cast("long"), F.col("mapping_version").try_cast("long"),
        F.col("logical_key")))
    return (normalized.where(F.col("execution_mode") == mode)
            .groupBy("raw_event_id").agg(newest.alias("_n")).select("raw_event_id", "_n.*"))


def derivation_history(normalized: DataFrame) -> DataFrame:
    """How often and under which versions each raw event was derived.

    Distinct (version, mode) pairs are combined before they are listed, so
    the list per event is as long as the number of versions, not of rows.
    """
    pairs = normalized.groupBy("raw_event_id", "parser_version", "execution_mode").agg(
        F.count(F.lit(1)).alias("_n"))
    label = F.concat_ws("/", "parser_version", "execution_mode")
    return pairs.groupBy("raw_event_id").agg(
        F.sum("_n").alias("derivations"),
        F.array_join(F.array_sort(F.collect_list(label)), ",").alias("versions"))
