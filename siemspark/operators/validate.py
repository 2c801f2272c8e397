"""Contract checks of signals, findings and the rule table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siemspark.functions.scalars import (INPUT_TYPE_CODES, MODES, RULE_TYPE_CODES, col, first_failure,
                                         has_text, is_uuid_v7)

# Closed sets of the contracts.
SIGNAL_STATUSES = ("ACTIVE", "SUPPRESSED", "PROMOTED", "INVALIDATED")
FINDING_TYPES = ("DETECTION", "THRESHOLD", "CORRELATION", "ANALYTICAL")
FINDING_STATUSES = ("OPEN", "ACKNOWLEDGED", "SUPPRESSED", "RESOLVED", "INVALIDATED")
FINDING_DISPOSITIONS = ("UNDETERMINED", "TRUE_POSITIVE", "BENIGN_TRUE_POSITIVE", "FALSE_POSITIVE",
                        "DUPLICATE", "TEST_ACTIVITY")
RULE_STATUSES = ("EXPERIMENTAL", "TESTING", "STABLE", "DEPRECATED", "DISABLED")
COVERAGE = ("positive", "negative", "edge_cases")
# Milliseconds of the allowed timestamp range.
MIN_MS, MAX_MS = -62_135_596_800_000, 253_402_300_799_999


def rule_id_ok(c, prefix: str = "DET") -> Column:
    return F.coalesce(col(c).rlike(f"^{prefix}-[0-9]{{6}}$"), F.lit(False))


def _time(c) -> Column:
    return col(c).between(MIN_MS, MAX_MS)


def _pair(a, b) -> Column:
    return col(a).isNull() == col(b).isNull()


def _optional_text(c) -> Column:
    return col(c).isNull() | has_text(c)


def _distinct(array: Column) -> Column:
    return F.size(F.array_distinct(array)) == F.size(array)


def signal_violation(rule_prefix: str = "DET") -> Column:
    """First broken rule of a signal row with nested ``inputs``."""
    inputs = F.col("inputs")
    events = F.size(F.filter(inputs, lambda i: i["input_type"] == "NORMALIZED_EVENT"))
    kind, n = F.col("rule_type"), F.col("event_count")
    input_ok = F.forall(inputs, lambda i: i["input_type"].isin(*INPUT_TYPE_CODES) & is_uuid_v7(i["input_id"])
                        & has_text(i["relation"]))
    ordinals = F.transform(inputs, lambda i: i["ordinal"])
    positions = F.transform(inputs, lambda i, at: at)
    pairs = F.transform(inputs, lambda i: F.struct(i["input_type"], i["input_id"]))
    return first_failure([
        ("signal_id", is_uuid_v7("signal_id")), ("tenant_id", is_uuid_v7("tenant_id")),
        ("rule_id", rule_id_ok("rule_id", rule_prefix)), ("rule_version", has_text("rule_version")),
        ("rule_type", kind.isin(*RULE_TYPE_CODES)), ("severity", has_text("severity")),
        ("confidence", _optional_text("confidence")), ("status", F.col("status").isin(*SIGNAL_STATUSES)),
        ("execution_mode", F.col("execution_mode").isin(*MODES)),
        ("observed_pair", _pair("first_ms", "last_ms")),
        ("observed_range", F.col("first_ms").isNull() | (_time("first_ms") & _time("last_ms"))),
        ("observed_order", F.col("first_ms").isNull() | (F.col("first_ms") <= F.col("last_ms"))),
        ("source_count", F.col("source_count") > 0), ("event_count", n > 0), ("summary", has_text("summary")),
        ("evaluated_at", _time("evaluated_ms")), ("inputs", F.size(inputs) > 0), ("input", input_ok),
        ("ordinal", ordinals == positions), ("duplicate_input", _distinct(pairs)),
        ("rule_counts", F.when(kind == "EVENT", (events == 1) & (n == 1))
         .when(kind == "THRESHOLD", (events > 0) & (events == n)).otherwise(True)),
        ("source_over_events", (kind == "CORRELATION") | (F.col("source_count") <= n)),
    ])


def finding_violation() -> Column:
    """First broken rule of a finding row.

    Correlation findings carry ``input_ids`` (provenance) that must be backed
    by ``inputs``; other types must not carry them.
    """
    inputs, kind = F.col("inputs"), F.col("finding_type")
    ids = F.col("input_ids")
    backed = F.size(F.array_except(ids, F.transform(inputs, lambda i: i["input_id"]))) == 0
    relations = F.transform(inputs, lambda i: F.struct(i["input_type"], i["input_id"], i["relation"]))
    input_ok = F.forall(inputs, lambda i: has_text(i["input_type"]) & is_uuid_v7(i["input_id"])
                        & has_text(i["relation"]))
    linked = kind == "CORRELATION"
    return first_failure([
        ("finding_id", is_uuid_v7("finding_id")), ("tenant_id", is_uuid_v7("tenant_id")),
        ("finding_type", kind.isin(*FINDING_TYPES)), ("status", F.col("status").isin(*FINDING_STATUSES)),
        ("severity", has_text("severity")), ("confidence", _optional_text("confidence")),
        ("title", has_text("title")), ("description", has_text("description")),
        ("seen_pair", _pair("first_ms", "last_ms")),
        ("seen_order", F.col("first_ms").isNull() | (F.col("first_ms") <= F.col("last_ms"))),
        ("correlation_pair", _pair("correlation_rule_id", "correlation_rule_version")),
        ("disposition", F.col("disposition").isin(*FINDING_DISPOSITIONS)),
        ("execution_mode", F.col("execution_mode").isin(*MODES)),
        ("inputs", F.size(inputs) > 0), ("input", input_ok), ("duplicate_input", _distinct(relations)),
        ("provenance_only_for_correlation", linked | ids.isNull()),
        ("correlation_rule", ~linked | F.col("correlation_rule_id").isNotNull()),
        ("provenance_ids", ~linked | (F.size(ids) > 0)),
        ("provenance_unique", ~linked | _distinct(ids)), ("provenance_backed", ~linked | backed),
        ("configuration_hash", ~linked | has_text("configuration_hash")),
    ])


def rule_gate(rules: DataFrame, coverage: DataFrame, prefix: str = "DET") -> DataFrame:
    """Rules (rule_id, status) against their tests (rule_id, kind): why one may not run."""
    kinds = (coverage.where(F.col("kind").isin(*COVERAGE)).groupBy("rule_id")
             .agg(F.count_distinct("kind").alias("_kinds")))
    full = F.coalesce(F.col("_kinds"), F.lit(0)) == len(COVERAGE)
    reason = (F.when(~rule_id_ok("rule_id", prefix), "rule id format")
              .when(~F.coalesce(F.col("status").isin(*RULE_STATUSES), F.lit(False)), "unknown status")
              .when((F.col("status") == "STABLE") & ~full, "stable rule lacks tests"))
    return rules.join(kinds, "rule_id", "left").withColumn("reason", reason).drop("_kinds")
