"""Detection: per-event rules, count thresholds and ordered sequences."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siemspark.functions.scalars import (INPUT_TYPE_CODES, MODE_CODES, RULE_TYPE_CODES, enum_code,
                                         floor_div, millis)
from siemspark.operators.ordered import CHUNK, backwards, in_chunks, later_chunks, with_carry
from siemspark.session import cut_lineage

# How many window lengths one bucket of a split group spans.
BUCKET_WINDOWS = 8
# Up to this rank Spark limits window groups before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
MAP_SIDE_RANK = 1_000
RANK_PARTS = 64


# --- count threshold -------------------------------------------------------

def threshold_matches(events: DataFrame, group_by: Sequence[str], count: int, window_ms: int,
                      time_ms: str = "event_time_ms", id_col: str = "normalized_event_id",
                      tenant: str = "tenant_id") -> DataFrame:
    """Earliest run of ``count`` events within ``window_ms``, one per group.

    Events are ordered by (time, id); the window is closed; rows lacking a
    key or a time are left out.  ``events`` must hold each id once.

    A group is never handled as a whole, so a key with most of the rows does
    not land in one task:

    * time is cut into slices of one window.  Once a slice holds ``count``
      rows the run is complete, so later rows of that slice cannot end the
      earliest run.  The rank filter is applied map-side before the shuffle; where
      Spark does not do so, above ``MAP_SIDE_RANK``, parts of a slice are ranked first.
    * slices are joined into buckets; the last slice of a bucket is also sent
      to the next one, which is all that a run ending there can reach back to.
    """
    check_threshold_args(group_by, count, window_ms)
    keys = [tenant, *group_by]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, time_ms, id_col]])
    rows = (events.where(known)
            .select(*keys, F.col(id_col).alias("_id"), F.col(time_ms).cast("long").alias("_t"))
            .withColumn("_slice", floor_div("_t", window_ms)))
    if count > MAP_SIDE_RANK:
        # Each of the parts of a slice keeps its first rows, so the slice itself is bounded.
        part = Window.partitionBy(*keys, "_slice", "_part").orderBy("_t", "_id")
        rows = (rows.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(RANK_PARTS)))
                .withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= count).drop("_part", "_n"))
    in_slice = Window.partitionBy(*keys, "_slice").orderBy("_t", "_id")
    rows = rows.withColumn("_n", F.row_number().over(in_slice)).where(F.col("_n") <= count)

    bucket = floor_div("_slice", BUCKET_WINDOWS)
    last_slice = F.pmod(F.col("_slice"), F.lit(BUCKET_WINDOWS)) == BUCKET_WINDOWS - 1
    rows = (rows.withColumn("_home", bucket)
            .withColumn("_bucket", F.explode(
                F.when(last_slice, F.array(bucket, bucket + 1)).otherwise(F.array(bucket)))))
    in_bucket = Window.partitionBy(*keys, "_bucket")
    ordered = in_bucket.orderBy("_t", "_id")
    hit = (F.col("_home") == F.col("_bucket")) & (F.col("_t") - F.col("_start") <= window_ms)
    rows = (rows.withColumn("_rank", F.row_number().over(ordered))
            .withColumn("_start", F.lag("_t", count - 1).over(ordered) if count > 1 else F.col("_t"))
            .withColumn("_hit", F.min(F.when(hit, F.col("_rank"))).over(in_bucket))
            # Only the run that ends at a bucket's first hit is gathered.
            .where(F.col("_rank").between(F.col("_hit") - (count - 1), F.col("_hit"))))
    runs = rows.groupBy(*keys, "_bucket").agg(F.array_sort(F.collect_list(F.struct("_t", "_id"))).alias("_run"))
    first = F.min_by("_run", F.element_at("_run", -1))
    return (runs.groupBy(*keys).agg(first.alias("_m"))
            .select(*keys, F.col("_m._id").alias("event_ids"),
                    F.col("_m")[0]["_t"].alias("first_ms"), F.element_at("_m", -1)["_t"].alias("last_ms")))


def check_threshold_args(group_by, count, window_ms, late_policy: str = "ACCEPT") -> None:
    if not group_by or len(set(group_by)) != len(list(group_by)):
        raise ValueError("group_by must name distinct fields")
    if count <= 0:
        raise ValueError("threshold must be greater than zero")
    if window_ms <= 0:
        raise ValueError("window must be greater than zero")
    if late_policy != "ACCEPT":
        raise ValueError("a batch threshold accepts late events; use the streaming form otherwise")


# --- ordered sequence ------------------------------------------------------

def sequence_matches(rows: DataFrame, join_keys: Sequence[str], stages: Sequence[Column],
                     window_ms: int, time_ms: str = "time_ms", id_col: str = "signal_id",
                     tenant: str = "tenant_id") -> DataFrame:
    """Earliest chain of one row per stage, in order, spanning <= ``window_ms``.

    Rows are ordered by (time, id).  From a start row every next stage takes
    the first later row of that stage; because order starts with time this
    also gives the shortest span for that start, so the earliest start whose
    chain fits is the answer.  One chain per group.

    A group is cut into chunks of its ordered rows, however its times lie.  In a chunk
    every row gets the chain that starts there as far as the chunk goes.  The summary of
    a chunk is the chain from its first row of each stage; scanned from the last chunk to
    the first these give, for each chunk and stage, how a chain that still needs that
    stage goes on behind the chunk.
    """
    if len(stages) < 2:
        raise ValueError("a sequence needs at least two stages")
    if window_ms <= 0 or not join_keys:
        raise ValueError("a sequence needs a window and join keys")
    keys, order, last = [tenant, *join_keys], ["_t", "_id"], len(stages)
    flags = [f"_s{i}" for i in range(last)]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, time_ms, id_col]])
    src = (rows.where(known & reduce(lambda a, b: a | b, stages))
           .select(*keys, F.col(id_col).alias("_id"), F.col(time_ms).cast("long").alias("_t"),
                   *[F.coalesce(s, F.lit(False)).alias(n) for s, n in zip(stages, flags)]))
    src = in_chunks(src, keys, order, "sequence")

    def chain(ids, end, need):
        return F.struct(ids.alias("ids"), end.alias("end"), need.alias("need"))

    # From the last stage to the first: the row and the next stage's nearest later chain.
    later = backwards(keys, order)
    for n in reversed(range(last)):
        here = chain(F.array("_id"), F.col("_t"), F.lit(n + 1))
        if n < last - 1:
            src = src.withColumn("_next", F.last(f"_p{n + 1}", ignorenulls=True).over(later))
            here = F.when(F.col("_next").isNull(), here).otherwise(
                chain(F.concat(F.array("_id"), F.col("_next.ids")), F.col("_next.end"), F.col("_next.need")))
        src = src.withColumn(f"_p{n}", F.when(F.col(flags[n]), here))

    def completed(partial, carried):
        """The chain with what is carried for the stage it needs; null if that does not exist."""
        out = F.when(partial["need"] == last, partial)
        for n, rest in carried.items():
            out = out.when((partial["need"] == n) & rest.isNotNull(),
                           chain(F.concat(partial["ids"], rest["ids"]), rest["end"], F.lit(last)))
        return out

    first = [F.min_by(f"_p{n}", F.when(F.col(flags[n]), F.struct(*order))).alias(f"_f{n}") for n in range(1, last)]
    carry = src.groupBy(*keys, CHUNK).agg(*first)
    carried = {}
    for n in reversed(range(1, last)):
        carry = (carry.withColumn("_v", completed(F.col(f"_f{n}"), carried))
                 .withColumn(f"_after{n}", F.last("_v", ignorenulls=True).over(later_chunks(keys))).drop("_v", f"_f{n}"))
        carried[n] = F.col(f"_after{n}")
    starts = src.where(F.col(flags[0])).select(*keys, CHUNK, *order, "_p0")
    found = (with_carry(starts, carry, keys).withColumn("_c", completed(F.col("_p0"), carried))
             .where(F.col("_c.end") - F.col("_t") <= window_ms))
    return (found.groupBy(*keys).agg(F.min_by(F.struct("_c", "_t"), F.struct(*order)).alias("_m"))
            .select(*keys, F.col("_m._c.ids").alias("input_ids"),
                    F.col("_m._t").alias("start_ms"), F.col("_m._c.end").alias("end_ms")))


# --- rules -----------------------------------------------------------------

@dataclass(frozen=True)
class EventRule:
    rule_id: str
    predicate: dict
    severity: str
    summary: str
    version: str = "1"
    relation: str = "EVENT_MATCH"


@dataclass(frozen=True)
class ThresholdRule:
    rule_id: str
    predicate: dict
    group_by: tuple[str, ...]
    count: int
    window_ms: int
    severity: str = "HIGH"
    summary: str = "Authentication burst"
    version: str = "1"
    relation: str = "THRESHOLD_INPUT"


@dataclass(frozen=True)
class SequenceRule:
    rule_id: str
    stages: tuple[str, ...]
    join_key: str
    window_ms: int
    severity: str = "HIGH"
    confidence: str = "MEDIUM"
    title: str = "Account compromise sequence"
    description: str = "Failed login followed by successful login and privilege escalation"
    version: str = "2"
    relation: str = "SEQUENCE_INPUT"
    # Title, description and configuration text enter stored findings and their hash.
    configuration: str = "account-compromise-sequence-v1"


@dataclass(frozen=True)
class JoinRule:
    """Events of one predicate that meet events of another, with equal keys and within a window around them."""

    rule_id: str
    left: dict
    right: dict
    join_keys: tuple[str, ...]
    after_ms: int
    before_ms: int = 0


def _eq(name, value):
    return {"op": "eq", "field": name, "value": value}


FAILED_LOGIN = {"and": [_eq("activity_name", "Logon"), _eq("status", "Failure")]}
SUCCESSFUL_LOGIN = {"and": [_eq("activity_name", "Logon"), _eq("status", "Success")]}
PRIVILEGE_ESCALATION = _eq("activity_name", "Privilege Escalation")


@dataclass(frozen=True)
class RulePack:
    """The shipped rules; windows and counts can be scaled to the data."""

    events: tuple[EventRule, ...] = (
        EventRule("DET-000101", FAILED_LOGIN, "MEDIUM", "Failed login matched"),
        EventRule("DET-000102", SUCCESSFUL_LOGIN, "LOW", "Successful login matched"),
        EventRule("DET-000103", PRIVILEGE_ESCALATION, "HIGH", "Privilege escalation matched"),
    )
    threshold: ThresholdRule = field(default_factory=lambda: ThresholdRule(
        "DET-000001", FAILED_LOGIN, ("user_name", "src_ip"), 10, 300_000))
    sequence: SequenceRule = field(default_factory=lambda: SequenceRule(
        "COR-0003", ("DET-000101", "DET-000102", "DET-000103"), "user_name", 600_000))


# --- signals and findings --------------------------------------------------

def signal_logical_key() -> Column:
    """Stable identity of a signal: rule, mode and ordered inputs."""
    head = F.concat_ws("|", "tenant_id", "rule_id", "rule_version",
                       enum_code("rule_type", RULE_TYPE_CODES).cast("string"),
                       enum_code("execution_mode", MODE_CODES).cast("string"))
    types = F.create_map(*[F.lit(x) for kv in INPUT_TYPE_CODES.items() for x in kv])
    parts = F.transform("inputs", lambda i: F.concat_ws(
        ":", i["ordinal"].cast("string"), F.element_at(types, i["input_type"]).cast("string"),
        i["input_id"], i["relation"]))
    return F.sha2(F.concat_ws("|", head, F.array_join(parts, "|")), 256)


def finding_logical_key() -> Column:
    head = F.concat_ws("|", "tenant_id", "correlation_rule_id", "correlation_rule_version",
                       enum_code("execution_mode", MODE_CODES).cast("string"),
                       "configuration_hash")
    return F.sha2(F.concat_ws("|", head, F.array_join("input_ids", "|")), 256)


def id_from_key(key: Column, version: str = "7") -> Column:
    """UUID-shaped id made from a logical key: reruns give the same id."""
    return F.concat(F.substring(key, 1, 8), F.lit("-"), F.substring(key, 9, 4), F.lit("-" + version),
                    F.substring(key, 13, 3), F.lit("-8"), F.substring(key, 16, 3), F.lit("-"),
                    F.substring(key, 19, 12))


def _inputs(ids: Column, relation: str) -> Column:
    return F.transform(ids, lambda x, i: F.struct(
        F.lit("NORMALIZED_EVENT").alias("input_type"), x.alias("input_id"),
        F.lit(relation).alias("relation"), i.cast("int").alias("ordinal")))


_SIGNAL_COLUMNS = ["logical_key", "signal_id", "tenant_id", "rule_id", "rule_version", "rule_type",
                   "severity", "confidence", "status", "first_ms", "last_ms", "execution_mode",
                   "source_count", "event_count", "summary", "evaluated_ms", "inputs"]


def _as_signals(df: DataFrame, rule_type: str, mode: str, evaluated_ms: int,
                extra: Sequence[str] = ()) -> DataFrame:
    return (df.withColumn("rule_type", F.lit(rule_type))
            .withColumn("execution_mode", F.lit(mode))
            .withColumn("confidence", F.lit(None).cast("string"))
            .withColumn("status", F.lit("ACTIVE"))
            .withColumn("source_count", F.lit(1).cast("long"))
            .withColumn("event_count", F.size("inputs").cast("long"))
            .withColumn("evaluated_ms", F.lit(evaluated_ms).cast("long"))
            .withColumn("logical_key", signal_logical_key())
            .withColumn("signal_id", id_from_key(F.col("logical_key")))
            .select(*_SIGNAL_COLUMNS, *extra))


def event_signals(events: DataFrame, rules: Sequence[EventRule], mode: str, evaluated_ms: int = 0,
                  extra: Sequence[str] = ()) -> DataFrame:
    """One signal per (event, matching rule), all rules in a single pass."""
    from siemspark.functions.predicates import rule_predicate

    hits = F.array(*[
        F.when(rule_predicate(r.predicate), F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.version).alias("rule_version"),
            F.lit(r.severity).alias("severity"), F.lit(r.summary).alias("summary"),
            F.lit(r.relation).alias("relation")))
        for r in rules])
    any_rule = reduce(lambda a, b: a | b, [rule_predicate(r.predicate) for r in rules])
    time = F.when(F.col("event_time_present") == 1, millis("event_time_seconds", "event_time_nanos"))
    matched = (events.where(any_rule).withColumn("_r", F.explode(hits)).where(F.col("_r").isNotNull())
               .select("tenant_id", "normalized_event_id", *extra, "_r.*",
                       time.alias("first_ms"), time.alias("last_ms")))
    one = F.array(F.struct(F.lit("NORMALIZED_EVENT").alias("input_type"),
                           F.col("normalized_event_id").alias("input_id"),
                           F.col("relation"), F.lit(0).alias("ordinal")))
    return _as_signals(matched.withColumn("inputs", one), "EVENT", mode, evaluated_ms, extra)


def threshold_signals(events: DataFrame, rule: ThresholdRule, mode: str,
                      evaluated_ms: int = 0, time_ms: str = "event_time_ms") -> DataFrame:
    from siemspark.functions.predicates import rule_predicate

    matches = threshold_matches(events.where(rule_predicate(rule.predicate)), rule.group_by,
                                rule.count, rule.window_ms, time_ms)
    rows = (matches.withColumn("rule_id", F.lit(rule.rule_id))
            .withColumn("rule_version", F.lit(rule.version))
            .withColumn("severity", F.lit(rule.severity))
            .withColumn("summary", F.lit(rule.summary))
            .withColumn("inputs", _inputs(F.col("event_ids"), rule.relation)))
    return _as_signals(rows, "THRESHOLD", mode, evaluated_ms)


_FINDING_COLUMNS = ["logical_key", "finding_id", "tenant_id", "finding_type", "status", "severity",
                    "confidence", "title", "description", "first_ms", "last_ms",
                    "correlation_rule_id", "correlation_rule_version", "disposition",
                    "execution_mode", "configuration_hash", "input_ids", "inputs"]


def sequence_input(signals: DataFrame, mode: str, on_conflict: str = "raise") -> DataFrame:
    """Signals by id, once each; another mode than the run's or a differing copy fails the job."""
    from siemspark.operators.events import dedup_events

    if "execution_mode" in signals.columns:
        message = F.concat(F.lit(f"signal of another mode than {mode}: "), F.col("signal_id"))
        other = F.coalesce(F.col("execution_mode") != mode, F.lit(True))
        signals = signals.withColumn("signal_id", F.when(other, F.raise_error(message)).otherwise(F.col("signal_id")))
    return dedup_events(signals, "signal_id", on_conflict)


def sequence_findings(signals: DataFrame, rule: SequenceRule, mode: str,
                      order_id: str = "signal_id", checked: bool = False) -> DataFrame:
    """Findings from EVENT signals that carry the join key column.

    ``order_id`` breaks ties of equal times; the ids listed in the finding
    are signal ids.  ``checked`` says that the caller has made the signals in this
    very run, from events without repeats, so ids and mode hold already.
    """
    if not checked:
        need = dict.fromkeys(["signal_id", order_id, "tenant_id", "rule_id", "first_ms", rule.join_key])
        if "execution_mode" in signals.columns:
            need["execution_mode"] = None
        signals = sequence_input(signals.select(*need), mode)
    stages = [F.col("rule_id") == s for s in rule.stages]
    tie = F.concat_ws("\u0001", F.col(order_id), F.col("signal_id"))
    matches = sequence_matches(signals.withColumn("_order", tie), [rule.join_key], stages,
                               rule.window_ms, "first_ms", "_order")
    ids = F.transform("input_ids", lambda x: F.substring_index(x, "\u0001", -1))
    return (matches.withColumn("input_ids", ids)
            .withColumn("correlation_rule_id", F.lit(rule.rule_id))
            .withColumn("correlation_rule_version", F.lit(rule.version))
            .withColumn("execution_mode", F.lit(mode))
            .withColumn("configuration_hash", F.sha2(F.lit(rule.configuration), 256))
            .withColumn("logical_key", finding_logical_key())
            .withColumn("finding_id", id_from_key(F.col("logical_key")))
            .withColumn("inputs", F.transform("input_ids", lambda x: F.struct(
                F.lit("SIGNAL").alias("input_type"), x.alias("input_id"),
                F.lit(rule.relation).alias("relation"))))
            .select(F.col("logical_key"), "finding_id", "tenant_id",
                    F.lit("CORRELATION").alias("finding_type"), F.lit("OPEN").alias("status"),
                    F.lit(rule.severity).alias("severity"),
                    F.lit(rule.confidence).alias("confidence"), F.lit(rule.title).alias("title"),
                    F.lit(rule.description).alias("description"),
                    F.col("start_ms").alias("first_ms"), F.col("end_ms").alias("last_ms"),
                    "correlation_rule_id", "correlation_rule_version",
                    F.lit("UNDETERMINED").alias("disposition"), "execution_mode",
                    "configuration_hash", "input_ids", "inputs")
            .select(*_FINDING_COLUMNS))


@dataclass(frozen=True)
class DetectionRun:
    events: DataFrame
    signals: DataFrame
    findings: DataFrame
    rejected: DataFrame | None = None


def event_error(json: Column, columns: Sequence[str]) -> Column:
    """Why the run cannot use an event: a field of its rules that is no text, or a time that is no whole number."""
    from siemspark.functions.fields import number_field_error, string_field_error
    from siemspark.operators.normalize import PROMOTED

    def error(v: Column) -> Column:
        checks = [string_field_error(v, PROMOTED[c]) for c in dict.fromkeys(columns) if c in PROMOTED]
        return F.when(v.isNull(), "event is no JSON").otherwise(F.coalesce(*checks, number_field_error(v, "time")))

    # The lambda's argument is parsed once, however often the checks look at it.
    return F.transform(F.array(F.try_parse_json(json)), error)[0]


def detect(events: DataFrame, pack: RulePack, mode: str, tenant_id: str | None = None,
           start_ms: int | None = None, end_ms: int | None = None,
           evaluated_ms: int = 0, on_conflict: str = "raise", on_error: str = "raise") -> DetectionRun:
    """Scan, remove repeats, run all rules: the bounded detection run.

    Where the events carry their JSON, a field that a rule reads must be text or
    unset and the time a whole number.  Other events fail the job (``raise``) or go
    to ``rejected`` with the reason (``quarantine``), never into the rules.
    """
    from siemspark.functions.predicates import rule_fields
    from siemspark.operators.events import batch_scan, dedup_events

    if on_error not in ("raise", "quarantine"):
        raise ValueError("on_error must be 'raise' or 'quarantine'")
    scanned, rejected = batch_scan(events, tenant_id, mode, start_ms, end_ms), None
    if "ocsf_event_json" in events.columns:
        read = [f for r in (*pack.events, pack.threshold) for f in rule_fields(r.predicate)]
        scanned = scanned.withColumn("_error", event_error(
            F.col("ocsf_event_json"), [*read, *pack.threshold.group_by, pack.sequence.join_key]))
        if on_error == "quarantine":
            rejected = scanned.where(F.col("_error").isNotNull()).select("tenant_id", "normalized_event_id",
                                                                         F.col("_error").alias("error"))
            scanned = scanned.where(F.col("_error").isNull())
        else:
            message = F.concat("normalized_event_id", F.lit(": "), "_error")
            scanned = scanned.withColumn("normalized_event_id", F.when(
                F.col("_error").isNotNull(), F.raise_error(message)).otherwise(F.col("normalized_event_id")))
    need = ["tenant_id", "normalized_event_id", "event_time_present", "event_time_seconds",
            "event_time_nanos", "activity_name", "status", *pack.threshold.group_by]
    loaded = dedup_events(scanned.select(*dict.fromkeys(need + [pack.sequence.join_key])),
                          on_conflict=on_conflict)
    # Written once: signals, bursts and sequences all read it.
    loaded = cut_lineage(loaded.withColumn("event_time_ms", millis("event_time_seconds", "event_time_nanos")), "loaded")
    per_event = event_signals(loaded, pack.events, mode, evaluated_ms,
                              extra=[pack.sequence.join_key, "normalized_event_id"])
    bursts = threshold_signals(loaded, pack.threshold, mode, evaluated_ms)
    findings = sequence_findings(per_event, pack.sequence, mode, "normalized_event_id", checked=True)
    signals = per_event.select(*bursts.columns).unionByName(bursts)
    return DetectionRun(loaded, signals, findings, rejected)


# --- further rule kinds ----------------------------------------------------

def aggregation_rule(events: DataFrame, group_by: Sequence[str], window_ms: int, minimum: int,
                     time_ms: str = "event_time_ms") -> DataFrame:
    """Groups with at least ``minimum`` events in a tumbling window."""
    start = floor_div(time_ms, window_ms) * window_ms
    return (events.groupBy(*group_by, start.alias("window_start_ms"))
            .agg(F.count(F.lit(1)).alias("events"), F.min(time_ms).alias("first_ms"),
                 F.max(time_ms).alias("last_ms"))
            .where(F.col("events") >= minimum))


def absence_rule(triggers: DataFrame, expected: DataFrame, keys: Sequence[str], window_ms: int,
                 time_ms: str = "event_time_ms", id_col: str = "normalized_event_id") -> DataFrame:
    """Trigger events not followed by an expected event within ``window_ms``.

    An expected event at the trigger's own time follows it.  Rows lacking a key or a
    time are left out.  Both sides are merged and cut into chunks of a key's
    ordered rows; the next expected time is a running minimum inside the chunk or,
    behind its last expected event, the first one of a later chunk.
    """
    keys, order = list(keys), ["_t", "_kind", "_id"]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, time_ms]])

    def side(df, kind):
        return df.where(known).select(*keys, F.col(id_col).alias("_id"), F.col(time_ms).cast("long").alias("_t"),
                                      F.lit(kind).alias("_kind"))

    rows = in_chunks(side(triggers, 0).unionByName(side(expected, 1)), keys, order, "absence")
    time = F.when(F.col("_kind") == 1, F.col("_t"))
    carry = (rows.groupBy(*keys, CHUNK).agg(F.min(time).alias("_first"))
             .withColumn("_behind", F.min("_first").over(later_chunks(keys))).drop("_first"))
    inside = rows.withColumn("_next", F.min(time).over(backwards(keys, order))).where(F.col("_kind") == 0)
    found = with_carry(inside, carry, keys).withColumn("_next", F.coalesce("_next", "_behind"))
    return (found.where(F.col("_next").isNull() | (F.col("_next") - F.col("_t") > window_ms))
            .select(*keys, F.col("_id").alias(id_col), F.col("_t").alias(time_ms)))


def join_rule(left: DataFrame, right: DataFrame, keys: Sequence[str], after_ms: int, before_ms: int = 0,
              time_ms: str = "event_time_ms", id_col: str = "normalized_event_id") -> DataFrame:
    """Left events that meet right events of the same keys from ``before_ms`` before to ``after_ms`` after them.

    One row per left event with a match: its id and time, the number of matches and the first one by (time, id).
    Both ends belong to the window.  Rows lacking a key, an id or a time are left out; each
    side must hold an id once.

    No pair is made.  A left event asks at both ends of its window how many right events
    come later; the difference is the number of matches, and the first that comes
    after its beginning is the first match.  Questions and right events are merged and cut into
    chunks of a key's ordered rows, which carry the count and first right event of the chunks behind.
    """
    if after_ms < 0 or before_ms < 0 or not keys:
        raise ValueError("a join rule needs keys and a window")
    keys, order = list(keys), ["_t", "_kind", "_id"]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, time_ms, id_col]])

    def side(df, *ends):
        """``ends``: (kind, shift of the time)."""
        t = F.col(time_ms).cast("long")
        places = F.array(*[F.struct(F.lit(k).alias("_kind"), (t + F.lit(ms).cast("long")).alias("_t")) for k, ms in ends])
        return df.where(known).select(*keys, F.col(id_col).alias("_id"), t.alias("_own"), F.inline(places))

    # Kinds order equal times: a window's beginning, right events, a window's end.
    rows = side(left, (0, -before_ms), (2, after_ms)).unionByName(side(right, (1, 0)))
    rows = in_chunks(rows, keys, order, "join-rule")
    is_right = F.col("_kind") == 1
    event = F.when(is_right, F.struct("_t", "_id"))
    carry = rows.groupBy(*keys, CHUNK).agg(F.sum(is_right.cast("long")).alias("_n"), F.min(event).alias("_first"))
    behind = later_chunks(keys)
    carry = (carry.withColumn("_count_behind", F.sum("_n").over(behind))
             .withColumn("_next_behind", F.last("_first", ignorenulls=True).over(behind)).drop("_n", "_first"))
    later = backwards(keys, order)
    asked = (rows.withColumn("_count", F.sum(is_right.cast("long")).over(later))
             .withColumn("_next", F.last(event, ignorenulls=True).over(later)).where(~is_right))
    asked = with_carry(asked, carry, keys)
    count = F.coalesce("_count", F.lit(0)) + F.coalesce("_count_behind", F.lit(0))
    begins = F.col("_kind") == 0
    found = (asked.groupBy(*keys, "_id", "_own")
             .agg((F.max(F.when(begins, count)) - F.max(F.when(~begins, count))).alias("matches"),
                  F.max(F.when(begins, F.coalesce("_next", "_next_behind"))).alias("_m"))
             .where(F.col("matches") > 0))
    return found.select(*keys, F.col("_id").alias(id_col), F.col("_own").alias(time_ms), "matches",
                        F.col("_m._id").alias("first_match_id"), F.col("_m._t").alias("first_match_ms"))


def join_matches(events: DataFrame, rule: JoinRule, time_ms: str = "event_time_ms") -> DataFrame:
    """``join_rule`` over events of one table, with the rule's predicates; tenants never mix."""
    from siemspark.functions.predicates import rule_predicate

    left, right = (events.where(rule_predicate(p)) for p in (rule.left, rule.right))
    found = join_rule(left, right, ["tenant_id", *rule.join_keys], rule.after_ms, rule.before_ms, time_ms)
    return found.withColumn("rule_id", F.lit(rule.rule_id))
