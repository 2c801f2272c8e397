"""Detection queries: rules, signals, findings."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from siemspark.functions.predicates import rule_errors, rule_predicate
from siemspark.operators import detect as D
from siemspark.operators.events import batch_scan, dedup_events
from siemspark.functions.scalars import millis
from siemspark.plans.fixtures import CTE, with_ctes
from siemspark.plans.registry import query

DAY_MS = 86_400_000
_default = D.RulePack()
# Events are sparse per user in the test tables, so counts and windows are scaled.
PACK = replace(_default,
               threshold=replace(_default.threshold, count=3, window_ms=DAY_MS),
               sequence=replace(_default.sequence, window_ms=DAY_MS))

CTE["live"] = CTE["ne"] + """,
live AS (SELECT * FROM ne WHERE execution_mode = 'LIVE' AND event_time_present = 1)"""

# Signals of all event rules, with their logical keys.
CTE["esig"] = CTE["live"] + """,
esig0 AS (
 SELECT l.*, r.* FROM live l JOIN (VALUES
   ('DET-000101','MEDIUM','Failed login matched'), ('DET-000102','LOW','Successful login matched'),
   ('DET-000103','HIGH','Privilege escalation matched')) r(rule_id, rule_severity, summary)
  ON (r.rule_id = 'DET-000101' AND activity_name = 'Logon' AND status = 'Failure')
  OR (r.rule_id = 'DET-000102' AND activity_name = 'Logon' AND status = 'Success')
  OR (r.rule_id = 'DET-000103' AND activity_name = 'Privilege Escalation')),
esig AS (
 SELECT *, sha256(tenant_id || '|' || rule_id || '|1|1|1|0:1:' || normalized_event_id || ':EVENT_MATCH') AS logical_key
 FROM esig0)"""

CTE["esid"] = CTE["esig"] + """,
esid AS (SELECT *, substr(logical_key,1,8) || '-' || substr(logical_key,9,4) || '-7' || substr(logical_key,13,3)
   || '-8' || substr(logical_key,16,3) || '-' || substr(logical_key,19,12) AS signal_id FROM esig)"""

CTE["thr"] = CTE["live"] + """,
thr0 AS (SELECT tenant_id, user_name, src_ip, normalized_event_id, time_ms,
   lag(time_ms, 2) OVER w AS start_ms, lag(normalized_event_id, 2) OVER w AS id0, lag(normalized_event_id, 1) OVER w AS id1,
   row_number() OVER w AS rn
  FROM live WHERE activity_name = 'Logon' AND status = 'Failure' AND user_name IS NOT NULL
  WINDOW w AS (PARTITION BY tenant_id, user_name, src_ip ORDER BY time_ms, normalized_event_id)),
thr1 AS (SELECT *, min(rn) OVER (PARTITION BY tenant_id, user_name, src_ip) AS first_rn FROM thr0
  WHERE time_ms - start_ms <= 86400000),
thr AS (SELECT tenant_id, user_name, src_ip, id0, id1, normalized_event_id AS id2, start_ms AS first_ms, time_ms AS last_ms,
   sha256(tenant_id || '|DET-000001|1|2|1|0:1:' || id0 || ':THRESHOLD_INPUT|1:1:' || id1 || ':THRESHOLD_INPUT|2:1:'
     || normalized_event_id || ':THRESHOLD_INPUT') AS logical_key
  FROM thr1 WHERE rn = first_rn)"""

# All valid triples; the lexicographically first one per group is the greedy earliest chain.
CTE["seq"] = CTE["esid"] + """,
sg AS (SELECT tenant_id, user_name, rule_id, time_ms AS t, normalized_event_id AS e, signal_id AS s FROM esid
  WHERE user_name IS NOT NULL),
seq0 AS (SELECT a.tenant_id, a.user_name, a.t AS first_ms, c.t AS last_ms, a.s AS s0, b.s AS s1, c.s AS s2,
   row_number() OVER (PARTITION BY a.tenant_id, a.user_name ORDER BY a.t, a.e, b.t, b.e, c.t, c.e) AS rn
  FROM sg a JOIN sg b USING (tenant_id, user_name) JOIN sg c USING (tenant_id, user_name)
  WHERE a.rule_id = 'DET-000101' AND b.rule_id = 'DET-000102' AND c.rule_id = 'DET-000103'
   AND (b.t, b.e) > (a.t, a.e) AND (c.t, c.e) > (b.t, b.e) AND c.t - a.t <= 86400000),
seq AS (SELECT * FROM seq0 WHERE rn = 1)"""


def live(t):
    return (batch_scan(t.normalized_events, None, "LIVE")
            .withColumn("event_time_ms", millis("event_time_seconds", "event_time_nanos")))


def _rule(name, spec, sql):
    @query(name, with_ctes("ne", body=f"SELECT normalized_event_id FROM ne WHERE {sql}"))
    def run(t):
        return t.normalized_events.where(rule_predicate(spec)).select("normalized_event_id")


def _r(op, field, value=None):
    return {"op": op, "field": field, "value": value}


_rule("rule_eq", _r("eq", "user.name", "user3"), "user_name = 'user3'")
_rule("rule_exists", _r("exists", "user.name"), "user_name IS NOT NULL")
_rule("rule_bool", {"and": [_r("eq", "activity_name", "Logon"),
                            {"or": [{"not": _r("eq", "user.name", "user3")},
                                    _r("eq", "status", "Failure")]}]},
      "activity_name = 'Logon' AND (coalesce(user_name <> 'user3', true) OR status = 'Failure')")


@query("rule_ops", with_ctes("ne", body="""
    SELECT normalized_event_id, user_name IS NOT NULL AND user_name <> 'user3' AS ne,
      coalesce(user_name > 'user3', false) AS gt, coalesce(user_name >= 'user3', false) AS gte,
      coalesce(user_name < 'user3', false) AS lt, coalesce(user_name <= 'user3', false) AS lte,
      coalesce(user_name IN ('user1','user3'), false) AS is_in, coalesce(user_name NOT IN ('user1','user3'), false) AS not_in,
      contains(message, ' by user1') AS contains, starts_with(src_ip, '10.0.3') AS starts_with,
      coalesce(ends_with(user_name, '9'), false) AS ends_with,
      coalesce(regexp_matches(user_name, '^user[0-4]+$'), false) AS matches
    FROM ne"""))
def rule_ops(t):
    ops = {"ne": _r("ne", "user.name", "user3"), "gt": _r("gt", "user.name", "user3"),
           "gte": _r("gte", "user.name", "user3"), "lt": _r("lt", "user.name", "user3"),
           "lte": _r("lte", "user.name", "user3"), "is_in": _r("in", "user.name", ["user1", "user3"]),
           "not_in": _r("not_in", "user.name", ["user1", "user3"]),
           "contains": _r("contains", "message", " by user1"),
           "starts_with": _r("starts_with", "src_endpoint.ip", "10.0.3"),
           "ends_with": _r("ends_with", "user.name", "9"),
           "matches": _r("matches", "user.name", "^user[0-4]+$")}
    return t.normalized_events.select(
        "normalized_event_id", *[rule_predicate(p).alias(n) for n, p in ops.items()])


@query("rule_fail_closed", with_ctes("ne", body="""
    SELECT normalized_event_id, CASE event_id % 101 WHEN 3 THEN 'field user.name is not a string'
      ELSE 'field user.name is malformed' END AS error
    FROM ne WHERE event_id % 101 IN (3, 4)"""))
def rule_fail_closed(t):
    """Events on which a rule over user.name must not run."""
    spec = {"and": [_r("eq", "status", "Failure"), _r("eq", "user.name", "user3")]}
    v = t.normalized_events.select("normalized_event_id",
                                   F.try_parse_json("ocsf_event_json").alias("v"))
    return (v.select("normalized_event_id", rule_errors(spec, F.col("v")).alias("error"))
            .where(F.col("error").isNotNull()))


@query("event_signals", with_ctes("esid", body="""
    SELECT signal_id, tenant_id, rule_id, rule_severity AS severity, summary, normalized_event_id AS input_id,
      time_ms AS first_ms, time_ms AS last_ms, 1::BIGINT AS source_count, 1::BIGINT AS event_count, 'ACTIVE' AS status
    FROM esid"""))
def event_signals(t):
    s = D.event_signals(live(t), PACK.events, "LIVE")
    return s.select("signal_id", "tenant_id", "rule_id", "severity", "summary",
                    F.col("inputs")[0]["input_id"].alias("input_id"), "first_ms", "last_ms",
                    "source_count", "event_count", "status")


@query("rule_pack", with_ctes("esig", body="""
    SELECT tenant_id, rule_id, count(*) AS signals, min(time_ms) AS first_ms, max(time_ms) AS last_ms
    FROM esig GROUP BY ALL"""))
def rule_pack(t):
    s = D.event_signals(live(t), PACK.events, "LIVE")
    return s.groupBy("tenant_id", "rule_id").agg(
        F.count(F.lit(1)).alias("signals"), F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"))


@query("threshold", with_ctes("thr", body="""
    SELECT tenant_id, user_name, src_ip, id0 || ',' || id1 || ',' || id2 AS event_ids, first_ms, last_ms FROM thr"""))
def threshold(t):
    rows = live(t).where(rule_predicate(PACK.threshold.predicate))
    m = D.threshold_matches(rows, ["user_name", "src_ip"], 3, DAY_MS)
    return m.withColumn("event_ids", F.array_join("event_ids", ","))


@query("threshold_signals", with_ctes("thr", body="""
    SELECT logical_key, tenant_id, 'DET-000001' AS rule_id, 'HIGH' AS severity, 3::BIGINT AS event_count,
      1::BIGINT AS source_count, first_ms, last_ms, '0=' || id0 || ',1=' || id1 || ',2=' || id2 AS inputs FROM thr"""))
def threshold_signals(t):
    s = D.threshold_signals(live(t), PACK.threshold, "LIVE")
    ordered = F.array_join(F.transform("inputs", lambda i: F.concat(
        i["ordinal"].cast("string"), F.lit("="), i["input_id"])), ",")
    return s.select("logical_key", "tenant_id", "rule_id", "severity", "event_count", "source_count",
                    "first_ms", "last_ms", ordered.alias("inputs"))


def sequence_rows(t):
    return D.event_signals(live(t), PACK.events, "LIVE", extra=["user_name", "normalized_event_id"])


@query("sequence", with_ctes("seq", body="""
    SELECT tenant_id, user_name, s0 || ',' || s1 || ',' || s2 AS input_ids, first_ms AS start_ms, last_ms AS end_ms FROM seq"""))
def sequence(t):
    rows = sequence_rows(t)
    stages = [F.col("rule_id") == s for s in PACK.sequence.stages]
    m = D.sequence_matches(
        rows.withColumn("_o", F.concat_ws("/", "normalized_event_id", "signal_id")),
        ["user_name"], stages, DAY_MS, "first_ms", "_o")
    ids = F.array_join(F.transform("input_ids", lambda x: F.substring_index(x, "/", -1)), ",")
    return m.withColumn("input_ids", ids)


@query("sequence_input", with_ctes("esid", body="""
    SELECT signal_id, rule_id, user_name, time_ms FROM esid WHERE user_name IS NOT NULL"""))
def sequence_input(t):
    """Signals -> the user of their input event, by a lookup join."""
    events = live(t)
    signals = dedup_events(
        D.event_signals(events, PACK.events, "LIVE").select("signal_id", "rule_id", "first_ms", "inputs"),
        "signal_id")
    inputs = signals.select("signal_id", "rule_id", F.col("first_ms").alias("time_ms"),
                            F.col("inputs")[0]["input_id"].alias("normalized_event_id"))
    users = events.where(F.col("user_name").isNotNull()).select("normalized_event_id", "user_name")
    return inputs.join(users, "normalized_event_id").select("signal_id", "rule_id", "user_name", "time_ms")


@query("findings", with_ctes("seq", body="""
    SELECT tenant_id, 'CORRELATION' AS finding_type, 'OPEN' AS status, 'UNDETERMINED' AS disposition,
      first_ms, last_ms, 'COR-0003' AS correlation_rule_id, '2' AS correlation_rule_version,
      s0 || ',' || s1 || ',' || s2 AS input_ids FROM seq"""))
def findings(t):
    f = D.sequence_findings(sequence_rows(t), PACK.sequence, "LIVE", "normalized_event_id")
    return f.select("tenant_id", "finding_type", "status", "disposition", "first_ms", "last_ms",
                    "correlation_rule_id", "correlation_rule_version",
                    F.array_join("input_ids", ",").alias("input_ids"))


@query("signal_logical_key", with_ctes("esig", body="""
    SELECT normalized_event_id, rule_id, logical_key FROM esig"""))
def signal_logical_key(t):
    s = D.event_signals(live(t), PACK.events, "LIVE", extra=["normalized_event_id"])
    return s.select("normalized_event_id", "rule_id", "logical_key")


@query("finding_logical_key", with_ctes("seq", body="""
    SELECT tenant_id, first_ms, sha256(tenant_id || '|COR-0003|2|1|' || sha256('account-compromise-sequence-v1')
      || '|' || s0 || '|' || s1 || '|' || s2) AS logical_key FROM seq"""))
def finding_logical_key(t):
    f = D.sequence_findings(sequence_rows(t), PACK.sequence, "LIVE", "normalized_event_id")
    return f.select("tenant_id", "first_ms", "logical_key")


_RUN_SQL = """f AS (SELECT tenant_id, 'FINDING' AS kind, 'COR-0003' AS rule_id, first_ms, last_ms,
      s0 || ',' || s1 || ',' || s2 AS inputs,
      sha256(tenant_id || '|COR-0003|2|1|' || sha256('account-compromise-sequence-v1') || '|' || s0 || '|' || s1 || '|' || s2) AS logical_key FROM seq),
    th AS (SELECT * FROM thr)
    SELECT kind, tenant_id, rule_id, first_ms, last_ms, inputs, logical_key FROM f
    UNION ALL SELECT 'SIGNAL', tenant_id, rule_id, time_ms, time_ms, normalized_event_id, logical_key FROM esid
    UNION ALL SELECT 'SIGNAL', tenant_id, 'DET-000001', first_ms, last_ms, id0 || ',' || id1 || ',' || id2, logical_key FROM th"""


# Events whose JSON breaks a rule's field: a number or scalar as user, a time that is no whole number.
_SOUND = "event_time_present = 1 AND event_id % 101 NOT IN (3, 4, 6, 7) AND tenant_id = 'tenant-1' AND time_ms BETWEEN 0 AND 4102444800000)"


@query("detect_run", ("WITH " + CTE["seq"] + ", " + CTE["thr"][len(CTE["live"]) + 1:].strip() + ",\n" + _RUN_SQL)
       .replace("event_time_present = 1)", _SOUND, 1))
def detect_run(t):
    """The bounded run of one tenant over twice delivered events; unsound events are set aside."""
    run = D.detect(t.delivered_events, PACK, "LIVE", "tenant-1", 0, 4_102_444_800_000, on_error="quarantine")
    signals = run.signals.select(
        F.lit("SIGNAL").alias("kind"), "tenant_id", "rule_id", "first_ms", "last_ms",
        F.array_join(F.transform("inputs", lambda i: i["input_id"]), ",").alias("inputs"), "logical_key")
    found = run.findings.select(
        F.lit("FINDING").alias("kind"), "tenant_id", F.col("correlation_rule_id").alias("rule_id"),
        "first_ms", "last_ms", F.array_join("input_ids", ",").alias("inputs"), "logical_key")
    return signals.unionByName(found)


# Technique attached to the shipped burst rule.
ATTACK = [("DET-000001", "1", "T1110", "Brute Force")]


@query("signals_attack", with_ctes("thr", body="""
    SELECT tenant_id, logical_key, 'T1110' AS technique_id, 'Brute Force' AS technique FROM thr"""))
def signals_attack(t):
    table = t.spark.createDataFrame(ATTACK, "rule_id string, rule_version string, technique_id string, technique string")
    s = D.threshold_signals(live(t), PACK.threshold, "LIVE")
    return (s.join(F.broadcast(table), ["rule_id", "rule_version"])
            .select("tenant_id", "logical_key", "technique_id", "technique"))
