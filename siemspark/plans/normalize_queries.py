"""Normalization queries: times, mappings, keys, derivation history, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siemspark.functions.text import canonical_json
from siemspark.operators import normalize as N
from siemspark.operators import parse as P
from siemspark.plans.fixtures import CTE, with_ctes
from siemspark.plans.parse_queries import parsed
from siemspark.plans.registry import query
from siemspark.session import cut_lineage, shared_dir
from siemspark.sources import sinks

POLICIES = N.policies_from_spec("source-0=+05:30,source-1=-08:00,source-3=+00:00")
CLOCK_MS = 1_800_000_000_000

# Lines that map: well-formed sshd lines.  Version 2 only changes the message.
CTE["nm"] = CTE["out"] + f""",
nm0 AS (SELECT *, event_id % 18 = 0 AS invalid, 1024 + event_id % 60000 AS port,
  ingest_time_seconds * 1000 + ingest_time_nanos // 1000000 AS logged_ms,
  event_time_seconds * 1000 + event_time_nanos // 1000000 AS declared_ms,
  CASE source_id WHEN 'source-0' THEN '+05:30' WHEN 'source-1' THEN '-08:00' WHEN 'source-3' THEN '+00:00' END AS off
 FROM outcome WHERE parser_id = 'linux/sshd' AND error_code IS NULL),
nm1 AS (SELECT n0.*, v.pv, v.mode,
  '{{"activity_id":1,"activity_name":"Logon","auth_protocol":"SSH","auth_protocol_id":99,"category_name":"Identity & Access Management","category_uid":3,"class_name":"Authentication","class_uid":3002,"is_remote":true,"message":"SSH authentication failed for '
   || CASE WHEN invalid AND v.pv = '2' THEN 'invalid user ' ELSE 'user ' END || usr || ' from ' || ip
   || '","metadata":{{"logged_time":' || logged_ms || ',"processed_time":{CLOCK_MS},"product":{{"name":"siemspark","vendor_name":"siemspark"}},"version":"1.9.0","x_time_source":"'
   || CASE WHEN declared_ms IS NULL THEN 'ingest_time_fallback' ELSE 'event_time' END || '"}},"service":{{"name":"sshd"}},"severity":"Low","severity_id":2,"src_endpoint":{{"ip":"' || ip || '","port":' || port
   || '}},"status":"Failure","status_detail":"' || CASE WHEN invalid THEN 'Invalid user' ELSE 'Authentication failed' END
   || '","status_id":2,"time":' || coalesce(declared_ms, logged_ms) || ',"type_name":"Authentication: Logon","type_uid":300201,"user":{{"name":"' || usr || '"}}}}' AS ocsf,
  sha256('parser=linux/sshd@' || v.pv || chr(10) || 'mapping=linux.ssh.authentication@1' || chr(10) || 'ocsf=1.9.0' || chr(10) || 'pipeline=1' || chr(10)
   || 'mode=EXECUTION_MODE_' || v.mode || chr(10)) AS base_hash
 FROM nm0 n0, (VALUES ('1', 'LIVE'), ('2', 'REPLAY')) v(pv, mode)),
nm2 AS (SELECT *, CASE WHEN declared_ms IS NULL AND off IS NOT NULL THEN
   sha256('base_configuration=' || base_hash || chr(10) || 'source_time_policy=fixed_utc_offset=' || off || ';rfc3164_year=nearest_ingest_year' || chr(10))
   ELSE base_hash END AS configuration_hash FROM nm1),
nmv AS (SELECT *, sha256('raw_event_id=' || raw_event_id || chr(10) || 'parser=linux/sshd@' || pv || chr(10) || 'mapping=linux.ssh.authentication@1' || chr(10)
   || 'ocsf=1.9.0' || chr(10) || 'pipeline=1' || chr(10) || 'configuration=' || configuration_hash || chr(10) || 'execution_mode=EXECUTION_MODE_' || mode || chr(10)) AS logical_key
 FROM nm2)"""


def mapped(t, version="1", mode="LIVE"):
    return N.map_events(parsed(t, version), mode, CLOCK_MS, POLICIES)


def both_derivations(t):
    """Live rows and a later re-normalization of the same raw events."""
    return (N.normalized_rows(mapped(t)).unionByName(N.normalized_rows(mapped(t, "2", "REPLAY"))))


@query("event_time_resolve", with_ctes("out", body="""
    c AS (SELECT *, CASE source_id WHEN 'source-0' THEN 19800 WHEN 'source-1' THEN -28800 WHEN 'source-3' THEN 0 END AS off,
        CASE WHEN error_code IS NULL AND k = 1 THEN old END AS stamp FROM outcome),
    y AS (SELECT raw_event_id, ingest_time_seconds, off, d, epoch(try_strptime((year(make_timestamp((ingest_time_seconds + off) * 1000000)) + d)::VARCHAR || ' ' || stamp, '%Y %b %d %H:%M:%S'))::BIGINT - off AS s
        FROM c, (VALUES (-1), (0), (1)) v(d) WHERE event_time_seconds IS NULL AND stamp IS NOT NULL AND off IS NOT NULL),
    b AS (SELECT raw_event_id, arg_min(s, abs(s - ingest_time_seconds) * 10 + d) AS s FROM y WHERE s IS NOT NULL GROUP BY 1)
    SELECT raw_event_id, coalesce(event_time_seconds, b.s) AS resolved_seconds,
      CASE WHEN event_time_seconds IS NOT NULL THEN event_time_nanos WHEN b.s IS NOT NULL THEN 0 END AS resolved_nanos,
      CASE WHEN event_time_seconds IS NOT NULL THEN 'event_time' WHEN b.s IS NOT NULL THEN 'source_time_policy' ELSE 'ingest_time_fallback' END AS time_source
    FROM c LEFT JOIN b USING (raw_event_id)"""))
def event_time_resolve(t):
    return (N.resolve_event_time(parsed(t), POLICIES)
            .select("raw_event_id", "resolved_seconds", "resolved_nanos", "time_source"))


@query("rfc3164_nearest_year", """
    WITH x AS (SELECT o_orderkey, strftime(o_orderdate, '%b %d %H:%M:%S') AS stamp, epoch(o_orderdate)::BIGINT + (o_orderkey % 700) * 86400 - 30000000 AS ingest,
        ((o_custkey % 25) - 12) * 3600 AS off FROM orders),
    y AS (SELECT *, epoch(try_strptime((year(make_timestamp((ingest + off) * 1000000)) + d)::VARCHAR || ' ' || stamp, '%Y %b %d %H:%M:%S'))::BIGINT - off AS s
          FROM x, (VALUES (-1), (0), (1)) v(d))
    SELECT o_orderkey, arg_min(s, abs(s - ingest) * 10 + d) AS seconds FROM y WHERE s IS NOT NULL GROUP BY 1""")
def rfc3164_nearest_year(t):
    o = t.read("orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    x = o.select("o_orderkey", F.date_format("ts", "MMM dd HH:mm:ss").alias("stamp"),
                 (F.unix_seconds("ts") + (F.col("o_orderkey") % 700) * 86400 - 30_000_000).alias("ingest"),
                 ((F.col("o_custkey") % 25 - 12) * 3600).alias("off"))
    out = x.select("o_orderkey", N.nearest_year_seconds("stamp", "ingest", F.col("off")).alias("seconds"))
    return out.where(F.col("seconds").isNotNull())


@query("source_policy_check", """
    WITH p AS (SELECT CASE WHEN s_suppkey % 31 = 0 THEN ' ' WHEN s_suppkey % 29 = 0 THEN 'a=b' || s_suppkey ELSE 'source-' || (s_suppkey // 2 + s_suppkey % 2 * (s_suppkey % 3) * 1000) END AS source_id,
        CASE s_suppkey % 4 WHEN 0 THEN '+05:30' WHEN 1 THEN '-08:00' WHEN 2 THEN '+9:00' ELSE '+26:00' END AS utc_offset FROM supplier),
    g AS (SELECT source_id, count(*) AS entries, min(utc_offset) AS o FROM p GROUP BY 1),
    r AS (SELECT source_id, entries, CASE WHEN trim(source_id) = '' THEN 'empty source' WHEN regexp_matches(source_id, '[,=]') THEN 'source has '','' or ''='''
        WHEN entries > 1 THEN 'duplicate source' WHEN NOT regexp_full_match(o, '[+-]([01][0-9]|2[0-5]):[0-5][0-9]') THEN 'bad offset' END AS reason FROM g)
    SELECT * FROM r WHERE reason IS NOT NULL""")
def source_policy_check(t):
    from siemspark.functions.scalars import floor_div

    k = F.col("s_suppkey").cast("long")
    name = (F.when(k % 31 == 0, " ").when(k % 29 == 0, F.concat(F.lit("a=b"), k.cast("string")))
            .otherwise(F.concat(F.lit("source-"), (
                floor_div(k, 2) + k % 2 * (k % 3) * 1000).cast("string"))))
    off = (F.when(k % 4 == 0, "+05:30").when(k % 4 == 1, "-08:00").when(k % 4 == 2, "+9:00")
           .otherwise("+26:00"))
    return N.policy_errors(t.read("supplier").select(name.alias("source_id"), off.alias("utc_offset")))


@query("mapping_lookup", with_ctes("out", body="""
    SELECT raw_event_id, CASE parser_id WHEN 'linux/sshd' THEN 'linux.ssh.authentication' END AS mapping_id,
      CASE WHEN error_code IS NOT NULL THEN error_code WHEN parser_id <> 'linux/sshd' THEN 'NORM-MAPPING-UNSUPPORTED' END AS error_code
    FROM outcome"""))
def mapping_lookup(t):
    return mapped(t).select("raw_event_id", "mapping_id", "error_code")


@query("ocsf_auth", with_ctes("nm", body="""
    SELECT raw_event_id, ocsf AS ocsf_event_json, CASE WHEN declared_ms IS NULL THEN 'PARTIAL' ELSE 'SUCCESS' END AS normalization_status
    FROM nmv WHERE mode = 'LIVE'"""))
def ocsf_auth(t):
    return (mapped(t).where(F.col("error_code").isNull())
            .select("raw_event_id", "ocsf_event_json", "normalization_status"))


@query("canonical_hash", with_ctes("out", body="""
    SELECT raw_event_id, sha256(CASE n % 6 WHEN 0 THEN '{"event_time":"' || rfc || '","user":"' || usr || '"}'
        WHEN 1 THEN '{"n":123456789012345678901234567890,"timestamp":"01/02/2024","u":' || user_id::VARCHAR || '}'
        WHEN 2 THEN '{"@timestamp":' || (us // 1000000)::VARCHAR || ',"a":[1.50,1e2,-0,1E400]}' WHEN 3 THEN '[1,2,3]'
        WHEN 4 THEN '{"a":null,"b":{"a":"' || event_type || '","z":1}}' ELSE '{"event_time":"' || rfc || '","timestamp":5}' END) AS hash
    FROM outcome WHERE k = 4"""))
def canonical_hash(t):
    lines = t.raw_lines.where((F.col("content_type") == "application/json"))
    p = P.select_parser(lines, P.ParserRegistry()).where(F.col("parser_id") == P.JSON)
    text = canonical_json(F.col("payload").cast("string"))
    return p.select("raw_event_id", F.sha2(text, 256).alias("hash")).where(F.col("hash").isNotNull())


@query("config_hash", with_ctes("nm", body="""
    SELECT raw_event_id, mode AS execution_mode, configuration_hash FROM nmv"""))
def config_hash(t):
    return both_derivations(t).select("raw_event_id", "execution_mode", "configuration_hash")


@query("logical_key", with_ctes("nm", body="SELECT raw_event_id, mode AS execution_mode, logical_key FROM nmv"))
def logical_key(t):
    return both_derivations(t).select("raw_event_id", "execution_mode", "logical_key")


@query("normalize", with_ctes("nm", body="""
    SELECT tenant_id, raw_event_id, logical_key, CASE WHEN declared_ms IS NULL THEN 0 ELSE 1 END::INTEGER AS event_time_present,
      coalesce(event_time_seconds, 0) AS event_time_seconds, coalesce(event_time_nanos, 0)::INTEGER AS event_time_nanos,
      usr AS user_name, ip AS src_ip, 'Failure' AS status, 'Logon' AS activity_name, sha256(ocsf) AS normalized_hash
    FROM nmv WHERE mode = 'LIVE'"""))
def normalize(t):
    return N.normalized_rows(mapped(t)).select(
        "tenant_id", "raw_event_id", "logical_key", "event_time_present", "event_time_seconds",
        "event_time_nanos", "user_name", "src_ip", "status", "activity_name", "normalized_hash")


@query("transformations", with_ctes("nm", body="""
    SELECT raw_event_id AS input_object_id, 'normalizer:linux.ssh.authentication' AS component, '1' AS component_version,
      configuration_hash, 'SUCCESS' AS status, mode AS execution_mode FROM nmv WHERE mode = 'LIVE'"""))
def transformations(t):
    return N.transformation_rows(mapped(t)).select(
        "input_object_id", "component", "component_version", "configuration_hash", "status",
        "execution_mode")


@query("renormalize_history", with_ctes("nm", body="""
    SELECT raw_event_id, 2::BIGINT AS derivations, '1/LIVE,2/REPLAY' AS versions FROM nmv WHERE mode = 'LIVE'"""))
def renormalize_history(t):
    return N.derivation_history(both_derivations(t))


@query("current_derivation", with_ctes("nm", body="""
    SELECT raw_event_id, '2' AS parser_version, logical_key FROM nmv WHERE mode = 'REPLAY'"""))
def current_derivation(t):
    rows = both_derivations(t)
    return (N.current_derivation(rows, "REPLAY")
            .select("raw_event_id", "parser_version", "logical_key"))


@query("normalized_verify", with_ctes("ne", body="""
    SELECT normalized_event_id, CASE WHEN event_id % 19 = 0 THEN 'raw_event_id' WHEN event_id % 23 = 0 THEN 'normalized_at' END AS violation FROM ne"""))
def normalized_verify(t):
    eid = F.col("event_id")
    bad = t.normalized_events.withColumns({
        "raw_event_id": F.when(eid % 19 == 0, F.concat(F.col("raw_event_id"), F.lit("0"))).otherwise(F.col("raw_event_id")),
        "normalized_at_seconds": F.col("ingest_time_seconds"),
        "normalized_at_nanos": F.when(eid % 23 == 0, 1_000_000_000).otherwise(F.col("ingest_time_nanos"))})
    return bad.select("normalized_event_id", N.normalized_violation().alias("violation"))


@query("transformation_verify", with_ctes("ne", body="""
    SELECT normalized_event_id, CASE WHEN event_id % 19 = 0 THEN 'status' WHEN event_id % 29 = 0 THEN 'execution_mode'
      WHEN event_id % 23 = 0 THEN 'error' END AS violation FROM ne"""))
def transformation_verify(t):
    eid = F.col("event_id")
    rows = t.normalized_events.select(
        "normalized_event_id", F.col("normalized_event_id").alias("transformation_id"),
        F.col("ingest_time_seconds").alias("started_at_seconds"),
        F.col("ingest_time_seconds").alias("completed_at_seconds"),
        F.when(eid % 19 == 0, "").when(eid % 23 == 0, "FAILED").otherwise("SUCCESS").alias("status"),
        F.when(eid % 29 == 0, "NONE").otherwise("LIVE").alias("execution_mode"),
        F.lit(None).cast("string").alias("error"))
    return rows.select("normalized_event_id", N.transformation_violation().alias("violation"))


@query("normalized_append", with_ctes("nm", body="""
    SELECT tenant_id, raw_event_id, mode AS execution_mode, logical_key, 1::BIGINT AS copies FROM nmv"""))
def normalized_append(t):
    """Live rows, then live and replay rows again: every key is stored once."""
    path = shared_dir(t.spark, "normalized")
    partitions = ["tenant_id", "execution_mode", "event_date"]
    order = ["event_time_seconds", "event_time_nanos", "normalized_event_id"]
    # Read more than once by the appends, so the lines are parsed once for each mode.
    live = cut_lineage(N.normalized_rows(mapped(t)), "live")
    sinks.append_missing(live, path, "logical_key", partitions, order)
    again = live.unionByName(cut_lineage(N.normalized_rows(mapped(t, "2", "REPLAY")), "replay"))
    table = sinks.append_missing(again, path, "logical_key", partitions, order)
    return (table.groupBy("tenant_id", "raw_event_id", "execution_mode", "logical_key")
            .agg(F.count(F.lit(1)).alias("copies")))


@query("normalized_conflicts", with_ctes("nm", body="""
    SELECT logical_key, CASE WHEN user_id % 2 = 0 THEN 'normalized_hash' ELSE 'tenant_id,normalized_hash' END AS differs
    FROM nmv WHERE mode = 'LIVE' AND user_id % 4 IN (0, 1)"""))
def normalized_conflicts(t):
    stored = N.normalized_rows(mapped(t)).select("logical_key", "tenant_id", "raw_event_id", "user_name", "normalized_hash")
    uid = F.substring("user_name", 5, 9).cast("long")
    new = stored.withColumns({
        "normalized_hash": F.when((uid % 4).isin(0, 1), F.sha2("user_name", 256)).otherwise(F.col("normalized_hash")),
        "tenant_id": F.when(uid % 4 == 1, "elsewhere").otherwise(F.col("tenant_id"))})
    return sinks.key_conflicts(new, stored, "logical_key", ["tenant_id", "raw_event_id", "normalized_hash"])
