"""Parsing queries over the raw log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from siemspark.operators import parse as P
from siemspark.plans.fixtures import CTE, with_ctes
from siemspark.plans.registry import query

# The probes, written independently of the Spark expressions.
CTE["probe"] = CTE["rl"] + """,
probe AS (SELECT *,
  CASE WHEN contains(text, 'Failed password for ') AND contains(text, ' from ') AND contains(text, ' port ') THEN 100 ELSE 0 END AS p_sshd,
  CASE WHEN starts_with(text, '{') AND contains(text, '"journald_version"') AND contains(text, '"fields"') THEN 100 ELSE 0 END AS p_journald,
  CASE WHEN regexp_matches(text, '^<[0-9]{1,3}>[0-9]+( |$)') AND try_cast(regexp_extract(text, '^<([0-9]{1,3})>', 1) AS INTEGER) <= 191 THEN 95 ELSE 0 END AS p_5424,
  CASE WHEN regexp_matches(text, '^<[0-9]{1,3}>[A-Za-z]{3} .. ..:..:..') AND try_cast(regexp_extract(text, '^<([0-9]{1,3})>', 1) AS INTEGER) <= 191 THEN 90 ELSE 0 END AS p_3164,
  CASE WHEN content_type = 'application/json' THEN CASE WHEN left(text, 1) IN ('{', '[') THEN 60 ELSE 35 END
       WHEN left(text, 1) IN ('{', '[') THEN 30 ELSE 0 END AS p_json
 FROM rl),
sel AS (SELECT *, CASE WHEN p_sshd = 100 AND p_journald = 100 THEN NULL WHEN p_sshd = 100 THEN 'linux/sshd'
   WHEN p_journald = 100 THEN 'journald/canonical' WHEN p_5424 > 0 THEN 'syslog/rfc5424' WHEN p_3164 > 0 THEN 'syslog/rfc3164'
   WHEN p_json > 0 THEN 'json/generic' END AS parser_id,
  CASE WHEN p_sshd = 100 AND p_journald = 100 THEN 'ambiguous'
   WHEN greatest(p_sshd, p_journald, p_5424, p_3164, p_json) = 0 THEN 'none' ELSE 'tier-then-confidence' END AS selection
 FROM probe)"""

# Outcome per line, from how the broken lines were made.
CTE["out"] = CTE["probe"] + """,
outc AS (SELECT *, CASE
   WHEN parser_id IS NULL THEN 'PARSE-NO-MATCH'
   WHEN k = 2 AND n % 8 = 5 THEN 'PARSE-UNSUPPORTED-VERSION' WHEN k = 2 AND n % 8 = 7 THEN 'PARSE-MALFORMED'
   WHEN k = 2 AND n % 8 = 4 THEN 'PARSE-INVALID-TIMESTAMP'
   WHEN k = 3 AND n % 8 IN (3, 4) THEN 'PARSE-MALFORMED' WHEN k = 3 AND n % 8 = 5 THEN 'PARSE-UNSUPPORTED-VERSION'
   WHEN k = 3 AND n % 8 = 6 THEN 'PARSE-INVALID-TIMESTAMP'
   WHEN k = 5 THEN 'PARSE-MALFORMED' END AS error_code FROM sel),
outcome AS (SELECT *, CASE WHEN error_code IS NOT NULL THEN 'FAILED'
   WHEN k = 1 OR (k = 2 AND n % 8 = 3) OR (k = 4 AND n % 6 IN (1, 2, 5)) THEN 'PARTIAL' ELSE 'SUCCESS' END AS parse_status FROM outc)"""


def parsed(t, version: str = "1"):
    return P.parse(t.dealt_lines, P.ParserRegistry(P.default_parsers(version)))


@query("parser_probe", with_ctes("probe", body="""
    SELECT raw_event_id, 'linux/sshd=' || p_sshd || ',journald/canonical=' || p_journald || ',syslog/rfc5424=' || p_5424
      || ',syslog/rfc3164=' || p_3164 || ',json/generic=' || p_json AS candidates_trace FROM probe"""))
def parser_probe(t):
    return (P.select_parser(t.raw_lines, P.ParserRegistry())
            .select("raw_event_id", "candidates_trace"))


@query("parser_select", with_ctes("probe", body="""
    SELECT raw_event_id, parser_id, CASE WHEN parser_id IS NOT NULL THEN '1' END AS parser_version, selection FROM sel"""))
def parser_select(t):
    return (P.select_parser(t.raw_lines, P.ParserRegistry())
            .select("raw_event_id", "parser_id", "parser_version", "selection"))


@query("parser_configured", with_ctes("probe", body="""
    SELECT raw_event_id, CASE user_id % 3 WHEN 0 THEN parser_id WHEN 1 THEN 'json/generic' END AS parser_id,
      CASE user_id % 3 WHEN 0 THEN selection WHEN 1 THEN 'configured' ELSE 'unknown-configured' END AS selection FROM sel"""))
def parser_configured(t):
    """A parser named by the source's settings is used whatever the probes say."""
    named = (F.when(F.col("tenant_id") == "tenant-1", "json/generic")
             .when(F.col("tenant_id") == "tenant-2", "no/such"))
    return (P.select_parser(t.raw_lines.withColumn("configured", named), P.ParserRegistry(),
                            configured="configured")
            .select("raw_event_id", "parser_id", "selection"))


def _sshd_sql(version):
    label = "invalid user " if version == "2" else "user "
    return with_ctes("probe", body=f"""
    x AS (SELECT raw_event_id, regexp_extract(text, 'Failed password for (.*?) from (.*?) port \\s*(\\S+)', ['who', 'ip', 'port']) AS m
          FROM sel WHERE parser_id = 'linux/sshd'),
    y AS (SELECT raw_event_id, m.who AS who, m.ip AS ip, CASE WHEN regexp_full_match(m.port, '\\+?[0-9]+') THEN try_cast(m.port AS BIGINT) END AS port FROM x)
    SELECT raw_event_id, CASE WHEN starts_with(who, 'invalid user ') THEN substr(who, 14) ELSE who END AS username, ip AS source_ip,
      port AS source_port, starts_with(who, 'invalid user ') AS invalid_user,
      'SSH authentication failed for ' || CASE WHEN starts_with(who, 'invalid user ') THEN '{label}' || substr(who, 14) ELSE 'user ' || who END
        || ' from ' || ip AS message
    FROM y WHERE port <= 65535""")


def _sshd(t, version):
    p = parsed(t, version).where((F.col("parser_id") == P.SSHD) & F.col("error_code").isNull())
    return p.select("raw_event_id", *[F.col("parsed_linux_sshd")[c].alias(c) for c in (
        "username", "source_ip", "source_port", "invalid_user", "message")])


@query("parse_sshd", _sshd_sql("1"))
def parse_sshd(t):
    return _sshd(t, "1")


@query("parse_sshd_v2", _sshd_sql("2"))
def parse_sshd_v2(t):
    return _sshd(t, "2")


_SYSLOG = ["pri", "facility", "severity", "version", "timestamp", "hostname", "app_name", "procid",
           "msgid", "structured_data", "message"]


@query("parse_rfc5424", with_ctes("out", body="""
    SELECT raw_event_id, parse_status, (event_id % 192)::INTEGER AS pri, ((event_id % 192) // 8)::INTEGER AS facility,
      (event_id % 8)::INTEGER AS severity, 1::INTEGER AS version, CASE n % 8 WHEN 3 THEN NULL ELSE rfc END AS timestamp,
      CASE n % 8 WHEN 6 THEN NULL ELSE host END AS hostname, app AS app_name, (event_id % 1000)::VARCHAR AS procid,
      'ID' || (event_id % 50)::VARCHAR AS msgid,
      CASE n % 8 WHEN 1 THEN '[ex@1 k="a]b" q="x\\"y"]' WHEN 2 THEN '[a@1][b@2 z="1"]' END AS structured_data,
      CASE n % 8 WHEN 6 THEN '' ELSE 'msg ' || event_type || ' end' END AS message
    FROM outcome WHERE k = 2 AND error_code IS NULL"""))
def parse_rfc5424(t):
    p = parsed(t).where((F.col("parser_id") == P.RFC5424) & F.col("error_code").isNull())
    return p.select("raw_event_id", "parse_status",
                    *[F.col("parsed_syslog_rfc5424")[c].alias(c) for c in _SYSLOG])


@query("parse_rfc3164", with_ctes("out", body="""
    SELECT raw_event_id, parse_status, (event_id % 192)::INTEGER AS pri, old AS timestamp, host AS hostname,
      CASE n % 4 WHEN 1 THEN NULL WHEN 3 THEN app || '[]' ELSE app END AS app_name,
      CASE n % 4 WHEN 2 THEN (event_id % 1000)::VARCHAR END AS procid,
      CASE n % 4 WHEN 1 THEN 'just text ' ELSE '' END || 'event ' || event_type AS message
    FROM outcome WHERE k = 1"""))
def parse_rfc3164(t):
    p = parsed(t).where((F.col("parser_id") == P.RFC3164) & F.col("error_code").isNull())
    return p.select("raw_event_id", "parse_status", *[F.col("parsed_syslog_rfc3164")[c].alias(c) for c in (
        "pri", "timestamp", "hostname", "app_name", "procid", "message")])


@query("syslog_pri", with_ctes("probe", body="""
    x AS (SELECT raw_event_id, try_cast(regexp_extract(text, '^<([0-9]{1,3})>', 1) AS INTEGER) AS pri FROM sel
          WHERE parser_id IN ('syslog/rfc5424', 'syslog/rfc3164'))
    SELECT raw_event_id, pri, (pri // 8)::INTEGER AS facility, (pri % 8)::INTEGER AS severity FROM x"""))
def syslog_pri(t):
    p = parsed(t).where(F.col("parser_id").isin(P.RFC5424, P.RFC3164))
    return p.select("raw_event_id", *[
        F.coalesce(F.col("parsed_syslog_rfc5424")[c], F.col("parsed_syslog_rfc3164")[c]).alias(c)
        for c in ("pri", "facility", "severity")])


@query("parse_json_events", with_ctes("out", body="""
    SELECT raw_event_id, parse_status,
      CASE n % 6 WHEN 0 THEN '{"event_time":"' || rfc || '","user":"' || usr || '"}'
        WHEN 1 THEN '{"n":123456789012345678901234567890,"timestamp":"01/02/2024","u":' || user_id::VARCHAR || '}'
        WHEN 2 THEN '{"@timestamp":' || (us // 1000000)::VARCHAR || ',"a":[1.50,1e2,-0,1E400]}' WHEN 3 THEN '[1,2,3]'
        WHEN 4 THEN '{"a":null,"b":{"a":"' || event_type || '","z":1}}' ELSE '{"event_time":"' || rfc || '","timestamp":5}' END AS fields,
      CASE n % 6 WHEN 0 THEN 'event_time=' || rfc || '/rfc3339/high' WHEN 1 THEN 'timestamp=01/02/2024/source_text/low'
        WHEN 2 THEN '@timestamp=' || (us // 1000000)::VARCHAR || '/source_numeric_unspecified_unit/low'
        WHEN 5 THEN 'event_time=' || rfc || '/rfc3339/high;timestamp=5/source_numeric_unspecified_unit/low' ELSE '' END AS candidates,
      CASE WHEN n % 6 IN (1, 2, 5) THEN 1 ELSE 0 END::INTEGER AS warnings
    FROM outcome WHERE k = 4"""))
def parse_json_events(t):
    p = parsed(t).where((F.col("parser_id") == P.JSON) & F.col("error_code").isNull())
    shown = F.array_join(F.transform("time_candidates", lambda c: F.concat(
        c["source_field"], F.lit("="), c["value"], F.lit("/"), c["precision"], F.lit("/"),
        c["confidence"])), ";")
    return p.select("raw_event_id", "parse_status", F.col("parsed_json_generic.fields").alias("fields"),
                    shown.alias("candidates"), F.size("warnings").alias("warnings"))


@query("parse_journald", with_ctes("out", body="""
    SELECT raw_event_id, CASE n % 8 WHEN 1 THEN NULL ELSE 's=' || event_id::VARCHAR END AS cursor,
      'MESSAGE:utf8:ran ' || event_type || ',_SOURCE_REALTIME_TIMESTAMP:utf8:' || us::VARCHAR || ',DATA:base64:AAEC' AS fields,
      '_SOURCE_REALTIME_TIMESTAMP=' || us::VARCHAR AS candidates
    FROM outcome WHERE k = 3 AND error_code IS NULL"""))
def parse_journald(t):
    p = parsed(t).where((F.col("parser_id") == P.JOURNALD) & F.col("error_code").isNull())
    out = F.col("parsed_journald_canonical")
    return p.select(
        "raw_event_id", out["cursor"].alias("cursor"),
        F.array_join(F.transform(out["journal_fields"], lambda f: F.concat_ws(
            ":", f["name"], f["encoding"], f["value"])), ",").alias("fields"),
        F.array_join(F.transform("time_candidates", lambda c: F.concat_ws(
            "=", c["source_field"], c["value"])), ",").alias("candidates"))


@query("parse_outcomes", with_ctes("out", body="""
    SELECT raw_event_id, parser_id, parse_status, error_code FROM outcome"""))
def parse_outcomes(t):
    return parsed(t).select("raw_event_id", "parser_id", "parse_status", "error_code")


@query("parse_outcomes_text", """
    WITH x AS (SELECT 'doc-' || doc_id::VARCHAR AS raw_event_id, text FROM documents
      UNION ALL SELECT 'page-' || page_id::VARCHAR, html FROM pages),
    y AS (SELECT *, contains(text, 'Failed password for ') AND contains(text, ' from ') AND contains(text, ' port ') AS is_sshd,
      left(ltrim(text, chr(9) || chr(10) || chr(12) || chr(13) || ' '), 1) IN ('{', '[') AS opens FROM x)
    SELECT raw_event_id, CASE WHEN is_sshd THEN 'linux/sshd' WHEN opens THEN 'json/generic' END AS parser_id,
      'FAILED' AS parse_status, CASE WHEN is_sshd OR opens THEN 'PARSE-MALFORMED' ELSE 'PARSE-NO-MATCH' END AS error_code, strlen(text)::BIGINT AS bytes FROM y""")
def parse_outcomes_text(t):
    """Whole prose texts and web pages: junk for every parser, and none may fail."""
    docs = t.read("documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("raw_event_id"), "text")
    pages = t.read("pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("raw_event_id"),
        F.col("html").alias("text"))
    raw = docs.unionByName(pages).select(
        "raw_event_id", F.encode("text", "UTF-8").alias("payload"),
        F.lit("text/plain").alias("content_type"))
    p = P.parse(raw)
    return p.select("raw_event_id", "parser_id", "parse_status", "error_code",
                    F.octet_length("payload").cast("long").alias("bytes"))


@query("json_limits", with_ctes("rl", body="""
    SELECT raw_event_id, CASE user_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 2 END::INTEGER AS code FROM rl"""))
def json_limits(t):
    """Nesting and field-count limits on JSON built from every line."""
    uid = F.substring("source_id", 8, 1).cast("int")

    def nested(depth):
        return F.concat(F.repeat(F.lit("["), depth), F.col("event_id").cast("string"),
                        F.repeat(F.lit("]"), depth))

    wide = F.concat(F.lit("["), F.repeat(F.lit("1,"), 4_096), F.lit("1]"))
    text = (F.when(uid == 0, nested(3)).when(uid == 1, nested(64)).when(uid == 2, nested(65))
            .when(uid == 3, wide).otherwise(nested(128)))
    return t.dealt_lines.select("raw_event_id", P.json_limit_code(text).alias("code"))


@query("normalizer_metrics", with_ctes("out", body="""
    SELECT parse_status, coalesce(parser_id, 'none') AS parser_id, coalesce(error_code, '') AS error_code,
      count(*) AS lines, sum(strlen(text))::BIGINT AS bytes
    FROM outcome GROUP BY ALL"""))
def normalizer_metrics(t):
    p = parsed(t)
    return p.groupBy("parse_status", F.coalesce("parser_id", F.lit("none")).alias("parser_id"),
                     F.coalesce("error_code", F.lit("")).alias("error_code")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.octet_length("payload").cast("long")).alias("bytes"))
