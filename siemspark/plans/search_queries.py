"""Search, paging and field-state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siemspark.functions.fields import (field_state, integral_number, number_field_error,
                                        strict_string)
from siemspark.functions.predicates import search_predicate
from siemspark.operators import search as S
from siemspark.operators.events import batch_scan, conflicting_ids, dedup_events
from siemspark.plans.fixtures import with_ctes
from siemspark.plans.registry import query
from siemspark.session import shared_dir

DAY10 = (1704844800, 0)            # 2024-01-10T00:00:00Z
DAY20 = (1705708800, 500_000_000)


def _search(name, spec, sql):
    """A whole-table search: every event of every tenant that matches."""
    oracle = with_ctes("ne", body=f"""
        SELECT tenant_id, normalized_event_id, event_time_seconds FROM ne WHERE {sql}""")

    @query(name, oracle)
    def run(t):
        return (t.normalized_events.where(search_predicate(spec))
                .select("tenant_id", "normalized_event_id", "event_time_seconds"))


def _leaf(field, op, value=None):
    return {"field": field, "op": op, "value": value}


_search("search_eq", {"or": [_leaf("user.name", "==", "user7"), _leaf("severity_id", "==", 4)]},
        "coalesce(user_name,'') = 'user7' OR severity = 4")
_search("search_ne", _leaf("user.name", "!=", "user7"), "coalesce(user_name,'') <> 'user7'")
_search("search_range_num", {"or": [_leaf("severity_id", ">", 3), _leaf("activity_id", "<=", 0)]},
        "severity > 3 OR activity_id <= 0")
_search("search_in", {"and": [_leaf("user.name", "in", ["user1", "user2", ""]),
                              _leaf("severity_id", "in", [2, 3, 4])]},
        "coalesce(user_name,'') IN ('user1','user2','') AND severity IN (2,3,4)")
_search("search_contains", _leaf("message", "contains", "or by user1"),
        "strpos(message, 'or by user1') > 0")
_search("search_prefix", _leaf("src_endpoint.ip", "starts_with", "10.0.2."),
        "starts_with(src_ip, '10.0.2.')")
_search("search_suffix", _leaf("user.name", "ends_with", "3"),
        "ends_with(coalesce(user_name,''), '3')")
_search("search_exists", {"and": [_leaf("user.name", "exists"), _leaf("activity_id", "exists")]},
        "coalesce(user_name,'') <> '' AND activity_id IS NOT NULL")
_search("search_bool",
        {"not": {"or": [{"and": [_leaf("user.name", "starts_with", "user1"),
                                 _leaf("severity_id", ">=", 3)]},
                        {"not": _leaf("status", "==", "Success")},
                        _leaf("user.name", "==", "")]}},
        """NOT ((starts_with(coalesce(user_name,''),'user1') AND severity >= 3)
           OR NOT (coalesce(status,'') = 'Success') OR coalesce(user_name,'') = '')""")


@query("search_json_field", with_ctes("ne", body="""
    SELECT normalized_event_id, CASE WHEN json_type(ocsf_event_json, '$.user.name') = 'VARCHAR'
      THEN json_extract_string(ocsf_event_json, '$.user.name') ELSE '' END AS user_text
    FROM ne"""))
def search_json_field(t):
    """Promotion of a JSON string: anything but a string counts as ''."""
    v = t.normalized_events.select("normalized_event_id",
                                   F.try_parse_json("ocsf_event_json").alias("v"))
    return v.select("normalized_event_id",
                    F.coalesce(strict_string(F.col("v"), "user.name"), F.lit("")).alias("user_text"))


@query("search_view", with_ctes("ne", body="""
    SELECT normalized_event_id, raw_event_id, tenant_id,
      CASE WHEN event_time_present = 1 THEN strftime(make_timestamp(event_time_seconds * 1000000), '%Y-%m-%dT%H:%M:%S')
        || CASE WHEN event_time_nanos = 0 THEN '' ELSE '.' || rtrim(lpad(event_time_nanos::VARCHAR, 9, '0'), '0') END || 'Z'
        ELSE '' END AS event_time,
      strftime(make_timestamp(ingest_time_seconds * 1000000), '%Y-%m-%dT%H:%M:%S')
        || CASE WHEN ingest_time_nanos = 0 THEN '' ELSE '.' || rtrim(lpad(ingest_time_nanos::VARCHAR, 9, '0'), '0') END || 'Z' AS ingest_time,
      ocsf_version, class_uid, category_uid, activity_id, severity AS severity_id, parser_id, parser_version,
      mapping_id, mapping_version, sha256(ocsf_event_json) AS normalized_hash, execution_mode,
      ocsf_event_json AS ocsf_event
    FROM ne"""))
def search_view(t):
    return S.event_view(t.normalized_events)


@query("search_time_range", with_ctes("ne", body=f"""
    SELECT normalized_event_id, event_time_seconds, event_time_nanos FROM ne
    WHERE event_time_present = 1
      AND event_time_seconds * 1000000000 + event_time_nanos >= {DAY10[0]}000000000 + {DAY10[1]}
      AND event_time_seconds * 1000000000 + event_time_nanos < {DAY20[0]}000000000 + {DAY20[1]}"""))
def search_time_range(t):
    return (S.time_range(t.normalized_events, DAY10, DAY20)
            .select("normalized_event_id", "event_time_seconds", "event_time_nanos"))


_PAGE_COLUMNS = ["position", "has_more", "normalized_event_id", "event_time_seconds",
                 "event_time_nanos"]
_PAGE_SQL = """r AS (
      SELECT *, row_number() OVER (ORDER BY event_time_seconds {d}, event_time_nanos {d}, normalized_event_id {d})::INTEGER AS position,
        count(*) OVER () > 200 AS has_more
      FROM ne WHERE event_time_present = 1 AND tenant_id = 'tenant-1' AND {w})
    SELECT position, has_more, normalized_event_id, event_time_seconds, event_time_nanos FROM r WHERE position <= 200"""


@query("search_page", with_ctes("ne", body=_PAGE_SQL.format(d="DESC", w="severity >= 3")))
def search_page(t):
    """Newest 200 matches of a tenant: the page size is the feature."""
    rows = S.search(t.normalized_events, "tenant-1", (0, 0), (4102444800, 0),
                    _leaf("severity_id", ">=", 3))
    return S.page(rows, 200, "desc").select(*_PAGE_COLUMNS)


@query("search_stored", with_ctes("ne", body=f"""
    SELECT normalized_event_id, event_time_seconds, event_time_nanos, user_name FROM ne
    WHERE event_time_present = 1 AND tenant_id = 'tenant-1' AND user_name = 'user7'
      AND event_time_seconds * 1000000000 + event_time_nanos >= {DAY10[0]}000000000 + {DAY10[1]}
      AND event_time_seconds * 1000000000 + event_time_nanos < {DAY20[0]}000000000 + {DAY20[1]}"""))
def search_stored(t):
    """The normalized table, written once by tenant, mode and day: range, tenant and field reach the scan."""
    path = shared_dir(t.spark, "normalized")
    rows = t.normalized_events
    (rows.hint("rebalance", F.col("tenant_id"), F.col("execution_mode"), F.col("event_date"))
     .sortWithinPartitions("tenant_id", "execution_mode", "event_date", "event_time_seconds", "event_time_nanos")
     .write.partitionBy("tenant_id", "execution_mode", "event_date").parquet(path))
    found = S.search(t.spark.read.schema(rows.schema).parquet(path), "tenant-1", DAY10, DAY20,
                     {"field": "user.name", "op": "==", "value": "user7"})
    return found.select("normalized_event_id", "event_time_seconds", "event_time_nanos", "user_name")


@query("search_next_page", with_ctes("ne", body=_PAGE_SQL.format(
    d="ASC", w=f"""(event_time_seconds > {DAY10[0]} OR (event_time_seconds = {DAY10[0]} AND
       (event_time_nanos > 5 OR (event_time_nanos = 5 AND normalized_event_id > '018f47a2'))))""")))
def search_next_page(t):
    rows = S.search(t.normalized_events, "tenant-1", (0, 0), (4102444800, 0))
    return (S.page(S.after_cursor(rows, DAY10[0], 5, "018f47a2", "asc"), 200, "asc")
            .select(*_PAGE_COLUMNS))


@query("list_page", """
    SELECT 'finding-' || lpad(o_orderkey::VARCHAR, 12, '0') AS finding_id, o_custkey FROM orders
    WHERE 'finding-' || lpad(o_orderkey::VARCHAR, 12, '0') > 'finding-000000000100'
    ORDER BY finding_id LIMIT 201""")
def list_page(t):
    findings = t.read("orders").select(
        F.concat(F.lit("finding-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
        .alias("finding_id"), "o_custkey")
    return S.keyset_list(findings, "finding_id", "finding-000000000100", 200)


@query("event_lookup", with_ctes("ne", body="""
    SELECT normalized_event_id, user_name, status FROM ne
    WHERE tenant_id = 'tenant-' || (SELECT user_id % 3 FROM events WHERE event_id = 77)
      AND normalized_event_id = '018f47a2-4b00-7a00-8000-00000000004d'"""))
def event_lookup(t):
    """One id, looked up under each tenant: only its own tenant finds it."""
    hits = [S.lookup(t.normalized_events, f"tenant-{i}", "018f47a2-4b00-7a00-8000-00000000004d") for i in range(3)]
    return hits[0].union(hits[1]).union(hits[2]).select("normalized_event_id", "user_name", "status")


@query("field_state", with_ctes("ne", body="""
    j AS (SELECT normalized_event_id, event_id, ocsf_event_json AS j, json_type(ocsf_event_json, '$.user') AS u,
            json_type(ocsf_event_json, '$.user.name') AS n FROM ne)
    SELECT normalized_event_id,
      CASE WHEN u IS NULL THEN 'ABSENT' WHEN u = 'NULL' THEN 'NULL' WHEN u <> 'OBJECT' THEN 'MALFORMED'
           WHEN n IS NULL THEN 'ABSENT' WHEN n = 'NULL' THEN 'NULL' ELSE 'PRESENT' END AS user_state,
      CASE WHEN n = 'VARCHAR' THEN json_extract_string(j, '$.user.name') END AS user_text,
      'MALFORMED' AS empty_segment_state
    FROM j"""))
def field_state_query(t):
    v = t.normalized_events.select("normalized_event_id",
                                   F.try_parse_json("ocsf_event_json").alias("v"))
    return v.select("normalized_event_id", field_state(F.col("v"), "user.name").alias("user_state"),
                    strict_string(F.col("v"), "user.name").alias("user_text"),
                    field_state(F.col("v"), "user..name").alias("empty_segment_state"))


@query("time_field_errors", with_ctes("ne", body="""
    SELECT normalized_event_id, CASE event_id % 101 WHEN 6 THEN 'field time is not numeric'
      ELSE 'field time is not an integral number' END AS error FROM ne WHERE event_id % 101 IN (6, 7)"""))
def time_field_errors(t):
    v = t.normalized_events.select("normalized_event_id",
                                   F.try_parse_json("ocsf_event_json").alias("v"))
    return (v.select("normalized_event_id", number_field_error(F.col("v"), "time").alias("error"))
            .where(F.col("error").isNotNull()))


@query("time_field", with_ctes("ne", body="""
    SELECT normalized_event_id, CASE WHEN event_id % 101 NOT IN (6, 7) THEN time_ms END AS time_value
    FROM ne"""))
def time_field(t):
    v = t.normalized_events.select("normalized_event_id",
                                   F.try_parse_json("ocsf_event_json").alias("v"))
    return v.select("normalized_event_id", integral_number(F.col("v"), "time").alias("time_value"))


@query("batch_scan", with_ctes("ne", body=f"""
    SELECT tenant_id, normalized_event_id, time_ms FROM ne
    WHERE execution_mode = 'LIVE' AND event_time_present = 1
      AND time_ms BETWEEN {DAY10[0] * 1000 + 250} AND {DAY20[0] * 1000 + 750}"""))
def batch_scan_query(t):
    from siemspark.functions.scalars import millis

    rows = batch_scan(t.normalized_events, None, "LIVE", DAY10[0] * 1000 + 250, DAY20[0] * 1000 + 750)
    return rows.select("tenant_id", "normalized_event_id",
                       millis("event_time_seconds", "event_time_nanos").alias("time_ms"))


@query("batch_scan_dedup", with_ctes("ne", body="""
    SELECT tenant_id, normalized_event_id, status, user_name, ocsf_event_json FROM ne"""))
def batch_scan_dedup(t):
    """Twice delivered events come out once."""
    return (dedup_events(t.delivered_events)
            .select("tenant_id", "normalized_event_id", "status", "user_name", "ocsf_event_json"))


@query("batch_scan_conflicts", with_ctes("ne", body="""
    SELECT normalized_event_id, 2::BIGINT AS copies FROM ne WHERE event_id % 97 = 0"""))
def batch_scan_conflicts(t):
    return conflicting_ids(t.altered_events)
