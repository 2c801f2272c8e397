"""Retry, dead-letter and replay queries over the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from siemspark.functions.scalars import floor_div
from siemspark.operators import reliability as L
from siemspark.plans.fixtures import CTE, numbered_lines, with_ctes
from siemspark.plans.registry import query
from siemspark.session import shared_dir
from siemspark.sources import sinks

CODES = ["PARSE-MALFORMED", "NORM-RAW-HASH", "NORM-RAW-READ", "NORM-RAW-STORE-IO", "NORM-CLICKHOUSE-DOWN",
         "NORM-NATS-TIMEOUT", "NORM-MAPPING-UNSUPPORTED", "NORM-TENANT", "NORM-OTHER"]


def _code():
    return F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.col("l_partkey") % 9 + 1).cast("int"))


_CODE_SQL = "[" + ", ".join(f"'{c}'" for c in CODES) + "][l_partkey % 9 + 1]"

CTE["att"] = CTE["li"] + f""",
att AS (SELECT 'msg-' || l_orderkey AS message_key, seq, CASE WHEN l_quantity > 42 THEN 'SUCCESS' WHEN l_quantity < 3 THEN 'DLQ_PUBLISHED' ELSE 'FAILURE' END AS outcome,
  CASE WHEN l_suppkey % 3 <> 0 THEN 'id-' || l_suppkey END AS message_id, epoch(l_shipdate)::BIGINT * 1000 AS occurred_ms,
  (2 + l_orderkey % 3)::INTEGER AS retry_budget, {_CODE_SQL} AS error_code, l_returnflag <> 'R' AS retryable FROM li)"""


def attempts(t):
    li = numbered_lines(t.read("lineitem"))
    occurred = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * 1000
    return li.select(
        F.lit("normalizer").alias("consumer"), F.concat(F.lit("msg-"), F.col("l_orderkey").cast("string")).alias("message_key"),
        "seq", F.when(F.col("l_quantity") > 42, "SUCCESS").when(F.col("l_quantity") < 3, "DLQ_PUBLISHED")
        .otherwise("FAILURE").alias("outcome"),
        F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("id-"), F.col("l_suppkey").cast("string"))).alias("message_id"),
        occurred.alias("occurred_ms"), (2 + F.col("l_orderkey") % 3).cast("int").alias("retry_budget"),
        F.col("seq").alias("delivery_attempt"), _code().alias("error_code"),
        (F.col("l_returnflag") != "R").alias("retryable"), (occurred + 5_000).alias("next_retry_ms"))


@query("error_classify", with_ctes("li", body=f"""
    x AS (SELECT DISTINCT {_CODE_SQL} AS error_code FROM li)
    SELECT error_code, CASE WHEN starts_with(error_code, 'PARSE-') THEN 'PARSING' WHEN error_code = 'NORM-RAW-HASH' THEN 'INTEGRITY'
        WHEN error_code IN ('NORM-RAW-STORE-IO', 'NORM-CLICKHOUSE-DOWN') THEN 'STORAGE' WHEN error_code = 'NORM-NATS-TIMEOUT' THEN 'TRANSPORT'
        WHEN error_code = 'NORM-MAPPING-UNSUPPORTED' THEN 'NORMALIZATION' ELSE 'INTERNAL' END AS category,
      CASE WHEN starts_with(error_code, 'PARSE-') THEN 'parsing' WHEN starts_with(error_code, 'NORM-RAW') THEN 'raw_read_or_integrity'
        WHEN error_code = 'NORM-CLICKHOUSE-DOWN' THEN 'normalized_storage' WHEN error_code = 'NORM-NATS-TIMEOUT' THEN 'event_bus'
        WHEN error_code = 'NORM-MAPPING-UNSUPPORTED' THEN 'mapping' WHEN error_code = 'NORM-TENANT' THEN 'handoff_validation' ELSE 'normalization' END AS stage
    FROM x"""))
def error_classify(t):
    codes = t.read("lineitem").select(_code().alias("error_code")).distinct()
    return codes.select("error_code", L.error_category("error_code").alias("category"),
                        L.failure_stage("error_code").alias("stage"))


# A plain walk through every history, one attempt at a time.
@query("retry_state", "WITH RECURSIVE" + with_ctes("att", body="""
    a AS (SELECT * RENAME (message_id AS new_id), row_number() OVER (PARTITION BY message_key ORDER BY seq) AS pos, outcome <> 'FAILURE' AS clears FROM att),
    w AS (
     SELECT message_key, 0::BIGINT AS i, 0 AS n, NULL::VARCHAR AS message_id, NULL::BIGINT AS first_ms, NULL::BIGINT AS last_ms, NULL::INTEGER AS budget,
       NULL::INTEGER AS last_attempt, NULL::VARCHAR AS code, NULL::BOOLEAN AS again, NULL::BIGINT AS nx FROM (SELECT DISTINCT message_key FROM att)
     UNION ALL
     SELECT message_key, pos, CASE WHEN clears THEN 0 WHEN counts THEN n + 1 ELSE n END, CASE WHEN clears THEN NULL WHEN counts THEN coalesce(message_id, new_id) ELSE message_id END,
       CASE WHEN clears THEN NULL WHEN counts THEN coalesce(first_ms, occurred_ms) ELSE first_ms END,
       CASE WHEN clears THEN NULL WHEN counts THEN greatest(coalesce(last_ms, occurred_ms), occurred_ms) ELSE last_ms END,
       CASE WHEN clears THEN NULL WHEN counts THEN coalesce(budget, retry_budget) ELSE budget END, CASE WHEN clears THEN NULL WHEN counts THEN seq ELSE last_attempt END,
       CASE WHEN clears THEN NULL WHEN counts THEN error_code ELSE code END, CASE WHEN clears THEN NULL WHEN counts THEN retryable ELSE again END,
       CASE WHEN clears THEN NULL WHEN counts THEN occurred_ms + 5000 ELSE nx END
     FROM (SELECT *, n = 0 OR (again AND n < budget) AS counts FROM w JOIN a USING (message_key) WHERE pos = i + 1))
    SELECT 'normalizer' AS consumer, message_key, message_id, first_ms AS first_failure_ms, last_ms AS last_failure_ms, n::INTEGER AS failure_count, budget AS retry_budget,
      last_attempt::INTEGER AS last_delivery_attempt, code AS last_error_code, again AS last_error_retryable,
      CASE WHEN again AND n < budget THEN greatest(last_ms, nx) END AS next_retry_ms, NOT (again AND n < budget) AS isolated
    FROM (SELECT *, max(i) OVER (PARTITION BY message_key) AS top FROM w) WHERE i = top AND n > 0""")[4:])
def retry_state(t):
    return L.retry_state(attempts(t), ["consumer", "message_key"], ["seq"])


@query("retry_backoff", with_ctes("att", body="""
    x AS (SELECT message_key, seq, least(250 * (1::BIGINT << least(greatest(seq - 1, 0), 20)), 5000)::BIGINT AS base,
        ('0x' || substr(sha256(message_key || ':' || seq), 1, 16))::UBIGINT % 41 AS j FROM att)
    SELECT message_key, seq, base AS delay_ms, round(greatest(250000000, least(base * 1000000 * (80 + j) // 100, 5000000000)) / 1000000.0, 3) AS jittered_ms FROM x"""))
def retry_backoff(t):
    a = attempts(t)
    return a.select("message_key", "seq", L.retry_delay_ms("seq", 250, 5000).alias("delay_ms"),
                    F.round(L.retry_delay_ms("seq", 250, 5000, "message_key"), 3).alias("jittered_ms"))


@query("retry_disposition", with_ctes("att", body="""
    SELECT message_key, seq, CASE WHEN NOT retryable OR seq >= retry_budget THEN 'ISOLATE' ELSE 'RETRY' END AS disposition FROM att WHERE outcome = 'FAILURE'"""))
def retry_disposition(t):
    a = attempts(t).where(F.col("outcome") == "FAILURE")
    return a.select("message_key", "seq", L.retry_disposition("seq", "retry_budget", "retryable").alias("disposition"))


CTE["dl"] = CTE["li"] + f""",
dl0 AS (SELECT *, {_CODE_SQL} AS error_code, l_returnflag <> 'R' AS retryable, 'payload-' || l_orderkey AS payload, l_linenumber % 3 = 0 AS is_replay,
   CASE WHEN l_suppkey % 4 <> 0 THEN 'm-' || l_orderkey END AS original_message_id, CASE WHEN l_suppkey % 5 <> 0 THEN l_orderkey * 10 END AS stream_sequence,
   CASE WHEN l_linenumber % 3 = 0 THEN 'root-' || (l_orderkey % 100) END AS root,
   CASE WHEN l_linenumber % 3 = 0 THEN (1 + l_orderkey % 4)::INTEGER END AS replay_attempt,
   CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey * 10 + 1 END AS replay_source FROM li),
dl1 AS (SELECT *, CASE WHEN is_replay THEN 'raw.persisted' WHEN l_linenumber = 7 THEN 'raw.other' ELSE 'raw.persisted' END AS original_subject,
   CASE WHEN is_replay THEN replay_source ELSE stream_sequence END AS seqno, sha256(payload) AS sha FROM dl0),
dl AS (SELECT *, CASE WHEN is_replay THEN 'normalization-dlq:v1:replay:' || root || ':' || replay_attempt || ':' || sha
   WHEN original_message_id IS NOT NULL THEN 'normalization-dlq:v1:' || original_message_id || ':' || sha
   WHEN seqno IS NOT NULL THEN 'normalization-dlq:v1:stream:' || seqno ELSE 'normalization-dlq:v1:payload:' || sha END AS dedup_id FROM dl1)"""


def failures(t):
    li = numbered_lines(t.read("lineitem"))
    again = F.col("l_linenumber") % 3 == 0
    key = F.col("l_orderkey")
    return li.select(
        "l_orderkey", "seq", F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("m-"), key.cast("string"))).alias("message_id"),
        F.when(again, "raw.replay").when(F.col("l_linenumber") == 7, "raw.other").otherwise("raw.persisted").alias("subject"),
        F.encode(F.concat(F.lit("payload-"), key.cast("string")), "UTF-8").alias("payload"),
        F.lit("normalizer").alias("consumer"), F.col("seq").alias("attempt_count"),
        F.when(F.col("l_suppkey") % 5 != 0, key * 10).alias("stream_sequence"),
        _code().alias("error_code"), (F.col("l_returnflag") != "R").alias("retryable"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("first_failure_ms"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("last_failure_ms"),
        F.concat(F.lit("tenant-"), (key % 3).cast("string")).alias("tenant_id"),
        F.when(again, F.concat(F.lit("root-"), (key % 100).cast("string"))).alias("replay_root_dlq_record_id"),
        F.when(again, 1 + key % 4).cast("int").alias("replay_attempt"),
        F.when(again, key * 10 + 1).alias("replay_source_sequence"))


@query("dead_letters", with_ctes("dl", body="""
    SELECT original_message_id, original_subject, sha AS original_payload_sha256, seqno AS stream_sequence, error_code, retryable,
      root AS replay_root_dlq_record_id, replay_attempt, dedup_id FROM dl"""))
def dead_letters(t):
    return L.dead_letters(failures(t)).select(
        "original_message_id", "original_subject", "original_payload_sha256", "stream_sequence", "error_code", "retryable",
        "replay_root_dlq_record_id", "replay_attempt", "dedup_id")


@query("dlq_dedup", with_ctes("dl", body="SELECT dedup_id, count(*) AS copies FROM dl GROUP BY 1"))
def dlq_dedup(t):
    return L.dead_letters(failures(t)).groupBy("dedup_id").agg(F.count(F.lit(1)).alias("copies"))


@query("dlq_sink", with_ctes("dl", body="SELECT DISTINCT dedup_id, sha256('dlq|' || dedup_id) AS dlq_record_id FROM dl"))
def dlq_sink(t):
    """Two appends of the same failures store every record once."""
    path = shared_dir(t.spark, "dlq")
    rows = L.dead_letters(failures(t))
    sinks.append_missing(rows, path, "dedup_id")
    return sinks.append_missing(rows, path, "dedup_id").select("dedup_id", "dlq_record_id")


def _records(t):
    """Dead letters with some damaged ones for the eligibility checks."""
    rows = failures(t)
    out = L.dead_letters(rows.withColumn("tenant_id", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("seq").cast("string"))))
    return out.withColumn("original_payload_sha256", F.when(F.col("attempt_count") == 5, F.upper("original_payload_sha256"))
                          .otherwise(F.col("original_payload_sha256")))


@query("replay_eligibility", with_ctes("dl", body="""
    x AS (SELECT *, l_orderkey || '/' || seq AS row_id, CASE WHEN seq = 5 AND regexp_matches(sha, '[a-f]') THEN 'INVALID_RECORD' WHEN original_subject <> 'raw.persisted' THEN 'UNSUPPORTED_ORIGIN'
        WHEN coalesce(seqno, 0) = 0 THEN 'SOURCE_UNAVAILABLE' WHEN NOT retryable THEN 'PERMANENT_FAILURE' ELSE 'ELIGIBLE' END AS reason FROM dl)
    SELECT row_id, reason, reason = 'ELIGIBLE' AS eligible,
      CASE WHEN reason IN ('ELIGIBLE', 'PERMANENT_FAILURE') THEN 'normalization-replay:v1:dlq:' || coalesce(root, sha256('dlq|' || dedup_id)) END AS lifecycle_key FROM x"""))
def replay_eligibility(t):
    return (L.replay_eligibility(_records(t), 3)
            .select(F.col("tenant_id").alias("row_id"), "reason", "eligible", "lifecycle_key"))


CTE["rq"] = CTE["li"] + """,
rq AS (SELECT l_orderkey, seq, 'life-' || (l_orderkey % 50) AS lifecycle_key, CASE WHEN l_linenumber = 6 AND l_orderkey % 11 = 0 THEN 'other' ELSE 'root-' || (l_orderkey % 50) END AS replay_root,
   (10 + l_orderkey % 50 % 7)::INTEGER AS max_attempts, 'dlq-' || (l_orderkey // 5) AS source_dlq_record_id,
   CASE WHEN l_linenumber = 5 THEN l_orderkey * 10 ELSE (l_orderkey // 5) * 10 END AS source_sequence FROM li)"""


def replay_requests(t):
    li = numbered_lines(t.read("lineitem"))
    key = F.col("l_orderkey")
    group = (key % 50).cast("string")
    return li.select(
        "l_orderkey", "seq", F.concat(F.lit("life-"), group).alias("lifecycle_key"),
        F.when((F.col("l_linenumber") == 6) & (key % 11 == 0), "other").otherwise(F.concat(F.lit("root-"), group)).alias("replay_root"),
        (10 + key % 50 % 7).cast("int").alias("max_attempts"),
        F.concat(F.lit("dlq-"), floor_div(key, 5).cast("string")).alias("source_dlq_record_id"),
        F.when(F.col("l_linenumber") == 5, key * 10).otherwise(floor_div(key, 5) * 10).alias("source_sequence"))


@query("replay_reserve", with_ctes("rq", body="""
    c AS (SELECT lifecycle_key, arg_min(replay_root, l_orderkey * 1000 + seq) AS root0, arg_min(max_attempts, l_orderkey * 1000 + seq) AS max0 FROM rq GROUP BY 1),
    r AS (SELECT rq.*, replay_root = root0 AND max_attempts = max0 AS ok FROM rq JOIN c USING (lifecycle_key)),
    f AS (SELECT lifecycle_key, source_dlq_record_id, min(l_orderkey * 1000 + seq) AS pos, arg_min(source_sequence, l_orderkey * 1000 + seq) AS s0, max(max_attempts) AS m FROM r WHERE ok GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY lifecycle_key ORDER BY pos) AS a FROM f),
    j AS (SELECT r.*, k.a, k.s0 FROM r LEFT JOIN k ON r.lifecycle_key = k.lifecycle_key AND r.source_dlq_record_id = k.source_dlq_record_id AND k.a <= k.m),
    s AS (SELECT *, CASE WHEN NOT ok THEN 'CONFLICT' WHEN a IS NOT NULL AND s0 <> source_sequence THEN 'CONFLICT' WHEN a IS NOT NULL THEN 'RESERVED' ELSE 'EXHAUSTED' END AS status FROM j)
    SELECT l_orderkey, seq, status, CASE status WHEN 'RESERVED' THEN a WHEN 'EXHAUSTED' THEN max_attempts END::INTEGER AS attempt FROM s"""))
def replay_reserve(t):
    return (L.replay_reserve(replay_requests(t), ["l_orderkey", "seq"])
            .select("l_orderkey", "seq", "status", "attempt"))


@query("replay_set", """
    WITH x AS (SELECT o_orderkey AS k, 'payload-' || o_orderkey AS payload FROM orders)
    SELECT 'dlq-' || k AS source_dlq_record_id, CASE WHEN k % 5 = 0 THEN 'SOURCE_UNAVAILABLE' WHEN k % 7 = 0 THEN 'SOURCE_SUBJECT_DIFFERS' WHEN k % 11 = 0 THEN 'SOURCE_HASH_DIFFERS' ELSE 'REPLAY' END AS status,
      CASE WHEN k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 0 THEN 'normalization-replay:v1:root-' || k || ':' || (1 + k % 3) END AS message_id,
      CASE WHEN k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 0 AND k % 2 = 0 THEN 'req-' || k END AS request_id,
      CASE WHEN k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 0 THEN sha256(payload) END AS payload_sha256 FROM x""")
def replay_set(t):
    k = F.col("o_orderkey")
    text = k.cast("string")
    payload = F.encode(F.concat(F.lit("payload-"), text), "UTF-8")
    o = t.read("orders")
    # Sequences that the stream no longer holds are numbered apart.
    stream = o.select(F.when(k % 5 == 0, -k - 1).otherwise(k).alias("sequence"),
                      F.when(k % 7 == 0, "raw.other").otherwise("raw.persisted").alias("subject"),
                      payload.alias("payload"),
                      F.when(k % 2 == 0, F.concat(F.lit("req-"), text)).otherwise("").alias("request_id"))
    reserved = o.select(
        k.alias("source_sequence"), F.concat(F.lit("root-"), text).alias("replay_root"),
        (1 + k % 3).cast("int").alias("attempt"), F.concat(F.lit("dlq-"), text).alias("source_dlq_record_id"),
        F.when(k % 11 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(payload, 256)).alias("source_payload_sha256"),
        F.lit("RESERVED").alias("status"))
    return L.replay_set(reserved, stream).select(
        "source_dlq_record_id", "status", F.col("headers")["Message-Id"].alias("message_id"),
        F.col("headers")["Request-Id"].alias("request_id"), F.sha2("payload", 256).alias("payload_sha256"))
