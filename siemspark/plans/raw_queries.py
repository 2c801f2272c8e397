"""Raw evidence queries: intake, checks, delivery, manifests, gaps, outbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from siemspark.functions.scalars import floor_div
from siemspark.operators import raw as R
from siemspark.plans.fixtures import CTE, with_ctes
from siemspark.plans.registry import query
from siemspark.session import shared_dir
from siemspark.sources import journal, sinks



def _id_sql(key: str) -> str:
    return (f"substr({key},1,8) || '-' || substr({key},9,4) || '-7' || substr({key},13,3) || '-8' || "
            f"substr({key},16,3) || '-' || substr({key},19,12)")


def raw(t):
    """Raw records under the column names of the raw contract."""
    return t.raw_lines.withColumn("n", F.col("event_id")).drop("event_id").withColumnRenamed("raw_event_id", "event_id")


CTE["rx"] = CTE["rl"] + """,
rx AS (SELECT * EXCLUDE (event_id, n), raw_event_id AS event_id, event_id AS n FROM rl)"""


@query("raw_intake", with_ctes("rl", body=f"""
    x AS (SELECT *, sha256(source_id || chr(10) || ingest_time_seconds || chr(10) || ingest_time_nanos || chr(10) || sha256(text)) AS key FROM rl)
    SELECT raw_event_id, {_id_sql('key')} AS new_id, sha256(text) AS raw_hash, strlen(text)::BIGINT AS raw_size FROM x"""))
def raw_intake(t):
    lines = t.raw_lines.select("raw_event_id", "source_id", "ingest_time_seconds", "ingest_time_nanos", "payload")
    return (R.raw_intake(lines, ["source_id", "ingest_time_seconds", "ingest_time_nanos"])
            .select("raw_event_id", F.col("event_id").alias("new_id"), "raw_hash", "raw_size"))


@query("raw_admission", with_ctes("rl", body="""
    SELECT raw_event_id, CASE WHEN remote_identity = '' THEN 'remote_identity' WHEN sensor_id IS NULL THEN 'sensor_id'
      WHEN strlen(text) > 200 THEN 'raw_payload' END AS reason FROM rl"""))
def raw_admission(t):
    return t.raw_lines.select("raw_event_id", R.admission_reason(200).alias("reason"))


@query("json_intake", with_ctes("rl", body="""
    SELECT raw_event_id, CASE WHEN content_type <> 'application/json' THEN 'unsupported_media_type' WHEN strlen(text) > 250 THEN 'payload_too_large'
      WHEN NOT json_valid(text) THEN 'invalid_json' END AS reason FROM rl"""))
def json_intake(t):
    kind = F.when(F.col("content_type") == "application/json", "Application/JSON; charset=utf-8").otherwise(F.col("content_type"))
    return t.raw_lines.select("raw_event_id", R.json_reason(kind, "payload", 250).alias("reason"))


@query("syslog_intake", """
    WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
    SELECT doc_id, line_no::INTEGER AS line_no, sha256(line) AS raw_hash, strlen(line)::BIGINT AS raw_size FROM x""")
def syslog_intake(t):
    """Every line of every text is one framed message, bytes untouched."""
    lines = R.framed_lines(t.read("documents"), "text", ["doc_id"])
    return R.raw_intake(lines, ["doc_id", "line_no"]).select("doc_id", "line_no", "raw_hash", "raw_size")


@query("journald_entries", """
    WITH x AS (SELECT event_id, event_id % 4 = 0 AS has_cursor, event_id % 7 = 0 AS is_bin, event_id % 9 = 0 AS bad, event_type FROM events)
    SELECT event_id, CASE WHEN has_cursor THEN 's=' || event_id END AS cursor, CASE WHEN bad THEN 'invalid field name' END AS error,
      CASE WHEN NOT bad THEN '{"journald_version":1,"cursor":' || CASE WHEN has_cursor THEN '"s=' || event_id || '"' ELSE 'null' END || ',"fields":['
        || CASE WHEN has_cursor THEN '{"name":"__CURSOR","encoding":"utf8","value":"s=' || event_id || '"},' ELSE '' END
        || '{"name":"MESSAGE","encoding":"utf8","value":"a=b \\u003c' || event_type || '\\u003e \\u0026 c"}'
        || CASE WHEN is_bin THEN ',{"name":"DATA","encoding":"base64","value":"/wB4"}' ELSE '' END || ']}' END AS canonical
    FROM x""")
def journald_entries(t):
    """Export blocks built from every event and read back as canonical JSON."""
    text = F.concat(
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("__CURSOR=s="), F.col("event_id").cast("string"), F.lit("\n"))).otherwise(""),
        F.when(F.col("event_id") % 9 == 0, "bad-name=1\n").otherwise(""),
        F.lit("MESSAGE=a=b <"), F.col("event_type"), F.lit("> & c\n"))
    tail = F.when(F.col("event_id") % 7 == 0, F.concat(F.encode(F.lit("DATA="), "UTF-8"), F.unhex(F.lit("FF00780A")))) \
        .otherwise(F.unhex(F.lit("")))
    blocks = t.read("events").select("event_id", F.concat(F.encode(text, "UTF-8"), tail).alias("entry"))
    return journal.journal_entries(blocks, "entry").select("event_id", "cursor", "error", "canonical")


@query("journald_shape", """
    SELECT event_id, event_id % 5 IN (1, 2) AS valid FROM events""")
def journald_shape(t):
    """Rows hold a field map, raw bytes, both, neither or an empty map."""
    m = F.col("event_id") % 5
    fields = F.when(m.isin(1, 3), F.create_map(F.lit("MESSAGE"), F.col("event_type"))) \
        .when(m == 4, F.create_map().cast("map<string,string>"))
    shaped = t.read("events").select(
        "event_id", fields.alias("fields"),
        F.when(m.isin(2, 3), F.encode("event_type", "UTF-8")).alias("raw"))
    return shaped.select("event_id", journal.one_evidence_form("fields", "raw").alias("valid"))


@query("raw_verify", with_ctes("rx", body="""
    SELECT event_id, CASE WHEN n % 73 = 0 THEN 'raw_size' WHEN n % 71 = 0 THEN 'raw_hash' END AS violation FROM rx"""))
def raw_verify(t):
    return raw(t).select("event_id", R.raw_violation().alias("violation"))


CTE["loc"] = CTE["rx"] + """,
loc AS (SELECT *, 'raw:///' || tenant_id || '/' || event_id || '/data' AS storage_uri FROM rx)"""


def objects(t):
    """Where each record was stored."""
    return raw(t).select(
        "event_id", "n", F.concat(F.lit("raw:///"), "tenant_id", F.lit("/"), "event_id", F.lit("/data")).alias("storage_uri"),
        F.col("event_id").alias("segment_id"), F.lit(0).cast("long").alias("offset"),
        F.octet_length("payload").cast("long").alias("length"),
        "persisted_at_seconds", "persisted_at_nanos")


@query("raw_persisted", with_ctes("loc", body="""
    SELECT event_id, tenant_id, source_id, raw_size, raw_hash, storage_uri, event_id AS segment_id, 0::BIGINT AS "offset",
      strlen(text)::BIGINT AS length, 'msg-' || n AS causation_id, '1' AS pipeline_version FROM loc"""))
def raw_persisted(t):
    rows = raw(t).withColumn("message_id", F.concat(F.lit("msg-"), F.col("n").cast("string")))
    return R.raw_persisted(rows, objects(t)).select(
        "event_id", "tenant_id", "source_id", "raw_size", "raw_hash", "storage_uri", "segment_id",
        "offset", "length", "causation_id", "pipeline_version")


@query("persisted_verify", with_ctes("loc", body="""
    SELECT event_id, CASE WHEN n % 17 = 0 THEN 'storage_uri' WHEN n % 19 = 0 THEN 'persisted_at'
      WHEN n % 23 = 0 THEN 'raw_hash' WHEN n % 73 = 0 THEN 'length' END AS violation FROM loc"""))
def persisted_verify(t):
    n = F.col("causation_id").cast("long")
    rows = R.raw_persisted(raw(t).withColumn("message_id", F.col("n").cast("string")), objects(t)).withColumns({
        "storage_uri": F.when(n % 17 == 0, "").otherwise(F.col("storage_uri")),
        "persisted_at_nanos": F.when(n % 19 == 0, -1).otherwise(F.col("persisted_at_nanos")),
        "raw_hash": F.when(n % 23 == 0, F.upper("raw_hash")).otherwise(F.col("raw_hash"))})
    return rows.select("event_id", R.persisted_violation().alias("violation"))


def envelopes(t):
    return raw(t).select(
        "event_id", "tenant_id", "n", F.when(F.col("n") % 17 == 0, "2").otherwise("1").alias("contract_version"),
        F.when(F.col("n") % 19 == 0, "no-uuid").otherwise(F.col("event_id")).alias("message_id"),
        F.when(F.col("n") % 23 == 0, "Other").otherwise("RawEvent").alias("message_type"),
        F.when(F.col("n") % 29 == 0, "Tenant").otherwise(F.col("tenant_id")).alias("envelope_tenant_id"),
        F.struct(F.lit("intake").alias("component"),
                 F.when(F.col("n") % 31 == 0, "").otherwise("1").alias("component_version")).alias("producer"),
        F.col("ingest_time_seconds").alias("emitted_at_seconds"), F.col("ingest_time_nanos").alias("emitted_at_nanos"),
        F.lit("raw_event.v1").alias("payload_schema"), (F.col("n") % 37 != 0).alias("has_payload"))


@query("envelope_verify", with_ctes("rx", body="""
    SELECT event_id, CASE WHEN n % 17 = 0 THEN 'contract_version' WHEN n % 19 = 0 THEN 'message_id'
      WHEN n % 31 = 0 THEN 'producer.component_version' WHEN n % 37 = 0 THEN 'payload' END AS violation FROM rx"""))
def envelope_verify(t):
    return envelopes(t).select("event_id", R.envelope_violation().alias("violation"))


@query("handoff_verify", with_ctes("rx", body="""
    SELECT event_id, CASE WHEN n % 23 = 0 THEN 'message_type' WHEN n % 29 = 0 THEN 'tenant_differs' END AS violation FROM rx"""))
def handoff_verify(t):
    return envelopes(t).select("event_id", R.handoff_violation().alias("violation"))


@query("delivery_disposition", with_ctes("rx", body="""
    d AS (SELECT *, unnest(CASE WHEN n % 10 = 0 THEN [1, 2] ELSE [1] END) AS delivery FROM rx)
    SELECT event_id, delivery::INTEGER AS delivery, CASE WHEN transport <> 'tcp' THEN 'PRESERVE' WHEN n % 46 = 0 THEN 'ISOLATE'
      WHEN n % 4 = 0 THEN 'ACK' ELSE 'REPUBLISH' END AS disposition FROM d"""))
def delivery_disposition(t):
    """Records that came over tcp were processed before, part of them published."""
    rows = raw(t).select("event_id", "n", "transport", "raw_hash", F.lit("preserver").alias("consumer"),
                         F.concat(F.lit("msg-"), F.col("n").cast("string")).alias("message_id"))
    deliveries = rows.withColumn("delivery", F.explode(F.when(F.col("n") % 10 == 0, F.array(F.lit(1), F.lit(2)))
                                                       .otherwise(F.array(F.lit(1)))))
    processed = rows.where(F.col("transport") == "tcp").select(
        "consumer", "message_id", "event_id",
        F.when(F.col("n") % 46 == 0, F.sha2("raw_hash", 256)).otherwise(F.col("raw_hash")).alias("raw_hash"),
        (F.col("n") % 4 == 0).alias("published"))
    return R.delivery_disposition(deliveries, processed).select("event_id", "delivery", "disposition")


@query("locator_conflicts", with_ctes("loc", body="""
    SELECT event_id, 2::BIGINT AS rows FROM loc WHERE n % 97 = 0"""))
def locator_conflicts(t):
    base = objects(t)
    again = base.withColumn("storage_uri", F.when(F.col("n") % 97 == 0, F.concat("storage_uri", F.lit("2")))
                            .otherwise(F.col("storage_uri")))
    return R.locator_conflicts(base.unionByName(again).drop("n"))


@query("raw_fetch", with_ctes("loc", body="""
    SELECT event_id, CASE WHEN n % 41 = 0 THEN 'NORM-RAW-URI' WHEN n % 43 = 0 THEN 'NORM-RAW-READ' END AS error_code,
      CASE WHEN n % 41 <> 0 AND n % 43 <> 0 THEN sha256(substr(text, 3)) END AS hash FROM loc"""))
def raw_fetch(t):
    n = F.col("n")
    places = objects(t).select(
        "event_id", "n", F.when(n % 41 == 0, F.concat(F.lit("raw:///a/../"), "event_id"))
        .otherwise(F.col("storage_uri")).alias("storage_uri"), F.lit(2).cast("long").alias("offset"),
        (F.col("length") - F.when(n % 43 == 0, 1).otherwise(2)).alias("length"))
    store = raw(t).select(F.concat(F.lit("raw:///"), "tenant_id", F.lit("/"), "event_id", F.lit("/data")).alias("storage_uri"),
                          F.col("payload").alias("object"))
    return R.raw_fetch(places, store).select("event_id", "error_code", F.sha2("payload", 256).alias("hash"))


@query("raw_reverify", with_ctes("rx", body="""
    SELECT event_id, CASE WHEN n % 73 = 0 THEN 'NORM-RAW-LENGTH' WHEN n % 71 = 0 THEN 'NORM-RAW-HASH' END AS error_code FROM rx"""))
def raw_reverify(t):
    return raw(t).select("event_id", R.reverify_code().alias("error_code"))


CTE["man"] = CTE["rx"] + """,
man AS (SELECT event_id, n, tenant_id, raw_hash, '{"manifest_version":1,"segment_id":"' || event_id || '","tenant_id":"' || tenant_id
  || '","event_count":1,"first_event_id":"' || event_id || '","last_event_id":"' || event_id || '","created_at":"'
  || strftime(make_timestamp(persisted_at_seconds * 1000000), '%Y-%m-%dT%H:%M:%S') || 'Z","previous_segment_hash":null,"content_hash":"sha256:' || raw_hash || '"}' || chr(10) AS manifest FROM rx)"""


@query("segment_manifest", with_ctes("man", body="""
    SELECT event_id AS segment_id, manifest, sha256(manifest) AS manifest_hash FROM man"""))
def segment_manifest(t):
    return R.segment_manifests(raw(t)).select("segment_id", "manifest", "manifest_hash")


@query("manifest_verify", with_ctes("man", body="""
    SELECT event_id, CASE n % 10 WHEN 1 THEN 'line_feed' WHEN 2 THEN 'canonical_form' WHEN 3 THEN 'identity'
      WHEN 4 THEN 'manifest_hash' WHEN 5 THEN 'content_hash' END AS violation FROM man"""))
def manifest_verify(t):
    stored = R.segment_manifests(raw(t)).withColumnRenamed("segment_id", "event_id")
    rows = stored.join(raw(t).select("event_id", "n"), "event_id")
    m, text = F.col("n") % 10, F.col("manifest")
    rows = rows.withColumns({
        "manifest": F.when(m == 1, F.concat(text, F.lit("\n"))).when(m == 2, F.replace(text, F.lit(","), F.lit(", ")))
        .otherwise(text),
        "tenant_id": F.when(m == 3, "other").otherwise(F.col("tenant_id")),
        "manifest_hash": F.when(m == 4, F.lit("00")).otherwise(F.col("manifest_hash")),
        "raw_hash": F.when(m == 5, F.lit("00")).otherwise(F.col("raw_hash"))})
    return rows.select("event_id", R.manifest_violation().alias("violation"))


@query("source_gaps", """
    WITH s AS (SELECT 'tenant-' || (o_custkey % 3) AS tenant_id, 'source-' || (o_custkey % 10) AS source_id, o_orderkey AS seq,
        o_orderkey - (o_orderkey % 7) * 5 AS arrival FROM orders),
    p AS (SELECT *, max(seq) OVER (PARTITION BY tenant_id, source_id ORDER BY arrival, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s)
    SELECT tenant_id, source_id, prev + 1 AS expected_sequence, seq AS observed_sequence FROM p WHERE seq > prev + 1""")
def source_gaps(t):
    rows = t.read("orders").select(
        F.concat(F.lit("tenant-"), (F.col("o_custkey") % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("source-"), (F.col("o_custkey") % 10).cast("string")).alias("source_id"),
        F.col("o_orderkey").alias("seq"),
        (F.col("o_orderkey") - (F.col("o_orderkey") % 7) * 5).alias("arrival"))
    return R.source_gaps(rows, ["tenant_id", "source_id"], "seq", ["arrival", "seq"], floor_div("arrival", 1_000))


@query("ingest_metrics", with_ctes("rl", body="""
    x AS (SELECT *, CASE WHEN remote_identity = '' THEN 'remote_identity' WHEN sensor_id IS NULL THEN 'sensor_id'
      WHEN strlen(text) > 200 THEN 'raw_payload' END AS reason FROM rl)
    SELECT tenant_id, source_id, count(*) AS received, count(*) FILTER (reason IS NULL) AS accepted,
      count(*) FILTER (reason IS NOT NULL) AS rejected, sum(strlen(text))::BIGINT AS bytes_received,
      count(*) FILTER (reason = 'raw_payload') AS payload_too_large,
      count(*) FILTER (reason IN ('remote_identity', 'sensor_id')) AS invalid_metadata FROM x GROUP BY ALL"""))
def ingest_metrics(t):
    rows = t.raw_lines.withColumn("reason", R.admission_reason(200))
    return R.ingest_metrics(rows, ["tenant_id", "source_id"])


def _outbox(t):
    return R.outbox_rows(raw(t), "raw.persisted", R.PERSISTED_TYPE, R.PERSISTED_SCHEMA, "event_id")


CTE["obx"] = CTE["rx"] + f""",
obx0 AS (SELECT *, sha256('raw.persisted|' || event_id) AS key FROM rx),
obx AS (SELECT *, {_id_sql('key')} AS message_id FROM obx0)"""


@query("outbox_rows", with_ctes("obx", body="""
    SELECT message_id, 'raw.persisted' AS subject, 'RawEventPersisted' AS message_type, tenant_id,
      'raw_event_persisted.v1' AS payload_schema, event_id AS object_key FROM obx"""))
def outbox_rows(t):
    return _outbox(t).select("message_id", "subject", "message_type", "tenant_id", "payload_schema", "object_key")


def _publications(t):
    """Some messages were published once, some twice, the others not yet."""
    times = (F.when(F.col("n") % 4 == 0, F.array(F.lit(50), F.lit(20)))
             .when(F.col("n") % 4 == 1, F.array(F.lit(30))).otherwise(F.array().cast("array<int>")))
    ids = _outbox(t).select("message_id", F.col("object_key").alias("event_id"))
    return (raw(t).select("event_id", F.explode(times).alias("after"), "ingest_time_seconds").join(ids, "event_id")
            .select("message_id", (F.col("ingest_time_seconds") * 1000 + F.col("after")).alias("published_ms")))


@query("outbox_pending", with_ctes("obx", body="""
    SELECT message_id, CASE n % 4 WHEN 0 THEN ingest_time_seconds * 1000 + 20 WHEN 1 THEN ingest_time_seconds * 1000 + 30 END AS published_ms,
      n % 4 >= 2 AS pending FROM obx"""))
def outbox_pending(t):
    return R.outbox_state(_outbox(t).select("message_id"), _publications(t)).select(
        "message_id", "published_ms", F.col("published_ms").isNull().alias("pending"))


@query("preservation_record", with_ctes("obx", body="""
    SELECT 'msg-' || n AS incoming_message_id, event_id, message_id AS outgoing_message_id,
      'raw:///' || tenant_id || '/' || event_id || '/data' AS storage_uri FROM obx"""))
def preservation_record(t):
    out = _outbox(t).select("message_id", F.col("object_key"))
    processed = (raw(t).select("event_id", F.concat(F.lit("msg-"), F.col("n").cast("string")).alias("incoming_message_id"))
                 .join(out.select(F.col("message_id").alias("outgoing_message_id"),
                                  F.col("object_key").alias("event_id")), "event_id"))
    rows = R.preservation_records(processed, objects(t).select("event_id", "storage_uri"), out)
    return rows.select("incoming_message_id", "event_id", "outgoing_message_id", "storage_uri")


@query("outbox_append", with_ctes("obx", body="SELECT message_id, object_key AS event_id, 1::BIGINT AS copies FROM (SELECT message_id, event_id AS object_key FROM obx)"))
def outbox_append(t):
    """Writing the outbox twice stores every message once."""
    path = shared_dir(t.spark, "outbox")
    rows = _outbox(t).drop("producer")
    sinks.append_missing(rows, path, "message_id")
    table = sinks.append_missing(rows, path, "message_id")
    return (table.groupBy("message_id", F.col("object_key").alias("event_id"))
            .agg(F.count(F.lit(1)).alias("copies")))
