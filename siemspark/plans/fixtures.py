"""Security tables derived from the generic test tables.

Every view is a pure projection of a whole input table (see FIXTURES.md), so
the work of a query grows with its input.  ``CTE`` holds the same views for
the SQL side.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siemspark.functions.scalars import epoch_micros, floor_div

NORMALIZED_PREFIX = "018f47a2-4b00-7a00-8000-"
RAW_PREFIX = "018f47a2-4b00-7a00-8001-"


def hex12(c):
    return F.lpad(F.lower(F.hex(c)), 12, "0")


class Tables:
    """Lazy access to the input tables and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def normalized_events(self) -> DataFrame:
        return normalized_events(self.read("events"))

    @cached_property
    def raw_lines(self) -> DataFrame:
        return raw_lines(self.read("events"))

    @cached_property
    def dealt_lines(self) -> DataFrame:
        """The raw lines for costly work on each: the file's few splits are dealt to as many tasks as the rows ask for."""
        return raw_lines(dealt(self.read("events")))

    @cached_property
    def delivered_events(self) -> DataFrame:
        """Normalized events as delivered: every tenth one arrives twice."""
        copies = F.when(F.col("event_id") % 10 == 0, 2).otherwise(1)
        return (self.normalized_events
                .withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy"))

    @cached_property
    def altered_events(self) -> DataFrame:
        """As above, and the second copy of some events differs in content."""
        twice = (F.col("event_id") % 10 == 0) | (F.col("event_id") % 97 == 0)
        return (self.normalized_events
                .withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(twice, 2).otherwise(1))))
                .withColumn("status", F.when((F.col("copy") == 2) & (F.col("event_id") % 97 == 0),
                                             "Altered").otherwise(F.col("status")))
                .drop("copy"))


TASK_ROWS = 20_000


def dealt(rows: DataFrame) -> DataFrame:
    """All rows in tasks of about ``TASK_ROWS``."""
    return rows.repartition(max(1, -(-rows.count() // TASK_ROWS)))


def normalized_events(events: DataFrame) -> DataFrame:
    eid, uid, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    activity = (F.when(kind.isin("error", "signup"), "Logon")
                .when(kind == "purchase", "Privilege Escalation")
                .when(kind == "view", "Read").otherwise("Navigate"))
    status = F.when(kind == "error", "Failure").otherwise("Success")
    severity = (F.when(kind == "error", 4).when(kind == "purchase", 3)
                .when(kind == "signup", 2)).cast("long")
    user = F.when(uid % 17 != 16, F.concat(F.lit("user"), uid.cast("string")))
    ip = F.concat(F.lit("10.0."), (uid % 4).cast("string"), F.lit("."), (uid % 250).cast("string"))
    parser_version = F.when(eid % 2 == 0, "1").otherwise("2")
    base = events.withColumn("us", epoch_micros("ts"))
    seconds = floor_div("us", 1_000_000)
    user_json = (F.when(eid % 101 == 1, "")
                 .when(eid % 101 == 2, ',"user":{"name":null}')
                 .when(eid % 101 == 3, ',"user":{"name":7}')
                 .when(eid % 101 == 4, ',"user":5')
                 .when(eid % 101 == 5, ',"user":null')
                 .when(user.isNull(), ',"user":{}')
                 .otherwise(F.concat(F.lit(',"user":{"name":"'), user, F.lit('"}'))))
    time_json = (F.when(eid % 101 == 6, '"late"').when(eid % 101 == 7, "1.5")
                 .otherwise(floor_div("us", 1000).cast("string")))
    message = F.concat(kind, F.lit(" by "), F.coalesce(user, F.lit("nobody")))
    ocsf = F.concat(
        F.lit('{"activity_name":"'), activity, F.lit('","message":"'), message,
        F.lit('","service":{"name":"sshd"},"src_endpoint":{"ip":"'), ip,
        F.lit('"},"status":"'), status, F.lit('","time":'), time_json, user_json, F.lit("}"))
    return (base.select(
        eid,
        F.concat(F.lit("tenant-"), (uid % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit(NORMALIZED_PREFIX), hex12(eid)).alias("normalized_event_id"),
        F.concat(F.lit(RAW_PREFIX), hex12(eid)).alias("raw_event_id"),
        F.when(eid % 53 == 0, 0).otherwise(1).alias("event_time_present"),
        seconds.alias("event_time_seconds"),
        (F.pmod(F.col("us"), F.lit(1_000_000)) * 1000).cast("int").alias("event_time_nanos"),
        (seconds + eid % 7).alias("ingest_time_seconds"),
        (F.pmod(F.col("us"), F.lit(1_000_000)) * 1000).cast("int").alias("ingest_time_nanos"),
        F.lit("1.8.0").alias("ocsf_version"),
        F.lit(3002).cast("long").alias("class_uid"),
        F.lit(3).cast("long").alias("category_uid"),
        F.when(eid % 11 != 0, 1).cast("long").alias("activity_id"),
        severity.alias("severity"),
        activity.alias("activity_name"), status.alias("status"), user.alias("user_name"),
        ip.alias("src_ip"), F.lit("sshd").alias("service_name"), message.alias("message"),
        F.lit("linux.sshd").alias("parser_id"), parser_version.alias("parser_version"),
        F.lit("linux.ssh.auth").alias("mapping_id"), F.lit("1").alias("mapping_version"),
        F.when(eid % 29 == 0, "REPLAY").otherwise("LIVE").alias("execution_mode"),
        ocsf.alias("ocsf_event_json"))
        .withColumn("event_date", F.to_date(F.timestamp_seconds("event_time_seconds"))))


# The same views as DuckDB text.
CTE: dict[str, str] = {}

CTE["ne"] = f"""
ne0 AS (
 SELECT *, epoch_us(ts) AS us,
  CASE WHEN event_type IN ('error','signup') THEN 'Logon' WHEN event_type = 'purchase' THEN 'Privilege Escalation'
       WHEN event_type = 'view' THEN 'Read' ELSE 'Navigate' END AS activity_name,
  CASE WHEN event_type = 'error' THEN 'Failure' ELSE 'Success' END AS status,
  CASE WHEN user_id % 17 <> 16 THEN 'user' || user_id::VARCHAR END AS user_name,
  '10.0.' || (user_id % 4)::VARCHAR || '.' || (user_id % 250)::VARCHAR AS src_ip
 FROM events),
ne AS (
 SELECT event_id, 'tenant-' || (user_id % 3)::VARCHAR AS tenant_id,
  '{NORMALIZED_PREFIX}' || lpad(lower(to_hex(event_id)), 12, '0') AS normalized_event_id,
  '{RAW_PREFIX}' || lpad(lower(to_hex(event_id)), 12, '0') AS raw_event_id,
  CASE WHEN event_id % 53 = 0 THEN 0 ELSE 1 END AS event_time_present,
  us // 1000000 AS event_time_seconds,
  ((us % 1000000) * 1000)::INTEGER AS event_time_nanos,
  us // 1000000 + event_id % 7 AS ingest_time_seconds,
  ((us % 1000000) * 1000)::INTEGER AS ingest_time_nanos,
  '1.8.0' AS ocsf_version, 3002::BIGINT AS class_uid, 3::BIGINT AS category_uid,
  CASE WHEN event_id % 11 <> 0 THEN 1::BIGINT END AS activity_id,
  CASE event_type WHEN 'error' THEN 4::BIGINT WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 END AS severity,
  activity_name, status, user_name, src_ip, 'sshd' AS service_name,
  event_type || ' by ' || coalesce(user_name, 'nobody') AS message,
  'linux.sshd' AS parser_id, CASE WHEN event_id % 2 = 0 THEN '1' ELSE '2' END AS parser_version,
  'linux.ssh.auth' AS mapping_id, '1' AS mapping_version,
  CASE WHEN event_id % 29 = 0 THEN 'REPLAY' ELSE 'LIVE' END AS execution_mode,
  '{{"activity_name":"' || activity_name || '","message":"' || event_type || ' by ' || coalesce(user_name, 'nobody')
   || '","service":{{"name":"sshd"}},"src_endpoint":{{"ip":"' || src_ip || '"}},"status":"' || status || '","time":'
   || CASE event_id % 101 WHEN 6 THEN '"late"' WHEN 7 THEN '1.5' ELSE (us // 1000)::VARCHAR END
   || CASE event_id % 101 WHEN 1 THEN '' WHEN 2 THEN ',"user":{{"name":null}}' WHEN 3 THEN ',"user":{{"name":7}}'
        WHEN 4 THEN ',"user":5' WHEN 5 THEN ',"user":null'
        ELSE CASE WHEN user_name IS NULL THEN ',"user":{{}}' ELSE ',"user":{{"name":"' || user_name || '"}}' END END
   || '}}' AS ocsf_event_json,
  us // 1000 AS time_ms
 FROM ne0)"""


def with_ctes(*names: str, body: str) -> str:
    """One SQL text: the named views, then ``body``.

    ``body`` may open with further views, as ``x AS (...), y AS (...) SELECT``.
    """
    head = ",".join(CTE[n] for n in names)
    text = body.strip()
    glue = "\n" if text[:6].upper() == "SELECT" else ",\n"
    return f"WITH {head}{glue}{text}"


# --- raw log lines ---------------------------------------------------------

def raw_lines(events: DataFrame) -> DataFrame:
    """Log lines of six kinds, broken ones included, as raw records."""
    e = events.withColumn("us", epoch_micros("ts"))
    eid, uid = F.col("event_id"), F.col("user_id")
    n = floor_div("event_id", 6)
    ts = F.col("ts").cast("timestamp")

    def txt(c):
        return c.cast("string")

    def cat(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    user = cat("user", txt(uid))
    ip = cat("10.0.", txt(uid % 4), ".", txt(uid % 250))
    rfc = cat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), ".",
              F.lpad(txt(F.pmod(F.col("us"), F.lit(1_000_000))), 6, "0"), "Z")
    old = F.date_format(ts, "MMM dd HH:mm:ss")
    pri = cat("<", txt(eid % 192), ">")
    host = cat("host", txt(uid % 5))
    failed = cat("Failed password for ", F.when(eid % 18 == 0, "invalid user ").otherwise(""), user,
                 " from ", ip, " port ", txt(1024 + eid % 60000), " ssh2")
    sshd = F.when(eid % 12 == 6, cat("<38>", old, " ", host, " sshd[77]: ", failed)).otherwise(failed)
    app = cat("app", txt(uid % 7))
    tag = (F.when(n % 4 == 0, cat(app, ": ")).when(n % 4 == 1, "just text ")
           .when(n % 4 == 2, cat(app, "[", txt(eid % 1000), "]: ")).otherwise(cat(app, "[]:")))
    bsd = cat(pri, old, " ", host, " ", tag, "event ", F.col("event_type"))
    m = n % 8
    sd = (F.when(m == 1, '[ex@1 k="a]b" q="x\\"y"]').when(m == 2, '[a@1][b@2 z="1"]')
          .when(m == 7, '[a@1 k="x').otherwise("-"))
    stamp = F.when(m == 3, "-").when(m == 4, "2024-99-01T00:00:00Z").otherwise(rfc)
    ietf = cat(pri, F.when(m == 5, "2").otherwise("1"), " ", stamp, " ",
               F.when(m == 6, "-").otherwise(host), " ", app, " ", txt(eid % 1000), " ID",
               txt(eid % 50), " ", sd,
               F.when(m == 6, "").otherwise(cat(" msg ", F.col("event_type"), " end")))
    journal = cat('{"journald_version":', F.when(m == 5, "2").otherwise("1"), ',"cursor":',
                  F.when(m == 1, "null").otherwise(cat('"s=', txt(eid), '"')),
                  F.when(m == 4, ',"extra":1').otherwise(""),
                  ',"fields":[{"name":"MESSAGE","encoding":"utf8","value":"',
                  F.when(m == 7, failed).otherwise(cat("ran ", F.col("event_type"))),
                  '"},{"name":"_SOURCE_REALTIME_TIMESTAMP","encoding":"utf8","value":"',
                  F.when(m == 6, "12a").otherwise(txt(F.col("us"))),
                  '"},{"name":"DATA","encoding":"base64","value":"',
                  F.when(m == 3, "A*==").otherwise("AAEC"), '"}]}')
    j = n % 6
    generic = (F.when(j == 0, cat('{"event_time":"', rfc, '","user":"', user, '"}'))
               .when(j == 1, cat('{"timestamp":"01/02/2024","n":123456789012345678901234567890,"u":', txt(uid), "}"))
               .when(j == 2, cat('{"@timestamp":', txt(floor_div("us", 1_000_000)), ',"a":[1.50,1e2,-0,1E400]}'))
               .when(j == 3, "[1,2,3]")
               .when(j == 4, cat('{"b":{"z":1,"a":"', F.col("event_type"), '"},"a":null}'))
               .otherwise(cat('{"event_time":"', rfc, '","timestamp":5}')))
    broken = (F.when(j == 0, '{"a":')
              .when(j == 1, "Failed password for root from 10.0.0.1 port 999999 ssh2")
              .when(j == 2, "<999>Jan 01 00:00:00 h a: x").when(j == 3, "plain junk")
              .when(j == 4, "Failed password for x from 1.2.3.4 port 22.0 y").otherwise('{"a":1'))
    k = eid % 6
    text = (F.when(k == 0, sshd).when(k == 1, bsd).when(k == 2, ietf).when(k == 3, journal)
            .when(k == 4, generic).otherwise(broken))
    seconds = floor_div("us", 1_000_000)
    nanos = (F.pmod(F.col("us"), F.lit(1_000_000)) * 1000).cast("int")
    has_time = eid % 3 != 0
    return e.withColumn("text", text).select(
        eid, F.concat(F.lit(RAW_PREFIX), hex12(eid)).alias("raw_event_id"),
        cat("tenant-", txt(uid % 3)).alias("tenant_id"),
        cat("source-", txt(uid % 5)).alias("source_id"),
        F.when(eid % 13 != 0, cat("sensor-", txt(uid % 2))).alias("sensor_id"),
        F.when(k.isin(3, 4) | ((k == 5) & (j == 5)), "application/json").otherwise("text/plain")
        .alias("content_type"),
        F.encode("text", "UTF-8").alias("payload"),
        F.when(eid % 71 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256)).alias("raw_hash"),
        F.lit("sha256").alias("raw_hash_algorithm"),
        (F.octet_length("text") + F.when(eid % 73 == 0, 1).otherwise(0)).cast("long").alias("raw_size"),
        F.when(has_time, seconds).alias("event_time_seconds"),
        F.when(has_time, nanos).alias("event_time_nanos"),
        (seconds + eid % 7).alias("ingest_time_seconds"), nanos.alias("ingest_time_nanos"),
        (seconds + 10).alias("persisted_at_seconds"), F.lit(0).alias("persisted_at_nanos"),
        F.when(eid % 2 == 0, "tcp").otherwise("http").alias("transport"),
        F.when(eid % 89 == 0, "").otherwise(ip).alias("remote_identity"))


CTE["rl"] = f"""
rl0 AS (
 SELECT *, epoch_us(ts) AS us, event_id // 6 AS n, event_id % 6 AS k,
  'user' || user_id::VARCHAR AS usr, '10.0.' || (user_id % 4)::VARCHAR || '.' || (user_id % 250)::VARCHAR AS ip,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') || 'Z' AS rfc,
  strftime(ts, '%b %d %H:%M:%S') AS old, '<' || (event_id % 192)::VARCHAR || '>' AS pri,
  'host' || (user_id % 5)::VARCHAR AS host, 'app' || (user_id % 7)::VARCHAR AS app,
  'Failed password for ' || CASE WHEN event_id % 18 = 0 THEN 'invalid user ' ELSE '' END || 'user' || user_id::VARCHAR
   || ' from 10.0.' || (user_id % 4)::VARCHAR || '.' || (user_id % 250)::VARCHAR || ' port ' || (1024 + event_id % 60000)::VARCHAR || ' ssh2' AS failed
 FROM events),
rl1 AS (SELECT *, CASE k
  WHEN 0 THEN CASE WHEN event_id % 12 = 6 THEN '<38>' || old || ' ' || host || ' sshd[77]: ' || failed ELSE failed END
  WHEN 1 THEN pri || old || ' ' || host || ' ' || CASE n % 4 WHEN 0 THEN app || ': ' WHEN 1 THEN 'just text '
     WHEN 2 THEN app || '[' || (event_id % 1000)::VARCHAR || ']: ' ELSE app || '[]:' END || 'event ' || event_type
  WHEN 2 THEN pri || CASE n % 8 WHEN 5 THEN '2' ELSE '1' END || ' ' || CASE n % 8 WHEN 3 THEN '-' WHEN 4 THEN '2024-99-01T00:00:00Z' ELSE rfc END
     || ' ' || CASE n % 8 WHEN 6 THEN '-' ELSE host END || ' ' || app || ' ' || (event_id % 1000)::VARCHAR || ' ID' || (event_id % 50)::VARCHAR || ' '
     || CASE n % 8 WHEN 1 THEN '[ex@1 k="a]b" q="x\\"y"]' WHEN 2 THEN '[a@1][b@2 z="1"]' WHEN 7 THEN '[a@1 k="x' ELSE '-' END
     || CASE n % 8 WHEN 6 THEN '' ELSE ' msg ' || event_type || ' end' END
  WHEN 3 THEN '{{"journald_version":' || CASE n % 8 WHEN 5 THEN '2' ELSE '1' END || ',"cursor":' || CASE n % 8 WHEN 1 THEN 'null' ELSE '"s=' || event_id::VARCHAR || '"' END
     || CASE n % 8 WHEN 4 THEN ',"extra":1' ELSE '' END || ',"fields":[{{"name":"MESSAGE","encoding":"utf8","value":"'
     || CASE n % 8 WHEN 7 THEN failed ELSE 'ran ' || event_type END || '"}},{{"name":"_SOURCE_REALTIME_TIMESTAMP","encoding":"utf8","value":"'
     || CASE n % 8 WHEN 6 THEN '12a' ELSE us::VARCHAR END || '"}},{{"name":"DATA","encoding":"base64","value":"' || CASE n % 8 WHEN 3 THEN 'A*==' ELSE 'AAEC' END || '"}}]}}'
  WHEN 4 THEN CASE n % 6 WHEN 0 THEN '{{"event_time":"' || rfc || '","user":"' || usr || '"}}'
     WHEN 1 THEN '{{"timestamp":"01/02/2024","n":123456789012345678901234567890,"u":' || user_id::VARCHAR || '}}'
     WHEN 2 THEN '{{"@timestamp":' || (us // 1000000)::VARCHAR || ',"a":[1.50,1e2,-0,1E400]}}' WHEN 3 THEN '[1,2,3]'
     WHEN 4 THEN '{{"b":{{"z":1,"a":"' || event_type || '"}},"a":null}}' ELSE '{{"event_time":"' || rfc || '","timestamp":5}}' END
  ELSE CASE n % 6 WHEN 0 THEN '{{"a":' WHEN 1 THEN 'Failed password for root from 10.0.0.1 port 999999 ssh2'
     WHEN 2 THEN '<999>Jan 01 00:00:00 h a: x' WHEN 3 THEN 'plain junk' WHEN 4 THEN 'Failed password for x from 1.2.3.4 port 22.0 y' ELSE '{{"a":1' END
  END AS text FROM rl0),
rl AS (
 SELECT *, '{RAW_PREFIX}' || lpad(lower(to_hex(event_id)), 12, '0') AS raw_event_id,
  'tenant-' || (user_id % 3)::VARCHAR AS tenant_id, 'source-' || (user_id % 5)::VARCHAR AS source_id,
  CASE WHEN event_id % 13 <> 0 THEN 'sensor-' || (user_id % 2)::VARCHAR END AS sensor_id,
  CASE WHEN k IN (3, 4) OR (k = 5 AND n % 6 = 5) THEN 'application/json' ELSE 'text/plain' END AS content_type,
  CASE WHEN event_id % 71 = 0 THEN sha256('other') ELSE sha256(text) END AS raw_hash,
  (strlen(text) + CASE WHEN event_id % 73 = 0 THEN 1 ELSE 0 END)::BIGINT AS raw_size,
  CASE WHEN event_id % 3 <> 0 THEN us // 1000000 END AS event_time_seconds,
  CASE WHEN event_id % 3 <> 0 THEN ((us % 1000000) * 1000)::INTEGER END AS event_time_nanos,
  us // 1000000 + event_id % 7 AS ingest_time_seconds, ((us % 1000000) * 1000)::INTEGER AS ingest_time_nanos,
  us // 1000000 + 10 AS persisted_at_seconds,
  CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'http' END AS transport,
  CASE WHEN event_id % 89 = 0 THEN '' ELSE ip END AS remote_identity
 FROM rl1)"""


# --- operations ------------------------------------------------------------

_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
               "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def numbered_lines(lineitem: DataFrame) -> DataFrame:
    """Order lines with their position in the order (``seq``)."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    return lineitem.withColumn("seq", F.row_number().over(w))


CTE["li"] = f"""
li AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE_ORDER)}))::INTEGER AS seq FROM lineitem)"""
