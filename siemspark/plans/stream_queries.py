"""Streaming queries: the input arrives in three parts, in time order.

Each part is written as new files and a stream with a kept checkpoint is run
over what is new, so every query also restarts twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siemspark.functions.predicates import rule_predicate
from siemspark.functions.scalars import floor_div
from siemspark.operators import detect as D
from siemspark.plans.detect_queries import DAY_MS, PACK, live
from siemspark.plans.fixtures import with_ctes
from siemspark.plans.normalize_queries import CLOCK_MS, POLICIES
from siemspark.plans.registry import query
from siemspark.session import shared_dir
from siemspark.sources.sinks import read_table
from siemspark.streaming import jobs
from siemspark.streaming.state import GapTracker, Matcher

PARTS = 3


def staged(t, df, order, run, flush=None):
    """Writes ``df`` in PARTS steps along ``order`` and runs the stream after each."""
    spark, path = t.spark, shared_dir(t.spark, "arrivals")
    low, high = df.agg(F.min(order), F.max(order)).first()
    step = (high - low) // PARTS + 1
    part = floor_div(F.col(order) - low, step)
    stored = shared_dir(t.spark, "parts")
    df.withColumn("_part", part).write.partitionBy("_part").parquet(stored)
    for i in range(PARTS):
        spark.read.schema(df.schema).parquet(f"{stored}/_part={i}").write.mode("append").parquet(path)
        for q in run(spark.readStream.schema(df.schema).parquet(path)):
            q.awaitTermination()
    if flush:
        flush()


def appended(t, df, order, shape, lateness_mode="append"):
    """Runs ``shape(stream)`` into a Parquet sink and returns what it wrote."""
    out, check = shared_dir(t.spark, "out"), shared_dir(t.spark, "check")
    schema = []

    def run(stream):
        result = shape(stream)
        schema[:] = [result.schema]
        return [result.writeStream.format("parquet").outputMode(lateness_mode).option("path", out)
                .option("checkpointLocation", check).trigger(availableNow=True).start()]

    staged(t, df, order, run)
    return read_table(t.spark, out, schema[0])


@query("stream_event_signals", with_ctes("esid", body="SELECT signal_id, tenant_id, rule_id, time_ms AS first_ms FROM esid"))
def stream_event_signals(t):
    def shape(stream):
        return D.event_signals(stream, PACK.events, "LIVE").select("signal_id", "tenant_id", "rule_id", "first_ms")

    return appended(t, live(t), "event_time_ms", shape)


@query("stream_dedup", with_ctes("ne", body="""
    SELECT normalized_event_id, tenant_id, status FROM ne"""))
def stream_dedup(t):
    """Repeats arrive in the same part or in a later one."""
    twice = t.delivered_events.select("normalized_event_id", "tenant_id", "status", "event_time_seconds",
                                      F.timestamp_seconds("event_time_seconds").alias("ts"))
    out = appended(t, twice, "event_time_seconds",
                   lambda s: jobs.drop_repeats(s, "normalized_event_id", "ts", "40 days"))
    return out.select("normalized_event_id", "tenant_id", "status")


@query("stream_source_gaps", """
    WITH s AS (SELECT 'source-' || (o_custkey % 10) AS source_id, o_orderkey AS seq, o_orderkey - (o_orderkey % 7) * 5 AS arrival FROM orders),
    p AS (SELECT *, max(seq) OVER (PARTITION BY source_id ORDER BY arrival, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s)
    SELECT source_id, prev + 1 AS expected_sequence, seq AS observed_sequence FROM p WHERE seq > prev + 1""")
def stream_source_gaps(t):
    rows = t.read("orders").select(
        F.concat(F.lit("source-"), (F.col("o_custkey") % 10).cast("string")).alias("source_id"),
        F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") - (F.col("o_orderkey") % 7) * 5).alias("arrival"))
    tracker = GapTracker(shared_dir(t.spark, "gaps"), ["source_id"], "seq", ["arrival", "seq"],
                         lambda: floor_div("arrival", 1_000))
    check = shared_dir(t.spark, "check")
    staged(t, rows, "arrival", lambda s: [jobs.start_batches(s, tracker.process, check)])
    return tracker.gaps(t.spark).select("source_id", "expected_sequence", "observed_sequence")


@query("stream_threshold", with_ctes("thr", body="""
    SELECT tenant_id, user_name, src_ip, id0 || ',' || id1 || ',' || id2 AS event_ids, first_ms, last_ms FROM thr"""))
def stream_threshold(t):
    rows = live(t).where(rule_predicate(PACK.threshold.predicate)).select(
        "tenant_id", "user_name", "src_ip", "normalized_event_id", "event_time_ms")
    m = Matcher(shared_dir(t.spark, "threshold"),
                lambda df: D.threshold_matches(df, ["user_name", "src_ip"], 3, DAY_MS),
                ["tenant_id", "user_name", "src_ip"], "event_time_ms", "normalized_event_id", DAY_MS, 3_600_000)
    check = shared_dir(t.spark, "check")
    staged(t, rows, "event_time_ms", lambda s: [jobs.start_batches(s, m.process, check)], lambda: m.flush(t.spark))
    return m.matches(t.spark).select("tenant_id", "user_name", "src_ip", F.array_join("event_ids", ",").alias("event_ids"),
                                     "first_ms", "last_ms")


@query("stream_sequence", with_ctes("seq", body="""
    SELECT tenant_id, user_name, s0 || ',' || s1 || ',' || s2 AS input_ids, first_ms AS start_ms, last_ms AS end_ms FROM seq"""))
def stream_sequence(t):
    rows = (D.event_signals(live(t), PACK.events, "LIVE", extra=["user_name", "normalized_event_id"])
            .select("tenant_id", "user_name", "rule_id", "first_ms",
                    F.concat_ws("/", "normalized_event_id", "signal_id").alias("ordered_id")))
    stages = [F.col("rule_id") == s for s in PACK.sequence.stages]
    m = Matcher(shared_dir(t.spark, "sequence"),
                lambda df: D.sequence_matches(df, ["user_name"], stages, DAY_MS, "first_ms", "ordered_id"),
                ["tenant_id", "user_name"], "first_ms", "ordered_id", DAY_MS, 3_600_000)
    check = shared_dir(t.spark, "check")
    staged(t, rows, "first_ms", lambda s: [jobs.start_batches(s, m.process, check)], lambda: m.flush(t.spark))
    ids = F.array_join(F.transform("input_ids", lambda x: F.substring_index(x, "/", -1)), ",")
    return m.matches(t.spark).select("tenant_id", "user_name", ids.alias("input_ids"), "start_ms", "end_ms")


@query("stream_normalize", with_ctes("nm", body="""
    SELECT raw_event_id, logical_key, NULL::VARCHAR AS error_code FROM nmv WHERE mode = 'LIVE'
    UNION ALL SELECT raw_event_id, NULL, coalesce(error_code, 'NORM-MAPPING-UNSUPPORTED') FROM outcome WHERE error_code IS NOT NULL OR parser_id <> 'linux/sshd'"""))
def stream_normalize(t):
    table, dlq, check = (shared_dir(t.spark, n) for n in ("normalized", "dlq", "check"))
    handle = jobs.normalize_batch(table, dlq, "LIVE", CLOCK_MS, POLICIES)
    staged(t, t.dealt_lines, "ingest_time_seconds", lambda s: [jobs.start_batches(s, handle, check)])
    good = t.spark.read.parquet(table).select("raw_event_id", "logical_key", F.lit(None).cast("string").alias("error_code"))
    bad = t.spark.read.parquet(dlq).select("raw_event_id", F.lit(None).cast("string").alias("logical_key"), "error_code")
    return good.unionByName(bad)


@query("stream_modes", with_ctes("ne", body="""
    SELECT c.consumer, c.execution_mode, raw_event_id
    FROM ne JOIN (VALUES ('live', 'LIVE', 'raw.persisted'), ('replay-history', 'REPLAY', 'raw.persisted'), ('test', 'TEST', 'raw.persisted'),
      ('replay-selected', 'REPLAY', 'raw.replay')) c(consumer, execution_mode, subject)
    ON c.subject = CASE WHEN event_id % 13 = 0 THEN 'raw.replay' ELSE 'raw.persisted' END"""))
def stream_modes(t):
    """Each consumer reads all records of its subject, in its own mode."""
    rows = t.normalized_events.select(
        F.when(F.col("event_id") % 13 == 0, "raw.replay").otherwise("raw.persisted").alias("subject"),
        "raw_event_id", "event_time_seconds")
    out = shared_dir(t.spark, "modes")
    checks = shared_dir(t.spark, "checks")

    def write(df, consumer):
        return (df.writeStream.format("parquet").option("path", f"{out}/{consumer}")
                .option("checkpointLocation", f"{checks}/{consumer}").trigger(availableNow=True).start())

    staged(t, rows, "event_time_seconds", lambda s: jobs.start_consumers(s, write))
    schema = rows.withColumn("execution_mode", F.lit("")).schema
    legs = [read_table(t.spark, f"{out}/{c}", schema).select(F.lit(c).alias("consumer"), "execution_mode", "raw_event_id")
            for c in jobs.CONSUMERS]
    return reduce(DataFrame.unionByName, legs)


@query("stream_metrics", with_ctes("ne", body="""
    SELECT tenant_id, ingest_time_seconds - ingest_time_seconds % 86400 AS window_start, count(*) AS events, sum(strlen(ocsf_event_json))::BIGINT AS bytes
    FROM ne GROUP BY ALL"""))
def stream_metrics(t):
    """Daily counters of every day; a last row closes the source and with it the open days."""
    rows = t.normalized_events.select(
        "tenant_id", "ingest_time_seconds", F.octet_length("ocsf_event_json").cast("long").alias("bytes"))
    rows = rows.unionByName(jobs.end_of_source(rows, "ingest_time_seconds", 2 * 86_400))
    out = appended(t, rows, "ingest_time_seconds",
                   lambda s: jobs.windowed_counts(s.withColumn("ts", F.timestamp_seconds("ingest_time_seconds")),
                                                  "ts", "1 hour", "1 day", ["tenant_id"]))
    return (out.where(F.col("tenant_id").isNotNull())
            .select("tenant_id", F.unix_seconds("window.start").alias("window_start"), "events", "bytes"))
