"""Retry, dead-letter and bounded-replay bookkeeping as DataFrame jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siemspark.functions.scalars import col, is_sha256
from siemspark.operators.ordered import first_ranks

DLQ_SCHEMA_VERSION = "normalization-dlq/v1"
PERSISTED_SUBJECT = "raw.persisted"
REPLAY_SUBJECT = "raw.replay"
REPLAY_MODE = "REPLAY"

# Code prefixes, first match wins.  They are the known codes without the product's own
# prefix, which is left out so that codes of any product fit.
CATEGORY_PREFIXES = [
    ("PARSE-", "PARSING"),
    ("NORM-RAW-HASH", "INTEGRITY"), ("NORM-RAW-LENGTH", "INTEGRITY"), ("NORM-RAW-INTEGRITY", "INTEGRITY"),
    ("NORM-CLICKHOUSE", "STORAGE"), ("NORM-RAW-STORE", "STORAGE"),
    ("NORM-NATS", "TRANSPORT"), ("NORM-PUBLISH", "TRANSPORT"),
    ("NORM-MAPPING", "NORMALIZATION"), ("NORM-CONTRACT", "NORMALIZATION"),
    ("NORM-TRANSFORMATION", "NORMALIZATION"), ("NORM-SOURCE-TIME", "NORMALIZATION"),
]
STAGE_PREFIXES = [
    ("PARSE-", "parsing"), ("NORM-MAPPING", "mapping"), ("NORM-CLICKHOUSE", "normalized_storage"),
    ("NORM-RAW", "raw_read_or_integrity"),
    ("NORM-ENVELOPE", "handoff_validation"), ("NORM-PAYLOAD", "handoff_validation"),
    ("NORM-TENANT", "handoff_validation"), ("NORM-UNSUPPORTED-CONTRACT", "handoff_validation"),
    ("NORM-PUBLISH", "event_bus"), ("NORM-NATS", "event_bus"),
]


def _by_prefix(code, table, default: str) -> Column:
    expr = F
    for prefix, value in table:
        expr = expr.when(col(code).startswith(prefix), value)
    return expr.otherwise(default)


def error_category(code) -> Column:
    return _by_prefix(code, CATEGORY_PREFIXES, "INTERNAL")


def failure_stage(code) -> Column:
    return _by_prefix(code, STAGE_PREFIXES, "normalization")


# --- retry -----------------------------------------------------------------

def retry_delay_ms(deliveries, min_ms: int, max_ms: int, seed=None) -> Column:
    """Exponential delay; with ``seed`` spread to 80..120 % by a hash.

    Nothing is random: the same message and attempt always wait the same.
    """
    n = col(deliveries)
    exponent = F.greatest(F.lit(0), F.least(n - 1, F.lit(20))).cast("int")
    base = F.least(F.lit(min_ms) * F.pow(F.lit(2), exponent).cast("long"), F.lit(max_ms))
    if seed is None:
        return base
    digest = F.sha2(F.concat(col(seed), F.lit(":"), n.cast("string")), 256)
    sample = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % 41
    # Nanosecond arithmetic in whole numbers, shown in milliseconds.
    nanos = F.call_function("div", base * 1_000_000 * (F.lit(80) + sample.cast("long")), F.lit(100))
    return F.greatest(F.lit(min_ms * 1_000_000), F.least(nanos, F.lit(max_ms * 1_000_000))) / 1_000_000


def retry_state(attempts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Open retry state per key after a history of attempts.

    ``attempts`` holds failures and clearing rows (``outcome`` FAILURE, or
    SUCCESS / DLQ_PUBLISHED which end the lifecycle).  In a lifecycle the
    budget of the first failure counts; failures after isolation (budget used
    up or not retryable) change nothing.

    A key with very many attempts is not sorted as one group.  Only the
    failures after its last clearing matter, and of those only as many as the budget of
    the first one, whatever it is: the rest is cut off by chunks.
    """
    position = F.struct(*order)
    clears = (attempts.where(F.col("outcome") != "FAILURE").groupBy(*keys)
              .agg(F.max(position).alias("_cleared")))
    failures = (attempts.where(F.col("outcome") == "FAILURE")
                .join(clears, list(keys), "left")
                .where(F.col("_cleared").isNull() | (position > F.col("_cleared"))).drop("_cleared"))
    first = first_ranks(failures, keys, order, F.col("retry_budget"), "retries")
    first = first.withColumn("_n", F.col("_rank")).withColumn("_budget", F.col("_limit"))
    # The first failure that is not retryable is the last one that counts; a key has no more rows here than its budget.
    stop = F.min(F.when(~F.col("retryable"), F.col("_n"))).over(Window.partitionBy(*keys))
    kept = first.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("_n") <= F.col("_stop")))
    at = F.struct("_n")
    state = kept.groupBy(*keys).agg(
        F.min_by("message_id", F.when(F.col("message_id").isNotNull(), F.col("_n"))).alias("message_id"),
        F.min_by("occurred_ms", at).alias("first_failure_ms"), F.max("occurred_ms").alias("last_failure_ms"),
        F.count(F.lit(1)).cast("int").alias("failure_count"), F.max("_budget").alias("retry_budget"),
        F.max_by("delivery_attempt", at).alias("last_delivery_attempt"),
        F.max_by("error_code", at).alias("last_error_code"),
        F.max_by("retryable", at).alias("last_error_retryable"),
        F.max_by("next_retry_ms", at).alias("_next"))
    isolated = ~F.col("last_error_retryable") | (F.col("failure_count") >= F.col("retry_budget"))
    return state.select(
        *keys, "message_id", "first_failure_ms", "last_failure_ms", "failure_count", "retry_budget",
        "last_delivery_attempt", "last_error_code", "last_error_retryable",
        F.when(~isolated, F.greatest("last_failure_ms", "_next")).alias("next_retry_ms"),
        isolated.alias("isolated"))


def retry_disposition(failure_count, budget, retryable) -> Column:
    """ISOLATE when the failure is final, else RETRY."""
    return F.when(~col(retryable) | (col(failure_count) >= col(budget)), "ISOLATE").otherwise("RETRY")


# --- dead letters ----------------------------------------------------------

def dead_letters(failures: DataFrame) -> DataFrame:
    """Dead-letter records from isolated failures.

    A replayed message is recorded under its original subject and sequence.
    """
    replayed = ((F.col("subject") == REPLAY_SUBJECT) & F.col("replay_root_dlq_record_id").isNotNull()
                & F.col("replay_attempt").isNotNull() & F.col("replay_source_sequence").isNotNull())
    rows = failures.select(
        F.lit(DLQ_SCHEMA_VERSION).alias("schema_version"),
        F.when(F.col("message_id") != "", F.col("message_id")).alias("original_message_id"),
        F.when(replayed, PERSISTED_SUBJECT).otherwise(F.col("subject")).alias("original_subject"),
        F.sha2("payload", 256).alias("original_payload_sha256"), "consumer", "attempt_count",
        F.when(replayed, F.col("replay_source_sequence")).otherwise(F.col("stream_sequence")).alias("stream_sequence"),
        "error_code", error_category("error_code").alias("error_category"),
        failure_stage("error_code").alias("failure_stage"), "retryable", "first_failure_ms",
        "last_failure_ms", "tenant_id", "replay_root_dlq_record_id", "replay_attempt")
    rows = rows.withColumn("dedup_id", dead_letter_dedup_id())
    return rows.withColumn("dlq_record_id", F.sha2(F.concat(F.lit("dlq|"), "dedup_id"), 256))


def dead_letter_dedup_id() -> Column:
    """Replay root and attempt, else message and payload, else sequence, else payload."""
    head = "normalization-dlq:v1:"
    sha = F.col("original_payload_sha256")
    return F.coalesce(
        F.concat(F.lit(head + "replay:"), "replay_root_dlq_record_id", F.lit(":"),
                 F.col("replay_attempt").cast("string"), F.lit(":"), sha),
        F.concat(F.lit(head), "original_message_id", F.lit(":"), sha),
        F.concat(F.lit(head + "stream:"), F.col("stream_sequence").cast("string")),
        F.concat(F.lit(head + "payload:"), sha))


# --- replay ----------------------------------------------------------------

def replay_eligibility(dlq: DataFrame, max_attempts: int) -> DataFrame:
    """Adds ``eligible``, ``reason``, ``replay_root`` and ``lifecycle_key``."""
    root = F.coalesce(F.trim("replay_root_dlq_record_id"), F.trim("dlq_record_id"))
    invalid = ~F.coalesce((F.col("schema_version") == DLQ_SCHEMA_VERSION) & (F.trim("dlq_record_id") != "")
                          & is_sha256("original_payload_sha256"), F.lit(False))
    reason = (F.when(F.lit(max_attempts == 0), "DISABLED").when(invalid, "INVALID_RECORD")
              .when(~F.col("original_subject").eqNullSafe(PERSISTED_SUBJECT), "UNSUPPORTED_ORIGIN")
              .when(F.col("stream_sequence").isNull() | (F.col("stream_sequence") == 0), "SOURCE_UNAVAILABLE")
              .when(root == "", "INVALID_RECORD").when(~F.col("retryable"), "PERMANENT_FAILURE")
              .otherwise("ELIGIBLE"))
    out = dlq.withColumn("reason", reason)
    followed = F.col("reason").isin("ELIGIBLE", "PERMANENT_FAILURE")
    return (out.withColumn("eligible", F.col("reason") == "ELIGIBLE")
            .withColumn("replay_root", F.when(followed, root))
            .withColumn("lifecycle_key", F.when(followed, F.concat(
                F.lit("normalization-replay:v1:dlq:"), root))))


def replay_reserve(requests: DataFrame, order: Sequence[str]) -> DataFrame:
    """Budgeted replay attempts for a batch of requests, in arrival order.

    The first request of a lifecycle fixes root and budget; requests that
    disagree are CONFLICT.  Each new source record takes the next attempt, a
    repeated one gets its attempt back (CONFLICT if its sequence changed),
    and beyond the budget nothing is reserved.

    Sources are first reduced to their earliest request (map-side), then only
    as many sources of a lifecycle are ranked as its budget allows.
    """
    life, source = ["lifecycle_key"], ["lifecycle_key", "source_dlq_record_id"]
    arrival = F.struct(*order)
    rows = requests.withColumn("_at", arrival)
    captured = rows.groupBy(*life).agg(F.min_by(F.struct("replay_root", "max_attempts"), "_at").alias("_c"))
    rows = rows.join(captured, life)
    agrees = ((F.col("replay_root") == F.col("_c.replay_root"))
              & (F.col("max_attempts") == F.col("_c.max_attempts")))
    rows = rows.withColumn("_ok", agrees)
    firsts = (rows.where("_ok").groupBy(*source)
              .agg(F.min("_at").alias("_first"), F.min_by("source_sequence", "_at").alias("_seq"),
                   F.max("max_attempts").alias("_max")))
    ranked = (first_ranks(firsts, life, ["_first"], F.col("_max"), "replays")
              .select(*source, "_seq", F.col("_rank").alias("_attempt")))
    out = rows.join(ranked, source, "left")
    held = F.col("_attempt").isNotNull()
    status = (F.when(~F.col("_ok"), "CONFLICT").when(held & (F.col("_seq") != F.col("source_sequence")), "CONFLICT")
              .when(held, "RESERVED").otherwise("EXHAUSTED"))
    return (out.withColumn("status", status)
            .withColumn("attempt", F.when(F.col("status") == "RESERVED", F.col("_attempt"))
                        .when(F.col("status") == "EXHAUSTED", F.col("max_attempts")).cast("int"))
            .select(*requests.columns, "status", "attempt"))


def replay_set(reserved: DataFrame, stream: DataFrame) -> DataFrame:
    """Messages to send again, with the headers that tie them to their record.

    ``stream`` is (sequence, subject, payload, request_id).  Where the source
    message is gone or differs, ``status`` says so and nothing is sent.
    """
    source = stream.select(F.col("sequence").alias("source_sequence"), F.col("subject").alias("_subject"),
                           "payload", "request_id")
    joined = reserved.join(source, "source_sequence", "left")
    status = (F.when(F.col("_subject").isNull(), "SOURCE_UNAVAILABLE")
              .when(F.col("_subject") != PERSISTED_SUBJECT, "SOURCE_SUBJECT_DIFFERS")
              .when(F.sha2("payload", 256) != F.col("source_payload_sha256"), "SOURCE_HASH_DIFFERS")
              .otherwise("REPLAY"))
    headers = F.create_map(
        F.lit("Message-Id"), F.concat(F.lit("normalization-replay:v1:"), "replay_root", F.lit(":"),
                                      F.col("attempt").cast("string")),
        F.lit("Execution-Mode"), F.lit(REPLAY_MODE), F.lit("Replay-Root-DLQ-Record-Id"), F.col("replay_root"),
        F.lit("Replay-Attempt"), F.col("attempt").cast("string"),
        F.lit("Replay-Source-DLQ-Record-Id"), F.col("source_dlq_record_id"),
        F.lit("Replay-Source-Stream-Sequence"), F.col("source_sequence").cast("string"))
    with_request = F.when(F.coalesce(F.col("request_id"), F.lit("")) != "",
                          F.map_concat(headers, F.create_map(F.lit("Request-Id"), F.col("request_id")))).otherwise(headers)
    out = joined.withColumn("status", status)
    send = F.col("status") == "REPLAY"
    return out.select(*[c for c in reserved.columns if c != "status"], "status",
                      F.when(send, REPLAY_SUBJECT).alias("subject"),
                      F.when(send, with_request).alias("headers"), F.when(send, F.col("payload")).alias("payload"))
