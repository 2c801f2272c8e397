"""Sequence gaps, journal export files, sinks and the replay of batches."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siemspark.functions.scalars import floor_div
from siemspark.operators import ordered
from siemspark.operators import raw as R
from siemspark.operators import reliability as L
from siemspark.session import cut_lineage
from siemspark.sources import journal, sinks


def brute_gaps(rows):
    top, out = {}, set()
    for source, at, seq in sorted(rows, key=lambda r: (r[0], r[1])):
        if seq is None:
            continue
        if source in top and seq > top[source] + 1:
            out.add((source, top[source] + 1, seq))
        top[source] = max(top.get(source, seq), seq)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_gaps(spark, seed):
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.6 else f"s{rnd.randrange(4)}", at, None if rnd.random() < 0.05 else
             at // 2 + rnd.randrange(12)) for at in range(400)]
    df = spark.createDataFrame(rows, "source_id string, at long, seq long")
    out = R.source_gaps(df, ["source_id"], "seq", ["at"], floor_div("at", [1, 17, 1000][seed]))
    assert {tuple(r) for r in out.collect()} == brute_gaps(rows)


def test_known_gap(spark):
    df = spark.createDataFrame([("s", i, q) for i, q in enumerate([41, 42, 45])], "source_id string, at long, seq long")
    assert [tuple(r) for r in R.source_gaps(df, ["source_id"], "seq", ["at"], F.lit(0)).collect()] == [("s", 43, 45)]


def test_journal_export_file(spark, tmp_path):
    path = tmp_path / "export.txt"
    path.write_bytes(b"__CURSOR=s=1\nMESSAGE=up <&>\n\nMESSAGE=\xfe\x02\n\n\n\nbad name=1\n\nUNIT=cron\n")
    out = journal.journal_entries(journal.read_journal_export(spark, str(path)), "entry").collect()
    got = sorted((r.canonical or "", r.cursor, r.error) for r in out)
    assert got == sorted([
        ("", None, "invalid field name"),
        ('{"journald_version":1,"cursor":"s=1","fields":[{"name":"__CURSOR","encoding":"utf8","value":"s=1"},'
         '{"name":"MESSAGE","encoding":"utf8","value":"up \\u003c\\u0026\\u003e"}]}', "s=1", None),
        ('{"journald_version":1,"cursor":null,"fields":[{"name":"MESSAGE","encoding":"base64","value":"/gI="}]}', None, None),
        ('{"journald_version":1,"cursor":null,"fields":[{"name":"UNIT","encoding":"utf8","value":"cron"}]}', None, None)])


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(100).select(F.col("id").cast("string").alias("key"), (F.col("id") % 3).alias("p"), F.lit("first").alias("v"))
    sinks.append_missing(rows.where("id < 60") if "id" in rows.columns else rows.where("key < '6'"), path, "key", ["p"])
    sinks.append_missing(rows.withColumn("v", F.lit("second")).union(rows.withColumn("v", F.lit("second"))), path, "key", ["p"])
    table = spark.read.parquet(path)
    assert table.count() == 100 == table.select("key").distinct().count()
    assert table.where("v = 'first'").count() == rows.where("key < '6'").count()
    standing = sinks.stored_or_new(rows.withColumn("v", F.lit("third")), table.select(rows.columns), "key")
    assert standing.where("v = 'third'").count() == 0


ATTEMPT = ("consumer string, message_key string, seq int, outcome string, message_id string, occurred_ms long, "
           "retry_budget int, delivery_attempt int, error_code string, retryable boolean, next_retry_ms long")


def walk_retries(rows):
    """(count, budget, isolated, last attempt) of every open lifecycle."""
    state = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        key, outcome, budget, retryable = r[1], r[3], r[6], r[9]
        if outcome != "FAILURE":
            state.pop(key, None)
        elif key not in state:
            state[key] = (1, budget, not retryable or 1 >= budget, r[7])
        elif not state[key][2]:
            n, first, _, _ = state[key]
            state[key] = (n + 1, first, not retryable or n + 1 >= first, r[7])
    return state


@pytest.mark.parametrize("seed", range(3))
def test_retry_state_with_mixed_budgets(spark, seed, monkeypatch):
    """Budgets from 1 to 100,000, one key with most attempts, cut into several chunks."""
    rnd = random.Random(seed)
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 300)
    rows = [("c", rnd.choice(["hot", "hot", "hot", "a", "b", "d"]), i, rnd.choice(["FAILURE"] * 400 + ["SUCCESS", "DLQ_PUBLISHED"]),
             rnd.choice([None, f"m{i}"]), 1_000 + i, rnd.choice([1, 3, 100, 100_000]), i, "X", rnd.random() < [1, 0.99, 0.5][seed], 5)
            for i in range(3_000)]
    got = L.retry_state(spark.createDataFrame(rows, ATTEMPT).repartition(3), ["consumer", "message_key"], ["seq"]).collect()
    assert {r.message_key: (r.failure_count, r.retry_budget, r.isolated, r.last_delivery_attempt) for r in got} == walk_retries(rows)


def test_replay_budget_comes_from_the_first_request(spark):
    rows = [("life", "root", 100_000 if k else 5_000, f"s{i}", i, i) for k in (0,) for i in range(6_000)]
    rows += [("small", "root", 2, f"s{i}", i, i) for i in range(5)] + [("small", "root", 9, "s0", 0, 9)]
    df = spark.createDataFrame(rows, "lifecycle_key string, replay_root string, max_attempts int, source_dlq_record_id string, source_sequence long, at int")
    got = L.replay_reserve(df.repartition(4), ["at"]).groupBy("lifecycle_key", "status").agg(F.count("*"), F.max("attempt")).collect()
    assert sorted(map(tuple, got)) == [("life", "EXHAUSTED", 1_000, 5_000), ("life", "RESERVED", 5_000, 5_000),
                                       ("small", "CONFLICT", 1, None), ("small", "EXHAUSTED", 3, 2), ("small", "RESERVED", 2, 2)]


def test_append_of_a_small_batch_does_not_shuffle_the_table(spark, tmp_path):
    path = str(tmp_path / "big")
    rows = spark.range(5_000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("x" * 50).alias("v"))
    sinks.append_missing(rows, path, "key")
    stored = sinks.read_table(spark, path, rows.schema)
    staged = cut_lineage(rows.limit(20), "few")
    known = stored.select("key").join(staged.select(F.col("key").alias("_k")), F.col("key") == F.col("_k"), "left_semi")
    assert "ShuffleExchange" not in known._jdf.queryExecution().executedPlan().toString()
    assert sinks.append_missing(rows.limit(20).union(spark.createDataFrame([("new", "y")], rows.schema)), path, "key").count() == 5_001


def test_raw_uri(spark):
    df = spark.createDataFrame([("raw:///a/b",), ("raw:///a/../b",), ("raw:///",), ("raw:///./a",), ("file:///a",), ("raw:///a//b",), ("raw:///..a/b",)], "u string")
    assert [r[0] for r in df.select(F.col("u").rlike(R.RAW_URI)).collect()] == [True, False, False, False, False, False, True]


def test_json_with_anything_behind_it_is_refused(spark):
    texts = ['{"a":1}', ' [1] ', '{"a":1} garbage', '{"a":1}{}', '1 2', '"x"', '', '{"a":1e400}', '{"a":-0}']
    df = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "i int, payload binary")
    out = {r.i: r.reason for r in df.select("i", R.json_reason(F.lit("application/json"), "payload").alias("reason")).collect()}
    assert [i for i, r in sorted(out.items()) if r] == [2, 3, 4, 6]


def test_append_searches_many_partitions(spark, tmp_path):
    path = str(tmp_path / "wide")
    rows = spark.range(300).select(F.col("id").cast("string").alias("key"),
                                   F.when(F.col("id") % 50 != 0, F.col("id") % 50).alias("p"))
    for _ in range(2):
        sinks.append_missing(rows, path, "key", ["p"])
    table = spark.read.parquet(path)
    assert table.count() == 300 == table.select("key").distinct().count()


def test_append_compares_keys_before_rows_travel(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(3_000).select(F.concat(F.lit("k"), (F.col("id") % 1_000).cast("string")).alias("key"), F.col("id").cast("string").alias("v"))
    first = {r.key: r.v for r in sinks.append_missing(rows, path, "key").collect()}
    assert len(first) == 1_000
    # The smallest digest of a row's content decides, as before.
    digest = F.sha2(F.to_json(F.struct("v"), {"ignoreNullFields": "false"}), 256)
    assert first == {r.key: r.v for r in rows.groupBy("key").agg(F.min_by("v", digest).alias("v")).collect()}
    files = set((tmp_path / "table").iterdir())
    sinks.append_missing(rows, path, "key")
    assert set((tmp_path / "table").iterdir()) == files  # nothing is written, not even an empty file
    plan = sinks.missing_keys(rows, sinks.read_table(spark, path, rows.schema), "key")._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and " v#" not in plan
    nulls = spark.createDataFrame([(None, "a"), (None, "b"), ("k1", "c"), ("n", "d"), ("n", "d")], rows.schema)
    for n in (1_002, 1_003):  # a null key is never found, so one row more each time
        assert sinks.append_missing(nulls, path, "key").count() == n
