"""Work that must not pass through the driver, nor stay in the few tasks of a small file."""

from pyspark.sql import functions as F

from siemspark.operators import invest as I
from siemspark.operators import normalize as N
from siemspark.operators import ordered
from siemspark.operators import parse as P
from siemspark.plans import fixtures
from siemspark.plans.fixtures import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_changes_send_no_objects_to_all_tasks(spark, monkeypatch, tmp_path):
    objects = spark.range(400).select(F.col("id").alias("k"), F.lit(1).alias("version"), F.lit("OPEN").alias("status"),
                                      F.lit("t").alias("title"), F.lit("").alias("owner"), F.lit("").alias("disposition"))
    none = [F.lit(None).cast("string").alias(c) for c in ("title", "owner", "disposition")]
    patches = spark.range(400).select(F.col("id").alias("k"), F.lit(1).alias("seq"), F.lit(1).alias("expected_version"),
                                      F.lit("TRIAGED").alias("status"), *none, F.lit("").alias("reason"))
    objects.write.parquet(f"{tmp_path}/objects")
    patches.write.parquet(f"{tmp_path}/patches")
    for rows in (1_000_000, 150):
        monkeypatch.setattr(ordered, "CHUNK_ROWS", rows)
        state, audit = I.apply_changes(spark.read.parquet(f"{tmp_path}/objects"), spark.read.parquet(f"{tmp_path}/patches"),
                                       I.INCIDENT, ["k"], ["seq"])
        assert "Broadcast" not in plan(state) and "Broadcast" not in plan(audit)
        assert state.where("version = 2 AND status = 'TRIAGED'").count() == 400 and audit.count() == 400


def test_lines_are_dealt_by_their_number(spark, data_dir, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_ROWS", 100)
    t = Tables(spark, data_dir)
    rows, parts = t.raw_lines.count(), t.dealt_lines.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts == -(-rows // 100)
    assert t.dealt_lines.exceptAll(t.raw_lines).count() == 0 and t.dealt_lines.count() == rows
    assert fixtures.dealt(t.read("events").where("false")).count() == 0


def test_wide_and_deep_json_is_over_the_limits(spark):
    wide = F.concat(F.lit("["), F.repeat(F.lit("1,"), F.lit(4096)), F.col("id").cast("string"), F.lit("]"))
    deep = F.concat(F.repeat(F.lit("["), F.lit(90)), F.col("id").cast("string"), F.repeat(F.lit("]"), F.lit(90)))
    rows = spark.range(1_000).coalesce(1)
    for text in (wide, deep):
        checked = rows.select(P.json_limit_code(text).alias("c"))
        assert {r["c"] for r in checked.limit(50).collect()} == {1}


def test_a_mode_that_is_not_asked_for_is_not_parsed(spark, data_dir):
    lines = P.parse(Tables(spark, data_dir).raw_lines)
    rows = N.normalized_rows(N.map_events(lines, "LIVE", 0)).unionByName(N.normalized_rows(N.map_events(lines, "REPLAY", 0)))
    assert plan(N.current_derivation(rows, "REPLAY")).count("Scan parquet") == 1
