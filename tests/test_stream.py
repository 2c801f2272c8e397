"""Late rows, repeated batches and restarts of the stream state."""

import pytest
from pyspark.sql import functions as F

from siemspark.functions.scalars import floor_div
from siemspark.operators import detect as D
from siemspark.streaming.state import GapTracker, Matcher

SCHEMA = "tenant_id string, user_name string, t long, id string"


def matcher(root, policy="ACCEPT_WITH_LIMIT", lateness=10):
    return Matcher(str(root), lambda df: D.threshold_matches(df, ["user_name"], 3, 100, "t", "id"),
                   ["tenant_id", "user_name"], "t", "id", 100, lateness, policy)


def feed(spark, m, batches, again=()):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([("x", "u", t, k) for t, k in rows], SCHEMA)
        m.process(df, i)
        if i in again:
            m.process(df, i)
    m.flush(spark)
    return [(r.event_ids, r.first_ms, r.last_ms) for r in m.matches(spark).collect()]


def test_match_across_batches_and_replay(spark, tmp_path):
    batches = [[(0, "a"), (50, "b")], [(90, "c"), (95, "d")], [(400, "e"), (401, "f"), (402, "g")]]
    want = [(["a", "b", "c"], 0, 90)]
    assert feed(spark, matcher(tmp_path / "one"), batches) == want
    assert feed(spark, matcher(tmp_path / "two"), batches, again=(0, 1, 2)) == want


def test_late_rows(spark, tmp_path):
    batches = [[(100, "a"), (200, "b")], [(195, "c")], [(150, "d"), (205, "e"), (210, "f")]]
    waits = feed(spark, matcher(tmp_path / "limit"), batches)
    assert waits == [(["a", "c", "b"], 100, 200)]
    strict = feed(spark, matcher(tmp_path / "ignore", "IGNORE_FOR_STREAM"), batches)
    assert strict == [(["b", "e", "f"], 200, 210)]
    with pytest.raises(ValueError):
        matcher(tmp_path / "no", "ACCEPT")


def test_gap_tracker(spark, tmp_path):
    g = GapTracker(str(tmp_path / "gaps"), ["s"], "seq", ["at"], lambda: floor_div("at", 2))
    at = 0
    for i, part in enumerate([[41, 42], [42, 45, 44], [46, 50], [49, 51]]):
        rows = []
        for q in part:
            rows.append(("x", at, q))
            at += 1
        df = spark.createDataFrame(rows, "s string, at long, seq long")
        g.process(df, i)
        g.process(df, i)
    assert sorted(tuple(r) for r in g.gaps(spark).select("s", "expected_sequence", "observed_sequence").collect()) == [
        ("x", 43, 45), ("x", 47, 50)]
    assert F is not None
