"""Predicates, time ranges and paging."""

import pytest
from pyspark.sql import functions as F

from siemspark.functions.predicates import PredicateError, rule_predicate, search_predicate
from siemspark.operators import search as S
from siemspark.plans.fixtures import Tables


@pytest.mark.parametrize("spec", [
    {"field": "nope", "op": "==", "value": "x"}, {"field": "status", "op": ">", "value": "x"},
    {"field": "status", "op": "==", "value": 1}, {"field": "class_uid", "op": "==", "value": "1"},
    {"field": "class_uid", "op": "contains", "value": "1"}, {"field": "class_uid", "op": "exists"},
    {"field": "raw_event_id", "op": "==", "value": "not-a-uuid"}, {"field": "status", "op": "in", "value": []},
    {"field": "status", "op": "in", "value": ["x"] * 33}, {"and": []}, {"field": "status"}, {"field": "status", "op": "~", "value": "x"},
])
def test_bad_search(spark, spec):
    with pytest.raises(PredicateError):
        search_predicate(spec)


@pytest.mark.parametrize("spec", [{"or": []}, {"op": "eq", "field": "nope", "value": "x"}, {"op": "eq", "field": "status", "value": 1},
                                  {"op": "in", "field": "status", "value": "x"}, {"op": "like", "field": "status", "value": "x"}])
def test_bad_rule(spark, spec):
    with pytest.raises(PredicateError):
        rule_predicate(spec)


def test_paging_visits_every_row_once(spark, data_dir):
    rows = Tables(spark, data_dir).normalized_events.where("event_time_present = 1 and tenant_id = 'tenant-1'")
    want = [r[0] for r in rows.orderBy(*S._order("desc")).select("normalized_event_id").collect()]
    got, cursor = [], None
    while True:
        here = rows if cursor is None else S.after_cursor(rows, *cursor, "desc")
        page = S.page(here, 100, "desc").orderBy("position").collect()
        got += [r.normalized_event_id for r in page]
        if not page or not page[0].has_more:
            break
        last = page[-1]
        cursor = (last.event_time_seconds, last.event_time_nanos, last.normalized_event_id)
    assert got == want


def test_cursor_is_bound_to_the_request():
    mark = S.fingerprint({"field": "status", "op": "==", "value": "x"}, (0, 0), (9, 0), "asc")
    text = S.Cursor(1, 2, "id", "asc", mark).encode()
    assert S.Cursor.decode(text, mark).event_id == "id"
    with pytest.raises(ValueError):
        S.Cursor.decode(text, "other")
    with pytest.raises(ValueError):
        S.Cursor.decode("!!", mark)


def test_range_arguments(spark, data_dir):
    rows = Tables(spark, data_dir).normalized_events
    with pytest.raises(ValueError):
        S.time_range(rows, (5, 0), (5, 0))
    with pytest.raises(ValueError):
        S.time_range(rows, (0, 0), (S.MAX_RANGE_SECONDS, 1), S.MAX_RANGE_SECONDS)


def test_filters_reach_the_scan(spark, data_dir, tmp_path):
    path = str(tmp_path / "normalized")
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    Tables(spark, data_dir).normalized_events.write.partitionBy("tenant_id", "execution_mode", "event_date").parquet(path)
    rows = S.search(spark.read.parquet(path), "tenant-1", (1_704_844_800, 0), (1_704_931_200, 0),
                    {"field": "user.name", "op": "==", "value": "user7"})
    plan = rows.select("normalized_event_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "tenant_id" in plan and "event_date" in plan
    assert "EqualNullSafe(user_name,user7)" in plan and "GreaterThanOrEqual(event_time_seconds" in plan
    assert "ocsf_event_json" not in plan.split("ReadSchema")[1]


def test_missing_strings_count_as_empty(spark):
    df = spark.createDataFrame([(None,), ("",), ("x",)], "user_name string")
    def hits(op, value=None):
        return df.where(search_predicate({"field": "user.name", "op": op, "value": value})).count()
    assert (hits("!=", "x"), hits("==", ""), hits("exists"), hits("in", ["", "x"]), hits("contains", "")) == (2, 2, 1, 3, 3)
    assert df.where(~search_predicate({"field": "user.name", "op": "==", "value": "x"})).count() == 2
    assert df.where(F.lit(True)).count() == 3
