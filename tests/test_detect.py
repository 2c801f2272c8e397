"""Thresholds, sequences and the bounded run against plain Python models."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siemspark.operators import detect as D
from siemspark.operators.events import conflicting_ids, dedup_events
from siemspark.operators import ordered
from siemspark.operators.ordered import in_chunks, running_max

MIN = 60_000


@pytest.fixture
def many_chunks(monkeypatch):
    """Chunks of few rows, so that small groups are cut too."""
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 60)


EVENTS = ("tenant_id string, normalized_event_id string, event_time_present int, event_time_seconds long, "
          "event_time_nanos int, activity_name string, status string, user_name string, src_ip string, "
          "execution_mode string")


def event(i, second, user="root", ip="10.0.0.9", status="Failure", activity="Logon", mode="REPLAY", tenant="t"):
    return (tenant, f"e{i:04d}", 1, second, 0, activity, status, user, ip, mode)


def burst(spark, rows, count=10, window=5 * MIN):
    df = spark.createDataFrame(rows, "tenant_id string, user_name string, src_ip string, "
                                     "event_time_ms long, normalized_event_id string")
    return D.threshold_matches(dedup_events(df), ["user_name", "src_ip"], count, window).collect()


def failed(n, step=20_000, user="root", ip="10.0.0.9"):
    return [("t", user, ip, 1_000_000 + i * step, f"e{i:03d}") for i in range(n)]


@pytest.mark.parametrize("rows, signals", [
    (failed(10), 1), (failed(9), 0), (failed(10) + failed(1), 1),
    (list(reversed(failed(10))), 1), (failed(10)[1:] + failed(10)[:1], 1),
    ([("t", "root", None, *r[3:]) if i == 4 else r for i, r in enumerate(failed(10))], 0),
    (failed(10, user="r�t", ip="2001:db8::9"), 1), (failed(10, step=40_000), 0),
])
def test_burst_fixtures(spark, rows, signals):
    out = burst(spark, rows)
    assert len(out) == signals
    if out:
        assert out[0].event_ids == sorted(r[4] for r in set(rows))


def brute_threshold(rows, count, window):
    groups = {}
    for tenant, user, ip, t, i in set(rows):
        if None not in (user, ip, t):
            groups.setdefault((tenant, user, ip), []).append((t, i))
    found = {}
    for key, items in groups.items():
        items.sort()
        left = 0
        for right in range(len(items)):
            while items[right][0] - items[left][0] > window:
                left += 1
            if right + 1 - left >= count:
                found[key] = [i for _, i in items[left:right + 1]]
                break
    return found


@pytest.mark.parametrize("seed", range(4))
def test_threshold_random(spark, seed):
    """One user holds most rows; times cross slices, buckets and zero."""
    rnd = random.Random(seed)
    rows, span = [], [200, 3_000, 40_000, 400][seed]
    for i in range(600):
        user = "hot" if rnd.random() < 0.5 else f"u{rnd.randrange(6)}"
        rows.append(("t", user, "ip", rnd.randrange(-span, span), f"e{i:04d}"))
    rows += rnd.sample(rows, 50)
    count, window = rnd.choice([(1, 5), (2, 7), (3, 10), (5, 25)])
    got = {(r.tenant_id, r.user_name, r.src_ip): r.event_ids for r in burst(spark, rows, count, window)}
    assert got == brute_threshold(rows, count, window)


def brute_sequence(rows, stages, window):
    groups = {}
    for tenant, user, stage, t, i in rows:
        groups.setdefault((tenant, user), []).append((t, i, stage))
    found = {}
    for key, items in groups.items():
        items.sort()
        for a, start in enumerate(items):
            if start[2] != stages[0]:
                continue
            chain, at = [start], a
            for want in stages[1:]:
                nxt = next((j for j in range(at + 1, len(items)) if items[j][2] == want), None)
                if nxt is None or items[nxt][0] - start[0] > window:
                    break
                chain.append(items[nxt])
                at = nxt
            if len(chain) == len(stages):
                found[key] = [x[1] for x in chain]
                break
    return found


@pytest.mark.parametrize("seed", range(2))
def test_threshold_ranks_parts_of_a_slice_for_high_counts(spark, seed, monkeypatch):
    monkeypatch.setattr(D, "MAP_SIDE_RANK", 1)
    monkeypatch.setattr(D, "RANK_PARTS", 3)
    rnd = random.Random(seed)
    rows = [("t", rnd.choice(["hot", "hot", "u"]), "ip", rnd.randrange(300), f"e{i:04d}") for i in range(500)]
    got = {(r.tenant_id, r.user_name, r.src_ip): r.event_ids for r in burst(spark, rows, 12, 20)}
    assert got == brute_threshold(rows, 12, 20)


def test_threshold_of_five_thousand(spark):
    """All rows of a key in one slice, in number beyond Spark's map-side rank."""
    df = spark.range(60_000).select(
        F.lit("t").alias("tenant_id"), F.when(F.col("id") < 4_999, "few").otherwise("hot").alias("user_name"),
        (F.col("id") % 977).alias("event_time_ms"), F.format_string("e%06d", "id").alias("normalized_event_id"))
    out = D.threshold_matches(df, ["user_name"], 5_000, 10_000).collect()
    assert [(r.user_name, len(r.event_ids), r.first_ms) for r in out] == [("hot", 5_000, 0)]
    want = sorted(((i % 977, f"e{i:06d}") for i in range(4_999, 60_000)))[:5_000]
    assert out[0].event_ids == [i for _, i in want] and out[0].last_ms == want[-1][0]


@pytest.mark.parametrize("seed", range(4))
def test_sequence_random(spark, seed, many_chunks):
    rnd = random.Random(seed)
    span = [100, 2_000, 20_000, 500][seed]
    rows = [("t", "hot" if rnd.random() < 0.5 else f"u{rnd.randrange(8)}", rnd.choice("abcd"),
             rnd.randrange(-span, span), f"s{i:04d}") for i in range(500)]
    df = spark.createDataFrame(rows, "tenant_id string, user_name string, rule_id string, time_ms long, signal_id string")
    window, stages = rnd.choice([3, 15, 60]), ["a", "b", "c"]
    out = D.sequence_matches(df, ["user_name"], [F.col("rule_id") == s for s in stages], window).collect()
    assert {(r.tenant_id, r.user_name): r.input_ids for r in out} == brute_sequence(rows, stages, window)


@pytest.mark.parametrize("rows, chains", [
    ([("a", 0), ("b", 1), ("c", 2)], 1), ([("a", 0), ("b", 1)], 0), ([("b", 0), ("a", 1), ("c", 2)], 0),
    ([("a", 0), ("b", 1), ("c", 1000)], 0), ([("a", 0), ("b", 1), ("c", 100)], 1),
])
def test_sequence_cases(spark, rows, chains):
    data = [("t", "u", s, t, f"s{i}") for i, (s, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "tenant_id string, user_name string, rule_id string, time_ms long, signal_id string")
    stages = [F.col("rule_id") == s for s in "abc"]
    assert D.sequence_matches(df, ["user_name"], stages, 100).count() == chains


def bounded_rows():
    rows = [event(i, 1_000 + i * 20) for i in range(10)]
    rows += [event(0, 1_000)]
    rows += [event(20 + i, 1_000 + i * 20, user="other") for i in range(9)]
    rows += [event(40, 1_190, status="Success"), event(41, 1_195, activity="Privilege Escalation", status="Success"),
             event(50, 1_100, mode="LIVE")]
    return rows


def test_bounded_run(spark):
    df = spark.createDataFrame(bounded_rows(), EVENTS)
    runs = [D.detect(df, D.RulePack(), "REPLAY", "t", 0, 10_000_000) for _ in range(2)]
    assert runs[0].events.count() == 21
    counts = {r.rule_id: r["count"] for r in runs[0].signals.groupBy("rule_id").count().collect()}
    assert counts == {"DET-000101": 19, "DET-000102": 1, "DET-000103": 1, "DET-000001": 1}
    found = runs[0].findings.collect()
    assert len(found) == 1 and len(found[0].input_ids) == 3
    for name in ("signals", "findings"):
        a, b = (sorted(map(str, getattr(r, name).collect())) for r in runs)
        assert a == b


def test_conflicting_copies(spark):
    rows = bounded_rows() + [event(0, 1_001)]
    df = spark.createDataFrame(rows, EVENTS).where("execution_mode = 'REPLAY'")
    assert [r.normalized_event_id for r in conflicting_ids(df).collect()] == ["e0000"]
    assert dedup_events(df, on_conflict="quarantine").count() == 20
    with pytest.raises(PySparkException, match="conflicting copies"):
        dedup_events(df).collect()


def test_argument_checks(spark):
    for args in ([[], 1, 1], [["a", "a"], 1, 1], [["a"], 0, 1], [["a"], 1, 0], [["a"], 1, 1, "IGNORE_FOR_STREAM"]):
        with pytest.raises(ValueError):
            D.check_threshold_args(*args)


def test_threshold_plan_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(failed(3), "tenant_id string, user_name string, src_ip string, "
                                          "event_time_ms long, normalized_event_id string")
    plan = D.threshold_matches(df, ["user_name"], 3, 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_copies_with_maps_and_nulls(spark):
    rows = [("a", None, {"k": "v"}), ("a", None, {"k": "v"}), ("b", None, {"k": "v"}), ("b", None, {"k": "w"}), ("c", 1, None)]
    df = spark.createDataFrame(rows, "id string, n int, m map<string,string>")
    assert [r.id for r in conflicting_ids(df, "id").collect()] == ["b"]
    plain = df.select("id", "n")
    assert conflicting_ids(plain, "id").count() == 0
    assert dedup_events(plain, "id").count() == 3
    assert [r.id for r in conflicting_ids(plain.union(spark.createDataFrame([("a", 2)], "id string, n int")), "id").collect()] == ["a"]


SOUND = '{{"activity_name":"Logon","status":"Failure","time":{t},"user":{{"name":{u}}},"src_endpoint":{{"ip":"10.0.0.9"}}}}'


@pytest.mark.parametrize("broken, why", [
    (SOUND.format(t=1, u=7), "user.name is not a string"), (SOUND.format(t='"late"', u='"root"'), "time is not numeric"),
    (SOUND.format(t=1.5, u='"root"'), "integral"), ('{"user":5}', "malformed"), ("{", "no JSON")])
def test_unsound_events_fail_or_are_set_aside(spark, broken, why):
    rows = [(*event(i, 1_000 + i * 20), SOUND.format(t=1000 + i, u='"root"')) for i in range(10)]
    df = spark.createDataFrame([*rows, (*event(99, 1_050), broken)], EVENTS + ", ocsf_event_json string")
    # Spark wraps it when several stages fail at once.
    with pytest.raises(Exception, match="e0099"):
        D.detect(df, D.RulePack(), "REPLAY", "t", 0, 10_000_000).signals.collect()
    run = D.detect(df, D.RulePack(), "REPLAY", "t", 0, 10_000_000, on_error="quarantine")
    assert run.signals.where("rule_id = 'DET-000001'").count() == 1
    rejected = run.rejected.collect()
    assert [r.normalized_event_id for r in rejected] == ["e0099"] and why in rejected[0].error


def test_sequence_input_checks(spark):
    schema = "signal_id string, tenant_id string, rule_id string, user_name string, first_ms long, execution_mode string"
    rows = [("a", "t", "DET-000101", "u", 1, "LIVE"), ("b", "t", "DET-000102", "u", 2, "LIVE"), ("c", "t", "DET-000103", "u", 3, "LIVE")]
    rule = D.RulePack().sequence
    assert D.sequence_findings(spark.createDataFrame(rows + rows[:1], schema), rule, "LIVE").count() == 1
    for extra, match in ((("a", "t", "DET-000101", "u", 9, "LIVE"), "conflicting"), (("d", "t", "DET-000101", "u", 9, "TEST"), "another mode")):
        with pytest.raises(PySparkException, match=match):
            D.sequence_findings(spark.createDataFrame([*rows, extra], schema), rule, "LIVE").collect()


@pytest.mark.parametrize("stages", ["ab", "abcd", "aba"])
def test_sequence_of_other_lengths_at_one_time(spark, many_chunks, stages):
    """Many rows of one key at one time: only ids order them."""
    rnd = random.Random(7)
    rows = [("t", rnd.choice(["hot", "hot", "u"]), rnd.choice("abcdx"), rnd.choice([5, 5, 5, 9]), f"s{i:04d}") for i in range(300)]
    df = spark.createDataFrame(rows, "tenant_id string, user_name string, rule_id string, time_ms long, signal_id string")
    out = D.sequence_matches(df, ["user_name"], [F.col("rule_id") == s for s in stages], 4).collect()
    assert {(r.tenant_id, r.user_name): r.input_ids for r in out} == brute_sequence(rows, stages, 4)


def test_hot_key_is_cut_into_chunks(spark, monkeypatch):
    """All rows of one key at one time are spread over all ranges."""
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 5_000)
    df = spark.range(40_000).select(F.lit("k").alias("k"), F.lit(1).alias("t"), "id").repartition(4)
    sizes = [r["count"] for r in in_chunks(df, ["k"], ["t", "id"], "test").groupBy("_chunk").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 10_000


def sides(rnd, n, span):
    rows = [("t", rnd.choice(["hot", "hot", "u1", "u2", None]), rnd.choice([None, *[rnd.randrange(span)] * 9]),
             f"e{i:04d}") for i in range(n)]
    cut = rnd.randrange(n // 3, n // 2)
    return rows[:cut], rows[cut:]


SIDE = "tenant_id string, user_name string, event_time_ms long, normalized_event_id string"


@pytest.mark.parametrize("seed", range(4))
def test_absence_random(spark, seed, many_chunks):
    rnd = random.Random(seed)
    triggers, expected = sides(rnd, 400, [60, 3_000, 500, 50][seed])
    if seed == 3:
        expected = []
    window = rnd.choice([0, 5, 40])
    a, b = (spark.createDataFrame(x, SIDE) for x in (triggers, expected))
    got = sorted(tuple(r) for r in D.absence_rule(a, b, ["tenant_id", "user_name"], window).collect())
    want = sorted((t, u, i, at) for t, u, at, i in triggers if u is not None and at is not None and not any(
        v == u and x is not None and at <= x <= at + window for _, v, x, _ in expected))
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_join_rule_random(spark, seed, many_chunks):
    rnd = random.Random(seed)
    left, right = sides(rnd, 400, [60, 3_000, 500, 50][seed])
    after, before = rnd.choice([(0, 0), (5, 0), (40, 7), (0, 30)])
    a, b = (spark.createDataFrame(x, SIDE) for x in (left, right))
    got = sorted(tuple(r) for r in D.join_rule(a, b, ["tenant_id", "user_name"], after, before).collect())
    want = []
    for t, u, at, i in left:
        hits = sorted((x, j) for _, v, x, j in right if None not in (u, at, x) and v == u and at - before <= x <= at + after)
        if hits:
            want.append((t, u, i, at, len(hits), hits[0][1], hits[0][0]))
    assert got == sorted(want)


def test_join_rule_without_rows_or_window(spark):
    none = spark.createDataFrame([], SIDE)
    assert D.join_rule(none, none, ["user_name"], 5).collect() == []
    for bad in ((["user_name"], -1), (["user_name"], 1, -1), ([], 1)):
        with pytest.raises(ValueError, match="window"):
            D.join_rule(none, none, *bad)


def test_running_max_over_chunks_of_chunks(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", None]), at, rnd.randrange(1000)) for at in rnd.sample(range(-3_000, 3_000), 500)]
    df = spark.createDataFrame(rows, "k string, at long, v long")
    got = {(r.k, r["at"]): r.before for r in running_max(df, ["k"], "at", "v", fan=7).collect()}
    assert got == {(k, at): max([v for j, b, v in rows if j == k and b < at], default=None) for k, at, _ in rows}
