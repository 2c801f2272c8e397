"""Versioned changes against a plain walk, and link views."""

import random

import pytest
from pyspark.sql import functions as F

from siemspark.operators import ordered
from siemspark.operators import invest as I

INCIDENT = "k long, version int, status string, title string, owner string, disposition string"
CASE = "k long, version int, status string, priority string, title string, owner string, disposition string, closure_reason string, closed_ms long"
PATCH = ("k long, seq long, expected_version int, status string, title string, owner string, priority string, disposition string, "
         "closure_reason string, reopen_reason string, reason string, at_ms long")
FIELDS = [x.split()[0] for x in PATCH.split(", ")]


@pytest.fixture
def many_chunks(monkeypatch):
    """Chunks of few rows, so that small groups are cut too."""
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 150)


def text(x):
    return bool(x and x.strip())


def allowed(table, old, new):
    return new in table and (new == old or old is not None and new in table.get(old, []))


def plain_incident(s, p):
    """(new state, audit) or None."""
    new = {n: s[n] if p[n] is None else p[n] for n in ("status", "title", "owner", "disposition")}
    if not allowed(I.INCIDENT_TRANSITIONS, s["status"], new["status"]) or p["title"] is not None and not text(p["title"]):
        return None
    moved = new["status"] != s["status"]
    return new, ("incident.status_changed" if moved else "incident.updated", "status_changed" if moved else "update", p["reason"])


def plain_case(s, p):
    new = {n: s[n] if p[n] is None else p[n] for n in ("status", "priority", "title", "owner", "disposition", "closure_reason")}
    new["closed_ms"] = s["closed_ms"]
    closing = new["status"] == "CLOSED" and s["status"] != "CLOSED"
    again = s["status"] == "CLOSED" and new["status"] == "INVESTIGATING"
    settled = new["disposition"] not in (None, "UNDETERMINED") and text(new["closure_reason"])
    if (not allowed(I.CASE_TRANSITIONS, s["status"], new["status"]) or p["title"] is not None and not text(p["title"])
            or p["priority"] is not None and p["priority"] not in I.CASE_PRIORITIES
            or p["disposition"] is not None and p["disposition"] not in I.CASE_DISPOSITIONS
            or closing and not settled or again and not text(p["reopen_reason"])):
        return None
    reason = p["reason"] or ""
    if again:
        new |= {"disposition": "UNDETERMINED", "closure_reason": "", "closed_ms": None}
        return new, ("case.reopened", "reopen", p["reopen_reason"])
    if closing:
        new["closed_ms"] = p["at_ms"]
        return new, ("case.closed", "close", reason or new["closure_reason"])
    if new["status"] != s["status"]:
        return new, ("case.status_changed", "status_changed", reason)
    if new["owner"] != s["owner"]:
        return new, ("case.owner_changed", "owner_changed", reason)
    return new, ("case.updated", "update", reason)


def walk(objects, patches, step):
    states, audits, by = [], [], {}
    for p in patches:
        by.setdefault(p["k"], []).append(p)
    for s in objects:
        s = dict(s)
        for p in sorted(by.get(s["k"], []), key=lambda p: p["seq"]):
            if p["expected_version"] != s["version"] or (p["expected_version"] or 0) < 1:
                continue
            found = step(s, p)
            if found:
                audits.append((s["k"], *found[1], s["version"], s["version"] + 1, s["status"], found[0]["status"]))
                s |= found[0]
                s["version"] += 1
        states.append(tuple(s.values()))
    return sorted(states, key=repr), sorted(audits, key=repr)


def random_patches(rnd, n, keys, drift, objects, step, targets):
    """Patches in order that name the version their object really has by then, or one near it."""
    now, out = {s["k"]: dict(s) for s in objects}, []
    for i in range(n):
        k = rnd.choice(keys)
        p = {"k": k, "seq": i, "expected_version": now[k]["version"] + rnd.choice(drift),
             "status": rnd.choice([None] * 4 + targets), "title": rnd.choice([None, None, " ", f"t{i}"]),
             "owner": rnd.choice([None, "", OWNER]), "priority": rnd.choice([None, None, None, "P1_CRITICAL", "P9"]),
             "disposition": rnd.choice([None, None, "OTHER", "UNDETERMINED"]), "closure_reason": rnd.choice([None, "", "done"]),
             "reopen_reason": rnd.choice([None, "again"]), "reason": rnd.choice([None, "", f"r{i}"]), "at_ms": i}
        found = step(now[k], p) if p["expected_version"] == now[k]["version"] >= 1 else None
        if found:
            now[k] |= {**found[0], "version": now[k]["version"] + 1}
        out.append(p)
    rnd.shuffle(out)
    return out


OWNER = "018f47a2-4b00-7a00-8000-000000000001"
HOT = [1] * 30 + [2, 3, 4]


@pytest.mark.parametrize("kind", ["incident", "case"])
@pytest.mark.parametrize("seed, drift", [(0, [0]), (1, [0, 0, 0, -1, 1]), (2, [0, 0, -1, -2, 1, 2, 3]), (3, [0, 0, 0, 0, -5, 5])])
def test_changes_of_hot_objects_equal_a_plain_walk(spark, many_chunks, kind, seed, drift):
    rnd = random.Random(seed)
    rules = {"incident": I.INCIDENT, "case": I.CASE}[kind]
    table = {"incident": I.INCIDENT_TRANSITIONS, "case": I.CASE_TRANSITIONS}[kind]
    state = {"status": "OPEN", "priority": "P3_MEDIUM", "title": "New", "owner": "", "disposition": "UNDETERMINED",
             "closure_reason": "", "closed_ms": None}
    objects = [{"k": k, "version": v, **{f: state[f] for f in rules.fields}} for k, v in ((1, 1), (2, 1), (3, 2), (4, 1), (5, 7))]
    objects[3]["status"] = "NO SUCH"
    step = {"incident": plain_incident, "case": plain_case}[kind]
    targets = [t for t in table if t != "INVALIDATED"]
    rows = random_patches(rnd, 1_500, HOT, drift, objects, step, targets)
    rows += [{**rows[0], "k": 99}, {**rows[0], "k": None}, {**rows[1], "seq": 5_000, "expected_version": None}]
    a = spark.createDataFrame([tuple(o.values()) for o in objects], {"incident": INCIDENT, "case": CASE}[kind])
    b = spark.createDataFrame([tuple(p[f] for f in FIELDS) for p in rows], PATCH).repartition(3)
    states, audits = I.apply_changes(a, b, rules, ["k"], ["seq"])
    want_states, want_audits = walk(objects, [p for p in rows if p["k"] is not None], step)
    assert sorted(map(tuple, states.collect()), key=repr) == want_states
    assert sorted([(r.k, r.event_type, r.action, r.reason, r.before_version, r.after_version, r.before_status, r.after_status)
                   for r in audits.collect()], key=repr) == want_audits
    assert len(want_audits) > 150


def test_patches_of_one_object_in_many_chunks(spark, monkeypatch):
    """One object, a tenth of its patches too old; all chunks take part in one chain."""
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 20_000)
    n = 200_000
    names = "CAST(id - (id + 6) DIV 10 + 1 - CASE WHEN id % 10 = 3 THEN 7 ELSE 0 END AS INT)"
    patches = spark.range(n).selectExpr(
        "1L AS k", "id AS seq", f"{names} AS expected_version", "CAST(NULL AS STRING) AS status",
        "CASE WHEN id % 7 = 0 THEN concat('t', id) END AS title", "CAST(NULL AS STRING) AS owner",
        "CAST(NULL AS STRING) AS disposition", "'' AS reason")
    objects = spark.createDataFrame([(1, 1, "OPEN", "New", "", "")], INCIDENT)
    states, audits = I.apply_changes(objects, patches, I.INCIDENT, ["k"], ["seq"])
    version, title = 1, "New"
    for i in range(n):
        if i - (i + 6) // 10 + 1 - 7 * (i % 10 == 3) == version:
            version += 1
            title = f"t{i}" if i % 7 == 0 else title
    assert version > 100_000
    assert [(r.version, r.title) for r in states.collect()] == [(version, title)]
    assert audits.agg(F.count("*"), F.count_distinct("before_version"), F.max("after_version")).first()[:] == (version - 1, version - 1, version)


def test_changes_without_patches(spark):
    objects = spark.createDataFrame([(1, 3, "OPEN", "New", "", "")], INCIDENT)
    states, audits = I.apply_changes(objects, spark.createDataFrame([], PATCH), I.INCIDENT, ["k"], ["seq"])
    assert [tuple(r) for r in states.collect()] == [(1, 3, "OPEN", "New", "", "")] and audits.count() == 0


def test_views_list_every_link(spark):
    objects = spark.createDataFrame([("t", "a"), ("t", "b")], "tenant_id string, incident_id string")
    links = spark.range(5000).selectExpr("'t' AS tenant_id", "'a' AS incident_id", "concat('f', id) AS finding_id")
    out = I.with_links(objects, links, ["tenant_id", "incident_id"], "finding_id", "finding_count")
    rows = out.groupBy("incident_id").agg({"finding_id": "count", "finding_count": "max"}).collect()
    assert {tuple(r)[0]: set(tuple(r)[1:]) for r in rows} == {"a": {5000}, "b": {0}}
    assert out.count() == 5001


def test_case_links_meet_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(I, "TASK_LINKS", 500)
    objects = spark.range(40).select(F.lit("t").alias("tenant_id"), F.concat(F.lit("c"), "id").alias("case_id"),
                                     F.concat(F.lit("i"), "id").alias("incident_id"))
    incidents = objects.select("tenant_id", "incident_id")
    made = spark.range(1_000).select(F.lit("t").alias("tenant_id"), F.concat(F.lit("f"), "id").alias("finding_id"),
                                     F.concat(F.lit("i"), F.col("id") % 40).alias("incident_id"))
    entities = spark.range(4_000).select(F.lit("t").alias("tenant_id"), F.concat(F.lit("f"), F.col("id") % 1_000).alias("finding_id"),
                                         F.concat(F.lit("e"), F.col("id") % 300).alias("entity_id"), F.lit("TARGET").alias("role"))
    for given in (None, 4_000):
        out = I.case_links(objects, incidents, made, entities.union(entities.limit(7)) if given is None else entities, given)
        plan = out._jdf.queryExecution().executedPlan().toString()
        tasks = 9 if given is None else 8
        assert f", {tasks}), REPARTITION_BY_NUM" in plan
        links = [tuple(r) for r in out.collect()]
        want = {("c%d" % (i % 1_000 % 40), "e%d" % (i % 300)) for i in range(4_000)}
        assert {(c, o) for _, c, kind, o, _ in links if kind == "ENTITY"} == want
        assert len(links) == len(set(links)) == len(want) + 1_000 + 40
