"""Investigation jobs: entities, risk ledger, incidents, cases, audit, timeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siemspark.functions.scalars import has_text, is_uuid_v7
from siemspark.operators.changes import Rules, apply_changes, one_of as any_of, texts, written  # noqa: F401

# Allowed state changes and closed value sets.
INCIDENT_TRANSITIONS = {
    "OPEN": ["TRIAGED", "INVALIDATED"],
    "TRIAGED": ["INVESTIGATING", "RESOLVED", "INVALIDATED"],
    "INVESTIGATING": ["CONTAINED", "RESOLVED", "INVALIDATED"],
    "CONTAINED": ["RESOLVED"],
    "RESOLVED": ["CLOSED", "INVESTIGATING"],
    "CLOSED": ["INVESTIGATING"],
    "INVALIDATED": [],
}
CASE_TRANSITIONS = {
    "OPEN": ["TRIAGE"],
    "TRIAGE": ["INVESTIGATING", "ON_HOLD", "RESOLVED"],
    "INVESTIGATING": ["ON_HOLD", "RESPONSE", "RESOLVED"],
    "ON_HOLD": ["TRIAGE", "INVESTIGATING", "RESPONSE"],
    "RESPONSE": ["ON_HOLD", "RESOLVED"],
    "RESOLVED": ["CLOSED", "INVESTIGATING"],
    "CLOSED": ["INVESTIGATING"],
}
CASE_PRIORITIES = ["P1_CRITICAL", "P2_HIGH", "P3_MEDIUM", "P4_LOW"]
CASE_DISPOSITIONS = ["UNDETERMINED", "CONFIRMED_INCIDENT", "BENIGN_ACTIVITY", "FALSE_POSITIVE",
                     "DUPLICATE", "TEST", "OTHER"]

LEDGER_ROWS = 200
TASK_LINKS = 500_000


# --- state changes ---------------------------------------------------------

def _allowed(table: dict[str, list[str]], old: Column, new: Column) -> Column:
    expr = new == old
    for source, targets in table.items():
        if targets:
            expr = expr | ((old == source) & new.isin(*targets))
    return expr & new.isin(*table)


def _owner_ok(owner: Column) -> Column:
    return owner.isNull() | (owner == "") | is_uuid_v7(owner)


def _set(s: Column, p: Column, name: str) -> Column:
    return F.coalesce(p[name], s[name])


def _incident_check(s, p):
    return (_allowed(INCIDENT_TRANSITIONS, s["status"], _set(s, p, "status"))
            & (p["title"].isNull() | has_text(p["title"])) & _owner_ok(p["owner"]))


def _incident_change(s, p):
    return {n: _set(s, p, n) for n in ("status", "title", "owner", "disposition")}


def _incident_event(s, n, p):
    moved = n["status"] != s["status"]
    return (F.when(moved, "incident.status_changed").otherwise("incident.updated"),
            F.when(moved, "status_changed").otherwise("update"), p["reason"])


def _place(value, values):
    """Index in a list; null if it is not there."""
    return F.nullif(F.array_position(F.lit(list(values)), value), F.lit(0)) - 1


def _incident_writes(s, p):
    return {n: written(p[n], p[n].isNotNull()) for n in ("title", "owner", "disposition")}


INCIDENT = Rules("incident", ("status", "title", "owner", "disposition"),
                 ("status", "title", "owner", "disposition", "reason"),
                 _incident_check, _incident_change, _incident_event,
                 {"status": any_of(INCIDENT_TRANSITIONS), "title": texts(has_text, "t", " "), "owner": texts(_owner_ok, "", "?")},
                 tuple({"status": s} for s in INCIDENT_TRANSITIONS),
                 lambda s: _place(s["status"], INCIDENT_TRANSITIONS), ("status",), _incident_writes)


def _closing(s, p):
    return (_set(s, p, "status") == "CLOSED") & (s["status"] != "CLOSED")


def _reopening(s, p):
    return (s["status"] == "CLOSED") & (_set(s, p, "status") == "INVESTIGATING")


def _case_check(s, p):
    closable = (_set(s, p, "disposition") != "UNDETERMINED") & has_text(_set(s, p, "closure_reason"))
    return (_allowed(CASE_TRANSITIONS, s["status"], _set(s, p, "status"))
            & (p["priority"].isNull() | p["priority"].isin(*CASE_PRIORITIES))
            & (p["title"].isNull() | has_text(p["title"])) & _owner_ok(p["owner"])
            & (p["disposition"].isNull() | p["disposition"].isin(*CASE_DISPOSITIONS))
            & (~_closing(s, p) | closable) & (~_reopening(s, p) | has_text(p["reopen_reason"])))


def _case_change(s, p):
    again = _reopening(s, p)
    out = {n: _set(s, p, n) for n in ("status", "priority", "title", "owner")}
    out["disposition"] = F.when(again, "UNDETERMINED").otherwise(_set(s, p, "disposition"))
    out["closure_reason"] = F.when(again, "").otherwise(_set(s, p, "closure_reason"))
    out["closed_ms"] = F.when(again, F.lit(None).cast("long")).when(
        _closing(s, p), p["at_ms"]).otherwise(s["closed_ms"])
    return out


def _case_event(s, n, p):
    again, closed = _reopening(s, p), _closing(s, p)
    moved = n["status"] != s["status"]
    owner = ~n["owner"].eqNullSafe(s["owner"])
    reason = F.coalesce(p["reason"], F.lit(""))
    return (F.when(again, "case.reopened").when(closed, "case.closed")
            .when(moved, "case.status_changed").when(owner, "case.owner_changed").otherwise("case.updated"),
            F.when(again, "reopen").when(closed, "close").when(moved, "status_changed")
            .when(owner, "owner_changed").otherwise("update"),
            F.when(again, p["reopen_reason"]).when(closed & (reason == ""), n["closure_reason"])
            .otherwise(reason))


def _case_index(s):
    decided = F.coalesce(s["disposition"] != "UNDETERMINED", F.lit(False)).cast("int")
    return (_place(s["status"], CASE_TRANSITIONS) * 4 + decided * 2
            + F.coalesce(has_text(s["closure_reason"]), F.lit(False)).cast("int"))


def _case_writes(s, p):
    again = F.coalesce(_reopening(s, p), F.lit(False))
    out = {n: written(p[n], p[n].isNotNull()) for n in ("priority", "title", "owner")}
    out["disposition"] = written(F.when(again, "UNDETERMINED").otherwise(p["disposition"]), again | p["disposition"].isNotNull())
    out["closure_reason"] = written(F.when(again, "").otherwise(p["closure_reason"]), again | p["closure_reason"].isNotNull())
    out["closed_ms"] = written(F.when(~again, p["at_ms"]), again | F.coalesce(_closing(s, p), F.lit(False)))
    return out


CASE = Rules("case", ("status", "priority", "title", "owner", "disposition", "closure_reason", "closed_ms"),
             ("status", "priority", "title", "owner", "disposition", "closure_reason", "reopen_reason",
              "reason", "at_ms"), _case_check, _case_change, _case_event,
             {"status": any_of(CASE_TRANSITIONS), "priority": texts(lambda c: c.isin(*CASE_PRIORITIES), "P4_LOW", "?"),
              "title": texts(has_text, "t", " "), "owner": texts(_owner_ok, "", "?"),
              "disposition": any_of(CASE_DISPOSITIONS), "closure_reason": texts(has_text, "t", " "),
              "reopen_reason": texts(has_text, "t", " ")},
             # A case can close if its disposition is decided and its reason has text.
             tuple({"status": s, "disposition": d, "closure_reason": r} for s in CASE_TRANSITIONS
                   for d in ("UNDETERMINED", "OTHER") for r in ("", "text")),
             _case_index, ("status",), _case_writes)


# --- ledger and views ------------------------------------------------------

def risk_ledger(contributions: DataFrame, limit: int = LEDGER_ROWS) -> DataFrame:
    """Newest contributions per entity with their rank.

    The rank filter is applied map-side first, so an entity with most of the
    rows costs ``limit`` rows per map task.
    """
    w = Window.partitionBy("tenant_id", "entity_id").orderBy(F.desc("created_ms"), F.desc("contribution_id"))
    return contributions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def unexpired_amounts(contributions: DataFrame, now_ms: int) -> DataFrame:
    """Sum of contributions still in force.  A plain sum, not a risk score."""
    live = contributions.where(F.col("expires_ms").isNull() | (F.col("expires_ms") > now_ms))
    return live.groupBy("tenant_id", "entity_id").agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("contributions"))


def finding_relations(relations: DataFrame, findings: DataFrame) -> DataFrame:
    """Entity relations of findings that exist."""
    return relations.join(findings.select("tenant_id", "finding_id"), ["tenant_id", "finding_id"], "left_semi")


def link_counts(links: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Members per object; copies of a link count once per row, and counting combines map-side."""
    return links.groupBy(*key).agg(F.count(F.lit(1)).alias(name))


def with_links(objects: DataFrame, links: DataFrame, key: Sequence[str], member: str, name: str) -> DataFrame:
    """One row per member of every object, with the object's columns and its member count (``name``).

    All links are rows, so an object may have any number; one without links has a
    row with a null member and count 0.
    """
    key = list(key)
    return (objects.join(link_counts(links, key, name), key, "left").join(links.select(*key, member), key, "left")
            .withColumn(name, F.coalesce(name, F.lit(0).cast("long"))))


# --- cases from incidents --------------------------------------------------

def case_number(case_id) -> Column:
    return F.concat(F.lit("CASE-"), F.upper(F.substring(F.replace(case_id, F.lit("-"), F.lit("")), 1, 12)))


def link_tasks(rows: int) -> int:
    """Tasks for link rows.  Their texts repeat, so a task of a fixed compressed size would hold many millions in memory."""
    return max(1, -(-rows // TASK_LINKS))


def case_links(cases: DataFrame, incidents: DataFrame, incident_findings: DataFrame,
               finding_entities: DataFrame, rows: int | None = None) -> DataFrame:
    """Everything a new case takes over from its incident, as link rows.

    Findings and their entities meet in tasks of about ``TASK_LINKS`` rows; ``rows`` says how many relations there are
    at most, else they are counted.
    """
    n = link_tasks(finding_entities.count() if rows is None else rows)
    by_finding = (n, "tenant_id", "finding_id")
    source = (cases.select("tenant_id", "case_id", "incident_id")
              .join(incidents.select("tenant_id", "incident_id"), ["tenant_id", "incident_id"], "left_semi"))
    findings = (source.join(incident_findings, ["tenant_id", "incident_id"])
                .select("tenant_id", "case_id", "finding_id").repartition(*by_finding).distinct())
    entities = (findings.join(finding_entities.select("tenant_id", "finding_id", "entity_id").repartition(*by_finding),
                              ["tenant_id", "finding_id"])
                .select("tenant_id", "case_id", "entity_id").repartition(n, "tenant_id", "case_id", "entity_id").distinct())

    def leg(df, kind, column, relation):
        return df.select("tenant_id", "case_id", F.lit(kind).alias("object_type"),
                         F.col(column).alias("object_id"), F.lit(relation).alias("relation"))

    return (leg(source, "INCIDENT", "incident_id", "SOURCE_INCIDENT")
            .unionByName(leg(findings, "FINDING", "finding_id", "INCIDENT_FINDING"))
            .unionByName(leg(entities, "ENTITY", "entity_id", "FINDING_ENTITY")))


def case_timeline(cases: DataFrame, case_incidents: DataFrame, incidents: DataFrame,
                  case_findings: DataFrame, findings: DataFrame, audit: DataFrame) -> DataFrame:
    """Incidents, findings and audit events of existing cases, in time order within each case."""
    here = cases.select("tenant_id", "case_id")

    def shape(df, kind, object_id, title, actor, source, detail):
        return df.select("tenant_id", "case_id", F.col("created_ms").alias("timestamp_ms"),
                         F.lit(kind).alias("entry_type"), F.col(object_id).alias("object_id"),
                         title.alias("title"), actor.alias("actor"), F.lit(source).alias("source"),
                         detail.alias("detail"))

    none = F.lit("")
    legs = [
        shape(case_incidents.join(incidents, ["tenant_id", "incident_id"]), "INCIDENT", "incident_id",
              F.col("title"), none, "case_incidents",
              F.concat_ws(",", "status", F.col("version").cast("string"))),
        shape(case_findings.join(findings, ["tenant_id", "finding_id"]), "FINDING", "finding_id",
              F.concat(F.lit("Finding "), "finding_id"), none, "case_findings", none),
        shape(audit.where(F.col("object_type") == "case").withColumn("case_id", F.col("object_id")),
              "AUDIT", "audit_event_id", F.col("event_type"), F.col("actor_id"), "audit_events",
              F.concat_ws(",", "action", "result")),
    ]
    out = legs[0].unionByName(legs[1]).unionByName(legs[2])
    return (out.join(here, ["tenant_id", "case_id"], "left_semi")
            .repartition("tenant_id", "case_id")
            .sortWithinPartitions("tenant_id", "case_id", "timestamp_ms", "entry_type", "object_id"))


def audit_list(audit: DataFrame, tenant_id: str, object_type: str = "", object_id: str = "",
               after: str | None = None, limit: int = 50) -> DataFrame:
    from siemspark.operators.search import keyset_list

    out = audit.where(F.col("tenant_id") == tenant_id)
    if object_type:
        out = out.where(F.col("object_type") == object_type)
    if object_id:
        out = out.where(F.col("object_id") == object_id)
    return keyset_list(out, "audit_event_id", after, limit)


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Aliases listed more than once for one entity."""
    keys = ["tenant_id", "alias_type", "alias_value", "entity_id"]
    return aliases.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries")).where(F.col("entries") > 1)


# --- checks and comparison -------------------------------------------------

# Roles of an entity in a finding.
ENTITY_ROLES = ["SUBJECT", "SOURCE", "DESTINATION", "ACTOR", "TARGET", "AFFECTED", "RELATED"]


def seen_order() -> Column:
    return F.col("last_seen_ms") >= F.col("first_seen_ms")


def window_pair() -> Column:
    """Both ends of a window or none, and in order."""
    start, end = F.col("window_start_ms"), F.col("window_end_ms")
    return (start.isNull() & end.isNull()) | (F.coalesce(end >= start, F.lit(False)))


def closed_case() -> Column:
    """A closed case has a closing time, a decided disposition and a reason; no other case has a closing time."""
    closed = F.col("status") == "CLOSED"
    settled = (F.col("closed_ms").isNotNull() & (F.col("disposition") != "UNDETERMINED")
               & F.coalesce(has_text("closure_reason"), F.lit(False)))
    return F.when(closed, settled).otherwise(F.col("closed_ms").isNull())


def one_of(name: str, values: Sequence[str]) -> Column:
    """A required value of a closed set."""
    return F.coalesce(F.col(name).isin(*values), F.lit(False))


def check_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Number of rows that break each rule; a rule that is NULL holds."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(True))).alias(n) for n, ok in rules.items()])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in rules])).alias("_r")).select("_r.*")


def check_reference(df: DataFrame, parent: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    missing = df.select(*key).join(parent.select(*key).distinct(), list(key), "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def check_unique(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return groups.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def compare_runs(left: DataFrame, right: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Rows of one run that the other lacks, ids and clocks left out.

    Rows are counted per content on both sides, so repeats are compared too.
    """
    columns = [c for c in left.columns if c not in ignore]
    both = (left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
            .unionByName(right.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r"))))
    return (both.groupBy(*columns).agg(F.sum("_l").alias("left_rows"), F.sum("_r").alias("right_rows"))
            .where(F.col("left_rows") != F.col("right_rows")))
