"""Investigation queries over customers, orders and order lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siemspark.operators import invest as I
from siemspark.operators.search import keyset_list
from siemspark.plans.fixtures import CTE, numbered_lines, with_ctes
from siemspark.plans.registry import query


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _tenant(key):
    return _cat("tenant-", (F.col(key) % 3).cast("string"))


def _name(prefix, key):
    return _cat(prefix, F.lpad(F.col(key).cast("string"), 9, "0"))


def entities(t):
    """Customers and suppliers as entities."""
    c = t.read("customer").select(_name("cust-", "c_custkey").alias("entity_id"), F.col("c_name").alias("display_name"),
                                  F.lit("USER").alias("entity_type"), F.col("c_custkey").alias("k"))
    s = t.read("supplier").select(_name("supp-", "s_suppkey").alias("entity_id"), _name("Supplier ", "s_suppkey").alias("display_name"),
                                  F.lit("HOST").alias("entity_type"), F.col("s_suppkey").cast("long").alias("k"))
    return c.unionByName(s)


def findings(t):
    return t.read("orders").select(
        _tenant("o_custkey").alias("tenant_id"), _name("finding-", "o_orderkey").alias("finding_id"),
        _name("inc-", "o_custkey").alias("incident_id"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"),
        (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1000).alias("created_ms"))


def finding_entities(t):
    actors = t.read("orders").select(_tenant("o_custkey").alias("tenant_id"), _name("finding-", "o_orderkey").alias("finding_id"),
                                     _name("cust-", "o_custkey").alias("entity_id"), F.lit("ACTOR").alias("role"))
    lines = t.read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    lines = lines.repartition(I.link_tasks(lines.count()), "o_orderkey").distinct()
    targets = (lines.join(t.read("orders").select("o_orderkey", "o_custkey"), "o_orderkey")
               .select(_tenant("o_custkey").alias("tenant_id"), _name("finding-", "o_orderkey").alias("finding_id"),
                       _name("supp-", "l_suppkey").alias("entity_id"), F.lit("TARGET").alias("role")))
    return actors.unionByName(targets)


def incidents(t):
    return (findings(t).groupBy("tenant_id", "incident_id", "c")
            .agg(F.min("created_ms").alias("created_ms"))
            .select("tenant_id", "incident_id", "c", "created_ms", F.lit(1).alias("version"), F.lit("OPEN").alias("status"),
                    _cat("Incident ", F.col("incident_id")).alias("title"), F.lit("").alias("owner"), F.lit("").alias("disposition")))


def cases(t):
    return incidents(t).select("tenant_id", F.regexp_replace("incident_id", "^inc-", "case-").alias("case_id"), "incident_id", "c",
                               "created_ms")


_N = "lpad({0}::VARCHAR, 9, '0')"

CTE["inv"] = f"""
ent AS (SELECT 'cust-' || {_N.format('c_custkey')} AS entity_id, c_name AS display_name, 'USER' AS entity_type FROM customer
  UNION ALL SELECT 'supp-' || {_N.format('s_suppkey')}, 'Supplier ' || {_N.format('s_suppkey')}, 'HOST' FROM supplier),
fnd AS (SELECT 'tenant-' || (o_custkey % 3) AS tenant_id, 'finding-' || {_N.format('o_orderkey')} AS finding_id, 'inc-' || {_N.format('o_custkey')} AS incident_id,
  'case-' || {_N.format('o_custkey')} AS case_id, o_orderkey AS k, o_custkey AS c, epoch(o_orderdate)::BIGINT * 1000 AS created_ms FROM orders),
fe AS (SELECT tenant_id, finding_id, 'cust-' || {_N.format('c')} AS entity_id, 'ACTOR' AS role FROM fnd
  UNION ALL SELECT DISTINCT f.tenant_id, f.finding_id, 'supp-' || {_N.format('l_suppkey')}, 'TARGET' FROM lineitem JOIN fnd f ON l_orderkey = f.k),
inc AS (SELECT tenant_id, incident_id, case_id, c, min(created_ms) AS created_ms FROM fnd GROUP BY ALL),
con AS (SELECT 'tenant-' || (o_custkey % 3) AS tenant_id, 'cust-' || {_N.format('o_custkey')} AS entity_id, 'con-' || {_N.format('l_orderkey')} || '-' || lpad(seq::VARCHAR, 4, '0') AS contribution_id,
  l_extendedprice::DECIMAL(18,4) AS amount, epoch(l_shipdate)::BIGINT * 1000 AS created_ms,
  CASE WHEN l_returnflag <> 'N' THEN epoch(l_shipdate)::BIGINT * 1000 + 34560000000 END AS expires_ms FROM li JOIN orders ON l_orderkey = o_orderkey)"""


def contributions(t):
    li = numbered_lines(t.read("lineitem")).withColumnRenamed("l_orderkey", "o_orderkey")
    ship = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * 1000
    return (li.join(t.read("orders").select("o_orderkey", "o_custkey"), "o_orderkey")
            .select(_tenant("o_custkey").alias("tenant_id"), _name("cust-", "o_custkey").alias("entity_id"),
                    _cat(_name("con-", "o_orderkey"), "-", F.lpad(F.col("seq").cast("string"), 4, "0")).alias("contribution_id"),
                    F.col("l_extendedprice").cast("decimal(18,4)").alias("amount"), ship.alias("created_ms"),
                    F.when(F.col("l_returnflag") != "N", ship + 86_400_000 * 400).alias("expires_ms")))


@query("entity_list", with_ctes("li", "inv", body="""
    SELECT entity_id, display_name, entity_type FROM ent WHERE entity_id > 'cust-000000050' ORDER BY entity_id LIMIT 201"""))
def entity_list(t):
    return keyset_list(entities(t).select("entity_id", "display_name", "entity_type"), "entity_id", "cust-000000050", 200)


@query("entity_seen", with_ctes("li", "inv", body="""
    SELECT e.entity_id, count(*) AS findings, min(f.created_ms) AS first_seen_ms, max(f.created_ms) AS last_seen_ms
    FROM fe e JOIN fnd f USING (tenant_id, finding_id) GROUP BY 1"""))
def entity_seen(t):
    return (finding_entities(t).join(findings(t), ["tenant_id", "finding_id"]).groupBy("entity_id")
            .agg(F.count(F.lit(1)).alias("findings"), F.min("created_ms").alias("first_seen_ms"),
                 F.max("created_ms").alias("last_seen_ms")))


@query("risk_ledger", with_ctes("li", "inv", body="""
    r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, entity_id ORDER BY created_ms DESC, contribution_id DESC)::INTEGER AS rank FROM con)
    SELECT tenant_id, entity_id, contribution_id, amount::DOUBLE AS amount, created_ms, rank FROM r WHERE rank <= 200"""))
def risk_ledger(t):
    return I.risk_ledger(contributions(t)).select(
        "tenant_id", "entity_id", "contribution_id", F.col("amount").cast("double").alias("amount"), "created_ms", "rank")


@query("unexpired_amounts", with_ctes("li", "inv", body="""
    SELECT tenant_id, entity_id, sum(amount)::DOUBLE AS amount, count(*) AS contributions FROM con
    WHERE expires_ms IS NULL OR expires_ms > 900000000000 GROUP BY ALL"""))
def unexpired_amounts(t):
    out = I.unexpired_amounts(contributions(t), 900_000_000_000)
    return out.withColumn("amount", F.col("amount").cast("double"))


@query("finding_entities", with_ctes("li", "inv", body="SELECT tenant_id, finding_id, entity_id, role FROM fe"))
def finding_entities_query(t):
    return I.finding_relations(finding_entities(t), findings(t)).select("tenant_id", "finding_id", "entity_id", "role")


@query("incident_view", with_ctes("li", "inv", body="""
    SELECT tenant_id, incident_id, min(created_ms) OVER w AS created_ms, count(*) OVER w AS finding_ids_count, finding_id
    FROM fnd WINDOW w AS (PARTITION BY tenant_id, incident_id)"""))
def incident_view(t):
    """Every finding of every incident, with the incident's columns and its count."""
    v = I.with_links(incidents(t), findings(t), ["tenant_id", "incident_id"], "finding_id", "finding_ids_count")
    return v.select("tenant_id", "incident_id", "created_ms", "finding_ids_count", "finding_id")


def case_links(t):
    # An actor per order and at most one target per line.
    return I.case_links(cases(t), incidents(t), findings(t).select("tenant_id", "incident_id", "finding_id"), finding_entities(t),
                        t.read("orders").count() + t.read("lineitem").count())


CTE["cl"] = """
cl AS (SELECT DISTINCT tenant_id, case_id, 'INCIDENT' AS object_type, incident_id AS object_id, 'SOURCE_INCIDENT' AS relation FROM inc
  UNION ALL SELECT DISTINCT tenant_id, case_id, 'FINDING', finding_id, 'INCIDENT_FINDING' FROM fnd
  UNION ALL SELECT DISTINCT f.tenant_id, f.case_id, 'ENTITY', e.entity_id, 'FINDING_ENTITY' FROM fnd f JOIN fe e USING (tenant_id, finding_id))"""


@query("case_fanout", with_ctes("li", "inv", "cl", body="SELECT * FROM cl"))
def case_fanout(t):
    return case_links(t)


@query("case_view", with_ctes("li", "inv", "cl", body="""
    SELECT tenant_id, case_id, 'CASE-' || upper(substr(replace(case_id, '-', ''), 1, 12)) AS case_number, object_type, object_id,
      count(*) OVER (PARTITION BY tenant_id, case_id, object_type) AS members FROM cl"""))
def case_view(t):
    """Every incident, finding and entity of every case, with its number of each kind."""
    links = case_links(t)
    # Counts are the build side of a hash join, so that tasks need not sort the links.
    counts = I.link_counts(links, ["tenant_id", "case_id", "object_type"], "members").hint("shuffle_hash")
    return (links.join(counts, ["tenant_id", "case_id", "object_type"])
            .select("tenant_id", "case_id", I.case_number("case_id").alias("case_number"), "object_type", "object_id",
                    "members"))


# Patches: one per order line, on the incident / case of the order's line number group.
_TARGETS = "['TRIAGED','INVESTIGATING','CONTAINED','RESOLVED','CLOSED','INVALIDATED','INVESTIGATING']"
_CASE_TARGETS = "['TRIAGE','INVESTIGATING','RESPONSE','RESOLVED','CLOSED','INVESTIGATING','ON_HOLD']"

CTE["pat"] = f"""
pat AS (SELECT l_orderkey AS k, seq, (seq - CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END)::INTEGER AS named, l_partkey, l_suppkey,
  CASE WHEN l_partkey % 7 <> 0 THEN {_TARGETS}[(seq - 1) % 7 + 1] END AS target, CASE WHEN l_partkey % 7 <> 0 THEN {_CASE_TARGETS}[(seq - 1) % 7 + 1] END AS case_target,
  CASE WHEN l_suppkey % 9 = 0 THEN ' ' WHEN l_suppkey % 9 = 1 THEN 'Title ' || l_suppkey END AS new_title,
  CASE WHEN l_partkey % 3 = 0 THEN 'OTHER' WHEN l_partkey % 3 = 1 THEN 'NOPE' END AS new_disposition,
  CASE WHEN l_suppkey % 2 = 0 THEN 'done' END AS new_closure, CASE WHEN l_suppkey % 3 = 0 THEN 'again' ELSE '' END AS reopen,
  epoch(l_shipdate)::BIGINT * 1000 AS at_ms FROM li)"""


def patches(t, targets):
    li = numbered_lines(t.read("lineitem"))
    names = F.array(*[F.lit(x) for x in targets])
    pick = F.element_at(names, ((F.col("seq") - 1) % 7 + 1).cast("int"))
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    return li.select(
        F.col("l_orderkey").alias("k"), "seq",
        (F.col("seq") - F.when(part % 5 == 0, 1).otherwise(0)).alias("expected_version"),
        F.when(part % 7 != 0, pick).alias("status"),
        F.when(supp % 9 == 0, " ").when(supp % 9 == 1, _cat("Title ", supp.cast("string"))).alias("title"),
        F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("priority"),
        F.when(part % 3 == 0, "OTHER").when(part % 3 == 1, "NOPE").alias("disposition"),
        F.when(supp % 2 == 0, "done").alias("closure_reason"), F.when(supp % 3 == 0, "again").otherwise("").alias("reopen_reason"),
        F.lit("").alias("reason"), (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * 1000).alias("at_ms"))


def incident_objects(t):
    return t.read("orders").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("version"), F.lit("OPEN").alias("status"),
                                   F.lit("New").alias("title"), F.lit("").alias("owner"), F.lit("").alias("disposition"))


def case_objects(t):
    return t.read("orders").select(
        F.col("o_orderkey").alias("k"), F.lit(1).alias("version"), F.lit("OPEN").alias("status"), F.lit("P3_MEDIUM").alias("priority"),
        F.lit("New").alias("title"), F.lit("").alias("owner"), F.lit("UNDETERMINED").alias("disposition"),
        F.lit("").alias("closure_reason"), F.lit(None).cast("long").alias("closed_ms"))


INCIDENT_TARGETS = ["TRIAGED", "INVESTIGATING", "CONTAINED", "RESOLVED", "CLOSED", "INVALIDATED", "INVESTIGATING"]
CASE_TARGETS = ["TRIAGE", "INVESTIGATING", "RESPONSE", "RESOLVED", "CLOSED", "INVESTIGATING", "ON_HOLD"]


def incident_changes(t):
    return I.apply_changes(incident_objects(t), patches(t, INCIDENT_TARGETS), I.INCIDENT, ["k"], ["seq"])


def case_changes(t):
    return I.apply_changes(case_objects(t), patches(t, CASE_TARGETS), I.CASE, ["k"], ["seq"])


def _allowed_sql(table):
    pairs = [f"('{a}','{b}')" for a, bs in table.items() for b in bs]
    return "(s.status = p.tgt OR (s.status, p.tgt) IN (" + ", ".join(pairs) + "))"


# One patch after the other, by recursion.
CTE["walk_inc"] = f"""
pi AS (SELECT *, coalesce(target, '') AS t0 FROM pat),
wi AS (SELECT o_orderkey AS k, 0 AS pos, 1 AS version, 'OPEN' AS status, 'New' AS title, '' AS disposition, false AS hit, NULL::VARCHAR AS old FROM orders
  UNION ALL
  SELECT s.k, p.seq, CASE WHEN p.ok THEN s.version + 1 ELSE s.version END, CASE WHEN p.ok THEN p.tgt ELSE s.status END,
    CASE WHEN p.ok THEN coalesce(p.new_title, s.title) ELSE s.title END, CASE WHEN p.ok THEN coalesce(p.new_disposition, s.disposition) ELSE s.disposition END, p.ok, s.status
  FROM wi s JOIN LATERAL (SELECT p.*, coalesce(p.target, s.status) AS tgt,
      p.named >= 1 AND p.named = s.version AND coalesce(trim(p.new_title) <> '', true) AND (coalesce(p.target, s.status) = s.status OR (s.status || '>' || p.target) IN
      ({", ".join("'" + a + ">" + b + "'" for a, bs in I.INCIDENT_TRANSITIONS.items() for b in bs)})) AS ok FROM pi p WHERE p.k = s.k AND p.seq = s.pos + 1) p ON true)"""

CTE["walk_case"] = f"""
wc AS (SELECT o_orderkey AS k, 0 AS pos, 1 AS version, 'OPEN' AS status, 'New' AS title, 'UNDETERMINED' AS disposition, '' AS closure, NULL::BIGINT AS closed_ms, false AS hit, NULL::VARCHAR AS old, '' AS reopen FROM orders
  UNION ALL
  SELECT s.k, p.seq, CASE WHEN p.ok THEN s.version + 1 ELSE s.version END, CASE WHEN p.ok THEN p.tgt ELSE s.status END,
    CASE WHEN p.ok THEN coalesce(p.new_title, s.title) ELSE s.title END,
    CASE WHEN NOT p.ok THEN s.disposition WHEN s.status = 'CLOSED' AND p.tgt = 'INVESTIGATING' THEN 'UNDETERMINED' ELSE p.disp END,
    CASE WHEN NOT p.ok THEN s.closure WHEN s.status = 'CLOSED' AND p.tgt = 'INVESTIGATING' THEN '' ELSE p.clo END,
    CASE WHEN NOT p.ok THEN s.closed_ms WHEN s.status = 'CLOSED' AND p.tgt = 'INVESTIGATING' THEN NULL WHEN s.status <> 'CLOSED' AND p.tgt = 'CLOSED' THEN p.at_ms ELSE s.closed_ms END,
    p.ok, s.status, p.reopen
  FROM wc s JOIN LATERAL (SELECT p.*, coalesce(p.case_target, s.status) AS tgt, coalesce(p.new_disposition, s.disposition) AS disp, coalesce(p.new_closure, s.closure) AS clo,
      p.named >= 1 AND p.named = s.version AND coalesce(trim(p.new_title) <> '', true) AND coalesce(p.new_disposition <> 'NOPE', true)
      AND (coalesce(p.case_target, s.status) = s.status OR (s.status || '>' || p.case_target) IN ({", ".join("'" + a + ">" + b + "'" for a, bs in I.CASE_TRANSITIONS.items() for b in bs)}))
      AND (NOT (coalesce(p.case_target, s.status) = 'CLOSED' AND s.status <> 'CLOSED') OR (coalesce(p.new_disposition, s.disposition) <> 'UNDETERMINED' AND trim(coalesce(p.new_closure, s.closure)) <> ''))
      AND (NOT (s.status = 'CLOSED' AND coalesce(p.case_target, s.status) = 'INVESTIGATING') OR trim(p.reopen) <> '') AS ok FROM pat p WHERE p.k = s.k AND p.seq = s.pos + 1) p ON true)"""


def _recursive(*names, body):
    return "WITH RECURSIVE" + with_ctes(*names, body=body)[4:]


@query("incident_apply", _recursive("li", "pat", "walk_inc", body="""
    SELECT k, arg_max(version, pos)::INTEGER AS version, arg_max(status, pos) AS status, arg_max(title, pos) AS title, arg_max(disposition, pos) AS disposition FROM wi GROUP BY 1"""))
def incident_apply(t):
    return incident_changes(t)[0].select("k", "version", "status", "title", "disposition")


@query("case_apply", _recursive("li", "pat", "walk_case", body="""
    l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos DESC) AS rn FROM wc)
    SELECT k, version::INTEGER AS version, status, title, disposition, closure AS closure_reason, closed_ms FROM l WHERE rn = 1"""))
def case_apply(t):
    return case_changes(t)[0].select("k", "version", "status", "title", "disposition", "closure_reason", "closed_ms")


@query("audit_rows", _recursive("li", "pat", "walk_inc", "walk_case", body="""
    SELECT 'incident' AS object_type, k, CASE WHEN status <> old THEN 'incident.status_changed' ELSE 'incident.updated' END AS event_type,
      CASE WHEN status <> old THEN 'status_changed' ELSE 'update' END AS action, (version - 1)::INTEGER AS before_version, version::INTEGER AS after_version, old AS before_status, status AS after_status, '' AS reason FROM wi WHERE hit
    UNION ALL SELECT 'case', k, CASE WHEN old = 'CLOSED' AND status = 'INVESTIGATING' THEN 'case.reopened' WHEN old <> 'CLOSED' AND status = 'CLOSED' THEN 'case.closed' WHEN status <> old THEN 'case.status_changed' ELSE 'case.updated' END,
      CASE WHEN old = 'CLOSED' AND status = 'INVESTIGATING' THEN 'reopen' WHEN old <> 'CLOSED' AND status = 'CLOSED' THEN 'close' WHEN status <> old THEN 'status_changed' ELSE 'update' END,
      (version - 1)::INTEGER, version::INTEGER, old, status,
      CASE WHEN old = 'CLOSED' AND status = 'INVESTIGATING' THEN reopen WHEN old <> 'CLOSED' AND status = 'CLOSED' THEN closure ELSE '' END FROM wc WHERE hit"""))
def audit_rows(t):
    def rows(kind, changes):
        return changes[1].select(F.lit(kind).alias("object_type"), "k", "event_type", "action", "before_version", "after_version",
                                 "before_status", "after_status", F.coalesce("reason", F.lit("")).alias("reason"))

    return rows("incident", incident_changes(t)).unionByName(rows("case", case_changes(t)))


def audit_events(t):
    """One audit event per order: on its case or on its incident."""
    o = t.read("orders")
    on_case = F.col("o_orderkey") % 2 == 0
    return o.select(
        _tenant("o_custkey").alias("tenant_id"), _name("audit-", "o_orderkey").alias("audit_event_id"),
        F.when(on_case, "case").otherwise("incident").alias("object_type"),
        F.when(on_case, _name("case-", "o_custkey")).otherwise(_name("inc-", "o_custkey")).alias("object_id"),
        F.when(on_case, "case.updated").otherwise("incident.updated").alias("event_type"), F.lit("update").alias("action"),
        F.lit("SUCCESS").alias("result"), F.lit("analyst").alias("actor_id"),
        (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1000 + 500).alias("created_ms"))


CTE["aud"] = f"""
aud AS (SELECT 'tenant-' || (o_custkey % 3) AS tenant_id, 'audit-' || {_N.format('o_orderkey')} AS audit_event_id, CASE WHEN o_orderkey % 2 = 0 THEN 'case' ELSE 'incident' END AS object_type,
  CASE WHEN o_orderkey % 2 = 0 THEN 'case-' ELSE 'inc-' END || {_N.format('o_custkey')} AS object_id, epoch(o_orderdate)::BIGINT * 1000 + 500 AS created_ms FROM orders)"""


@query("audit_list", with_ctes("li", "inv", "aud", body="""
    SELECT audit_event_id, object_id FROM aud WHERE tenant_id = 'tenant-2' AND object_type = 'case' AND audit_event_id > 'audit-000000010' ORDER BY audit_event_id LIMIT 201"""))
def audit_list(t):
    return I.audit_list(audit_events(t), "tenant-2", "case", "", "audit-000000010", 200).select("audit_event_id", "object_id")


@query("case_timeline", with_ctes("li", "inv", "aud", body="""
    SELECT tenant_id, case_id, created_ms AS timestamp_ms, 'INCIDENT' AS entry_type, incident_id AS object_id, 'Incident ' || incident_id AS title, 'OPEN,1' AS detail FROM inc
    UNION ALL SELECT tenant_id, case_id, created_ms, 'FINDING', finding_id, 'Finding ' || finding_id, '' FROM fnd
    UNION ALL SELECT tenant_id, object_id, created_ms, 'AUDIT', audit_event_id, 'case.updated', 'update,SUCCESS' FROM aud WHERE object_type = 'case'"""))
def case_timeline(t):
    c = cases(t)
    tl = I.case_timeline(c, c.select("tenant_id", "case_id", "incident_id"), incidents(t),
                         findings(t).select("tenant_id", F.regexp_replace("incident_id", "^inc-", "case-").alias("case_id"), "finding_id"),
                         findings(t), audit_events(t))
    return tl.select("tenant_id", "case_id", "timestamp_ms", "entry_type", "object_id", "title", "detail")


# Orders and lines read as stored cases and incidents, some of them unsound.
CTE["stored"] = """
sc AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'OPEN' ELSE 'PENDING' END AS status,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 <> 0 OR o_orderkey % 37 = 0 THEN epoch(o_orderdate)::BIGINT * 1000 END AS closed_ms,
  CASE WHEN o_orderkey % 7 = 0 THEN 'UNDETERMINED' WHEN o_orderkey % 11 = 0 THEN 'NOPE' ELSE 'OTHER' END AS disposition,
  CASE WHEN o_orderkey % 13 <> 0 THEN 'done' ELSE ' ' END AS closure_reason,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'P1_CRITICAL' WHEN '2' THEN 'P2_HIGH' WHEN '3' THEN 'P3_MEDIUM' WHEN '4' THEN 'P4_LOW' ELSE 'P5' END AS priority FROM orders),
si AS (SELECT l_orderkey, l_linenumber, epoch(l_shipdate)::BIGINT * 1000 AS first_ms, epoch(l_shipdate)::BIGINT * 1000 + (l_partkey % 50 - 2) * 1000 AS last_ms,
  CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey::BIGINT END AS w0, CASE WHEN l_linenumber % 4 <> 0 THEN l_suppkey::BIGINT + 5 END AS w1 FROM lineitem)"""


@query("ops_constraints", with_ctes("li", "inv", "stored", body="""
    SELECT 'expiry_after_creation' AS "check", count(*) FILTER (expires_ms < created_ms) AS violations FROM con
    UNION ALL SELECT 'seen_order', count(*) FILTER (last_ms < first_ms) FROM si
    UNION ALL SELECT 'window_pair', count(*) FILTER (NOT (w0 IS NULL AND w1 IS NULL OR coalesce(w1 >= w0, false))) FROM si
    UNION ALL SELECT 'closed_case', count(*) FILTER (CASE WHEN status = 'CLOSED' THEN closed_ms IS NULL OR disposition = 'UNDETERMINED' OR trim(closure_reason) = '' ELSE closed_ms IS NOT NULL END) FROM sc
    UNION ALL SELECT 'case_status', count(*) FILTER (status = 'PENDING') FROM sc
    UNION ALL SELECT 'case_priority', count(*) FILTER (priority = 'P5') FROM sc
    UNION ALL SELECT 'case_disposition', count(*) FILTER (disposition = 'NOPE') FROM sc
    UNION ALL SELECT 'entity_role', count(*) FILTER (role NOT IN ('ACTOR', 'TARGET')) FROM fe
    UNION ALL SELECT 'contribution_entity', count(*) FILTER (e.entity_id IS NULL) FROM con LEFT JOIN (SELECT entity_id FROM ent WHERE display_name <> 'x') e USING (entity_id)
    UNION ALL SELECT 'relation_finding', count(*) FROM fe ANTI JOIN fnd USING (tenant_id, finding_id)
    UNION ALL SELECT 'line_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'finding_key', count(*) FROM (SELECT tenant_id, finding_id FROM fnd GROUP BY ALL HAVING count(*) > 1)
    UNION ALL SELECT 'one_line_per_number', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)"""))
def ops_constraints(t):
    con, relations, found = contributions(t), finding_entities(t), findings(t)
    o, k, state = t.read("orders"), F.col("o_orderkey"), F.col("o_orderstatus")
    urgency = F.substring("o_orderpriority", 1, 1)
    when = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1000
    stored = o.select(
        F.when(state == "F", "CLOSED").when(state == "O", "OPEN").otherwise("PENDING").alias("status"),
        F.when(((state == "F") & (k % 10 != 0)) | (k % 37 == 0), when).alias("closed_ms"),
        F.when(k % 7 == 0, "UNDETERMINED").when(k % 11 == 0, "NOPE").otherwise("OTHER").alias("disposition"),
        F.when(k % 13 != 0, "done").otherwise(" ").alias("closure_reason"),
        F.when(urgency == "1", "P1_CRITICAL").when(urgency == "2", "P2_HIGH").when(urgency == "3", "P3_MEDIUM")
        .when(urgency == "4", "P4_LOW").otherwise("P5").alias("priority"))
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    ship = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * 1000
    lines = t.read("lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", ship.alias("first_seen_ms"),
        (ship + (part % 50 - 2) * 1000).alias("last_seen_ms"), F.when(line % 3 != 0, part).alias("window_start_ms"),
        F.when(line % 4 != 0, F.col("l_suppkey") + 5).alias("window_end_ms"))
    checks = [
        I.check_rows(con, {"expiry_after_creation": F.col("expires_ms") >= F.col("created_ms")}),
        I.check_rows(lines, {"seen_order": I.seen_order(), "window_pair": I.window_pair()}),
        I.check_rows(stored, {"closed_case": I.closed_case(), "case_status": I.one_of("status", list(I.CASE_TRANSITIONS)),
                              "case_priority": I.one_of("priority", I.CASE_PRIORITIES),
                              "case_disposition": I.one_of("disposition", I.CASE_DISPOSITIONS)}),
        I.check_rows(relations, {"entity_role": I.one_of("role", I.ENTITY_ROLES)}),
        I.check_reference(con, entities(t), ["entity_id"], "contribution_entity"),
        I.check_reference(relations, found, ["tenant_id", "finding_id"], "relation_finding"),
        I.check_reference(lines, o, ["o_orderkey"], "line_order"),
        I.check_unique(found, ["tenant_id", "finding_id"], "finding_key"),
        I.check_unique(lines, ["o_orderkey", "l_linenumber"], "one_line_per_number")]
    return reduce(DataFrame.unionByName, checks)


@query("entity_alias", """
    SELECT 'tenant-' || (l_orderkey % 3) AS tenant_id, 'part' AS alias_type, 'p' || l_partkey AS alias_value, 'supp-' || lpad(l_suppkey::VARCHAR, 9, '0') AS entity_id, count(*) AS entries
    FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def entity_alias(t):
    rows = t.read("lineitem").select(
        _tenant("l_orderkey").alias("tenant_id"), F.lit("part").alias("alias_type"),
        _cat("p", F.col("l_partkey").cast("string")).alias("alias_value"), _name("supp-", "l_suppkey").alias("entity_id"))
    return I.alias_conflicts(rows)


@query("run_compare", """
    SELECT o_custkey, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS status, count(*) FILTER (false) AS left_rows, count(*) AS right_rows FROM orders WHERE o_totalprice > 400000 GROUP BY ALL
    UNION ALL SELECT o_custkey, o_orderstatus, count(*), count(*) FILTER (o_totalprice <= 400000) FROM orders GROUP BY ALL HAVING count(*) <> count(*) FILTER (o_totalprice <= 400000)""")
def run_compare(t):
    """Two runs that agree but for some rows; ids are ignored."""
    o = t.read("orders")
    left = o.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    right = o.select((F.col("o_orderkey") + 1).alias("o_orderkey"), "o_custkey",
                     F.when(F.col("o_totalprice") > 400_000, "X").otherwise(F.col("o_orderstatus")).alias("status"))
    return I.compare_runs(left, right, ignore=["o_orderkey"])
