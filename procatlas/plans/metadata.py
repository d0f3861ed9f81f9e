"""Queries for the workspace tables, over stand-ins for them.

Nations are workspaces, market segments of a nation programs, customers
processes, their orders findings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from procatlas.operators import tables as m
from procatlas.plans.registry import query
from procatlas.plans.standin import table

STATUS = "CASE {0} % 6 WHEN 0 THEN 'analyzed' WHEN 1 THEN 'converted' WHEN 2 THEN 'validating' WHEN 3 THEN 'validated' WHEN 4 THEN 'deployed' ELSE 'blocked' END"
PROCESS = {
    "id": "concat('id', CAST(c_custkey AS string))",
    "program_id": "concat(CAST(c_nationkey AS string), '-', c_mktsegment)",
    "source_hash": "concat('h', CAST(c_custkey AS string))",
    "bp_name": "c_name",
    "score": "CAST(c_custkey % 101 AS INT)",
    "status": STATUS.format("c_custkey"),
}
MEMBER = {
    "workspace_id": "CAST(c_nationkey AS string)",
    "user_id": "concat('u', CAST(CAST(floor(c_custkey / 10) AS BIGINT) AS string))",
    "role": "CASE CAST(floor(c_custkey / 10) AS BIGINT) % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'editor' ELSE 'viewer' END",
}
WORKSPACE = {
    "id": "CAST(n_nationkey AS string)",
    "name": "n_name",
    "artifact_storage_enabled": "n_nationkey % 2 = 0",
    "retention_days": "CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST(n_nationkey - 1 AS INT) END",
}


def _sql(name: str, mapping: dict, source: str, where: str = "", distinct: bool = False) -> str:
    return f"{name} AS (SELECT {'DISTINCT ' if distinct else ''}" + ", ".join(f"{v} AS {k}" for k, v in mapping.items()) + f" FROM {source}{' WHERE ' + where if where else ''})"


BASE = ",\n".join([
    _sql("processes", PROCESS, "customer"), _sql("members", MEMBER, "customer", distinct=True), _sql("workspaces", WORKSPACE, "nation"),
    "programs AS (SELECT DISTINCT concat(CAST(c_nationkey AS string), '-', c_mktsegment) AS id, CAST(c_nationkey AS string) AS workspace_id FROM customer)",
    "kids AS (SELECT o_orderkey AS id, concat('id', CAST(o_custkey AS string)) AS process_id FROM orders)",
    "audit AS (SELECT event_id AS id, CAST(user_id % 25 AS string) AS workspace_id, event_type AS event, ts AS audit_at, CASE WHEN user_id % 7 = 0 THEN NULL ELSE concat('actor-', CAST(user_id AS string)) END AS actor FROM events)",
])


def _with(sql: str, extra: str = "") -> str:
    return f"WITH {BASE}{', ' + extra if extra else ''}\n{sql}"


def _cols(mapping):
    return [f"{v} AS {k}" for k, v in mapping.items()]


def _processes(spark, sf):
    return table(spark, sf, "customer").selectExpr(*_cols(PROCESS), "c_mktsegment", "c_custkey", "c_acctbal")


def _members(spark, sf):
    return table(spark, sf, "customer").selectExpr(*_cols(MEMBER)).distinct()


def _workspaces(spark, sf):
    return table(spark, sf, "nation").selectExpr(*_cols(WORKSPACE))


def _programs(spark, sf):
    return table(spark, sf, "customer").selectExpr("concat(c_nationkey, '-', c_mktsegment) AS id", "CAST(c_nationkey AS string) AS workspace_id").distinct()


def _kids(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey AS id", "concat('id', o_custkey) AS process_id")


def _audit(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id AS id", "CAST(user_id % 25 AS string) AS workspace_id", "event_type AS event", "ts AS at",
        "CASE WHEN user_id % 7 = 0 THEN NULL ELSE concat('actor-', user_id) END AS actor",
    )


@query("upsert_processes", _with(f"""
SELECT coalesce(t.id, s.id) AS id, coalesce(t.program_id, s.program_id) AS program_id, coalesce(t.source_hash, s.source_hash) AS source_hash, coalesce(s.score, t.score) AS score, coalesce(t.status, s.status) AS status
FROM (SELECT p.* FROM processes p JOIN customer ON p.id = concat('id', CAST(c_custkey AS string)) WHERE c_mktsegment <> 'BUILDING') t
FULL JOIN (SELECT concat('new', CAST(c_custkey AS string)) AS id, concat(CAST(c_nationkey AS string), '-', c_mktsegment) AS program_id, concat('h', CAST(c_custkey AS string)) AS source_hash, CAST(7 AS INT) AS score, 'analyzed' AS status FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) s
ON t.program_id = s.program_id AND t.source_hash = s.source_hash"""))
def upsert_processes(spark, sf):
    columns = ["id", "program_id", "source_hash", "score", "status"]
    rows = _processes(spark, sf)
    target = rows.where("c_mktsegment <> 'BUILDING'").select(*columns)
    source = rows.where("c_mktsegment in ('BUILDING', 'MACHINERY')").selectExpr("concat('new', c_custkey) AS id", "program_id", "source_hash", "CAST(7 AS INT) AS score", "'analyzed' AS status")
    return m.upsert_processes(target, source)


@query("replace_findings", _with("""
SELECT id, process_id FROM kids WHERE process_id NOT IN (SELECT concat('id', CAST(c_custkey AS string)) FROM customer WHERE c_mktsegment = 'BUILDING')
UNION ALL SELECT c_custkey, concat('id', CAST(c_custkey AS string)) FROM customer WHERE c_mktsegment = 'BUILDING'"""))
def replace_findings(spark, sf):
    synced = _processes(spark, sf).where("c_mktsegment = 'BUILDING'")
    fresh = synced.select(F.col("c_custkey").alias("id"), F.col("id").alias("process_id"))
    return m.replace_children(_kids(spark, sf), fresh, fresh).select("id", "process_id")


LINES = "SELECT DISTINCT CAST(l_suppkey AS string) AS from_name, CAST(l_partkey AS string) AS to_name FROM lineitem WHERE l_returnflag {0} 'R'"


@query("insert_edges_ignore", f"{LINES.format('=')} EXCEPT {LINES.format('<>')}")
def insert_edges_ignore(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr(
        "'g' AS program_id", "CAST(l_suppkey AS string) AS from_name", "'object' AS from_type", "CAST(l_partkey AS string) AS to_name", "'application' AS to_type", "l_returnflag"
    )
    new, old = lines.where("l_returnflag = 'R'").drop("l_returnflag"), lines.where("l_returnflag <> 'R'").drop("l_returnflag").distinct()
    return m.insert_absent(old, new).select("from_name", "to_name")


@query("status_changes", _with(f"""
SELECT CAST(c_nationkey AS string) AS workspace_id, concat('id', CAST(c_custkey AS string)) AS subject_id, concat('{{"from":"', a, '","to":"', b, '","name":"', c_name, '"}}') AS detail
FROM (SELECT *, {STATUS.format('c_custkey')} AS a, {STATUS.format('(c_custkey + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)')} AS b FROM customer) WHERE a <> b"""))
def status_changes(spark, sf):
    old = _processes(spark, sf)
    new = old.withColumn("status", F.expr(STATUS.format("(c_custkey + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)")))
    _, audit = m.status_changes(old, new, _programs(spark, sf), F.lit("me"), F.lit("2024-02-01").cast("timestamp"))
    return audit.select("workspace_id", "subject_id", "detail")


NOW = "2024-01-31 00:00:00"
PRUNED = f"audit.workspace_id = workspaces.id AND (retention_days IS NULL OR audit_at >= TIMESTAMP '{NOW}' - to_days(retention_days))"


@query("prune_audit", _with(f"SELECT audit.id, workspace_id FROM audit JOIN workspaces ON {PRUNED}"))
def prune_audit(spark, sf):
    return m.prune_audit(_audit(spark, sf), _workspaces(spark, sf), F.lit(NOW).cast("timestamp")).select("id", "workspace_id")


PURGED = "CAST(n_nationkey AS string) AS workspace_id FROM nation WHERE n_regionkey = 2"


def _purged(spark, sf):
    return table(spark, sf, "nation").where("n_regionkey = 2").selectExpr("CAST(n_nationkey AS string) AS workspace_id")


def _all(spark, sf):
    programs = _programs(spark, sf)
    edges = programs.selectExpr("id AS program_id", "'a' AS from_name", "'process' AS from_type", "'b' AS to_name", "'object' AS to_type")
    return {"programs": programs, "processes": _processes(spark, sf).select(*PROCESS), "findings": _kids(spark, sf), "dependency_edges": edges}


@query("purge_workspace", _with(f"""
SELECT 'programs' AS name, CAST(count(*) AS BIGINT) AS n FROM programs WHERE workspace_id NOT IN (SELECT {PURGED})
UNION ALL SELECT 'processes', CAST(count(*) AS BIGINT) FROM customer WHERE CAST(c_nationkey AS string) NOT IN (SELECT {PURGED})
UNION ALL SELECT 'findings', CAST(count(*) AS BIGINT) FROM orders JOIN customer ON o_custkey = c_custkey WHERE CAST(c_nationkey AS string) NOT IN (SELECT {PURGED})
UNION ALL SELECT 'dependency_edges', CAST(count(*) AS BIGINT) FROM programs WHERE workspace_id NOT IN (SELECT {PURGED})"""))
def purge_workspace(spark, sf):
    left = m.purge_workspaces(_all(spark, sf), _purged(spark, sf))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


@query("purge_events", _with(f"""
SELECT w.workspace_id, concat('{{"programs_deleted":', CAST((SELECT count(*) FROM programs p WHERE p.workspace_id = w.workspace_id) AS string), ',"audit_events_pruned":',
  CAST((SELECT count(*) FROM audit a WHERE a.workspace_id = w.workspace_id) - (SELECT count(*) FROM audit a JOIN workspaces s ON s.id = a.workspace_id WHERE a.workspace_id = w.workspace_id AND (retention_days IS NULL OR audit_at >= TIMESTAMP '{NOW}' - to_days(retention_days))) AS string),
  CASE WHEN s.retention_days IS NULL THEN '' ELSE concat(',"retention_days":', CAST(s.retention_days AS string)) END, '}}') AS detail
FROM (SELECT {PURGED}) w JOIN workspaces s ON s.id = w.workspace_id"""))
def purge_events(spark, sf):
    events = m.purge_events(_all(spark, sf), _audit(spark, sf), _workspaces(spark, sf), _purged(spark, sf), F.lit("me"), F.lit(NOW).cast("timestamp"))
    return events.select("workspace_id", "detail")


@query("named_audit_trail", _with("SELECT id, CASE WHEN actor IS NULL THEN 'system' WHEN CAST(replace(actor, 'actor-', '') AS INT) % 2 = 0 THEN concat(actor, '@x.org') ELSE substr(actor, 1, 8) END AS actor_name FROM audit"))
def named_audit_trail(spark, sf):
    events = _audit(spark, sf)
    members = table(spark, sf, "events").where("user_id % 2 = 0").selectExpr("CAST(user_id % 25 AS string) AS workspace_id", "concat('actor-', user_id) AS user_id", "concat('actor-', user_id, '@x.org') AS email").distinct()
    return m.named_audit_trail(events, members).select("id", "actor_name")


@query("tenant_view", _with("SELECT k.id, k.process_id FROM kids k JOIN processes p ON k.process_id = p.id JOIN programs g ON p.program_id = g.id WHERE g.workspace_id IN (SELECT workspace_id FROM members WHERE user_id = 'u3')"))
def tenant_view(spark, sf):
    return m.tenant_view(_kids(spark, sf), "findings", "u3", _members(spark, sf), _programs(spark, sf), _processes(spark, sf))


@query("tenant_view_programs", _with("SELECT id, workspace_id FROM programs WHERE workspace_id IN (SELECT workspace_id FROM members WHERE user_id = 'u4')"))
def tenant_view_programs(spark, sf):
    return m.tenant_view(_programs(spark, sf), "programs", "u4", _members(spark, sf), _programs(spark, sf), _processes(spark, sf))


@query("writable_rows", _with("""
SELECT 'u3' AS user_id, p.id FROM processes p JOIN programs g ON p.program_id = g.id WHERE g.workspace_id IN (SELECT workspace_id FROM members WHERE user_id = 'u3' AND role IN ('admin', 'editor'))
UNION ALL SELECT 'u4', g.id FROM programs g WHERE g.workspace_id IN (SELECT workspace_id FROM members WHERE user_id = 'u4' AND role = 'admin')
UNION ALL SELECT 'u5', p.id FROM processes p JOIN programs g ON p.program_id = g.id WHERE g.workspace_id IN (SELECT workspace_id FROM members WHERE user_id = 'u5' AND role IN ('admin', 'editor'))"""))
def writable_rows(spark, sf):
    """What an admin may update, an editor delete, and a viewer update."""
    members, programs, processes = _members(spark, sf), _programs(spark, sf), _processes(spark, sf)
    may = lambda df, name, action, user: m.writable_rows(df, name, action, user, members, programs, processes).select(F.lit(user).alias("user_id"), "id")
    return may(processes, "processes", "update", "u3").unionByName(may(programs, "programs", "delete", "u4")).unionByName(may(processes, "processes", "delete", "u5"))


REQUESTS = "SELECT CAST(o_custkey % 25 AS string) AS workspace_id, lower(concat('P', CAST(o_custkey AS string), '@x.org')) AS email, CASE o_custkey % 2 WHEN 0 THEN 'viewer' ELSE 'editor' END AS role, o_custkey FROM orders GROUP BY o_custkey"


def _requests(spark, sf):
    asked = table(spark, sf, "orders").select("o_custkey").distinct()
    return asked.selectExpr("CAST(o_custkey % 25 AS string) AS workspace_id", "concat(' P', o_custkey, '@X.org ') AS email", "CASE o_custkey % 2 WHEN 0 THEN 'viewer' ELSE 'editor' END AS role")


def _users(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 0").selectExpr("concat('u', c_custkey) AS id", "concat('p', c_custkey, '@x.org') AS email")


def _added(spark, sf):
    members = _members(spark, sf)
    invites = spark.createDataFrame([], "workspace_id string, email string, role string, invited_by string, invited_at timestamp")
    return m.add_members(_requests(spark, sf), _users(spark, sf), members, invites, F.lit("me"), F.lit(NOW).cast("timestamp"))


@query("add_member_or_invite", _with(f"""
SELECT 'invite' AS what, workspace_id, email AS who, role FROM ({REQUESTS}) r JOIN customer ON c_custkey = o_custkey WHERE c_acctbal <= 0
UNION ALL SELECT 'member', workspace_id, user_id, role FROM members
UNION ALL SELECT 'member', r.workspace_id, concat('u', CAST(c_custkey AS string)), r.role FROM ({REQUESTS}) r JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 AND (r.workspace_id, concat('u', CAST(c_custkey AS string))) NOT IN (SELECT workspace_id, user_id FROM members)"""))
def add_member_or_invite(spark, sf):
    done = _added(spark, sf)
    invites = done["invites"].select(F.lit("invite").alias("what"), "workspace_id", F.col("email").alias("who"), "role")
    return invites.unionByName(done["members"].select(F.lit("member").alias("what"), "workspace_id", F.col("user_id").alias("who"), "role"))


@query("claim_invites", _with(f"""
SELECT 'member.joined' AS event, workspace_id, concat('v', CAST(c_custkey AS string)) AS subject_id FROM ({REQUESTS}) r JOIN customer ON c_custkey = o_custkey WHERE c_acctbal <= 0 AND c_custkey % 2 = 0
UNION ALL SELECT 'still open', workspace_id, email FROM ({REQUESTS}) r JOIN customer ON c_custkey = o_custkey WHERE c_acctbal <= 0 AND c_custkey % 2 = 1"""))
def claim_invites(spark, sf):
    """Half of the invited people sign in for the first time."""
    done = _added(spark, sf)
    late = table(spark, sf, "customer").where("c_acctbal <= 0 and c_custkey % 2 = 0").selectExpr("concat('v', c_custkey) AS id", "concat('P', c_custkey, '@X.ORG') AS email")
    claimed = m.claim_invites(late, done["members"], done["invites"], F.lit(NOW).cast("timestamp"))
    joined = claimed["audit"].select("event", "workspace_id", "subject_id")
    return joined.unionByName(claimed["invites"].select(F.lit("still open").alias("event"), "workspace_id", F.col("email").alias("subject_id")))


@query("list_members", _with("SELECT workspace_id, user_id, role, concat(user_id, '@x.org') AS email FROM members"))
def list_members(spark, sf):
    members = _members(spark, sf)
    users = members.selectExpr("user_id AS id", "concat(user_id, '@x.org') AS email").distinct()
    return m.list_members(members, users).select("workspace_id", "user_id", "role", "email")


@query("list_workspaces", _with("SELECT id, name, role FROM workspaces JOIN members ON workspace_id = id WHERE user_id = 'u2'"))
def list_workspaces(spark, sf):
    spaces = _workspaces(spark, sf).withColumn("created_at", F.col("id").cast("int"))
    return m.list_workspaces(spaces, _members(spark, sf), "u2").select("id", "name", "role")


@query("check_constraints", _with("""
SELECT 'artifacts' AS "table", 'kind' AS rule, CAST(o_orderkey AS string) AS key FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'artifacts', 'size', CAST(o_orderkey AS string) FROM orders WHERE o_totalprice - 1000 < 0
UNION ALL SELECT 'artifacts', 'storage', CAST(o_orderkey AS string) FROM orders WHERE o_custkey % 25 % 2 = 1
UNION ALL SELECT 'workspaces', 'retention', id FROM workspaces WHERE retention_days < 1
UNION ALL SELECT 'workspace_members', 'role', user_id FROM members WHERE role = 'nobody'"""))
def check_constraints(spark, sf):
    artifacts = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "CAST(o_custkey % 25 AS string) AS workspace_id", "CASE o_orderstatus WHEN 'P' THEN 'zip' WHEN 'O' THEN 'bprelease' ELSE 'uipath-export' END AS kind",
        "o_totalprice - 1000 AS size_bytes",
    )
    return m.check_constraints({"artifacts": artifacts, "workspaces": _workspaces(spark, sf), "processes": _processes(spark, sf), "workspace_members": _members(spark, sf)})
