"""Queries for scores, rollups, summaries, windows, orders and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from procatlas.operators import score, select, summary, windows
from procatlas.operators.engine import run_rules
from procatlas.operators.reliability import rel_001, rel_003
from procatlas.plans.registry import query
from procatlas.plans.rendered import xml_chosen, xml_estate
from procatlas.plans.rules import OVERSIZE_BODY, REL_001_BODY, REL_003_BODY, SEVERITIES_SQL, small_page_limit
from procatlas.plans.standin import estate, table, with_cte

FLAGSHIP = f"""
hits AS (SELECT release_id, owner_id, 10 AS w, 'high' AS severity FROM ({REL_001_BODY}) UNION ALL SELECT release_id, owner_id, 4, 'medium' FROM ({OVERSIZE_BODY})),
scored AS (SELECT o.release_id, o.owner_id, o.owner_type, o.name, CAST(greatest(0, 100 - coalesce(sum(w), 0)) AS BIGINT) AS score, CAST(count(w) AS BIGINT) AS finding_count,
  CAST(count(w) FILTER (WHERE severity = 'high') AS BIGINT) AS n_high, CAST(count(w) FILTER (WHERE severity = 'medium') AS BIGINT) AS n_medium
  FROM ow o LEFT JOIN hits h ON o.owner_id = h.owner_id GROUP BY 1, 2, 3, 4),
graded AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' WHEN score >= 50 THEN 'E' ELSE 'F' END AS grade FROM scored)"""


def _scored(spark, sf):
    e = estate(spark, sf)
    findings, _ = run_rules(e, [rel_001, small_page_limit])
    return e, findings, score.score_owners(e.owners, findings)


@query("score_owners", with_cte("SELECT owner_id, owner_type, score, grade, finding_count, n_high, n_medium FROM graded", False, FLAGSHIP))
def score_owners(spark, sf):
    _, _, scored = _scored(spark, sf)
    return scored.select("owner_id", "owner_type", "score", "grade", "finding_count", "n_high", "n_medium")


@query("score_findings", with_cte("SELECT owner_id, score, grade, finding_count FROM graded WHERE finding_count > 0", False, FLAGSHIP))
def score_findings(spark, sf):
    from procatlas.model import located_owner

    _, findings, _ = _scored(spark, sf)
    placed = findings.withColumn("owner_id", located_owner())
    return score.score_findings(placed, "owner_id").select("owner_id", F.col("score").cast("long").alias("score"), "grade", "finding_count")


TOTALS = """
totals AS (SELECT g.release_id, CAST(count(*) AS BIGINT) AS components, CAST(floor(avg(score) + 0.5) AS BIGINT) AS average_score,
  max(grade) AS worst_grade, CAST(sum(finding_count) AS BIGINT) AS findings, CAST(sum(n_high) AS BIGINT) AS n_high, CAST(sum(n_medium) AS BIGINT) AS n_medium FROM graded g GROUP BY 1)"""


@query("file_totals", with_cte("SELECT * FROM totals", False, FLAGSHIP + "," + TOTALS))
def file_totals(spark, sf):
    _, findings, scored = _scored(spark, sf)
    return score.file_totals(scored, findings).select("release_id", "components", "average_score", "worst_grade", "findings", "n_high", "n_medium")


@query("release_rollup", with_cte("""
SELECT coalesce(release_id, '(all)') AS release_id, CASE WHEN grouping(release_id) = 1 THEN '(all)' ELSE coalesce(owner_type, '(all)') END AS role, CAST(count(*) AS BIGINT) AS components, CAST(sum(finding_count) AS BIGINT) AS findings,
  CAST(floor(avg(score) + 0.5) AS BIGINT) AS average_score, max(grade) AS worst_grade, CAST(round(CAST(sum(finding_count) AS DECIMAL(18, 2)) / 2, 1) AS DOUBLE) AS effort_hours
FROM graded GROUP BY ROLLUP (release_id, owner_type)""", False, FLAGSHIP))
def release_rollup(spark, sf):
    _, _, scored = _scored(spark, sf)
    sections = scored.withColumnRenamed("owner_type", "role").withColumn("effort_hours", F.col("finding_count") / 2)
    rolled = score.release_rollup(sections)
    return rolled.withColumns({"release_id": F.coalesce("release_id", F.lit("(all)")), "role": F.coalesce("role", F.lit("(all)"))})


@query("evaluate_gates", with_cte("""
SELECT release_id AS file, 'grade' AS gate, concat('"', name, '" has grade ', grade, ', wanted A or better') AS detail FROM graded WHERE grade > 'A'
UNION ALL SELECT release_id, 'critical', concat(CAST(n_high AS string), ' critical finding(s), at most 20 allowed') FROM totals WHERE n_high > 20""", False, FLAGSHIP + "," + TOTALS))
def evaluate_gates(spark, sf):
    """The critical gate is fed the high findings, of which the stand-in has many."""
    _, findings, scored = _scored(spark, sf)
    totals = score.file_totals(scored, findings).select(F.col("release_id").alias("file"), F.col("n_high").alias("n_critical"))
    return score.evaluate_gates(scored.withColumnRenamed("release_id", "file"), totals, "a", 20)


@query("tally_by_severity", with_cte(f"SELECT severity, CAST(count(*) AS BIGINT) AS n FROM (SELECT severity FROM hits UNION ALL SELECT 'medium' FROM ({REL_003_BODY})) GROUP BY 1", False, FLAGSHIP))
def tally_by_severity(spark, sf):
    findings, _ = run_rules(estate(spark, sf), [rel_001, small_page_limit, rel_003])
    return score.tally_by_severity(findings)


TRACKED = {
    "id": "c_custkey",
    "program_id": "concat('G', CAST(c_nationkey AS string))",
    "bp_name": "c_name",
    "status": "CASE c_custkey % 6 WHEN 0 THEN 'analyzed' WHEN 1 THEN 'converted' WHEN 2 THEN 'validating' WHEN 3 THEN 'validated' WHEN 4 THEN 'deployed' ELSE 'blocked' END",
    "score": "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey % 101 AS INT) END",
    "grade": "CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 101 >= 90 THEN 'A' WHEN c_custkey % 101 >= 50 THEN 'E' ELSE 'D' END",
    "effort_hours_est": "CAST(c_custkey % 50 AS DECIMAL(10, 1)) / 4",
    "stage_count": "CAST(c_custkey % 70 AS INT)",
    "updated_at": "c_custkey",
}
TRACKED_SQL = "tr AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in TRACKED.items()) + " FROM customer)"


def _tracked(spark, sf):
    processes = table(spark, sf, "customer").selectExpr(*[f"{v} AS {k}" for k, v in TRACKED.items()])
    findings = table(spark, sf, "orders").select(F.col("o_custkey").alias("process_id"))
    return score.tracked_processes(processes, findings)


@query("tracked_processes", f"WITH {TRACKED_SQL} SELECT id, bp_name AS name, stage_count, coalesce(score, 0) AS score, coalesce(grade, '?') AS grade, status, CAST(effort_hours_est AS DOUBLE) AS effort_hours, CAST(coalesce(n, 0) AS BIGINT) AS finding_count FROM tr LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON id = o_custkey")
def tracked_processes(spark, sf):
    return _tracked(spark, sf).select("id", "name", "stage_count", "score", "grade", "status", "effort_hours", "finding_count")


@query("program_rollup", f"""WITH {TRACKED_SQL} SELECT program_id, CAST(count(*) AS BIGINT) AS process_count, CAST(round(sum(CAST(effort_hours_est AS DECIMAL(18, 2))), 1) AS DOUBLE) AS total_effort_hours, CAST(floor(avg(coalesce(score, 0)) + 0.5) AS BIGINT) AS average_score,
  CASE max(CASE grade WHEN 'E' THEN 2 WHEN 'D' THEN 1 WHEN 'A' THEN 0 ELSE -1 END) WHEN 2 THEN 'E' WHEN 1 THEN 'D' WHEN 0 THEN 'A' ELSE '—' END AS worst_grade,
  CASE max(CASE grade WHEN 'D' THEN 1 WHEN 'A' THEN 0 ELSE -1 END) WHEN 1 THEN 'D' WHEN 0 THEN 'A' ELSE '—' END AS compat_worst_grade,
  {', '.join(f"CAST(count(*) FILTER (WHERE status = '{s}') AS BIGINT) AS {s}" for s in score.STATUSES)} FROM tr GROUP BY 1""")
def program_rollup(spark, sf):
    rows = _tracked(spark, sf)
    compat = rows.groupBy("program_id").agg(score.worst_grade(compat=True).alias("compat_worst_grade"))
    return score.program_rollup(rows).join(compat, "program_id")


@query("filter_tracked", f"WITH {TRACKED_SQL} SELECT id FROM tr WHERE status = 'blocked' AND bp_name LIKE '%77%'")
def filter_tracked(spark, sf):
    return select.filter_processes(_tracked(spark, sf), "blocked", " 77 ").select("id")


@query("stage_profile", with_cte("""
SELECT owner_id, CAST(max(p) AS BIGINT) AS page_count, CAST(max(s) AS BIGINT) AS stage_count, CAST(max(d) AS BIGINT) AS item_count FROM (
  SELECT owner_id, count(*) AS p, 0 AS s, 0 AS d FROM pp GROUP BY 1 UNION ALL SELECT owner_id, 0, count(*), 0 FROM (SELECT owner_id FROM st UNION ALL SELECT owner_id FROM pt) GROUP BY 1
  UNION ALL SELECT owner_id, 0, 0, count(*) FROM di GROUP BY 1) GROUP BY owner_id"""))
def stage_profile(spark, sf):
    e = estate(spark, sf)
    return summary.stage_profile(e.stages, e.pages, e.data_items).select("owner_id", "page_count", "stage_count", "item_count")


@query("kind_profile", with_cte("SELECT owner_id, kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT owner_id, kind FROM st UNION ALL SELECT owner_id, kind FROM pt) GROUP BY 1, 2"))
def kind_profile(spark, sf):
    return summary.kind_profile(estate(spark, sf).stages).select("owner_id", "kind", "n")


TOUCHED = """
direct AS (SELECT DISTINCT release_id, owner_id, CASE WHEN queue_name IS NOT NULL THEN 'queue' ELSE 'object' END AS role, coalesce(queue_name, object_name) AS name FROM st WHERE kind = 'action'),
touched AS (SELECT owner_id, role, name FROM direct UNION SELECT d.owner_id, 'application', s.application_name FROM direct d JOIN su s ON s.release_id = d.release_id AND s.name = d.name WHERE role = 'object')"""


@query("process_touches", with_cte("SELECT * FROM touched", False, TOUCHED))
def process_touches(spark, sf):
    e = estate(spark, sf)
    return summary.touched(e.stages, e.owners).select("owner_id", "role", "name")


@query("summarize_process", with_cte("""
SELECT cu.owner_id, cu.name, CAST(coalesce(p, 0) AS BIGINT) AS page_count, CAST(coalesce(s, 0) AS BIGINT) AS stage_count, CAST(coalesce(d, 0) AS BIGINT) AS item_count,
  CAST(coalesce(objects, 0) AS BIGINT) AS objects, CAST(coalesce(queues, 0) AS BIGINT) AS queues, CAST(coalesce(applications, 0) AS BIGINT) AS applications, coalesce(has_recovery, false) AS has_recovery, CAST(1 AS BIGINT) AS inputs
FROM cu LEFT JOIN (SELECT owner_id, count(*) AS p FROM pp GROUP BY 1) USING (owner_id) LEFT JOIN (SELECT owner_id, count(*) AS s, bool_or(kind = 'recover') AS has_recovery FROM st GROUP BY 1) USING (owner_id)
LEFT JOIN (SELECT owner_id, count(*) AS d FROM di GROUP BY 1) USING (owner_id)
LEFT JOIN (SELECT owner_id, count(*) FILTER (WHERE role = 'object') AS objects, count(*) FILTER (WHERE role = 'queue') AS queues, count(*) FILTER (WHERE role = 'application') AS applications FROM touched GROUP BY 1) USING (owner_id)""", False, TOUCHED))
def summarize_process(spark, sf):
    rows = summary.summarize_processes(estate(spark, sf))
    return rows.select("owner_id", "name", "page_count", "stage_count", "item_count", "objects", "queues", "applications", "has_recovery", "inputs")


@query("summarize_object", with_cte("""
SELECT su.owner_id, application_name, CAST(3 AS BIGINT) AS action_pages, CAST(coalesce(s, 0) AS BIGINT) AS stage_count, CAST(0 AS BIGINT) AS item_count, false AS has_recovery
FROM su LEFT JOIN (SELECT owner_id, count(*) AS s FROM pt GROUP BY 1) USING (owner_id)"""))
def summarize_object(spark, sf):
    rows = summary.summarize_objects(estate(spark, sf))
    return rows.select("owner_id", "application_name", "action_pages", "stage_count", "item_count", "has_recovery")


@query("exception_strategy", """
SELECT concat('P', CAST(o_orderkey AS string)) AS owner_id, 'recovery_page' AS fact, 'Work' AS page_name, NULL AS stage_name FROM orders WHERE o_orderkey % 3 <> 1
UNION ALL SELECT concat('P', CAST(o_orderkey AS string)), 'throw', CASE WHEN o_orderkey % 10 = 0 THEN 'Main Page' ELSE 'Work' END, 'Refuse' FROM orders""")
def exception_strategy(spark, sf):
    return summary.exception_strategy(xml_estate(spark, sf).stages).select("owner_id", "fact", "page_name", "stage_name")


@query("sensitivity_flags", """
SELECT concat('P', CAST(o_orderkey AS string)) AS owner_id, 'Login Password' AS item_name, 'Main Page' AS page_name, 'password-type' AS reason FROM orders
UNION ALL SELECT concat('P', CAST(o_orderkey AS string)), 'Item Data.Card Number', 'Main Page', 'name-pattern' FROM orders WHERE substr(o_orderpriority, 1, 1) = '1'""")
def sensitivity_flags(spark, sf):
    e = xml_chosen(spark, sf, True, stages="release_id owner_id kind data_item_id page_name", data_items="release_id owner_id item_id name data_type fields")
    return summary.sensitivity_flags(e.stages, e.data_items).select("owner_id", "item_name", "page_name", "reason")


@query("outline", "SELECT conv_id, turn, concat('Alert: ', CASE WHEN length(text) <= 60 THEN text ELSE concat(substr(text, 1, 59), '…') END) AS sentence FROM conversations")
def outline(spark, sf):
    """Conversations as pages whose turns are alert stages."""
    turns = table(spark, sf, "conversations")
    none = F.lit(None).cast("string")
    stages = turns.select(
        F.lit("R").alias("release_id"), F.lit("P").alias("owner_id"), F.col("conv_id").cast("string").alias("page_id"), none.alias("page_name"), F.lit(0).alias("page_index"),
        F.col("turn").cast("int").alias("stage_pos"), F.lit("alert").alias("kind"), F.col("role").alias("name"),
        F.array(F.struct(F.lit("message").alias("role"), none.alias("name"), F.col("text").alias("raw"))).alias("exprs"),
        *[none.alias(c) for c in ("object_name", "action_name", "queue_name", "store_in", "collection_name", "target_page_name", "exception_type", "language", "raw_type")],
        F.lit(None).cast("double").alias("timeout_seconds"),
        F.lit(None).cast("array<struct<element_id:string,action:string,store_in:string,raw:string>>").alias("steps"),
    )
    return summary.outline(stages).select(F.col("page_id").cast("long").alias("conv_id"), F.col("stage_pos").cast("long").alias("turn"), "sentence")


@query("first_steps", "SELECT concat('P', CAST(o_orderkey AS string)) AS owner_id, i AS stage_pos, CASE i WHEN 1 THEN concat('Queue \"', CASE WHEN o_orderkey % 7 = 0 THEN '(dynamic)' ELSE concat('Orders ', substr(o_orderpriority, 1, 1)) END, '\": Get Next Item') ELSE 'Decide: [Item Data.Id] <> \"\"' END AS sentence FROM orders, (VALUES (1), (2)) v(i)")
def first_steps(spark, sf):
    stages = xml_estate(spark, sf).stages.where("owner_type = 'process'")
    return summary.first_steps(stages, 2).select("owner_id", "stage_pos", "sentence")


# --- windows -----------------------------------------------------------------


@query("page_order", with_cte("SELECT page_id, page_index FROM pp WHERE owner_type = 'process'"))
def page_order(spark, sf):
    return estate(spark, sf).pages.where("owner_type = 'process'").select("page_id", "page_index")


@query("previous_turn", "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role FROM conversations")
def previous_turn(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    linked = windows.with_previous(turns, ["conv_id"], ["turn"], F.floor(F.col("turn") / 100), "role", "previous_role")
    return linked.select("conv_id", "turn", "previous_role")


@query("status_transitions", "SELECT * FROM (SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status, event_type AS to_status FROM events) WHERE from_status IS DISTINCT FROM to_status AND from_status IS NOT NULL")
def status_transitions(spark, sf):
    """A user's events are cut by day, so that a busy user spreads over tasks."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    linked = windows.with_previous(events, ["user_id"], ["ts", "event_id"], F.to_date("ts"), "event_type", "from_status")
    changed = linked.where(F.col("from_status").isNotNull() & (F.col("from_status") != F.col("event_type")))
    return changed.select("event_id", "user_id", "from_status", F.col("event_type").alias("to_status"))


@query("requests_in_trailing_hour", "SELECT event_id, user_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS in_hour FROM events")
def requests_in_trailing_hour(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return windows.trailing_count(events, ["user_id"], "ts", 3600, "in_hour").select("event_id", "user_id", "in_hour")


@query("rate_limited", "SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type IN ('click', 'purchase')) WHERE n > 1")
def rate_limited(spark, sf):
    """Requests over the limit of one other request in the trailing hour."""
    asked = table(spark, sf, "events").where(F.col("event_type").isin("click", "purchase")).select("event_id", "user_id", "ts")
    return windows.trailing_count(asked, ["user_id"], "ts", 3600, "n").where("n > 1").select("event_id")


# --- orders and limits -------------------------------------------------------


@query("recent_audit", "SELECT event_id, event_type FROM (SELECT event_id, event_type, ts FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id DESC LIMIT 12)")
def recent_audit(spark, sf):
    """The newest twelve events of one workspace."""
    from procatlas.operators.tables import recent_audit as newest

    events = table(spark, sf, "events").withColumnsRenamed({"user_id": "workspace_id", "ts": "at", "event_id": "id"})
    return newest(events, 8, 12).select(F.col("id").alias("event_id"), "event_type")


@query("recent_audit_per_workspace", "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 12")
def recent_audit_per_workspace(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return windows.top_per_key(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 12).select("event_id", "user_id")


@query("order_recommendations", f"SELECT c_custkey, severity, CAST(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 4 END AS INT) AS severity_rank FROM (SELECT c_custkey, {SEVERITIES_SQL} AS severity FROM customer) ORDER BY severity_rank, c_custkey")
def order_recommendations(spark, sf):
    from procatlas.functions.ranks import severity_rank
    from procatlas.operators.recommend import order_recommendations as ordered

    rows = table(spark, sf, "customer").select("c_custkey", F.expr(SEVERITIES_SQL).alias("severity"))
    recs = rows.select(F.col("c_custkey").alias("recommendation"), "severity", severity_rank("severity").alias("worst_rank"))
    return ordered(recs).withColumnsRenamed({"recommendation": "c_custkey", "worst_rank": "severity_rank"})


# --- set operations ----------------------------------------------------------


@query("each_owner", with_cte("SELECT owner_id, owner_type, name FROM ow"))
def each_owner(spark, sf):
    return estate(spark, sf).owners.select("owner_id", "owner_type", "name")


@query("walk_stages", with_cte("SELECT owner_id, page_id, stage_id, page_index, stage_pos FROM st UNION ALL SELECT owner_id, page_id, stage_id, page_index, stage_pos FROM pt"))
def walk_stages(spark, sf):
    from procatlas.model import WALK_ORDER

    stages = estate(spark, sf).stages
    return stages.orderBy(*WALK_ORDER).select("owner_id", "page_id", "stage_id", "page_index", "stage_pos")


@query("multiset_difference", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_quantity > 40")
def multiset_difference(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("k"))
    return a.exceptAll(b)


@query("distinct_names", with_cte("SELECT DISTINCT object_name FROM st WHERE object_name IS NOT NULL"))
def distinct_names(spark, sf):
    return estate(spark, sf).stages.where("object_name is not null").select("object_name").distinct().orderBy("object_name")


@query("common_nodes", with_cte("SELECT name FROM st WHERE kind = 'data' INTERSECT SELECT store_in FROM st WHERE kind = 'calculation' INTERSECT SELECT output_item FROM st"))
def common_nodes(spark, sf):
    stages = estate(spark, sf).stages
    items = stages.where("kind = 'data'").select("name")
    stored = stages.where("kind = 'calculation'").select(F.col("store_in").alias("name"))
    results = stages.where("kind = 'subsheetRef'").select(F.explode("outputs.store_in").alias("name"))
    return items.intersect(stored).intersect(results)
