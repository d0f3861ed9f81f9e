"""Queries for the graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from procatlas.operators import conversion, graph
from procatlas.plans.registry import query
from procatlas.plans.rendered import xml_chosen, xml_estate
from procatlas.plans.rules import CLOSURE, REACHED
from procatlas.plans.standin import estate, with_cte


@query("reachable", with_cte("SELECT page_id, stage_id, (page_id, stage_id) IN (SELECT page_id, stage_id FROM hit) AS reached FROM nodes", True, REACHED))
def reachable(spark, sf):
    e = estate(spark, sf)
    seeded = e.stages.withColumn("seed", F.col("kind").isin("start", "recover"))
    return graph.reachable(seeded, e.edges).select("page_id", "stage_id", "reached")


@query("cycles", with_cte("SELECT page_id, stage_id, head FROM cyc", True, CLOSURE))
def cycles(spark, sf):
    e = estate(spark, sf)
    return graph.cycles(e.stages, e.edges).select("page_id", "stage_id", "head")


LINKS = """
links AS (SELECT DISTINCT st.release_id, 'process' AS from_type, ow.name AS from_name, CASE WHEN queue_name IS NOT NULL THEN 'queue' ELSE 'object' END AS to_type, coalesce(queue_name, object_name) AS to_name
  FROM st JOIN ow USING (owner_id) WHERE kind = 'action'
  UNION SELECT release_id, 'object', name, 'application', application_name FROM ow WHERE application_name IS NOT NULL)"""


@query("dependency_edges", with_cte("SELECT * FROM links", False, LINKS))
def dependency_edges(spark, sf):
    e = estate(spark, sf)
    return graph.dependency_edges(e.owners, e.stages)


@query("hotspots", with_cte("SELECT to_type, to_name, CAST(count(DISTINCT (from_type, from_name)) AS BIGINT) AS shared_by FROM links GROUP BY 1, 2 HAVING shared_by >= 2", False, LINKS))
def hotspots(spark, sf):
    e = estate(spark, sf)
    return graph.hotspots(graph.dependency_edges(e.owners, e.stages))


@query("dependency_graph_nodes", with_cte("""
SELECT 'source' AS side, from_type AS type, from_name AS name, CAST(0 AS BIGINT) AS shared_by, false AS hotspot FROM links GROUP BY ALL
UNION ALL SELECT 'target', to_type, to_name, CAST(count(DISTINCT (from_type, from_name)) AS BIGINT), count(DISTINCT (from_type, from_name)) >= 2 FROM links GROUP BY to_type, to_name""", False, LINKS))
def dependency_graph_nodes(spark, sf):
    e = estate(spark, sf)
    return graph.graph_nodes(graph.dependency_edges(e.owners, e.stages))


@query("infer_exception_edges", with_cte("""
SELECT st.page_id, st.stage_id AS src, r.dst, 'exception' AS kind FROM st JOIN (SELECT page_id, arg_min(stage_id, stage_pos) AS dst FROM st WHERE kind = 'recover' GROUP BY 1) r ON st.page_id = r.page_id
WHERE st.kind IN ('action', 'subsheetRef', 'navigate', 'write', 'read', 'wait', 'code', 'exception')"""))
def infer_exception_edges(spark, sf):
    return graph.infer_exception_edges(estate(spark, sf).stages).select("page_id", "src", "dst", "kind")


@query("first_recover_stage", with_cte("SELECT page_id, arg_min(stage_id, stage_pos) AS stage_id FROM st WHERE kind = 'recover' GROUP BY 1"))
def first_recover_stage(spark, sf):
    return graph.first_stage(estate(spark, sf).stages, "recover").select("page_id", "stage_id")


@query("flow_maps", with_cte("""
SELECT e.page_id, e.src, max(CASE WHEN e.kind = 'flow' THEN e.dst END) AS next_flow, CAST(count(*) FILTER (WHERE e.kind = 'choice') AS BIGINT) AS choices
FROM (SELECT * FROM ed UNION ALL SELECT * FROM pe) e JOIN (SELECT page_id, stage_id FROM st UNION ALL SELECT page_id, stage_id FROM pt) n ON n.page_id = e.page_id AND n.stage_id = e.dst GROUP BY 1, 2"""))
def flow_maps(spark, sf):
    e = estate(spark, sf)
    return graph.flow_maps(e.stages, e.edges).select("page_id", "src", "next_flow", "choices")


# What walks read of links.
LINKED = "release_id owner_id page_id src dst kind edge_pos"


@query("decision_targets", "SELECT concat('P', CAST(o_orderkey AS string)) AS owner_id, 'dec' AS src, 'work' AS on_true, 'end' AS on_false FROM orders")
def decision_targets(spark, sf):
    e = xml_chosen(spark, sf, True, stages="release_id owner_id page_id stage_id", edges=LINKED)
    maps = graph.flow_maps(e.stages, e.edges)
    return maps.where("on_true is not null").select("owner_id", "src", "on_true", "on_false")


@query("branch_joins", "SELECT concat('P', CAST(o_orderkey AS string)) AS owner_id, b AS branch, j AS join_stage FROM orders, (VALUES ('dec', 'end'), ('pick', 'say')) v(b, j)")
def branch_joins(spark, sf):
    e = xml_chosen(spark, sf, True, stages="release_id owner_id page_id stage_id stage_pos kind", edges=LINKED)
    branching = e.stages.where("kind in ('decision', 'choice')").select("release_id", "owner_id", "page_id", F.col("stage_id").alias("src"))
    heads = e.edges.join(branching, ["release_id", "owner_id", "page_id", "src"]).select("release_id", "owner_id", "page_id", F.col("src").alias("branch"), F.col("dst").alias("head"))
    return graph.branch_joins(heads, e.edges, e.stages).select("owner_id", "branch", "join_stage")


@query("polling_loops", "SELECT concat('P', CAST(o_orderkey AS string)) AS owner_id, 'get' AS get_next_id, 'dec' AS decision_id, 'work' AS work_head_id, 'mark' AS mark_id, CAST(1 AS INT) AS anchors FROM orders WHERE o_orderstatus = 'O'")
def polling_loops(spark, sf):
    e = xml_chosen(spark, sf, True, stages="release_id owner_id page_id stage_id stage_pos kind object_name action_name queue_name", edges=LINKED)
    return graph.polling_loops(e.stages, e.edges).select("owner_id", "get_next_id", "decision_id", "work_head_id", "mark_id", "anchors")


@query("pages_needing_item", "SELECT concat('w', CAST(o_orderkey AS string)) AS page_id FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT concat('m', CAST(o_orderkey AS string)) FROM orders WHERE o_orderstatus = 'O'")
def pages_needing_item(spark, sf):
    return conversion.pages_needing_item(xml_estate(spark, sf, "stages", "edges")).select("page_id")


@query("queue_params", "SELECT concat('P', CAST(o_orderkey AS string)) AS owner_id, 'Work' AS callee, 'Amount' AS param_name, 'Item Data' AS item FROM orders WHERE o_orderkey % 11 <> 0")
def queue_params(spark, sf):
    e = xml_estate(spark, sf, "stages")
    return conversion.queue_params(e.stages, e.data_items).select("owner_id", "callee", "param_name", "item")


@query("resolve_calls", with_cte("""
SELECT st.stage_id, s.release_id IS NOT NULL AND action_name IN ('A', 'N', 'R') AS found,
  CASE WHEN s.release_id IS NOT NULL AND action_name IN ('A', 'N', 'R') THEN s.owner_id END AS object_id
FROM st LEFT JOIN su s ON s.release_id = st.release_id AND s.name = st.object_name WHERE kind = 'action' AND queue_name IS NULL"""))
def resolve_calls(spark, sf):
    e = estate(spark, sf)
    return graph.resolve_calls(e.stages, e.owners, e.pages).select("stage_id", "found", "object_id")


# validate_model: the four checks on the stand-in
@query("validate_model", with_cte("""
SELECT 'unknown-stage' AS issue, CAST(count(*) AS BIGINT) AS n FROM (SELECT page_id, dst FROM ed UNION ALL SELECT page_id, dst FROM pe) e WHERE NOT EXISTS (SELECT 1 FROM (SELECT page_id, stage_id FROM st UNION ALL SELECT page_id, stage_id FROM pt) n WHERE n.page_id = e.page_id AND n.stage_id = e.dst)"""))
def validate_model(spark, sf):
    from procatlas.operators.validate import validate_model as check

    return check(estate(spark, sf)).groupBy("issue").agg(F.count("*").alias("n"))
