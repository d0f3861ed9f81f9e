"""Queries for selectors, coverage, manual work, effort and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from procatlas.operators import conversion, recommend
from procatlas.operators.engine import run_rules
from procatlas.operators.rules import ALL_RULES
from procatlas.plans.registry import query
from procatlas.plans.rendered import xml_chosen, xml_estate
from procatlas.plans.standin import estate, with_cte
from procatlas.session import cut, written

PART_SELECTOR = """
q AS (SELECT *, strong_match = 'index' AS idx, strong_name = 'Name' AND strong_match <> 'index' AND mode <> 'Citrix' AS strong,
  strong_match = 'index' OR strong_name = 'Name' OR (strong_name = 'Title' AND mode = 'HTML') AS m1, weak_enabled AND mode = 'HTML' AS m2 FROM pt),
r AS (SELECT *, CAST(m1 AS INT) + CAST(m2 AS INT) AS parts, CASE mode WHEN 'SAP' THEN 0.85 WHEN 'UIA' THEN 0.8 ELSE 0.7 END AS base FROM q),
sel AS (SELECT *, CASE WHEN mode = 'Citrix' OR parts = 0 THEN 'image-ocr' ELSE 'selector' END AS strategy,
  CASE WHEN mode = 'Citrix' OR parts = 0 THEN 0.1 WHEN idx THEN 0.25 WHEN strong THEN least(0.9, base + 0.15) WHEN parts = 1 THEN 0.4 ELSE base END AS confidence FROM r)"""


@query("score_selectors", with_cte("SELECT stage_id AS element_id, strategy, CAST(round(confidence, 2) AS DOUBLE) AS confidence FROM sel", False, PART_SELECTOR))
def score_selectors(spark, sf):
    return conversion.score_selectors(estate(spark, sf).elements).select("element_id", "strategy", "confidence")


@query("domain_types", with_cte("SELECT data_type, CASE data_type WHEN 'number' THEN 'Double' WHEN 'collection' THEN 'DataTable' ELSE 'String' END AS target, CAST(count(*) AS BIGINT) AS n FROM di GROUP BY 1, 2"))
def domain_types(spark, sf):
    items = estate(spark, sf).data_items
    return items.groupBy("data_type").agg(F.count("*").alias("n")).select("data_type", conversion.domain_type("data_type").alias("target"), "n")


CONVERTED = "20 + CAST(o_orderkey % 2 = 0 AS INT) + CAST(o_orderkey % 4 <> 1 AS INT) + 2 * CAST(o_orderkey % 3 <> 1 AS INT)"


@query("coverage", f"""
SELECT concat('P', CAST(o_orderkey AS string)) AS owner_id, CAST(27 AS BIGINT) AS stage_count, CAST({CONVERTED} AS BIGINT) AS converted_count, CAST(floor(1000.0 * ({CONVERTED}) / 27 + 0.5) / 10 AS DOUBLE) AS coverage_pct FROM orders
UNION ALL SELECT concat('O', CAST(o_orderkey AS string)), 7, 7, 100.0 FROM orders""")
def coverage(spark, sf):
    done = conversion.convertible_stages(xml_estate(spark, sf, "stages", "edges"))
    return conversion.owner_coverage(done).select("owner_id", "stage_count", "converted_count", "coverage_pct")


PUNCH = """
SELECT reason, CAST(sum(n) AS BIGINT) AS n, manual FROM (
  SELECT unnest([
    {'reason': 'dynamic-queue', 'n': CAST(k % 7 = 0 AS INT), 'manual': false}, {'reason': 'queue-item', 'n': 1, 'manual': false},
    {'reason': 'no-timeout', 'n': CAST(k % 3 <> 2 AS INT), 'manual': false}, {'reason': 'unresolved-object', 'n': CAST(k % 2 = 1 AS INT), 'manual': true},
    {'reason': 'code-review', 'n': CAST(k % 4 <> 1 AS INT), 'manual': false}, {'reason': 'jscript', 'n': CAST(k % 4 = 1 AS INT), 'manual': true},
    {'reason': 'sensitive-alert', 'n': CAST(k % 8 = 0 AS INT), 'manual': false}, {'reason': 'missing-selector', 'n': 1, 'manual': false},
    {'reason': 'image-only', 'n': 2 * CAST(k % 5 = 3 AS INT), 'manual': true},
    {'reason': 'weak-selector', 'n': 1 + 2 * CAST(k % 6 = 1 AND k % 5 <> 3 AS INT), 'manual': false},
    {'reason': 'absorbed-loop', 'n': CAST(s = 'O' AS INT), 'manual': false}, {'reason': 'unknown-function', 'n': 1, 'manual': false},
    {'reason': 'no-parameter', 'n': 2 * CAST(k % 11 = 0 AS INT) + 2 * CAST(k % 2 = 0 AS INT), 'manual': false}], recursive := true)
  FROM (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders)) GROUP BY reason, manual HAVING sum(n) > 0"""


@query("punch_list", PUNCH)
def punch_list(spark, sf):
    punch = conversion.punch_list(xml_estate(spark, sf, "stages", "edges"))
    return punch.groupBy("reason", "manual").agg(F.count("*").alias("n"))


PROCESS_PUNCH = "1 + CAST(k % 7 = 0 AS INT) + CAST(k % 2 = 1 AS INT) + 1 + CAST(k % 8 = 0 AS INT) + CAST(s = 'O' AS INT) + 1 + 2 * CAST(k % 11 = 0 AS INT) + 2 * CAST(k % 2 = 0 AS INT)"
OBJECT_PUNCH = "CAST(k % 3 <> 2 AS INT) + 1 + 2 * CAST(k % 5 = 3 AS INT) + 1 + 2 * CAST(k % 6 = 1 AND k % 5 <> 3 AS INT)"
RISKY = "1 + CAST(k % 5 = 3 OR k % 6 = 1 AS INT)"


@query("effort_hours", f"""
SELECT owner_id, CAST(stages AS BIGINT) AS stages, CAST(punch AS BIGINT) AS punch, CAST(selectors AS BIGINT) AS selectors, CAST(risky AS BIGINT) AS risky,
  CAST(floor((stages * 3 + punch * 30 + selectors * 10 + risky * 20) / 6.0 + 0.5) / 10 AS DOUBLE) AS effort_hours
FROM (SELECT concat('P', CAST(k AS string)) AS owner_id, 27 + 7 * c AS stages, {PROCESS_PUNCH} + c * ({OBJECT_PUNCH}) AS punch, 2 * c AS selectors, c * ({RISKY}) AS risky
  FROM (SELECT o_orderkey AS k, o_orderstatus AS s, CAST(o_orderkey % 2 = 0 AS INT) AS c FROM orders))""")
def effort_hours(spark, sf):
    e = xml_estate(spark, sf, "stages", "edges")
    return conversion.effort_hours(e, written(conversion.punch_list(e), "punch")).select("owner_id", "stages", "punch", "selectors", "risky", "effort_hours")


@query("stage_mapping", """
SELECT status, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest([
  {'status': 'manual', 'n': CAST(k % 9 = 0 AS INT) + CAST(k % 2 = 1 AS INT) + CAST(k % 4 = 1 AS INT) + 2 * CAST(k % 5 = 3 AS INT)},
  {'status': 'review', 'n': 1 + CAST(k % 11 = 0 AS INT) + CAST(s = 'O' AS INT) + CAST(k % 2 = 0 AS INT) + 1 + CAST(k % 8 = 0 AS INT) + CAST(k % 4 <> 1 AS INT) + 2
     + CAST(k % 5 <> 3 AND (k % 3 <> 2 OR k % 6 = 1) AS INT) + CAST(k % 5 <> 3 AND k % 6 = 1 AS INT)}], recursive := true) FROM (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders)) GROUP BY status HAVING sum(n) > 0""")
def stage_mapping(spark, sf):
    e = xml_estate(spark, sf, "stages", "edges")
    rows = conversion.stage_mapping(e, conversion.punch_list(e))
    return rows.where("status <> 'converted'").groupBy("status").agg(F.count("*").alias("n"))


@query("stage_mapping_statuses", """
WITH n AS (SELECT concat('X', CAST(k AS string)) AS release_id,
  CAST(k % 9 = 0 AS INT) + CAST(k % 2 = 1 AS INT) + CAST(k % 4 = 1 AS INT) + 2 * CAST(k % 5 = 3 AS INT) AS manual,
  1 + CAST(k % 11 = 0 AS INT) + CAST(s = 'O' AS INT) + CAST(k % 2 = 0 AS INT) + 1 + CAST(k % 8 = 0 AS INT) + CAST(k % 4 <> 1 AS INT) + 2
    + CAST(k % 5 <> 3 AND (k % 3 <> 2 OR k % 6 = 1) AS INT) + CAST(k % 5 <> 3 AND k % 6 = 1 AS INT) AS review FROM (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders))
SELECT release_id, CAST(manual AS BIGINT) AS manual, CAST(review AS BIGINT) AS review, CAST(34 - manual - review AS BIGINT) AS converted FROM n""")
def stage_mapping_statuses(spark, sf):
    """All stages of each release by status, converted ones among them."""
    e = xml_estate(spark, sf, "stages", "edges")
    rows = conversion.stage_mapping(e, conversion.punch_list(e))
    return rows.groupBy("release_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("manual", "review", "converted")])


@query("target_labels", with_cte("""
SELECT kind, CASE kind WHEN 'start' THEN 'inputs' WHEN 'data' THEN 'variable' WHEN 'calculation' THEN concat('assignment: ', store_in) WHEN 'decision' THEN 'two-way branch'
  WHEN 'subsheetRef' THEN concat('page call: Pages\\', CASE WHEN target_page_id IS NULL THEN replace(name, ' ', '_') ELSE replace(page_name, ' ', '_') END, '.xaml')
  WHEN 'action' THEN CASE WHEN queue_name IS NULL THEN concat('object call: Objects\\', replace(object_name, '#', '_'), '\\', action_name, '.xaml')
    WHEN action_name = 'Get Next Item' THEN 'queue take' WHEN action_name = 'Add To Queue' THEN 'queue put'
    WHEN action_name = 'Mark Completed' THEN 'queue success' ELSE 'queue failure' END
  WHEN 'recover' THEN 'catch block' WHEN 'write' THEN 'typing: 1' WHEN 'wait' THEN 'element check' END AS target, CAST(count(*) AS BIGINT) AS n FROM st GROUP BY 1, 2"""))
def target_labels(spark, sf):
    stages = estate(spark, sf).stages.where("owner_type = 'process'")
    return stages.select("kind", conversion.target_label().alias("target")).groupBy("kind", "target").agg(F.count("*").alias("n"))


@query("argument_signature", """
SELECT page_id, item, way, identifier, target_type FROM (SELECT unnest([
  {'page_id': concat('m', k), 'item': 'Login Password', 'way': 'in', 'identifier': 'in_Login_Password', 'target_type': 'String'},
  {'page_id': concat('m', k), 'item': 'Total', 'way': 'out', 'identifier': 'out_Total', 'target_type': 'Double'},
  {'page_id': concat('m', k), 'item': 'Item Data', 'way': 'variable', 'identifier': 'Item_Data', 'target_type': 'DataTable'},
  {'page_id': concat('m', k), 'item': 'Spare Item', 'way': 'variable', 'identifier': 'Spare_Item', 'target_type': 'String'},
  {'page_id': concat('w', k), 'item': 'Item Data', 'way': 'in', 'identifier': 'in_Amount', 'target_type': 'String'},
  {'page_id': concat('w', k), 'item': 'Total', 'way': 'out', 'identifier': 'out_Result', 'target_type': 'String'},
  {'page_id': concat('a', k), 'item': 'Value', 'way': 'in', 'identifier': 'in_Value', 'target_type': 'Double'}], recursive := true) FROM (SELECT CAST(o_orderkey AS string) AS k FROM orders))""")
def argument_signature(spark, sf):
    e = xml_chosen(spark, sf, True, stages="release_id owner_id page_id stage_id stage_pos kind outputs", data_items="release_id owner_id page_id name data_type item_pos")
    return conversion.argument_signature(e.stages, e.data_items).select("page_id", "item", "way", "identifier", "target_type")


@query("expression_inventory", with_cte("SELECT 'len' AS function, CAST(count(*) AS BIGINT) AS uses, true AS supported FROM st WHERE kind = 'decision' UNION ALL SELECT 'upper', CAST(count(*) AS BIGINT), true FROM st WHERE kind = 'write'"))
def expression_inventory(spark, sf):
    return conversion.expression_inventory(estate(spark, sf).stages)


@query("unresolved_references", "SELECT concat('P', CAST(o_orderkey AS string)) AS owner_id, n AS name FROM orders, (VALUES ('Card Number', 8, 0), ('Queue', 7, 0)) v(n, m, r) WHERE o_orderkey % m = r")
def unresolved_references(spark, sf):
    e = xml_estate(spark, sf)
    return conversion.unresolved_refs(e.stages, e.data_items).select("owner_id", "name")


FOUND = """
found AS (SELECT * FROM (SELECT k, unnest([
  {'rule_id': 'SEC-001', 'rank': 0, 'n': CAST(k % 3 = 0 AS INT) + CAST(k % 10 = 3 AS INT)}, {'rule_id': 'SEC-002', 'rank': 1, 'n': CAST(k % 2 = 1 AS INT)},
  {'rule_id': 'SEC-003', 'rank': 1, 'n': CAST(k % 8 = 0 AS INT) + CAST(k % 6 = 0 AND k % 9 <> 0 AS INT)}, {'rule_id': 'SEC-004', 'rank': 2, 'n': CAST(k % 4 = 0 AS INT)},
  {'rule_id': 'REL-001', 'rank': 1, 'n': CAST(k % 3 = 1 AS INT)}, {'rule_id': 'MNT-002', 'rank': 3, 'n': 1},
  {'rule_id': 'CMP-001', 'rank': 1, 'n': CAST(p = '1' AND k % 3 <> 1 AS INT)}, {'rule_id': 'CMP-002', 'rank': 4, 'n': CAST(s = 'P' AS INT)}], recursive := true)
  FROM (SELECT o_orderkey AS k, o_orderstatus AS s, substr(o_orderpriority, 1, 1) AS p FROM orders)) WHERE n > 0)"""
LOCAL_RULES = tuple(r for r in ALL_RULES if r.meta.id in ("SEC-001", "SEC-002", "SEC-003", "SEC-004", "REL-001", "MNT-002", "CMP-001", "CMP-002"))


def _release_findings(spark, sf):
    e = xml_estate(spark, sf, "stages")
    return e, cut(run_rules(e, LOCAL_RULES)[0])


@query("recommendations", f"""
WITH {FOUND}, t AS (SELECT *, CASE rule_id WHEN 'SEC-001' THEN 'REC-CREDENTIAL-MANAGER' WHEN 'SEC-002' THEN 'REC-CREDENTIAL-MANAGER' WHEN 'SEC-003' THEN 'REC-MASK-PII-LOGS' WHEN 'SEC-004' THEN 'REC-EXTERNALIZE-CONFIG'
  WHEN 'CMP-001' THEN 'REC-ENCRYPT-QUEUES' WHEN 'CMP-002' THEN 'REC-DOCUMENT-PROCESSES' WHEN 'REL-001' THEN 'REC-REFRAMEWORK-EXCEPTIONS' ELSE 'REC-PRUNE-DATA' END AS recommendation FROM found)
SELECT concat('P', CAST(k AS string)) AS owner_id, recommendation, CAST(sum(n) AS BIGINT) AS finding_count, CAST(min(rank) AS INT) AS worst_rank, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM t GROUP BY k, recommendation""")
def recommendations(spark, sf):
    e, findings = _release_findings(spark, sf)
    recs = recommend.recommendations(findings, e)
    return recs.select("owner_id", "recommendation", "finding_count", "worst_rank", F.array_join("rule_ids", ",").alias("rules"))


@query("recommendation_coverage", f"WITH {FOUND} SELECT concat('P', CAST(k AS string)) AS owner_id, CAST(sum(n) AS BIGINT) AS covered, CAST(sum(n) AS BIGINT) AS total FROM found GROUP BY k")
def recommendation_coverage(spark, sf):
    _, findings = _release_findings(spark, sf)
    return recommend.recommendation_coverage(findings).select("owner_id", "covered", "total")


@query("finding_spots", "SELECT concat('P', CAST(o_orderkey AS string)) AS owner_id, '\"Spare Item\" (Main Page)' AS spot FROM orders")
def finding_spots(spark, sf):
    from procatlas.model import located_owner
    from procatlas.operators.maintenance import mnt_002
    from procatlas.operators.summary import finding_spots as spots

    e = xml_chosen(
        spark, sf, True, stages="release_id owner_id owner_type page_id stage_id name kind exprs outputs steps store_in collection_name",
        owners="release_id owner_id owner_type name", pages="release_id owner_id page_id name", elements="release_id owner_id element_id name",
    )
    return spots(run_rules(e, [mnt_002])[0], e).select(located_owner().alias("owner_id"), "spot")
