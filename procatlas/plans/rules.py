"""Queries for the rules, the runner and comparisons of findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from procatlas.functions import text as t
from procatlas.model import located_owner
from procatlas.operators import compliance, engine, maintenance, reliability, security, similarity
from procatlas.operators.engine import RuleConfig, define_rule, run_rules
from procatlas.operators.rules import ALL_RULES
from procatlas.plans.registry import query
from procatlas.plans.rendered import xml_estate
from procatlas.plans.standin import estate, table, with_cte

STRONG = "length({0}) >= 8 AND regexp_matches({0}, '[A-Za-z]') AND regexp_matches({0}, '[^A-Za-z\\s]')"
CRED = "regexp_matches({0}, '(?i)passw(or)?d|\\bpwd\\b|secret|api[\\s_-]?key|\\btoken\\b|credential')"
WHOLE = "regexp_matches({0}, '^\"[^\"]*\"$')"
INNER = "replace({0}, '\"', '')"


def _found(spark, sf, rule):
    findings, errors = run_rules(estate(spark, sf), [rule])
    if errors.count():
        raise RuntimeError(str(errors.collect()))
    return findings.select(
        "release_id", "rule_id", "severity", located_owner().alias("owner_id"), F.col("location.page_id").alias("page_id"),
        F.col("location.stage_id").alias("stage_id"), F.col("location.element_id").alias("element_id"), "confidence",
    )


def _rule_sql(body: str, rule: str, severity: str, confidence: float, recursive: bool = False, extra: str = "") -> str:
    """``body`` yields release_id, owner_id, page_id, stage_id, element_id."""
    return with_cte(
        f"SELECT release_id, '{rule}' AS rule_id, '{severity}' AS severity, owner_id, page_id, stage_id, element_id, CAST({confidence} AS DOUBLE) AS confidence FROM ({body})",
        recursive, extra)


SEC_001_BODY = f"""
SELECT release_id, owner_id, page_id, stage_id, NULL AS element_id FROM st WHERE {CRED.format('input_name')} AND {WHOLE.format('input_raw')} AND {STRONG.format(INNER.format('input_raw'))}
UNION ALL SELECT release_id, owner_id, page_id, stage_id, NULL FROM st WHERE kind = 'calculation' AND {CRED.format('store_in')} AND {WHOLE.format('expr')} AND {STRONG.format(INNER.format('expr'))}
UNION ALL SELECT release_id, owner_id, page_id, stage_id, NULL FROM di WHERE {CRED.format('name')} AND {STRONG.format('initial_value')}"""
ENV_SQL = "(regexp_matches({0}, '(?i)^https?://') OR regexp_matches({0}, '^\\\\\\\\[\\w$.-]+\\\\') OR regexp_matches({0}, '(?i)^[\\w-]+\\.(corp|local|internal|lan)\\b'))"


@query("rule_sec_001", _rule_sql(SEC_001_BODY, "SEC-001", "critical", 0.9))
def rule_sec_001(spark, sf):
    return _found(spark, sf, security.sec_001)


@query("rule_sec_002", _rule_sql(f"SELECT release_id, owner_id, NULL AS page_id, NULL AS stage_id, NULL AS element_id FROM cu WHERE {CRED.format('param_name')} AND param_type <> 'password'", "SEC-002", "high", 0.9))
def rule_sec_002(spark, sf):
    return _found(spark, sf, security.sec_002)


@query("rule_sec_003_texts", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND regexp_matches(text, '\\b\\d{3}-\\d{2}-\\d{4}\\b') OR role = 'assistant' AND turn % 2 = 1")
def rule_sec_003_texts(spark, sf):
    """Turns as stages: user turns are notes with their text, others alerts that name a reference."""
    from procatlas.model import Estate

    turns = table(spark, sf, "conversations")
    shown = F.when((F.col("role") == "assistant") & (F.col("turn") % 2 == 1), "[Card Number]").otherwise("[Name]")
    stages = turns.select(
        F.lit("R0").alias("release_id"), F.concat(F.lit("C"), "conv_id").alias("owner_id"), F.lit("process").alias("owner_type"),
        F.col("conv_id").cast("string").alias("page_id"), F.col("turn").cast("string").alias("stage_id"),
        F.concat(F.lit("Turn "), "turn").alias("name"), F.when(F.col("role") == "user", "note").otherwise("alert").alias("kind"), "text",
        F.array(F.struct(F.lit("message").alias("role"), F.lit(None).cast("string").alias("name"), shown.alias("raw"))).alias("exprs"),
    )
    findings, _ = run_rules(Estate.of(spark, stages=stages), [security.sec_003])
    return findings.select(F.col("location.page_id").cast("long").alias("conv_id"), F.col("location.stage_id").cast("long").alias("turn"))


@query("rule_sec_004", _rule_sql(f"""
SELECT release_id, owner_id, page_id, stage_id, NULL AS element_id FROM di WHERE {ENV_SQL.format('initial_value')}
UNION ALL SELECT release_id, owner_id, page_id, stage_id, NULL FROM st WHERE {WHOLE.format('input_raw')} AND {ENV_SQL.format(INNER.format('input_raw'))}""", "SEC-004", "medium", 0.85))
def rule_sec_004(spark, sf):
    return _found(spark, sf, security.sec_004)


REL_001_BODY = "SELECT release_id, owner_id, NULL AS page_id, NULL AS stage_id, NULL AS element_id FROM st GROUP BY release_id, owner_id HAVING NOT bool_or(kind = 'recover') AND bool_or(kind IN ('action', 'navigate', 'write', 'read', 'wait', 'code'))"


@query("rule_rel_001", _rule_sql(REL_001_BODY, "REL-001", "high", 0.9))
def rule_rel_001(spark, sf):
    return _found(spark, sf, reliability.rel_001)


# every pair of stages a page's edges connect; pages are small, so the closure is too
CLOSURE = """
nodes AS (SELECT release_id, owner_id, page_id, stage_id, stage_pos, kind FROM st UNION ALL SELECT release_id, owner_id, page_id, stage_id, stage_pos, kind FROM pt),
arcs AS (SELECT DISTINCT e.page_id, src, dst FROM (SELECT page_id, src, dst FROM ed UNION ALL SELECT page_id, src, dst FROM pe) e
         JOIN nodes a ON a.page_id = e.page_id AND a.stage_id = src JOIN nodes b ON b.page_id = e.page_id AND b.stage_id = dst),
tc AS (SELECT page_id, src, dst FROM arcs UNION SELECT tc.page_id, tc.src, arcs.dst FROM tc JOIN arcs ON tc.page_id = arcs.page_id AND tc.dst = arcs.src),
cyc AS (SELECT a.page_id, a.src AS stage_id, arg_min(n.stage_id, n.stage_pos) AS head FROM tc a JOIN tc b ON a.page_id = b.page_id AND a.src = b.dst AND a.dst = b.src
        JOIN nodes n ON n.page_id = a.page_id AND n.stage_id = a.dst GROUP BY 1, 2)"""

REL_002_BODY = """
SELECT any_value(n.release_id) AS release_id, any_value(n.owner_id) AS owner_id, page_id, head AS stage_id, NULL AS element_id
FROM cyc JOIN nodes n USING (page_id, stage_id) GROUP BY page_id, head HAVING NOT bool_or(kind IN ('decision', 'choice', 'loopStart', 'loopEnd', 'wait'))"""


@query("rule_rel_002", _rule_sql(REL_002_BODY, "REL-002", "high", 0.85, True, CLOSURE))
def rule_rel_002(spark, sf):
    return _found(spark, sf, reliability.rel_002)


REL_003_BODY = "SELECT release_id, owner_id, page_id, stage_id, NULL AS element_id FROM st WHERE kind = 'wait' AND coalesce(timeout_seconds, 0) <= 0"


@query("rule_rel_003", _rule_sql(REL_003_BODY, "REL-003", "medium", 0.95))
def rule_rel_003(spark, sf):
    return _found(spark, sf, reliability.rel_003)


@query("rule_rel_004", _rule_sql("SELECT release_id, owner_id, NULL AS page_id, NULL AS stage_id, stage_id AS element_id FROM pt WHERE strong_match = 'index'", "REL-004", "medium", 0.9))
def rule_rel_004(spark, sf):
    return _found(spark, sf, reliability.rel_004)


REACHED = """
nodes AS (SELECT release_id, owner_id, page_id, stage_id, stage_pos, kind FROM st UNION ALL SELECT release_id, owner_id, page_id, stage_id, stage_pos, kind FROM pt),
arcs AS (SELECT page_id, src, dst FROM ed UNION ALL SELECT page_id, src, dst FROM pe),
hit AS (SELECT page_id, stage_id FROM nodes WHERE kind IN ('start', 'recover')
        UNION SELECT arcs.page_id, n.stage_id FROM hit JOIN arcs ON hit.page_id = arcs.page_id AND hit.stage_id = arcs.src JOIN nodes n ON n.page_id = arcs.page_id AND n.stage_id = arcs.dst)"""
DEAD_BODY = "SELECT release_id, owner_id, page_id, stage_id, NULL AS element_id FROM nodes WHERE kind NOT IN ('start', 'recover', 'data', 'collection', 'note', 'generic') AND (page_id, stage_id) NOT IN (SELECT page_id, stage_id FROM hit)"
ORPHAN_BODY = "SELECT release_id, owner_id, page_id, NULL AS stage_id, NULL AS element_id FROM pp WHERE owner_type = 'process' AND page_index > 0 AND page_id NOT IN (SELECT target_page_id FROM st WHERE target_page_id IS NOT NULL)"


@query("rule_mnt_001", _rule_sql(f"{DEAD_BODY} UNION ALL {ORPHAN_BODY}", "MNT-001", "medium", 0.9, True, REACHED))
def rule_mnt_001(spark, sf):
    return _found(spark, sf, maintenance.mnt_001)


USED = """
used AS (SELECT owner_id, split_part(unnest(regexp_extract_all(expr, '\\[([^\\]]+)\\]', 1)), '.', 1) AS name FROM st WHERE expr IS NOT NULL
  UNION SELECT owner_id, split_part(unnest(regexp_extract_all(input_raw, '\\[([^\\]]+)\\]', 1)), '.', 1) FROM st WHERE input_raw IS NOT NULL
  UNION SELECT owner_id, store_in FROM st WHERE store_in IS NOT NULL UNION SELECT owner_id, output_item FROM st WHERE output_item IS NOT NULL)"""
UNUSED_BODY = "SELECT release_id, owner_id, page_id, stage_id, NULL AS element_id FROM st WHERE kind = 'data' AND NOT EXISTS (SELECT 1 FROM used u WHERE u.owner_id = st.owner_id AND u.name = st.name)"


@query("rule_mnt_002", _rule_sql(UNUSED_BODY, "MNT-002", "low", 0.85, False, USED))
def rule_mnt_002(spark, sf):
    return _found(spark, sf, maintenance.mnt_002)


BAGS = """
bag AS (SELECT release_id, owner_id, owner_pos, token, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT release_id, owner_id, owner_pos, concat('p', page_index, ':', kind) AS token FROM pt
  UNION ALL SELECT release_id, owner_id, owner_pos, concat('p', page_index, ':e:flow') FROM pt
  UNION ALL SELECT release_id, owner_id, owner_pos, concat('el:', mode) FROM pt
  UNION ALL SELECT release_id, owner_id, owner_pos, concat('attr:', strong_match) FROM pt
  UNION ALL SELECT release_id, owner_id, owner_pos, 'attr:exact' FROM pt) GROUP BY ALL),
size AS (SELECT owner_id, any_value(owner_pos) AS pos, any_value(release_id) AS release_id, sum(n) AS size FROM bag GROUP BY owner_id),
common AS (SELECT a.owner_id AS a, b.owner_id AS b, sum(least(a.n, b.n)) AS c FROM bag a JOIN bag b ON a.release_id = b.release_id AND a.token = b.token AND a.owner_pos < b.owner_pos GROUP BY 1, 2),
sims AS (SELECT a, b, x.release_id, x.pos AS a_pos, y.pos AS b_pos, c / (x.size + y.size - c) AS similarity FROM common JOIN size x ON a = x.owner_id JOIN size y ON b = y.owner_id)"""


@query("structure_tokens", with_cte("SELECT owner_id, token, n FROM bag", False, BAGS))
def structure_tokens(spark, sf):
    return similarity.structure_tokens(estate(spark, sf)).select("owner_id", "token", "n")


@query("object_similarity", with_cte("SELECT a, b, round(similarity, 6) AS similarity FROM sims WHERE b_pos = a_pos + 1", False, BAGS))
def object_similarity(spark, sf):
    """Each object against the next one."""
    tokens = similarity.structure_tokens(estate(spark, sf))
    objects = tokens.select("release_id", "owner_id", "owner_pos").distinct()
    nxt = objects.select("release_id", F.col("owner_id").alias("b"), (F.col("owner_pos") - 1).alias("owner_pos"))
    pairs = objects.withColumnRenamed("owner_id", "a").join(nxt, ["release_id", "owner_pos"]).select("release_id", "a", "b")
    return similarity.object_similarity(pairs, tokens).select("a", "b", F.round("similarity", 6).alias("similarity"))


# The walk in document order, one object per step in every release at once.
WALK = BAGS + """,
objs AS (SELECT release_id, owner_id, pos, row_number() OVER (PARTITION BY release_id ORDER BY pos) AS i FROM size),
near AS (SELECT b AS owner_id, list(a_pos) AS earlier FROM sims WHERE similarity > 0.85 GROUP BY b),
walk AS (SELECT DISTINCT release_id, CAST(0 AS BIGINT) AS i, CAST([] AS INT[]) AS kept, CAST(NULL AS string) AS owner_id, CAST(NULL AS INT) AS canonical FROM objs
  UNION ALL SELECT w.release_id, o.i, CASE WHEN len(list_intersect(w.kept, coalesce(n.earlier, CAST([] AS INT[])))) > 0 THEN w.kept ELSE list_append(w.kept, o.pos) END, o.owner_id,
    list_min(list_intersect(w.kept, coalesce(n.earlier, CAST([] AS INT[])))) FROM walk w JOIN objs o ON o.release_id = w.release_id AND o.i = w.i + 1 LEFT JOIN near n ON n.owner_id = o.owner_id)"""


@query("rule_mnt_003", _rule_sql("SELECT release_id, owner_id, NULL AS page_id, NULL AS stage_id, NULL AS element_id FROM walk WHERE canonical IS NOT NULL", "MNT-003", "medium", 0.8, True, WALK))
def rule_mnt_003(spark, sf):
    return _found(spark, sf, maintenance.mnt_003)


@query("near_duplicates", with_cte("SELECT w.owner_id, concat('O', CAST(canonical AS string)) AS canonical_id, round(similarity, 6) AS similarity FROM walk w JOIN sims s ON s.b = w.owner_id AND s.a_pos = w.canonical AND s.release_id = w.release_id WHERE canonical IS NOT NULL", True, WALK))
def near_duplicates(spark, sf):
    found = similarity.near_duplicates(similarity.structure_tokens(estate(spark, sf)))
    return found.select("owner_id", "canonical_id", F.round("similarity", 6).alias("similarity"))


@query("greedy_dedupe", """
WITH RECURSIVE pairs AS (SELECT DISTINCT CAST(floor(o_orderkey / 100) AS BIGINT) AS g, o_custkey AS a, (o_custkey * 7 + 3) % 1000 AS b FROM orders), p AS (SELECT DISTINCT g, least(a, b) AS a, greatest(a, b) AS b FROM pairs WHERE a <> b),
nodes AS (SELECT g, n, row_number() OVER (PARTITION BY g ORDER BY n) AS i FROM (SELECT g, a AS n FROM p UNION SELECT g, b FROM p)), near AS (SELECT g, b, list(a) AS earlier FROM p GROUP BY g, b),
walk AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS canonical FROM nodes
  UNION ALL SELECT w.g, o.i, CASE WHEN len(list_intersect(w.kept, coalesce(e.earlier, CAST([] AS BIGINT[])))) > 0 THEN w.kept ELSE list_append(w.kept, o.n) END, o.n, list_min(list_intersect(w.kept, coalesce(e.earlier, CAST([] AS BIGINT[]))))
  FROM walk w JOIN nodes o ON o.g = w.g AND o.i = w.i + 1 LEFT JOIN near e ON e.g = w.g AND e.b = o.n)
SELECT g, n AS owner_id, canonical AS canonical_id FROM walk WHERE canonical IS NOT NULL""")
def greedy_dedupe(spark, sf):
    """Pairs of customers within a hundred orders, as if they were similar."""
    made = table(spark, sf, "orders").selectExpr("CAST(floor(o_orderkey / 100) AS BIGINT) AS release_id", "o_custkey AS x", "(o_custkey * 7 + 3) % 1000 AS y").where("x <> y")
    pairs = made.select("release_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    found = similarity.greedy_dedupe(pairs.withColumn("a_pos", F.col("a")).withColumn("b_pos", F.col("b")))
    return found.withColumnRenamed("release_id", "g")


PAGE_LIMIT = 8
OVERSIZE_BODY = f"SELECT release_id, owner_id, NULL AS page_id, NULL AS stage_id, NULL AS element_id FROM (SELECT release_id, owner_id, page_id, count(*) AS n FROM st GROUP BY ALL) GROUP BY release_id, owner_id HAVING sum(n) > 150 OR bool_or(n > {PAGE_LIMIT})"


@define_rule("MNT-004", "Oversized process", "medium", "maintainability", "The size rule with a page limit that fits the benchmark tables.")
def small_page_limit(e, meta):
    return maintenance.oversize_findings(e, meta, page_limit=PAGE_LIMIT)


@query("rule_mnt_004", _rule_sql(OVERSIZE_BODY, "MNT-004", "medium", 0.95))
def rule_mnt_004(spark, sf):
    return _found(spark, sf, small_page_limit)


EXPOSED = """
enc AS (SELECT release_id, name, arg_max(encrypted, queue_pos) AS encrypted FROM qu GROUP BY 1, 2),
first_item AS (SELECT owner_id, name, arg_min(coalesce(field_name, ''), stage_pos * 1000000.0) AS field_name FROM di GROUP BY 1, 2),
adds AS (SELECT st.*, regexp_extract(input_raw, '\\[([^\\]]+)\\]', 1) AS ref FROM st WHERE queue_name IS NOT NULL AND lower(action_name) LIKE '%add%' AND input_name = 'Data')"""


@query("rule_cmp_001", _rule_sql("""
SELECT adds.release_id, adds.owner_id, adds.page_id, adds.stage_id, NULL AS element_id FROM adds
LEFT JOIN enc ON adds.release_id = enc.release_id AND adds.queue_name = enc.name
WHERE NOT coalesce(enc.encrypted, false) AND EXISTS (
  SELECT 1 FROM (SELECT owner_id, name, arg_min(coalesce(field_name, ''), struct_pack(p := stage_pos, s := stage_id)) AS f FROM di GROUP BY 1, 2) i
  WHERE i.owner_id = adds.owner_id AND i.name = adds.ref AND i.f = 'Card Number')""", "CMP-001", "high", 0.85, False, EXPOSED))
def rule_cmp_001(spark, sf):
    return _found(spark, sf, compliance.cmp_001)


@query("rule_cmp_002", _rule_sql("SELECT release_id, owner_id, NULL AS page_id, NULL AS stage_id, NULL AS element_id FROM ow WHERE trim(coalesce(description, '')) = ''", "CMP-002", "info", 1.0))
def rule_cmp_002(spark, sf):
    return _found(spark, sf, compliance.cmp_002)


RUN = (reliability.rel_001, reliability.rel_003, reliability.rel_004, small_page_limit, compliance.cmp_002)


@define_rule("ZZZ-999", "Broken rule", "low", "reliability", "Always fails, to show that one failure stays alone.")
def broken_rule(e, meta):
    raise LookupError("no such table")


def _run(spark, sf):
    config = RuleConfig(disabled=frozenset({"CMP-002"}), severity_overrides={"REL-003": "low"})
    return run_rules(estate(spark, sf), [*RUN, broken_rule], config)


@query("run_rules", with_cte(f"""
SELECT rule_id, severity, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'REL-001' AS rule_id, 'high' AS severity FROM ({REL_001_BODY}) UNION ALL SELECT 'REL-003', 'low' FROM ({REL_003_BODY})
  UNION ALL SELECT 'REL-004', 'medium' FROM pt WHERE strong_match = 'index' UNION ALL SELECT 'MNT-004', 'medium' FROM ({OVERSIZE_BODY})) GROUP BY 1, 2"""))
def run_rules_query(spark, sf):
    findings, _ = _run(spark, sf)
    return findings.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


_ALL = (  # rule, severity, owner's letter, page's letter, stage, element, the orders whose release has it
    ("CMP-001", "high", "P", "w", "add", None, "substr(o_orderpriority, 1, 1) = '1' AND k % 3 <> 1"), ("CMP-002", "info", "P", None, None, None, "o_orderstatus = 'P'"),
    ("MNT-001", "medium", "P", "m", "throw", None, "k % 10 = 0"), ("MNT-001", "medium", "P", "w", "throw", None, "k % 10 <> 0"), ("MNT-001", "medium", "P", "s", None, None, "k % 5 = 0"),
    ("MNT-001", "medium", "P", "w", None, None, "k % 11 = 0"), ("MNT-001", "medium", "P", "w", "rec", None, "k % 3 = 1"), ("MNT-001", "medium", "P", "w", "res", None, "k % 3 = 1"),
    ("MNT-002", "low", "P", "m", "d4", None, "true"), ("REL-001", "high", "P", None, None, None, "k % 3 = 1"), ("REL-003", "medium", "O", "a", "wait", None, "k % 3 <> 2"),
    ("REL-004", "medium", "O", None, None, "e1", "k % 6 = 1"), ("SEC-001", "critical", "P", "m", "d1", None, "k % 3 = 0"), ("SEC-001", "critical", "P", "w", "call", None, "k % 10 = 3"),
    ("SEC-002", "high", "P", None, None, None, "k % 2 = 1"), ("SEC-003", "high", "P", "m", "note", None, "k % 6 = 0 AND k % 9 <> 0"), ("SEC-003", "high", "P", "w", "say", None, "k % 8 = 0"),
    ("SEC-004", "medium", "P", "m", "d4", None, "k % 4 = 0"),
)
_text = lambda x: "CAST(NULL AS string)" if x is None else f"'{x}'"


@query("run_all_rules", "WITH o AS (SELECT *, o_orderkey AS k FROM orders) " + " UNION ALL ".join(
    f"SELECT concat('X', CAST(k AS string)) AS release_id, '{rule}' AS rule_id, '{severity}' AS severity, concat('{owner}', CAST(k AS string)) AS owner_id, "
    f"{'CAST(NULL AS string)' if page is None else f"concat('{page}', CAST(k AS string))"} AS page_id, {_text(stage)} AS stage_id, {_text(element)} AS element_id FROM o WHERE {when}"
    for rule, severity, owner, page, stage, element, when in _ALL))
def run_all_rules(spark, sf):
    """All fourteen rules, as they come, in one run over the rendered releases."""
    findings, _ = run_rules(xml_estate(spark, sf, "stages", "edges"), ALL_RULES)
    return findings.select("release_id", "rule_id", "severity", located_owner().alias("owner_id"), "location.page_id", "location.stage_id", "location.element_id")


@define_rule("ZZZ-998", "Late failure", "low", "reliability", "Fails while it runs, on the first owner.")
def late_rule(e, meta):
    return engine.make_finding(meta, e.owners, F.raise_error(F.concat(F.lit("no sense in "), "owner_id")), "None.", 0.5)


@query("rule_errors", with_cte(f"""
SELECT 'ZZZ-998' AS rule_id, CAST(1 AS BIGINT) AS n, false AS ran UNION ALL SELECT 'ZZZ-999', CAST(1 AS BIGINT), false
UNION ALL SELECT 'REL-001', CAST(count(*) AS BIGINT), true FROM ({REL_001_BODY})"""))
def rule_errors(spark, sf):
    """A rule fails while it is planned and one while it runs; the third is not stopped by them."""
    findings, errors = run_rules(estate(spark, sf), [broken_rule, late_rule, reliability.rel_001], isolated=True)
    count = lambda df, ran: df.groupBy("rule_id").agg(F.count("*").alias("n")).withColumn("ran", F.lit(ran))
    return count(errors, False).unionByName(count(findings, True))


@query("rule_counts", with_cte(f"""
SELECT * FROM (SELECT 'REL-001' AS rule_id, (SELECT CAST(count(*) AS BIGINT) FROM ({REL_001_BODY})) AS finding_count UNION ALL SELECT 'REL-003', (SELECT CAST(count(*) AS BIGINT) FROM ({REL_003_BODY}))
UNION ALL SELECT 'REL-004', (SELECT CAST(count(*) AS BIGINT) FROM pt WHERE strong_match = 'index') UNION ALL SELECT 'MNT-004', (SELECT CAST(count(*) AS BIGINT) FROM ({OVERSIZE_BODY})) UNION ALL SELECT 'CMP-002', CAST(0 AS BIGINT))"""))
def rule_counts(spark, sf):
    return engine.rule_counts(_run(spark, sf)[0], RUN)


@query("order_findings", with_cte(f"""
SELECT rule_id, location_key, CAST(row_number() OVER (ORDER BY rank, rule_id, location_key) AS BIGINT) AS place FROM (
  SELECT 1 AS rank, 'REL-001' AS rule_id, concat(owner_id, '////') AS location_key FROM ({REL_001_BODY})
  UNION ALL SELECT 2, 'MNT-004', concat(owner_id, '////') FROM ({OVERSIZE_BODY}) UNION ALL SELECT 2, 'REL-004', concat('/', owner_id, '///', stage_id) FROM pt WHERE strong_match = 'index')"""))
def order_findings(spark, sf):
    """The place of each finding, numbered from the sorted partitions and their sizes."""
    from procatlas.model import location_key

    findings, _ = run_rules(estate(spark, sf), [reliability.rel_001, small_page_limit, reliability.rel_004])
    return engine.place_findings(findings).select("rule_id", location_key().alias("location_key"), "place")


@query("diff_findings", """
WITH a AS (SELECT doc_id, 'quality' AS flag FROM documents WHERE n_chars > 300 UNION ALL SELECT doc_id, 'toxic' FROM documents WHERE doc_id % 9 = 0),
e AS (SELECT doc_id, 'quality' AS flag FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)
SELECT 'missed' AS side, * FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM a) UNION ALL SELECT 'unexpected', * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM e)""")
def diff_findings(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    flag = lambda df, cond, name: df.where(cond).select("doc_id", F.lit(name).alias("flag"))
    actual = flag(docs, "n_chars > 300", "quality").unionByName(flag(docs, "doc_id % 9 = 0", "toxic"))
    expected = flag(labels, "quality = 1", "quality").unionByName(flag(labels, "toxic = 1", "toxic"))
    missed, unexpected = engine.diff_findings(actual, expected, ["doc_id", "flag"])
    return missed.withColumn("side", F.lit("missed")).unionByName(unexpected.withColumn("side", F.lit("unexpected")))


@query("credential_literals_in_documents", """
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '(?i)(?:password|passwd|secret|token|api_key)\\s*[=:]\\s*"([^"]*)"', 1), lambda v: length(v) >= 8 AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[^A-Za-z\\s]'))) AS BIGINT) AS n
FROM documents WHERE n > 0""")
def credential_literals_in_documents(spark, sf):
    values = F.regexp_extract_all("text", F.lit(r'(?i)(?:password|passwd|secret|token|api_key)\s*[=:]\s*"([^"]*)"'), F.lit(1))
    rows = table(spark, sf, "documents").select("doc_id", F.size(F.filter(values, t.credential_strength)).cast("long").alias("n"))
    return rows.where("n > 0")

SEVERITIES_SQL = "CASE c_custkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'info' END"
