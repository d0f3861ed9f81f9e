"""Queries for the column functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from procatlas.functions import literals, ranks
from procatlas.functions import text as t
from procatlas.model import location_key
from procatlas.operators import naming, select, summary
from procatlas.plans.registry import query
from procatlas.plans.standin import estate, table, with_cte

PART_RAW = "concat('[', p_name, '.', p_brand, '] & \"', p_type, '\" + [ ', p_type, ' ]')"


@query("identifier_refs", f"SELECT p_partkey, array_to_string(regexp_extract_all({PART_RAW}, '\\[([^\\]]+)\\]', 1), '|') AS refs FROM part")
def identifier_refs(spark, sf):
    raw = table(spark, sf, "part").select("p_partkey", F.expr(PART_RAW).alias("raw"))
    return raw.select("p_partkey", F.array_join(t.identifier_refs("raw"), "|").alias("refs"))


@query("base_identifier", f"SELECT p_partkey, split_part(regexp_extract({PART_RAW}, '\\[([^\\]]+)\\]', 1), '.', 1) AS base FROM part")
def base_identifier(spark, sf):
    raw = table(spark, sf, "part").select("p_partkey", F.expr(PART_RAW).alias("raw"))
    return raw.select("p_partkey", F.get(t.base_refs("raw"), F.lit(0)).alias("base"))


LITERAL_RAW = "concat(CASE WHEN p_size % 2 = 0 THEN ' ' ELSE '' END, '\"', p_name, '\"', CASE WHEN p_size % 3 = 0 THEN ' & \"x\"' ELSE ' ' END)"


@query("whole_literal", f"SELECT p_partkey, CASE WHEN regexp_matches({LITERAL_RAW}, '^\\s*\"[^\"]*\"\\s*$') THEN regexp_extract({LITERAL_RAW}, '\"([^\"]*)\"', 1) END AS literal FROM part")
def whole_literal(spark, sf):
    raw = table(spark, sf, "part").select("p_partkey", F.expr(LITERAL_RAW).alias("raw"))
    return raw.select("p_partkey", t.whole_literal("raw").alias("literal"))


@query("is_sensitive_name", with_cte(
    "SELECT name, regexp_matches(name, '(?i)\\bssn\\b|social\\s*security|account\\s*number|card\\s*number|credit\\s*card|\\biban\\b|sort\\s*code') AS sensitive, CAST(count(*) AS BIGINT) AS n FROM st GROUP BY 1, 2"))
def is_sensitive_name(spark, sf):
    stages = estate(spark, sf).stages.where("owner_type = 'process'")
    return stages.groupBy("name").agg(F.count("*").alias("n")).select("name", t.is_sensitive_name("name").alias("sensitive"), "n")


@query("credential_names_in_documents",
       "SELECT lang, CAST(count(*) FILTER (WHERE regexp_matches(text, '(?i)passw(or)?d|\\bpwd\\b|secret|api[\\s_-]?key|\\btoken\\b|credential')) AS BIGINT) AS named, "
       "CAST(count(*) FILTER (WHERE len(list_filter(regexp_extract_all(text, '\"([^\"]*)\"', 1), lambda v: length(v) >= 8 AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[^A-Za-z\\s]'))) > 0) AS BIGINT) AS strong "
       "FROM documents GROUP BY lang")
def credential_names_in_documents(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "text")
    quoted = F.regexp_extract_all("text", F.lit('"([^"]*)"'), F.lit(1))
    return docs.groupBy("lang").agg(
        F.count_if(t.is_credential_name("text")).alias("named"),
        F.count_if(F.exists(quoted, t.credential_strength)).alias("strong"),
    )


SSN_RAW = "concat('id ', lpad(CAST(o_custkey % 1000 AS string), 3, '0'), '-', lpad(CAST(o_orderkey % 100 AS string), 2, '0'), '-', CASE WHEN o_orderstatus = 'F' THEN lpad(CAST(o_orderkey % 10000 AS string), 4, '0') ELSE '12' END)"


@query("has_ssn_digits", f"SELECT o_orderstatus, regexp_matches({SSN_RAW}, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b') AS hit, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2")
def has_ssn_digits(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderstatus", t.has_ssn_digits(F.expr(SSN_RAW)).alias("hit"))
    return rows.groupBy("o_orderstatus", "hit").agg(F.count("*").alias("n"))


@query("environment_values",
       "WITH v AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('\\\\', split_part(url, '/', 3), '\\share') WHEN 2 THEN concat(replace(split_part(url, '/', 3), '.', '-'), '.local') ELSE concat('see ', url) END AS value FROM pages) "
       "SELECT page_id, (regexp_matches(value, '^\\\\\\\\[\\w$.-]+\\\\') OR regexp_matches(value, '(?i)^https?://') OR regexp_matches(value, '(?i)^[\\w-]+\\.(corp|local|internal|lan)\\b')) AS fixed FROM v")
def environment_values(spark, sf):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    value = (
        F.when(F.col("page_id") % 4 == 0, F.col("url"))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("\\\\"), host, F.lit("\\share")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.replace(host, F.lit("."), F.lit("-")), F.lit(".local")))
        .otherwise(F.concat(F.lit("see "), F.col("url")))
    )
    return table(spark, sf, "pages").select("page_id", t.looks_like_environment_value(value).alias("fixed"))


@query("extract_refs", f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({PART_RAW}, '\\[([^\\]\\[]+)\\]', 1), lambda x: trim(x)))), '|') AS refs FROM part")
def extract_refs(spark, sf):
    raw = table(spark, sf, "part").select("p_partkey", F.expr(PART_RAW).alias("raw"))
    return raw.select("p_partkey", F.array_join(t.extract_refs("raw"), "|").alias("refs"))


@query("expressions_of_stages", with_cte(
    "SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(raw)) AS BIGINT) AS chars FROM (SELECT kind, expr AS raw FROM st WHERE expr IS NOT NULL UNION ALL SELECT kind, input_raw FROM st WHERE input_raw IS NOT NULL) GROUP BY kind"))
def expressions_of_stages(spark, sf):
    raws = estate(spark, sf).stages.select("kind", F.explode("exprs.raw").alias("raw"))
    return raws.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("raw")).alias("chars"))


@query("location_keys", with_cte("SELECT concat(owner_id, '//', page_id, '/', stage_id, '/') AS location_key FROM st WHERE kind = 'wait' AND coalesce(timeout_seconds, 0) <= 0"))
def location_keys(spark, sf):
    from procatlas.operators.engine import run_rules
    from procatlas.operators.reliability import rel_003

    findings, _ = run_rules(estate(spark, sf), [rel_003])
    return findings.select(location_key().alias("location_key"))


@query("location_paths", with_cte("SELECT page_id, stage_pos, concat('process/', ow.name, '/', page_name, '/', st.name) AS location_path FROM st JOIN ow USING (owner_id) WHERE kind = 'wait' AND coalesce(timeout_seconds, 0) <= 0"))
def location_paths(spark, sf):
    from procatlas.operators.engine import run_rules
    from procatlas.operators.reliability import rel_003

    e = estate(spark, sf)
    placed = summary.location_paths(run_rules(e, [rel_003])[0], e)
    return placed.select(
        F.col("location.page_id").alias("page_id"),
        F.split_part(F.col("location.stage_id"), F.lit(":"), F.lit(2)).cast("int").alias("stage_pos"), "location_path",
    )


@query("step_sentences", with_cte("""
SELECT stage_id, CASE kind
  WHEN 'action' THEN CASE WHEN queue_name IS NOT NULL THEN concat('Queue "', queue_name, '": ', action_name) ELSE concat('Call ', object_name, ' › ', action_name) END
  WHEN 'calculation' THEN concat('Set ', store_in, ' = ', CASE WHEN length(expr) <= 60 THEN expr ELSE concat(substr(expr, 1, 59), '…') END)
  WHEN 'decision' THEN concat('Decide: ', CASE WHEN length(expr) <= 60 THEN expr ELSE concat(substr(expr, 1, 59), '…') END)
  WHEN 'subsheetRef' THEN concat('Run page "', CASE WHEN target_page_id IS NOT NULL THEN page_name ELSE name END, '"')
  WHEN 'write' THEN 'Write 1 value(s) to the application'
  WHEN 'wait' THEN concat('Wait for 0 condition(s)', CASE WHEN timeout_seconds > 0 THEN concat(' (timeout ', CAST(CAST(timeout_seconds AS INT) AS string), 's)') ELSE ' (no timeout)' END)
  WHEN 'recover' THEN 'Recover from exception' END AS sentence
FROM st WHERE kind NOT IN ('start', 'data')"""))
def step_sentences(spark, sf):
    stages = estate(spark, sf).stages.where("owner_type = 'process'")
    said = stages.select("stage_id", summary.step_sentence().alias("sentence"))
    return said.where(F.col("sentence").isNotNull())


VAR_RAW = "concat('$', replace(p_name, ' ', '_'), '$ & $', p_type, '.', p_brand, '$ costs $5')"


@query("rewrite_vars", f"SELECT p_partkey, regexp_replace({VAR_RAW}, '\\$([A-Za-z_][\\w.]*)\\$', '[\\1]', 'g') AS raw FROM part")
def rewrite_vars(spark, sf):
    return table(spark, sf, "part").select("p_partkey", t.rewrite_vars(F.expr(VAR_RAW)).alias("raw"))


LITERALS_SQL = "regexp_extract_all(text, '\"(?:[^\"\\\\]|\\\\.|\"\")*\"|''(?:[^''\\\\]|\\\\.)*''', 0)"


@query("redact_literals", f"""
WITH f AS (SELECT doc_id, length(text) AS chars, list_filter({LITERALS_SQL}, lambda m: length(m) > 4) AS lits FROM documents)
SELECT doc_id, CAST(len(lits) AS BIGINT) AS literals,
  CAST(chars - coalesce(list_sum(list_transform(lits, lambda m: length(m))), 0) + coalesce(list_sum(list_transform(range(1, len(lits) + 1), lambda i: 10 + length(CAST(i AS string)))), 0) AS BIGINT) AS redacted_chars,
  md5(array_to_string(lits, '|')) AS hidden, true AS restores
FROM f""")
def redact_literals(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    done = docs.select(
        "doc_id", "text", literals.long_literals("text").alias("lits"), literals.redact_literals("text").alias("redacted")
    )
    return done.select(
        "doc_id", F.size("lits").cast("long").alias("literals"), F.length("redacted").cast("long").alias("redacted_chars"),
        F.md5(F.array_join("lits", "|")).alias("hidden"),
        (literals.restore_literals("redacted", "lits") == F.col("text")).alias("restores"),
    )


@query("sanitize_identifier", "SELECT o_orderkey, CASE WHEN regexp_matches(s, '^[0-9]') THEN concat('_', s) ELSE s END AS identifier, array_to_string(list_filter(regexp_split_to_array(o_orderpriority, '[^A-Za-z0-9]+'), lambda p: p <> ''), '.') AS package FROM (SELECT o_orderkey, o_orderpriority, regexp_replace(regexp_replace(concat(o_orderpriority, ' '), '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM orders)")
def sanitize_identifier(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", t.sanitize_identifier("o_orderpriority").alias("identifier"), t.package_id("o_orderpriority").alias("package")
    )


@query("unique_names", with_cte("SELECT stage_id, CASE WHEN k = 1 THEN base ELSE concat(base, '_', CAST(k AS string)) END AS identifier FROM (SELECT stage_id, base, row_number() OVER (PARTITION BY owner_id, base ORDER BY stage_pos) AS k FROM (SELECT *, replace(name, ' ', '_') AS base FROM pt))"))
def unique_names(spark, sf):
    parts = estate(spark, sf).stages.where("owner_type = 'object'")
    claims = parts.select("owner_id", "stage_id", "stage_pos", t.sanitize_identifier("name").alias("base"))
    named = naming.unique_names(claims, ["owner_id"], "base", "stage_pos", [F.floor(F.col("stage_pos") / 1000)])
    return named.select("stage_id", "identifier")


@query("stable_ids", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12))) AS BIGINT) AS ids, min(concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12))) AS first_id FROM (SELECT sha256(concat(p_name, chr(1), CAST(p_partkey AS string))) AS h FROM part)")
def stable_ids(spark, sf):
    ids = table(spark, sf, "part").select(t.stable_id("p_name", F.col("p_partkey").cast("string")).alias("id"))
    return ids.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("first_id"))


SIZE = "CAST(floor(o_totalprice) AS BIGINT) * CAST(pow(10, o_orderkey % 6) AS BIGINT)"


@query("format_bytes", f"""
WITH v AS (SELECT o_orderkey, CAST({SIZE} AS DOUBLE) AS b FROM orders),
s AS (SELECT *, CASE WHEN b < 1048576 THEN b / 1024 WHEN b < 1073741824 THEN b / 1048576 ELSE b / 1073741824 END AS x,
  CASE WHEN b < 1048576 THEN 'KB' WHEN b < 1073741824 THEN 'MB' ELSE 'GB' END AS u FROM v)
SELECT o_orderkey, CASE WHEN b < 1024 THEN concat(CAST(CAST(b AS BIGINT) AS string), ' B') WHEN x >= 100 THEN concat(CAST(CAST(floor(x + 0.5) AS BIGINT) AS string), ' ', u)
  ELSE concat(regexp_replace(printf('%.1f', floor(x * 10 + 0.5) / 10), '\\.0$', ''), ' ', u) END AS size FROM s""")
def format_bytes(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", t.format_bytes(F.expr(SIZE)).alias("size"))


SEVERITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'low' ELSE 'info' END"


@query("severity_scale", f"SELECT s AS severity, CAST(CASE s WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS INT) AS severity_rank, CAST(CASE s WHEN 'critical' THEN 25 WHEN 'high' THEN 10 WHEN 'medium' THEN 4 WHEN 'low' THEN 1 ELSE 0 END AS INT) AS weight, CAST(count(*) AS BIGINT) AS n FROM (SELECT {SEVERITY} AS s FROM orders) GROUP BY s")
def severity_scale(spark, sf):
    rows = table(spark, sf, "orders").select(F.expr(SEVERITY).alias("severity"))
    return rows.groupBy("severity").agg(F.count("*").alias("n")).select(
        "severity", ranks.severity_rank("severity").alias("severity_rank"), ranks.severity_weight("severity").alias("weight"), "n"
    )


@query("grade_scale", "SELECT CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' WHEN s >= 50 THEN 'E' ELSE 'F' END AS grade, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey % 101 AS s FROM orders) GROUP BY 1")
def grade_scale(spark, sf):
    rows = table(spark, sf, "orders").select(ranks.grade_for_score(F.col("o_orderkey") % 101).alias("grade"))
    return rows.groupBy("grade").agg(F.count("*").alias("n"))


@query("clamped_confidence", "SELECT l_orderkey, least(1.0, greatest(0.0, l_discount * 20 - 0.5)) AS confidence, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2")
def clamped_confidence(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", t.clamp01(F.col("l_discount") * 20 - 0.5).alias("confidence"))
    return rows.groupBy("l_orderkey", "confidence").agg(F.count("*").alias("n"))


@query("queue_action_class", with_cte("SELECT action_name, CASE action_name WHEN 'Get Next Item' THEN 'get_next' WHEN 'Add To Queue' THEN 'add' WHEN 'Mark Completed' THEN 'complete' WHEN 'Mark Exception' THEN 'exception' ELSE 'other' END AS class, CAST(count(*) AS BIGINT) AS n FROM st WHERE kind = 'action' GROUP BY 1, 2"))
def queue_action_class(spark, sf):
    calls = estate(spark, sf).stages.where("kind = 'action'")
    return calls.groupBy("action_name").agg(F.count("*").alias("n")).select("action_name", t.queue_action_class("action_name").alias("class"), "n")


@query("filter_processes", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND lower(c_name) LIKE '%omer#00000001%'")
def filter_processes(spark, sf):
    rows = table(spark, sf, "customer").withColumnsRenamed({"c_mktsegment": "status", "c_name": "name"})
    return select.filter_processes(rows, "BUILDING", " OMER#00000001 ").select("c_custkey", F.col("name").alias("c_name"))


@query("filter_findings_by_severity", f"SELECT o_orderkey, {SEVERITY} AS severity FROM orders WHERE {SEVERITY} IN ('critical', 'low')")
def filter_findings_by_severity(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr(SEVERITY).alias("severity"))
    return select.filter_findings_by_severity(rows, ["critical", "low"])


@query("findings_for_owner", with_cte("SELECT stage_id FROM st WHERE owner_id = 'P7' AND kind = 'wait' AND coalesce(timeout_seconds, 0) <= 0"))
def findings_for_owner(spark, sf):
    from procatlas.operators.engine import run_rules
    from procatlas.operators.reliability import rel_003

    findings, _ = run_rules(estate(spark, sf), [rel_003])
    return select.findings_for(findings, "P7").select(F.col("location.stage_id").alias("stage_id"))


@query("owners_with_recovery", with_cte("SELECT owner_id, bool_or(kind = 'recover') AS has_role FROM (SELECT owner_id, kind FROM st UNION ALL SELECT owner_id, kind FROM pt) GROUP BY owner_id"))
def owners_with_recovery(spark, sf):
    return select.has_role(estate(spark, sf).stages, ["recover"]).select("owner_id", "has_role")


@query("decide_layout", with_cte("SELECT owner_id, CAST(count(*) AS BIGINT) AS stage_count, bool_or(queue_name IS NOT NULL) AS uses_queues, CASE WHEN bool_or(queue_name IS NOT NULL) OR count(*) >= 60 THEN 'reframework' ELSE 'plain' END AS layout FROM st GROUP BY owner_id"))
def decide_layout(spark, sf):
    return select.layouts(estate(spark, sf).stages).select("owner_id", "stage_count", "uses_queues", "layout")


@query("first_queue", with_cte("SELECT owner_id, arg_min(queue_name, page_index * 1000 + stage_pos) AS queue_name FROM st WHERE queue_name IS NOT NULL GROUP BY owner_id"))
def first_queue(spark, sf):
    return select.first_queue(estate(spark, sf).stages).select("owner_id", "queue_name")


# --- expression functions ----------------------------------------------------


@query("expression_text", """
SELECT p_partkey, CAST(length(p_name) AS INT) AS len, upper(p_name) AS upper_, lower(p_brand) AS lower_, trim(concat('  ', p_name, ' ')) AS trimmed, ltrim(concat('  ', p_name, ' ')) AS trim_start, rtrim(concat('  ', p_name, ' ')) AS trim_end,
  left(p_name, 3) AS left_, right(p_name, 3) AS right_, substr(p_name, 2, 4) AS mid, CAST(instr(p_name, ' ') AS INT) AS instr_, replace(p_name, 'e', 'E') AS replaced, chr(CAST(65 + p_size % 26 AS INT)) AS chr_, CAST(ascii(p_name) AS INT) AS asc_,
  TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) IS NOT NULL AS is_number, TRY_CAST(p_brand AS DOUBLE) IS NOT NULL AS is_not, starts_with(p_name, 'red') AS starts, ends_with(p_name, 'ring') AS ends_, contains(p_name, 'l') AS contains_, concat(p_name, p_brand) AS joined
FROM part""")
def expression_text(spark, sf):
    from procatlas.functions.expressions import FUNCTIONS as X
    from procatlas.functions.expressions import OPERATORS

    name, brand, padded = F.col("p_name"), F.col("p_brand"), F.concat(F.lit("  "), "p_name", F.lit(" "))
    return table(spark, sf, "part").select(
        "p_partkey", X["len"](name).alias("len"), X["upper"](name).alias("upper_"), X["lower"](brand).alias("lower_"), X["trim"](padded).alias("trimmed"),
        X["trimstart"](padded).alias("trim_start"), X["trimend"](padded).alias("trim_end"), X["left"](name, F.lit(3)).alias("left_"), X["right"](name, F.lit(3)).alias("right_"),
        X["mid"](name, F.lit(2), F.lit(4)).alias("mid"), X["instr"](name, F.lit(" ")).alias("instr_"), X["replace"](name, F.lit("e"), F.lit("E")).alias("replaced"),
        X["chr"](65 + F.col("p_size") % 26).alias("chr_"), X["asc"](name).alias("asc_"), X["isnumber"](F.regexp_replace(brand, "Brand#", "")).alias("is_number"), X["isnumber"](brand).alias("is_not"),
        X["startswith"](name, F.lit("red")).alias("starts"), X["endswith"](name, F.lit("ring")).alias("ends_"), X["contains"](name, F.lit("l")).alias("contains_"), OPERATORS["&"](name, brand).alias("joined"),
    )


@query("expression_math", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_quantity - 25) AS abs_, round(sqrt(l_quantity), 6) AS sqrt_, round(ln(l_quantity), 6) AS log_, round_even(l_quantity / 2, 0) AS round_, CAST(ceil(l_quantity / 4) AS BIGINT) AS up, CAST(floor(l_quantity / 4) AS BIGINT) AS down,
  pow(l_linenumber, 2) AS power, l_quantity * 2 - 1 > 20 OR NOT l_linenumber = 3 AS logic, TRY_CAST(CAST(l_linenumber AS string) AS DOUBLE) AS number FROM lineitem""")
def expression_math(spark, sf):
    from procatlas.functions.expressions import FUNCTIONS as X
    from procatlas.functions.expressions import OPERATORS as O

    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X["abs"](O["-"](q, F.lit(25))).alias("abs_"), F.round(X["sqrt"](q), 6).alias("sqrt_"), F.round(X["log"](q), 6).alias("log_"),
        X["round"](O["/"](q, F.lit(2))).alias("round_"), X["rndup"](q / 4).alias("up"), X["rnddn"](q / 4).alias("down"), O["^"](n, F.lit(2)).alias("power"),
        O["or"](O[">"](O["-"](O["*"](q, F.lit(2)), F.lit(1)), F.lit(20)), ~O["="](n, F.lit(3))).alias("logic"), X["tonumber"](n.cast("string")).alias("number"),
    )


@query("expression_dates", """
SELECT o_orderkey, strftime(o_orderdate + INTERVAL 2 YEARS, '%Y-%m-%d') AS years, strftime(o_orderdate + INTERVAL 3 MONTHS, '%Y-%m-%d') AS quarter_, strftime(o_orderdate + to_months(CAST(o_custkey % 20 AS INT)), '%Y-%m-%d') AS months, strftime(o_orderdate + to_days(CAST(7 * (o_custkey % 9) AS INT)), '%Y-%m-%d') AS weeks,
  strftime(o_orderdate + to_hours(o_custkey % 50), '%Y-%m-%d %H') AS hours, CAST(round_even(date_diff('second', o_orderdate, o_orderdate + to_hours(o_custkey % 50)) / 86400.0, 0) AS BIGINT) AS days_between, CAST(date_diff('month', o_orderdate, TIMESTAMP '2001-01-15') AS BIGINT) AS months_between,
  CAST(date_diff('year', o_orderdate, TIMESTAMP '2001-01-15') AS BIGINT) AS years_between, CAST(date_diff('quarter', o_orderdate, TIMESTAMP '2001-01-15') AS BIGINT) AS quarters_between, strftime(o_orderdate, '%d/%m/%Y') AS formatted FROM orders""")
def expression_dates(spark, sf):
    from procatlas.functions.expressions import FUNCTIONS as X

    d, c = F.col("o_orderdate").cast("timestamp"), F.col("o_custkey")
    end = F.lit("2001-01-15 00:00:00").cast("timestamp")
    day = lambda col: F.date_format(col, "yyyy-MM-dd")
    later = X["dateadd"]("h", c % 50, d)
    return table(spark, sf, "orders").select(
        "o_orderkey", day(X["dateadd"]("yyyy", F.lit(2), d)).alias("years"), day(X["dateadd"]("q", F.lit(1), d)).alias("quarter_"), day(X["dateadd"]("m", c % 20, d)).alias("months"),
        day(X["dateadd"]("ww", c % 9, d)).alias("weeks"), F.date_format(later, "yyyy-MM-dd HH").alias("hours"), X["datediff"]("d", d, later).alias("days_between"),
        X["datediff"]("m", d, end).alias("months_between"), X["datediff"]("yyyy", d, end).alias("years_between"), X["datediff"]("q", d, end).alias("quarters_between"),
        X["formatdate"](d, "dd/MM/yyyy").alias("formatted"),
    )
