"""Queries on the syntax of expressions rendered from orders, and of those in rendered releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procatlas.operators import syntax
from procatlas.plans.registry import query
from procatlas.plans.rendered import K, render, xml_chosen
from procatlas.plans.standin import table

VALUES = {
    "k": K,
    "c": "CAST(o_custkey AS string)",
    "deep": "repeat('Trim(', CAST(o_orderkey % 5 AS int))",
    "end": "repeat(')', CAST(o_orderkey % 5 AS int))",
    "more": "repeat(', [More]', CAST(o_orderkey % 3 AS int))",
    "sign": "CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END",
    "clerk": "concat('\"', o_orderpriority, '\"\"(\"')",
}
CALLS = 'Replace(Mid([Note [${k}], 1, Len("a(b) [c], ""q""")), ${clerk}, ${deep}[Id ${k}]${end}) & Text((Now())${more})'
OPERATORS = "${sign}[A] ^ 2 ^ ${c} - 3 * (${sign}${k} + 1) >= [B] AND NOT NOT [C] = TRUE"
FAULTS = (  # text, place and reason of the error
    ('[A] + ${c}', None, None), ('([A] + ${c}', 5, 'unclosed bracket'), ('[A] + * ${c}', 3, 'operand missing'), ('[A] ${c}', 2, 'operator missing'),
    ('Left([A], ${c}', 6, 'unclosed bracket'), ('([A], ${c})', 3, 'stray comma'), ('Left([A], )', 5, 'operand missing'), ('Total * ${c}', 1, 'name without call'),
    ('[A] & "${c}', 3, 'unclosed text'), ('[A] & [${c}', 3, 'unclosed reference'), ('[A] + ${c})', 4, 'unopened bracket'), ('${c} ? [A] + +', 2, 'unknown character'),
    ('"(" & ")""" & [A', 5, 'unclosed reference'),
)


def expressions(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """One expression per order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", render(template, VALUES).alias("raw"))


@query("expression_calls", """
WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 5 AS INT) AS deep, CAST(o_orderkey % 3 AS INT) AS more FROM orders)
SELECT o_orderkey, f AS function, CAST(d AS INT) AS depth, CAST(n AS INT) AS args FROM o, (VALUES ('Replace', 0, 3), ('Mid', 1, 3), ('Len', 2, 1), ('Now', 2, 0)) v(f, d, n)
UNION ALL SELECT o_orderkey, 'Text', 0, 1 + more FROM o
UNION ALL SELECT o_orderkey, 'Trim', CAST(d AS INT), 1 FROM (SELECT o_orderkey, unnest(range(1, deep + 1)) AS d FROM o)""")
def expression_calls(spark, sf):
    calls = syntax.expression_parts(expressions(spark, sf, CALLS)).where("part = 'call'")
    return calls.select("o_orderkey", F.col("text").alias("function"), "depth", "args")


@query("expression_operators", """
WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 2 = 0 AS INT) AS s FROM orders),
p AS (SELECT *, unnest([
  {'operator': '-', 'args': 1, 'depth': 0, 'last': false, 'place': 1, 'n': s}, {'operator': '^', 'args': 2, 'depth': 0, 'last': false, 'place': 2 + s, 'n': 1},
  {'operator': '^', 'args': 2, 'depth': 0, 'last': false, 'place': 4 + s, 'n': 1}, {'operator': '-', 'args': 2, 'depth': 0, 'last': false, 'place': 6 + s, 'n': 1},
  {'operator': '*', 'args': 2, 'depth': 0, 'last': false, 'place': 8 + s, 'n': 1}, {'operator': '-', 'args': 1, 'depth': 1, 'last': false, 'place': 10 + s, 'n': s},
  {'operator': '+', 'args': 2, 'depth': 1, 'last': true, 'place': 11 + 2 * s, 'n': 1}, {'operator': '>=', 'args': 2, 'depth': 0, 'last': false, 'place': 14 + 2 * s, 'n': 1},
  {'operator': 'AND', 'args': 2, 'depth': 0, 'last': true, 'place': 16 + 2 * s, 'n': 1}, {'operator': 'NOT', 'args': 1, 'depth': 0, 'last': false, 'place': 17 + 2 * s, 'n': 1},
  {'operator': 'NOT', 'args': 1, 'depth': 0, 'last': false, 'place': 18 + 2 * s, 'n': 1}, {'operator': '=', 'args': 2, 'depth': 0, 'last': false, 'place': 20 + 2 * s, 'n': 1}], recursive := true) FROM o)
SELECT o_orderkey, operator, CAST(args AS INT) AS args, CAST(depth AS INT) AS depth, last, CAST(place AS INT) AS place FROM p WHERE n = 1""")
def expression_operators(spark, sf):
    found = syntax.expression_parts(expressions(spark, sf, OPERATORS)).where("part = 'operator'")
    return found.select("o_orderkey", F.col("text").alias("operator"), "args", "depth", "last", "place")


@query("expression_errors", "SELECT o_orderkey, CASE o_orderkey % {0} {1} END AS place, CASE o_orderkey % {0} {2} END AS reason FROM orders WHERE o_orderkey % {0} <> 0".format(
    len(FAULTS), " ".join(f"WHEN {i} THEN CAST({at} AS INT)" for i, (_, at, _) in enumerate(FAULTS) if at), " ".join(f"WHEN {i} THEN '{why}'" for i, (_, _, why) in enumerate(FAULTS) if why)))
def expression_errors(spark, sf):
    orders = table(spark, sf, "orders")
    fault = F.expr(f"o_orderkey % {len(FAULTS)}")
    raw = F.coalesce(*[F.when(fault == i, render(text, VALUES)) for i, (text, _, _) in enumerate(FAULTS)])
    found = syntax.expression_parts(orders.select("o_orderkey", raw.alias("raw"))).where("part = 'error'")
    return found.select("o_orderkey", "place", F.col("text").alias("reason"))


@query("expression_issues", f"""
SELECT concat('P', {K}) AS owner_id, 'calc' AS stage_id, 'unknown-function' AS issue, 'Fancy' AS detail, CAST(8 AS INT) AS place FROM orders
UNION ALL SELECT concat('P', {K}), 'say', 'unknown-reference', 'Card Number', 3 FROM orders WHERE o_orderkey % 8 = 0
UNION ALL SELECT concat('P', {K}), 'get', 'unknown-reference', 'Queue', 1 FROM orders WHERE o_orderkey % 7 = 0""")
def expression_issues(spark, sf):
    e = xml_chosen(spark, sf, True, stages="release_id owner_id page_id stage_id exprs", data_items="release_id owner_id name")
    return syntax.expression_issues(e.stages, e.data_items).select("owner_id", "stage_id", "issue", "detail", "place")
