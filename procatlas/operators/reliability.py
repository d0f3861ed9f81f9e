"""Rules on error handling, loops, waits and element matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.model import Estate
from procatlas.operators import graph
from procatlas.operators.engine import define_rule, make_finding

RISKY_KINDS = ("action", "navigate", "write", "read", "wait", "code")
GUARD_KINDS = ("decision", "choice", "loopStart", "loopEnd", "wait")


def unrecovered_owners(stages: DataFrame) -> DataFrame:
    """Process owners with risky work and no recovery; two flags per owner, combined map-side."""
    flags = (
        stages.where((F.col("owner_type") == "process") & F.col("kind").isin("recover", *RISKY_KINDS))
        .groupBy("release_id", "owner_id", "owner_type")
        .agg(
            F.bool_or(F.col("kind") == "recover").alias("recovers"),
            F.bool_or(F.col("kind") != "recover").alias("risky"),
        )
    )
    return flags.where("risky and not recovers").select("release_id", "owner_id", "owner_type")


@define_rule("REL-001", "No error handling", "high", "reliability",
             "A process works on applications or queues and has no recover stage anywhere.")
def rel_001(estate: Estate, meta) -> DataFrame:
    return make_finding(
        meta, unrecovered_owners(estate.stages),
        F.lit("The process does application or queue work but no page has a recover stage."),
        "Wrap the work in recover and resume stages.", 0.9,
    )


def unguarded_cycles(stages: DataFrame, edges: DataFrame) -> DataFrame:
    """First stage (document order) of every cycle that no guard stage bounds."""
    cycles = graph.cycles(stages, edges)
    guard = F.col("kind").isin(*GUARD_KINDS)
    keys = ["release_id", "owner_id", "page_id"]
    members = cycles.join(stages.select(*keys, "stage_id", "kind"), [*keys, "stage_id"])
    heads = members.groupBy(*keys, "head").agg(F.bool_or(guard).alias("guarded"), F.count("*").alias("n"))
    return heads.where(~F.col("guarded")).select(*keys, F.col("head").alias("stage_id"), "n")


@define_rule("REL-002", "Unguarded loop", "high", "reliability",
             "A cycle of stages holds no decision, choice, loop or wait stage.")
def rel_002(estate: Estate, meta) -> DataFrame:
    heads = unguarded_cycles(estate.stages, estate.edges)
    kinds = estate.owners.select("release_id", "owner_id", "owner_type")
    message = F.format_string("%d stage(s) form a cycle that nothing bounds.", "n")
    return make_finding(meta, heads.join(kinds, ["release_id", "owner_id"]), message,
                        "Count the attempts and decide on the count, or use a bounded loop.", 0.85,
                        page=F.col("page_id"), stage=F.col("stage_id"))


@define_rule("REL-003", "Wait without timeout", "medium", "reliability",
             "A wait stage has no timeout or one of zero.")
def rel_003(estate: Estate, meta) -> DataFrame:
    rows = estate.stages.where((F.col("kind") == "wait") & (F.coalesce("timeout_seconds", F.lit(0.0)) <= 0))
    return make_finding(meta, rows, F.format_string('Wait stage "%s" has no timeout.', "name"),
                        "Give the wait a timeout and handle it.", 0.95,
                        page=F.col("page_id"), stage=F.col("stage_id"))


def index_attributes(attributes: str = "attributes") -> Column:
    return F.filter(attributes, lambda a: a["enabled"] & (a["match_type"] == "index"))


@define_rule("REL-004", "Element matched by position", "medium", "reliability",
             "An application element is found by an index attribute.")
def rel_004(estate: Estate, meta) -> DataFrame:
    rows = (
        estate.elements.withColumn("by_index", F.transform(index_attributes(), lambda a: a["name"]))
        .where(F.size("by_index") > 0)
        .withColumn("owner_type", F.lit("object"))
    )
    message = F.format_string('Element "%s" is matched by index (%s).', F.col("name"), F.array_join("by_index", ", "))
    return make_finding(meta, rows, message, "Match on attributes that survive a change of layout.", 0.9,
                        element=F.col("element_id"))
