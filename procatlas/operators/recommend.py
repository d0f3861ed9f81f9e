"""Recommendations that findings add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.functions.ranks import severity_of_rank, severity_rank
from procatlas.model import Estate, located_owner, location_key
from procatlas.operators.summary import finding_spots
from procatlas.operators.windows import top_per_key

# Which recommendation answers which rule.
TEMPLATES = {
    "SEC-001": "REC-CREDENTIAL-MANAGER",
    "SEC-002": "REC-CREDENTIAL-MANAGER",
    "SEC-003": "REC-MASK-PII-LOGS",
    "SEC-004": "REC-EXTERNALIZE-CONFIG",
    "CMP-001": "REC-ENCRYPT-QUEUES",
    "CMP-002": "REC-DOCUMENT-PROCESSES",
    "REL-001": "REC-REFRAMEWORK-EXCEPTIONS",
    "REL-002": "REC-BOUNDED-RETRIES",
    "REL-003": "REC-TIMEOUTS",
    "REL-004": "REC-STABLE-SELECTORS",
    "MNT-001": "REC-DELETE-DEAD-LOGIC",
    "MNT-002": "REC-PRUNE-DATA",
    "MNT-003": "REC-SHARED-LIBRARY",
    "MNT-004": "REC-DISPATCHER-PERFORMER",
}
PRACTICE = {
    "REC-CREDENTIAL-MANAGER": "Keep secrets in a credential store",
    "REC-MASK-PII-LOGS": "Keep personal data out of logs",
    "REC-EXTERNALIZE-CONFIG": "Keep environment values in settings",
    "REC-ENCRYPT-QUEUES": "Encrypt queues that carry personal data",
    "REC-DOCUMENT-PROCESSES": "Describe every process and object",
    "REC-REFRAMEWORK-EXCEPTIONS": "Catch and retry failures by policy",
    "REC-BOUNDED-RETRIES": "Bound every retry loop",
    "REC-TIMEOUTS": "Give every wait a timeout",
    "REC-STABLE-SELECTORS": "Match elements on stable attributes",
    "REC-DELETE-DEAD-LOGIC": "Remove dead logic before moving",
    "REC-PRUNE-DATA": "Remove unused data items",
    "REC-SHARED-LIBRARY": "Merge near-duplicate objects into a library",
    "REC-DISPATCHER-PERFORMER": "Split large processes into loader and worker",
}


def template_id(rule_id: str = "rule_id") -> Column:
    """The recommendation for a rule; null for rules without one."""
    pairs = F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv])
    return F.try_element_at(pairs, F.col(rule_id))


def _titles(rec: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PRACTICE.items() for x in kv]), rec)


def recommendations(findings: DataFrame, estate: Estate, by_owner: bool = True) -> DataFrame:
    """One row per recommendation, per owner or for each release.

    The worst severity per rule and the counts are plain aggregates over at most
    fourteen rules.  The first three places are picked by a top-3 that every task
    applies before the shuffle, and only those are resolved to names.
    """
    keys = ["release_id", *(["owner_id"] if by_owner else []), "recommendation"]
    hits = findings.withColumn("owner_id", located_owner()).withColumn("recommendation", template_id()).where("recommendation is not null")
    per_rule = hits.groupBy(*keys, "rule_id").agg(F.count("*").alias("n"), F.min(severity_rank("severity")).alias("rank"))
    per_rec = per_rule.groupBy(*keys).agg(
        F.sum("n").alias("finding_count"), F.min("rank").alias("worst_rank"),
        F.array_sort(F.collect_list(F.struct("rule_id", severity_of_rank("rank").alias("severity")))).alias("rules"),
    )
    order = [severity_rank("severity"), F.col("rule_id"), location_key(), F.col("message")]
    top = top_per_key(hits, keys, order, 3)
    named = finding_spots(top, estate)
    spots = named.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(severity_rank("severity").alias("r"), "rule_id", location_key().alias("k"), "message", "spot"))), lambda s: s["spot"]
        ).alias("spots")
    )
    more = F.when(F.col("finding_count") > 3, F.concat(F.lit(" and "), (F.col("finding_count") - 3).cast("string"), F.lit(" more"))).otherwise("")
    plural = F.when(F.col("finding_count") == 1, "").otherwise("s")
    rationale = F.concat(F.lit("Addresses "), F.col("finding_count").cast("string"), F.lit(" finding"), plural, F.lit(": "), F.array_join("spots", ", "), more, F.lit("."))
    return per_rec.join(spots, keys).select(
        *keys, _titles(F.col("recommendation")).alias("title"), severity_of_rank("worst_rank").alias("severity"), "worst_rank", "finding_count",
        F.transform("rules", lambda r: r["rule_id"]).alias("rule_ids"), F.map_from_entries("rules").alias("rule_severities"), rationale.alias("rationale"),
    )


def order_recommendations(recs: DataFrame) -> DataFrame:
    return recs.orderBy("worst_rank", "recommendation")


def recommendation_coverage(findings: DataFrame) -> DataFrame:
    """Per owner how many findings some recommendation answers."""
    return findings.withColumn("owner_id", located_owner()).groupBy("release_id", "owner_id").agg(
        F.count_if(template_id().isNotNull()).alias("covered"), F.count("*").alias("total")
    )
