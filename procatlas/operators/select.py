"""Filters and small decisions on processes, findings and owners."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYOUT_THRESHOLD = 60


def filter_processes(rows: DataFrame, status: str = "all", search: str = "", name: str = "name") -> DataFrame:
    """Status equality and a case-blind part of the name; ``all`` and an empty search keep everything."""
    if status != "all":
        rows = rows.where(F.col("status") == status)
    needle = search.strip().lower()
    return rows.where(F.contains(F.lower(name), F.lit(needle))) if needle else rows


def filter_findings_by_severity(findings: DataFrame, enabled: Iterable[str]) -> DataFrame:
    return findings.where(F.col("severity").isin(*enabled))


def findings_for(findings: DataFrame, owner_id: str) -> DataFrame:
    place = F.col("location")
    return findings.where((place["process_id"] == owner_id) | (place["object_id"] == owner_id))


def has_role(stages: DataFrame, kinds: Iterable[str], out: str = "has_role") -> DataFrame:
    """Per owner whether any stage is of one of the kinds."""
    return stages.groupBy("release_id", "owner_id").agg(F.bool_or(F.col("kind").isin(*kinds)).alias(out))


def uses_queues() -> Column:
    return (F.col("kind") == "action") & (
        F.col("queue_name").isNotNull() | (F.coalesce("object_name", F.lit("")) == "Work Queues")
    )


def decide_layout(stage_count: Column, queues: Column, threshold: int = LAYOUT_THRESHOLD) -> Column:
    """Queue users and processes from the threshold on get the transaction framework."""
    return F.when(queues | (stage_count >= threshold), "reframework").otherwise("plain")


def layouts(stages: DataFrame, threshold: int = LAYOUT_THRESHOLD) -> DataFrame:
    per_owner = (
        stages.where(F.col("owner_type") == "process").groupBy("release_id", "owner_id")
        .agg(F.count("*").alias("stage_count"), F.bool_or(uses_queues()).alias("uses_queues"))
    )
    return per_owner.withColumn("layout", decide_layout(F.col("stage_count"), F.col("uses_queues"), threshold))


def first_queue(stages: DataFrame) -> DataFrame:
    """The first queue a process touches; a minimum per owner, combined map-side."""
    touched = stages.where((F.col("kind") == "action") & F.col("queue_name").isNotNull() & (F.col("owner_type") == "process"))
    return touched.groupBy("release_id", "owner_id").agg(
        F.min_by("queue_name", F.struct("page_index", "stage_pos")).alias("queue_name")
    )
