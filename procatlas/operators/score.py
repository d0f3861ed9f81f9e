"""Scores, grades, totals, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.functions.ranks import (
    COMPAT_GRADES,
    GRADES,
    SEVERITIES,
    grade_for_score,
    grade_of_rank,
    grade_rank,
    severity_weight,
)
from procatlas.model import located_owner

STATUSES = ("analyzed", "converted", "validating", "validated", "deployed", "blocked")


def _severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES]


def score_findings(findings: DataFrame, *by: str) -> DataFrame:
    """Score 100 minus the severity weights, not below 0; grade, count and count per severity."""
    grouped = findings.groupBy(*by) if by else findings.groupBy()
    score = F.greatest(F.lit(0), F.lit(100) - F.coalesce(F.sum(severity_weight("severity")), F.lit(0)))
    out = grouped.agg(score.alias("score"), F.count("*").alias("finding_count"), *_severity_counts())
    return out.withColumn("grade", grade_for_score("score"))


def score_owners(owners: DataFrame, findings: DataFrame) -> DataFrame:
    """Every owner with its score; an owner without findings has 100 and an A."""
    placed = findings.select("release_id", located_owner().alias("owner_id"), "severity")
    scored = score_findings(placed, "release_id", "owner_id")
    counts = ["finding_count", *[f"n_{s}" for s in SEVERITIES]]
    joined = owners.select("release_id", "owner_id", "owner_type", "name").join(scored, ["release_id", "owner_id"], "left")
    return joined.select(
        "release_id", "owner_id", "owner_type", "name",
        F.coalesce("score", F.lit(100)).cast("long").alias("score"),
        F.coalesce("grade", F.lit("A")).alias("grade"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
    )


def worst_grade(grade: str = "grade", compat: bool = False) -> Column:
    """Aggregate: the worst grade, ``—`` when there is none.

    E ranks between D and F; with ``compat`` it does not count, as in the compared tool.
    """
    return grade_of_rank(F.coalesce(F.max(grade_rank(grade, compat)), F.lit(-1)), compat)


def average_score(score: str = "score") -> Column:
    return F.coalesce(F.floor(F.avg(score) + 0.5), F.lit(0)).cast("long")


def file_totals(scored: DataFrame, findings: DataFrame, compat: bool = False, by: str = "release_id") -> DataFrame:
    """Per file: findings, by severity, worst grade and average score of its components."""
    components = scored.groupBy(by).agg(
        F.count("*").alias("components"), worst_grade(compat=compat).alias("worst_grade"), average_score().alias("average_score")
    )
    found = findings.groupBy(by).agg(F.count("*").alias("findings"), *_severity_counts())
    joined = components.join(found, by, "full_outer")
    zero = ["components", "average_score", "findings", *[f"n_{s}" for s in SEVERITIES]]
    return joined.select(
        by, F.coalesce("worst_grade", F.lit("—")).alias("worst_grade"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero],
    )


def release_rollup(sections: DataFrame, compat: bool = False) -> DataFrame:
    """Subtotals per release and role, per release, and overall.

    ``sections`` has release_id, role, score, grade, finding_count, effort_hours.
    """
    return sections.rollup("release_id", "role").agg(
        F.count("*").alias("components"), F.sum("finding_count").alias("findings"),
        average_score().alias("average_score"), worst_grade(compat=compat).alias("worst_grade"),
        F.round(F.sum(F.coalesce("effort_hours", F.lit(0)).cast("decimal(18,2)")), 1).cast("double").alias("effort_hours"),
    )


def program_rollup(processes: DataFrame, compat: bool = False) -> DataFrame:
    """Per program: processes, effort, average score, worst grade and count per status."""
    by_status = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return processes.groupBy("program_id").agg(
        F.count("*").alias("process_count"),
        F.round(F.sum(F.coalesce("effort_hours", F.lit(0)).cast("decimal(18,2)")), 1).cast("double").alias("total_effort_hours"),
        average_score().alias("average_score"), worst_grade(compat=compat).alias("worst_grade"), *by_status,
    )


def tracked_processes(processes: DataFrame, findings: DataFrame) -> DataFrame:
    """Processes with their finding counts; missing numbers 0, a missing grade ``?``."""
    counted = findings.groupBy("process_id").agg(F.count("*").alias("finding_count"))
    return processes.join(counted, processes["id"] == counted["process_id"], "left").select(
        processes["id"], processes["program_id"], F.col("bp_name").alias("name"),
        F.coalesce("stage_count", F.lit(0)).alias("stage_count"), F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("grade", F.lit("?")).alias("grade"), "status",
        F.coalesce(F.col("effort_hours_est").cast("double"), F.lit(0.0)).alias("effort_hours"),
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"), "updated_at",
    )


def tally_by_severity(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by, "severity").agg(F.count("*").alias("n"))


def evaluate_gates(
    components: DataFrame, totals: DataFrame, fail_below: str | None = None, max_critical: int | None = None,
    compat: bool = False,
) -> DataFrame:
    """Rows (file, gate, detail) for everything that breaks a gate.

    ``components`` has file, name, grade; ``totals`` has file and n_critical.
    """
    spark = components.sparkSession
    broken = spark.createDataFrame([], "file string, gate string, detail string")
    if fail_below is not None:
        scale = COMPAT_GRADES if compat else GRADES
        wanted = fail_below.upper()
        if wanted not in scale:
            raise ValueError(f"fail_below expects one of {'/'.join(scale)}, got {fail_below!r}")
        low = components.where(grade_rank("grade", compat) > scale.index(wanted))
        broken = broken.unionByName(low.select(
            "file", F.lit("grade").alias("gate"),
            F.format_string('"%s" has grade %s, wanted %s or better', F.col("name"), F.col("grade"), F.lit(wanted)).alias("detail"),
        ))
    if max_critical is not None:
        over = totals.where(F.coalesce("n_critical", F.lit(0)) > max_critical)
        broken = broken.unionByName(over.select(
            "file", F.lit("critical").alias("gate"),
            F.format_string("%d critical finding(s), at most %d allowed", F.col("n_critical").cast("long"), F.lit(max_critical)).alias("detail"),
        ))
    return broken


def coverage_pct(converted: str = "converted") -> Column:
    """Aggregate: share of converted stages in percent with one decimal; 100 when there are none."""
    share = F.floor(F.count_if(F.col(converted)) * 1000 / F.count("*") + 0.5) / 10
    return F.coalesce(share, F.lit(100.0))
