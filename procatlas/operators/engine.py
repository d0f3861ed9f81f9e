"""Define, collect and run rules over an estate."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procatlas.functions.ranks import SEVERITIES, severity_rank
from procatlas.functions.text import clamp01
from procatlas.model import FINDING_SCHEMA, Estate, conform, location, location_key
from procatlas.session import cut, written

RULE_ID = re.compile(r"[A-Z]{3}-\d{3}")


@dataclass(frozen=True)
class RuleMeta:
    id: str
    title: str
    severity: str
    category: str
    description: str


@dataclass(frozen=True)
class Rule:
    """A named check; ``check`` turns an estate into finding rows and changes nothing."""

    meta: RuleMeta
    check: Callable[[Estate, RuleMeta], DataFrame]


@dataclass(frozen=True)
class RuleConfig:
    disabled: frozenset[str] = frozenset()
    severity_overrides: dict[str, str] = field(default_factory=dict)


def define_rule(id: str, title: str, severity: str, category: str, description: str):
    """Decorator that turns ``check(estate, meta)`` into a Rule."""
    if not RULE_ID.fullmatch(id):
        raise ValueError(f"rule id {id!r} is not of the form ABC-123")

    def wrap(check) -> Rule:
        return Rule(RuleMeta(id, title, severity, category, description), check)

    return wrap


def build_ruleset(rules: Iterable[Rule]) -> tuple[Rule, ...]:
    rules = tuple(rules)
    ids = [r.meta.id for r in rules]
    repeated = sorted({i for i in ids if ids.count(i) > 1})
    if repeated:
        raise ValueError(f"rule ids used twice: {', '.join(repeated)}")
    return rules


def make_finding(
    meta: RuleMeta,
    rows: DataFrame,
    message: Column,
    remediation: str,
    confidence: float | Column = 1.0,
    page: Column | None = None,
    stage: Column | None = None,
    element: Column | None = None,
) -> DataFrame:
    """Finding rows for rows that carry release_id, owner_type and owner_id."""
    confidence = F.lit(confidence) if isinstance(confidence, (int, float)) else confidence
    return rows.select(
        "release_id",
        F.lit(meta.id).alias("rule_id"),
        F.lit(meta.severity).alias("severity"),
        F.lit(meta.category).alias("category"),
        location(page_id=page, stage_id=stage, element_id=element).alias("location"),
        message.alias("message"),
        F.lit(remediation).alias("remediation"),
        clamp01(confidence).alias("confidence"),
    )


def run_rules(
    estate: Estate, rules: Iterable[Rule], config: RuleConfig = RuleConfig(), isolated: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Findings of all enabled rules, and one row per rule that failed.

    An override replaces a rule's severity before its plan is built, so it costs
    no join.  A rule that raises while its plan is built does not stop the rest.
    ``isolated`` writes each rule's findings on its own, so that neither does a
    rule that fails while it runs; without it the rules stay one plan.
    """
    spark = estate.owners.sparkSession
    empty = spark.createDataFrame([], FINDING_SCHEMA)
    plans, errors = [empty], []
    for rule in rules:
        if rule.meta.id in config.disabled:
            continue
        wanted = config.severity_overrides.get(rule.meta.id, rule.meta.severity)
        try:
            if wanted not in SEVERITIES:
                raise ValueError(f"unknown severity {wanted!r}")
            found = conform(rule.check(estate, replace(rule.meta, severity=wanted)), empty)
            plans.append(written(found, "findings") if isolated else found)
        except Exception as problem:  # noqa: BLE001 - the point is to report any failure
            errors.append((rule.meta.id, f"{type(problem).__name__}: {problem}"))
    findings = reduce(DataFrame.unionByName, plans)
    return findings, spark.createDataFrame(errors, "rule_id string, message string")


def order_findings(findings: DataFrame) -> DataFrame:
    """Worst first, then by rule, then by place."""
    return findings.orderBy(severity_rank("severity"), "rule_id", location_key(), "message")


def place_findings(findings: DataFrame) -> DataFrame:
    """Findings with their 1-based ``place`` in that order, from sorted partitions and the partitions' sizes."""
    rows = cut(order_findings(findings).withColumn("__id", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__id", 33))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(starts, "__part").withColumn("place", place).drop("__id", "__part", "__before")


def rule_counts(findings: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Findings per rule; rules without any stay in with 0."""
    spark = findings.sparkSession
    registry = spark.createDataFrame([(r.meta.id,) for r in rules], "rule_id string")
    counted = findings.groupBy("rule_id").agg(F.count("*").alias("n"))
    return registry.join(counted, "rule_id", "left").select(
        "rule_id", F.coalesce("n", F.lit(0)).cast("long").alias("finding_count")
    )


RESOLVED = ("rule_id", "process_name", "object_name", "page_name", "stage_name", "element_name")


def resolve_names(findings: DataFrame, estate: Estate) -> DataFrame:
    """Findings with the names of their owner, page, stage and element."""
    owner = F.coalesce(F.col("location.process_id"), F.col("location.object_id"))
    f = findings.withColumns(
        {
            "owner_id": owner,
            "page_id": F.col("location.page_id"),
            "stage_id": F.col("location.stage_id"),
            "element_id": F.col("location.element_id"),
        }
    )
    owners = estate.owners.select("release_id", "owner_id", "owner_type", F.col("name").alias("owner_name"))
    pages = estate.pages.select("release_id", "owner_id", "page_id", F.col("name").alias("page_name"))
    # only the stages that some finding names go on; a short list of findings is broadcast by size
    place = ["release_id", "owner_id", "page_id", "stage_id"]
    named = f.where("stage_id is not null").select(*place).distinct()
    stages = estate.stages.select(*place, F.col("name").alias("stage_name")).join(named, place, "left_semi")
    elements = estate.elements.select(
        "release_id", "owner_id", "element_id", F.col("name").alias("element_name")
    )
    return (
        f.join(owners, ["release_id", "owner_id"], "left")
        .join(pages, ["release_id", "owner_id", "page_id"], "left")
        .join(stages, ["release_id", "owner_id", "page_id", "stage_id"], "left")
        .join(elements, ["release_id", "owner_id", "element_id"], "left")
        .withColumn("process_name", F.when(F.col("location.process_id").isNotNull(), F.col("owner_name")))
        .withColumn("object_name", F.when(F.col("location.process_id").isNull(), F.col("owner_name")))
    )


def diff_findings(
    actual: DataFrame, expected: DataFrame, keys: Iterable[str] = RESOLVED, rule_ids: Iterable[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(missed, unexpected) as multisets of name rows; nulls compare equal.

    ``rule_ids`` narrows what is expected, never what was found.
    """
    keys = list(keys)
    wanted = expected if rule_ids is None else expected.where(F.col("rule_id").isin(*rule_ids))
    a, e = actual.select(*keys), wanted.select(*keys)
    return e.exceptAll(a), a.exceptAll(e)
