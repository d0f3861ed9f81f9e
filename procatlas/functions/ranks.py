"""Severity and grade scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from worst to mildest with their score penalty.
SEVERITY_WEIGHTS = {"critical": 25, "high": 10, "medium": 4, "low": 1, "info": 0}
SEVERITIES = tuple(SEVERITY_WEIGHTS)
# Lower bound of each grade.
GRADE_BANDS = (("A", 90), ("B", 80), ("C", 70), ("D", 60), ("E", 50))
GRADES = ("A", "B", "C", "D", "E", "F")
# The scale of the compared tool leaves out E, so an E never counts as worst there.
COMPAT_GRADES = ("A", "B", "C", "D", "F")


def _case(col: Column | str, mapping: dict, default) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    out = None
    for key, value in mapping.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return out.otherwise(F.lit(default))


def severity_rank(severity: Column | str) -> Column:
    """0 for critical up to 4 for info; unknown names sort last."""
    return _case(severity, {s: i for i, s in enumerate(SEVERITIES)}, len(SEVERITIES))


def severity_of_rank(rank: Column | str) -> Column:
    return _case(rank, dict(enumerate(SEVERITIES)), "info")


def severity_weight(severity: Column | str) -> Column:
    return _case(severity, SEVERITY_WEIGHTS, 0)


def grade_for_score(score: Column | str) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    out = None
    for grade, bound in GRADE_BANDS:
        out = F.when(score >= bound, grade) if out is None else out.when(score >= bound, grade)
    return out.otherwise("F")


def grade_rank(grade: Column | str, compat: bool = False) -> Column:
    """Position on the grade scale, -1 for a grade that is not on it.

    ``compat=True`` uses the scale without E.
    """
    scale = COMPAT_GRADES if compat else GRADES
    return _case(grade, {g: i for i, g in enumerate(scale)}, -1)


def grade_of_rank(rank: Column | str, compat: bool = False) -> Column:
    return _case(rank, dict(enumerate(COMPAT_GRADES if compat else GRADES)), "—")
