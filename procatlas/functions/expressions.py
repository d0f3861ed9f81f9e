"""The functions of exported expressions as column functions.

Argument positions and edge cases follow the source language: positions are
1-based, ``Round`` rounds halves to even, a date difference in days or less is
rounded, one in weeks or more counts boundaries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


def _months(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def date_add(interval: str, number: Column, date: Column) -> Column:
    """``interval`` is one of yyyy, q, m, ww, w, d, y, h, n, s."""
    key = interval.lower()
    months = {"yyyy": 12, "q": 3, "m": 1}
    seconds = {"ww": 604_800, "w": 86_400, "d": 86_400, "y": 86_400, "h": 3_600, "n": 60, "s": 1}
    stamp = date.cast("timestamp")
    if key in months:
        moved = F.add_months(stamp.cast("date"), (number * months[key]).cast("int")).cast("timestamp")
        return F.timestamp_micros(F.unix_micros(moved) + F.unix_micros(stamp) - F.unix_micros(stamp.cast("date").cast("timestamp")))
    if key in seconds:
        return F.timestamp_micros(F.unix_micros(stamp) + (number * seconds[key]).cast("long") * 1_000_000)
    raise ValueError(f"unknown interval {interval!r}")


def date_diff(interval: str, start: Column, end: Column) -> Column:
    """From ``start`` to ``end``: d, h, n, s round to even; yyyy, q, m, ww, w count."""
    key = interval.lower()
    unit = {"d": 86_400, "h": 3_600, "n": 60, "s": 1}
    if key in unit:
        return F.bround(_micros_between(start, end) / (unit[key] * 1_000_000)).cast("long")
    if key == "yyyy":
        return (F.year(end) - F.year(start)).cast("long")
    if key == "m":
        return (_months(end) - _months(start)).cast("long")
    if key == "q":
        return (F.year(end) * 4 + F.quarter(end) - F.year(start) * 4 - F.quarter(start)).cast("long")
    if key == "w":
        days = F.datediff(end, start)
        return F.when(days >= 0, F.floor(days / 7)).otherwise(F.ceil(days / 7)).cast("long")
    if key == "ww":
        sunday = lambda d: F.date_sub(d.cast("date"), F.dayofweek(d) - 1)
        return (F.datediff(sunday(end), sunday(start)) / 7).cast("long")
    raise ValueError(f"unknown interval {interval!r}")


def _quoted_format(col: Column, pattern: Column | str) -> Column:
    return F.date_format(col, pattern)


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "len": F.length,
    "upper": F.upper,
    "lower": F.lower,
    "trim": lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""),
    "trimstart": lambda s: F.regexp_replace(s, r"^\s+", ""),
    "trimend": lambda s: F.regexp_replace(s, r"\s+$", ""),
    "left": F.left,
    "right": F.right,
    "mid": lambda s, start, size: s.substr(start, size),
    "instr": lambda s, part: F.locate(part, s) if isinstance(part, str) else F.position(part, s),
    "replace": F.replace,
    "chr": F.char,
    "asc": F.ascii,
    "isnumber": lambda s: s.try_cast("double").isNotNull(),
    "startswith": F.startswith,
    "endswith": F.endswith,
    "contains": F.contains,
    "abs": F.abs,
    "sqrt": F.sqrt,
    "log": F.log,
    "round": lambda n, places=0: F.bround(n, places),
    "rndup": F.ceil,
    "rnddn": F.floor,
    "now": F.current_timestamp,
    "today": F.current_date,
    "newline": lambda: F.lit("\n"),
    "tonumber": lambda s: s.try_cast("double"),
    "todate": lambda s: F.try_to_date(s),
    "formatdate": _quoted_format,
    "formatdatetime": _quoted_format,
    "dateadd": date_add,
    "datediff": date_diff,
}
# Functions that only exist while an error is handled: no column form, but known.
RECOVERY_FUNCTIONS = ("exceptiondetail", "exceptiontype", "exceptionstage")
FUNCTION_NAMES = (*FUNCTIONS, *RECOVERY_FUNCTIONS)

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "or": lambda a, b: a | b,
    "and": lambda a, b: a & b,
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "&": lambda a, b: F.concat(a, b),
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b,
    "^": F.pow,
}
