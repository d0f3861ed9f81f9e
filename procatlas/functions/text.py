"""String functions on names, expressions and values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide which names and values count as sensitive.
CREDENTIAL_NAME = r"(?i)passw(or)?d|\bpwd\b|secret|api[\s_-]?key|\btoken\b|credential"
SENSITIVE_NAME = (
    r"(?i)\bssn\b|social\s*security|account\s*number|card\s*number|credit\s*card|\biban\b|sort\s*code"
)
SSN_DIGITS = r"\b\d{3}-\d{2}-\d{4}\b"
ENVIRONMENT_VALUES = (
    r"^\\\\[\w$.-]+\\",
    r"(?i)^https?://",
    r"(?i)^[\w-]+\.(corp|local|internal|lan)\b",
)

REFERENCE = r"\[([^\]]+)\]"
FLAT_REFERENCE = r"\[([^\]\[]+)\]"
WHOLE_LITERAL = r'^\s*"([^"]*)"\s*$'


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def identifier_refs(raw: Column | str) -> Column:
    """Contents of every ``[…]`` reference, in order, with repeats."""
    return F.regexp_extract_all(_c(raw), F.lit(REFERENCE), F.lit(1))


def base_identifier(ref: Column | str) -> Column:
    """``Collection.Field`` names the collection; other names pass through."""
    return F.substring_index(_c(ref), ".", 1)


def base_refs(raw: Column | str) -> Column:
    return F.transform(identifier_refs(raw), base_identifier)


def whole_literal(raw: Column | str) -> Column:
    """Content of an expression that is exactly one quoted string, else null."""
    raw = _c(raw)
    return F.when(raw.rlike(WHOLE_LITERAL), F.regexp_extract(raw, WHOLE_LITERAL, 1))


def is_sensitive_name(name: Column | str) -> Column:
    return _c(name).rlike(SENSITIVE_NAME)


def is_credential_name(name: Column | str) -> Column:
    return _c(name).rlike(CREDENTIAL_NAME)


def credential_strength(value: Column | str) -> Column:
    """At least 8 characters, a letter, and something that is neither letter nor space."""
    value = _c(value)
    return (F.length(value) >= 8) & value.rlike("[A-Za-z]") & value.rlike(r"[^A-Za-z\s]")


def has_ssn_digits(text: Column | str) -> Column:
    return _c(text).rlike(SSN_DIGITS)


def looks_like_environment_value(value: Column | str) -> Column:
    value = _c(value)
    return reduce(lambda a, b: a | b, [value.rlike(p) for p in ENVIRONMENT_VALUES])


def extract_refs(raw: Column | str) -> Column:
    """References without nested brackets: trimmed, distinct, sorted."""
    found = F.regexp_extract_all(_c(raw), F.lit(FLAT_REFERENCE), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda r: F.trim(r))))


def rewrite_vars(raw: Column | str) -> Column:
    """Interpolated ``$Name$`` variables become ``[Name]`` references."""
    return F.regexp_replace(_c(raw), r"\$([A-Za-z_][\w.]*)\$", r"[$1]")


def sanitize_identifier(name: Column | str) -> Column:
    """A display name as an identifier: runs of other characters become one underscore."""
    cleaned = F.regexp_replace(F.regexp_replace(_c(name), r"[^A-Za-z0-9_]+", "_"), r"^_+|_+$", "")
    cleaned = F.when(cleaned == "", F.lit("Item")).otherwise(cleaned)
    return F.when(cleaned.rlike("^[0-9]"), F.concat(F.lit("_"), cleaned)).otherwise(cleaned)


def package_id(name: Column | str) -> Column:
    """The alphanumeric runs of a name joined by dots."""
    return F.array_join(F.filter(F.split(_c(name), "[^A-Za-z0-9]+"), lambda p: p != ""), ".")


def stable_id(*parts: Column | str) -> Column:
    """An id that depends only on its parts."""
    digest = F.sha2(F.concat_ws("\u0001", *[_c(p) for p in parts]), 256)
    pieces = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *pieces)


def source_hash(content: Column | str, name: Column | str | None = None) -> Column:
    """SHA-256 of the content, or of name and content on two lines."""
    content = _c(content)
    return F.sha2(content if name is None else F.concat_ws("\n", _c(name), content), 256)


def format_bytes(size: Column | str) -> Column:
    """1536 → ``1.5 KB``; one decimal below 100 of a unit, none from there on."""
    size = _c(size).cast("double")
    scaled = F.when(size < 1024**2, size / 1024).when(size < 1024**3, size / 1024**2).otherwise(size / 1024**3)
    unit = F.when(size < 1024**2, F.lit("KB")).when(size < 1024**3, F.lit("MB")).otherwise(F.lit("GB"))
    tenths = F.floor(scaled * 10 + 0.5)
    short = F.when(tenths % 10 == 0, (tenths / 10).cast("long").cast("string")).otherwise(
        F.concat_ws(".", F.floor(tenths / 10).cast("string"), (tenths % 10).cast("string"))
    )
    text = F.when(scaled >= 100, F.floor(scaled + 0.5).cast("string")).otherwise(short)
    return F.when(size < 1024, F.concat_ws(" ", size.cast("long").cast("string"), F.lit("B"))).otherwise(
        F.concat_ws(" ", text, unit)
    )


def clamp01(value: Column | str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(value).cast("double")))


def truncate(text: Column | str, limit: int = 60) -> Column:
    """At most ``limit`` characters, the last one an ellipsis when cut."""
    text = _c(text)
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - 1), F.lit("…"))
    )


def queue_action_class(action_name: Column | str) -> Column:
    """What a queue action does; the first matching phrase decides."""
    action = F.lower(_c(action_name))
    return (
        F.when(action.contains("get next"), "get_next")
        .when(action.contains("add to queue"), "add")
        .when(action.contains("complete"), "complete")
        .when(action.contains("exception"), "exception")
        .otherwise("other")
    )
