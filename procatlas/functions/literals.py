"""Hide string literals of code behind numbered placeholders, and bring them back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A double-quoted literal (backslash escapes or doubled quotes) or a
# single-quoted one.  The runs are possessive so that long literals need no deep stack.
LITERAL = r""""(?:[^"\\]++|\\.|"")*"|'(?:[^'\\]++|\\.)*'"""
KEPT_LENGTH = 4
MARK = "\uffff\ufffe"


def literals(code: Column | str) -> Column:
    """Every literal of the code, quotes included, in order."""
    return F.regexp_extract_all(code, F.lit(LITERAL), F.lit(0))


def long_literals(code: Column | str) -> Column:
    """The literals that carry data; ``redact_literals`` numbers them from 1 in this order."""
    return F.filter(literals(code), lambda m: F.length(m) > KEPT_LENGTH)


def redact_literals(code: Column | str) -> Column:
    """Code with each long literal replaced by ``"__LIT_n__"``; repeats get their own number.

    Long literals first become a mark made of two code points that text never
    holds; the pieces between the marks are then numbered.  Every step is one pass.
    """
    code = F.col(code) if isinstance(code, str) else code
    shown = F.transform(literals(code), lambda m: F.when(F.length(m) > KEPT_LENGTH, MARK).otherwise(m))
    pieces = F.arrays_zip(F.split(code, LITERAL, -1).alias("gap"), shown.alias("lit"))
    marked = F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], F.coalesce(p["lit"], F.lit("")))), "")
    kept = F.split(marked, MARK, -1)
    numbered = F.arrays_zip(kept.alias("text"), F.sequence(F.lit(0), F.size(kept) - 1).alias("n"))
    return F.array_join(
        F.transform(
            numbered,
            lambda p: F.when(p["n"] == 0, p["text"]).otherwise(F.concat(F.lit('"__LIT_'), p["n"].cast("string"), F.lit('__"'), p["text"])),
        ),
        "",
    )


def restore_literals(text: Column | str, originals: Column | str) -> Column:
    """Put literal n back for placeholder n, written with or without its quotes.

    The text is cut at the placeholders once, so an original that happens to
    contain another placeholder's text is not rewritten in turn.
    """
    text = F.col(text) if isinstance(text, str) else text
    originals = F.col(originals) if isinstance(originals, str) else originals
    marker = r'"__LIT_(\d+)__"|__LIT_(\d+)__'
    marks = F.regexp_extract_all(text, F.lit(marker), F.lit(0))
    between = F.split(text, marker, -1)
    filled = F.transform(
        marks,
        lambda m: F.coalesce(F.try_element_at(originals, F.regexp_extract(m, r"(\d+)", 1).cast("int")), m),
    )
    return F.array_join(
        F.transform(F.arrays_zip(between.alias("gap"), filled.alias("lit")), lambda p: F.concat(p["gap"], F.coalesce(p["lit"], F.lit("")))),
        "",
    )


def surviving_literals(payload: Column | str, originals: Column | str) -> Column:
    """Contents of more than two characters that still occur in the payload."""
    payload = F.col(payload) if isinstance(payload, str) else payload
    inner = F.transform(originals, lambda o: o.substr(F.lit(2), F.length(o) - 2))
    return F.filter(inner, lambda v: (F.length(v) > 2) & F.contains(payload, v))
