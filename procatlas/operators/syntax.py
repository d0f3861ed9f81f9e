"""What expressions are made of: calls, operators and references as rows, and where their syntax breaks.

Spark cuts an expression into tokens; a batch of token lists is then read at once by array arithmetic. An infix language
needs no tree for this: whether a token is in its place follows from its neighbours, which bracket holds it from a running
depth, and which operator of a bracket is applied last from ranks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.functions.expressions import FUNCTION_NAMES
from procatlas.model import OWNER, STAGE

# The operators, the loosest first; those of a line bind alike.
RANKS = (("OR",), ("AND",), ("NOT",), ("=", "<>", "<", ">", "<=", ">="), ("&",), ("+", "-"), ("*", "/"), ("^",), ("unary -",))
RANK = {op: rank for rank, ops in enumerate(RANKS) for op in ops}
SYMBOLS = [op for op in RANK if not op[0].isalpha()]
BLANK = r"[\t-\r\x{85}\p{Z}]"
TOKEN = "(?s)" + "|".join((BLANK + "++", r'"[^"]*+"?+', r"\[[^\]]*+\]?+", r"[0-9]*\.?[0-9]+", "[A-Za-z_][A-Za-z0-9_]*+", "<>|<=|>=", "."))
PARTS = "array<struct<place:int,depth:int,part:string,text:string,args:int,last:boolean>>"


def _before(values: np.ndarray, first: np.ndarray, none) -> np.ndarray:
    """Of each token the value of the one before it in its expression."""
    return np.where(first, none, np.roll(values, 1))


def _within(steps: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Running sums that begin anew with every expression."""
    sums = np.cumsum(steps)
    return sums - np.repeat(sums[starts] - steps[starts], lengths)


def _parts(tokens: pa.Array) -> pa.Array:
    """The parts of every expression of a batch, in order of place; a syntax error is one part, the first."""
    rows = len(tokens)
    owner = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    text = pc.list_flatten(tokens).cast(pa.string())
    mask = lambda values: values.to_numpy(zero_copy_only=False).astype(bool)
    quoted = mask(pc.starts_with(text, '"'))
    whole_text = quoted & mask(pc.ends_with(text, '"')) & mask(pc.greater(pc.utf8_length(text), 1))
    # a doubled quote goes on with the text before it
    goes_on = quoted & np.r_[False, quoted[:-1] & (owner[1:] == owner[:-1])] if len(owner) else quoted
    stay = ~mask(pc.match_substring_regex(text, "^" + BLANK)) & ~(goes_on & whole_text)
    owner, text, quoted, whole_text = owner[stay], text.filter(pa.array(stay)), quoted[stay], whole_text[stay]
    present, starts, lengths = np.unique(owner, return_index=True, return_counts=True)
    first = np.zeros(len(owner), bool)
    first[starts] = True
    final = np.roll(first, -1)

    is_one = lambda *values: mask(pc.is_in(text, value_set=pa.array(values, pa.string())))
    upper = pc.utf8_upper(text)
    is_word = lambda *values: word & mask(pc.is_in(upper, value_set=pa.array(values, pa.string())))
    word = mask(pc.match_substring_regex(text, "^[A-Za-z_]"))
    number = mask(pc.match_substring_regex(text, r"^\.?[0-9]"))
    reference = mask(pc.starts_with(text, "["))
    whole_reference = reference & mask(pc.ends_with(text, "]"))
    opens, closes, comma, symbol, minus = is_one("("), is_one(")"), is_one(","), is_one(*SYMBOLS), is_one("-")
    ends = quoted | number | reference | closes | is_word("TRUE", "FALSE")  # an operand ends here
    wanted = ~_before(ends, first, False)  # an operand must begin here
    opened = np.where(final, False, np.roll(opens, -1))  # a bracket follows
    free = first | _before(opens | comma | is_word("AND", "OR", "NOT"), first, True)
    negates = is_word("NOT") & wanted & free
    joins = is_word("AND", "OR") & ~wanted
    call = word & wanted & opened & ~negates & ~is_word("TRUE", "FALSE")
    unary = minus & wanted

    depth = _within(opens.astype(int) - closes, starts, lengths) if len(owner) else np.zeros(0, int)
    level = depth + closes
    by_level = np.lexsort((np.arange(len(owner)), level, owner))
    sorted_owner, sorted_level = owner[by_level], level[by_level]
    head = opens[by_level] | np.r_[True, (sorted_owner[1:] != sorted_owner[:-1]) | (sorted_level[1:] != sorted_level[:-1])][: len(owner)]
    bracket, argument = np.empty(len(owner), int), np.empty(len(owner), int)
    bracket[by_level], argument[by_level] = np.cumsum(head) - 1, np.cumsum(head | comma[by_level]) - 1
    commas = np.bincount(bracket, comma, int(head.sum())).astype(int)
    opener = opens & _before(call, first, False)  # of a call
    of_call = np.bincount(bracket, opener, int(head.sum())) > 0
    empty = closes & _before(opener, first, False)
    inside = np.where(final, 0, np.roll(bracket, -1))
    arguments = np.where(np.roll(empty, -2), 0, commas[inside] + 1)  # an empty pair stands right behind its call

    # the first rule that a token breaks
    rules = (
        (quoted & ~whole_text, "unclosed text", 0),
        (reference & ~whole_reference, "unclosed reference", 0),
        (~(quoted | reference | number | word | opens | closes | comma | symbol), "unknown character", 0),
        (wanted & (comma | closes & ~empty | symbol & ~minus), "operand missing", 1),
        (~wanted & (quoted | number | reference | opens | word & ~joins), "operator missing", 1),
        (wanted & word & ~call & ~negates & ~is_word("TRUE", "FALSE"), "name without call", 1),
        (closes & (depth < 0), "unopened bracket", 1),
        (comma & ~of_call[bracket], "stray comma", 1),
    )
    broken = np.zeros(len(owner), int)
    for number_of_rule, (hit, _, _) in enumerate(rules, 1):
        broken = np.where((broken == 0) & hit, number_of_rule, broken)
    order = np.array([2, *(late for _, _, late in rules)])[broken]
    place = np.arange(len(owner)) - np.repeat(starts, lengths) + 1
    at = np.flatnonzero(broken)
    at = at[np.lexsort((place[at], order[at], owner[at]))]
    at = at[np.unique(owner[at], return_index=True)[1]]
    last = starts + lengths - 1
    unended = np.where(~ends[last], "operand missing", np.where(depth[last] > 0, "unclosed bracket", ""))
    late = ~np.isin(present, owner[at]) & (unended != "")
    blank = np.setdiff1d(np.flatnonzero(mask(pc.is_valid(tokens))), present)

    # the operator applied last within its argument: the loosest; of equals the last, but for prefixes and powers the first
    operator = negates | joins | symbol
    names = np.asarray(upper.to_numpy(zero_copy_only=False), object)
    ops = np.flatnonzero(operator)
    shown = np.where(unary[ops], "unary -", names[ops]) if len(ops) else np.empty(0, object)
    rank = np.array([RANK[op] for op in shown], int)
    forward = np.isin(rank, [RANK["NOT"], RANK["^"], RANK["unary -"]])
    by_rank = np.lexsort((np.where(forward, place[ops], -place[ops]), rank, argument[ops]))
    applied = np.zeros(len(ops), bool)
    applied[by_rank[np.unique(argument[ops][by_rank], return_index=True)[1]]] = True

    plain = np.asarray(text.to_numpy(zero_copy_only=False), object)
    calls, refs = np.flatnonzero(call), np.flatnonzero(whole_reference)
    columns = [  # owner, place, depth, part, text, args, last
        (owner[calls], place[calls], depth[calls], "call", plain[calls], arguments[calls], False),
        (owner[ops], place[ops], depth[ops], "operator", np.where(unary[ops], "-", names[ops]), np.where(unary[ops] | negates[ops], 1, 2), applied),
        (owner[refs], place[refs], depth[refs], "reference", np.array([t[1:-1].strip() for t in plain[refs]], object), 0, False),
        (owner[at], place[at], depth[at], "error", np.array([rules[b - 1][1] for b in broken[at]], object), 0, False),
        (present[late], lengths[late] + 1, depth[last][late], "error", unended[late].astype(object), 0, False),
        (blank, 1, 0, "error", "empty", 0, False),
    ]
    sizes = [len(c[0]) for c in columns]
    stacked = [np.concatenate([np.broadcast_to(np.asarray(c[i], kind), size) for c, size in zip(columns, sizes)])
               for i, kind in enumerate((np.int64, np.int32, np.int32, object, object, np.int32, bool))]
    turn = np.lexsort((stacked[1], stacked[0]))
    types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_())
    fields = [pa.array(values[turn], kind) for values, kind in zip(stacked[1:], types)]
    offsets = np.r_[0, np.cumsum(np.bincount(stacked[0], minlength=rows))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["place", "depth", "part", "text", "args", "last"]))


def parts(raw: Column) -> Column:
    """The parts of an expression: ``place`` counts tokens from 1, ``depth`` the brackets around it.

    ``part`` is call, operator, reference or error. Of a call ``args`` is the number of arguments, of an operator that of its
    operands, and ``last`` says whether it is the one applied last in its bracket or argument. An expression has at most one
    error: characters that make no token first, then the first token out of place; its other parts are given all the same.
    An empty expression has the error "empty"; a null one has no parts.
    """
    read = F.arrow_udf(_parts, PARTS)
    return F.when(raw.isNotNull(), read(F.regexp_extract_all(raw, F.lit(TOKEN), F.lit(0))))


def expression_parts(expressions: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per part of the expressions in column ``raw``, all columns kept."""
    return expressions.withColumn("__part", F.explode(parts(F.col(raw)))).select(*expressions.columns, "__part.*")


def expressions_of(stages: DataFrame) -> DataFrame:
    """One row per expression of a stage, with its place among them."""
    return stages.select(*STAGE, F.posexplode("exprs").alias("expr_pos", "__expr")).select(*STAGE, "expr_pos", F.col("__expr.raw").alias("raw"))


def expression_issues(stages: DataFrame, items: DataFrame) -> DataFrame:
    """What keeps an expression from being carried over: its syntax, a function without counterpart, an item its owner lacks."""
    found = expression_parts(expressions_of(stages))
    base = F.trim(F.substring_index("text", ".", 1))
    named = found.withColumn("name", F.when(F.col("part") == "reference", base).otherwise(F.col("text")))
    known = items.select(*OWNER, "name", F.lit("reference").alias("part")).distinct().withColumn("known", F.lit(True))
    issue = (
        F.when(F.col("part") == "error", "syntax")
        .when((F.col("part") == "call") & ~F.lower("text").isin(*FUNCTION_NAMES), "unknown-function")
        .when((F.col("part") == "reference") & F.col("known").isNull(), "unknown-reference")
    )
    rows = named.join(known, [*OWNER, "part", "name"], "left").withColumn("issue", issue).where(F.col("issue").isNotNull())
    return rows.select(*STAGE, "expr_pos", "raw", "place", "issue", F.col("name").alias("detail"))
