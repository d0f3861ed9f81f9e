"""Parts and errors of expressions against a reading by recursive descent."""

import re
import time

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from procatlas.operators import syntax

PIECES = ["[A]", "[b c]", "1", ".5", '"x"', '"a""b"', '"("', "F", "NOT", "And", "or", "TRUE", "(", ")", ",", "-", "+", "*", "^", "&", "=", "<=", "?", '"', "[", " "]


def tokens_of(raw):
    found = re.findall(r'"(?:[^"]|"")*"?|\[[^\]]*\]?|[0-9]*\.?[0-9]+|[A-Za-z_]\w*|<>|<=|>=|\S', raw)
    for t in found:
        if t[0] == '"' and t.count('"') % 2 or t[0] == "[" and t[-1] != "]" or not re.match(r'["\[\w.(),&+*/^=<>-]', t) or t == ".":
            raise SyntaxError(t)
    return found


class Reader:
    """One function per level; ``calls`` are (name, arguments, depth), ``read`` gives the operator applied last."""

    def __init__(self, raw):
        self.tokens, self.at, self.depth, self.calls = tokens_of(raw), 0, 0, []
        self.root = self.loose(0)
        if self.at < len(self.tokens):
            raise SyntaxError("rest")

    def peek(self):
        return self.tokens[self.at].upper() if self.at < len(self.tokens) else None

    def loose(self, level):
        if level == 2 and self.peek() == "NOT":
            self.at += 1
            self.loose(2)
            return "NOT"
        if level == 2:
            return self.loose(3)
        if level == 7:
            root = self.sign()
            if self.peek() == "^":
                self.at += 1
                self.loose(7)
                return "^"
            return root
        root = self.loose(level + 1)
        while self.peek() in syntax.RANKS[level]:
            root = self.peek()
            self.at += 1
            self.loose(level + 1)
        return root

    def sign(self):
        if self.peek() == "-":
            self.at += 1
            self.sign()
            return "-"
        token = self.peek()
        if token is None:
            raise SyntaxError("end")
        self.at += 1
        if token[0] in '"[' or token[0].isdigit() or token[0] == "." or token in ("TRUE", "FALSE"):
            return None
        if re.match("[A-Z_]", token) and self.peek() == "(":
            self.at += 1
            call = [self.tokens[self.at - 2], 0, self.depth]
            self.calls.append(call)
            self.depth += 1
            if self.peek() != ")":
                self.loose(0)
                call[1] = 1
                while self.peek() == ",":
                    self.at += 1
                    self.loose(0)
                    call[1] += 1
            self.close()
            return None
        if token == "(":
            self.depth += 1
            self.loose(0)
            self.close()
            return None
        raise SyntaxError(token)

    def close(self):
        if self.peek() != ")":
            raise SyntaxError("bracket")
        self.at += 1
        self.depth -= 1


def cut(raw):
    """The tokens as Spark's function cuts them."""
    blank = syntax.BLANK.replace(r"\x{85}", "\x85").replace(r"\p{Z}", " \xa0")
    return re.findall(syntax.TOKEN.replace("(?s)", "").replace(syntax.BLANK, blank), raw, re.S)


def check(raws):
    for raw, found in zip(raws, syntax._parts(pa.array([cut(r) for r in raws], pa.list_(pa.string()))).to_pylist()):
        errors = [p for p in found if p["part"] == "error"]
        assert [p["place"] for p in found] == sorted(p["place"] for p in found)
        try:
            reader = Reader(raw)
        except SyntaxError:
            assert len(errors) == 1, raw
            continue
        assert not errors, (raw, errors)
        calls = sorted((p["text"], p["args"], p["depth"]) for p in found if p["part"] == "call")
        assert calls == sorted(map(tuple, reader.calls)), raw
        roots = [p["text"] for p in found if p["part"] == "operator" and p["last"] and p["depth"] == 0]
        assert roots == ([reader.root] if reader.root else []), raw


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map(" ".join) | st.lists(st.sampled_from(PIECES), max_size=8).map("".join), max_size=5))
def test_random_pieces(raws):
    check(raws)


EXPRESSION = st.recursive(
    st.sampled_from(["[A]", "2", '"q(""),"', "TRUE"]),
    lambda inner: st.one_of(
        st.tuples(inner, st.sampled_from([" + ", "-", "*", "^", " & ", "<>", " AND ", " or "]), inner).map("".join),
        inner.map("({})".format), inner.map("-{}".format), inner.map("(NOT {})".format),
        st.lists(inner, max_size=3).map(lambda a: "Fn(" + ", ".join(a) + ")")),
    max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(EXPRESSION, min_size=1, max_size=4))
def test_random_expressions(raws):
    for raw in raws:
        Reader(raw)
    check(raws)


def test_errors_in_spark(spark):
    cases = {
        "1 + 2": None, '"a"" ( ""b"': None, "NOT NOT [x] = 2": None, "- -1 ^ -2": None, "Now()": None, "And([a], [b])": None,
        "": "empty", "  ": "empty", "1 +": "operand missing", "* 2": "operand missing", "f(1,,2)": "operand missing", "f(1,)": "operand missing", "()": "operand missing",
        "1 2": "operator missing", "[a] NOT [b]": "operator missing", "1 + NOT [a]": "name without call", "Total": "name without call",
        "(1, 2)": "stray comma", "1, 2": "stray comma", "1)": "unopened bracket", "(1": "unclosed bracket", "f(1": "unclosed bracket",
        '1 + "x': "unclosed text", '"a""': "unclosed text", "[a": "unclosed reference", "1 + + ?": "unknown character", "1 + 2": None,
    }
    rows = spark.createDataFrame([Row(raw=r, part="kept") for r in [*cases, None]], "raw string, part string")
    out = syntax.expression_parts(rows.withColumnRenamed("part", "other")).where("part = 'error'").collect()
    assert {r["raw"]: r["text"] for r in out} == {k: v for k, v in cases.items() if v}
    assert {r["other"] for r in out} == {"kept"}
    assert syntax.expression_parts(rows.drop("part").limit(0)).count() == 0


def test_long_expressions(spark):
    deep, wide, blanks = "(" * 20_000 + "1" + ")" * 20_000, "f(" + ", ".join(["[a] + 1"] * 30_000) + ")", "1" + " " * 500_000
    quotes = '"' + '""' * 100_000 + '"'
    start = time.perf_counter()
    rows = spark.createDataFrame([Row(id=i, raw=r) for i, r in enumerate((deep, wide, blanks, quotes))])
    out = syntax.expression_parts(rows)
    assert out.where("part = 'error'").count() == 0
    assert out.where("part = 'call'").collect()[0].args == 30_000
    assert time.perf_counter() - start < 60
