import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from procatlas.functions import expressions, literals, ranks
from procatlas.functions import text as t
from procatlas.operators import guards, naming, windows


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("value,text", [(0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (10240, "10 KB"), (52428800, "50 MB"), (204800, "200 KB"), (5 * 1024**4, "5120 GB")])
def test_format_bytes(spark, value, text):
    assert one(spark, t.format_bytes("v"), v=value) == text


@pytest.mark.parametrize("raw,want", [('"abc"', "abc"), ('  "a b"\n', "a b"), ('"a" & "b"', None), ("abc", None), ('""', "")])
def test_whole_literal(spark, raw, want):
    assert one(spark, t.whole_literal("r"), r=raw) == want


@pytest.mark.parametrize("score,grade", [(100, "A"), (90, "A"), (89, "B"), (70, "C"), (60, "D"), (59, "E"), (50, "E"), (49, "F"), (0, "F")])
def test_grades(spark, score, grade):
    assert one(spark, ranks.grade_for_score(F.lit(score))) == grade


def test_grade_e_ranks_between_d_and_f_unless_compat(spark):
    assert one(spark, ranks.grade_rank(F.lit("E"))) == 4
    assert one(spark, ranks.grade_rank(F.lit("E"), compat=True)) == -1


LITERAL = re.compile(r'"(?:[^"\\]|\\.|"")*"|\'(?:[^\'\\]|\\.)*\'')


def plain_redact(code):
    found = []

    def swap(m):
        if len(m.group()) <= 4:
            return m.group()
        found.append(m.group())
        return f'"__LIT_{len(found)}__"'

    return LITERAL.sub(swap, code), found


def test_redaction_matches_a_plain_loop(spark):
    rnd = random.Random(5)
    alphabet = ['"', "'", "\\", "a", "b", " ", '""', "secret", "\n", "x"]
    codes = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, code string")
    done = df.select("i", "code", literals.redact_literals("code").alias("r"), literals.long_literals("code").alias("l"))
    rows = done.select("*", literals.restore_literals("r", "l").alias("back"), literals.surviving_literals("r", "l").alias("s")).collect()
    for row in rows:
        redacted, found = plain_redact(row.code)
        assert (row.r, row.l) == (redacted, found)
        assert row.back == row.code
        assert row.s == [f[1:-1] for f in found if len(f) > 4 and f[1:-1] in redacted]


def plain_names(bases):
    used, out = set(), []
    for base in bases:
        name, k = base, 2
        while name in used:
            name, k = f"{base}_{k}", k + 1
        used.add(name)
        out.append(name)
    return out


def test_unique_names_match_one_after_another(spark):
    rnd = random.Random(3)
    scopes = {s: [rnd.choice(["A", "A_2", "A_3", "B", "A_2_2"]) for _ in range(20)] for s in "xyz"}
    rows = [(s, i, b) for s, bases in scopes.items() for i, b in enumerate(bases)]
    df = spark.createDataFrame(rows, "scope string, pos int, base string")
    got = naming.unique_names(df, ["scope"], "base", "pos", [F.floor(F.col("pos") / 4)]).collect()
    for s, bases in scopes.items():
        assert [r.identifier for r in sorted(got, key=lambda r: r.pos) if r.scope == s] == plain_names(bases)


def test_windows_match_plain_windows(spark):
    rnd = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice("aab"), start + dt.timedelta(minutes=rnd.randint(0, 900)), rnd.choice("pqr")) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, k string, at timestamp, v string")
    hour = F.date_trunc("hour", "at")
    placed = {r.i: r.pos for r in windows.numbered(df, ["k"], ["at", "i"], [hour], "pos").collect()}
    previous = {r.i: r.before for r in windows.with_previous(df, ["k"], ["at", "i"], hour, "v", "before").collect()}
    trailing = {r.i: r.n for r in windows.trailing_count(df, ["k"], "at", 3600, "n").collect()}
    for key in "ab":
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        for pos, r in enumerate(mine):
            assert placed[r[0]] == pos + 1
            assert previous[r[0]] == (mine[pos - 1][3] if pos else None)
            assert trailing[r[0]] == sum(1 for o in mine if r[2] - dt.timedelta(hours=1) <= o[2] <= r[2])


def test_leaks_match_plain_containment(spark):
    rnd = random.Random(11)
    words = ["alpha", "Beta", "gamma", "öl", "x", "delta"]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(12))) for i in range(40)]
    values = ["ALPHA beta gamma", "mma öl de", "amma", "ta gam", "delta delta", "nothing here at all", "eta x alpha x"]
    t_df = spark.createDataFrame(texts, "text_id int, text string")
    v_df = spark.createDataFrame([(v,) for v in values], "value string")
    got = {(r.text_id, r.value) for r in guards.leaked_values(t_df, v_df, keys=[]).collect()}
    assert got == {(i, v) for i, x in texts for v in values if v.lower() in x.lower()}


@pytest.mark.parametrize("value_chars,text_chars", [(1_000_000, 4_000_000), (5, 40)])
def test_many_values_in_slices(spark, value_chars, text_chars):
    """Keys, nulls, values in other case or within others, repeated rows, empty and long texts; many slices and salts too."""
    from procatlas.operators.search import contained

    rnd = random.Random(3)
    pick = lambda n: "".join(rnd.choice("abé😀 ") for _ in range(n))
    texts = [(rnd.choice(["r", "s", None]), i, pick(rnd.randint(0, 30))) for i in range(60)]
    texts += [("r", 60, None), ("r", 61, ""), ("s", None, "abab"), ("s", None, "abab"), ("r", 62, pick(20_000)), ("lone", 63, "ab")]
    values = [(rnd.choice(["r", "s", None, "none"]), v, v.lower()) for v in {pick(rnd.randint(1, 4)).replace("a", rnd.choice("aA")) for _ in range(40)}]
    values += [("s", "ab", "ab"), ("s", "AB", "ab"), ("s", "ab", "ab"), ("s", "bab", "bab"), ("r", None, "a"), ("r", "", ""), ("r", "a", None)]
    t_df = spark.createDataFrame(texts, "k string, text_id long, body string")
    v_df = spark.createDataFrame(values, "k string, value string, body string")
    got = sorted((r.k, str(r.text_id), r.value) for r in contained(t_df, v_df, ["k"], value_chars, text_chars).collect())
    known = {v for v in values if all(v)}
    assert got == sorted((k, str(i), v) for k, i, x in texts for kv, v, n in known if k == kv and x is not None and n in x)
    assert contained(t_df, v_df.where("false"), ["k"]).count() == contained(t_df.where("false"), v_df, []).count() == 0


@pytest.mark.parametrize("interval,want", [("d", 31), ("h", 756), ("m", 1), ("yyyy", 1), ("q", 1), ("n", 45360), ("w", 4), ("ww", 5)])
def test_date_diff(spark, interval, want):
    a, b = F.lit("2023-12-15 00:00:00").cast("timestamp"), F.lit("2024-01-15 12:00:00").cast("timestamp")
    # 31.5 days round to the even 32
    assert one(spark, expressions.date_diff(interval, a, b)) == (32 if interval == "d" else want)


@pytest.mark.parametrize("interval,want", [("d", "2024-02-01 10:00:00"), ("m", "2024-02-29 10:00:00"), ("yyyy", "2025-01-31 10:00:00"), ("h", "2024-01-31 11:00:00"), ("ww", "2024-02-07 10:00:00"), ("q", "2024-04-30 10:00:00")])
def test_date_add(spark, interval, want):
    moved = expressions.date_add(interval, F.lit(1), F.lit("2024-01-31 10:00:00").cast("timestamp"))
    assert one(spark, F.date_format(moved, "yyyy-MM-dd HH:mm:ss")) == want


@pytest.mark.parametrize("name,args,want", [
    ("len", ["abc"], 3), ("mid", ["abcdef", 2, 3], "bcd"), ("left", ["abc", 2], "ab"), ("right", ["abc", 2], "bc"), ("replace", ["aba", "a", "x"], "xbx"),
    ("isnumber", ["1.5"], True), ("isnumber", ["x"], False), ("startswith", ["abc", "ab"], True), ("round", [2.5], 2.0), ("round", [3.5], 4.0),
    ("rndup", [1.2], 2), ("rnddn", [1.8], 1), ("tonumber", ["12"], 12.0), ("chr", [65], "A"), ("asc", ["A"], 65), ("trim", ["\t a "], "a"), ("abs", [-2], 2), ("instr", ["abc", "c"], 3),
])
def test_expression_functions(spark, name, args, want):
    assert one(spark, expressions.FUNCTIONS[name](*[F.lit(a) if not (name in ("mid", "left", "right") and isinstance(a, int)) else F.lit(a) for a in args])) == want


def test_positions_keep_rows_with_null_keys_and_buckets(spark):
    rows = [(1, None, 5, "a"), (2, None, None, "b"), (3, "k", None, "c"), (4, "k", 9, "d"), (5, None, 7, "e")]
    df = spark.createDataFrame(rows, "i int, k string, at int, v string")
    placed = windows.numbered(df, ["k"], ["at", "i"], [F.col("at")], "pos").collect()
    assert {r.i: r.pos for r in placed} == {1: 2, 2: 1, 3: 1, 4: 2, 5: 3}
    previous = windows.with_previous(df, ["k"], ["at", "i"], F.col("at"), "v", "before").collect()
    assert {r.i: r.before for r in previous} == {1: "b", 2: None, 3: None, 4: "c", 5: "a"}


def test_unique_names_end_on_equal_positions_and_null_scopes(spark):
    rows = [(None, "A", 1), (None, "A", 1), (None, "A", 1), (None, "A_2", 1), ("s", "A", 0), ("s", "A_2", 0), ("s", "A", 0)]
    df = spark.createDataFrame(rows, "scope string, base string, pos int")
    got = naming.unique_names(df, ["scope"], "base", "pos", [F.lit(0)]).collect()
    assert sorted((r.scope or "", r.identifier) for r in got) == sorted([*(("", n) for n in ("A", "A_2", "A_3", "A_2_2")), ("s", "A"), ("s", "A_2"), ("s", "A_2_2")])


def test_an_export_may_begin_with_long_comments_and_be_of_any_size(spark):
    from procatlas.sources import files

    lead = "<?xml version='1.0'?><!-- " + "x <process> " * 2000 + "-->"
    rows = [("a.xml", lead + "<bpr:release/>"), ("b.xml", lead + "<other><process/></other>"), ("c.xml", "<process>" + "y" * 3_000_000 + "</process>")]
    uploads = spark.createDataFrame([(f, len(c), c) for f, c in rows], "file string, size_bytes long, content string")
    assert {r.file: r.reason is None for r in files.intake_gate(uploads).collect()} == {"a.xml": True, "b.xml": False, "c.xml": True}
    assert files.intake_gate(uploads, 100).where("reason is null").count() == 0


def test_numbered_takes_one_shuffle_and_buckets_only_for_large_keys(spark):
    rows = [("hot", i % 50, i) for i in range(300)] + [(k, i % 3, 1000 + 10 * j + i) for j, k in enumerate(["a", None, "b"]) for i in range(7)]
    rows += [("a", None, 2000)]
    df = spark.createDataFrame(rows, "k string, at int, i int")
    expected = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        expected.update({r[2]: place for place, r in enumerate(mine, 1)})
    plans = {}
    for cap in (1000, 100, 2):  # no key is large, one is, all are
        placed = windows.numbered(df, ["k"], ["at", "i"], [F.col("at")], "pos", cap=cap)
        assert {r.i: r.pos for r in placed.collect()} == expected
        assert placed.schema["pos"].dataType.simpleString() == "int"
        plans[cap] = placed._jdf.queryExecution().sparkPlan().toString() + placed._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plans[1000] and "Aggregate" not in plans[1000]
    assert "Join" in plans[100]


def test_stand_in_writes_numbers_only(spark):
    """Four tables come from the numbered lines; none of them is written again."""
    import os

    from procatlas.plans import standin

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("benchmark tables are not here")
    e = standin.estate(spark, sf)
    files = {name: df.inputFiles() for name, df in e.tables().items()}
    assert not any("/estate-" in f for fs in files.values() for f in fs)
    assert all("/lines-" in f for f in files["data_items"])
    lines = spark.read.parquet(files["data_items"][0])
    assert {t for c, t in lines.dtypes if c not in ("l_returnflag", "l_linestatus")} <= {"bigint", "int", "double"}
