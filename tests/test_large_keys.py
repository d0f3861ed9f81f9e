"""Large keys are found without a count of every key."""

import pytest
from procatlas.operators import windows
from pyspark.sql import functions as F


def numbered(df, cap):
    return sorted(map(tuple, windows.numbered(df, ["a", "b"], ["v"], [F.floor(F.col("v") / 10)], "at", cap).select("a", "b", "v", "at").collect()), key=str)


@pytest.mark.parametrize("slots", [1, 3, 1 << 16])
def test_positions(spark, monkeypatch, slots):
    monkeypatch.setattr(windows, "SLOTS", slots)
    keys = {(None, "x"): 40, (1, None): 25, (None, None): 30, (2, "y"): 20, **{(k, "z"): 3 for k in range(5, 25)}}
    rows = [(a, b, v) for (a, b), n in keys.items() for v in range(n)]
    df = spark.createDataFrame(rows, "a int, b string, v int").repartition(4)
    expected = sorted(((a, b, v, v + 1) for a, b, v in rows), key=str)
    for cap in (2, 20, 100):
        assert numbered(df, cap) == expected
    large = windows._large_keys(df, ["a", "b"], 20)
    assert sorted(map(tuple, large.collect()), key=str) == sorted((k for k, n in keys.items() if n > 20), key=str)


def test_keys_are_not_counted_when_none_is_large(spark, monkeypatch):
    made, cut = [], windows.cut
    monkeypatch.setattr(windows, "cut", lambda df: made.append(df.columns) or cut(df))
    windows.numbered(spark.range(1000).selectExpr("id DIV 3 AS k", "id AS v"), ["k"], ["v"], [F.col("v")], "at").count()
    assert made == [["__slot"]]
