"""Position, previous value and trailing counts that survive a hot key.

A plain window sends a whole key to one task.  Here the rows of a key that has too
many for that are cut into buckets along the order (a month, a day, a range of part
numbers), windows run inside a bucket, and only one small row per bucket is carried across.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procatlas.session import cut

KEY_CAP = 100_000  # rows of a key that one task may hold
SLOTS = 1 << 16  # of a key's hash, by which rows are counted before keys are


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same name, where null equals null; the columns appear once."""
    marked = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(marked[f"__r_{c}"]) for c in on])
    return left.join(marked, same, how).drop(*[f"__r_{c}" for c in on])


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Sequence[Column], out: str, cap: int = KEY_CAP
) -> DataFrame:
    """1-based position of each row within its key.

    A key of at most ``cap`` rows is numbered in one window, after one shuffle; only the rows of larger keys are cut
    into buckets, which takes three. ``bucket`` must never decrease along ``order``. Null keys and buckets count as
    values; null buckets come first.
    """
    large = _large_keys(df, keys, cap)
    whole = lambda rows: rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if large is None:
        return whole(df)
    small = whole(join_null_safe(df, large, keys, "left_anti"))
    return small.unionByName(_numbered_in_buckets(join_null_safe(df, large, keys, "left_semi"), keys, order, bucket, out))


def _large_keys(df: DataFrame, keys: Sequence[str], cap: int) -> DataFrame | None:
    """The keys of more than ``cap`` rows; none when there are no such keys.

    A large key fills the slot of its hash, so rows are counted by slot first, in a map of the same size however many keys
    there are. Only keys in slots of more than ``cap`` rows are counted themselves.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS))
    over = lambda rows, by: cut(rows.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > cap).drop("__n"))
    full = over(df.withColumn("__slot", slot), ["__slot"])
    if full.isEmpty():
        return None
    large = over(df.withColumn("__slot", slot).join(full, "__slot", "left_semi"), keys)
    return None if large.isEmpty() else large


def _numbered_in_buckets(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Sequence[Column], out: str) -> DataFrame:
    names = [f"__b{i}" for i in range(len(bucket))]
    placed = df.withColumns(dict(zip(names, bucket)))
    counts = placed.groupBy(*keys, *names).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, *names, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    return (
        join_null_safe(placed.withColumn("__rn", F.row_number().over(inside)), offsets, [*keys, *names])
        .withColumn(out, (F.col("__off") + F.col("__rn")).cast("int"))
        .drop("__rn", "__off", *names)
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, out: str
) -> DataFrame:
    """The value of the row before, per key; null on the first row of a key."""
    cut = df.withColumn("__b", bucket)
    last = cut.groupBy(*keys, "__b").agg(F.max_by(F.struct(value), F.struct(*order)).alias("__last"))
    carried = last.select(
        *keys, "__b", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__b"))[value].alias("__carry")
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    placed = cut.withColumn("__rn", F.row_number().over(inside)).withColumn("__lag", F.lag(value).over(inside))
    return (
        join_null_safe(placed, carried, [*keys, "__b"])
        .withColumn(out, F.when(F.col("__rn") == 1, F.col("__carry")).otherwise(F.col("__lag")))
        .drop("__b", "__rn", "__lag", "__carry")
    )


def trailing_count(df: DataFrame, keys: Sequence[str], at: str, seconds: int, out: str) -> DataFrame:
    """Rows of the same key in the ``seconds`` up to and including each row.

    A row is seen from its own bucket of that length and from the next one, so a
    task holds two buckets of a key and never the key's whole history.
    """
    span = seconds * 1_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    cut = df.withColumn("__t", micros).withColumn("__b", F.floor(micros / span))
    seen = cut.withColumn("__own", F.lit(True)).unionByName(
        cut.withColumn("__b", F.col("__b") + 1).withColumn("__own", F.lit(False))
    )
    trailing = Window.partitionBy(*keys, "__b").orderBy("__t").rangeBetween(-span, 0)
    counted = seen.withColumn(out, F.count("*").over(trailing))
    return counted.where("__own").drop("__t", "__b", "__own")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark limits each task to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")
