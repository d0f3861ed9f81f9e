"""Mixing sources to target weights by fitting each source's budget with whole documents.

Documents are counted by (source, exact length); this histogram is all that a source's plan needs. Whole passes over
a source come first, then an equal share of every length, then a bounded knapsack over the lengths that are left fits
the rest of the budget. The plan says how many documents of a length are taken beyond the passes; all alike as far as that
goes, then those with the smallest seeded hashes once more. Documents of one length are ranked in hash ranges of a few thousand, so that a length with
a third of all rows is ranked by many tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procatlas.llm.store import stored
from procatlas.llm.tokens import word_count

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
RANGE_ROWS = 4096


def fit(sizes: list[int], counts: list[int], budget: int, most: int = 1, dp_budget: int = 1 << 16) -> list[int]:
    """How many of each size to take, at most ``most`` times ``counts``, so that their sum comes nearest to ``budget``.

    First the floor of every size's share, then large sizes until at most ``dp_budget`` is left, then an exact bounded
    knapsack over reachable sums, kept as bits of an integer, which ends as soon as the rest of the budget is reached. It
    may end above the budget, by less than ``dp_budget``, where that is nearer.
    """
    total = sum(s * c for s, c in zip(sizes, counts))
    if budget >= most * total:
        return [most * c for c in counts]
    if budget <= 0:
        return [0] * len(sizes)
    take = [min(most * c, c * budget // total) for c in counts]
    rest = budget - sum(s * t for s, t in zip(sizes, take))
    order = sorted((i for i in range(len(sizes)) if sizes[i] > 0), key=lambda i: -sizes[i])
    for i in order:
        if rest <= dp_budget:
            break
        more = min(most * counts[i] - take[i], rest // sizes[i], -(-(rest - dp_budget) // sizes[i]))
        take[i] += more
        rest -= more * sizes[i]
    top = rest + dp_budget
    reach, mask, steps = 1, (1 << (top + 1)) - 1, []
    for i in order:
        left, chunk = min(most * counts[i] - take[i], top // sizes[i]), 1
        while left > 0 and not reach >> rest & 1:
            many = min(chunk, left)
            steps.append((i, many, reach))
            reach |= (reach << many * sizes[i]) & mask
            left, chunk = left - many, chunk * 2
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    goal = below
    if below < rest and above:
        over = rest + (above & -above).bit_length()
        goal = over if over - rest < rest - below else below
    for i, many, before in reversed(steps):
        if not before >> goal & 1:
            take[i] += many
            goal -= many * sizes[i]
    return take


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_PASSES) -> DataFrame:
    """One row per source: ``source, source_size, target``; ``sized`` has ``source, size``.

    Sources in the order of their code points, null last, have the weights in turn. They share ``share`` of all sizes;
    no target exceeds ``most`` times the source's size, and what that leaves over is shared again by weight. With the
    sources in the order of that bound per weight, those that reach it come first, and sums along the order give the level
    of the rest. The windows here run over one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    caps = sources.withColumn("place", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    levels = caps.select(
        "*",
        (F.sum("source_size").over(Window.partitionBy()) * share).alias("all"),
        F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("caps_before"),
        F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("weights_left"),
    ).withColumn("level", (F.col("all") - F.col("caps_before")) / F.col("weights_left"))
    capped = F.col("cap") <= F.col("weight") * F.col("level")
    level = F.max(F.when(~capped, F.col("level"))).over(Window.partitionBy())
    return levels.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def _plan(histogram: DataFrame, most: int) -> DataFrame:
    def fit_source(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        passes = int(target // size) if size else 0
        extra = fit([int(s) for s in rows["size"]], [int(c) for c in rows["n"]], round(target) - passes * size, max(1, most - passes))
        extra = extra if passes < most else [0] * len(rows)
        return rows.assign(passes=passes, extra=extra)[["key", "size", "n", "source_size", "target", "passes", "extra"]]

    return histogram.groupBy("key").applyInPandas(fit_source, "key string, size long, n long, source_size long, target double, passes int, extra long")


def _text_key(value: Column) -> Column:
    """The value as text that is never null and keeps null apart."""
    return F.coalesce(F.concat(F.lit("s"), value.cast("string")), F.lit(""))


def _draw(seed: int, text: str, doc_id: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(doc_id), F.when(F.col(doc_id).isNull(), F.xxhash64(F.col(text))))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_PASSES, seed: int = 17,
        text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, source_key, size, source_size, target, times, taken``.

    ``source_key`` is the source after an ``s``, or empty if it is null. ``size`` is the number of words, ``times`` how often the mix takes the document (at most ``most``), ``taken`` the
    words that makes. A null source is a source of its own. Null, empty and blank texts have no words; they are taken as
    often as the whole passes of their source, which takes no words. Rows that repeat an id are told apart by a hash of
    their text; where that agrees too, which of them is taken doesn't matter. The same rows give the same mix, whatever
    their order or partitions. Other columns are ignored, and an empty table gives an empty mix.
    """
    hashed = _draw(seed, text, doc_id)
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), hashed.alias("draw")
    ).withColumn("key", _text_key(F.col("source")))
    slim = stored(slim, "mix-sizes")
    goals = targets(slim, weights, share, most).select(_text_key(F.col("source")).alias("key"), "source_size", "target")
    histogram = slim.groupBy("key", "size").agg(F.count("*").alias("n")).join(goals, "key")
    plan = stored(_plan(histogram, most), "mix-plan")
    planned = slim.join(plan, ["key", "size"])
    ranges = F.ceil(F.col("n") / RANGE_ROWS)
    planned = planned.withColumn("range", F.pmod(F.shiftrightunsigned("draw", 16), ranges).cast("long"))
    counts = planned.groupBy("key", "size", "range").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("key", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("key", "size", "range", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "range").orderBy("draw", "doc_id"))
    ranked = planned.withColumn("rank", rank).join(starts, ["key", "size", "range"])
    again = (F.col("before") + F.col("rank") <= F.col("extra") % F.col("n")).cast("int")
    times = (F.col("passes") + F.floor(F.col("extra") / F.col("n")) + again).cast("int")
    return ranked.select("doc_id", F.col("key").alias("source_key"), "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def repeat_mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_PASSES, seed: int = 17,
                 text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The rows of the mix with all their columns, each as often as it is taken.

    Rows that agree in id, source and number of words are numbered, and the mix's decisions on them are dealt in turn.
    """
    shares = mix(docs, weights, share, most, seed, text, source, doc_id).filter("times > 0")
    keys = ["id_key", "source_key", "size"]
    shares = shares.withColumn("id_key", _text_key(F.col("doc_id")))
    shares = shares.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("times"))).alias("turn"), "times")
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    row = row.select("row", _text_key(F.col("row")[doc_id]).alias("id_key"), _text_key(F.col("row")[source]).alias("source_key"), word_count(F.col("row")[text]).alias("size"))
    row = row.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("row")[text])))
    taken = row.join(shares, [*keys, "turn"])
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
