"""Contraction of long flows, so that a deep page takes rounds by the logarithm of its depth.

A vertex with one way out shares its fate: what it leads to is what its end, the
first vertex with another number of ways out, leads to.  Ends are found by
pointer doubling; the core that is left has only vertices with several ways out,
whose edges lead to ends.  Branches that meet again become one edge and dead ends
fall away, so that a core is often contracted again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procatlas.session import cut

#: marks move over so many jump tables before they are checkpointed
JUMPS_KEPT = 4


@dataclass(frozen=True)
class Contracted:
    """``jumps[k]`` leads 2^k steps on, or to the end where that is nearer: keys, node, to, live, moved, least."""

    keys: tuple[str, ...]
    jumps: tuple[DataFrame, ...]
    branch: DataFrame  # keys, src, dst: edges of vertices with several ways out
    core: DataFrame  # the same edges leading to ends; dead ends left out, src = dst where a vertex leads back to itself

    @property
    def ends(self) -> DataFrame:
        return self.jumps[-1].where("not live").select(*self.keys, "node", "to")

    @property
    def rings(self) -> DataFrame:
        """Vertices of closed chains without a branch, with the least vertex of theirs."""
        live = self.jumps[-1].where("live")
        inside = live.select(*self.keys, F.col("to").alias("node")).distinct()
        return live.join(inside, [*self.keys, "node"], "left_semi").select(*self.keys, "node", F.col("least").alias("head"))


def contract(edges: DataFrame, keys: Sequence[str]) -> Contracted:
    """Contract distinct edges (keys, src, dst) with src <> dst."""
    keys = list(keys)
    out = cut(edges.groupBy(*keys, "src").agg(F.count("*").alias("ways"), F.min("dst").alias("to")))
    single = out.where("ways = 1").select(*keys, F.col("src").alias("node"), "to")
    ahead = single.select(*keys, F.col("node").alias("to"), F.lit(True).alias("live"))
    jump = cut(single.join(ahead, [*keys, "to"], "left").select(
        *keys, "node", "to", F.coalesce("live", F.lit(False)).alias("live"), F.lit(True).alias("moved"), F.col("node").alias("least"),
    ))
    longest = single.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    jumps, reach = [jump], 1
    while reach < longest and not jump.where("live").isEmpty():
        near = jump.where("live").select(*keys, "node", F.col("to").alias("over"), F.col("least").alias("here"))
        far = jump.select(*keys, F.col("node").alias("over"), "to", "live", F.col("least").alias("there"))
        on = near.join(far, [*keys, "over"]).select(*keys, "node", "to", "live", F.lit(True).alias("moved"), F.least("here", "there").alias("least"))
        jump = cut(on.unionByName(jump.where("not live").withColumn("moved", F.lit(False))))
        jumps.append(jump)
        reach *= 2
    several = out.where("ways > 1").select(*keys, "src")
    branch = cut(edges.join(several, [*keys, "src"], "left_semi").select(*keys, "src", "dst"))
    ends = jump.where("not live").select(*keys, F.col("node").alias("dst"), F.col("to").alias("end"))
    core = branch.join(ends, [*keys, "dst"], "left").select(*keys, "src", F.coalesce("end", "dst").alias("dst")).distinct()
    core = core.join(several.withColumnRenamed("src", "dst"), [*keys, "dst"], "left_semi")
    return Contracted(tuple(keys), tuple(jumps), branch, cut(core.select(*keys, "src", "dst")))


def along(contracted: Contracted, marks: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Marks (keys, extra, node) and all that lies behind them on their chains, ends included."""
    columns = [*contracted.keys, *extra]
    for i, jump in enumerate(reversed(contracted.jumps)):
        hop = jump.where("moved").select(*contracted.keys, "node", "to")
        both = marks.join(hop, [*contracted.keys, "node"], "left").select(*columns, F.explode(F.array_compact(F.array("node", "to"))).alias("node"))
        marks = both.distinct()
        if (i + 1) % JUMPS_KEPT == 0:
            marks = cut(marks)
    return cut(marks)
