"""Exact top-k search by the threshold algorithm.

Vectors are sorted by the sides of a few planes they lie on and cut into blocks, so that a block holds like directions.
Within a block every dimension has its candidates in sorted order. A query walks these lists from the end that its own
component favours, scores each candidate it meets in full, and stops as soon as the score that an unmet candidate could
reach at best, the sum over the lists' current values, is below its kth result.

Each query first searches the block it lies in itself. The kth score found there goes with it: a block whose greatest
and least components cannot reach that score is not searched, and in the others the walk stops at it. The blocks'
results are merged by a window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procatlas.llm.store import stored

EXACT = float(2**52)
NO_FLOOR = -(2**63)
PLANES = 16
FOUND = "dim int, cb long, query_id long, query_key long, vec_id long, score long, lo array<long>, hi array<long>"


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` of every component as a long; null for vectors that are null or hold a null, NaN or infinity."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(whole, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


class Block:
    """Candidates of one block with their sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)

    def search(self, query_id, query: np.ndarray, k: int, floor: int = NO_FLOOR, first: int = 8) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, candidates scored) of the k best, ties to the smaller id; ``query_id`` is left out.

        With a ``floor`` only those of at least that score are looked for.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        met = self.ids == query_id
        ids, scores, scored, depth, done = np.empty(0, self.ids.dtype), np.empty(0, query.dtype), 0, min(first, n), 0
        while True:
            high, low = self.order[n - depth : n - done, up], self.order[done:depth, down]
            new = np.unique(np.concatenate([high.ravel(), low.ravel()])) if len(up) or len(down) else np.arange(n)
            new = new[~met[new]]
            if len(new):
                met[new] = True
                scored += len(new)
                ids, scores = np.concatenate([ids, self.ids[new]]), np.concatenate([scores, self.vectors[new] @ query])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            bound = query[up] @ self.sorted[n - depth, up] + query[down] @ self.sorted[depth - 1, down]
            settled = len(ids) == k and scores[-1] > bound or floor > bound
            if depth == n or not (len(up) or len(down)) or settled or met.all():
                return ids, scores, scored
            done, depth = depth, min(2 * depth, n)


def _numbers(*columns: pd.Series) -> list[np.ndarray]:
    """Vectors as matrices; as doubles where all their inner products are whole numbers that these hold."""
    found = [np.array(c.tolist(), dtype=np.int64).reshape(len(c), -1) for c in columns]
    largest = [float(np.abs(m).max(initial=0)) for m in found]
    if max((m.shape[1] for m in found), default=0) * max(largest) ** 2 < EXACT:
        found = [m.astype(np.float64) for m in found]
    return found


def _planes(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(normals, offsets) of up to 16 planes midway between vectors, drawn by hash: at most 64 vectors come to the driver."""
    drawn = rows.select("v").orderBy(F.xxhash64(F.lit(8), "v"), "v").limit(4 * PLANES).collect()
    some = list(dict.fromkeys(tuple(r["v"]) for r in drawn))
    some = np.array([v for v in some if len(v) == len(some[0])], dtype=np.float64)[: 2 * PLANES]
    one, other = some[: len(some) // 2], some[len(some) // 2 : len(some) // 2 * 2]
    return one - other, ((one**2).sum(axis=1) - (other**2).sum(axis=1)) / 2 if len(one) else np.zeros(0)


def _side(rows: DataFrame) -> Column:
    """The sides of the planes that a vector lies on, as bits."""
    normals, offsets = _planes(rows)

    @F.pandas_udf("int")
    def side(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), np.int32)
        if len(normals):
            fits = np.flatnonzero(vectors.map(len).to_numpy() == normals.shape[1])
            matrix = np.array(vectors.iloc[fits].tolist(), dtype=np.float64).reshape(len(fits), -1)
            out[fits] = (matrix @ normals.T > offsets) @ (1 << np.arange(len(offsets))[::-1]) if len(fits) else 0
        return pd.Series(out)

    return side("v")


def _cut(rows: DataFrame, along: str, size: int, out: str) -> DataFrame:
    """Even blocks of about ``size`` rows of a dimension at most, in the order of ``along``; rows that share it are dealt by hash."""
    counts = rows.groupBy("dim", along).agg(F.count("*").alias("n"))
    before = Window.partitionBy("dim").orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = F.sum("n").over(Window.partitionBy("dim"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("each", F.ceil(all_rows / F.ceil(all_rows / size)))
    at = F.col("start") + F.pmod("key", "n")
    return rows.join(starts, ["dim", along]).withColumn(out, F.floor(at / F.col("each")).cast("long")).drop("n", "start", "each")


def blocks_of(vectors: DataFrame, scale: float, vec_id: str, vector: str, block: int) -> DataFrame:
    """``vec_id, v, dim, key, cb``: the vectors that take part, once each, in blocks of like directions; written."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("v"))
    rows = rows.filter("vec_id is not null and v is not null").distinct()
    rows = stored(rows.withColumn("dim", F.size("v")).withColumn("key", F.xxhash64("vec_id", "v")), "top-k-vectors")
    sided = stored(rows.withColumn("side", _side(rows)), "top-k-sides")
    return stored(_cut(sided, "side", block, "cb").drop("side"), "top-k-blocks")


def at_home(rows: DataFrame, k: int, every: int) -> DataFrame:
    """What each query finds in its own block, and a row per block with the least and greatest of every component; written."""

    def search(found: pd.DataFrame) -> pd.DataFrame:
        ids, (v,) = found["vec_id"].to_numpy(), _numbers(found["v"])
        dim, cb = found["dim"].iloc[0], found["cb"].iloc[0]
        span = {"lo": [v.min(axis=0).astype(np.int64)], "hi": [v.max(axis=0).astype(np.int64)]}
        held, out = Block(ids, v), [pd.DataFrame({"query_id": [None], "query_key": [None], "vec_id": [None], "score": [None], **span}, dtype=object)]
        for at in np.flatnonzero(ids % every == 0):
            near, scores, _ = held.search(ids[at], v[at], k)
            out.append(pd.DataFrame({"query_id": ids[at], "query_key": found["key"].iloc[at], "vec_id": near, "score": scores.astype(np.int64), "lo": None, "hi": None}, dtype=object))
        return pd.concat(out).assign(dim=dim, cb=cb)[["dim", "cb", "query_id", "query_key", "vec_id", "score", "lo", "hi"]]

    return stored(rows.groupBy("dim", "cb").applyInPandas(search, FOUND), "top-k-home")


def reachable_blocks(asked: DataFrame, spans: DataFrame, chunk: int = 4096) -> DataFrame:
    """``dim, qb, cb, query_id, query_key``: the blocks but its own in which a query may find its floor or more; written.

    Blocks of queries meet chunks of the rows that stand for blocks, so a task holds one of each.
    """
    last_cb, last_qb = (int(df.select(F.max(c)).first()[0] or 0) for df, c in ((spans, "cb"), (asked, "qb")))
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
    left = spans.withColumn("part", F.floor(F.col("cb") / chunk)).withColumn("qb", up_to(last_qb))
    right = asked.withColumn("part", up_to(last_cb // chunk))
    right = right.toDF(*right.columns)

    def choose(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if blocks.empty or queries.empty:
            return pd.DataFrame({c: np.empty(0, np.int64) for c in ("dim", "qb", "cb", "query_id", "query_key")})
        lo, hi, q = _numbers(blocks["lo"], blocks["hi"], queries["v"])
        best = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
        may = (best >= queries["floor"].to_numpy()[:, None]) & (queries["home"].to_numpy()[:, None] != blocks["cb"].to_numpy()[None, :])
        query, block = np.nonzero(may)
        return pd.DataFrame({
            "dim": queries["dim"].iloc[0], "qb": queries["qb"].iloc[0], "cb": blocks["cb"].to_numpy()[block],
            "query_id": queries["vec_id"].to_numpy()[query], "query_key": queries["key"].to_numpy()[query],
        })

    pairs = left.groupBy("dim", "qb", "part").cogroup(right.groupBy("dim", "qb", "part")).applyInPandas(choose, "dim int, qb long, cb long, query_id long, query_key long")
    return stored(pairs, "top-k-pairs")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding",
          block: int = 8192, query_block: int = 1024) -> DataFrame:
    """Each query's k best candidates: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id is divisible by ``every``, candidates all rows with another id; the score is the inner
    product of the quantised vectors, ties go to the smaller id. Vectors that are null or hold null or non-finite
    components take no part, nor do rows without an id. Rows that repeat an id and a vector count once; a query id with
    several vectors has a ranking of its own for each. Only vectors of equal length are compared, and an empty one
    scores 0. Scores must fit a long. Other columns are ignored; an empty table gives an empty result.
    """
    rows = blocks_of(vectors, scale, vec_id, vector, block)
    home = at_home(rows, k, every)
    met = home.filter("query_id is not null")
    floors = met.groupBy(F.col("query_id").alias("vec_id"), F.col("query_key").alias("key")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    asked = _cut(rows.filter(F.col("vec_id") % every == 0), "cb", query_block, "qb").withColumnRenamed("cb", "home").join(floors, ["vec_id", "key"], "left")
    asked = stored(asked.withColumn("floor", F.coalesce("floor", F.lit(NO_FLOOR))), "top-k-queries")
    pairs = reachable_blocks(asked, home.filter("lo is not null").select("dim", "cb", "lo", "hi"))
    ours = rows.join(pairs.select("dim", "qb", "cb").distinct(), ["dim", "cb"])
    theirs = pairs.join(asked.select(F.col("vec_id").alias("query_id"), F.col("key").alias("query_key"), "v", "floor"), ["query_id", "query_key"])
    theirs = theirs.toDF(*theirs.columns)  # columns apart from those of the same tables on the other side

    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "query_key", "vec_id", "score"]
        if candidates.empty or queries.empty:
            return pd.DataFrame({c: np.empty(0, np.int64) for c in columns})
        v, q = _numbers(candidates["v"], queries["v"])
        held, out = Block(candidates["vec_id"].to_numpy(), v), []
        for query_id, key, floor, query in zip(queries["query_id"].to_numpy(), queries["query_key"].to_numpy(), queries["floor"].to_numpy(), q):
            ids, scores, _ = held.search(query_id, query, k, int(floor))
            out.append(pd.DataFrame({"query_id": query_id, "query_key": key, "vec_id": ids, "score": scores.astype(np.int64)}))
        return pd.concat(out)[columns]

    far = ours.groupBy("dim", "qb", "cb").cogroup(theirs.groupBy("dim", "qb", "cb")).applyInPandas(search, "query_id long, query_key long, vec_id long, score long")
    found = met.select("query_id", "query_key", "vec_id", "score").unionByName(far)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
