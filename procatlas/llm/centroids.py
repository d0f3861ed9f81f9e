"""Centroid clustering of integer vectors with PCA-rotated filtering.

Vectors are rotated once into the directions in which they vary most. Each row keeps its leading rotated coordinates and
the norm of the rest. For a centroid treated alike, the distance between the leading parts and the difference of the two
norms, both squared and added, is at most the distance, by the triangle inequality. A row is compared first with the centroid
of the least bound, then only with those whose bound, less what rounding may add, does not pass that distance. Comparisons
and means are made in integers, so ties and sums are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.llm.partials import matrix, merged
from procatlas.llm.store import stored

SAFE = 2**27


def integers(vector: Column, scale: float, width: int) -> Column:
    """``floor(scale * x)`` of each component as whole doubles; null unless there are ``width`` components, all finite."""
    whole = (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(scale) * x.cast("double")) < float("inf")))
    # Doubles from 2^52 are whole already, and floor() itself ends at the limits of a long.
    whole_part = lambda y: F.when(F.abs(y) < float(2**52), F.floor(y).cast("double")).otherwise(y)
    return F.when(whole, F.transform(vector, lambda x: whole_part(F.lit(scale) * x.cast("double"))))


def exact(rows: np.ndarray) -> np.ndarray:
    """Whole doubles as integers: of 64 bits while squares of differences fit, of any size otherwise."""
    if np.abs(rows).max(initial=0) < SAFE:
        return rows.astype(np.int64)
    return np.array([[int(x) for x in row] for row in rows.tolist()], dtype=object).reshape(rows.shape)


@dataclass(frozen=True)
class Rotation:
    """An orthogonal ``basis`` whose first ``lead`` columns are kept as coordinates, around ``mean``."""

    mean: np.ndarray
    basis: np.ndarray
    lead: int

    def sketch(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = (rows - self.mean) @ self.basis
        return turned[:, : self.lead], np.sqrt((turned[:, self.lead :] ** 2).sum(axis=1))


def principal_rotation(rows: DataFrame, width: int, lead: int) -> Rotation:
    """The principal directions of all rows ``y``; any orthogonal basis gives the same clusters, only with more comparisons."""

    def partial(batches: Iterable[pa.RecordBatch]):
        n, total, gram = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            y = np.clip(matrix(batch.column(0), width), -1e9, 1e9)
            n, total, gram = n + len(y), total + y.sum(axis=0), gram + y.T @ y
        return n, total, gram

    n, total, gram = merged(rows.select("y"), partial, lambda a, b: tuple(x + y for x, y in zip(a, b))) or (0, np.zeros(width), np.zeros((width, width)))
    if not n:
        return Rotation(np.zeros(width), np.eye(width), lead)
    mean = total / n
    return Rotation(mean, np.linalg.eigh(gram / n - np.outer(mean, mean))[1][:, ::-1], lead)


@dataclass(frozen=True)
class Centroids:
    """Whole-number centroids as Python integers, with their sketches."""

    points: tuple[tuple[int, ...], ...]
    rotation: Rotation

    def nearest(self, y: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance, comparisons made) of each row; ties go to the smaller number."""
        rows = exact(y)
        wide = rows.dtype == object or any(abs(x) >= SAFE for point in self.points for x in point)
        points = np.array(self.points, dtype=object if wide else np.int64)
        rows = rows.astype(object) if wide else rows
        as_floats = np.array(self.points, dtype=np.float64)
        c_lead, c_rest = self.rotation.sketch(as_floats)
        with np.errstate(over="ignore", invalid="ignore"):
            bound = ((lead[:, None, :] - c_lead[None]) ** 2).sum(axis=2) + (rest[:, None] - c_rest[None]) ** 2
            size = (y**2).sum(axis=1)[:, None] + (as_floats**2).sum(axis=1)[None] + 2 * (self.rotation.mean**2).sum()
            bound = bound - 1e-9 * (size + 1)
        bound = np.where(np.isfinite(bound), bound, -np.inf)

        def distance(at: np.ndarray, to: np.ndarray) -> np.ndarray:
            return ((rows[at] - points[to]) ** 2).sum(axis=1)

        everyone = np.arange(len(rows))
        best = bound.argmin(axis=1)
        least = distance(everyone, best)
        first, compared = best.copy(), len(rows)
        for k in range(len(points)):
            # Rows that centroid k may still be nearest to, at a tie included.
            at = np.flatnonzero((first != k) & (bound[:, k] <= least.astype(np.float64)))
            if not len(at):
                continue
            found = distance(at, np.full(len(at), k))
            nearer = (found < least[at]) | ((found == least[at]) & (k < best[at]))
            best[at[nearer]], least[at[nearer]] = k, found[nearer]
            compared += len(at)
        return best, least, compared


def _read(batch: pa.RecordBatch, width: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors and sketches of a batch whose last columns are ``y, lead, rest``."""
    y, kept, rest = batch.columns[-3:]
    return matrix(y, width), matrix(kept, lead), rest.to_numpy(zero_copy_only=False)


def _means(rows: DataFrame, now: Centroids, width: int) -> list[tuple[int, list[int]]]:
    """(count, exact sums) of the rows nearest to each centroid."""
    many, lead = len(now.points), now.rotation.lead

    def partial(batches: Iterable[pa.RecordBatch]):
        out = [(0, [0] * width) for _ in range(many)]
        for batch in batches:
            y, kept, rest = _read(batch, width, lead)
            best = now.nearest(y, kept, rest)[0]
            for k in range(many):
                mine = exact(y[best == k])
                out[k] = (out[k][0] + len(mine), [a + int(b) for a, b in zip(out[k][1], mine.sum(axis=0))] if len(mine) else out[k][1])
        return out

    def merge(a, b):
        return [(m + n, [x + y for x, y in zip(s, t)]) for (m, s), (n, t) in zip(a, b)]

    return merged(rows.select("y", "lead", "rest"), partial, merge) or [(0, [0] * width) for _ in range(many)]


def cluster(
    vectors: DataFrame, width: int = 64, many: int = 8, rounds: int = 10, scale: float = 1024.0, lead: int = 16, seed: str = "3:",
    vector: str = "embedding", vec_id: str = "vec_id",
) -> DataFrame:
    """One row per vector that takes part: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors of exactly ``width`` finite components take part, each component as ``floor(scale * x)``. The first centroids are
    the ``many`` vectors with the smallest SHA-256 of the seed and their id (at a repeated id the smaller vector first), fewer
    where there are fewer vectors; rows without an id are never among them. Without any centroid the result is empty. Each round
    puts every vector to its nearest centroid, the smaller number at a tie, and moves centroids to the floor of their vectors'
    mean; one without vectors stays. Distances are squared; those and their sums that pass a long are null. Repeated rows
    count each, other columns are ignored.
    """
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), integers(F.col(vector), scale, width).alias("y")).filter("y is not null")
    plain = stored(kept, "cluster-rows")
    rotation = principal_rotation(plain, width, lead)
    sketch_schema = pa.schema([("vec_id", pa.int64()), ("y", pa.list_(pa.float64())), ("lead", pa.list_(pa.float64())), ("rest", pa.float64())])

    def sketch(batches):
        for batch in batches:
            kept_part, rest = rotation.sketch(matrix(batch.column(1), width))
            lists = pa.ListArray.from_arrays(np.arange(0, kept_part.size + 1, lead, dtype=np.int32), np.ascontiguousarray(kept_part).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(sketch_schema.field("y").type), lists, pa.array(rest)], schema=sketch_schema)

    rows = stored(plain.select("vec_id", "y").mapInArrow(sketch, "vec_id long, y array<double>, lead array<double>, rest double"), "cluster-sketches")
    drawn = plain.filter("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256), "y").limit(many).collect()
    out_ddl = "vec_id long, cluster int, distance long"
    if not drawn:
        return vectors.sparkSession.createDataFrame([], f"{out_ddl}, cluster_inertia long, inertia long, centroid_sha256 string")
    now = Centroids(tuple(tuple(int(x) for x in r["y"]) for r in drawn), rotation)
    for _ in range(rounds):
        means = _means(rows, now, width)
        moved = tuple(tuple(s // n for s in sums) if n else point for point, (n, sums) in zip(now.points, means))
        if moved == now.points:
            break  # every further round would give the same
        now = Centroids(moved, rotation)

    out_schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def assign(batches):
        for batch in batches:
            best, least, _ = now.nearest(*_read(batch, width, lead))
            distances = pa.array([x if x < 2**63 else None for x in least.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), distances], schema=out_schema)

    assigned = stored(rows.mapInArrow(assign, out_ddl), "cluster-assigned")
    exact_sum = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: None if r["open"] else int(r["total"]) for r in assigned.groupBy("cluster").agg(exact_sum.alias("total"), F.max(F.isnull("distance")).alias("open")).collect()}
    whole = None if None in sums.values() else sum(sums.values())
    fits = lambda x: F.lit(x if x is not None and x < 2**63 else None).cast("long")
    labels = [hashlib.sha256(",".join(map(str, point)).encode()).hexdigest() for point in now.points]
    per_cluster = F.create_map(*[x for k in sums for x in (F.lit(k), fits(sums[k]))])
    names = F.create_map(*[x for k in sums for x in (F.lit(k), F.lit(labels[k]))])
    return assigned.select("*", per_cluster[F.col("cluster")].alias("cluster_inertia"), fits(whole).alias("inertia"), names[F.col("cluster")].alias("centroid_sha256"))
