"""Whitening of embeddings through shifted CholeskyQR.

The rows, centred at their mean, are a tall matrix that is never gathered. Each pass sums the Gram matrix of the rows after
the triangular solves of the passes before; its Cholesky factor is the next solve. The first Gram matrix is shifted, so its
factor exists however ill-conditioned the rows are, and each further pass brings the rows nearer to orthonormal ones. The
product of the factors is the R of a QR decomposition, and the singular values and right singular vectors of R, small
enough for the driver, are those of the rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.llm.partials import matrix, merged
from procatlas.llm.store import stored

LARGEST = 2.0**52
ROUNDING = 2.0**-53


def quantised(vector: Column, scale: float) -> Column:
    """``floor(scale * x)`` of each component as a long, held within 2^52; null for vectors with a null or non-finite one."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    limit = F.lit(LARGEST)
    return F.when(whole, F.transform(vector, lambda x: F.floor(F.least(F.greatest(F.lit(scale) * x.cast("double"), -limit), limit)).cast("long")))


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """The rows times the inverses of upper triangular factors, by substitution."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(r.shape[0]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


@dataclass(frozen=True)
class Whitening:
    """``directions`` are unit eigenvectors of the covariance as rows, ``values`` their eigenvalues, falling."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return rows - np.array([s / self.n for s in self.sums])

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        return self.centred(rows.astype(np.float64)) @ (self.directions / np.sqrt(self.values)[:, None]).T

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of ``(n * x - S) ** 2`` of each row; null where it passes a long."""
        bound = self.n * int(np.abs(rows).max(initial=0)) + max(map(abs, self.sums))
        if bound * bound * rows.shape[1] < 2**63:
            return ((rows * np.int64(self.n) - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * x - s) ** 2 for x, s in zip(row, self.sums)) for row in rows.tolist()]
        return [x if x < 2**63 else None for x in exact]


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of the dimensions."""

    def partial(batches: Iterable[pa.RecordBatch]):
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            rows = matrix(batch.column(0), width)
            n, high, low = n + len(rows), high + (rows >> 26).sum(axis=0), low + (rows & (2**26 - 1)).sum(axis=0)
        return n, [(int(h) << 26) + int(s) for h, s in zip(high, low)]

    return merged(fit, partial, lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1])])) or (0, [0] * width)


def _gram(fit: DataFrame, width: int, means: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """The Gram matrix of the centred rows after the solves."""

    def partial(batches: Iterable[pa.RecordBatch]):
        total = np.zeros((width, width))
        for batch in batches:
            rows = solved(matrix(batch.column(0), width) - means, factors)
            total += rows.T @ rows
        return total

    return merged(fit, partial, lambda a, b: a + b)


def _factors(fit: DataFrame, width: int, n: int, means: np.ndarray, passes: int) -> tuple[list[np.ndarray], np.ndarray, float]:
    """(factors, Gram matrix of the rows after them, trace of the first one).

    Directions without any variance stay without it; the rest become orthonormal. A Gram matrix without a Cholesky factor
    is shifted again.
    """
    factors: list[np.ndarray] = []
    trace = 0.0
    while True:
        gram = _gram(fit, width, means, factors)
        values = np.linalg.eigvalsh(gram)
        trace = trace if factors else float(np.trace(gram))
        settled = factors and bool(np.all((np.abs(values - 1) < 1e-8) | (np.abs(values) < 1e-8)))
        if settled or len(factors) == passes or values[-1] <= 0:
            return factors, gram, trace
        shift = 11 * (n * width + width * (width + 1)) * ROUNDING * values[-1]
        if factors and values[0] > shift:
            shift = 0.0
        factors.append(np.linalg.cholesky(gram + min(shift, values[-1]) * np.eye(width)).T)


def fit_whitening(fit: DataFrame, components: int = 4, passes: int = 8) -> Whitening | None:
    """Whitening of the rows ``x`` of equal length in ``fit``, each counted once for each row; null without rows or variance.

    Components whose singular value is below 1e-12 of the greatest are left out: nothing varies along them.
    """
    first = fit.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    width = first["d"]
    n, sums = _sums(fit, width)
    means = np.array([s / n for s in sums])
    factors, gram, trace = _factors(fit, width, n, means, passes)
    if trace <= 0 or not factors:
        return None
    product = np.eye(width)
    for r in factors:
        product = r @ product
    # What the last Gram matrix still differs from the identity goes into R as well.
    values, vectors = np.linalg.eigh(gram)
    singular, directions = np.linalg.svd((np.sqrt(np.maximum(values, 0))[:, None] * vectors.T) @ product)[1:]
    rank = min(components, int((singular > 1e-12 * singular[0]).sum()))
    directions = directions[:rank]
    largest = directions[np.arange(rank), np.abs(directions).argmax(axis=1)]
    found = Whitening(n, tuple(sums), directions * np.sign(largest)[:, None], singular[:rank] ** 2 / n, trace / n, 0.0)

    def partial(batches: Iterable[pa.RecordBatch]):
        total, squares = np.zeros(rank), np.zeros((rank, rank))
        for batch in batches:
            z = found.whitened(matrix(batch.column(0), width))
            total, squares = total + z.sum(axis=0), squares + z.T @ z
        return total, squares

    total, squares = merged(fit, partial, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    covariance = squares / n - np.outer(total / n, total / n)
    error = float(np.abs(covariance - np.eye(rank)).max())
    return Whitening(n, found.sums, found.directions, found.values, found.trace, error)


_OUT = [("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
_OUT_DDL = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 4, scale: float = 256.0, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """One row per input row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    A component of a vector counts as ``floor(scale * x)``. Rows whose vector is null, empty or holds a null, NaN or
    infinity take no part, and of vectors of several lengths only those of the most frequent one do (the longer at a tie).
    The whitening is fitted to each distinct vector once; every row is whitened, repeated ones and those with a null id
    included. Components past the number of directions that vary have no rows, so equal vectors alone give an empty
    result, as does an empty table. Other columns are ignored.
    """
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("x")).filter("size(x) > 0")
    rows = stored(kept, "whiten-rows")
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    width = common["d"] if common else 0
    rows = rows.filter(F.size("x") == width)
    fit = stored(rows.select("x").distinct(), "whiten-fit")
    model = fit_whitening(fit, components) if common else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id long, {_OUT_DDL}")
    schema = pa.schema([("vec_id", pa.int64()), *_OUT])
    rank = len(model.values)

    def project(batches):
        for batch in batches:
            x = matrix(batch.column(1), width)
            each = np.repeat(np.arange(len(x)), rank)
            columns = [
                batch.column(0).take(pa.array(each)), np.tile(np.arange(1, rank + 1, dtype=np.int32), len(x)), np.full(len(each), model.n),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(each)), model.whitened(x).reshape(-1),
                np.tile(model.values / model.trace, len(x)), np.full(len(each), model.identity_error),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, schema)], schema=schema)

    return rows.select("vec_id", "x").mapInArrow(project, f"vec_id long, {_OUT_DDL}")
