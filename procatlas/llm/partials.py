"""One value of a whole table, put together from one partial result per task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable
from functools import reduce
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

T = TypeVar("T")
_PART = pa.schema([("part", pa.binary())])


def merged(df: DataFrame, partial: Callable[[Iterable[pa.RecordBatch]], T], merge: Callable[[T, T], T], fan: int = 16) -> T | None:
    """``partial`` of each task's batches, merged first in ``fan`` tasks and then here; null for a table without tasks.

    Only ``fan`` parts reach the driver, however many tasks there are, so a part must be of bounded size.
    """

    def packed(value: T) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(value)], pa.binary())], schema=_PART)

    def first(batches):
        yield packed(partial(batches))

    def again(batches):
        parts = [pickle.loads(x.as_py()) for batch in batches for x in batch.column(0)]
        if parts:
            yield packed(reduce(merge, parts))

    parts = df.mapInArrow(first, "part binary").repartition(fan).mapInArrow(again, "part binary").collect()
    return reduce(merge, [pickle.loads(bytes(r["part"])) for r in parts]) if parts else None


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``width`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
