"""Intermediate tables of the operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame

from procatlas.session import shared_dir


def place(df: DataFrame, name: str) -> str:
    """A new folder's name in the storage that driver and executors share."""
    return f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a frame once as Parquet into the shared storage and read it back; a lost executor loses none of it."""
    path = place(df, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_process(kind: str, key: Hashable, make: Callable[[], object]):
    """What ``make`` gives, made once in a process for each kind while its key stays the same.

    Functions travel to the tasks by value, so a module's own globals would start anew with every task.
    """
    state = sys.modules.setdefault("procatlas_process_state", types.ModuleType("procatlas_process_state")).__dict__
    if kind not in state or state[kind][0] != key:
        state[kind] = (key, make())
    return state[kind][1]
