"""Packing documents into training windows, with a bounded number of windows open at a time.

Each task reads its documents once and keeps ``open_windows`` windows: a full window's worth of a long document is
closed at once, and what is left of it goes into the open window it fits best. When it fits none, the fullest window
is closed; where that one has more than ``slack`` free places, the piece is cut to fill them first. At the end a task
pours its open windows into each other, and the one that stays unfilled is merged with those of other tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procatlas.llm.store import stored
from procatlas.llm.tokens import encoder

ID_BYTES = 4
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("task", pa.int64())])
_DDL = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, task long"
_MERGED = 1 << 62


class Windows:
    """Open windows of ``size`` tokens; closed ones are handed out as lists of pieces (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, open_windows: int, slack: int):
        self.size, self.limit, self.slack = size, open_windows, slack
        self.open: list[tuple[int, list]] = []

    def add(self, doc_id, ids: bytes) -> Iterator[list]:
        """Place a whole document; yields the windows that this closes."""
        total = len(ids) // ID_BYTES
        whole = total - total % self.size
        for start in range(0, whole, self.size):
            yield [(doc_id, start, ids[start * ID_BYTES : (start + self.size) * ID_BYTES], total)]
        if total > whole:
            yield from self.place((doc_id, whole, ids[whole * ID_BYTES :], total))

    def place(self, piece) -> Iterator[list]:
        """Place a piece shorter than a window, best fit first."""
        doc_id, start, ids, total = piece
        length = len(ids) // ID_BYTES
        best = -1
        for i, (used, _) in enumerate(self.open):
            if used + length <= self.size and (best < 0 or used > self.open[best][0]):
                best = i
        if best < 0 and len(self.open) >= self.limit:
            fullest = max(range(len(self.open)), key=lambda i: self.open[i][0])
            used, pieces = self.open.pop(fullest)
            free = self.size - used
            if free > self.slack:
                pieces.append((doc_id, start, ids[: free * ID_BYTES], total))
                start, ids, length = start + free, ids[free * ID_BYTES :], length - free
            yield pieces
        if best < 0:
            self.open.append((length, [(doc_id, start, ids, total)]))
            return
        used, pieces = self.open[best]
        pieces.append((doc_id, start, ids, total))
        if used + length == self.size:
            self.open.pop(best)
            yield pieces
        else:
            self.open[best] = (used + length, pieces)

    def pour(self) -> Iterator[list]:
        """Pour the open windows into each other, fullest first; only the last window is not full."""
        now, used = [], 0
        for _, pieces in sorted(self.open, key=lambda w: -w[0]):
            for doc_id, start, ids, total in pieces:
                while ids:
                    part = ids[: (self.size - used) * ID_BYTES]
                    now.append((doc_id, start, part, total))
                    start, ids, used = start + len(part) // ID_BYTES, ids[len(part) :], used + len(part) // ID_BYTES
                    if used == self.size:
                        yield now
                        now, used = [], 0
        self.open = []
        if now:
            yield now


def _rows(pieces: list, sequence_id: int | None, task: int) -> list[tuple]:
    out, offset = [], 0
    for doc_id, start, ids, total in pieces:
        out.append((doc_id, start, ids, total, sequence_id, offset, task))
        offset += len(ids) // ID_BYTES
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _PIECES]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 0, open_windows: int = 32, slack: int = 8,
         tasks_merged: int = 64, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, start, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit integers; each document's ids end with ``end_id``, so null and empty
    texts have one id. A sequence is the pieces of one ``sequence_id`` in the order of ``offset``, gapless, to be padded
    to ``size``. Each input row is a document of its own, also where it repeats another row or has no id; other columns
    are ignored. An empty table has no pieces. The pieces are written once to the shared folder, so reading the
    result never packs again. ``open_windows`` and one batch bound a task's memory, and ``tasks_merged`` how many
    tasks' last windows meet.
    """

    def fill(batches):
        task = TaskContext.get().partitionId()
        windows, encode, sequence, rows, held = Windows(size, open_windows, slack), encoder(vocabulary).encode, task << 32, [], 0
        end = end_id.to_bytes(ID_BYTES, "little")
        for batch in batches:
            for one_id, one_text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for pieces in windows.add(one_id, encode(one_text.as_py()) + end):
                    rows += _rows(pieces, sequence, task)
                    sequence += 1
                    held += size
                    if held >= 1 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        for pieces in windows.pour():
            full = sum(len(p[2]) for p in pieces) == size * ID_BYTES
            rows += _rows(pieces, sequence if full else None, task)
            sequence += 1
        yield _batch(rows)

    def merge(group: pa.Table) -> pa.Table:
        windows = Windows(size, 1 << 30, slack)
        group = group.sort_by([("task", "ascending"), ("offset", "ascending")]).to_pylist()
        windows.open = [(0, [(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]) for r in group])]
        key = group[0]["task"] // tasks_merged
        rows = [r for n, pieces in enumerate(windows.pour()) for r in _rows(pieces, _MERGED | key << 32 | n, key)]
        return pa.Table.from_batches([_batch(rows)])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = stored(slim.mapInArrow(fill, _DDL), "packed")
    last = pieces.filter("sequence_id is null").groupBy(F.floor(F.col("task") / tasks_merged).alias("group"))
    merged = last.applyInArrow(merge, _DDL)
    return pieces.filter("sequence_id is not null").unionByName(merged).drop("task")
