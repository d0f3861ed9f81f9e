"""Token ids as length-delimited binary records, with an offset index beside them.

A data file is a row of records: the payload's length as 8 bytes, the masked checksum of these, the payload, the masked
checksum of the payload. All numbers are little-endian; a checksum is a CRC-32 turned right by 15 bits plus a constant,
so that a checksum stored in a payload doesn't check itself. A payload is a flag byte (1: the document has no id), the
width of an id in bytes, the document's id as 8 bytes, and the ids, two bytes each where all of the document's fit.

The index is a Parquet table with one row per record. Records can be read file by file in order, or any set of them
by offset, which a shuffled reader does.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procatlas.llm.tokens import encoder
from procatlas.session import CHECKPOINT_CONF

_LENGTH, _CHECK, _HEAD = "<Q", "<I", "<BBq"
FRAME = struct.calcsize(_LENGTH) + 2 * struct.calcsize(_CHECK)
_MASK_DELTA = 0xA282EAD8  # fixed value of the record format
#: Spark's names of file systems, and Arrow's
_SCHEMES = {"hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}

_INDEX = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("first_token", pa.int64()), ("n_tokens", pa.int64())])
_INDEX_DDL = "part long, number long, doc_id long, offset long, length long, first_token long, n_tokens long"
_READ = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("number", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
_READ_DDL = "doc_id long, part long, number long, start long, ids binary"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """One record of little-endian unsigned 32-bit ids."""
    wide = np.frombuffer(ids, dtype="<u4")
    width = 2 if not len(wide) or int(wide.max()) < 1 << 16 else 4
    payload = struct.pack(_HEAD, doc_id is None, width, doc_id or 0) + (wide.astype("<u2").tobytes() if width == 2 else ids)
    length = struct.pack(_LENGTH, len(payload))
    return b"".join((length, struct.pack(_CHECK, masked(length)), payload, struct.pack(_CHECK, masked(payload))))


def unframe(record: bytes) -> tuple[int | None, bytes]:
    """(document id, ids as little-endian unsigned 32-bit integers) of one whole record; a damaged one raises."""
    head = record[: struct.calcsize(_LENGTH)]
    if struct.unpack_from(_CHECK, record, len(head))[0] != masked(head):
        raise ValueError("the record's length is damaged")
    (length,) = struct.unpack(_LENGTH, head)
    start = len(head) + struct.calcsize(_CHECK)
    payload = record[start : start + length]
    if len(record) != length + FRAME or struct.unpack_from(_CHECK, record, start + length)[0] != masked(payload):
        raise ValueError("the record is damaged")
    missing, width, doc_id = struct.unpack_from(_HEAD, payload)
    ids = np.frombuffer(payload, dtype=f"<u{width}", offset=struct.calcsize(_HEAD))
    return (None if missing else doc_id), ids.astype("<u4").tobytes()


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark understands it: without one it lies on Hadoop's default file system.

    On a cluster a folder on the machine's own disk is refused unless it lies in one that the cluster calls shared,
    ``spark.checkpoint.dir`` or the warehouse.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def whole(name: str) -> str:
        at = path(name)
        return at.getFileSystem(conf).makeQualified(at).toString().rstrip("/")

    full = whole(folder)
    if full.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        named = [spark.sparkContext.getCheckpointDir(), spark.sparkContext.getConf().get(CHECKPOINT_CONF, None), spark.conf.get(CHECKPOINT_CONF, None), spark.conf.get("spark.sql.warehouse.dir", None)]
        shared = [whole(n) for n in named if n]
        if not any(full == s or full.startswith(s + "/") for s in shared):
            raise ValueError(f"{full} is a folder of one machine; records need one that all executors share")
    return full


def _storage(folder: str):
    """(Arrow's file system, path) of a qualified folder."""
    from pyarrow import fs

    scheme, _, rest = folder.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    known = _SCHEMES.get(scheme)
    if known is None:
        raise ValueError(f"no records on {scheme}: folders")
    return fs.FileSystem.from_uri(f"{known}:{quote(rest, safe='/:@')}")


def _file(part: int) -> str:
    return f"data-{part:06d}.rec"


def _slices(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, files: int | None = None, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write every document's ids, ended by ``end_id``, in ascending order of id, and the index.

    Files hold ranges of ids, and each is sorted; documents without an id come first, and rows that repeat an id are all
    written, in the order of a hash of their text. Null and empty texts have the end id alone. Other columns
    are ignored; an empty table gives an empty index. ``files`` defaults to the shuffle partitions. A task writes its
    file under a name of its own and renames it when it is complete, so a repeated task leaves one whole file. The
    folder must be reachable by every executor through a file system that Arrow knows.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        part = TaskContext.get().partitionId()
        store, path = _storage(folder)
        store.create_dir(f"{path}/data", recursive=True)
        draft = f"{path}/data/.{_file(part)}.{TaskContext.get().taskAttemptId()}-{os.getpid()}"
        encode, end = encoder(vocabulary).encode, end_id.to_bytes(4, "little")
        number = offset = tokens = 0
        with store.open_output_stream(draft) as out:
            for batch in batches:
                rows = []
                for one_id, one_text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(one_text.as_py()) + end
                    record = frame(one_id, ids)
                    out.write(record)
                    rows.append((part, number, one_id, offset, len(record), tokens, len(ids) // 4))
                    number, offset, tokens = number + 1, offset + len(record), tokens + len(ids) // 4
                yield _slices(rows, _INDEX)
        store.move(draft, f"{path}/data/{_file(part)}")

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    ordered = slim.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(write, _INDEX_DDL).write.option("compression", "zstd").parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: ``part, number, doc_id, offset, length, first_token, n_tokens``; places count within the file."""
    return spark.read.schema(_INDEX_DDL).parquet(f"{folder}/index")


def _records(stream, limit: int = 1 << 23) -> Iterator[bytes]:
    """The records of an open file, read in blocks."""
    held = b""
    while True:
        block = stream.read(limit)
        held += block
        at = 0
        while len(held) - at >= FRAME:
            end = at + FRAME + struct.unpack_from(_LENGTH, held, at)[0]
            if end > len(held):
                break
            yield held[at:end]
            at = end
        held = held[at:]
        if not block:
            if held:
                raise ValueError("the file ends inside a record")
            return


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All documents from the data files: ``doc_id, part, number, start, ids``.

    ``start`` is the number of ids in all documents before; only the files' totals, one row each, are summed in order.
    """
    folder = qualified(spark, folder)
    index = read_index(spark, folder)
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = totals.select("part", before.alias("base"))

    def read(batches):
        store, path = _storage(folder)
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                with store.open_input_stream(f"{path}/data/{_file(part)}") as stream:
                    for number, record in enumerate(_records(stream)):
                        doc_id, ids = unframe(record)
                        rows.append((doc_id, part, number, base, ids))
                        base, held = base + len(ids) // 4, held + len(ids)
                        if held >= 1 << 22:
                            yield _slices(rows, _READ)
                            rows, held = [], 0
                yield _slices(rows, _READ)

    many = totals.count()
    return files.repartition(max(1, many), "part").mapInArrow(read, _READ_DDL)


def read_at(wanted: DataFrame, folder: str) -> DataFrame:
    """The records of some index rows, by offset, in the order in which their tasks get them: ``doc_id, part, number, start, ids``.

    ``start`` counts within the file here.
    """
    folder = qualified(wanted.sparkSession, folder)

    def read(batches):
        store, path = _storage(folder)
        names = wanted_columns
        open_files: dict[int, object] = {}
        for batch in batches:
            rows = []
            for part, number, offset, length, first in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)):
                if part not in open_files:
                    open_files[part] = store.open_input_file(f"{path}/data/{_file(part)}")
                doc_id, ids = unframe(open_files[part].read_at(length, offset))
                rows.append((doc_id, part, number, first, ids))
            yield _slices(rows, _READ)
        for stream in open_files.values():
            stream.close()

    wanted_columns = ("part", "number", "offset", "length", "first_token")
    return wanted.select(*wanted_columns).mapInArrow(read, _READ_DDL)


def read_shuffled(spark: SparkSession, folder: str, seed: int, tasks: int | None = None) -> DataFrame:
    """All documents in an order drawn by ``seed``: each task reads its random share of all files by offset."""
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = read_index(spark, folder).withColumn("draw", F.xxhash64(F.lit(seed), "part", "number"))
    return read_at(drawn.repartition(tasks, "draw").sortWithinPartitions("draw"), folder)
