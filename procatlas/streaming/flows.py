"""Streaming forms of intake, de-duplication, rate limits, status changes and retention.

Every flow reads files as they land, runs with ``availableNow`` or any other
trigger, keeps its state under a checkpoint in shared storage and writes Parquet.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from procatlas.model import Estate
from procatlas.session import shared_dir
from procatlas.sources import files, releases

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, glob: str = "events.parquet", files_per_trigger: int = 64) -> DataFrame:
    """The event table as a stream; ``at`` is its event time."""
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, output_mode: str = "append", path: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Run a stream over everything that is there, and read what it wrote; ``by`` are columns with a folder each of their values."""
    spark = stream.sparkSession
    base = path or f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").outputMode(output_mode).option("checkpointLocation", f"{base}/checkpoint")
    if by:
        writer = writer.partitionBy(*by)
    query = writer.option("path", f"{base}/data").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def stream_dedup(events: DataFrame, keys: list[str], delay: str = "30 days") -> DataFrame:
    """The first event of each key within the delay; later copies are dropped."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(keys)


def stream_rate(events: DataFrame, key: str, window: str = "1 hour", slide: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events per key in sliding windows; a window is written once the watermark has passed it."""
    counted = events.withWatermark("at", delay).groupBy(F.window("at", window, slide).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def stream_rate_limit(events: DataFrame, key: str, limit: int = 30, **windows: str) -> DataFrame:
    """The windows in which a key went over the limit."""
    return stream_rate(events, key, **windows).where(F.col("n") > limit)


STATUS_OUT = "subject long, at timestamp, event_id long, from_status string, to_status string"
STATUS_STATE = "status string, at timestamp, event_id long"


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key's new events in order of time; the state is the last status and when it was set."""
    last = state.get if state.exists else None
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["at", "event_id"], kind="stable")
    if last is not None:
        # an event older than the last known one cannot change the status any more
        known = (pd.Timestamp(last[1]), last[2])
        rows = rows[[(a, e) > known for a, e in zip(rows["at"], rows["event_id"])]]
    if rows.empty:
        return
    before = rows["event_type"].shift(1)
    before.iloc[0] = last[0] if last is not None else None
    changed = before.notna() & (before != rows["event_type"])
    end = rows.iloc[-1]
    state.update((end["event_type"], end["at"], int(end["event_id"])))
    out = rows[changed]
    yield pd.DataFrame(
        {"subject": key[0], "at": out["at"], "event_id": out["event_id"], "from_status": before[changed], "to_status": out["event_type"]}
    )


def stream_status_changes(events: DataFrame, key: str) -> DataFrame:
    """from → to whenever a key's status changes, with one small state per key.

    A micro-batch holds as much of a key as ``maxFilesPerTrigger`` lets in; that
    option bounds what a task meets of a busy key.
    """
    return events.select(key, "at", "event_id", "event_type").groupBy(key).applyInPandasWithState(
        _changes, STATUS_OUT, STATUS_STATE, "append", GroupStateTimeout.NoTimeout
    )


REACH_DAYS = 3650
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(duration: str | None) -> int | None:
    return None if duration is None else int(pd.Timedelta(duration).total_seconds() * 1000)


class _Clock:
    """Event time as it passes.

    Spark drops what is older than its watermark before a processor sees it, so the watermark here lags by ``REACH_DAYS``
    and is used as a clock only: the horizon is the latest event time of earlier batches less the patience.
    """

    def __init__(self, patience: str):
        self.lag = REACH_DAYS * 86_400_000 - _ms(patience)

    def horizon(self, watermark: int) -> int | None:
        return watermark + self.lag if watermark > 0 else None

    def timer(self, at: int) -> int:
        """When to ask for a timer that rings once the horizon has reached a time."""
        return at - self.lag


def _millis(at: pd.Series) -> pd.Series:
    return at.astype("datetime64[us]").astype("int64") // 1000


ORDERED_OUT = "kind string, subject long, at timestamp, event_id long, from_status string, to_status string"


class _Ordered(StatefulProcessor):
    """Holds a key's events until the horizon has passed them, and compares them in order of time.

    Events wait in buckets of time, so that neither a busy key's batch nor all it waits for is held at once. ``last`` is the
    status that was handed out last; it goes when the key has been silent for ``expire``.
    """

    def __init__(self, patience: str, bucket: str, expire: str | None):
        self.clock, self.width, self.expire = _Clock(patience), _ms(bucket), _ms(expire)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "at array<timestamp>, event_id array<long>, status array<string>")
        self.last = handle.getValueState("last", "status string, at timestamp, event_id long")

    def handleInputRows(self, key, rows, timerValues):
        horizon = self.clock.horizon(timerValues.getCurrentWatermarkInMs())
        for part in rows:
            at = _millis(part["at"])
            late = at <= horizon if horizon is not None else pd.Series(False, index=part.index)
            if late.any():
                out = part[late]
                yield pd.DataFrame({"kind": "late", "subject": key[0], "at": out["at"], "event_id": out["event_id"], "from_status": None, "to_status": out["event_type"]})
            kept = part[~late]
            for start, events in kept.groupby(at[~late] // self.width * self.width):
                bucket = (int(start),)
                held = self.waiting.getValue(bucket) if self.waiting.containsKey(bucket) else ([], [], [])
                if not held[0]:
                    self.handle.registerTimer(self.clock.timer(int(start) + self.width - 1))
                self.waiting.updateValue(bucket, (
                    [*held[0], *events["at"].dt.to_pydatetime()], [*held[1], *events["event_id"].tolist()], [*held[2], *events["event_type"].tolist()],
                ))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        rung = expiredTimerInfo.getExpiryTimeInMs() + self.clock.lag
        bucket = (rung + 1 - self.width,)
        last = self.last.get() if self.last.exists() else None
        if self.waiting.containsKey(bucket):
            at, ids, status = self.waiting.getValue(bucket)
            self.waiting.removeKey(bucket)
            rows = pd.DataFrame({"at": pd.to_datetime(pd.Series(list(at))), "event_id": list(ids), "to_status": list(status)}).sort_values(["at", "event_id"], kind="stable", ignore_index=True)
            before, when = rows["to_status"].shift(1), rows["at"].shift(1)
            if last is not None:
                before.iloc[0], when.iloc[0] = last[0], pd.Timestamp(last[1])
            changed = before.notna() & (before != rows["to_status"])
            if self.expire is not None:
                changed &= (rows["at"] - when).dt.total_seconds() * 1000 <= self.expire
            end = rows.iloc[-1]
            self.last.update((end["to_status"], end["at"].to_pydatetime(), int(end["event_id"])))
            if self.expire is not None:
                self.handle.registerTimer(self.clock.timer(int(_millis(rows["at"]).iloc[-1]) + self.expire + 1))
            out = rows[changed]
            if len(out):
                yield pd.DataFrame({"kind": "change", "subject": key[0], "at": out["at"], "event_id": out["event_id"], "from_status": before[changed], "to_status": out["to_status"]})
        elif last is not None and self.expire is not None and rung > int(_millis(pd.Series([pd.Timestamp(last[1])])).iloc[0]) + self.expire:
            self.last.clear()


class _Sided(StatefulProcessor):
    """Hands out every row with whether it came after the horizon; keeps nothing."""

    def __init__(self, patience: str):
        self.clock = _Clock(patience)

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        horizon = self.clock.horizon(timerValues.getCurrentWatermarkInMs())
        for part in rows:
            late = _millis(part["at"]) <= horizon if horizon is not None else False
            yield part.assign(late=late)


def _stateful(events: DataFrame, keys: list[str], processor: StatefulProcessor, ddl: str) -> DataFrame:
    # The only provider that keeps timers and several states for a key; it holds for queries started from here on.
    events.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    timed = events.withWatermark("at", f"{REACH_DAYS} days")
    return timed.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=ddl, outputMode="Append", timeMode="EventTime")


def stream_ordered_changes(events: DataFrame, key: str, patience: str = "10 minutes", bucket: str = "1 minute", expire: str | None = None) -> DataFrame:
    """from → to whenever a key's status changes in order of event time, in whatever order events arrive.

    An event waits until the latest event time seen is ``patience`` ahead of its bucket; an event that arrives when its own time is
    already that far behind comes out as a row of kind ``late``, so changes and late rows account for all that was read. A key
    silent for longer than ``expire`` starts anew. Order within equal times is by ``event_id``.
    """
    return _stateful(events.select(key, "at", "event_id", "event_type"), [key], _Ordered(patience, bucket, expire), ORDERED_OUT)


def stream_with_late(events: DataFrame, patience: str, spread: int = 64) -> DataFrame:
    """Every row with ``late``: whether its time was further behind the latest one of earlier batches than ``patience``.

    What a watermark would drop without a trace can be written beside the rest. Rows are dealt over ``spread`` keys.
    """
    dealt = events.withColumn("spread", F.pmod(F.xxhash64("event_id"), F.lit(spread)))
    ddl = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in dealt.schema)}, late boolean"
    return _stateful(dealt, ["spread"], _Sided(patience), ddl).drop("spread")


def stream_retained(events: DataFrame, retention: str, window: str = "1 day") -> DataFrame:
    """Events per day, without those that arrive later than the retention; the watermark is the retention."""
    counted = events.withWatermark("at", retention).groupBy(F.window("at", window).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("day"), "n")


def stream_intake(spark: SparkSession, folder: str, sink: Callable[[Estate, DataFrame], None], checkpoint: str, glob: str | None = None, max_bytes: int | None = None):
    """New export files as they land: gate, normalise, hand the tables and the rejects to ``sink``.

    Runs over what is there and stops; the same checkpoint continues later. The content of a file over ``max_bytes``
    goes no further than the scan.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    content = F.col("content").cast("string")
    kept = content if max_bytes is None else F.when(F.col("length") <= max_bytes, content)
    landed = reader.load(folder).select(F.col("path").alias("file"), F.col("length").alias("size_bytes"), kept.alias("content"))

    return run_intake(landed, sink, checkpoint, max_bytes)


def run_intake(landed: DataFrame, sink: Callable[[Estate, DataFrame], None], checkpoint: str, max_bytes: int | None = None, of: str = releases.DEFINITION):
    """Gate and normalise a stream of ``file, size_bytes, content`` rows, batch by batch; ``of`` are the fields that the sink shows."""

    def batch(df: DataFrame, epoch: int) -> None:
        gated = files.intake_gate(df, max_bytes)
        accepted, rejected = files.split_accepted(gated)
        sink(releases.normalize(accepted, of), rejected)

    query = landed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
