"""Repeated paths of a stream, with the reason of every rejection."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sheaf.session import ship_package

#: The state store that timers and named states need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Queries started here keep their state in RocksDB; the session is left as it was."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class FirstArrival(StatefulProcessor):
    """Per path the arrival that opened its window. A timer drops it once the watermark has passed the window's end.
    Times are microseconds."""

    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "source string, micros bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.first.get()
        first = opened = None if held is None else (held[1], held[0])
        # One micro-batch of one path, names alone; the trigger bounds it.
        for at, source in sorted(((r.micros, r.source) for r in rows), key=lambda x: (x[0], x[1] is not None, x[1] or "")):
            kept = first is None or at - first[0] >= self.window
            if kept:
                first = (at, source)
            yield Row(bundle_id=key[0], path=key[1], source=source, micros=at, kept=kept, first_source=first[1], first_micros=first[0])
        if first != opened:
            self.first.update((first[1], first[0]))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(self._end(first[0]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.first.get()
        if held is not None and self._end(held[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.first.clear()
        return iter([])

    def _end(self, opened: int) -> int:
        """Where a window ends in milliseconds, rounded up."""
        return -(-(opened + self.window) // 1000)

    def close(self) -> None:
        pass


def guard_sources(files: DataFrame, window: timedelta, lateness: str) -> DataFrame:
    """Every arrival of a stream with its verdict: ``bundle_id, path, source, at, kept, first_source, first_at``.

    ``files`` has ``bundle_id, path, source`` (string) and ``at`` (timestamp); other columns are not read. The first
    arrival of a path opens a window and is kept. Arrivals within it are rejected and name the source and the time
    of the first; the next one after it opens another. Within a micro-batch arrivals count by time, then
    source (null first). An arrival that comes after the window of a later one was opened is a repeat of that one.
    Rows later than ``lateness`` behind the latest time seen are dropped, and so are rows without a time.
    Null bundles and paths are keys like any other.

    State is one row a path whose window the watermark has not passed; a timer removes it then, so state
    is bounded by the paths of one window and the lateness. Only names move. The query needs the RocksDB state
    store: start it inside ``rocks_state``, or set the session so.
    """
    ship_package(files.sparkSession)
    named = files.select("bundle_id", "path", F.col("source").cast("string").alias("source"), "at", F.unix_micros("at").alias("micros"))
    out = "bundle_id string, path string, source string, micros bigint, kept boolean, first_source string, first_micros bigint"
    told = (
        named.filter(F.col("at").isNotNull())
        .withWatermark("at", lateness)
        .groupBy("bundle_id", "path")
        .transformWithState(FirstArrival(window // timedelta(microseconds=1)), outputStructType=out, outputMode="Append", timeMode="EventTime")
    )
    at, first_at = F.timestamp_micros("micros").alias("at"), F.timestamp_micros("first_micros").alias("first_at")
    return told.select("bundle_id", "path", "source", at, "kept", "first_source", first_at)
