"""Streams that remember: documents that arrive again, and sessions of events.

State is kept by key in the state store and goes with the checkpoint, so a
restarted stream goes on where it was. What is later than the watermark has
nothing left to be held against; it is dropped, and counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructField, StructType

#: The state store that keyed state with timers needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def millis(t: datetime) -> int:
    return int(t.timestamp() * 1000)


class Arrivals(StatefulProcessor):
    """Passes the first row of a key on, and forgets the key some time after its last arrival."""

    def __init__(self, key: str, at: str, keep_ms: int):
        self.key, self.at, self.keep_ms = key, at, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, arrivals long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, arrivals = self.seen.get() if self.seen.exists() else (0, 0)
        first = None
        for r in rows:
            arrivals += 1
            last = max(last, millis(r[self.at]))
            if first is None or tuple(map(str, r)) < tuple(map(str, first)):
                first = r
        new = not self.seen.exists()
        self.seen.update((last, arrivals))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.keep_ms)
        if new and first is not None:
            yield first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())


def first_arrivals(docs: DataFrame, key: str = "doc_id", at: str = "arrived", delay: str = "1 hour", keep_ms: int = 3_600_000) -> DataFrame:
    """Of rows of a key that arrive within ``keep_ms`` of one another, the first; of those of one batch, the least.

    Keys and moments must not be null; rows later than ``delay`` behind the
    latest are dropped.
    """
    usable = docs.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, delay)
    kept = StructType([StructField(f.name, f.dataType) for f in usable.schema])
    return usable.groupBy(key).transformWithState(Arrivals(key, at, keep_ms), kept, "Append", "EventTime")


def write_once(docs: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The rows of a stream as Parquet files, each batch once, whatever restarts there are."""
    return docs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def late(query: StreamingQuery) -> int:
    """How many rows a query has dropped since it was started because they were behind the watermark."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", value: str = "value", gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """For each key runs of events with less than ``gap`` between them: first and last moment, count, and sum of the value.

    The same for a table and, with a ``delay`` for the watermark, for a stream,
    where a session comes out once nothing that is in time can prolong it.
    """
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    rows = rows.withWatermark(at, delay) if delay else rows
    found = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
    return found.drop("w")


def configured(spark: SparkSession) -> SparkSession:
    """The session, with the state store that keyed state needs."""
    for k, v in STORE.items():
        spark.conf.set(k, v)
    return spark
