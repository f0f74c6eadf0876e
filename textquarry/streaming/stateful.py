"""Operators with state of their own: the review log and the throttle, as streams.

Both keep a small state for each key in Spark's state store and give the same rows for any cut of the input into
micro-batches. The review log goes by arrival: a review is accepted if it expects the revision that its record is at.
The throttle goes by event time: once the watermark has passed a client's earliest unserved second a timer fires, and all
seconds up to the watermark, whose failures have all come, are served in one pass along the window; so their order of
arrival doesn't matter, and a client's state is read once for a micro-batch, not once for each second. What no later
second can need is dropped.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from textquarry.operators.review import KEY, STATUSES

#: The state store that such operators need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
JUDGED = "extraction_id string, record_id string, expected_revision int, revision int, status string, payload string, reviewer string, created string, reason string"
WAITS = "client string, ts long, recent long, retry_after long"
Judged = Row("extraction_id", "record_id", "expected_revision", "revision", "status", "payload", "reviewer", "created", "reason")
Wait = Row("client", "ts", "recent", "retry_after")


class ReviewLog(StatefulProcessor):
    """Accepts reviews one after another; of one micro-batch the earlier created ones come first."""

    def init(self, handle) -> None:
        self.now = handle.getValueState("revision", "revision int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = self.now.get()[0] if self.now.exists() else 0
        for r in sorted(rows, key=lambda r: (r.created or "", r.reviewer or "", r.payload or "")):
            invalid = r.status not in STATUSES or not (r.reviewer or "").strip()
            reason = "invalid" if invalid else None if r.expected_revision == now else "revision_changed"
            now += reason is None
            yield Judged(r.extraction_id, r.record_id, r.expected_revision, now, r.status, r.payload, r.reviewer, r.created, reason)
        self.now.update((now,))

    def close(self) -> None:
        pass


def judged_reviews(stream: DataFrame) -> DataFrame:
    """Reviews (extraction_id, record_id, expected_revision, status, payload, reviewer, created) with their record's revision after them and a reason, null where accepted."""
    rows = stream.select(*KEY, F.col("expected_revision").cast("int").alias("expected_revision"), "status", "payload", "reviewer", "created")
    return rows.groupBy(*KEY).transformWithState(statefulProcessor=ReviewLog(), outputStructType=JUDGED, outputMode="Append", timeMode="None")


def store_reviews(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Two tables, accepted reviews and refused ones. A micro-batch that runs again replaces its own files."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        for name, held in (("reviews", rows.filter("reason IS NULL").drop("reason", "expected_revision")), ("conflicts", rows.filter("reason IS NOT NULL"))):
            held.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        rows.unpersist()

    return _started(judged_reviews(stream).writeStream.foreachBatch(batch), stream.sparkSession, checkpoint)


class Throttle(StatefulProcessor):
    """Failures of a client within the window before each, and the seconds to wait once there are enough."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "ts long, n long")
        self.done = handle.getValueState("done", "ts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = Counter(r.ts for r in rows if r.ts is not None)
        if new:
            self.times.appendList([(ts, n) for ts, n in sorted(new.items())])
            self.handle.registerTimer((min(new) + 1) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = timerValues.getCurrentWatermarkInMs() // 1000 - 1  # the last second that is over
        sums = Counter()
        for t, n in self.times.get():
            sums[int(t)] += int(n)
        held = sorted(sums.items())
        at = [t for t, _ in held]
        done = self.done.get()[0] if self.done.exists() else None
        begin = 0 if done is None else bisect_right(at, done)  # those before have been served
        end = bisect_right(at, due)
        if begin >= end:
            return
        first = bisect_right(at, at[begin] - self.window)
        recent = sum(n for _, n in held[first:begin])
        for ts, n in held[begin:end]:
            recent += n
            while at[first] <= ts - self.window:
                recent -= held[first][1]
                first += 1
            wait = max(1, self.window - (ts - at[first])) if recent >= self.limit else 0
            for _ in range(n):
                yield Wait(key[0], ts, recent, wait)
        self.done.update((at[end - 1],))
        self.times.put(held[bisect_right(at, at[end - 1] - self.window) :])
        if end < len(at):
            self.handle.registerTimer((at[end] + 1) * 1000)

    def close(self) -> None:
        pass


def retry_after(stream: DataFrame, limit: int = 5, window: int = 900, delay: str = "10 seconds") -> DataFrame:
    """(client string, time timestamp) → (client, ts, recent, retry_after) for each failure, once the watermark has passed it."""
    rows = stream.select(F.col("client").cast("string").alias("client"), F.unix_timestamp("time").alias("ts"), F.col("time").cast("timestamp").alias("time")).withWatermark("time", delay)
    return rows.groupBy("client").transformWithState(statefulProcessor=Throttle(limit, window), outputStructType=WAITS, outputMode="Append", timeMode="EventTime")


def _started(writer, spark: SparkSession, checkpoint: str) -> StreamingQuery:
    """Start a query over all that is there, with the state store that it needs; the session's settings stay as they were."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of a stream with state to a table."""
    return _started(rows.writeStream.format("parquet").option("path", path).outputMode("append"), rows.sparkSession, checkpoint)
