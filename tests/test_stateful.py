"""Streams with state against their batch forms, for several cuts into micro-batches."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from textquarry.operators import review
from textquarry.streaming import stateful

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def fed(spark, rows, schema, cuts, path):
    for part in cuts:
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("sizes", [(40,), (13, 1, 26)])
def test_reviews(spark, tmp_path, sizes):
    rnd = random.Random(1)
    rows = [("x", f"r{rnd.randrange(4)}", rnd.choice([0, 0, 1, 1, 2, 3]), rnd.choice([*review.STATUSES, "odd"]), "{}", rnd.choice(["me", "you", " ", None]), f"{i:04d}") for i in range(40)]
    cuts, at = [], 0
    for n in sizes:
        cuts.append(range(at, at + n))
        at += n
    stream = fed(spark, rows, "extraction_id string, record_id string, expected_revision int, status string, payload string, reviewer string, created string", cuts, f"{tmp_path}/in")
    stateful.store_reviews(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    now, accepted, refused = {}, [], []
    for _, record, expected, status, _, reviewer, created in rows:
        if status not in review.STATUSES or not (reviewer or "").strip():
            refused.append((created, "invalid"))
        elif expected != now.get(record, 0):
            refused.append((created, "revision_changed"))
        else:
            now[record] = expected + 1
            accepted.append((created, expected + 1))
    got = spark.read.parquet(f"{tmp_path}/out/reviews")
    assert sorted((r.created, r.revision) for r in got.collect()) == accepted and accepted
    assert sorted((r.created, r.reason) for r in spark.read.parquet(f"{tmp_path}/out/conflicts").collect()) == refused
    assert review.conflicts(got).count() == 0


def test_throttle(spark, tmp_path):
    """Failures that come out of order, within the delay, wait as they do in the batch form."""
    rnd = random.Random(2)
    rows = [(rnd.choice("abc"), START + timedelta(seconds=rnd.randrange(4000))) for _ in range(90)] + [(None, START)]
    shuffled = list(range(91))
    rnd.shuffle(shuffled)
    rows.append(("end", START + timedelta(days=3)))
    stream = fed(spark, rows, "client string, time timestamp", [shuffled[:50], shuffled[50:], [91]], f"{tmp_path}/in")
    stateful.stored(stateful.retry_after(stream, 3, 600, "2 hours"), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(stateful.WAITS).parquet(f"{tmp_path}/out").filter("client IN ('a', 'b', 'c')").collect())
    batch = review.retry_after(spark.createDataFrame(rows, "client string, time timestamp").select("client", F.unix_timestamp("time").alias("ts")), 3, 600)
    assert got == sorted((r.client, r.ts, r.recent, r.retry_after) for r in batch.filter("client IN ('a', 'b', 'c')").collect()) and any(r[3] for r in got)
    assert spark.conf.get(next(iter(stateful.STORE)), None) != stateful.STORE[next(iter(stateful.STORE))]


def test_throttle_reads_its_state_once_for_all_due_seconds():
    class State:
        def __init__(self):
            self.rows, self.reads = [], 0

        def get(self):
            self.reads += 1
            return iter(list(self.rows))

        def put(self, rows):
            self.rows = list(rows)

        def appendList(self, rows):
            self.rows += rows

    class Value:
        now = None
        exists = lambda self: self.now is not None
        get = lambda self: self.now

        def update(self, now):
            self.now = now

    class Handle:
        getListState = lambda self, *_: State()
        getValueState = lambda self, *_: Value()
        registerTimer = lambda self, at: timers.append(at)

    timers, late = [], type("Times", (), {"getCurrentWatermarkInMs": lambda self: 2_001_000})()
    throttle = stateful.Throttle(2, 10)
    throttle.init(Handle())
    assert list(throttle.handleInputRows(("a",), [type("R", (), {"ts": t})() for t in range(3000)], None)) == []
    served = list(throttle.handleExpiredTimer(("a",), late, None))
    assert [r.ts for r in served] == list(range(2001)) and throttle.times.reads == 1
    assert served[0].retry_after == 0 and served[-1].recent == 10 and served[-1].retry_after == 1
    assert timers[-1] == 2_002_000 and len(throttle.times.rows) < 1020
