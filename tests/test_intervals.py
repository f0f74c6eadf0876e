"""Interval joins against all pairs, and in time on one document with very many spans."""

import random
import time

from pyspark.sql import functions as F

from textquarry.operators import intervals
from textquarry.operators.intervals import first_holding, holding, level, overlapping

SCHEMA = "doc_id int, start int, end int, name string"


def some(seed, n, longest=60):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a = rnd.randrange(200)
        rows.append((rnd.randrange(3), a, a + rnd.choice([1, 2, 3, 8, 16, rnd.randrange(1, longest)]), f"{seed}-{i % (n - 3)}"))
    return rows + [(0, 5, 5, "empty"), (0, None, 5, "null"), (None, 1, 9, "no key"), (1, 0, 4096, f"{seed}-all")]


def real(rows):
    return [r for r in rows if None not in r and r[1] < r[2]]


def names(pairs):
    return sorted((p.left.doc_id, p.left.start, p.left.end, p.left.name, p.right.start, p.right.end, p.right.name) for p in pairs.collect())


def test_against_all_pairs(spark):
    left, right = some(1, 90), some(2, 120, 25)
    a, b = (spark.createDataFrame(x, SCHEMA).repartition(3) for x in (left, right))
    pairs = [(x, y) for x in real(left) for y in real(right) if x[0] == y[0]]
    shown = lambda found: sorted((*x, *y[1:]) for x, y in found)
    assert names(holding(a, b)) == shown((x, y) for x, y in pairs if x[1] <= y[1] and y[2] <= x[2])
    assert names(overlapping(a, b)) == shown((x, y) for x, y in pairs if max(x[1], y[1]) < min(x[2], y[2]))
    assert names(overlapping(a, b, rising=True)) == shown((x, y) for x, y in pairs if x[1] < y[1] < x[2])
    own = [(x, y) for x in real(left) for y in real(left) if x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2])]
    assert names(overlapping(a, a)) == shown(own) and names(overlapping(a, a, rising=True)) == shown((x, y) for x, y in own if x[1] < y[1])
    assert overlapping(a.limit(0), b).count() == 0 and overlapping(a, b.limit(0)).count() == 0
    got = sorted(((r.doc_id, r.start, r.end, r.name), r.held_by and tuple(r.held_by)) for r in first_holding(b, a).filter("doc_id IS NOT NULL AND start IS NOT NULL").collect())
    holders = lambda y: [x for x, z in pairs if z == y and x[1] <= y[1] and y[2] <= x[2]]
    order = lambda x: (x[1], x[2], x[0], x[3])
    assert got == sorted((y, min(holders(y), key=order, default=None)) for y in right if None not in y)
    assert first_holding(b, a).count() == len(right)
    assert first_holding(b, a.limit(0)).filter("held_by IS NOT NULL").count() == 0 and holding(a.limit(0), b).count() == 0


def test_level(spark):
    rows = spark.range(1, 70).select("id", level(F.col("id")).alias("k")).collect()
    assert all(2**r.k >= r.id and (r.k == 0 or 2 ** (r.k - 1) < r.id) for r in rows)


def test_one_large_document(spark):
    """10^5 spans a side in one document: all pairs would be 10^10. Nested holders would be 10^10 pairs too, but one first each."""
    spans = lambda step, length: spark.range(100_000).select(F.lit(1).alias("doc_id"), (F.col("id") * step).alias("start"), (F.col("id") * step + length).alias("end"), F.col("id").alias("name"))
    began = time.perf_counter()
    assert overlapping(spans(10, 10), spans(10, 12)).count() == 199_999
    assert holding(spans(10, 10), spans(10, 4)).count() == 100_000
    nested = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("start"), (F.lit(10**7) - F.col("id")).alias("end"), F.col("id").alias("name"))
    found = first_holding(spans(10, 4).withColumn("start", F.col("start") + 100_000).withColumn("end", F.col("end") + 100_000), nested)
    assert found.filter("held_by.name = 0").count() == 100_000
    assert time.perf_counter() - began < 60


def test_overlap_of_many_lengths(spark, monkeypatch):
    """Spans below and beyond the least level, by keys of two types and with other columns, packed and sent in small steps."""
    monkeypatch.setattr(intervals, "WIDE", 4)
    monkeypatch.setattr(intervals, "ROWS", 50)
    monkeypatch.setattr(intervals, "PAIRS", 7)
    left, right = some(3, 200), some(4, 150, 150)
    a, b = (spark.createDataFrame(x, SCHEMA).repartition(3) for x in (left, right))
    b = b.select(F.col("doc_id").cast("long").alias("doc_id"), "start", "end", "name", F.lit(1.5).alias("more"))
    pairs = [(x, y) for x in real(left) for y in real(right) if x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2])]
    assert names(overlapping(a, b)) == sorted((*x, *y[1:]) for x, y in pairs)
    assert names(overlapping(b, a, rising=True)) == sorted((*y, *x[1:]) for x, y in pairs if y[1] < x[1])


def test_overlap_shuffles_little(spark):
    """Two million words: each was written in up to eleven rows of a hundred bytes; now a span is sent once and packed."""
    words = spark.range(2_000_000).select((F.col("id") / 500).cast("long").alias("doc_id"), (F.col("id") % 500 * 6).cast("int").alias("start"), (F.col("id") % 500 * 6 + 8).cast("int").alias("end"))
    written = lambda: sum(s.shuffleWriteBytes() for s in stages(spark))
    before = written()
    assert overlapping(words, words, rising=True).count() == 2_000_000 - 4_000
    assert written() - before < 16_000_000


def stages(spark):
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]
