"""The search index against a scan, appended to and compacted."""

import random

import pytest
from pyspark.sql import functions as F

from textquarry.functions.text import matches_terms
from textquarry.operators import index, review
from textquarry.workspace import Workspace

SCHEMA = "extraction_id string, record_id string, text string, junk int"


def rows(seed, n):
    rnd = random.Random(seed)
    text = lambda: "".join(rnd.choice("abAB é药😀\n ") for _ in range(rnd.randint(0, 60)))
    return [(f"x{i % 3}", f"r{i}", text(), 1) for i in range(n)] + [("x0", f"null{seed}", None, 1), ("x1", f"long{seed}", "ab" * 9000 + "needle" + "é" * 4095 + "pin", 1)]


def test_against_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 16)
    path = f"file://{tmp_path}/index"
    first, second = rows(1, 90), rows(2, 30)
    assert index.segments(spark, path) == []
    for k, part in enumerate((first, second)):
        index.append(spark.createDataFrame([*part, part[0]], SCHEMA), path, k)
    assert index.segments(spark, path) == [0, 1]
    index.compact(spark, path, f"{path}2")
    now = {(r[0], r[1]): r for r in first + second}
    scan = spark.createDataFrame(list(now.values()), SCHEMA).cache()
    for query in ("药", "😀", "aB", "aba", "needle pin", "nothing", "a b é 药"):
        want = sorted(map(tuple, scan.filter(matches_terms(F.col("text"), query)).select("extraction_id", "record_id", "text").collect()))
        for at in (path, f"{path}2")[: 1 + (query == "aba")]:
            assert sorted(map(tuple, index.find(spark, at, query).collect())) == want, query
    assert [r.record_id for r in index.search(spark, path, "a", 2).collect()] == [r.record_id for r in review.search(scan.withColumnRenamed("record_id", "id"), "a", 2).collect()]
    for bad in ("", "  ", "x" * 201):
        with pytest.raises(ValueError):
            index.search(spark, path, bad)
    with pytest.raises(Exception, match="already exists"):
        index.append(spark.createDataFrame(second, SCHEMA), path, 1)
    scan.unpersist()


def test_only_what_is_needed_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 16)
    path = f"file://{tmp_path}/index"
    index.append(spark.createDataFrame(rows(3, 200), SCHEMA), path, 0)
    plan = index.candidates(spark, path, "needle")._jdf.queryExecution().toString()
    assert "shard" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(gram" in plan and "texts" not in plan
    sizes = spark.read.parquet(f"{path}/postings").select(F.size("ids").alias("n"), "gram", "block")
    assert sizes.agg(F.max("n")).first()[0] <= 40 and sizes.filter("gram = 'a'").count() > 8  # a frequent gram is many rows


def test_workspace_search(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/lab")
    text = "The response rate was 40%. Overall survival was longer with the drug, OS 12 months."
    w.ingest(spark.createDataFrame([(text, "text", "t", "s")], "content string, format string, title string, source string"))
    found = w.extract("x").collect()
    assert found and w.search("x", "SURVIVAL longer").count() == sum("survival" in r.text.lower() for r in found) > 0
    r = next(r for r in found if "survival" in r.text.lower())
    at = text.index("Overall survival")
    w.review(r.extraction_id, r.id, 0, "approved", "me", {"evidence": {"start": at, "end": at + 16, "text": "Overall survival"}})
    hit = lambda q: (r.extraction_id, r.id) in {(x.extraction_id, x.record_id) for x in w.search("x", q).collect()}
    assert hit("overall survival") and not hit("longer")
    with pytest.raises(KeyError):
        w.search("y", "survival")


def test_blocks_are_inverted_as_numbers(monkeypatch):
    """Lists of a block equal brute force, however few pairs are sorted and written at once."""
    import pyarrow as pa

    texts = [(b, i, t.lower() if t else None) for b in (0, 2) for i, (_, _, t, _) in enumerate(rows(b, 20)[:20])] + [(2, 99, "\U0010ffff a\x00")]
    want = {}
    for b, i, t in texts:
        for g in {t[k : k + n] for n in (1, 2, 3) for k in range(len(t or "") - n + 1)} if t else ():
            want.setdefault((g, b), []).append(i)
    for run, lists in ((1, 1), (50, 7), (1 << 20, 1 << 16)):
        monkeypatch.setattr(index, "RUN", run)
        monkeypatch.setattr(index, "LISTS", lists)
        batches = [pa.RecordBatch.from_pylist([dict(zip("bit", x)) for x in texts[k : k + 9]], pa.schema([("b", pa.int32()), ("i", pa.int64()), ("t", pa.string())])) for k in range(0, len(texts), 9)]
        got = [(g, b, i) for out in index._inverted(iter(batches)) for g, b, i in zip(*(out.column(k).to_pylist() for k in range(3)))]
        assert {(g, b): i for g, b, i in got} == {k: sorted(v) for k, v in want.items()} and len(got) == len(want)
