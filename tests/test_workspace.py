"""The workspace from files to exports, corpora of named entities."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textquarry.operators import ner
from textquarry.workspace import Conflict, Workspace


def raw(spark, *texts):
    return spark.createDataFrame([(t, "text", "", "test") for t in texts], "content string, format string, title string, source string")


def test_datasets(spark, tmp_path):
    lines = [json.dumps({"text": f"text {l} {i}", "label": l}) for l in "ab" for i in range(6)] + [json.dumps({"text": "TEXT a 0", "label": "a"})]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    w = Workspace(spark, str(tmp_path / "w"))
    m = w.prepare(str(tmp_path / "in.jsonl"), "v1").first()
    assert (m.input_rows, m.accepted_rows, m.labels) == (13, 12, ["a", "b"]) and w.dataset("v1").count() == 12
    with pytest.raises(ValueError, match="exists"):
        w.prepare(str(tmp_path / "in.jsonl"), "v1")
    with pytest.raises(ValueError, match="no name"):
        w.prepare(str(tmp_path / "in.jsonl"), "../x")
    rows = w.dataset("v1").filter("split <> 'train'")
    for run, right in (("good", 0.9), ("bad", 0.2)):
        p = F.when(F.col("label") == "a", F.array(F.lit(right), F.lit(1 - right))).otherwise(F.array(F.lit(1 - right), F.lit(right)))
        for split in ("validation", "test"):
            s = w.evaluate(run, "v1", rows.filter(F.col("split") == split).select("source_line", p.alias("p")), split).first()
            assert s.accuracy == (1.0 if run == "good" else 0.0)
    assert [r.run for r in w.compare(["bad", "good"]).collect()] == ["good", "bad"]
    with pytest.raises(ValueError, match="align"):
        w.evaluate("x", "v1", rows.limit(0).select("source_line", F.array(F.lit(1.0)).alias("p")))


def test_documents_to_export(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    text = "肺癌患者中位OS为10个月；中位PFS为5个月。未见阿司匹林。"
    d = w.ingest(raw(spark, text)).first()
    assert w.ingest(raw(spark, text)).first().id == d.id and w.documents().count() == 1
    with pytest.raises(ValueError):
        w.ingest(raw(spark, " "))
    ents = spark.createDataFrame([(d.id, "e0", "肺癌", "dis", 0, 2), (d.id, "e1", "阿司匹林", "sym", text.index("阿"), text.index("阿") + 4)], "doc_id string, id string, text string, type string, start int, end int")
    found = w.extract("x1", ents).collect()
    eid = f"x1:{d.id}"
    rid = next(r.id for r in found if r.category == "efficacy")
    a, b = text.index("中位PFS"), text.index("未见")
    w.review(eid, rid, 0, "approved", "one", {"endpoint": "PFS", "evidence": {"start": a, "end": b, "text": text[a:b]}})
    with pytest.raises(Conflict):
        w.review(eid, rid, 0, "rejected", "two")
    for bad in ({"evidence": {"start": a, "end": b, "text": "x"}}, {"other": 1}):
        with pytest.raises(ValueError):
            w.review(eid, rid, 1, "approved", "one", bad)
    with pytest.raises(KeyError):
        w.review(eid, "r99", 0, "approved", "one")
    w.review(eid, rid, 1, "approved", "two", {"note": "again"})
    w.review(eid, "e0", 0, "rejected", "one", {"type": "dis", "canonical": "肺癌"})
    record = w.records("x1").filter(F.col("id") == rid).first()
    assert (record.text, record.endpoint, record.revision, record.note) == (text[a:b], "PFS", 2, "again") and w.history(eid, rid).count() == 2
    assert w.search("x1", "中位PFS").count() >= 1
    out = w.export("x1")
    assert [r.id for r in out["records"].collect()] == [rid] and out["records"].first().mentions == [] and out["entities"].count() == 0
    everything = w.export("x1", "all")
    assert everything["history"].count() == 2 and everything["records"].count() == len(found)
    assert {r.id: r.context.assertion for r in w.entities("x1").collect()}["e1"] == "negated"


def test_corpus_policies(spark):
    rows = [("dev", 0, "abc def", [(0, 2, "dis")]), ("dev", 1, "bad one", [(0, 2, "zzz")]), ("train", 0, "BAD ONE", [(0, 2, "dis")]), ("train", 1, "ABC DEF", [(0, 2, "dis")]), ("train", 2, "x y", [(1, 1, "dis")]), ("train", 3, "a" * 20, [(0, 14, "dru")])]
    schema = "split string, line int, text string, entities array<struct<start_idx:int,end_idx:int,type:string>>"
    got = {(r.split, r.line): r for r in ner.convert(spark.createDataFrame(rows, schema), ["split", "line"], length=10, stride=4).collect()}
    assert {k: r.reason for k, r in got.items()} == {("dev", 0): None, ("dev", 1): "invalid", ("train", 0): "duplicate", ("train", 1): "duplicate", ("train", 2): "unaligned", ("train", 3): "uncovered"}
    assert [tuple(e) for e in got["dev", 0].entities] == [(0, 3, "dis")]
    judged = spark.createDataFrame([("k", 0, "invalid"), ("k", 1, None), ("k", 2, None)], "key string, line int, reason string")
    assert [r.reason for r in ner.first_copies(judged, ["line"], False).orderBy("line").collect()] == ["invalid", None, "duplicate"]
    assert [r.reason for r in ner.first_copies(judged, ["line"], True).orderBy("line").collect()] == ["invalid", "duplicate", "duplicate"]
    tasks = ner.window_tasks(spark.createDataFrame(rows[5:], schema).withColumn("windows", F.expr("array(named_struct('start', 0, 'end', 10), named_struct('start', 6, 'end', 16))")), "line")
    assert [(r.base, len(r.text)) for r in tasks.orderBy("base").collect()] == [(0, 10), (6, 10)]
    assert ner.too_many_windows(spark.createDataFrame([([1, 2],)], "windows array<int>"), 1).count() == 1


def test_predictors(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(70)], "doc_id int, text string")

    def load():
        return lambda frame: pd.DataFrame({"doc_id": frame.doc_id, "start": 0, "end": frame.text.str.len(), "type": "dis", "score": frame.doc_id.astype(float)})

    schema = "doc_id int, start int, end int, type string, score double"
    makers = {"pandas": lambda config: lambda df: ner.predict_in_batches(df, load, schema)}
    assert ner.predictor_for({"backend": "pandas"}, makers)(rows).count() == 70
    assert ner.predictor_for({"backend": "pandas", "recipe": {"thresholds": {"dis": 9.0}}}, makers)(rows).count() == 60
    with pytest.raises(ValueError):
        ner.predictor_for({"backend": "none"}, makers)
    ner.aligned(rows, rows)
    with pytest.raises(ValueError):
        ner.aligned(rows, rows.limit(3))
