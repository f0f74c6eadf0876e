"""Parsing, offsets, sentences, readers and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_bindings import parsed
from textquarry.sources import readers, sinks
from textquarry.sources.documents import concatenated, sentences

XML = """<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><article-meta><article-id pub-id-type="doi">10.0/x</article-id><title-group><article-title>一篇<b>小</b>文</article-title></title-group>
<permissions><license xlink:href="http://terms.invalid"><p>open</p></license></permissions>
<abstract xml:lang="zh"><sec><title>要点</title><p>😀胃炎患者18例，P=0.4。</p></sec></abstract><trans-abstract>In short</trans-abstract></article-meta></front>
<body><sec><title>随访</title><p>无人退出。</p><table-wrap><caption><p>两组比较</p></caption><table><tr><th>组</th><th>人数</th></tr><tr><td>甲</td><td>18例</td></tr></table></table-wrap>
<sec><p>Deeper.</p><boxed-text><p>二</p></boxed-text></sec></sec></body><back><ref-list><ref><p>只在文献里</p></ref></ref-list></back></article>"""


def test_article(spark):
    d = parsed(spark, [XML], "jats").first()
    assert json.loads(d.metadata["article_ids"]) == {"doi": "10.0/x"} and d.metadata["title"] == "一篇小文" and json.loads(d.metadata["licenses"])[0]["href"] == "http://terms.invalid"
    assert "只在文献里" not in d.text and [(b.kind, b.text) for b in d.blocks if b.kind != "paragraph"] == [("table_caption", "两组比较"), ("table_row", "组 | 人数"), ("table_row", "甲 | 18例")]
    assert [b.section for b in d.blocks] == ["摘要 / zh / 要点", "摘要 / unspecified", "正文 / 随访", "正文 / 随访", "正文 / 随访", "正文 / 随访", "正文 / 随访 / section", "正文 / 随访 / section"]
    assert d.blocks[2].locator == "body/sec[1]/p[2]" and d.blocks[4].locator == "body/sec[1]/table-wrap[3]/tr[1]"
    assert all(d.text[b.start : b.end] == b.text for b in d.blocks) and [b.id for b in d.blocks] == [f"b{i}" for i in range(len(d.blocks))]
    found = sentences(parsed(spark, [XML], "jats"), "doc_id").collect()
    assert "😀胃炎患者18例，P=0.4。" in [s.text for s in found] and all(d.text[s.start : s.end] == s.text for s in found)


def test_refused(spark):
    bad = ["<!DOCTYPE article [<!ENTITY e 'y'>]><article/>", "<!doctype article><article/>", "<book/>", "<article>", "<article/>", " "]
    errors = [r.error for r in parsed(spark, bad, "jats").orderBy("doc_id").collect()]
    assert "DTD" in errors[0] and "DTD" in errors[1] and "root" in errors[2] and "malformed" in errors[3] and "paragraphs" in errors[4] and "characters" in errors[5]
    ok = '<!DOCTYPE article SYSTEM "journal.dtd"><article><body><p>只有一段。</p></body></article>'
    assert parsed(spark, [ok], "jats").first().text == "只有一段。"
    assert "formats" in parsed(spark, ["x"], "pdf").first().error and "characters" in parsed(spark, ["x" * 500_001]).first().error


def test_plain_text(spark):
    text = "前言\n\n## 方法 \n 用药 5.5mg. Then more. and 1.5 x\r\n结果\nDone!? Yes。\n"
    d = parsed(spark, [text]).first()
    assert [(b.text, b.section, b.locator) for b in d.blocks] == [("前言", "正文", "line:1"), ("## 方法", "方法", "line:3"), ("用药 5.5mg. Then more. and 1.5 x", "方法", "line:4"), ("结果", "结果", "line:5"), ("Done!? Yes。", "结果", "line:6")]
    found = [s.text for s in sentences(parsed(spark, [text]), "doc_id").orderBy("start").collect()]
    assert found == ["前言", "## 方法", "用药 5.5mg.", "Then more. and 1.5 x", "结果", "Done!?", "Yes。"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿text,label,split\n"a, ""q""",x,train\n,y,\n"two\nlines",z,test\n', encoding="utf-8")
    rows = readers.read_records(spark, str(tmp_path / "a.csv")).orderBy("source_line").collect()
    assert [(r.text, r.label, r.split, r.source_line) for r in rows] == [('a, "q"', "x", "train", 2), ("", "y", None, 3), ("two\nlines", "z", "test", 4)]
    (tmp_path / "b.csv").write_text("text,other\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_records(spark, str(tmp_path / "b.csv"))
    with pytest.raises(ValueError):
        readers.read_records(spark, str(tmp_path / "b.txt"))
    (tmp_path / "a.jsonl").write_text('﻿{"text":"a","label":"x"}\n\n{"text":5,"label":"x","split":"test"}\n{"text":"c","label":null,"split":3}\n', encoding="utf-8")
    rows = readers.read_records(spark, str(tmp_path / "a.jsonl")).orderBy("source_line").collect()
    assert [(r.text, r.label, r.split, r.source_line) for r in rows] == [("a", "x", None, 1), (None, "x", "test", 3), ("c", None, "?", 4)]
    (tmp_path / "bad.jsonl").write_text('{"text":"a","label":"x"}\n{oops\n')
    with pytest.raises(ValueError, match="line 2"):
        readers.read_records(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "c.json").write_text('\n [{"a":1},{"a":2}]')
    (tmp_path / "d.json").write_text('{"a":1}\n{"a":2}\n')
    assert [r.a for p in "cd" for r in readers.read_json_any(spark, str(tmp_path / f"{p}.json"), "a int").collect()] == [1, 2, 1, 2]
    (tmp_path / "t.txt").write_text("one\ttwo\t1\nthree\t0\n")
    assert [(r.text, r.label) for r in readers.read_tsv_labels(spark, str(tmp_path / "t.txt"), ["n", "p"]).orderBy("source_line").collect()] == [("one\ttwo", "p"), ("three", "n")]
    (tmp_path / "u.txt").write_text("one\t2\n")
    with pytest.raises(ValueError):
        readers.read_tsv_labels(spark, str(tmp_path / "u.txt"), ["n", "p"])
    import hashlib

    got = readers.verify_bytes(spark, str(tmp_path / "u.txt")).first()
    assert got.sha256 == hashlib.sha256(b"one\t2\n").hexdigest() and got.git_sha1 == hashlib.sha1(b"blob 6\0one\t2\n").hexdigest()
    for n in ("r1", "r2"):
        (tmp_path / "runs" / n).mkdir(parents=True)
        (tmp_path / "runs" / n / "run.json").write_text('{"status":"completed"}')
    assert [r.run for r in readers.read_runs(spark, str(tmp_path / "runs/*/run.json"), "status string").collect()] == ["r2", "r1"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", "train", 1), ("b", "y", "test", 2), ("c", "x", "validation", 3)], "text string, label string, split string, source_line int")
    one = {r.split: r.fingerprint for r in sinks.fingerprint(rows.repartition(3), "split").collect()}
    assert one == {r.split: r.fingerprint for r in sinks.fingerprint(rows.coalesce(1).orderBy(F.desc("text")), "split").collect()}
    assert one != {r.split: r.fingerprint for r in sinks.fingerprint(rows.withColumn("text", F.upper("text")), "split").collect()}
    assert {r.split: r.fingerprint for r in sinks.write_splits(rows, str(tmp_path / "v1")).collect()} == one
    with pytest.raises(Exception, match="already exists"):
        sinks.write_splits(rows, str(tmp_path / "v1"))
    m = sinks.manifest(rows, spark.createDataFrame([(9, "why")], "source_line int, reason string")).first()
    assert (m.input_rows, m.accepted_rows, m.labels, m.counts["train"], m.reasons, m.split_sha256) == (4, 3, ["x", "y"], {"x": 1}, {"why": 1}, one)
    docs = parsed(spark, ["一份文献。", "一份文献。", "另一份。"]).drop("doc_id")
    first = sinks.add_documents(spark, docs, str(tmp_path / "docs"))
    assert first.count() == 2 and sinks.add_documents(spark, docs, str(tmp_path / "docs")).count() == 2
    details = rows.withColumn("correct", F.col("label") == "x")
    sinks.save_evaluation(details, rows.groupBy().count(), str(tmp_path / "eval"))
    assert spark.read.parquet(str(tmp_path / "eval/errors")).count() == 1


def test_concatenated(spark):
    rows = spark.createDataFrame([(1, 0, "ab"), (1, 1, "😀"), (1, 2, "c")], "d int, n int, t string")
    assert [(r.start, r.end) for r in concatenated(rows, "d", "n", "t").orderBy("n").collect()] == [(0, 2), (3, 4), (5, 6)]
