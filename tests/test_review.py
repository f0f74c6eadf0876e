"""The review log, narrowed evidence, exports, search, streams, baselines."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_bindings import parsed
from textquarry.operators import evidence, ml, review
from textquarry.sources.documents import sentences


def log(spark, rows):
    return spark.createDataFrame([("x", r, n, s, json.dumps(p, ensure_ascii=False), "one", f"2026-01-0{n}") for r, n, s, p in rows], review.REVIEWS)


def test_state_and_conflicts(spark):
    reviews = log(spark, [("r0", 1, "approved", {"endpoint": "OS", "normalized_value": "未见"}), ("r0", 2, "rejected", {"note": "no"}), ("r1", 1, "approved", {})])
    state = {r.record_id: r for r in review.latest(reviews, review.RECORD_FIELDS).collect()}
    assert (state["r0"].revision, state["r0"].status, state["r0"].endpoint, state["r0"].note, state["r1"].endpoint) == (2, "rejected", "OS", "no", None)
    assert [r.revision for r in review.history(reviews, "x", "r0").collect()] == [1, 2] and review.conflicts(reviews).count() == 0
    assert review.conflicts(reviews.unionAll(log(spark, [("r1", 1, "rejected", {})]))).count() == 1
    cols = "extraction_id string, record_id string, expected_revision int, status string, payload string, reviewer string, created string"
    incoming = spark.createDataFrame([("x", "r0", 2, "approved", "{}", "a", "t1"), ("x", "r0", 2, "pending", "{}", "b", "t2"), ("x", "r0", 1, "approved", "{}", "c", "t0"), ("x", "r9", 0, "approved", "{}", "d", "t"), ("x", "r9", 0, "maybe", "{}", "d", "t"), ("x", "r8", 0, "approved", "{}", " ", "t")], cols)
    new, bad = review.append(reviews, incoming)
    assert sorted((r.record_id, r.revision, r.reviewer) for r in new.collect()) == [("r0", 3, "a"), ("r9", 1, "d")]
    assert sorted((r.record_id, r.reason) for r in bad.collect()) == [("r0", "revision_changed"), ("r0", "revision_changed"), ("r8", "invalid"), ("r9", "invalid")]


def test_export(spark):
    ents = spark.createDataFrame([("x", f"e{i}", "肺癌", "dis", "肺癌", 0, 2) for i in range(3)], "extraction_id string, id string, text string, type string, canonical string, start int, end int")
    reviews = log(spark, [("e0", 1, "rejected", {"type": "dis", "canonical": "肺癌"}), ("r0", 1, "approved", {})])
    records = spark.createDataFrame([("x", "r0", ["e0", "e1"], "肺癌患者"), ("x", "r1", ["e2"], "服用药物")], "extraction_id string, id string, mentions array<string>, text string")
    state, found = review.reviewed_records(records, reviews), review.reviewed_entities(ents, reviews)
    rows, kept, concepts = review.approved_export(state, found)
    assert [r.id for r in kept.collect()] == ["e1"] and [(r.id, r.mentions, r.omitted_rejected_mentions) for r in rows.collect()] == [("r0", ["e1"], 1)] and concepts.first().mentions == ["e1"]
    assert {(r.record_id, len(r.history)) for r in review.full_export(state, found, reviews)[2].collect()} == {("e0", 1), ("r0", 1)}
    changed = review.reviewed_entities(ents, log(spark, [("e0", 1, "approved", {"type": "pro", "canonical": "免疫治疗"})])).filter("id = 'e0'").first()
    assert (changed.model_type, changed.type, changed.canonical, changed.type_name, changed.revision) == ("dis", "pro", "免疫治疗", "医疗程序", 1)
    c = review.status_counts(state).first()
    assert (c.pending, c.approved, c.rejected) == (1, 1, 0)
    assert review.search(state, "患者").count() == 1 and review.search(state, '" OR 1=1 --').count() == 0 and review.search(state, "肺癌 患者").count() == 1
    with pytest.raises(ValueError):
        review.search(state, "  ")


def test_narrowed_evidence(spark):
    docs = parsed(spark, ["肺癌患者中位OS为10个月；中位PFS为5个月。"])
    text = docs.first().text
    a, b = text.index("中位PFS"), len(text)
    corrections = spark.createDataFrame([(0, a, b, text[a:b]), (0, 0, 1, "x"), (0, 5, 500, "y"), (9, 0, 1, "z")], "doc_id int, start int, end int, text string")
    got = review.evidence_errors(corrections, docs).collect()
    assert sorted((r.start, r.reason or "") for r in got) == [(0, "no_document"), (0, "not_the_source_text"), (5, "invalid_offsets"), (a, "")] and next(r for r in got if not r.reason).block == "b0"
    records = evidence.candidates(sentences(docs, "doc_id")).filter("category IN ('efficacy', 'population')").select("doc_id", "id", "category", F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(text[a:b]).alias("text"), "block", "section", "locator", "kind")
    ents = spark.createDataFrame([(0, "e0", a, a + 2), (0, "e1", 0, 2)], "doc_id int, id string, start int, end int")
    rows = {r.category: r for r in review.rebuilt(records, ents).collect()}
    assert [n.text for n in rows["efficacy"].numbers] == ["5个月"] and [x.endpoint for x in rows["efficacy"].binding_suggestions] == ["PFS"] and rows["efficacy"].mentions == ["e0"]
    assert not rows["population"].numbers and set(rows["population"].qualifiers) == set(evidence.QUALIFIERS)
    reviews = log(spark, [("r0", 1, "approved", {"evidence": {"start": a, "end": b, "text": text[a:b]}}), ("r0", 2, "approved", {"note": "again"})])
    base = spark.createDataFrame([("x", "r0", 0, 5, "old 10个月")], "extraction_id string, id string, start int, end int, text string")
    state = review.reviewed_records(base, reviews).first()
    assert (state.start, state.end, state.text, state.narrowed, state.note) == (a, b, text[a:b], True, "again")
    assert review.search(review.reviewed_records(base, reviews), "10个月").count() == 0


def test_relation_scopes(spark):
    docs = parsed(spark, ["一可能二。三。"])
    flat = docs.select("doc_id", F.inline("blocks"))
    rel = spark.createDataFrame([(0, "a", "b0", 0, 1, 3, 4), (0, "b", "b0", 0, 1, 5, 6)], "doc_id int, relation_id string, block string, s_start int, s_end int, o_start int, o_end int")
    rows = {r.relation_id: r for r in evidence.relation_scopes(rel, sentences(docs, "doc_id"), flat, docs).collect()}
    assert rows["a"].scope_text == "一可能二。" and rows["a"].scope_flags == ["uncertainty"] and rows["b"].scope_text == "一可能二。三。"


def test_throttle(spark):
    rows = spark.createDataFrame([("c", t) for t in (0, 100, 200, 300, 400, 950, 5000)], "client string, ts long")
    assert [(r.ts, r.recent, r.retry_after) for r in review.retry_after(rows).orderBy("ts").collect()][3:] == [(300, 4, 0), (400, 5, 500), (950, 5, 50), (5000, 1, 0)]


def test_streams(spark, tmp_path):
    from textquarry.streaming import ingest

    rows = spark.createDataFrame([("一份。", "text", "", "s"), ("一份。", "text", "", "s"), ("二份。", "text", "", "s"), (" ", "text", "", "s")], "content string, format string, title string, source string")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.store_documents(stream, str(tmp_path / "docs"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "docs")).count() == 2
    q = ingest.distinct_documents(stream, "content").writeStream.format("memory").queryName("distinct_docs").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("distinct_docs").count() == 3
    log(spark, [("r0", 1, "approved", {}), ("r0", 2, "rejected", {})]).write.parquet(str(tmp_path / "log"))
    reviews = spark.readStream.schema(review.REVIEWS).parquet(str(tmp_path / "log"))
    q = ingest.latest_reviews(reviews).writeStream.format("memory").queryName("latest_reviews").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.revision, r.status) for r in spark.table("latest_reviews").collect()] == [(2, "rejected")]


def test_baselines(spark):
    rows = [(f"{w} {i} {'甲' if l == 'a' else '乙'}", l) for i in range(12) for w, l in (("sun", "a"), ("rain", "b"), ("wind", "b"))]
    train = spark.createDataFrame(rows, "text string, label string").cache()
    features = ml.TfIdf(50).fit(train)
    assert len(features.vocabulary) == 50
    held = spark.createDataFrame([("sun 鑫 甲", "a"), ("rain 乙", "b")], train.schema)
    v = features.transform(held).first().features
    assert abs(v.norm(2) - 1) < 1e-9 and not any("鑫" in t for t in ml.TfIdf().fit(train).vocabulary)
    for kind in ("logistic", "linear_svm"):
        predict, labels = ml.train_linear(train, kind)
        got = predict(held).collect()
        assert labels == ["a", "b"] and [r.predicted for r in got] == ["a", "b"] and all(abs(sum(r.p) - 1) < 1e-6 for r in got)
    with pytest.raises(ValueError):
        ml.train_linear(train, "other")
