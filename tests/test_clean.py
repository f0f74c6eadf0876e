"""Cleaning, splits, sampling, benchmarks, imports."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_intervals import stages
from textquarry.functions import text as tx
from textquarry.operators import clean, relations
from textquarry.operators.ranking import hash_rank
from textquarry.session import stored

SCHEMA = "text string, label string, split string, source_line int"


def labelled(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], SCHEMA)


def good(n=5):
    return [(f"text {l} {i}", l, None) for l in "ab" for i in range(n)]


def test_normalize(spark):
    texts = ["ＡＢＣ　１２３", "a​b", "x\x00\x0b\x0cy\tz\n", "  ﬁ  Straße ", "ŞŠ", "", None, "ⅷ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.normalize("t"), tx.text_key("t"))
    got = [tuple(r) for r in df.collect()]
    assert [g[0] for g in got] == ["ABC 123", "ab", "xy z", "fi Straße", "ŞŠ", "", None, "viii"]
    assert [g[1] for g in got][3] == "fi strasse" and got[4][1] == "şš"


def test_prepare(spark):
    rows = good() + [("ＴＥＸＴ a 0", "a", None), ("", "a", None), ("clash", "a", None), ("CLASH", "b", None), (None, "a", None), ("x", "a", "dev"), ("x" * 20001, "a", None)]
    found = clean.prepare(labelled(spark, rows))
    kept = found.clean.collect()
    assert {r.split for r in kept} == set(clean.SPLITS) and len(kept) == 10
    counts = {(r.label, r.split): r["count"] for r in found.clean.groupBy("label", "split").count().collect()}
    assert counts == {(l, s): {"train": 3}.get(s, 1) for l in "ab" for s in clean.SPLITS}
    assert sorted((r.source_line, r.reason) for r in found.rejected.collect()) == [(11, "normalized_duplicate"), (12, "empty_text_or_label"), (13, "conflicting_labels"), (14, "conflicting_labels"), (15, "text_or_label_no_string"), (16, "unknown_split"), (17, "text_or_label_too_long")]
    again = clean.prepare(labelled(spark, rows).repartition(5)).clean.collect()
    assert {(r.source_line, r.split) for r in again} == {(r.source_line, r.split) for r in kept}


def test_aborts(spark):
    cases = [
        ([("same", "a", "train"), ("SAME", "a", "test"), ("o", "b", "train")], "different splits"),
        ([("u", "a", "train"), ("v", "b", None)], "mixed"),
        ([("u", "a", None), ("v", "a", None)], "two labels"),
        ([("u", "a", None), ("v", "b", None)], "needs 5"),
        ([("u", "a", "train"), ("v", "b", "train"), ("w", "a", "test")], "empty splits"),
        ([("u", "a", "train"), ("v", "a", "validation"), ("w", "b", "test")], "train lacks"),
        ([("", "a", None)], "no valid rows"),
        ([], "empty"),
    ]
    for rows, why in cases:
        with pytest.raises(ValueError, match=why):
            clean.prepare(labelled(spark, rows))
    both = [("same", "a", "train"), ("SAME", "b", "test"), ("u", "a", "train"), ("v", "b", "train"), ("w", "a", "test"), ("z", "b", "validation")]
    assert clean.prepare(labelled(spark, both)).clean.count() == 4  # conflict comes before leakage


def test_held_out_and_benchmark(spark):
    def rows(name, data):
        return spark.createDataFrame([(t, l, name, i) for i, (t, l) in enumerate(data)], "text string, label string, source_file string, source_line int").withColumn("key", tx.text_key("text"))

    test = rows("test", [("dup", "a"), ("DUP", "b"), ("t1", "b")])
    dups = clean.held_out_duplicates(test).collect()
    assert [(r.lines, r.labels, r.conflicting) for r in dups] == [([0, 1], ["a", "b"], True)]
    train = rows("train", [("dup", "a"), ("v", "a"), ("c", "a"), ("C", "b"), ("a1", "a"), ("A1", "a")] + [(f"x{i}", "ab"[i % 2]) for i in range(14)])
    found = clean.fixed_benchmark(train, rows("dev", [("v", "a"), ("t1", "a")]), test, 5, 1729)
    assert {r.split: r["count"] for r in found.clean.groupBy("split").count().collect()} == {"train": 10, "validation": 1, "test": 3}
    assert sorted((r.source_file, r.source_line, r.reason) for r in found.rejected.collect()) == [("dev", 1, "validation_overlaps_test"), ("train", 0, "train_overlaps_held_out"), ("train", 1, "train_overlaps_held_out"), ("train", 2, "train_conflict"), ("train", 3, "train_conflict"), ("train", 5, "train_duplicate")]
    with pytest.raises(ValueError):
        clean.fixed_benchmark(train, rows("dev", []), test, 9, 1)


def test_rank_and_samples(spark):
    rows = spark.range(500).select(F.col("id"), F.when(F.col("id") < 400, "big").otherwise("small").alias("label"), F.col("id").cast("string").alias("key")).repartition(7)
    got = hash_rank(rows, ["label"], F.sha2("key", 256), "key").collect()
    import hashlib

    for label in ("big", "small"):
        own = sorted((hashlib.sha256(r.key.encode()).hexdigest(), r.rank) for r in got if r.label == label)
        assert [k for _, k in own] == list(range(1, len(own) + 1)) and {r.group_size for r in got if r.label == label} == {len(own)}
    assert clean.sample_per_class(rows, 30, 5).count() == 60
    slices = clean.budget_slices(rows, {"validation": 20, "test": 40}, 7)
    assert {r.split: r["count"] for r in slices.groupBy("split").count().collect()} == {"validation": 20, "test": 40}


def test_variants(spark):
    text = "一二三四五六七八九十甲乙丙"
    df = spark.createDataFrame([(text,), ("ab",), ("a,b;c(d):",), ("x" * 50,)], "t string")
    got = df.select(tx.punctuated(F.col("t")), tx.truncated(F.col("t")), tx.thinned(F.col("t"), 1, F.col("t")), tx.full_width(F.col("t")), tx.perturbed(F.col("t"), "clean_subset")).collect()
    assert got[0][0] == "一二三四五六，七八九十甲乙，丙" and got[0][1] == text[: int(13 * 0.7)] and len(got[0][2]) == 12 and got[1][2] == "ab" and got[1][1] == "a"
    assert got[2][3] == "a，b；c（d）：" and len(got[3][2]) == 50 - 2 and got[3][4] == "x" * 50  # half to even
    with pytest.raises(ValueError):
        tx.perturbed(F.col("t"), "other")
    rows = labelled(spark, good(6))
    stress = clean.stress_subset(rows, 3).collect()
    assert {m: sum(r["mode"] == m for r in stress) for m in {r["mode"] for r in stress}} == dict.fromkeys(("clean_subset", "punctuation", "char_delete_5pct", "tail_truncate_30pct"), 6)
    assert len({(r.source_line) for r in stress}) == 6 and all(r.text == r.original_text for r in stress if r["mode"] == "clean_subset")


def test_verify(spark):
    from textquarry.sources.sinks import fingerprint

    rows = clean.prepare(labelled(spark, good())).clean
    prints = {r.split: r.fingerprint for r in fingerprint(rows.select("text", "label", "split", "source_line"), "split").collect()}
    clean.verify_dataset(rows, ["a", "b"], prints)
    with pytest.raises(ValueError, match="changed"):
        clean.verify_dataset(rows.withColumn("text", F.concat("text", F.lit("x"))), ["a", "b"], prints)
    with pytest.raises(ValueError, match="labels"):
        clean.verify_dataset(rows, ["a"], prints)


SPO = "text string, spo_list array<struct<subject:string,subject_type:string,predicate:string,object:map<string,string>,object_type:map<string,string>>>, split string, source_line int"


def test_records(spark):
    schema = relations.schema_items(relations.schema_frame(spark, [("works", "person", {"@value": "firm", "since": "year"}), ("born", "person", {"@value": "place"})]))
    assert [(r.id, r.label) for r in schema.orderBy("id").collect()] == [(0, "born"), (1, "works"), (2, "works / since")]
    relation = lambda s, p, o, t: {"subject": s, "subject_type": "person", "predicate": p, "object": o, "object_type": t}
    ok = relation("安娜", "works", {"@value": "工厂", "since": "2001"}, {"@value": "firm", "since": "year"})
    data = [("😀安娜在工厂工作，2001年。安娜", [ok, ok], None, 1), ("安娜", [], None, 2), ("安娜", [ok], None, 3), ("安娜 工厂", [relation("安娜", "loves", {"@value": "工厂"}, {"@value": "firm"})], None, 4), (" ", [ok], None, 5), ("工厂", [ok], None, 6)]
    got = {r.source_line: r for r in relations.convert_records(spark.createDataFrame(data, SPO), schema, "source_line").collect()}
    assert [tuple(t) for t in got[1].triples] == [(1, 3, "person", 1, 4, 6, "firm"), (1, 3, "person", 2, 9, 13, "year")] and got[1].ambiguous_mentions == 2
    assert [got[i].reason for i in range(2, 7)] == ["empty_text_or_no_relations", "object_not_in_text", "not_in_schema", "empty_text_or_no_relations", "subject_not_in_text"]
    ents = relations.entities(spark.createDataFrame([(1, *t) for t in got[1].triples], "doc_id int, s_start int, s_end int, s_type string, rel int, o_start int, o_end int, o_type string"), "doc_id")
    assert sorted((r.start, r.end, r.type) for r in ents.collect()) == [(1, 3, "person"), (4, 6, "firm"), (9, 13, "year")]
    with pytest.raises(ValueError):
        relations.check_schema(relations.schema_frame(spark, []))


def test_import(spark):
    schema = relations.schema_frame(spark, [("p", "A", {"@value": "B"})])
    one = lambda i: [{"subject": f"s{i}", "subject_type": "A", "predicate": "p", "object": {"@value": f"o{i}"}, "object_type": {"@value": "B"}}]
    data = [(f"s{i} with o{i}", one(i) if i != 3 else [], None, i) for i in range(28)] + [("S5 with O5", one(5), None, 50), ("s6 with o6", one(6), None, 51), ("s9 bad", one(9), None, 52), ("", [], None, 53), ("no list", None, None, 54)]
    found = relations.import_records(spark.createDataFrame(data, SPO), schema)
    audit = sorted((r.source_line, r.reason) for r in found.rejected.collect())
    assert audit == [(50, "subject_not_in_text"), (51, "normalized_duplicate"), (52, "object_not_in_text"), (53, "no_text"), (54, "no_annotation")]
    assert {r.split: r["count"] for r in found.clean.groupBy("split").count().collect()} == {"train": 22, "validation": 2, "test": 4}
    leak = [(f"s{i} with o{i}", one(i), ("train", "validation", "test")[i % 3], i) for i in range(24)] + [("s1 with o1", one(1), "train", 90)]
    with pytest.raises(ValueError, match="different splits"):
        relations.import_records(spark.createDataFrame(leak, SPO), schema)
    with pytest.raises(ValueError, match="there must be 20"):
        relations.import_records(spark.createDataFrame(data[:5], SPO), schema)
    clash = data + [("s7 with o7", [], None, 60)]
    assert relations.import_records(spark.createDataFrame(clash, SPO), schema).clean.count() == 27
    bad = spark.createDataFrame([("ab", [(0, 3, "A", 0, 0, 1, "B")]), ("cd", [(0, 1, "X", 0, 1, 2, "B")]), ("ef", [(0, 1, "A", 0, 1, 2, "B")])], "text string, triples array<struct<s_start:int,s_end:int,s_type:string,rel:int,o_start:int,o_end:int,o_type:string>>")
    assert sorted((r.text, r.reason) for r in relations.verify_records(bad, relations.schema_items(schema)).collect()) == [("ab", "bad_offsets"), ("cd", "against_schema")]


def test_decoding(spark):
    schema = relations.schema_items(relations.schema_frame(spark, [("p", "A", {"@value": "B"}), ("q", "A", {"@value": "A"})]))
    scores = spark.createDataFrame([(1, 0, 0, 0, 2.0), (1, 1, 2, 3, 1.0), (1, 1, 3, 2, 9.0), (1, 0, 1, 1, 9.0), (1, 0, 0, 3, -1.0)], "doc_id int, type_id int, first int, last int, logit double")
    offsets = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 2), (1, 2, 3, 4), (1, 3, 5, 7)], "doc_id int, token int, start int, end int")
    found = relations.candidate_entities(scores, offsets)
    assert sorted((r.start, r.end, r.type_id, r.capped) for r in found.collect()) == [(0, 2, 0, False), (3, 7, 1, False)]
    capped = relations.candidate_entities(scores, offsets, cap=1).collect()
    assert len(capped) == 1 and capped[0].capped and capped[0].logit == 2.0
    ents = found.select("doc_id", "first", "last", "start", "end", F.when(F.col("type_id") == 0, "A").otherwise("B").alias("type"), F.col("logit").alias("score"))
    links = spark.createDataFrame([(1, "head", 0, 0, 2, 0.5), (1, "tail", 0, 0, 3, 0.4), (1, "head", 1, 0, 0, 3.0)], "doc_id int, kind string, rel int, i int, j int, logit double")
    triples = relations.decode_joint(ents, links, schema).collect()
    assert [(t.s_start, t.s_end, t.rel, t.o_start, t.o_end, t.score) for t in triples] == [(0, 2, 0, 3, 7, 0.4)]
    assert relations.decode_joint(ents, links.filter("kind = 'head'"), schema).count() == 0
    assert sorted(t.rel for t in relations.decode_joint(ents, links, schema, use_tail=False).collect()) == [0, 1]
    pairs = spark.createDataFrame([(1, 0, 2, 3, 7, 0, 0.7), (1, 3, 7, 0, 2, 0, 5.0)], "doc_id int, s_start int, s_end int, o_start int, o_end int, rel int, logit double")
    assert [(t.rel, t.score) for t in relations.decode_pairs(ents, pairs, schema).collect()] == [(0, 0.7)]
    e = spark.createDataFrame([(1, 0, 0, 2, "A", 1.0), (1, 10, 0, 2, "A", 3.0), (1, 8, 2, 4, "A", 5.0)], "doc_id int, base int, start int, end int, type string, score double")
    t = spark.createDataFrame([(1, 8, 0, 2, "A", 1, 2, 4, "A", 0.5)], "doc_id int, base int, s_start int, s_end int, s_type string, rel int, o_start int, o_end int, o_type string, score double")
    ents, triples = relations.merge_windows(e, t)
    assert sorted((r.start, r.end, r.score) for r in ents.collect()) == [(0, 2, 1.0), (10, 12, 5.0)]
    texts = spark.createDataFrame([(1, "abcdefgh12ij")], "doc_id int, text string")
    ents2, rels = relations.extraction(texts, ents.unionByName(spark.createDataFrame([(1, 8, 10, "A", 60.0)], "doc_id int, start int, end int, type string, score double")), triples, schema)
    r = rels.first()
    assert (r.subject, r.object, r.subject_text, r.object_text, r.label) == ("e1", "e2", "12", "ij", "q") and math.isclose(r.confidence, 1 / (1 + math.exp(-0.5)))
    assert max(x.confidence for x in ents2.collect()) == 1 / (1 + math.exp(-50))
    groups = relations.group_relations(rels.unionAll(rels.withColumn("subject", F.lit("e9")).withColumn("confidence", F.lit(0.9))), "doc_id").collect()
    assert len(groups) == 1 and groups[0].confidence == 0.9 and len(groups[0].mention_links) == 2


def test_negatives_and_dictionary(spark):
    rows = [(1, i < 3, i) for i in range(200)] + [(2, True, i) for i in range(70)] + [(2, False, 100)] + [(3, False, i) for i in range(10)]
    kept = relations.spread_negatives(spark.createDataFrame(rows, "doc_id int, positive boolean, n int"), "n").collect()
    import numpy as np

    want = [range(3, 200)[i] for i in np.linspace(0, 196, 61, dtype=int)]
    assert sorted(r.n for r in kept if r.doc_id == 1 and not r.positive) == want and sum(r.doc_id == 2 for r in kept) == 70 and sum(r.doc_id == 3 for r in kept) == 10
    train = spark.createDataFrame([("aab", 0, 2, "x")] * 3 + [("aab", 1, 2, "x")] * 9 + [("aab", 0, 3, "y")] * 2, "text string, start int, end int, type string")
    lexicon = relations.dictionary(train)
    assert [(r.term, r.type, r.support) for r in lexicon.collect()] == [("aa", "x", 3)]
    texts = spark.createDataFrame([(1, "aaaa"), (2, "b"), (3, "")], "doc_id int, text string")
    assert sorted((r.doc_id, r.start, r.end) for r in relations.dictionary_matches(texts, lexicon).collect()) == [(1, 0, 2), (1, 1, 3), (1, 2, 4)]
    assert relations.dictionary_matches(texts, lexicon.limit(0)).collect() == []


def test_spans(spark):
    from textquarry.functions import spans

    rnd = random.Random(1)
    text = "".join(rnd.choice("ab😀 é1") for _ in range(60)) + "12"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(spans.regex_spans(F.col("t"), r"\d+|é")).first()[0]
    import re

    assert [(s.start, s.end, s.text) for s in got] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"\d+|é", text)]
    assert df.select(spans.count_of(F.lit("aaaa"), F.lit("aa")), spans.first_at(F.lit("x😀y"), F.lit("y")), spans.occurrences(F.lit("aaaa"), F.lit("aa"))).first() == (2, 2, [0, 1, 2])
    toks = df.select(spans.character_tokens(F.lit("a b😀"))).first()[0]
    assert [(t.start, t.end) for t in toks] == [(0, 1), (2, 3), (3, 4)]
    win = df.select(spans.token_windows(spans.character_tokens(F.lit("abcdefghij")), 4, 2), spans.token_windows(spans.character_tokens(F.lit("abc")), 4, 2), spans.token_windows(spans.character_tokens(F.lit(" ")), 4, 2)).first()
    assert [[(w.start, w.end) for w in x] for x in win] == [[(0, 4), (2, 6), (4, 8), (6, 10)], [(0, 3)], []]


def test_short_passages_are_found(spark):
    items = ["What is the capital of France?", "capital", "the cap", "ital of Fra", "is the capital of", "a b c d e f g", "the  capital", "首都是哪里", "never there", "not in any of these", "What", "of"]
    texts = ["Tell me: What is the capital of France? Paris.", "What is the capital of\nFrance?", "capitals", "x a b c d e f gh", "the  capital", "问：首都是哪里？", "", None, "of"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    passages = spark.createDataFrame([*enumerate(items), (90, ""), (91, " "), (92, None)], "item_id int, text string")
    want = sorted((d, i) for d, t in enumerate(texts) for i, p in enumerate(items) if t and p in t)
    assert sorted(map(tuple, clean.contained_passages(docs, passages).collect())) == want and (0, 0) in want
    assert clean.contained_passages(docs, passages.limit(0)).collect() == []


def test_keys_in_steps_equal_whole_ones():
    """Texts are normalised a few at a time; ASCII that normalisation leaves as it is takes a shorter way."""
    import unicodedata

    import pyarrow as pa
    import pyarrow.compute as pc

    from textquarry.functions import text as tx

    texts = ["Plain Text", None, "", " lead", "trail ", "two  spaces", "a\tb\nc", "bell\x07", "Straße ﬁ", "soft­hyphen", "wide　space", "x" * 50, "\x7f", "İ"]

    def whole(t):
        a = pc.replace_substring_regex(pa.array([None if t is None else unicodedata.normalize("NFKC", t)], pa.string()), r"\p{Cf}", "")
        a = pc.replace_substring_regex(a, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
        return pc.utf8_trim(pc.replace_substring_regex(a, tx.WHITE, " "), " ")[0].as_py()

    for step in (1, 20, 1 << 20):
        sizes = []
        got = tx.in_steps(pa.array(texts, pa.string()), lambda a: (sizes.append(len(a)), tx._folded(a))[1], step)
        assert got.to_pylist() == [None if t is None else whole(t).casefold() for t in texts]
        assert step > 20 or max(sizes) < len(texts)


def test_candidates_dealt_out_by_rows(spark, monkeypatch):
    """Joins and ranks run over as many partitions as the rows ask for, with the same candidates."""
    from textquarry import session
    from textquarry.plans import extraction

    assert session.parts(spark.range(1000), 10) == 100 and session.parts(spark.range(10), 10) == spark.sparkContext.defaultParallelism
    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, extraction.topk_candidates_capped(spark, sf).collect()))
    monkeypatch.setattr(extraction, "parts", lambda rows: 37)
    found = extraction.topk_candidates_capped(spark, sf)
    assert found.rdd.getNumPartitions() == 37 and sorted(map(tuple, found.collect())) == want


def test_prepare_keeps_texts_out_of_memory(spark):
    """Eight megabytes of texts: checks cached them twice, beside their keys, and shuffled them with the facts of their groups."""
    text = F.concat(*(F.sha2(F.concat("id", F.lit(f"-{k}")), 256) for k in range(32)))
    rows = spark.range(4000).select(text.alias("text"), (F.col("id") % 3).cast("string").alias("label"), F.lit(None).cast("string").alias("split"), F.col("id").alias("source_line"))
    cached = lambda: sum(i.memSize() + i.diskSize() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo())
    before = cached(), sum(s.shuffleWriteBytes() for s in stages(spark))
    found = clean.prepare(rows)
    assert found.clean.groupBy("split").count().count() == 3 and found.rejected.count() == 0
    assert cached() == before[0] and sum(s.shuffleWriteBytes() for s in stages(spark)) - before[1] < 8_000_000
    kept = found.clean.join(rows.select("source_line", F.col("text").alias("given")), "source_line")
    assert kept.filter("text = given").count() == 4000 and set(found.clean.columns) == {"text", "label", "split", "source_line"}


def test_stored(spark):
    rows = spark.createDataFrame([(1, None), (2, "b")], "id int, t string")
    assert sorted(stored(rows).collect()) == sorted(rows.collect())
    assert stored(rows.limit(0)).schema == rows.schema and stored(rows.limit(0)).count() == 0
