"""Golden cases of endpoint bindings, context and aliases."""

import pytest
from pyspark.sql import functions as F

from textquarry.operators import alias, context, evidence
from textquarry.sources.documents import parse_documents, sentences

M = "个月"
CASES = [
    # one endpoint, its value and unit; an arm named in the clause
    ("全体患者的OS为14.5个月。", [("OS", 14.5, M, None)]),
    ("随访后，乙组中位PFS达6.4个月。", [("PFS", 6.4, M, "乙组")]),
    ("放疗组ORR达到35%，中位OS为21个月。", [("ORR", 35.0, "%", "放疗组"), ("OS", 21.0, M, None)]),
    # two values side by side, told apart only if two arms stand side by side and the text says so
    ("A组与B组的中位PFS分别为9.1和7.3个月。", [("PFS", 9.1, M, "A组"), ("PFS", 7.3, M, "B组")]),
    ("甲组和乙组ORR分别为31%与28%。", [("ORR", 31.0, "%", "甲组"), ("ORR", 28.0, "%", "乙组")]),
    ("二组ORR分别为12%和18%。", [("ORR", 12.0, "%", None), ("ORR", 18.0, "%", None)]),
    ("甲组和乙组PFS为3个月和2个月。", [("PFS", 3.0, M, None), ("PFS", 2.0, M, None)]),
    ("ORR为44% versus 39%。", [("ORR", 44.0, "%", None), ("ORR", 39.0, "%", None)]),
    ("中位PFS为5.2 vs. 4.8个月。", [("PFS", 5.2, M, None), ("PFS", 4.8, M, None)]),
    # names and units in other spellings
    ("中位总生存期达到30周。", [("OS", 30.0, "周", None)]),
    ("无进展生存期为200天。", [("PFS", 200.0, "天", None)]),
    ("缓解率为18％。", [("ORR", 18.0, "%", None)]),
    # adverse events, with an expansion or a count before the percentage
    ("安慰剂组总体不良事件发生率为9.5%。", [("总体不良事件发生率", 9.5, "%", "安慰剂组")]),
    ("试验组≥3级TEAEs发生率为3.3%。", [("≥3级TEAEs发生率", 3.3, "%", "试验组")]),
    ("试验组总体不良反应（adverse reactions, ARs）发生率为41%。", [("总体不良反应", 41.0, "%", "试验组")]),
    ("安慰剂组任意等级AEs为7例（21.5%）。", [("任意等级AEs", 21.5, "%", "安慰剂组")]),
    # nothing is bound without a connector, a number or a fitting unit
    ("安慰剂组AEs为7例。", []),
    ("两药OS无差异，P=0.41。", []),
    ("中位PFS尚未达到。", []),
    ("中位OS未达到24个月。", []),
    ("中位PFS为7。", []),
    ("中位PFS为40%。", []),
    ("客观缓解率为3周。", []),
    ("中位PFS为2个月和9天。", []),
    ("中位OS分别为4个月和5个月和6个月。", []),
    ("共入组66例，缓解率未统计。", []),
    ("PFS获益者改用20mg制剂。", []),
    # what stands between two endpoints isn't bound to either
    ("PFS为3个月，随访时间20个月，OS为15个月。", [("PFS", 3.0, M, None), ("OS", 15.0, M, None)]),
]
REASONS = {
    "中位PFS为7。": "missing_or_mixed_units",
    "中位PFS为2个月和9天。": "missing_or_mixed_units",
    "中位PFS为40%。": "endpoint_unit_mismatch",
    "中位OS分别为4个月和5个月和6个月。": "more_than_two_parallel_values",
    "PFS获益者改用20mg制剂。": "no_explicit_value_connector",
}
CONTEXTS = [
    ("😀胸片未发现结核，然而仍有低热。", [("结核", "dis"), ("低热", "sym")], ["negated", "unmarked"]),
    ("疑似胃炎，却没有腹痛。", [("胃炎", "dis"), ("腹痛", "sym")], ["uncertain", "negated"]),
    ("无头痛；否认呕吐。", [("头痛", "sym"), ("呕吐", "sym")], ["negated", "negated"]),
    # what looks like a cue and isn't one
    ("无进展的胃炎，两组腹痛无明显差异。", [("胃炎", "dis"), ("腹痛", "sym")], ["unmarked", "unmarked"]),
    ("无论是否有胃炎都应随访。", [("胃炎", "dis")], ["unmarked"]),
    ("有无结核尚待无创检查确认。", [("结核", "dis")], ["unmarked"]),
    # a cue after its entity, near or too far; a list; the next sentence
    ("结核涂片阴性。", [("结核", "dis")], ["negated"]),
    ("结核相关的多项检验结果阴性。", [("结核", "dis")], ["unmarked"]),
    ("未出现胃炎、结核。", [("胃炎", "dis"), ("结核", "dis")], ["negated", "negated"]),
    ("未出现胃炎。结核患者入组。", [("结核", "dis")], ["unmarked"]),
    # an outcome is denied, not the disease; a type that the cue doesn't speak of
    ("没有延长胃炎病程。", [("胃炎", "dis")], ["unmarked"]),
    ("未见结核进展。", [("结核", "dis")], ["unmarked"]),
    ("未见好转，口服布洛芬。", [("布洛芬", "dru")], ["unmarked"]),
    ("可能无结核。", [("结核", "dis")], ["conflicting"]),
]


def parsed(spark, texts, kind="text"):
    rows = [(i, t, kind, "", "test") for i, t in enumerate(texts)]
    return parse_documents(spark.createDataFrame(rows, "doc_id int, content string, format string, title string, source string"))


def placed(spark, cases):
    rows = [(d, f"e{i}", term, kind, text.index(term), text.index(term) + len(term)) for d, (text, terms, *_) in enumerate(cases) for i, (term, kind) in enumerate(terms)]
    return spark.createDataFrame(rows, "doc_id int, id string, text string, type string, start int, end int")


def test_bindings(spark):
    from textquarry.operators.binding import suggestions

    docs = parsed(spark, ["😀前言。" + t for t, _ in CASES]).cache()
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = sentences(docs, "doc_id").withColumn("s", suggestions(F.col("text"), F.col("start"), F.col("kind"))).filter("start > 0").collect()
    got = {i: [] for i in range(len(CASES))}
    for r in sorted(rows, key=lambda r: r.start):
        for b in r.s.bindings:
            got[r.doc_id].append((b.endpoint, b.value, b.unit, b.arm.text if b.arm else None))
            assert b.status == "pending"
            for ref in (b.endpoint_reference, b.value_reference, b.arm):
                assert ref is None or text[r.doc_id][ref.start : ref.end] == ref.text
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]
    reasons = {CASES[r.doc_id][0]: [a.reason for a in r.s.abstentions] for r in rows}
    assert {t: reasons[t] for t in REASONS} == {t: [why] for t, why in REASONS.items()}
    assert reasons["中位PFS尚未达到。"][0] in ("no_explicit_value_connector", "non_numeric_or_unreached_endpoint")


def test_intervals_tables_and_counts(spark):
    from textquarry.operators.binding import Sentence

    text = "甲组随访中。中位OS达到18.6（95%CI: 15.2-22.8）个月。PFS为4.4（95%CI: 3.7-NR）个月。"
    rows = sentences(parsed(spark, [text]), "doc_id").orderBy("start").collect()
    one, two = (Sentence(r.text, r.start).suggest(r.kind)["bindings"][0] for r in rows[1:])
    assert one["arm"] is None and one["interval"] == {"lower": 15.2, "upper": 22.8} and two["interval"] == {"lower": 3.7, "upper": None}
    assert Sentence("中位PFS为5个月", 20).suggest("table_row") == {"bindings": [], "abstentions": [{"reason": "table_headers_not_bound", "endpoint": None}]}
    counted = Sentence("乙组任意等级AEs为19例（38.0%）。", 0).suggest(None)["bindings"][0]
    assert counted["count"] == 19 and counted["count_reference"] == {"text": "19", "start": 10, "end": 12}


def test_candidates(spark):
    docs = parsed(spark, ["中位PFS为6个月，AEs发生率为33%。", "😀ORR为51.2%，P=0.03。未发生严重不良反应。"])
    rows = {(r.doc_id, r.category): r for r in evidence.candidates(sentences(docs, "doc_id")).collect()}
    assert [b.endpoint for b in rows[0, "efficacy"].binding_suggestions] == ["PFS"] and [b.endpoint for b in rows[0, "adverse_event"].binding_suggestions] == ["AEs发生率"]
    assert rows[1, "adverse_event"].qualifiers["negation"][0].text == "未发生" and [n.text for n in rows[1, "efficacy"].numbers] == ["51.2%", "P=0.03"]
    assert all(r.status == "pending" and set(r.qualifiers) == set(evidence.QUALIFIERS) for r in rows.values())
    assert {r.id for (d, _), r in rows.items() if d == 0} == {f"r{i}" for i in range(sum(d == 0 for d, _ in rows))}


def test_numeric_atoms(spark):
    literals = ["HR=0.84", "95%CI: 0.71-1.3", "9.25个月", "P＜0.01", "18.6（95%CI: 15.2-22.8）个月", "95%CI: 3.7-NR", "18％", "19例", "61岁", "7mg", "0.2μg", "abc", "8周"]
    df = spark.createDataFrame([(x,) for x in literals], "x string").select("x", evidence.numeric_atom(F.col("x")).alias("a"))
    got = {r.x: r.a for r in df.collect()}
    assert (got["HR=0.84"].kind, got["HR=0.84"].measure, got["HR=0.84"].operator, got["HR=0.84"].value, got["HR=0.84"].unit) == ("effect_estimate", "HR", "=", 0.84, None)
    assert got["95%CI: 0.71-1.3"].kind == "confidence_interval" and got["95%CI: 0.71-1.3"].interval.upper == 1.3
    assert got["9.25个月"].kind == "duration" and got["P＜0.01"].operator == "<" and got["P＜0.01"].kind == "p_value"
    both = got["18.6（95%CI: 15.2-22.8）个月"]
    assert both.value == 18.6 and both.unit == M and both.interval.lower == 15.2
    assert got["95%CI: 3.7-NR"].interval.upper is None and got["95%CI: 3.7-NR"].interval.lower == 3.7
    assert [got[x].kind for x in ("18％", "19例", "61岁", "7mg", "0.2μg", "abc", "8周")] == ["percentage", "count", "age", "dose", "dose", "unparsed", "duration"] and got["18％"].unit == "%"


def test_context(spark):
    docs = parsed(spark, [t for t, *_ in CONTEXTS]).cache()
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = context.entity_context(placed(spark, CONTEXTS), sentences(docs, "doc_id")).collect()
    got = {(r.doc_id, r.id): r.context for r in rows}
    for d, (_, terms, want) in enumerate(CONTEXTS):
        assert [got[d, f"e{i}"].assertion for i in range(len(terms))] == want, text[d]
        for i in range(len(terms)):
            for m in [*got[d, f"e{i}"].modifiers, *got[d, f"e{i}"].blocked_modifiers]:
                assert text[d][m.cue_start : m.cue_end] == m.cue


def test_family_history_and_gates(spark):
    cases = [("父亲曾患胃炎，本人腹痛。", [("胃炎", "dis"), ("腹痛", "sym")]), ("否认GERD。", [("GERD", "dis")]), ("未见布洛芬。", [("布洛芬", "sym")])]
    docs = parsed(spark, [t for t, _ in cases])
    rows = {(r.doc_id, r.id): r.context for r in context.entity_context(placed(spark, cases), sentences(docs, "doc_id")).collect()}
    assert (rows[0, "e0"].temporality, rows[0, "e0"].experiencer) == ("historical", "family") and (rows[0, "e1"].temporality, rows[0, "e1"].assertion) == ("unmarked", "unmarked")
    assert rows[1, "e0"].assertion == "unmarked" and rows[1, "e0"].blocked_modifiers[0].reason == "unverified_disease_surface" and rows[2, "e0"].assertion == "negated"
    named = placed(spark, cases).withColumn("canonical", F.when(F.col("text") == "GERD", "胃食管反流病").otherwise(F.col("text"))).withColumn("type", F.when(F.col("text") == "布洛芬", "dru").otherwise(F.col("type")))
    rows = {(r.doc_id, r.id): r.context for r in context.entity_context(named, sentences(docs, "doc_id")).collect()}
    assert rows[1, "e0"].assertion == "negated" and rows[1, "e0"].blocked_modifiers == [] and rows[2, "e0"].modifiers == []
    alone = placed(spark, [("一。二。", [("一。二", "dis")])])
    assert context.entity_context(alone, sentences(parsed(spark, ["一。二。"]), "doc_id")).first().context.assertion == "unassigned"


def test_provenance(spark):
    docs = parsed(spark, ["我们的研究重复了ORIENT-11[8]。中位PFS为6个月。本研究随访两年。另见[4, 6-9]。"])
    rows = sentences(docs, "doc_id").withColumn("p", evidence.provenance(F.col("text"), F.col("start"))).orderBy("start").collect()
    assert [r.p.scope for r in rows] == ["mixed_cues", "unassigned", "current_study_cue", "cited_study_cues"]
    text = docs.first().text
    assert all(text[c.start : c.end] == c.text for r in rows for c in r.p.cues) and [c.category for c in rows[0].p.cues] == ["current_study", "named_trial", "citation"]


def test_aliases(spark):
    text = "胃食管反流病（gastroesophageal reflux disease, GERD）。GERD患者。OS（HR=0.84, 95%CI: 0.71-1.3, P=0.4），抑酸治疗（HR）。"
    docs = spark.createDataFrame([(0, text)], "doc_id int, text string")
    at = text.index("GERD患者")
    ents = spark.createDataFrame([(0, "e0", "胃食管反流病", "dis", 0, 6), (0, "e1", "GERD", "dis", at, at + 4), (0, "e2", "OS", "dis", text.index("OS（"), text.index("OS（") + 2), (0, "e3", "反流病", "dis", 3, 6), (0, "e4", "抑酸治疗", "pro", text.index("抑酸"), text.index("抑酸") + 4)], "doc_id int, id string, text string, type string, start int, end int")
    found = alias.abbreviations(docs, ents).collect()
    assert [(r.alias, r.canonical) for r in found] == [("GERD", "胃食管反流病")] and text[found[0].start : found[0].end].endswith("GERD）")
    rows = {r.id: r for r in alias.normalized(docs, ents).collect()}
    assert rows["e0"].concept_id == rows["e1"].concept_id and rows["e1"].normalization == "explicit_alias" and rows["e0"].normalization == "exact_surface"
    import hashlib

    assert rows["e0"].concept_id == "local:" + hashlib.sha256("dis\0胃食管反流病".encode()).hexdigest()[:16]
    glossary = lambda p: spark.createDataFrame([("另一疾病", "dis", ["GERD"], p)], "canonical string, type string, aliases array<string>, provenance string")
    rows = {r.id: r for r in alias.normalized(docs, ents, glossary("test")).collect()}
    assert rows["e1"].normalization == "ambiguous" and rows["e1"].canonical == "GERD" and len(rows["e1"].candidates) == 2
    with pytest.raises(ValueError, match="provenance"):
        alias.normalized(docs, ents, glossary(None))
    groups = {r.canonical: r.mentions for r in alias.concepts(alias.normalized(docs, ents), "doc_id").collect()}
    assert groups["胃食管反流病"] == ["e0", "e1"]
