"""Queries over texts that are made from the driver's tables by templates.

The tables hold no annotated reports, articles or records. So each row of ``part`` becomes one, from a template that
its key chooses and with the row's own numbers and names; the SQL says what such a text holds, from the columns alone.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators import alias, context, evidence, ner, relations, review, selection, thresholds
from textquarry.operators.binding import suggestions
from textquarry.session import load, spread
from textquarry.sources.documents import parse_documents, sentences

N = lambda k=0: ("n", k)  # noqa: E731  the row's number, and so much more


class Template:
    """Parts of a text: literal ones and numbers."""

    def __init__(self, *parts):
        self.parts = parts

    def column(self):
        return F.concat(*(F.lit(p) if isinstance(p, str) else (F.col("p_size") + p[1]).cast("string") for p in self.parts))

    def until(self, i: int):
        """The length of the first i parts, as a column."""
        return reduce(lambda a, b: a + b, (F.lit(len(p)) if isinstance(p, str) else F.length((F.col("p_size") + p[1]).cast("string")) for p in self.parts[:i]), F.lit(0)).cast("int")

    def at(self, i: int, more: int = 0) -> str:
        """Where part i begins, as SQL."""
        n = sum(len(p) for p in self.parts[:i] if isinstance(p, str)) + more
        return f"({' + '.join([str(n), *(f'length((p_size + {p[1]})::VARCHAR)' for p in self.parts[:i] if not isinstance(p, str))])})::INTEGER"


def reports(spark, sf, templates: list[Template]) -> DataFrame:
    """(doc_id, m, p_size, text): a text for each row of part."""
    rows = load(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % len(templates)).cast("int").alias("m"), "p_size")
    rows = spread(rows)
    return rows.withColumn("text", F.coalesce(*(F.when(F.col("m") == i, t.column()) for i, t in enumerate(templates))))


def parsed(rows: DataFrame, kind: str = "text") -> DataFrame:
    raw = rows.select("doc_id", F.col("text").alias("content"), F.lit(kind).alias("format"), F.lit("").alias("title"), F.lit("templates").alias("source"))
    return parse_documents(raw)


def marked(spark, sf, templates: list[Template], places: list[list[tuple[int, str]]]) -> DataFrame:
    """(doc_id, id, start, end, type, text): the parts that are entities."""
    rows = reports(spark, sf, templates)
    of = [F.when(F.col("m") == m, F.array(*(F.struct(F.lit(f"e{i}").alias("id"), templates[m].until(k).alias("start"), templates[m].until(k + 1).alias("end"), F.lit(kind).alias("type")) for i, (k, kind) in enumerate(own)))) for m, own in enumerate(places) if own]
    return rows.withColumn("_e", F.coalesce(*of)).select("doc_id", "text", F.inline("_e")).select("doc_id", "id", "start", "end", "type", F.expr("substring(text, start + 1, end - start)").alias("text"))


def union(templates: list[Template], rows: list[list[dict[str, str]]]) -> str:
    """SQL of the rows that each template gives: column → expression."""
    return " UNION ALL ".join(f"SELECT p_partkey AS doc_id, {', '.join(f'{v} AS {k}' for k, v in r.items())} FROM part WHERE p_partkey % {len(templates)} = {m}" for m, own in enumerate(rows) for r in own)


def text(value: str | None) -> str:
    return "NULL::VARCHAR" if value is None else f"'{value}'"


# --- endpoints and their values

ENDPOINTS = [
    Template("第", N(), "例。", "甲组", "中位PFS为", N(), "个月。"),
    Template("第", N(), "例。", "甲组", "与乙组ORR分别为", N(), "%和", N(1), "%。"),
    Template("第", N(), "例。", "OS为", N(), "周，随访后PFS为", N(2), "周。"),
    Template("第", N(), "例。", "中位OS为", N(), "%。"),
    Template("第", N(), "例。", "甲组", "任意等级AEs为", N(), "例（", N(3), "%）。"),
    Template("第", N(), "例。", "中位PFS为", N(), "。"),
    Template("第", N(), "例。", "中位PFS尚未达到", N(), "个月。"),
]


def _bound(m: int, endpoint: str, k: int, unit: str, statistic="reported", arm=None, place=None, count=None) -> dict[str, str]:
    t = ENDPOINTS[m]
    return {
        "endpoint": text(endpoint), "statistic": text(statistic), "value": f"(p_size + {t.parts[k][1]})::DOUBLE", "unit": text(unit), "value_start": t.at(k), "value_end": t.at(k + 1, len(unit)), "arm": text(arm),
        "parallel_position": "NULL::INTEGER" if place is None else f"{place}::INTEGER", "count": "NULL::DOUBLE" if count is None else f"(p_size + {t.parts[count][1]})::DOUBLE",
    }


BOUND = [
    [_bound(0, "PFS", 5, "个月", "median", "甲组")],
    [_bound(1, "ORR", 5, "%", arm="甲组", place=0), _bound(1, "ORR", 7, "%", arm="乙组", place=1)],
    [_bound(2, "OS", 4, "周"), _bound(2, "PFS", 6, "周")],
    [],
    [_bound(4, "任意等级AEs", 7, "%", arm="甲组", count=5)],
    [],
    [],
]


def _suggested(spark, sf):
    return sentences(parsed(reports(spark, sf, ENDPOINTS)), "doc_id").withColumn("s", suggestions(F.col("text"), F.col("start"), F.col("kind")))


def endpoint_bindings(spark, sf):
    b = _suggested(spark, sf).select("doc_id", F.explode("s.bindings").alias("b"))
    return b.select("doc_id", "b.endpoint", "b.statistic", "b.value", "b.unit", F.col("b.value_reference.start").alias("value_start"), F.col("b.value_reference.end").alias("value_end"), F.col("b.arm.text").alias("arm"), "b.parallel_position", "b.count")


def endpoint_abstentions(spark, sf):
    a = _suggested(spark, sf).select("doc_id", F.explode("s.abstentions").alias("a"))
    return a.select("doc_id", "a.reason", F.col("a.endpoint.text").alias("endpoint"), F.col("a.endpoint.start").alias("start"))


REFUSED = {3: ("endpoint_unit_mismatch", "中位OS"), 5: ("missing_or_mixed_units", "中位PFS"), 6: ("no_explicit_value_connector", "中位PFS")}
ARMS = [[(3, "dru")] if m in (0, 1, 4) else [] for m in range(len(ENDPOINTS))]
#: Numbers and bindings of each template's sentence.
COUNTS = [(1, 1), (2, 2), (2, 2), (1, 0), (2, 1), (0, 0), (1, 0)]


def evidence_of_reports(spark, sf):
    found = evidence.candidates(sentences(parsed(reports(spark, sf, ENDPOINTS)), "doc_id"), marked(spark, sf, ENDPOINTS, ARMS))
    return found.select("doc_id", "id", "category", "start", "end", F.size("numbers").alias("numbers"), F.size("binding_suggestions").alias("bindings"), F.array_join("mentions", ",").alias("mentions"), F.size(F.col("qualifiers")["negation"]).alias("negations"), "status")


def extraction_counters(spark, sf):
    found = sentences(parsed(reports(spark, sf, ENDPOINTS)), "doc_id")
    ents = context.entity_context(marked(spark, sf, ENDPOINTS, ARMS), found)
    counts = selection.extraction_counters(evidence.candidates(found), ents)
    return counts.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("records", "bindings", "explicit_arms", "cited_or_mixed", "negative_efficacy", "entities", "modified", "blocked")))


def sentence_spans(spark, sf):
    return sentences(parsed(reports(spark, sf, ENDPOINTS)), "doc_id").select("doc_id", "start", "end", "text", "section", "locator", "kind")


def _sentence_rows(m: int, t: Template) -> list[dict[str, str]]:
    whole = " || ".join(f"'{p}'" if isinstance(p, str) else f"(p_size + {p[1]})::VARCHAR" for p in t.parts)
    base = {"section": "'正文'", "locator": "'line:1'", "kind": "'paragraph'"}
    return [{"\"start\"": "0", "\"end\"": t.at(3), "text": f"substr({whole}, 1, {t.at(3)})"} | base, {"\"start\"": t.at(3), "\"end\"": t.at(len(t.parts)), "text": f"substr({whole}, {t.at(3)} + 1)"} | base]


# --- assertion, time and experiencer of entities

CONTEXTS = [
    Template("第", N(), "例。", "未见", "结核", "，", "然而有", "低热", "。"),
    Template("第", N(), "例。", "疑似", "胃炎", "。"),
    Template("第", N(), "例。", "父亲", "曾患", "胃炎", "，", "本人", "腹痛", "。"),
    Template("第", N(), "例。", "没有", "延长", "胃炎", "病程", "。"),
    Template("第", N(), "例。", "结核", "涂片", "阴性", "。"),
    Template("第", N(), "例。", "结核", "病史", "。"),
    Template("第", N(), "例。", "有无", "结核", "，", "口服", "布洛芬", "。"),
]
ENTITIES = [[(4, "dis"), (7, "sym")], [(4, "dis")], [(5, "dis"), (8, "sym")], [(5, "dis")], [(3, "dis")], [(3, "dis")], [(4, "dis"), (7, "dru")]]
#: assertion, temporality, experiencer, modifiers, blocked modifiers of each.
STATES = [
    [("negated", "unmarked", "unmarked", 1, 0), ("unmarked", "unmarked", "unmarked", 0, 0)],
    [("uncertain", "unmarked", "unmarked", 1, 0)],
    [("unmarked", "historical", "family", 2, 0), ("unmarked", "unmarked", "unmarked", 0, 0)],
    [("unmarked", "unmarked", "unmarked", 0, 1)],
    [("negated", "unmarked", "unmarked", 1, 0)],
    [("unmarked", "historical", "unmarked", 1, 0)],
    [("unmarked", "unmarked", "unmarked", 0, 0)] * 2,
]
#: category, cue part, first and last part of the scope.
MODIFIERS = [[("negated", 3, 4, 5)], [("uncertain", 3, 4, 5)], [("historical", 4, 5, 6), ("family", 3, 4, 6)], [("negated", 3, 4, 7)], [("negated", 5, 3, 5)], [("historical", 4, 3, 4)], []]


def entity_contexts(spark, sf):
    found = sentences(parsed(reports(spark, sf, CONTEXTS)), "doc_id")
    rows = context.entity_context(marked(spark, sf, CONTEXTS, ENTITIES), found)
    return rows.select("doc_id", "id", "text", "context.assertion", "context.temporality", "context.experiencer", F.size("context.modifiers").alias("modifiers"), F.size("context.blocked_modifiers").alias("blocked"))


def context_modifiers(spark, sf):
    m = reports(spark, sf, CONTEXTS).select("doc_id", F.explode(context.modifiers(F.col("text"))).alias("m"))
    return m.select("doc_id", "m.category", "m.direction", "m.cue", "m.cue_start", "m.cue_end", "m.scope_start", "m.scope_end")


def _modifier(t: Template, category: str, cue: int, a: int, b: int) -> dict[str, str]:
    return {"category": text(category), "direction": text("forward" if a > cue else "backward"), "cue": text(t.parts[cue]), "cue_start": t.at(cue), "cue_end": t.at(cue + 1), "scope_start": t.at(a), "scope_end": t.at(b)}


def relation_scope_flags(spark, sf):
    """A relation between the two ends of each report that has two entities, and the flags of the sentence around it."""
    ents = marked(spark, sf, CONTEXTS, ENTITIES).groupBy("doc_id").agg(F.min("start").alias("s_start"), F.min("end").alias("s_end"), F.max("start").alias("o_start"), F.max("end").alias("o_end"))
    docs = parsed(reports(spark, sf, CONTEXTS))
    rels = ents.select("doc_id", F.lit("x").alias("relation_id"), F.lit("b0").alias("block"), "s_start", "s_end", "o_start", "o_end")
    found = evidence.relation_scopes(rels, sentences(docs, "doc_id"), docs.select("doc_id", F.inline("blocks")), docs.select("doc_id", "text"))
    return found.select("doc_id", "scope_start", "scope_end", F.array_join("scope_flags", ",").alias("flags"))


FLAGS = ["negation", "", "", "negation", "", "", ""]

# --- sources, numbers

STUDIES = [Template("我们的研究", "纳入", N(), "例。"), Template("参见", "[", N(), "]。"), Template("本研究与", "ORIENT-", N(), "结果一致。"), Template("共", N(), "例。")]
SCOPES = [("current_study_cue", 1), ("cited_study_cues", 1), ("mixed_cues", 2), ("unassigned", 0)]


def provenance_scopes(spark, sf):
    rows = reports(spark, sf, STUDIES).withColumn("p", evidence.provenance(F.col("text")))
    return rows.select("doc_id", F.col("p.scope").alias("scope"), F.size("p.cues").alias("cues"), F.array_min(F.transform("p.cues", lambda c: c["start"])).alias("first_start"), F.array_max(F.transform("p.cues", lambda c: c["end"])).alias("last_end"))


CUE_ENDS = [("0", STUDIES[0].at(1)), (STUDIES[1].at(1), STUDIES[1].at(3, 1)), ("0", STUDIES[2].at(3)), ("NULL::INTEGER", "NULL::INTEGER")]

NUMBERS = [Template("HR=", N(), ".5，差异。"), Template("年龄", N(), "岁，口服", N(1), "mg。"), Template("P＜0.0", N(), "。"), Template("随访", N(), "（95%CI: ", N(1), "-", N(5), "）个月。"), Template("有效", N(), "％。")]


def _number(kind, value, a, b, measure=None, operator=None, unit=None, lower="NULL::DOUBLE", upper="NULL::DOUBLE"):
    return {"kind": text(kind), "measure": text(measure), "operator": text(operator), "value": value, "unit": text(unit), "\"start\"": a, "\"end\"": b, "lower": lower, "upper": upper}


ATOMS = [
    [_number("effect_estimate", "p_size + 0.5::DOUBLE", "0", NUMBERS[0].at(2, 2), "HR", "=")],
    [_number("age", "p_size::DOUBLE", NUMBERS[1].at(1), NUMBERS[1].at(2, 1), unit="岁"), _number("dose", "(p_size + 1)::DOUBLE", NUMBERS[1].at(3), NUMBERS[1].at(4, 2), unit="mg")],
    [_number("p_value", "('0.0' || p_size)::DOUBLE", "0", NUMBERS[2].at(2), "P", "<")],
    [_number("duration", "p_size::DOUBLE", NUMBERS[3].at(1), NUMBERS[3].at(6, 3), unit="个月", lower="(p_size + 1)::DOUBLE", upper="(p_size + 5)::DOUBLE")],
    [_number("percentage", "p_size::DOUBLE", NUMBERS[4].at(1), NUMBERS[4].at(2, 1), unit="%")],
]


def numbers_in_reports(spark, sf):
    x = reports(spark, sf, NUMBERS).select("doc_id", F.inline(evidence.numbers(F.col("text")))).select("doc_id", "start", "end", "normalized.*")
    return x.select("doc_id", "kind", "measure", "operator", "value", "unit", "start", "end", "interval.lower", "interval.upper")


# --- names

ALIASES = [Template("慢性病", N(), "（disease, ", "CD", N(), "）。", "CD", N(), "患者。"), Template("胃炎", "（P）。", "胃炎", N(), "例。")]


def _names(spark, sf):
    """Entities: the name with its number and the alias; the plain name twice."""
    rows = reports(spark, sf, ALIASES)
    t, u = ALIASES
    pair = lambda *ends: F.array(*(F.struct(F.lit(f"e{i}").alias("id"), a.alias("start"), b.alias("end")) for i, (a, b) in enumerate(ends)))
    one, two = pair((t.until(0), t.until(2)), (t.until(6), t.until(8))), pair((u.until(0), u.until(1)), (u.until(2), u.until(3)))
    ents = rows.select("doc_id", "text", F.inline(F.when(F.col("m") == 0, one).otherwise(two)))
    return rows.select("doc_id", "text"), ents.select("doc_id", "id", "start", "end", F.lit("dis").alias("type"), F.expr("substring(text, start + 1, end - start)").alias("text"))


def abbreviations(spark, sf):
    return alias.abbreviations(*_names(spark, sf)).select("doc_id", "alias", "canonical", "type", "start", "end")


def normalized_entities(spark, sf):
    glossary = load(spark, sf, "region").limit(1).select(F.lit("胃黏膜炎").alias("canonical"), F.lit("dis").alias("type"), F.array(F.lit("胃炎")).alias("aliases"), F.lit("fixed").alias("provenance"))
    rows = alias.normalized(*_names(spark, sf), glossary)
    return rows.select("doc_id", "id", "canonical", "normalization", "concept_id")


def _concept(name: str) -> str:
    return f"'local:' || substr(sha256('dis' || chr(0) || {name}), 1, 16)"


# --- documents

def articles(spark, sf):
    """Blocks of an article for each row of part."""
    part = load(spark, sf, "part")
    tags = ["<article><front><article-meta><title-group><article-title>", "p_name", "</article-title></title-group><abstract xml:lang=\"en\"><p>", "p_type", "</p></abstract></article-meta></front><body><sec><title>", "p_brand", "</title><p>", "p_name", "<i> of </i>", "p_brand", "</p><table-wrap><caption><p>", "p_type", "</p></caption><table><tr><th>size</th><th>", "p_size", "</th></tr></table></table-wrap></sec></body><back><ref-list><ref><p>unread</p></ref></ref-list></back></article>"]
    xml = F.concat(*(F.col(t).cast("string") if t.startswith("p_") else F.lit(t) for t in tags))
    docs = parsed(part.select(F.col("p_partkey").alias("doc_id"), xml.alias("text")), "jats")
    return docs.select("doc_id", F.col("metadata")["title"].alias("title"), F.inline("blocks")).select("doc_id", "title", "id", "text", "section", "kind", "locator", "start", "end")


ARTICLE_SQL = """WITH b AS (SELECT p_partkey AS doc_id, p_name AS title, unnest([
{'k': 0, 't': p_type, 's': '摘要 / en', 'kind': 'paragraph', 'l': 'article-meta/abstract[1]/p[1]'}, {'k': 1, 't': p_name || ' of ' || p_brand, 's': '正文 / ' || p_brand, 'kind': 'paragraph', 'l': 'body/sec[1]/p[2]'},
{'k': 2, 't': p_type, 's': '正文 / ' || p_brand, 'kind': 'table_caption', 'l': 'body/sec[1]/table-wrap[3]/caption'}, {'k': 3, 't': 'size | ' || p_size, 's': '正文 / ' || p_brand, 'kind': 'table_row', 'l': 'body/sec[1]/table-wrap[3]/tr[1]'}]) AS x FROM part),
p AS (SELECT doc_id, title, x, (sum(length(x.t) + 1) OVER (PARTITION BY doc_id ORDER BY x.k))::INTEGER AS e FROM b)
SELECT doc_id, title, 'b' || x.k AS id, x.t AS text, x.s AS section, x.kind AS kind, x.l AS locator, (e - length(x.t) - 1)::INTEGER AS "start", (e - 1)::INTEGER AS "end" FROM p"""


def text_blocks(spark, sf):
    """Blocks of a plain text with headings."""
    part = load(spark, sf, "part")
    docs = parsed(part.select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit("\n\n## 方法 \n  "), "p_type", F.lit("\r\n结果\n"), "p_brand", F.lit("\n")).alias("text")))
    return docs.select("doc_id", "sha256", F.inline("blocks")).select("doc_id", "sha256", "id", "text", "section", "locator", "start", "end")


TEXT_SQL = """WITH b AS (SELECT p_partkey AS doc_id, sha256(p_name || chr(10) || '## 方法' || chr(10) || p_type || chr(10) || '结果' || chr(10) || p_brand) AS sha256, unnest([
{'k': 0, 't': p_name, 's': '正文', 'l': 'line:1'}, {'k': 1, 't': '## 方法', 's': '方法', 'l': 'line:3'}, {'k': 2, 't': p_type, 's': '方法', 'l': 'line:4'}, {'k': 3, 't': '结果', 's': '结果', 'l': 'line:5'}, {'k': 4, 't': p_brand, 's': '结果', 'l': 'line:6'}]) AS x FROM part),
p AS (SELECT doc_id, sha256, x, (sum(length(x.t) + 1) OVER (PARTITION BY doc_id ORDER BY x.k))::INTEGER AS e FROM b)
SELECT doc_id, sha256, 'b' || x.k AS id, x.t AS text, x.s AS section, x.l AS locator, (e - length(x.t) - 1)::INTEGER AS "start", (e - 1)::INTEGER AS "end" FROM p"""


# --- reviews

def reviewed_entities(spark, sf):
    """Entities of parts; a third has a revision that sets the type, another a second one that rejects."""
    part = load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit("x").alias("extraction_id"), F.col("p_name").alias("text"), F.lit("dis").alias("type"))
    k = F.col("id").cast("long")
    base = part.select("extraction_id", F.col("id").alias("record_id"), k.alias("k"))
    first = base.filter("k % 3 < 2").select("extraction_id", "record_id", F.lit(1).alias("revision"), F.lit("approved").alias("status"), F.lit('{"type":"sym","canonical":"C"}').alias("payload"), F.lit("me").alias("reviewer"), F.lit("1").alias("created"))
    second = base.filter("k % 3 = 1").select("extraction_id", "record_id", F.lit(2).alias("revision"), F.lit("rejected").alias("status"), F.lit('{"type":"dru"}').alias("payload"), F.lit("you").alias("reviewer"), F.lit("2").alias("created"))
    rows = review.reviewed_entities(part, first.unionAll(second))
    return rows.select("id", "type", "model_type", "canonical", "model_canonical", "status", F.col("revision").cast("long").alias("revision"), "reviewer", "type_name", "concept_id")


def refused_corrections(spark, sf):
    """Corrections of evidence: right ones, bad offsets, other texts, across blocks, of no document."""
    docs = parsed(load(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit("\n"), "p_brand").alias("text")))
    name, k = F.length("p_name"), F.col("p_partkey") % 5
    rows = load(spark, sf, "part").select(
        F.when(k == 4, -F.col("p_partkey") - 1).otherwise(F.col("p_partkey")).alias("doc_id"),
        F.when(k == 1, F.lit(-1)).otherwise(F.lit(0)).alias("start"), F.when(k == 3, name + 3).otherwise(name).alias("end"),
        F.when(k == 2, F.lit("other")).when(k == 3, F.concat("p_name", F.lit("\n"), F.substring("p_brand", 1, 2))).otherwise(F.col("p_name")).alias("text"),
    )
    return review.evidence_errors(rows, docs).select("doc_id", "reason", "block", "section")


def rebuilt_evidence(spark, sf):
    """Evidence narrowed to the second sentence of each report."""
    docs = reports(spark, sf, ENDPOINTS)
    start = F.coalesce(*(F.when(F.col("m") == i, t.until(3)) for i, t in enumerate(ENDPOINTS)))
    rows = docs.withColumn("start", start).withColumn("end", F.length("text"))
    rows = rows.select("doc_id", F.lit("r0").alias("id"), F.when(F.col("m") == 4, "adverse_event").otherwise("efficacy").alias("category"), "start", "end", F.expr("substring(text, start + 1, end - start)").alias("text"), F.lit("b0").alias("block"), F.lit("正文").alias("section"), F.lit("line:1").alias("locator"), F.lit("paragraph").alias("kind"))
    found = review.rebuilt(rows, marked(spark, sf, ENDPOINTS, ARMS))
    return found.select("doc_id", "id", F.coalesce(F.size("numbers"), F.lit(0)).alias("numbers"), F.coalesce(F.size("binding_suggestions"), F.lit(0)).alias("bindings"), F.array_join("mentions", ",").alias("mentions"), F.col("provenance.scope").alias("scope"))


# --- records of relations

def _schema(spark):
    return relations.schema_frame(spark, [("made", "thing", {"@value": "brand"}), ("sold", "thing", {"@value": "brand"})])


def _record(predicate="made"):
    return F.array(F.struct(F.col("subject"), F.lit("thing").alias("subject_type"), predicate if not isinstance(predicate, str) else F.lit(predicate).alias("predicate"), F.create_map(F.lit("@value"), F.col("object")).alias("object"), F.create_map(F.lit("@value"), F.lit("brand")).alias("object_type")))


def converted_records(spark, sf):
    """Records of parts: right ones, and one of each kind that is refused."""
    k = F.col("p_partkey") % 5
    rows = load(spark, sf, "part").withColumn("text", F.concat("p_name", F.lit(" comes from "), "p_brand"))
    rows = rows.withColumn("subject", F.when(k == 0, "nowhere").otherwise(F.col("p_name"))).withColumn("object", F.when(k == 1, "nowhere").otherwise(F.col("p_brand")))
    rows = rows.withColumn("spo_list", F.when(k != 3, _record(F.when(k == 2, "lost").otherwise("made").alias("predicate"))))
    found = relations.convert_records(rows, relations.schema_items(_schema(spark)), "p_partkey")
    t = F.element_at("triples", 1)
    return found.select("p_partkey", "reason", "ambiguous_mentions", *(t[c].alias(c) for c in relations.TRIPLE))


def _imported(spark, sf):
    rows = spread(load(spark, sf, "part").select("p_partkey", "p_name", "p_brand")).select((F.col("p_partkey") + 1).alias("source_line"), F.concat(F.lit("item "), "p_partkey", F.lit(" "), "p_name", F.lit(" comes from "), "p_brand").alias("text"), F.col("p_name").alias("subject"), F.col("p_brand").alias("object"), F.col("p_partkey").alias("k"))
    rows = rows.withColumn("predicate", F.when(F.col("k") % 2 == 0, "made").otherwise("sold"))
    again = rows.filter("k % 25 = 0").withColumn("source_line", F.col("source_line") + 1_000_000_000)
    other = rows.filter("k % 25 = 1").withColumn("source_line", F.col("source_line") + 2_000_000_000).withColumn("predicate", F.lit("made"))
    blank = rows.filter("k % 25 = 2").withColumn("source_line", F.col("source_line") + 3_000_000_000).withColumn("text", F.lit(" "))
    odd = rows.filter("k % 25 = 3").withColumn("source_line", F.col("source_line") + 4_000_000_000).withColumn("object", F.lit("nowhere")).withColumn("text", F.concat("text", F.lit(" again")))
    every = reduce(DataFrame.unionAll, (rows, again, other, blank, odd))
    return every.select("source_line", "text", F.lit(None).cast("string").alias("split"), _record(F.col("predicate")).alias("spo_list"))


def imported_records(spark, sf):
    found = relations.import_records(_imported(spark, sf), _schema(spark), 42)
    return found.clean.select("source_line", F.col("split").alias("outcome")).unionAll(found.rejected.select("source_line", "reason"))


# copies with another predicate conflict where the first one's differs
IMPORT_SQL = """WITH p AS (SELECT p_partkey AS k, lower('item ' || p_partkey || ' ' || p_name || ' comes from ' || p_brand) AS key FROM part),
ok AS (SELECT * FROM p WHERE NOT (k % 25 = 1 AND k % 2 = 1)), n AS (SELECT count(*) AS n, floor(count(*) * 0.8::DOUBLE)::BIGINT AS a FROM ok),
r AS (SELECT k, row_number() OVER (ORDER BY sha256('42:' || key), key) AS r FROM ok)
SELECT k + 1 AS source_line, CASE WHEN r <= a THEN 'train' WHEN r <= a + greatest(1, floor(n * 0.1::DOUBLE)::BIGINT) THEN 'validation' ELSE 'test' END AS outcome FROM r, n
UNION ALL SELECT k + 1, 'conflicting_annotations' FROM p WHERE k % 25 = 1 AND k % 2 = 1 UNION ALL SELECT k + 1 + 1000000000, 'normalized_duplicate' FROM p WHERE k % 25 = 0
UNION ALL SELECT k + 1 + 2000000000, CASE WHEN k % 2 = 1 THEN 'conflicting_annotations' ELSE 'normalized_duplicate' END FROM p WHERE k % 25 = 1
UNION ALL SELECT k + 1 + 3000000000, 'no_text' FROM p WHERE k % 25 = 2 UNION ALL SELECT k + 1 + 4000000000, 'object_not_in_text' FROM p WHERE k % 25 = 3"""


def verified_records(spark, sf):
    """Stored rows that break their version: offsets beyond the text, types against the schema, a text twice."""
    part = load(spark, sf, "part")
    words = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("same "), (F.col("p_partkey") % 22).cast("string"))).otherwise(F.concat(F.lit("abcdefgh "), F.col("p_partkey").cast("string")))
    kinds = "array<struct<s_start:int,s_end:int,s_type:string,rel:int,o_start:int,o_end:int,o_type:string>>"
    triple = F.array(F.struct(F.lit(0), F.lit(3), F.when(F.col("p_partkey") % 7 == 0, "other").otherwise("thing"), F.lit(0), F.lit(4), F.col("p_size"), F.lit("brand"))).cast(kinds)
    rows = part.select(words.alias("text"), triple.alias("triples"))
    return relations.verify_records(rows, relations.schema_items(_schema(spark))).groupBy("text", "reason").agg(F.count("*").alias("n"))


VERIFY_SQL = """WITH r AS (SELECT p_partkey AS k, p_size, CASE WHEN p_partkey % 11 = 0 THEN 'same ' || (p_partkey % 22) ELSE 'abcdefgh ' || p_partkey END AS text FROM part),
d AS (SELECT text, count(*) AS n FROM r GROUP BY text HAVING count(*) > 1),
b AS (SELECT DISTINCT text, p_size, k % 7 = 0 AS odd FROM r)
SELECT text, 'duplicate_text' AS reason, n::BIGINT AS n FROM d UNION ALL
SELECT text, CASE WHEN p_size <= 4 OR p_size > length(text) THEN 'bad_offsets' ELSE 'against_schema' END AS reason, count(*)::BIGINT FROM b WHERE p_size <= 4 OR p_size > length(text) OR odd GROUP BY 1, 2"""

# --- decoding

#: Lines of orders, each number once.
LINES = "l AS (SELECT l_orderkey AS d, l_linenumber AS n, max(l_quantity) AS q, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2)"


def _lines(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").alias("q"), F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))


def _spans(spark, sf):
    return _lines(spark, sf).select("doc_id", (F.col("n") * 2).alias("first"), (F.col("n") * 2 + 1).alias("last"), (F.col("n") * 10).alias("start"), (F.col("n") * 10 + 5).alias("end"), F.when(F.col("n") % 2 == 0, "brand").otherwise("thing").alias("type"), (F.col("q") - 5).alias("score"), "n", "p", "s")


def _pairs(spark, sf):
    a, b = (_spans(spark, sf).select("doc_id", *(F.col(c).alias(f"{x}_{c}") for c in ("n", "p", "s"))) for x in "ab")
    return a.join(b, "doc_id").filter("a_n <> b_n")


def joint_triples(spark, sf):
    """Head and tail links between lines of an order; things and brands by turns."""
    pairs = _pairs(spark, sf)
    link = lambda kind, add, c, rel: pairs.select("doc_id", F.lit(kind).alias("kind"), F.lit(rel).alias("rel"), (F.col("a_n") * 2 + add).alias("i"), (F.col("b_n") * 2 + add).alias("j"), (F.col(f"a_{c}") + F.col(f"b_{c}") + rel).cast("double").alias("x"))
    links = reduce(DataFrame.unionAll, (link("head", 0, "p", r).withColumn("logit", F.col("x") % 11 - 5) for r in (0, 1)))
    links = links.unionAll(reduce(DataFrame.unionAll, (link("tail", 1, "s", r).withColumn("logit", F.col("x") % 7 - 2) for r in (0, 1)))).drop("x")
    spans = _spans(spark, sf).drop("n", "p", "s")
    found = relations.decode_joint(spans, links, relations.schema_items(_schema(spark)))
    heads = relations.decode_joint(spans, links, relations.schema_items(_schema(spark)), 2.0, use_tail=False)
    return found.withColumn("tail", F.lit(True)).unionByName(heads.withColumn("tail", F.lit(False)))


JOINT_SQL = f"""WITH {LINES}, x AS (SELECT a.d AS doc_id, a.n AS an, b.n AS bn, a.q - 5 AS aq, b.q - 5 AS bq, rel, ((a.p + b.p + rel)::DOUBLE % 11) - 5 AS h, ((a.s + b.s + rel)::DOUBLE % 7) - 2 AS t
FROM l a JOIN l b ON a.d = b.d AND a.n % 2 = 1 AND b.n % 2 = 0, (VALUES (0), (1)) r(rel)),
y AS (SELECT *, true AS tail, least(aq, bq, h, t) AS score FROM x WHERE h > 0 AND t > 0 UNION ALL SELECT *, false, least(aq, bq, h) FROM x WHERE h > 2)
SELECT doc_id, an * 10 AS s_start, an * 10 + 5 AS s_end, 'thing' AS s_type, rel, bn * 10 AS o_start, bn * 10 + 5 AS o_end, 'brand' AS o_type, score, tail FROM y"""


def pair_triples(spark, sf):
    scores = _pairs(spark, sf).select("doc_id", (F.col("a_n") * 10).alias("s_start"), (F.col("a_n") * 10 + 5).alias("s_end"), (F.col("b_n") * 10).alias("o_start"), (F.col("b_n") * 10 + 5).alias("o_end"), F.lit(1).alias("rel"), ((F.col("a_p") + F.col("b_s")) % 9 - 4.0).alias("logit"))
    return relations.decode_pairs(_spans(spark, sf).select("doc_id", "start", "end", "type", "score"), scores, relations.schema_items(_schema(spark)))


def window_triples(spark, sf):
    """Triples of windows that start at two places, as those of documents."""
    t = joint_triples(spark, sf).filter("tail").drop("tail").withColumn("base", F.explode(F.array(F.lit(0), F.lit(10))))
    none = t.select("doc_id", "base", F.col("s_start").alias("start"), F.col("s_end").alias("end"), F.col("s_type").alias("type"), "score")
    _, merged = relations.merge_windows(none, t)
    return merged


def extracted_relations(spark, sf):
    """Entities with ids and confidences, and relations that refer to them."""
    spans, triples = _spans(spark, sf).select("doc_id", "start", "end", "type", "score"), pair_triples(spark, sf)
    texts = spans.select("doc_id").distinct().withColumn("text", F.lit("0123456789" * 9))
    ents, rels = relations.extraction(texts, spans, triples, relations.schema_items(_schema(spark)))
    ents = ents.select("doc_id", "id", F.lit("").alias("object"), F.lit("").alias("predicate"), "text", F.round("confidence", 9).alias("confidence"))
    return ents.unionAll(rels.select("doc_id", "subject", "object", "predicate", F.concat("subject_text", F.lit("|"), "object_text"), F.round("confidence", 9)))


EXTRACT_SQL = f"""WITH {LINES}, e AS (SELECT d, n, q - 5 AS score, 'e' || (row_number() OVER (PARTITION BY d ORDER BY n) - 1) AS id FROM l),
t AS (SELECT a.d, a.id AS s, b.id AS o, least(a.score, b.score, (x.p + y.s) % 9 - 4.0::DOUBLE) AS score, (x.p + y.s) % 9 - 4 AS h FROM e a JOIN e b ON a.d = b.d AND a.n % 2 = 1 AND b.n % 2 = 0 JOIN l x ON x.d = a.d AND x.n = a.n JOIN l y ON y.d = b.d AND y.n = b.n)
SELECT d AS doc_id, id, '' AS object, '' AS predicate, substr(repeat('0123456789', 9), n * 10 + 1, 5) AS text, round(1 / (1 + exp(-score)), 9) AS confidence FROM e
UNION ALL SELECT d, s, o, 'sold', '01234|01234', round(1 / (1 + exp(-score)), 9) FROM t WHERE h > 0"""


def triple_entities(spark, sf):
    return relations.entities(pair_triples(spark, sf), "doc_id")


def shifted_triples(spark, sf):
    rows = joint_triples(spark, sf).filter("tail").groupBy("doc_id").agg(F.collect_list(F.struct(*relations.TRIPLE)).alias("t"))
    return rows.select("doc_id", F.inline(relations.shifted(F.col("t"), 7)))


# --- named entities

def ner_conversion(spark, sf):
    """Names of parts as texts with entities: right ones, of no type, off the tokens, longer than a window."""
    k, first = F.col("p_partkey") % 4, F.length(F.substring_index("p_name", " ", 1))
    one = F.struct(F.when(k == 2, first).otherwise(F.lit(0)).alias("start_idx"), (F.when(k == 3, F.length("p_name")).when(k == 2, first + 2).otherwise(first) - 1).alias("end_idx"), F.when(k == 1, "none").otherwise("dis").alias("type"))
    rows = load(spark, sf, "part").select("p_partkey", F.col("p_name").alias("text"), F.array(one).alias("entities"))
    return ner.convert(rows, ["p_partkey"], length=6, stride=2).select("p_partkey", "reason", F.size("windows").cast("long").alias("windows"))


NER_SQL = """WITH r AS (SELECT p_partkey, p_name, p_partkey % 4 AS k, length(replace(p_name, ' ', '')) AS n, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS c, strpos(p_name, ' ') - 1 AS f FROM part)
SELECT p_partkey, CASE WHEN c > 1 THEN 'duplicate' WHEN k = 1 THEN 'invalid' WHEN k = 2 THEN 'unaligned' WHEN k = 3 AND n > 6 THEN 'uncovered' WHEN k = 0 AND f > 6 THEN 'uncovered' END AS reason, (greatest(ceil((n - 6) / 4.0), 0) + 1)::BIGINT AS windows FROM r"""


def ner_window_tasks(spark, sf):
    rows = load(spark, sf, "part").select("p_partkey", F.col("p_name").alias("text"), F.array(F.struct(F.lit(0).alias("start_idx"), F.lit(0).alias("end_idx"), F.lit("dis").alias("type"))).alias("entities"))
    made = ner.convert(rows, ["p_partkey"], length=6, stride=2)
    return ner.window_tasks(ner.too_many_windows(made, 1), "p_partkey").select("p_partkey", "base", "text")


def predicted_spans(spark, sf):
    """A predictor named by a run's configuration, run over rows in batches, with a recipe of thresholds."""

    def maker(config):
        def run(rows):
            def load_model():
                return lambda frame: pd.DataFrame({"doc_id": frame.doc_id, "start": 0, "end": frame.text.str.len(), "type": ["long" if n > 9 else "short" for n in frame.text.str.len()], "score": frame.p_size.astype(float) * config["scale"]})

            return ner.predict_in_batches(rows, load_model, "doc_id long, start int, end int, type string, score double", 7)

        return run

    predictor = ner.predictor_for({"backend": "sizes", "scale": 2.0, "recipe": {"thresholds": {"long": 40.0, "short": 60.0}}}, {"sizes": maker})
    rows = spread(load(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"), "p_size"))
    found = predictor(rows)
    ner.aligned(rows, predictor_base(rows, maker))
    return found


def predictor_base(rows, maker):
    return ner.predictor_for({"backend": "sizes", "scale": 1.0}, {"sizes": maker})(rows)


def nested_spans(spark, sf):
    """Two spans of a line cross or hold each other, by the part; the better one of two that cross stays."""
    line = _lines(spark, sf).select("doc_id", (F.col("n") * 100).alias("a"), F.col("p"), F.col("s"))
    one = line.select("doc_id", F.col("a").alias("start"), (F.col("a") + 10).alias("end"), F.lit("long").alias("type"), (F.lit(10) + F.col("p") % 5).cast("double").alias("score"))
    two = line.select("doc_id", (F.col("a") + 5).alias("start"), (F.col("a") + F.when(F.col("s") % 2 == 0, 15).otherwise(9)).alias("end"), F.lit("short").alias("type"), F.lit(12.0).alias("score"))
    return thresholds.decode(one.unionAll(two), {"long": 3.0, "short": 3.0}, "nested")


NESTED_SQL = f"""WITH {LINES} SELECT d AS doc_id, n * 100 AS "start", n * 100 + 10 AS "end", 'long' AS type, (10 + p % 5)::DOUBLE AS score FROM l WHERE s % 2 = 1 OR p % 5 >= 2
UNION ALL SELECT d, n * 100 + 5, n * 100 + CASE WHEN s % 2 = 0 THEN 15 ELSE 9 END, 'short', 12.0::DOUBLE FROM l WHERE s % 2 = 1 OR p % 5 < 2"""


def _counter(m: int) -> dict[str, str]:
    _, bindings = COUNTS[m]
    arms = {0: 1, 1: 2, 4: 1}.get(m, 0)
    entity = int(bool(ARMS[m]))
    return {k: f"{v}::BIGINT" for k, v in {"records": 1, "bindings": bindings, "explicit_arms": arms, "cited_or_mixed": 0, "negative_efficacy": int(m == 6), "entities": entity, "modified": 0, "blocked": 0}.items()}


E = ENDPOINTS
QUERIES = {
    "endpoint_bindings": (endpoint_bindings, union(E, BOUND)),
    "endpoint_abstentions": (endpoint_abstentions, union(E, [[{"reason": text(REFUSED[m][0]), "endpoint": text(REFUSED[m][1]), "\"start\"": t.at(3)}] if m in REFUSED else [] for m, t in enumerate(E)])),
    "evidence_of_reports": (evidence_of_reports, union(E, [[{"id": "'r0'", "category": text("adverse_event" if m == 4 else "efficacy"), "\"start\"": t.at(3), "\"end\"": t.at(len(t.parts)), "numbers": str(COUNTS[m][0]), "bindings": str(COUNTS[m][1]), "mentions": text("e0" if ARMS[m] else ""), "negations": str(int(m == 6)), "status": "'pending'"}] for m, t in enumerate(E)])),
    "extraction_counters": (extraction_counters, union(E, [[_counter(m)] for m in range(len(E))])),
    "sentence_spans": (sentence_spans, union(E, [_sentence_rows(m, t) for m, t in enumerate(E)])),
    "entity_contexts": (entity_contexts, union(CONTEXTS, [[{"id": f"'e{i}'", "text": text(t.parts[ENTITIES[m][i][0]]), "assertion": text(s[0]), "temporality": text(s[1]), "experiencer": text(s[2]), "modifiers": str(s[3]), "blocked": str(s[4])} for i, s in enumerate(STATES[m])] for m, t in enumerate(CONTEXTS)])),
    "context_modifiers": (context_modifiers, union(CONTEXTS, [[_modifier(t, *x) for x in MODIFIERS[m]] for m, t in enumerate(CONTEXTS)])),
    "relation_scope_flags": (relation_scope_flags, union(CONTEXTS, [[{"scope_start": t.at(3), "scope_end": t.at(len(t.parts)), "flags": text(FLAGS[m])}] for m, t in enumerate(CONTEXTS)])),
    "provenance_scopes": (provenance_scopes, union(STUDIES, [[{"scope": text(s), "cues": str(n), "first_start": a, "last_end": b}] for (s, n), (a, b) in zip(SCOPES, CUE_ENDS)])),
    "numbers_in_reports": (numbers_in_reports, union(NUMBERS, ATOMS)),
    "abbreviations": (abbreviations, union(ALIASES, [[{"alias": "'CD' || p_size", "canonical": "'慢性病' || p_size", "type": "'dis'", "\"start\"": "0", "\"end\"": ALIASES[0].at(5, 1)}], []])),
    "normalized_entities": (normalized_entities, union(ALIASES, [
        [{"id": f"'e{i}'", "canonical": "'慢性病' || p_size", "normalization": text("explicit_alias" if i else "exact_surface"), "concept_id": _concept("'慢性病' || p_size")} for i in range(2)],
        [{"id": f"'e{i}'", "canonical": "'胃黏膜炎'", "normalization": "'explicit_alias'", "concept_id": _concept("'胃黏膜炎'")} for i in range(2)]])),
    "articles": (articles, ARTICLE_SQL),
    "text_blocks": (text_blocks, TEXT_SQL),
    "reviewed_entities": (reviewed_entities, f"""WITH r AS (SELECT p_partkey::VARCHAR AS id, p_partkey % 3 AS k, p_name, CASE p_partkey % 3 WHEN 0 THEN 'sym' WHEN 1 THEN 'dru' ELSE 'dis' END AS type, CASE WHEN p_partkey % 3 < 2 THEN 'C' ELSE p_name END AS canonical FROM part)
SELECT id, type, 'dis' AS model_type, canonical, p_name AS model_canonical, CASE k WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END::BIGINT AS revision, CASE k WHEN 0 THEN 'me' WHEN 1 THEN 'you' END AS reviewer,
CASE type WHEN 'sym' THEN '{review.TYPE_NAMES["sym"]}' WHEN 'dru' THEN '{review.TYPE_NAMES["dru"]}' ELSE '{review.TYPE_NAMES["dis"]}' END AS type_name, 'local:' || substr(sha256(type || chr(0) || canonical), 1, 16) AS concept_id FROM r"""),
    "refused_corrections": (refused_corrections, "SELECT CASE WHEN p_partkey % 5 = 4 THEN -p_partkey - 1 ELSE p_partkey END AS doc_id, CASE p_partkey % 5 WHEN 1 THEN 'invalid_offsets' WHEN 2 THEN 'not_the_source_text' WHEN 3 THEN 'not_within_one_block' WHEN 4 THEN 'no_document' END AS reason, CASE WHEN p_partkey % 5 = 0 THEN 'b0' END AS block, CASE WHEN p_partkey % 5 = 0 THEN '正文' END AS section FROM part"),
    "rebuilt_evidence": (rebuilt_evidence, union(E, [[{"id": "'r0'", "numbers": str(COUNTS[m][0]), "bindings": str(COUNTS[m][1]), "mentions": text("e0" if ARMS[m] else ""), "scope": "'unassigned'"}] for m in range(len(E))])),
    "converted_records": (converted_records, """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'subject_not_in_text' WHEN 1 THEN 'object_not_in_text' WHEN 2 THEN 'not_in_schema' WHEN 3 THEN 'empty_text_or_no_relations' END AS reason, CASE WHEN k THEN 0 END AS ambiguous_mentions,
CASE WHEN k THEN 0 END AS s_start, CASE WHEN k THEN length(p_name)::INTEGER END AS s_end, CASE WHEN k THEN 'thing' END AS s_type, CASE WHEN k THEN 0 END AS rel, CASE WHEN k THEN (length(p_name) + 12)::INTEGER END AS o_start, CASE WHEN k THEN (length(p_name) + 12 + length(p_brand))::INTEGER END AS o_end, CASE WHEN k THEN 'brand' END AS o_type FROM (SELECT *, p_partkey % 5 = 4 AS k FROM part)"""),
    "imported_records": (imported_records, IMPORT_SQL),
    "verified_records": (verified_records, VERIFY_SQL),
    "joint_triples": (joint_triples, JOINT_SQL),
    "pair_triples": (pair_triples, f"""WITH {LINES} SELECT a.d AS doc_id, a.n * 10 AS s_start, a.n * 10 + 5 AS s_end, 'thing' AS s_type, 1 AS rel, b.n * 10 AS o_start, b.n * 10 + 5 AS o_end, 'brand' AS o_type, least(a.q - 5, b.q - 5, ((a.p + b.s) % 9 - 4)::DOUBLE) AS score
FROM l a JOIN l b ON a.d = b.d AND a.n % 2 = 1 AND b.n % 2 = 0 WHERE (a.p + b.s) % 9 > 4"""),
    "window_triples": (window_triples, f"""WITH j AS ({JOINT_SQL}), w AS (SELECT *, unnest([0, 10]) AS base FROM j WHERE tail)
SELECT doc_id, s_start + base AS s_start, s_end + base AS s_end, s_type, rel, o_start + base AS o_start, o_end + base AS o_end, o_type, max(score) AS score FROM w GROUP BY ALL"""),
    "extracted_relations": (extracted_relations, EXTRACT_SQL),
    "triple_entities": (triple_entities, f"""WITH {LINES}, t AS (SELECT a.d, a.n AS x, b.n AS y FROM l a JOIN l b ON a.d = b.d AND a.n % 2 = 1 AND b.n % 2 = 0 WHERE (a.p + b.s) % 9 > 4)
SELECT DISTINCT d AS doc_id, x * 10 AS "start", x * 10 + 5 AS "end", 'thing' AS type FROM t UNION ALL SELECT DISTINCT d, y * 10, y * 10 + 5, 'brand' FROM t"""),
    "shifted_triples": (shifted_triples, f"WITH j AS ({JOINT_SQL}) SELECT doc_id, s_start + 7 AS s_start, s_end + 7 AS s_end, s_type, rel, o_start + 7 AS o_start, o_end + 7 AS o_end, o_type FROM j WHERE tail"),
    "ner_conversion": (ner_conversion, NER_SQL),
    "ner_window_tasks": (ner_window_tasks, None),
    "predicted_spans": (predicted_spans, """SELECT p_partkey AS doc_id, 0 AS "start", length(p_name)::INTEGER AS "end", CASE WHEN length(p_name) > 9 THEN 'long' ELSE 'short' END AS type, p_size * 2.0::DOUBLE AS score FROM part WHERE p_size * 2 > CASE WHEN length(p_name) > 9 THEN 40 ELSE 60 END"""),
    "nested_spans": (nested_spans, NESTED_SQL),
}
