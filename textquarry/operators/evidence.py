"""Evidence candidates: sentences that hold cues, with their numbers, qualifiers and sources.

All patterns run as column functions; a sentence gives a record for each category whose cue it holds. Records
are candidates for a review, never conclusions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.spans import regex_spans
from textquarry.operators.intervals import first_holding, holding

# The cues, qualifiers, units and study cues must be these for the same results.
CUES = {
    "population": r"纳入|入组|患者|受试者|病例|人群|participants|patients",
    "intervention": r"接受|给予|口服|服用|治疗组|干预组|联合|对照组|安慰剂|intervention|placebo",
    "efficacy": r"生存期|缓解率|有效率|无进展|终点|疗效|(?<![A-Za-z])(?:OS|PFS|ORR)(?![A-Za-z])|response rate|survival",
    "adverse_event": r"不良(?:事件|反应)|毒(?:副作用|性)|安全性|(?<![A-Za-z])(?:AEs?|TRAEs?|SAEs?)(?![A-Za-z])|adverse (?:event|reaction)|toxicity",
}
QUALIFIERS = {
    "negation": r"未(?:能|见|达到|发生|提高|改善|接受|证明|提供|发现|观察)|没有|无(?:显著|统计学|明显|差异|需)|不能|不需要|不(?:接受|推荐)|未进一步获益|not (?:significant|improve)|no (?:significant|benefit)",
    "uncertainty": r"可能|提示|尚不|仍需|有待|may\b|might\b",
    "comparison": r"相比|对比|比较|对照|分别|vs\.?|versus|compared",
    "study_design": r"回顾性|随机|前瞻性|病例报告|Meta分析|倾向性评分|retrospective|randomized",
}
STUDIES = {
    "current_study": r"本研究|我们(?:的)?研究",
    "citation": r"\[\s*\d+(?:\s*[,，–-]\s*\d+)*\s*\]",
    "named_trial": r"(?<![A-Za-z0-9])(?:KEYNOTE|CheckMate|RATIONALE|ORIENT|OAK|PROLUNG|TORG|LUME)[A-Za-z0-9-]*(?:\s+\d+)?(?![A-Za-z0-9])",
}
N = r"\d+(?:\.\d+)?"
BOUND = rf"(?:{N}|NA|NR)"
INTERVAL = rf"95%\s*(?:CI|置信区间)\s*[:：]?\s*[（(]?\s*{BOUND}\s*[-–~]\s*{BOUND}"
UNIT = r"(?:%|％|个月|例|岁|mg|μg|天|周|年)"
NUMBERS = rf"{N}\s*[（(]\s*{INTERVAL}[)）]\s*{UNIT}|{INTERVAL}|(?:HR|OR|RR|P)\s*[=＜<＞>≤≥]\s*{N}|{N}\s*{UNIT}"
OUTCOMES = ("OS", "PFS", "ORR")
METHOD = "evidence_rules_v1"


def categories(text: Column, cues: dict[str, str] = CUES) -> Column:
    """Names of the cues that a sentence holds."""
    return F.array_compact(F.array(*(F.when(text.rlike("(?iU)" + p), F.lit(name)) for name, p in cues.items())))


def qualifiers(text: Column, base: Column | int = 0, patterns: dict[str, str] = QUALIFIERS) -> Column:
    """map<name, spans>: every qualifier has an entry."""
    return F.create_map(*(x for name, p in patterns.items() for x in (F.lit(name), regex_spans(text, p, base))))


def scope_flags(text: Column) -> Column:
    return categories(text, QUALIFIERS)


def provenance(text: Column, base: Column | int = 0) -> Column:
    """struct<scope, cues>: whether a sentence speaks of this study, of cited ones, or both."""

    def named(name: str):
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.lit(name).alias("category"))

    by_kind = [F.transform(regex_spans(text, p, base), named(name)) for name, p in STUDIES.items()]
    own, other = F.size(by_kind[0]) > 0, (F.size(by_kind[1]) > 0) | (F.size(by_kind[2]) > 0)
    scope = F.when(own & other, "mixed_cues").when(other, "cited_study_cues").when(own, "current_study_cue").otherwise("unassigned")
    return F.struct(scope.alias("scope"), F.array_sort(F.concat(*by_kind)).alias("cues"))


def _interval(literal: Column) -> Column:
    pattern = rf"(?iU)^95%\s*(?:CI|置信区间)\s*[:：]?\s*[（(]?\s*({N}|NA|NR)\s*[-–~]\s*({N}|NA|NR)$"
    bound = lambda k: F.when(~F.upper(F.regexp_extract(literal, pattern, k)).isin("NA", "NR", ""), F.regexp_extract(literal, pattern, k).try_cast("double"))
    return F.when(literal.rlike(pattern), F.struct(F.lit(0.95).alias("level"), bound(1).alias("lower"), bound(2).alias("upper")))


def numeric_atom(literal: Column) -> Column:
    """struct<kind, measure, operator, value, unit, interval>: what a literal says, without arm or endpoint. Bounds NA and NR are null."""
    effect = rf"(?iU)^(HR|OR|RR|P)\s*([=＜<＞>≤≥])\s*({N})$"
    quantity = rf"(?iU)^({N})\s*({UNIT})$"
    with_interval = rf"(?iU)^({N})\s*[（(]\s*({INTERVAL})[)）]\s*({UNIT})$"
    get = lambda pattern, k: F.regexp_extract(literal, pattern, k)
    is_effect, is_interval, is_both, is_quantity = literal.rlike(effect), _interval(literal).isNotNull(), literal.rlike(with_interval), literal.rlike(quantity)
    unit = F.when(is_both, get(with_interval, 3)).when(is_quantity, get(quantity, 2))
    unit_kind = F.when(unit.isin("%", "％"), "percentage").when(unit == "例", "count").when(unit == "岁", "age").when(F.lower(unit).isin("mg", "μg"), "dose").otherwise("duration")
    measure = F.upper(get(effect, 1))
    return F.struct(
        F.when(is_effect, F.when(measure == "P", "p_value").otherwise("effect_estimate")).when(is_interval, "confidence_interval").when(is_both | is_quantity, unit_kind).otherwise("unparsed").alias("kind"),
        F.when(is_effect, measure).alias("measure"),
        F.when(is_effect, F.translate(get(effect, 2), "＜＞", "<>")).alias("operator"),
        F.when(is_effect, get(effect, 3)).when(is_both, get(with_interval, 1)).when(is_quantity, get(quantity, 1)).try_cast("double").alias("value"),
        F.when(unit == "％", "%").otherwise(unit).alias("unit"),
        F.when(is_interval, _interval(literal)).when(is_both, _interval(get(with_interval, 2))).alias("interval"),
    )


def numbers(text: Column, base: Column | int = 0) -> Column:
    """Numbers with units or statistical notation: array<struct<start, end, text, normalized>>."""
    return F.transform(regex_spans(text, NUMBERS, base), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), numeric_atom(s["text"]).alias("normalized")))


def mentions_in(sentences: DataFrame, entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """(_k, _a, _b, mentions) of each sentence that holds entities: its key, start and end, and their ids in order."""
    pairs = holding(sentences.select(key, "start", "end"), entities.select(key, "id", "start", "end", "type"), key)
    held = F.array_sort(F.collect_list(F.struct("right.start", "right.end", "right.type", "right.id")))
    return pairs.groupBy(F.col(f"left.{key}").alias("_k"), F.col("left.start").alias("_a"), F.col("left.end").alias("_b")).agg(F.transform(held, lambda e: e["id"]).alias("mentions"))


def candidates(sentences: DataFrame, entities: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Evidence records of sentences (key, start, end, text, block, section, locator, kind): one for each category.

    Bindings of outcomes stand with efficacy, all others with adverse events; other categories have none.
    """
    from textquarry.operators.binding import suggestions

    rows = sentences.withColumn("category", F.explode(categories(F.col("text"))))
    bound = F.col("category").isin("efficacy", "adverse_event")
    rows = rows.withColumn("_s", F.when(bound, suggestions(F.col("text"), F.col("start"), F.col("kind"))))
    fits = F.filter("_s.bindings", lambda b: b["endpoint"].isin(*OUTCOMES) == (F.col("category") == "efficacy"))
    rows = rows.withColumn("binding_suggestions", F.coalesce(fits, F.filter("_s.bindings", lambda b: F.lit(False)))).withColumn("binding_abstentions", F.col("_s.abstentions")).drop("_s")
    rows = rows.withColumn("numbers", numbers(F.col("text"), F.col("start"))).withColumn("qualifiers", qualifiers(F.col("text"), F.col("start"))).withColumn("provenance", provenance(F.col("text"), F.col("start")))
    rank = F.create_map(*(F.lit(x) for i, name in enumerate(CUES) for x in (name, i)))
    order = Window.partitionBy(key).orderBy("start", F.element_at(rank, F.col("category")))
    rows = rows.withColumn("id", F.concat(F.lit("r"), (F.row_number().over(order) - 1).cast("string"))).withColumn("status", F.lit("pending")).withColumn("method", F.lit(METHOD))
    if entities is None:
        return rows.withColumn("mentions", F.array().cast("array<string>"))
    held = mentions_in(sentences, entities, key)
    joined = rows.join(held, (F.col(key) == F.col("_k")) & (F.col("start") == F.col("_a")) & (F.col("end") == F.col("_b")), "left").drop("_k", "_a", "_b")
    return joined.withColumn("mentions", F.coalesce("mentions", F.array().cast("array<string>")))


def relation_scopes(relations: DataFrame, sentences: DataFrame, blocks: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first sentence that holds both ends of a relation, else its block: scope_start, scope_end, scope_text, scope_flags.

    relations: (key, relation_id, block, s_start, s_end, o_start, o_end); the hull runs from the smaller start, its end
    is the greater end.
    """
    hull = relations.withColumn("_lo", F.least("s_start", "o_start")).withColumn("_hi", F.greatest("s_end", "o_end"))
    hull = first_holding(hull, sentences.select(key, "start", "end"), key, ("_lo", "_hi"), name="s")
    b = blocks.select(F.col(key).alias("_bk"), F.col("id").alias("_bid"), F.col("start").alias("_ba"), F.col("end").alias("_bb"))
    rows = hull.join(b, (F.col(key) == F.col("_bk")) & (F.col("block") == F.col("_bid")))
    rows = rows.withColumn("scope_start", F.coalesce("s.start", "_ba")).withColumn("scope_end", F.coalesce("s.end", "_bb")).drop("s", "_bk", "_bid", "_ba", "_bb", "_lo", "_hi")
    rows = rows.join(texts.select(F.col(key).alias("_t"), F.col("text").alias("_text")), F.col(key) == F.col("_t"))
    rows = rows.withColumn("scope_text", F.substring("_text", F.col("scope_start") + 1, F.col("scope_end") - F.col("scope_start"))).drop("_t", "_text")
    return rows.withColumn("scope_flags", scope_flags(F.col("scope_text")))
