"""Assertion, time and experiencer of entities, by directed cues with scopes.

A cue reaches forwards or backwards to the next termination, 32 characters at most, and speaks for some entity
types. All of it are column functions over arrays of spans; entities meet their sentence by a join on the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.spans import contains, regex_spans
from textquarry.operators.intervals import first_holding

# Cues, directions, types and reach must be these for the same results.
RULES = [
    ("negated", r"未见|未发现|未发生|未出现|没有|否认|无", "forward", ("dis", "mic", "sym")),
    ("negated", r"阴性", "backward", ("dis", "ite", "mic")),
    ("uncertain", r"不能排除|不排除|疑似|可能|考虑", "forward", ("dis", "mic", "sym")),
    ("historical", r"既往患有|既往有|既往患|曾患", "forward", ("dis", "sym")),
    ("historical", r"病史", "backward", ("dis", "sym")),
    ("family", r"父亲|母亲|家族史|家族中", "forward", ("dis", "sym")),
]
PSEUDO = r"无进展|无论|有无|无创|无(?:明显|显著|统计学)?差异|无证据证明|没有(?:明显|显著|统计学)?差异"
TERMINATION = r"[，,；;。！？!?]|但是|但|然而|不过|却"
OUTCOME_BETWEEN = r"改善|提高|降低|延长|发生率|接受|治疗|驱动基因|批准"
OUTCOME_AFTER = r"^(?:的)?(?:改善|进展|提高|降低|差异|优势)"
REACH, NEAR, PEEK = 32, 4, 5
METHOD = "chinese_context_rules_v1"


def modifiers(text: Column) -> Column:
    """Cues of a sentence with their scopes, offsets inside the sentence."""
    pseudo, ends = regex_spans(text, PSEUDO), regex_spans(text, TERMINATION)

    def scoped(category: str, direction: str, types: tuple[str, ...]):
        def one(c):
            left = F.coalesce(F.array_max(F.transform(F.filter(ends, lambda e: e["end"] <= c["start"]), lambda e: e["end"])), F.lit(0))
            right = F.coalesce(F.array_min(F.transform(F.filter(ends, lambda e: e["start"] >= c["end"]), lambda e: e["start"])), F.length(text))
            a, b = (c["end"], F.least(right, c["end"] + REACH)) if direction == "forward" else (F.greatest(left, c["start"] - REACH), c["start"])
            return F.struct(F.lit(category).alias("category"), F.lit(direction).alias("direction"), c["text"].alias("cue"), c["start"].alias("cue_start"), c["end"].alias("cue_end"), a.alias("scope_start"), b.alias("scope_end"), F.array(*map(F.lit, types)).alias("allowed_types"))

        return one

    is_pseudo = lambda c: F.exists(pseudo, lambda p: (p["start"] <= c["start"]) & (c["end"] <= p["end"]))
    return F.concat(*(F.transform(F.filter(regex_spans(text, pattern), lambda c: ~is_pseudo(c)), scoped(category, direction, types)) for category, pattern, direction, types in RULES))


def sentence_of(entities: DataFrame, sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each entity with the first sentence that holds it: _s (start, end, text), null if none does."""
    found = first_holding(entities, sentences.select(key, "start", "end", "text"), key, name="_s")
    return found.withColumn("_s", F.when(F.col("_s").isNotNull(), F.struct("_s.start", "_s.end", "_s.text")))


def entity_context(entities: DataFrame, sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add context to entities (key, id, start, end, type, text, perhaps canonical): assertion, temporality,
    experiencer, modifiers and those that were blocked, with the reason. Without a sentence: unassigned.
    """
    rows = sentence_of(entities, sentences, key)
    text, base = F.col("_s.text"), F.col("_s.start")
    a, b = F.col("start") - base, F.col("end") - base
    name = F.coalesce(F.col("canonical"), F.col("text")) if "canonical" in entities.columns else F.col("text")
    between = lambda m: F.substring(text, m["cue_end"] + 1, F.greatest(a - m["cue_end"], F.lit(0)))
    after = lambda m: F.substring(text, b + 1, F.greatest(F.least(b + PEEK, m["scope_end"]) - b, F.lit(0)))
    outcome = lambda m: (m["direction"] == "forward") & m["category"].isin("negated", "uncertain") & (between(m).rlike(OUTCOME_BETWEEN) | after(m).rlike(OUTCOME_AFTER))
    reason = lambda m: (  # noqa: E731  the last check that fails gives the reason
        F.when(outcome(m), "outcome_or_indirect_scope")
        .when((m["direction"] == "backward") & (m["cue_start"] - b > NEAR), "nonlocal_backward_modifier")
        .when((F.col("type") == "dis") & ~name.rlike("[\\u4e00-\\u9fff]"), "unverified_disease_surface")
    )
    applies = lambda m: F.array_contains(m["allowed_types"], F.col("type")) & (m["scope_start"] <= a) & (b <= m["scope_end"])
    shown = lambda m: F.struct(m["category"].alias("category"), m["direction"].alias("direction"), m["cue"].alias("cue"), (m["cue_start"] + base).alias("cue_start"), (m["cue_end"] + base).alias("cue_end"), (m["scope_start"] + base).alias("scope_start"), (m["scope_end"] + base).alias("scope_end"), reason(m).alias("reason"))
    rows = rows.withColumn("_m", F.transform(F.filter(modifiers(text), applies), shown))
    rows = rows.withColumn("modifiers", F.filter("_m", lambda m: m["reason"].isNull())).withColumn("blocked_modifiers", F.filter("_m", lambda m: m["reason"].isNotNull()))
    has = lambda c: F.exists("modifiers", lambda m: m["category"] == c)
    assertion = F.when(F.col("_s").isNull(), "unassigned").when(has("negated") & has("uncertain"), "conflicting").when(has("negated"), "negated").when(has("uncertain"), "uncertain").otherwise("unmarked")
    context = F.struct(assertion.alias("assertion"), F.when(has("historical"), "historical").otherwise("unmarked").alias("temporality"), F.when(has("family"), "family").otherwise("unmarked").alias("experiencer"), "modifiers", "blocked_modifiers", F.lit(METHOD).alias("method"), F.lit("rule_candidate").alias("status"))
    return rows.withColumn("context", context).drop("_s", "_m", "modifiers", "blocked_modifiers")
