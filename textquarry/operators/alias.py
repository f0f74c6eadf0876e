"""Concepts: explicit abbreviations, glossaries, one canonical name or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.spans import regex_spans

# What a definition in parentheses looks like, and statistics that are no aliases.
PARENTHESES = r"[（(][^()（）]{1,100}[)）]"
DEFINITION = r"^(?:[A-Za-z][A-Za-z ,\-]+[,，]\s*|简称\s*)?([A-Z][A-Z0-9-]{1,13}s?)$"
STATISTICS = ("HR", "OR", "RR", "CI", "P")


def concept_id(type_: Column, canonical: Column) -> Column:
    return F.concat(F.lit("local:"), F.substring(F.sha2(F.concat(type_, F.lit("\x00"), canonical), 256), 1, 16))


def abbreviations(texts: DataFrame, entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Definitions like 名称（English name, ABC）: alias, canonical, type, start, end. The longest entity that ends at the bracket is named."""
    found = texts.select(key, F.inline(regex_spans(F.col("text"), PARENTHESES)))
    inner = F.regexp_replace(F.substring("text", F.lit(2), F.length("text") - 2), r"(?U)^\s+|\s+$", "")
    found = found.select(F.col(key).alias("_k"), F.col("start").alias("_open"), F.col("end").alias("_close"), F.regexp_extract(inner, DEFINITION, 1).alias("alias"))
    found = found.filter((F.col("alias") != "") & ~F.col("alias").isin(*STATISTICS))
    before = entities.join(found, (F.col(key) == F.col("_k")) & (F.col("end") == F.col("_open")))
    longest = before.groupBy(key, "alias", "_open", "_close").agg(F.max_by(F.struct("text", "type", "start"), F.struct(F.col("end") - F.col("start"), (-F.col("start")).alias("s"), F.col("type"))).alias("e"))
    return longest.select(key, "alias", F.col("e.text").alias("canonical"), F.col("e.type").alias("type"), F.col("e.start").alias("start"), F.col("_close").alias("end"))


def normalized(texts: DataFrame, entities: DataFrame, glossary: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Entities with canonical, concept_id, normalization and candidates.

    An alias with one canonical name takes it; with several it is ambiguous and keeps its own. Glossary rows
    (canonical, type, aliases, provenance) hold for all documents and must say where they come from.
    """
    names = abbreviations(texts, entities, key).groupBy(key, "alias", "type").agg(F.collect_set("canonical").alias("c"))
    names = names.select(F.col(key).alias("_k"), F.col("alias").alias("_a"), F.col("type").alias("_t"), "c")
    rows = entities.join(names, (F.col(key) == F.col("_k")) & (F.col("text") == F.col("_a")) & (F.col("type") == F.col("_t")), "left").drop("_k", "_a", "_t")
    none = F.array().cast("array<string>")
    if glossary is not None:
        if glossary.filter(F.col("provenance").isNull() | (F.col("provenance") == "")).limit(1).count():
            raise ValueError("glossary entries need a provenance")
        flat = glossary.select("canonical", "type", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", none))).alias("_a"))
        flat = flat.groupBy("_a", F.col("type").alias("_t")).agg(F.collect_set("canonical").alias("g"))
        rows = rows.join(flat, (F.col("text") == F.col("_a")) & (F.col("type") == F.col("_t")), "left").drop("_a", "_t")
    else:
        rows = rows.withColumn("g", none)
    rows = rows.withColumn("candidates", F.array_sort(F.array_union(F.coalesce("c", none), F.coalesce("g", none)))).drop("c", "g")
    n = F.size("candidates")
    rows = rows.withColumn("canonical", F.when(n == 1, F.element_at("candidates", 1)).otherwise(F.col("text")))
    rows = rows.withColumn("normalization", F.when(n > 1, "ambiguous").when(n == 1, "explicit_alias").otherwise("exact_surface"))
    return rows.withColumn("concept_id", concept_id(F.col("type"), F.col("canonical")))


def concepts(entities: DataFrame, *keys: str) -> DataFrame:
    """Concepts of the entities that aren't rejected, with their mentions."""
    kept = entities.filter(F.coalesce(F.col("status"), F.lit("")) != "rejected") if "status" in entities.columns else entities
    named = kept.withColumn("_mention", F.col("id")).drop("id")
    return named.groupBy(*keys, F.col("concept_id").alias("id"), "canonical", "type").agg(F.array_sort(F.collect_list("_mention")).alias("mentions"))
