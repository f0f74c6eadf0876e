"""The queries that apply the operators to their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark, sf_dir):
    from textquarry.llm import topk

    return topk.query(_table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark, sf_dir):
    from textquarry.llm import toxicity

    return toxicity.query(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op3_simhash_dedup(spark, sf_dir):
    from textquarry.llm import simhash

    return simhash.query(_documents(spark, sf_dir))


def op4_suffix_dedup(spark, sf_dir):
    from textquarry.llm import suffix

    return suffix.remove_repeats(_documents(spark, sf_dir))


def op5_line_dedup(spark, sf_dir):
    from textquarry.llm import lines

    return lines.query(_documents(spark, sf_dir))


def op6_language_id(spark, sf_dir):
    from textquarry.llm import langid

    return langid.query(_documents(spark, sf_dir))


def op7_lm_scoring(spark, sf_dir):
    from textquarry.llm import ppm

    return ppm.query(_documents(spark, sf_dir))


def op8_packing(spark, sf_dir):
    from textquarry.llm import packing

    return packing.query(_documents(spark, sf_dir))


def op9_substring_dedup(spark, sf_dir):
    from textquarry.llm import substrings

    return substrings.dedup_substrings(_documents(spark, sf_dir))


def op10_decontamination(spark, sf_dir):
    from textquarry.llm import decontam

    return decontam.query(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark, sf_dir):
    from textquarry.llm import variants

    return variants.query(_documents(spark, sf_dir))


def op12_filter_audit(spark, sf_dir):
    from textquarry.llm import audit

    return audit.query(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op13_token_counts(spark, sf_dir):
    from textquarry.llm import tokens

    return tokens.query(_documents(spark, sf_dir))


def queries():
    return {
        "op1_exact_topk": op1_exact_topk,
        "op2_toxicity": op2_toxicity,
        "op3_simhash_dedup": op3_simhash_dedup,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_line_dedup": op5_line_dedup,
        "op6_language_id": op6_language_id,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_packing": op8_packing,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_decontamination": op10_decontamination,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_filter_audit": op12_filter_audit,
        "op13_token_counts": op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    from textquarry.llm import audit, lines, topk

    return {"op1_exact_topk": topk.ORACLE_SQL, "op5_line_dedup": lines.ORACLE_SQL, "op12_filter_audit": audit.ORACLE_SQL}
