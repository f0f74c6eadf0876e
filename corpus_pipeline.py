"""A corpus pipeline of the operators in ``textquarry.llm``: filter, deduplicate, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import decontam, jaccard, lines, packing, toxicity
from textquarry.llm._shared import pick, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.5 go. The model learns from the labels of the documents at hand."""
    docs = pick(docs, *COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter(F.col("score") < 0.5).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go; n_chars follows the text. A null text stays null."""
    docs = pick(docs, *COLUMNS)
    return lines.dedup_lines(docs, keep=COLUMNS).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash links and those it misses, at five-word Jaccard of 0.8 or more) one row stays: that with the smallest doc_id, of equal or no doc_ids the first text in order."""
    found = jaccard.near_copies(pick(docs, *COLUMNS))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text", "lang", "source", "n_chars")
    return found.groupBy("group").agg(F.min(first).alias("r")).select(*(f"r.{c}" for c in COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontam.leaks(pick(docs, *COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("leaks_") == 0).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens along the curve."""
    return packing.query(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can express neither the learned classifier nor the fingerprints; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
