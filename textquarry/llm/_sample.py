"""Bounded samples of labelled documents for the classifiers. All else covers all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm._shared import written

#: Chosen rows up to which the join with the documents is a broadcast one.
BROADCAST_ROWS = 1 << 17


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def chosen(labelled: DataFrame, per_label: int | Column) -> DataFrame:
    """(doc_id, label, n) of at most ``per_label`` documents of each label, chosen by the hash of doc_id.

    labelled: (doc_id, label). All labels are told apart, and the choice doesn't depend on partitions. Before rows
    are ranked, a cutoff that follows from the labels' counts leaves about as many as are wanted, so no task gets
    more than a few times the sample. n: how many documents have the label.
    """
    rows = labelled.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))).withColumn("most", per_label if isinstance(per_label, Column) else F.lit(per_label))
    counts = written(rows.groupBy("label").agg(F.count("*").alias("n")), "labels")  # so that the join knows its size
    near = rows.join(counts, "label").filter(F.col("h") < F.lit(float(1 << 40)) * (1.2 * F.col("most") + 200) / F.col("n"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))).filter(F.col("rank") <= F.col("most")).select("doc_id", "label", "n")


def sampled(labelled: DataFrame, docs: DataFrame, per_label: int | Column) -> DataFrame:
    """(doc_id, label, n, text): the rows of docs (doc_id, text) that are chosen; repeated doc_ids come as they are."""
    own = written(chosen(labelled, per_label).withColumnRenamed("doc_id", "chosen"), "chosen")
    if own.count() <= BROADCAST_ROWS:
        own = F.broadcast(own)
    return docs.join(own, F.col("doc_id") == F.col("chosen")).select("doc_id", "label", "n", "text")


def piece(text: Column, doc_id: Column, most: int) -> Column:
    """The text, or of a text with more than ``most`` characters so many from a place that the hash of doc_id chooses."""
    first = F.pmod(F.xxhash64(doc_id), F.greatest(F.length(text) - F.lit(most), F.lit(0)) + 1) + 1
    return F.when(F.length(text) > most, F.substring(text, first.cast("int"), F.lit(most))).otherwise(text)
