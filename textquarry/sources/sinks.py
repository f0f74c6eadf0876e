"""Sinks: split files, audits, manifests, documents that are stored once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def row_digest(*columns: Column | str) -> Column:
    """SHA-256 of a row as JSON."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def fingerprint(rows: DataFrame, by: str | None = None) -> DataFrame:
    """One digest of a set of rows, whatever their order and partitions: (by, rows, fingerprint).

    Row digests are added up in eight 32-bit lanes, so that no task holds all of them; the sums are hashed.
    """
    h = rows.select(*([by] if by else []), row_digest(*sorted(c for c in rows.columns if c != by)).alias("h"))
    lanes = [F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"l{k}") for k in range(8)]
    sums = (h.groupBy(by) if by else h.groupBy()).agg(F.count("*").alias("rows"), *lanes)
    return sums.select(*([by] if by else []), "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *(f"l{k}" for k in range(8))), 256).alias("fingerprint"))


def write_splits(rows: DataFrame, path: str, fmt: str = "json") -> DataFrame:
    """Write a folder for each split and return the fingerprints of the splits. An existing version stays."""
    rows.write.partitionBy("split").mode("errorifexists").format(fmt).save(path)
    return fingerprint(rows, "split")


def manifest(clean: DataFrame, rejected: DataFrame, seed: int | str = 42, provenance: str = "user-provided") -> DataFrame:
    """One row: counts, labels, counts by split and label, reasons, split fingerprints and that of the dataset."""
    counts = clean.groupBy("split", "label").count()
    by_split = counts.groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "count")))).alias("c"))
    by_split = by_split.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "c")), lambda a, b: F.when(a["split"] < b["split"], -1).otherwise(1))).alias("counts"))
    labels = counts.agg(F.array_sort(F.collect_set("label")).alias("labels"), F.coalesce(F.sum("count"), F.lit(0)).alias("accepted_rows"))
    reasons = rejected.groupBy("reason").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "count")))).alias("reasons"), F.coalesce(F.sum("count"), F.lit(0)).alias("rejected_rows"))
    prints = fingerprint(clean, "split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "fingerprint")))).alias("split_sha256"))
    one = labels.crossJoin(by_split).crossJoin(reasons).crossJoin(prints)  # single rows
    whole = F.sha2(F.to_json("split_sha256"), 256).alias("dataset_sha256")
    return one.select((F.col("accepted_rows") + F.col("rejected_rows")).alias("input_rows"), "accepted_rows", "rejected_rows", "labels", "counts", "reasons", "split_sha256", whole, F.lit(str(seed)).alias("seed"), F.lit(provenance).alias("provenance"))


def save_evaluation(details: DataFrame, metrics: DataFrame, path: str) -> None:
    """Metrics, all predictions and the wrong ones (correct = false), each a table below ``path``."""
    metrics.write.mode("errorifexists").parquet(f"{path}/metrics")
    details.write.mode("errorifexists").parquet(f"{path}/predictions")
    details.filter("NOT correct").write.mode("errorifexists").parquet(f"{path}/errors")


def new_documents(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents whose text isn't stored yet, each text once: by sha256, the smallest raw digest first."""
    rest = [c for c in incoming.columns if c != "sha256"]
    once = incoming.groupBy("sha256").agg(F.min_by(F.struct(*rest), F.struct("raw_sha256", F.to_json(F.struct("metadata")))).alias("d")).select("sha256", "d.*")
    return once.join(stored.select("sha256"), "sha256", "left_anti").withColumn("id", F.substring(F.sha2(F.concat(F.lit("document:"), "sha256"), 256), 1, 32))


def add_documents(spark: SparkSession, incoming: DataFrame, path: str) -> DataFrame:
    """Append the documents that aren't stored yet to a table; return the stored rows of all incoming ones."""
    try:
        stored = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = None
    fresh = new_documents(incoming, stored if stored is not None else spark.createDataFrame([], "sha256 string"))
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(fresh.schema).parquet(path).join(incoming.select("sha256").distinct(), "sha256", "left_semi")
