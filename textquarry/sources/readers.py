"""Scans with line numbers and explicit schemas. Bad lines go to an audit, unless the format asks for a stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOM = "﻿"


def with_line_number(df: DataFrame, name: str, start: int = 1) -> DataFrame:
    """Number the rows of a scan of files, each file from ``start``, whatever blocks it is read in.

    It is part of the query, not a job before it: one pass counts the rows of each block of a file, and the sums of the
    blocks before, a row for each block, are broadcast to the other.
    """
    block = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    tagged = df.select("*", *block, F.monotonically_increasing_id().alias("_row"))
    sizes = tagged.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_row").alias("_first"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_file", "_block", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    numbered = tagged.join(F.broadcast(bases), ["_file", "_block"])
    return numbered.withColumn(name, F.col("_base") + F.col("_row") - F.col("_first") + start).drop("_file", "_block", "_row", "_first", "_base")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(text, label, split, source_line): a CSV file with a header that has text and label; records count from 2."""
    header = spark.read.text(path).limit(1).collect()
    columns = [c.strip().strip('"') for c in header[0].value.lstrip(BOM).split(",")] if header else []
    if not {"text", "label"} <= set(columns):
        raise ValueError("the CSV needs the columns text and label")
    rows = spark.read.csv(path, header=True, multiLine=True, schema=", ".join(f"`{c}` string" for c in columns), enforceSchema=True, escape='"')
    rows = with_line_number(rows, "source_line", 2)
    return rows.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("label", F.lit("")).alias("label"), (F.col("split") if "split" in columns else F.lit(None).cast("string")).alias("split"), "source_line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, source_line): the lines of a text file that aren't blank, without a byte order mark."""
    lines = with_line_number(spark.read.text(path), "source_line")
    value = F.when(F.col("source_line") == 1, F.regexp_replace("value", f"^{BOM}", "")).otherwise(F.col("value"))
    return lines.withColumn("value", value).filter(F.trim("value") != "")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """(record variant, source_line): a JSON Lines file; the first malformed line stops the scan."""
    rows = read_lines(spark, path).withColumn("record", F.try_parse_json("value"))
    bad = rows.filter("record IS NULL").orderBy("source_line").limit(1).collect()
    if bad:
        raise ValueError(f"line {bad[0].source_line} is no valid JSON")
    return rows.select("record", "source_line")


def string_field(record: Column, name: str) -> Column:
    """A field of a variant if it is a string, else null."""
    kind = F.schema_of_variant(F.try_variant_get(record, f"$.{name}", "variant"))
    return F.when(kind == "STRING", F.try_variant_get(record, f"$.{name}", "string"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(text, label, split, source_line); fields that are no strings are null. A split that is no string becomes '?'."""
    rows, split = read_variants(spark, path), F.try_variant_get("record", "$.split", "variant")
    kind = F.schema_of_variant(split)
    known = F.when(split.isNull() | (kind == "VOID"), F.lit(None)).when(kind == "STRING", string_field(F.col("record"), "split")).otherwise(F.lit("?"))
    return rows.select(string_field(F.col("record"), "text").alias("text"), string_field(F.col("record"), "label").alias("label"), known.alias("split"), "source_line")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Labelled rows by the file's suffix."""
    suffix = path.rsplit(".", 1)[-1].lower()
    readers = {"csv": read_csv, "jsonl": read_jsonl}
    if suffix not in readers:
        raise ValueError("only UTF-8 CSV and JSON Lines files are read")
    return readers[suffix](spark, path)


def read_json_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or JSON Lines, whichever the first character says."""
    first = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
    array = bool(first) and first[0].value.lstrip(BOM).lstrip().startswith("[")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=array)


def read_tsv_labels(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """(text, label, source_line): lines of text, tab, class number. A number out of range or an empty text stops the scan."""
    rows = with_line_number(spark.read.text(path), "source_line")
    number = F.regexp_extract("value", r"\t\s*(\d+)\s*$", 1)
    rows = rows.select(F.regexp_extract("value", r"^(.*)\t[^\t]*$", 1).alias("text"), F.when(number != "", number.cast("int")).alias("id"), "source_line")
    bad = rows.filter(F.col("id").isNull() | (F.col("id") >= len(classes)) | (F.trim("text") == "")).orderBy("source_line").limit(1).collect()
    if bad:
        raise ValueError(f"line {bad[0].source_line} is no valid record")
    names = F.array(*map(F.lit, classes))
    return rows.select("text", F.element_at(names, F.col("id") + 1).alias("label"), "source_line")


def read_runs(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Run descriptions below a folder (``*/run.json``), newest name first, with the folder's name as run."""
    rows = spark.read.schema(schema).json(pattern, multiLine=True)
    return rows.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)).orderBy(F.desc("run"))


def verify_bytes(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, size, sha256, git_sha1) of whole files, for a comparison with pinned digests."""
    from textquarry.functions.text import git_blob_sha1

    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), git_blob_sha1(F.col("content")).alias("git_sha1"))
