"""Documents and reviews as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def distinct_documents(stream: DataFrame, text: str = "text", time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each text once, by its digest. With an event time, state older than the delay is dropped."""
    keyed = stream.withColumn("sha256", F.sha2(text, 256))
    if time is None:
        return keyed.dropDuplicates(["sha256"])
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["sha256"])


def store_documents(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Parse and append new documents batch by batch, idempotently: a batch that runs again finds its texts stored."""
    from textquarry.sources.documents import parse_documents
    from textquarry.sources.sinks import add_documents

    def batch(rows: DataFrame, _: int) -> None:
        parsed = parse_documents(rows).filter("error IS NULL")
        add_documents(rows.sparkSession, parsed, path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_reviews(stream: DataFrame) -> DataFrame:
    """The last revision of each record, as an aggregate that is kept up to date (output mode complete or update)."""
    last = F.max_by(F.struct("status", "payload", "reviewer", "created"), F.col("revision"))
    return stream.groupBy("extraction_id", "record_id").agg(F.max("revision").alias("revision"), last.alias("r")).select("extraction_id", "record_id", "revision", "r.*")


def windowed_counts(stream: DataFrame, time: str, width: str, slide: str | None = None, delay: str = "10 minutes", *by: str) -> DataFrame:
    """Counts by event-time windows, late rows up to the delay."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(window, *by).agg(F.count("*").alias("n")).select("window.start", "window.end", *by, "n")
