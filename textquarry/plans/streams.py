"""Streams with state over files that are made from the driver's tables, one micro-batch for each file."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.plans import reviews
from textquarry.plans.storage import scratch
from textquarry.session import load
from textquarry.streaming import stateful


def _fed(spark, rows, cuts, path):
    """Write rows in parts, one file after another, and read them as a stream."""
    for part in cuts:
        rows.filter(part).coalesce(1).write.mode("append").parquet(path)  # a file is a micro-batch
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def streamed_reviews(spark, sf):
    """The log's turns as reviews; in some records the third expects a revision too far."""
    path = scratch(spark)
    rows = reviews.log(spark, sf).withColumn("turn", F.col("revision") - 1)
    wrong = (F.col("turn") == 2) & F.col("record_id").endswith("7")
    rows = rows.withColumn("expected_revision", F.when(wrong, F.col("turn") + 2).otherwise(F.col("turn"))).withColumn("created", F.format_string("%06d", "turn"))
    fed = _fed(spark, rows, ("turn < 1", "turn IN (1, 2)", "turn > 2"), f"{path}/in")
    stateful.store_reviews(fed, f"{path}/out", f"{path}/state").awaitTermination()
    both = [spark.read.parquet(f"{path}/out/{name}").select("record_id", F.col("created").cast("int").alias("turn"), "revision", "status", F.lit(name).alias("kept_in")) for name in ("reviews", "conflicts")]
    return both[0].unionAll(both[1])


def streamed_throttle(spark, sf):
    """Failures by event time; a last row from far ahead lets all timers fire."""
    path = scratch(spark)
    events = load(spark, sf, "events").select((F.col("user_id") % 20).cast("string").alias("client"), F.col("ts").cast("timestamp").alias("time"))
    end = events.agg(F.lit("end").alias("client"), (F.max("time") + F.expr("interval 2 days")).alias("time"))
    rows = events.unionAll(end)
    lo, hi = events.agg(F.percentile_approx(F.unix_timestamp("time"), [0.3, 0.7], 100)).first()[0]
    at = F.unix_timestamp("time")
    fed = _fed(spark, rows, ((F.col("client") != "end") & (at <= lo), (F.col("client") != "end") & (at > lo) & (at <= hi), (F.col("client") != "end") & (at > hi), F.col("client") == "end"), f"{path}/in")
    stateful.stored(stateful.retry_after(fed, 2, 3600), f"{path}/out", f"{path}/state").awaitTermination()
    found = spark.read.schema(stateful.WAITS).parquet(f"{path}/out").filter("client <> 'end'")
    return found.groupBy(F.col("client").cast("long").alias("client")).agg(F.max("recent").alias("most"), F.sum("retry_after").alias("waits"))


QUERIES = {
    "streamed_reviews": (streamed_reviews, "SELECT 'r' || conv_id AS record_id, turn::INTEGER AS turn, CASE WHEN conv_id % 10 = 7 AND turn >= 2 THEN 2 ELSE turn + 1 END::INTEGER AS revision, CASE role WHEN 'user' THEN 'approved' WHEN 'assistant' THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN conv_id % 10 = 7 AND turn >= 2 THEN 'conflicts' ELSE 'reviews' END AS kept_in FROM conversations"),
    "streamed_throttle": (streamed_throttle, reviews.QUERIES["failure_throttle"][1]),
}
