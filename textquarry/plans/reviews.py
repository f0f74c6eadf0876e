"""Review queries: conversations are records, turns are revisions, roles are statuses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textquarry.operators import review
from textquarry.session import load

STATUS = {"user": "approved", "assistant": "rejected"}


def log(spark, sf):
    c = load(spark, sf, "conversations")
    status = F.when(F.col("role") == "user", "approved").when(F.col("role") == "assistant", "rejected").otherwise("pending")
    payload = F.to_json(F.struct(F.when(F.col("turn") % 2 == 0, F.col("role")).alias("endpoint"), F.when(F.col("turn") % 3 == 0, F.substring("text", 1, 10)).alias("note")))
    return c.select(F.concat(F.lit("x"), (F.col("conv_id") % 5).cast("string")).alias("extraction_id"), F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("record_id"), (F.col("turn") + 1).cast("int").alias("revision"), status.alias("status"), payload.alias("payload"), F.col("role").alias("reviewer"), F.col("turn").cast("string").alias("created"))


L = "l AS (SELECT 'x' || (conv_id % 5) AS extraction_id, 'r' || conv_id AS record_id, (turn + 1)::INTEGER AS revision, CASE role WHEN 'user' THEN 'approved' WHEN 'assistant' THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN turn % 2 = 0 THEN role END AS endpoint, CASE WHEN turn % 3 = 0 THEN substr(text, 1, 10) END AS note, role AS reviewer FROM conversations)"


def latest_revision(spark, sf):
    return review.latest(log(spark, sf), {"endpoint": "string", "note": "string"}).select("extraction_id", "record_id", "revision", "status", "reviewer", "endpoint", "note")


def revision_conflicts(spark, sf):
    rows = log(spark, sf).withColumn("revision", F.when((F.col("revision") == 3) & F.col("record_id").endswith("7"), 5).otherwise(F.col("revision")))
    return review.conflicts(rows).select("record_id", "revision", "expected")


def accepted_reviews(spark, sf):
    rows = log(spark, sf)
    incoming = rows.select("extraction_id", "record_id", (F.col("revision") + 1).alias("expected_revision"), "status", "payload", "reviewer", "created")
    new, _ = review.append(rows, incoming.withColumn("expected_revision", F.col("expected_revision") - 1))
    return new.select("record_id", "revision", "status")


def review_status_counts(spark, sf):
    return review.status_counts(review.latest(log(spark, sf)))


def review_history(spark, sf):
    return review.history(log(spark, sf), "x1", "r1").select("revision", "status", "reviewer")


def reviewed_records(spark, sf):
    records = load(spark, sf, "conversations").filter("turn = 0").select(F.concat(F.lit("x"), (F.col("conv_id") % 5).cast("string")).alias("extraction_id"), F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("id"), F.lit("none").alias("endpoint"), "text")
    return review.reviewed_records(records, log(spark, sf)).select("id", "status", "endpoint", "note", "revision")


def approved_export(spark, sf):
    records = load(spark, sf, "conversations").groupBy("conv_id").agg(F.min("text").alias("text"))
    records = records.select(F.concat(F.lit("x"), (F.col("conv_id") % 5).cast("string")).alias("extraction_id"), F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("id"), "text", F.array(*(F.concat(F.lit("e"), ((F.col("conv_id") * 3 + k) % 40).cast("string")) for k in range(3))).alias("mentions"))
    x, n = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("n")
    ents = spark.range(1).select(x).select("x", n)
    ents = ents.select(F.concat(F.lit("x"), F.col("x").cast("string")).alias("extraction_id"), F.concat(F.lit("e"), F.col("n").cast("string")).alias("id"), F.when(F.col("n") % 7 == 0, "rejected").when(F.col("n") % 5 == 0, "approved").otherwise("pending").alias("status"), F.lit("c").alias("canonical"), F.lit("t").alias("type"), F.lit("id").alias("concept_id"))
    rows, kept, _ = review.approved_export(review.reviewed_records(records, log(spark, sf)), ents)
    a = rows.groupBy("extraction_id").agg(F.count("*").alias("records"), F.sum("omitted_rejected_mentions").alias("omitted"))
    return a.join(kept.groupBy("extraction_id").agg(F.count("*").alias("entities")), "extraction_id")


def evidence_search(spark, sf):
    rows = load(spark, sf, "documents").select(F.col("source").alias("extraction_id"), F.col("doc_id").cast("string").alias("id"), "text")
    return review.search(rows, "the IDIOT", 50)


def newest_listing(spark, sf):
    return review.listing(load(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), "o_orderdate", "o_orderkey", most=100).select("o_orderkey", "o_orderpriority")


def conversation_sections(spark, sf):
    c = load(spark, sf, "conversations")
    section = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return c.select("conv_id", "turn", section.alias("section"))


def failure_throttle(spark, sf):
    rows = load(spark, sf, "events").select((F.col("user_id") % 20).alias("client"), F.unix_timestamp("ts").alias("ts"))
    found = review.retry_after(rows, 2, 3600)
    return found.groupBy("client").agg(F.max("recent").alias("most"), F.sum("retry_after").cast("long").alias("waits"))


def event_windows(spark, sf):
    e = load(spark, sf, "events")
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n")


QUERIES = {
    "latest_revision": (latest_revision, f"WITH {L} SELECT extraction_id, record_id, max(revision) AS revision, arg_max(status, revision) AS status, arg_max(reviewer, revision) AS reviewer, arg_max(endpoint, revision) FILTER (WHERE endpoint IS NOT NULL) AS endpoint, arg_max(note, revision) FILTER (WHERE note IS NOT NULL) AS note FROM l GROUP BY 1, 2"),
    "revision_conflicts": (revision_conflicts, f"WITH {L}, m AS (SELECT record_id, extraction_id, CASE WHEN revision = 3 AND record_id LIKE '%7' THEN 5 ELSE revision END AS revision, reviewer, revision AS o FROM l), e AS (SELECT *, (coalesce(lag(revision) OVER (PARTITION BY extraction_id, record_id ORDER BY revision, (o - 1)::VARCHAR, reviewer), 0) + 1)::INTEGER AS expected FROM m) SELECT record_id, revision, expected FROM e WHERE revision <> expected"),
    "accepted_reviews": (accepted_reviews, f"WITH {L} SELECT record_id, (max(revision) + 1)::INTEGER AS revision, arg_max(status, revision) AS status FROM l GROUP BY record_id"),
    "review_status_counts": (review_status_counts, f"WITH {L}, s AS (SELECT extraction_id, record_id, arg_max(status, revision) AS status FROM l GROUP BY 1, 2) SELECT extraction_id, count(*) FILTER (WHERE status = 'pending')::BIGINT AS pending, count(*) FILTER (WHERE status = 'approved')::BIGINT AS approved, count(*) FILTER (WHERE status = 'rejected')::BIGINT AS rejected FROM s GROUP BY 1"),
    "review_history": (review_history, f"WITH {L} SELECT revision, status, reviewer FROM l WHERE extraction_id = 'x1' AND record_id = 'r1'"),
    "reviewed_records": (reviewed_records, f"WITH {L}, s AS (SELECT record_id AS id, arg_max(status, revision) AS status, coalesce(arg_max(endpoint, revision) FILTER (WHERE endpoint IS NOT NULL), 'none') AS endpoint, arg_max(note, revision) FILTER (WHERE note IS NOT NULL) AS note, max(revision) AS revision FROM l GROUP BY 1) SELECT s.* FROM s JOIN (SELECT DISTINCT 'r' || conv_id AS id FROM conversations WHERE turn = 0) USING (id)"),
    "approved_export": (approved_export, f"""WITH {L}, s AS (SELECT record_id, extraction_id, arg_max(status, revision) AS status FROM l GROUP BY 1, 2), r AS (SELECT extraction_id, record_id, substr(record_id, 2)::BIGINT AS c FROM s WHERE status = 'approved'),
m AS (SELECT extraction_id, record_id, (c * 3 + k) % 40 AS n FROM r CROSS JOIN (SELECT unnest(range(3)) AS k)), e AS (SELECT 'x' || x AS extraction_id, n, CASE WHEN n % 7 = 0 THEN 'rejected' WHEN n % 5 = 0 THEN 'approved' ELSE 'pending' END AS status FROM (SELECT unnest(range(5)) AS x) CROSS JOIN (SELECT unnest(range(40)) AS n)),
k AS (SELECT * FROM e WHERE status <> 'rejected' AND (status = 'approved' OR (extraction_id, n) IN (SELECT (extraction_id, n) FROM m)))
SELECT a.extraction_id, records, omitted, entities FROM (SELECT extraction_id, count(*)::BIGINT AS records FROM r GROUP BY 1) a JOIN (SELECT extraction_id, count(*) FILTER (WHERE n % 7 = 0)::BIGINT AS omitted FROM m GROUP BY 1) b USING (extraction_id) JOIN (SELECT extraction_id, count(*)::BIGINT AS entities FROM k GROUP BY 1) c USING (extraction_id)"""),
    "evidence_search": (evidence_search, "SELECT source AS extraction_id, doc_id::VARCHAR AS record_id, text FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'idiot') ORDER BY 1, 2 LIMIT 50"),
    "newest_listing": (newest_listing, "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100"),
    "conversation_sections": (conversation_sections, "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations"),
    "failure_throttle": (failure_throttle, "WITH r AS (SELECT user_id % 20 AS client, floor(epoch(ts))::BIGINT AS ts FROM events), w AS (SELECT client, ts, count(*) OVER x AS recent, min(ts) OVER x AS f FROM r WINDOW x AS (PARTITION BY client ORDER BY ts RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)) SELECT client, max(recent)::BIGINT AS most, sum(CASE WHEN recent >= 2 THEN greatest(1, 3600 - (ts - f)) ELSE 0 END)::BIGINT AS waits FROM w GROUP BY 1"),
    "event_windows": (event_windows, "SELECT (floor(epoch(ts) / 21600) * 21600)::BIGINT AS \"start\", event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2"),
}
