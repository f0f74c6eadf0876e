"""The review log: append-only revisions, the state they add up to, search and export.

reviews: (extraction_id, record_id, revision, status, payload, reviewer, created); payload is JSON with the fields
that a review set. A field keeps the value of the last revision that set it, so corrections carry forward.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.spans import contains
from textquarry.functions.text import matches_terms

KEY = ["extraction_id", "record_id"]
STATUSES = ("pending", "approved", "rejected")
REVIEWS = "extraction_id string, record_id string, revision int, status string, payload string, reviewer string, created string"
RECORD_FIELDS = {"arm": "string", "endpoint": "string", "normalized_value": "string", "note": "string", "evidence": "struct<start:int,end:int,text:string>"}
ENTITY_FIELDS = {"type": "string", "canonical": "string", "note": "string", "normalization": "string"}
#: Entity types and their names.
TYPE_NAMES = {"bod": "身体", "dep": "科室", "dis": "疾病", "dru": "药物", "equ": "医疗设备", "ite": "医学检验", "mic": "微生物", "pro": "医疗程序", "sym": "临床表现"}
#: Relation participants' types as entity types.
PARTICIPANT_TYPES = {"疾病": "dis", "药物": "dru", "症状": "sym", "部位": "bod", "检查": "ite", "手术治疗": "pro", "其他治疗": "pro"}


def mapped(column, names: dict[str, str]):
    """A value by a fixed map, itself where the map hasn't it."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), column), column)


def latest(reviews: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """The state after all revisions: status, reviewer and created of the last, and each field's last value."""
    fields = fields or {}
    parsed = reviews.withColumn("_p", F.from_json("payload", "struct<" + ",".join(f"`{n}`:{t}" for n, t in fields.items()) + ">")) if fields else reviews
    last = [F.max_by(c, "revision").alias(c) for c in ("status", "reviewer", "created")]
    kept = [F.max_by(F.when(F.col(f"_p.{n}").isNotNull(), F.col(f"_p.{n}")), F.when(F.col(f"_p.{n}").isNotNull(), F.col("revision"))).alias(n) for n in fields]
    return parsed.groupBy(*KEY).agg(F.max("revision").alias("revision"), *last, *kept)


def history(reviews: DataFrame, extraction_id: str, record_id: str) -> DataFrame:
    return reviews.filter((F.col("extraction_id") == extraction_id) & (F.col("record_id") == record_id)).orderBy("revision")


def conflicts(reviews: DataFrame) -> DataFrame:
    """Revisions that don't follow the one before: gaps and repeats of (extraction, record, revision)."""
    order = Window.partitionBy(*KEY).orderBy("revision", "created", "reviewer")
    rows = reviews.withColumn("expected", F.coalesce(F.lag("revision").over(order), F.lit(0)) + 1)
    return rows.filter(F.col("revision") != F.col("expected"))


def append(reviews: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accept reviews (…, expected_revision, status, payload, reviewer, created) against the log: (new rows, conflicts).

    One review of a record is accepted at a time: the earliest of those that expect the current revision.
    """
    now = reviews.groupBy(*KEY).agg(F.max("revision").alias("_now"))
    rows = incoming.join(now, KEY, "left").withColumn("_now", F.coalesce("_now", F.lit(0)))
    bad = ~F.coalesce(F.col("status"), F.lit("")).isin(*STATUSES) | (F.trim(F.coalesce("reviewer", F.lit(""))) == "")
    fits = (F.col("expected_revision") == F.col("_now")) & ~bad
    order = Window.partitionBy(*KEY, fits).orderBy("created", "reviewer", "payload")
    rows = rows.withColumn("_fits", fits).withColumn("_n", F.row_number().over(order))
    reason = F.when(bad, "invalid").when(~F.col("_fits") | (F.col("_n") > 1), "revision_changed")
    rows = rows.withColumn("reason", reason).withColumn("revision", (F.col("_now") + 1).cast("int"))
    columns = [*KEY, "revision", "status", "payload", "reviewer", "created"]
    return rows.filter("reason IS NULL").select(*columns), rows.filter("reason IS NOT NULL").select(*KEY, "expected_revision", F.col("_now").alias("current"), "reviewer", "reason")


def reviewed_records(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """records (extraction_id, id, status, arm, endpoint, normalized_value, start, end, text, ...) as the log leaves them."""
    state = latest(reviews, RECORD_FIELDS)
    names = {"status", "reviewer", "created", "revision", *RECORD_FIELDS}
    state = state.select(F.col("extraction_id").alias("_x"), F.col("record_id").alias("_r"), *(F.col(c).alias(f"_n_{c}") for c in sorted(names)))
    rows = records.join(state, (F.col("extraction_id") == F.col("_x")) & (F.col("id") == F.col("_r")), "left")
    for c in ("status", "arm", "endpoint", "normalized_value"):
        old = F.col(c) if c in records.columns else F.lit(None).cast("string")
        rows = rows.withColumn(c, F.coalesce(f"_n_{c}", old))
    rows = rows.withColumn("status", F.coalesce("status", F.lit("pending"))).withColumn("note", F.col("_n_note")).withColumn("reviewer", F.col("_n_reviewer")).withColumn("reviewed_at", F.col("_n_created"))
    for c in ("start", "end", "text"):
        if c in records.columns:
            rows = rows.withColumn(c, F.coalesce(f"_n_evidence.{c}", c))
    return rows.withColumn("narrowed", F.col("_n_evidence").isNotNull()).withColumn("revision", F.coalesce("_n_revision", F.lit(0))).drop("_x", "_r", *(f"_n_{c}" for c in names))


def evidence_errors(corrections: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Corrected spans (key, start, end, text) that are refused: bad offsets, another text, not within one block; null reason if fine."""
    rows = corrections.join(documents.select(F.col(key).alias("_k"), F.col("text").alias("_text"), "blocks"), F.col(key) == F.col("_k"), "left").drop("_k")
    a, b = F.col("start"), F.col("end")
    holder = F.element_at(F.filter("blocks", lambda x: contains(x["start"], x["end"], a, b)), 1)
    reason = (
        F.when(F.col("_text").isNull(), "no_document")
        .when(a.isNull() | b.isNull() | (a < 0) | (a >= b) | (b > F.length("_text")), "invalid_offsets")
        .when(F.substring("_text", a + 1, b - a) != F.col("text"), "not_the_source_text")
        .when(F.size(F.filter("blocks", lambda x: contains(x["start"], x["end"], a, b))) == 0, "not_within_one_block")
    )
    rows = rows.withColumn("reason", reason)
    return rows.withColumn("block", F.when(F.col("reason").isNull(), holder["id"])).withColumn("section", F.when(F.col("reason").isNull(), holder["section"])).withColumn("locator", F.when(F.col("reason").isNull(), holder["locator"])).drop("_text", "blocks")


def rebuilt(narrowed: DataFrame, entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Evidence that a review narrowed, with numbers, qualifiers, bindings, mentions and sources of the new span alone.

    narrowed: (key, id, category, start, end, text, block, section, locator, kind). The first sentence of the span with the
    record's category counts; without one its numbers, bindings and qualifiers are empty.
    """
    from textquarry.operators.evidence import QUALIFIERS, candidates, provenance
    from textquarry.sources.documents import sentences

    block = F.array(F.struct(F.col("block").alias("id"), "text", "section", F.col("kind").alias("kind"), "locator", "start", "end"))
    unit = narrowed.withColumn("_u", F.concat_ws("\x00", F.col(key).cast("string"), "id")).withColumn("blocks", block)
    found = candidates(sentences(unit, "_u"), key="_u")
    first = found.groupBy("_u", "category").agg(F.min_by(F.struct("numbers", "qualifiers", "binding_suggestions", "binding_abstentions"), "start").alias("f"))
    rows = unit.drop("blocks").join(first.withColumnRenamed("category", "_c"), ["_u"], "left").filter(F.col("_c").isNull() | (F.col("_c") == F.col("category")))
    lost = unit.drop("blocks").join(rows.select("_u"), "_u", "left_anti")
    rows = rows.drop("_c").unionByName(lost, allowMissingColumns=True)
    no_spans = F.array().cast("array<struct<start:int,end:int,text:string>>")
    empty = F.create_map(*(x for n in QUALIFIERS for x in (F.lit(n), no_spans)))
    rows = rows.withColumn("numbers", F.coalesce("f.numbers", F.filter("f.numbers", lambda x: F.lit(False)))).withColumn("qualifiers", F.coalesce("f.qualifiers", empty))
    rows = rows.withColumn("binding_suggestions", F.col("f.binding_suggestions")).withColumn("binding_abstentions", F.col("f.binding_abstentions")).drop("f")
    rows = rows.withColumn("provenance", provenance(F.col("text"), F.col("start")))
    e = entities.select(F.col(key).alias("_k"), F.col("id").alias("_e"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    held = rows.select("_u", key, "start", "end").join(e, (F.col(key) == F.col("_k")) & contains(F.col("start"), F.col("end"), F.col("_a"), F.col("_b"))).groupBy("_u").agg(F.array_sort(F.collect_list("_e")).alias("mentions"))
    return rows.join(held, "_u", "left").withColumn("mentions", F.coalesce("mentions", F.array().cast("array<string>"))).drop("_u")


def reviewed_entities(entities: DataFrame, reviews: DataFrame) -> DataFrame:
    """entities (extraction_id, id, text, type, canonical, ...) as the log leaves them; what the model said stays beside."""
    from textquarry.operators.alias import concept_id

    state = latest(reviews, ENTITY_FIELDS).select(F.col("extraction_id").alias("_x"), F.col("record_id").alias("_r"), *(F.col(c).alias(f"_n_{c}") for c in ("status", "revision", "reviewer", *ENTITY_FIELDS)))
    rows = entities.join(state, (F.col("extraction_id") == F.col("_x")) & (F.col("id") == F.col("_r")), "left")
    own = F.coalesce(F.col("canonical"), F.col("text")) if "canonical" in entities.columns else F.col("text")
    rows = rows.withColumn("model_type", F.col("type")).withColumn("model_canonical", own).withColumn("canonical", F.coalesce("_n_canonical", own)).withColumn("type", F.coalesce("_n_type", "type"))
    status = F.col("status") if "status" in entities.columns else F.lit(None).cast("string")
    rows = rows.withColumn("status", F.coalesce("_n_status", status, F.lit("pending"))).withColumn("revision", F.coalesce("_n_revision", F.lit(0))).withColumn("reviewer", F.col("_n_reviewer"))
    rows = rows.withColumn("concept_id", concept_id(F.col("type"), F.col("canonical"))).withColumn("type_name", mapped(F.col("type"), TYPE_NAMES))
    return rows.drop("_x", "_r", *(f"_n_{c}" for c in ("status", "revision", "reviewer", *ENTITY_FIELDS)))


def status_counts(rows: DataFrame, by: str = "extraction_id") -> DataFrame:
    return rows.groupBy(by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def search(records: DataFrame, query: str, most: int = 50) -> DataFrame:
    """Records whose evidence holds every term of the query, 50 at most by default."""
    return records.filter(matches_terms(F.col("text"), query)).select("extraction_id", F.col("id").alias("record_id"), "text").orderBy("extraction_id", "record_id").limit(most)


def listing(rows: DataFrame, created: str = "created", *ties: str, most: int | None = None) -> DataFrame:
    """Newest first."""
    rows = rows.orderBy(F.desc(created), *ties)
    return rows if most is None else rows.limit(most)


def approved_export(records: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, entities, concepts) for an export: approved records; entities that are approved or cited by one of
    them, without rejected ones; mentions and concepts of these alone."""
    from textquarry.operators.alias import concepts

    approved = records.filter("status = 'approved'")
    cited = approved.select("extraction_id", F.explode("mentions").alias("id")).distinct().withColumn("_cited", F.lit(True))
    kept = entities.join(cited, ["extraction_id", "id"], "left").filter("(status = 'approved' OR _cited) AND status <> 'rejected'").drop("_cited")
    # each different list of mentions once, its ids looked up one by one
    alive = kept.select("extraction_id", "id").distinct()
    each = approved.select("extraction_id", F.col("mentions").alias("_m")).distinct().select("extraction_id", "_m", F.posexplode("_m").alias("_p", "id")).join(alive, ["extraction_id", "id"])
    lists = each.groupBy(F.col("extraction_id").alias("_e"), "_m").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "id"))), lambda x: x["id"]).alias("_pruned"))
    rows = approved.join(lists, (F.col("extraction_id") == F.col("_e")) & (F.col("mentions") == F.col("_m")), "left")
    pruned = F.when(F.col("mentions").isNotNull(), F.coalesce("_pruned", F.array().cast("array<string>")))
    rows = rows.withColumn("_kept", pruned).withColumn("omitted_rejected_mentions", F.size("mentions") - F.size("_kept"))
    rows = rows.withColumn("mentions", F.col("_kept")).drop("_kept", "_pruned", "_e", "_m")
    return rows, kept, concepts(kept, "extraction_id")


def full_export(records: DataFrame, entities: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Everything, and the revisions of each record and entity that has any."""
    revisions = reviews.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("revision", "status", "payload", "reviewer", "created"))).alias("history"))
    return records, entities, revisions


def retry_after(failures: DataFrame, limit: int = 5, window: int = 900) -> DataFrame:
    """(client, ts seconds) → failures within the window before each, and the seconds to wait once there are ``limit``."""
    recent = Window.partitionBy("client").orderBy("ts").rangeBetween(-window + 1, 0)
    rows = failures.withColumn("recent", F.count("*").over(recent)).withColumn("_first", F.min("ts").over(recent))
    return rows.withColumn("retry_after", F.when(F.col("recent") >= limit, F.greatest(F.lit(1), window - (F.col("ts") - F.col("_first")))).otherwise(0)).drop("_first")
