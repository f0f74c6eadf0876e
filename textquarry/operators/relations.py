"""Relation schemas, annotated records, candidate pairs and decoding.

Long form: entities are rows (doc_id, start, end, type, score), triples rows (doc_id, s_start, s_end, s_type,
rel, o_start, o_end, o_type, score). Scores come in as tables; models run elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.functions.spans import count_of, first_at, substring_of, token_of
from textquarry.functions.stats import sigmoid

RECORD = "struct<text:string,spo_list:array<struct<subject:string,subject_type:string,predicate:string,object:map<string,string>,object_type:map<string,string>>>>"
TRIPLE = ["s_start", "s_end", "s_type", "rel", "o_start", "o_end", "o_type"]
CAP, WIDTH = 64, 64
#: Edges of the buckets of distances between subject and object.
DISTANCE_EDGES = [-64, -32, -16, -8, -4, -2, -1, 0, 1, 2, 4, 8, 16, 32, 64]


def schema_items(schema: DataFrame) -> DataFrame:
    """(predicate, subject_type, object_type map) → (id, predicate, slot, subject_type, object_type, label), ids by order.

    A schema is user data of at most 128 slots, so one task orders it.
    """
    slots = schema.select("predicate", "subject_type", F.explode("object_type").alias("slot", "object_type"))
    order = Window.orderBy("predicate", "slot", "subject_type", "object_type")
    label = F.when(F.col("slot") == "@value", F.col("predicate")).otherwise(F.concat_ws(" / ", "predicate", "slot"))
    return slots.select((F.row_number().over(order) - 1).alias("id"), "predicate", "slot", "subject_type", "object_type", label.alias("label"))


def check_schema(schema: DataFrame) -> None:
    """1 to 64 predicates, at most 128 different slots, names of 1 to 80 characters."""
    n = schema.limit(65).count()
    if not 1 <= n <= 64:
        raise ValueError("a schema has 1 to 64 predicates")
    if schema.filter("object_type IS NULL OR size(object_type) = 0").limit(1).count():
        raise ValueError("object_type maps slots to types")
    slots = schema.select("predicate", "subject_type", F.explode("object_type").alias("slot", "object_type"))
    named = F.array("predicate", "subject_type", "slot", "object_type")
    if slots.filter(F.exists(named, lambda v: v.isNull() | (F.trim(v) == "") | (F.length(v) > 80))).limit(1).count():
        raise ValueError("names have 1 to 80 characters")
    total, different = slots.count(), slots.distinct().count()
    if total != different or total > 128:
        raise ValueError("slots must differ, and be 128 at most")


def convert_records(records: DataFrame, schema: DataFrame, *keys: str) -> DataFrame:
    """Records with spo_list → keys, text, triples (distinct, sorted), ambiguous_mentions, reason (null if accepted).

    Offsets are those of the first exact occurrence; a mention that occurs again counts as ambiguous. The schema is
    bounded user data (128 slots) and joins as a broadcast map inside the row.
    """
    text = F.col("text")
    items = schema.select(F.concat_ws("\x00", "predicate", "slot", "subject_type", "object_type").alias("k"), F.col("id").cast("int").alias("id"))
    lookup = F.broadcast(items.agg(F.map_from_entries(F.collect_list(F.struct("k", "id"))).alias("_schema")))
    rows = records.crossJoin(lookup)  # one row that holds the schema
    empty = F.coalesce(text.isNull() | (F.regexp_replace(text, r"(?U)\s", "") == ""), F.lit(True)) | F.coalesce(F.size("spo_list") == 0, F.lit(True)) | F.col("spo_list").isNull()
    flat = F.flatten(F.transform("spo_list", lambda s: F.transform(F.map_entries(s["object"]), lambda o: F.struct(
        s["subject"].alias("subject"), s["subject_type"].alias("s_type"), o["value"].alias("object"), F.element_at(s["object_type"], o["key"]).alias("o_type"),
        F.element_at(F.col("_schema"), F.concat_ws("\x00", s["predicate"], o["key"], s["subject_type"], F.element_at(s["object_type"], o["key"]))).alias("rel")))))
    rows = rows.withColumn("_m", F.when(~empty, flat))
    missing = lambda term: term.isNull() | (term == "") | ~F.contains(text, term)
    reason = (
        F.when(empty, "empty_text_or_no_relations")
        .when(F.exists("spo_list", lambda s: missing(s["subject"])), "subject_not_in_text")
        .when(F.exists("_m", lambda m: missing(m["object"])), "object_not_in_text")
        .when(F.exists("_m", lambda m: m["rel"].isNull()), "not_in_schema")
    )
    at = lambda term: first_at(text, term).cast("int")
    triples = F.transform("_m", lambda m: F.struct(
        at(m["subject"]).alias("s_start"), (at(m["subject"]) + F.length(m["subject"])).cast("int").alias("s_end"), m["s_type"].alias("s_type"), m["rel"].alias("rel"),
        at(m["object"]).alias("o_start"), (at(m["object"]) + F.length(m["object"])).cast("int").alias("o_end"), m["o_type"].alias("o_type")))
    twice = lambda array, of: F.size(F.filter(array, lambda x: count_of(text, of(x)) > 1))
    ambiguous = twice(F.col("spo_list"), lambda s: s["subject"]) + twice(F.col("_m"), lambda m: m["object"])
    rows = rows.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return rows.select(*keys, "text", F.when(ok, F.array_sort(F.array_distinct(triples))).alias("triples"), F.when(ok, ambiguous).alias("ambiguous_mentions"), "reason")


def entities(triples: DataFrame, *keys: str) -> DataFrame:
    """Participants of triples, each once: keys, start, end, type."""
    ends = F.array(F.struct(F.col("s_start").alias("start"), F.col("s_end").alias("end"), F.col("s_type").alias("type")), F.struct(F.col("o_start").alias("start"), F.col("o_end").alias("end"), F.col("o_type").alias("type")))
    return triples.select(*keys, F.inline(ends)).distinct()


def row_entities(triples: Column) -> Column:
    """The same inside a row: array<struct<start, end, type>>, sorted."""
    subjects = F.transform(triples, lambda t: F.struct(t["s_start"].alias("start"), t["s_end"].alias("end"), t["s_type"].alias("type")))
    objects = F.transform(triples, lambda t: F.struct(t["o_start"].alias("start"), t["o_end"].alias("end"), t["o_type"].alias("type")))
    return F.array_sort(F.array_union(subjects, objects))


def token_check(triples: Column, offsets: Column, most: int) -> Column:
    """Why a record doesn't fit its tokens, null if it does."""
    loose = F.exists(row_entities(triples), lambda e: token_of(offsets, e["start"], e["end"]).isNull())
    return F.when(F.size(offsets) > most, "too_many_tokens").when(loose, "not_at_token_boundaries")


def import_records(records: DataFrame, schema: DataFrame, seed: int | str = 42, most_characters: int = 6000, most_tokens: int = 128, least: int = 20, offsets=None):
    """User records (text, spo_list, split, source_line) → (clean rows with split, audit).

    An empty spo_list is a text annotated as having no relation; null isn't annotated and is refused. Leakage
    between given splits stops the run before conflicts are looked at; then a group of equal texts whose texts
    or triples differ goes as a whole; then the first stays. ``offsets``: text → tokens, characters by default.
    """
    from textquarry.functions.spans import character_tokens
    from textquarry.functions.text import seeded_order, text_key
    from textquarry.operators.clean import SPLITS, Cleaned
    from textquarry.operators.ranking import global_rank

    items = schema_items(schema)
    tokens = (offsets or character_tokens)(F.col("text"))
    first = (
        F.when(F.col("text").isNull() | (F.regexp_replace("text", r"(?U)\s", "") == ""), "no_text")
        .when(F.col("spo_list").isNull(), "no_annotation")
        .when(F.length("text") > most_characters, "text_too_long")
        .when(F.col("split").isNotNull() & ~F.col("split").isin(*SPLITS), "unknown_split")
    )
    rows = records.withColumn("_first", first).withColumn("_negative", F.coalesce(F.size("spo_list") == 0, F.lit(False)))
    rows = convert_records(rows, items, "source_line", "split", "_first", "_negative")
    rows = rows.withColumn("triples", F.when(F.col("_negative") & F.col("triples").isNull(), F.expr("filter(triples, x -> false)")).otherwise(F.col("triples")))
    none = F.from_json(F.lit("[]"), "array<struct<s_start:int,s_end:int,s_type:string,rel:int,o_start:int,o_end:int,o_type:string>>")
    rows = rows.withColumn("triples", F.when(F.col("_negative"), none).otherwise(F.col("triples"))).withColumn("ambiguous_mentions", F.when(F.col("_negative"), 0).otherwise(F.col("ambiguous_mentions")))
    reason = F.coalesce("_first", F.when(~F.col("_negative"), F.col("reason")))
    rows = rows.withColumn("reason", reason).withColumn("_tokens", tokens)  # once for all its uses
    rows = rows.withColumn("reason", F.coalesce("reason", token_check(F.col("triples"), F.col("_tokens"), most_tokens))).drop("_first", "_negative", "_tokens")
    rows = rows.persist()  # offsets and tokens are dear, and each of the checks below reads them; lost blocks are computed again
    valid = rows.filter("reason IS NULL").drop("reason").withColumn("key", text_key("text"))
    n, given = valid.agg(F.count("*"), F.count("split")).first()
    if 0 < given < n:
        raise ValueError("rows with and without a split can't be mixed")
    signature = F.sha2(F.to_json(F.struct("text", "triples")), 256)
    facts = valid.groupBy(F.col("key").alias("_k")).agg(F.min("source_line").alias("first"), (F.min(signature) != F.max(signature)).alias("conflict"), F.coalesce(F.min("split") != F.max("split"), F.lit(False)).alias("leak"))
    if facts.filter("leak").limit(1).count():
        raise ValueError("equal texts in different splits")
    joined = valid.join(facts, F.col("key") == F.col("_k")).drop("_k")
    judged = joined.withColumn("reason", F.when(F.col("conflict"), "conflicting_annotations").when(F.col("source_line") != F.col("first"), "normalized_duplicate")).drop("first", "conflict", "leak")
    clean = judged.filter("reason IS NULL").drop("reason")
    n = clean.count()
    if n < least:
        raise ValueError(f"{n} different texts are left; there must be {least}")
    if not given:
        a = int(n * 0.8)
        b = a + max(1, int(n * 0.1))
        ranked = global_rank(clean.drop("split"), seeded_order(seed, F.col("key")), "key")
        clean = ranked.withColumn("split", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= b, "validation").otherwise("test")).drop("rank", "group_size")
    found = {r.split: r for r in clean.groupBy("split").agg(F.count("*").alias("n")).collect()}
    if set(found) != set(SPLITS):
        raise ValueError("each split needs texts of its own")
    covered = clean.filter("split = 'train'").select(F.explode("triples.rel").alias("rel")).distinct().count()
    if covered != items.count():
        raise ValueError("train doesn't cover all slots of the schema")
    return Cleaned(clean.drop("key"), rows.filter("reason IS NOT NULL").select("source_line", "reason").unionByName(judged.filter("reason IS NOT NULL").select("source_line", "reason")))


def verify_records(rows: DataFrame, schema: DataFrame) -> DataFrame:
    """Rows (text, triples) that break a stored version, with the reason: a text twice, bad offsets, types against the schema."""
    from textquarry.functions.text import text_key

    keyed = rows.withColumn("_k", text_key("text"))
    again = keyed.groupBy("_k").agg(F.count("*").alias("_n")).filter("_n > 1")
    one = keyed.join(again, "_k", "left_semi").withColumn("reason", F.lit("duplicate_text")).drop("_k")
    flat = rows.select("*", F.inline("triples")).join(F.broadcast(schema.select(F.col("id").alias("rel"), "subject_type", "object_type")), "rel", "left")
    n = F.length("text")
    wrong = (F.col("s_start") < 0) | (F.col("s_start") >= F.col("s_end")) | (F.col("s_end") > n) | (F.col("o_start") < 0) | (F.col("o_start") >= F.col("o_end")) | (F.col("o_end") > n)
    types = F.col("subject_type").isNull() | (F.col("s_type") != F.col("subject_type")) | (F.col("o_type") != F.col("object_type"))
    two = flat.withColumn("reason", F.when(wrong, "bad_offsets").when(types, "against_schema")).filter("reason IS NOT NULL").select(*rows.columns, "reason").distinct()
    return one.unionByName(two)


def candidate_entities(scores: DataFrame, offsets: DataFrame, threshold: float = 0.0, cap: int = CAP, width: int = WIDTH, parts: int | None = None) -> DataFrame:
    """(doc_id, type_id, first, last, logit) → the best spans: rank, capped (whether more were above the threshold).

    offsets: (doc_id, token, start, end). Spans run forwards, over at most ``width`` tokens that have characters.
    parts: partitions of joins and ranks (``session.parts``), else the session's number.
    """
    dealt = lambda rows, *keys: rows.repartition(parts, *keys) if parts else rows
    above = scores.filter((F.col("logit") > threshold) & (F.col("first") <= F.col("last")) & (F.col("last") - F.col("first") < width))
    real = offsets.filter(F.col("end") > F.col("start"))
    begin = real.select("doc_id", F.col("token").alias("first"), "start")
    end = real.select("doc_id", F.col("token").alias("last"), "end")
    spans = dealt(above, "doc_id", "first").join(dealt(begin, "doc_id", "first"), ["doc_id", "first"])
    spans = dealt(dealt(spans, "doc_id", "last").join(dealt(end, "doc_id", "last"), ["doc_id", "last"]), "doc_id")
    by_doc = Window.partitionBy("doc_id")
    # ties go by token places before types
    ranked = spans.withColumn("n", F.count("*").over(by_doc)).withColumn("rank", F.row_number().over(by_doc.orderBy(F.desc("logit"), "first", "last", "type_id")))
    return ranked.filter(F.col("rank") <= cap).withColumn("capped", F.col("n") > cap).drop("n")


def candidate_pairs(spans: DataFrame, schema: DataFrame) -> DataFrame:
    """Ordered pairs of a document's spans that a relation of the schema allows, by their types.

    spans: (doc_id, start, end, type, score), bounded by ``candidate_entities``; the schema is small and joins first,
    so the pairs are an equi-join on document and both types.
    """
    small = F.broadcast(schema.select(F.col("id").alias("rel"), F.col("subject_type").alias("s_type"), F.col("object_type").alias("o_type")))
    subject = spans.select("doc_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.col("type").alias("s_type"), F.col("score").alias("s_score")).join(small, "s_type")
    object_ = spans.select("doc_id", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("type").alias("o_type"), F.col("score").alias("o_score"))
    return subject.join(object_, ["doc_id", "o_type"])


def decode_joint(candidates: DataFrame, links: DataFrame, schema: DataFrame, threshold: float = 0.0, use_tail: bool = True) -> DataFrame:
    """Triples whose head link, and tail link, are above the threshold; the score is the least of all parts.

    candidates: (doc_id, first, last, start, end, type, score); links: (doc_id, kind head|tail, rel, i, j, logit).
    """
    small = F.broadcast(schema.select(F.col("id").alias("rel"), F.col("subject_type").alias("s_type"), F.col("object_type").alias("o_type")))
    renamed = lambda p: candidates.select("doc_id", *(F.col(c).alias(f"{p}_{c}") for c in ("first", "last", "start", "end", "type", "score")))
    pairs = renamed("s").join(small, "s_type").join(renamed("o"), ["doc_id", "o_type"])
    above = links.filter(F.col("logit") > threshold)
    head = above.filter("kind = 'head'").select("doc_id", "rel", F.col("i").alias("s_first"), F.col("j").alias("o_first"), F.col("logit").alias("head"))
    found = pairs.join(head, ["doc_id", "rel", "s_first", "o_first"])
    score = F.least("s_score", "o_score", "head")
    if use_tail:
        tail = above.filter("kind = 'tail'").select("doc_id", "rel", F.col("i").alias("s_last"), F.col("j").alias("o_last"), F.col("logit").alias("tail"))
        found, score = found.join(tail, ["doc_id", "rel", "s_last", "o_last"]), F.least("s_score", "o_score", "head", "tail")
    return found.select("doc_id", *TRIPLE, score.alias("score"))


def decode_pairs(spans: DataFrame, pair_scores: DataFrame, schema: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Triples whose pair score is above the threshold; pair_scores: (doc_id, s_start, s_end, o_start, o_end, rel, logit)."""
    pairs = candidate_pairs(spans, schema)
    best = pairs.groupBy("doc_id", *TRIPLE).agg(F.max(F.least("s_score", "o_score")).alias("confidence"))
    found = best.join(pair_scores.filter(F.col("logit") > threshold), ["doc_id", "s_start", "s_end", "o_start", "o_end", "rel"])
    return found.select("doc_id", *TRIPLE, F.least("confidence", "logit").alias("score"))


def spread_negatives(pairs: DataFrame, *order: str, cap: int = 64) -> DataFrame:
    """All positive pairs of a document and evenly spaced negatives, up to max(cap, positives).

    pairs: (doc_id, positive, order...). The k-th of m chosen ones of n is number floor(k * (n - 1) / (m - 1)).
    """
    by_doc = Window.partitionBy("doc_id")
    n_pos = F.sum(F.col("positive").cast("int")).over(by_doc)
    n_neg = F.sum((~F.col("positive")).cast("int")).over(by_doc)
    rows = pairs.withColumn("_p", n_pos).withColumn("_n", n_neg).withColumn("_i", F.row_number().over(Window.partitionBy("doc_id", "positive").orderBy(*order)) - 1)
    m = F.greatest(F.lit(cap), F.col("_p")) - F.col("_p")
    wanted = F.transform(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0)).cast("int")), lambda k: F.when(m > 1, F.floor(k * ((F.col("_n") - 1) / (m - 1)))).otherwise(F.lit(0)).cast("long"))
    keep = F.col("positive") | (F.col("_n") <= m) | ((m > 0) & F.array_contains(wanted, F.col("_i").cast("long")))
    return rows.filter(keep).drop("_p", "_n", "_i")


def merge_windows(entities: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions of windows (base: where the window starts) as those of documents: shifted, the highest score of each."""
    at = lambda c: (F.col(c) + F.col("base")).alias(c)
    ents = entities.select("doc_id", at("start"), at("end"), "type", "score", *(["method"] if "method" in entities.columns else []))
    more = [F.array_sort(F.collect_set("method")).alias("methods")] if "method" in entities.columns else []
    merged = ents.groupBy("doc_id", "start", "end", "type").agg(F.max("score").alias("score"), *more)
    moved = triples.select("doc_id", at("s_start"), at("s_end"), "s_type", "rel", at("o_start"), at("o_end"), "o_type", "score")
    return merged, moved.groupBy("doc_id", *TRIPLE).agg(F.max("score").alias("score"))


def numbered(spans: DataFrame, prefix: str = "e") -> DataFrame:
    """Ids in the order of start, end, type within each document."""
    order = Window.partitionBy("doc_id").orderBy("start", "end", "type")
    return spans.withColumn("id", F.concat(F.lit(prefix), (F.row_number().over(order) - 1).cast("string")))


def extraction(texts: DataFrame, entities: DataFrame, triples: DataFrame, schema: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with ids, text and confidence; relations that refer to them."""
    ents = numbered(entities).join(texts, "doc_id")
    ents = ents.select("doc_id", "id", substring_of(F.col("text"), F.col("start"), F.col("end")).alias("text"), "type", "start", "end", sigmoid(F.col("score")).alias("confidence"))
    ref = lambda p, name: ents.select("doc_id", F.col("id").alias(name), F.col("text").alias(f"{name}_text"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.col("type").alias(f"{p}_type"))
    rels = triples.join(ref("s", "subject"), ["doc_id", "s_start", "s_end", "s_type"]).join(ref("o", "object"), ["doc_id", "o_start", "o_end", "o_type"])
    rels = rels.join(F.broadcast(schema.select(F.col("id").alias("rel"), "predicate", "slot", "label")), "rel")
    return ents, rels.select("doc_id", "subject", "object", "predicate", "slot", "label", "subject_text", "object_text", F.col("s_type").alias("subject_type"), F.col("o_type").alias("object_type"), sigmoid(F.col("score")).alias("confidence"))


def group_relations(relations: DataFrame, *keys: str) -> DataFrame:
    """Relations with equal typed texts as one: the highest confidence and all links between mentions."""
    same = ["subject_text", "subject_type", "predicate", "slot", "object_text", "object_type"]
    return relations.groupBy(*keys, *same).agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct("subject", "object"))).alias("mention_links"))


def dictionary(rows: DataFrame, support: int = 3) -> DataFrame:
    """Typed surfaces of annotated rows (text, start, end, type) with enough support and two characters at least."""
    term = substring_of(F.col("text"), F.col("start"), F.col("end"))
    return rows.groupBy(term.alias("term"), "type").agg(F.count("*").alias("support")).filter((F.col("support") >= support) & (F.length("term") >= 2))


def dictionary_matches(texts: DataFrame, lexicon: DataFrame, part_bytes: int = 1 << 18) -> DataFrame:
    """All occurrences, overlapping ones too, of lexicon terms: (doc_id, start, end, type), score 0, for each row of texts.

    An automaton over UTF-8 reads each text once, whatever the terms' lengths; nothing is shuffled. A lexicon of more than
    ``part_bytes`` is dealt out by its terms' first two characters, and each part has an automaton and a pass of its own:
    the driver holds the terms of one part at a time, and an executor some tens of megabytes.
    """
    from textquarry.operators.automaton import Automaton

    spark, kind = texts.sparkSession, texts.schema["doc_id"].dataType.simpleString()
    lexicon = lexicon.filter("term <> ''").select(F.col("term").cast("string"), F.col("type").cast("string")).distinct()
    texts = texts.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = lexicon.agg(F.sum(F.octet_length("term")).alias("n")).first().n or 0
    parts = -(-size // part_bytes)
    found = texts.select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("type")).limit(0)
    for p in range(parts):
        own = lexicon.filter(F.pmod(F.xxhash64(F.substring("term", 1, 2)), F.lit(parts)) == p).collect()
        if own:
            machine = spark.sparkContext.broadcast(Automaton([(r.term, r.type) for r in own]))
            one = texts.mapInArrow(lambda batches, m=machine: m.value.over(batches), f"doc_id {kind}, start int, end int, type string")
            found = one if p == 0 or parts == 1 else found.unionAll(one)
    return found.withColumn("score", F.lit(0.0))


def shifted(triples: Column, shift: int) -> Column:
    """Offsets after a prefix of ``shift`` characters."""
    moved = {"s_start", "s_end", "o_start", "o_end"}
    return F.transform(triples, lambda t: F.struct(*((t[c] + shift if c in moved else t[c]).alias(c) for c in TRIPLE)))


def schema_frame(spark: SparkSession, rows: list[tuple[str, str, dict[str, str]]]) -> DataFrame:
    return spark.createDataFrame(rows, "predicate string, subject_type string, object_type map<string,string>")
