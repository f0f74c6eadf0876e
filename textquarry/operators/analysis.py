"""Where predictions fail: partitions of errors, slices, role confusions, bands of support."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.spans import overlaps, substring_of
from textquarry.functions.stats import prf
from textquarry.operators.metrics import SURFACE, matched
from textquarry.operators.relations import entities

PAIR = ["s_text", "s_type", "o_text", "o_type"]


def error_partition(gold: DataFrame, predicted: DataFrame, predicted_entities: DataFrame, texts: DataFrame, *by: str, parts: int | None = None) -> DataFrame:
    """correct, missing_with_entity_error, missing_despite_both_entities, extra, by some columns of texts.

    gold, predicted: triples with offsets; a missing one lacks an entity if either end isn't predicted as it stands
    (of gold triples with equal texts the last one decides). texts: (doc_id, text, by...). Both kinds are grouped in
    one pass; parts: partitions of that pass and of the joins (``session.parts``), else the session's number.
    """
    dealt = lambda rows, *columns: rows.repartition(parts, *columns) if parts else rows
    triple = ["doc_id", "s_start", "s_end", "s_type", "rel", "o_start", "o_end", "o_type"]
    every = gold.select(*triple, F.lit(True).alias("_gold")).unionByName(predicted.select(*triple, F.lit(False).alias("_gold")))
    texts_ = texts.select("doc_id", F.col("text").alias("_text"))
    every = dealt(every, "doc_id").join(dealt(texts_, "doc_id"), "doc_id")
    every = every.withColumn("s_text", substring_of(F.col("_text"), F.col("s_start"), F.col("s_end"))).withColumn("o_text", substring_of(F.col("_text"), F.col("o_start"), F.col("o_end"))).drop("_text")
    keys = ["doc_id", *SURFACE]
    place = F.struct("s_start", "s_end", "o_start", "o_end")
    # a triple with a null among its keys equals no other kind's
    alone = F.when(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]), F.col("_gold"))
    rows = every.groupBy(*keys, alone.alias("_alone")).agg(F.max(F.when(F.col("_gold"), place)).alias("at"), F.max(F.col("_gold").cast("int")).alias("in_gold"), F.max((~F.col("_gold")).cast("int")).alias("in_pred"))
    rows = rows.select("doc_id", "s_type", "o_type", "at.*", "in_gold", "in_pred")
    ents = dealt(predicted_entities.select("doc_id", "start", "end", "type"), "doc_id", "start", "end", "type").distinct()
    for c in "so":
        on = ["doc_id", f"{c}_start", f"{c}_end", f"{c}_type"]
        rows = dealt(rows, *on).join(ents.toDF(*on).withColumn(f"_{c}", F.lit(True)), on, "left")
    both = F.col("_s").isNotNull() & F.col("_o").isNotNull()
    missing = (F.col("in_gold") == 1) & (F.col("in_pred") == 0)
    if by:
        rows = rows.join(texts.select("doc_id", *by), "doc_id")
    return rows.groupBy(*by).agg(
        F.count_if((F.col("in_gold") == 1) & (F.col("in_pred") == 1)).alias("correct"), F.count_if(missing & ~both).alias("missing_with_entity_error"),
        F.count_if(missing & both).alias("missing_despite_both_entities"), F.count_if((F.col("in_gold") == 0) & (F.col("in_pred") == 1)).alias("extra"),
    )


def slices(texts: DataFrame, gold: DataFrame, train: DataFrame, long: int = 150, rare: int = 100) -> DataFrame:
    """(doc_id, slice): short_text or long_text, shared_entity (one entity in several triples' ends), rare_relation.

    gold, train: triples; slices overlap.
    """
    frequent = train.groupBy("rel").agg(F.count("*").alias("_n"))
    few = gold.select("doc_id", "rel").distinct().join(frequent, "rel", "left").filter(F.coalesce("_n", F.lit(0)) < rare).select("doc_id").distinct().withColumn("_rare", F.lit(True))
    ends = F.array(F.struct(F.lit("s").alias("side"), F.col("s_start").alias("start"), F.col("s_end").alias("end"), F.col("s_type").alias("type")), F.struct(F.lit("o").alias("side"), F.col("o_start").alias("start"), F.col("o_end").alias("end"), F.col("o_type").alias("type")))
    uses = gold.select("doc_id", F.inline(ends)).groupBy("doc_id", "start", "end", "type").agg(F.count("*").alias("n"))
    shared = uses.filter("n > 1").select("doc_id").distinct().withColumn("_shared", F.lit(True))
    rows = texts.select("doc_id", "text").join(few, "doc_id", "left").join(shared, "doc_id", "left")
    names = F.array(F.when(F.length("text") >= long, "long_text").otherwise("short_text"), F.when(F.col("_shared"), "shared_entity"), F.when(F.col("_rare"), "rare_relation"))
    return rows.select("doc_id", F.explode(F.array_compact(names)).alias("slice"))


def slice_scores(members: DataFrame, counts: DataFrame, slice_: str = "slice", *by: str) -> DataFrame:
    """Micro scores of each slice out of documents' counts (doc_id, correct, predicted, gold, by...)."""
    sums = members.join(counts, "doc_id").groupBy(slice_, *by).agg(F.count_distinct("doc_id").alias("documents"), *(F.sum(c).alias(c) for c in ("correct", "predicted", "gold")))
    return sums.select(slice_, *by, "documents", *prf(F.col("correct"), F.col("predicted"), F.col("gold")))


def subgroups(texts: DataFrame, gold: DataFrame, train_texts: DataFrame, train: DataFrame) -> DataFrame:
    """(doc_id, slice) by the number of gold slots, overlap of different spans, and whether train has all typed surfaces."""
    spans = entities(gold, "doc_id").join(texts.select("doc_id", "text"), "doc_id")
    spans = spans.withColumn("term", substring_of(F.col("text"), F.col("start"), F.col("end"))).drop("text")
    known = entities(train, "doc_id").join(train_texts.select("doc_id", "text"), "doc_id").select(substring_of(F.col("text"), F.col("start"), F.col("end")).alias("term"), "type").distinct().withColumn("_known", F.lit(1))
    seen = spans.join(known, ["term", "type"], "left").groupBy("doc_id").agg(F.bool_and(F.col("_known").isNotNull()).alias("seen"))
    array = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("s"))
    nested = array.select("doc_id", F.exists("s", lambda a: F.exists("s", lambda b: (a != b) & overlaps(a["start"], a["end"], b["start"], b["end"]))).alias("nested"))
    slots = gold.select("doc_id", "s_start", "s_end", "s_type", "rel", "o_start", "o_end", "o_type").distinct().groupBy("doc_id").agg(F.count("*").alias("slots"))
    rows = reduce(lambda a, b: a.join(b, "doc_id", "left"), [texts.select("doc_id"), slots, nested, seen])
    names = [
        F.when(F.col("slots") == 1, "one_gold_slot").otherwise("multiple_gold_slots"),
        F.when(F.coalesce("nested", F.lit(False)), "distinct_overlapping_spans").otherwise("non_overlapping_spans"),
        F.when(F.coalesce("seen", F.lit(True)), "all_typed_surfaces_seen_in_train").otherwise("some_typed_surface_unseen"),
    ]
    return rows.select("doc_id", F.explode(F.array(*names)).alias("slice"))


def support_band(n):
    return F.when(n < 50, "train_support_1_49").when(n < 200, "train_support_50_199").otherwise("train_support_200_plus")


def band_scores(per_relation: DataFrame, support: DataFrame, *by: str) -> DataFrame:
    """Micro scores of relations (id, correct, predicted, gold) by bands of their support in train (id, n; none: 0)."""
    rows = per_relation.join(support.select(F.col("id").alias("_i"), "n"), F.col("id") == F.col("_i"), "left").withColumn("band", support_band(F.coalesce("n", F.lit(0))))
    sums = rows.groupBy("band", *by).agg(F.count("*").alias("slots"), *(F.sum(c).alias(c) for c in ("correct", "predicted", "gold")))
    return sums.select("band", *by, "slots", *prf(F.col("correct"), F.col("predicted"), F.col("gold")))


def role_errors(gold: DataFrame, predicted: DataFrame, predicted_surfaces: DataFrame, key: str = "doc_id") -> DataFrame:
    """(category, n) of missing and extra triples, all by surface.

    A missing triple has both typed surfaces detected, or not; besides, it may have a wrong role on the same typed
    pair. An extra triple stands on a gold typed pair, or not. predicted_surfaces: (key, term, type).
    """
    pairs = matched(gold, predicted, [key, *SURFACE])
    missing, extra = (F.col("in_gold") == 1) & (F.col("in_pred") == 0), (F.col("in_gold") == 0) & (F.col("in_pred") == 1)
    # what else stands on the same typed pair of a document
    same = pairs.groupBy(key, *PAIR).agg(F.max("in_gold").alias("_gold"), F.max(extra.cast("int")).alias("_extra"))
    seen = predicted_surfaces.groupBy(key, "term", "type").agg(F.count("*").alias("_n"))
    end = lambda c: seen.select(key, F.col("term").alias(f"{c}_text"), F.col("type").alias(f"{c}_type"), F.col("_n").alias(f"_{c}"))
    rows = pairs.filter("in_gold <> in_pred").join(same, [key, *PAIR]).join(end("s"), [key, "s_text", "s_type"], "left").join(end("o"), [key, "o_text", "o_type"], "left")
    both = F.col("_s").isNotNull() & F.col("_o").isNotNull()
    named = F.array(
        F.when(missing & both, "missing_despite_both_typed_surfaces_detected").when(missing, "missing_with_participant_surface_or_type_absent"),
        F.when(missing & (F.col("_extra") == 1), "missing_with_wrong_role_on_same_typed_pair"),
        F.when(extra & (F.col("_gold") == 1), "extra_wrong_role_on_gold_typed_pair").when(extra, "extra_other_pair_or_type"),
    )
    return rows.select(F.explode(F.array_compact(named)).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def role_confusions(gold: DataFrame, predicted: DataFrame, most: int = 15, key: str = "doc_id") -> DataFrame:
    """The most frequent (gold_rel, predicted_rel) of missing and extra triples on the same typed pair."""
    pairs = matched(gold, predicted, [key, *SURFACE])
    missing = pairs.filter("in_gold = 1 AND in_pred = 0").select(key, *PAIR, F.col("rel").alias("gold_rel"))
    extra = pairs.filter("in_gold = 0 AND in_pred = 1").select(key, *PAIR, F.col("rel").alias("predicted_rel"))
    return missing.join(extra, [key, *PAIR]).groupBy("gold_rel", "predicted_rel").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gold_rel", "predicted_rel").limit(most)
