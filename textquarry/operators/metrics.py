"""Scores of classifications, spans and triples. Gold and predictions are sets: both are made distinct first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.spans import substring_of
from textquarry.functions.stats import argmax, f1, prf, total

ENTITY = ["start", "end", "type"]
SURFACE = ["s_text", "s_type", "rel", "o_text", "o_type"]


def matched(gold: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join of two sets on ``key``: in_gold, in_pred (0 or 1). It is one shuffle of both, as a union and a count."""
    both = gold.select(*key, F.lit(1).alias("g"), F.lit(0).alias("p")).unionAll(predicted.select(*key, F.lit(0).alias("g"), F.lit(1).alias("p")))
    return both.groupBy(*key).agg(F.max("g").alias("in_gold"), F.max("p").alias("in_pred"))


def counts(pairs: DataFrame, *by: str) -> DataFrame:
    """correct, predicted, gold by some columns of ``matched``."""
    sums = [F.sum(F.col("in_gold") * F.col("in_pred")), F.sum("in_pred"), F.sum("in_gold")]
    return pairs.groupBy(*by).agg(*(F.coalesce(s, F.lit(0)).alias(n) for s, n in zip(sums, ("correct", "predicted", "gold"))))


def scored(sums: DataFrame, *keep: str) -> DataFrame:
    return sums.select(*keep, *prf(F.col("correct"), F.col("predicted"), F.col("gold")))


def surfaces(triples: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Triples by the texts of their ends: relations are compared by surface, entities by offset."""
    rows = triples.join(texts.select(F.col(key).alias("_k"), F.col("text").alias("_text")), F.col(key) == F.col("_k"))
    s, o = substring_of(F.col("_text"), F.col("s_start"), F.col("s_end")), substring_of(F.col("_text"), F.col("o_start"), F.col("o_end"))
    return rows.select(key, s.alias("s_text"), "s_type", "rel", o.alias("o_text"), "o_type").distinct()


def span_scores(gold: DataFrame, predicted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Micro scores (type null) and those of each type, of spans (key, start, end, type)."""
    pairs = matched(gold, predicted, [key, *ENTITY])
    sums = pairs.groupingSets([["type"], []], "type").agg(F.sum(F.col("in_gold") * F.col("in_pred")).alias("correct"), F.sum("in_pred").alias("predicted"), F.sum("in_gold").alias("gold"))
    return scored(sums.na.fill(0, ["correct", "predicted", "gold"]), "type")


def relation_scores(gold: DataFrame, predicted: DataFrame, schema: DataFrame, key: str = "doc_id") -> DataFrame:
    """Scores of each slot of the schema; slots without any triple score 0. gold, predicted: surfaces."""
    sums = counts(matched(gold, predicted, [key, *SURFACE]), "rel")
    all_slots = F.broadcast(schema).join(sums, F.col("id") == F.col("rel"), "left").na.fill(0, ["correct", "predicted", "gold"])
    return scored(all_slots, "id", "predicate", "slot", "label")


def relation_summary(gold: DataFrame, predicted: DataFrame, schema: DataFrame, key: str = "doc_id") -> DataFrame:
    """Micro scores over all triples, and macro_f1 over all slots of the schema."""
    per_slot = relation_scores(gold, predicted, schema, key)
    sums = per_slot.agg(F.avg("f1").alias("macro_f1"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("correct", "predicted", "gold")))
    return scored(sums, "macro_f1")


def document_counts(gold: DataFrame, predicted: DataFrame, documents: DataFrame, key: str = "doc_id", columns: list[str] = SURFACE) -> DataFrame:
    """correct, predicted, gold of each document, 0 for those without any."""
    sums = counts(matched(gold, predicted, [key, *columns]), key)
    return documents.select(key).join(sums, key, "left").na.fill(0, ["correct", "predicted", "gold"])


def differences(gold: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """What is missing or extra: key and kind."""
    pairs = matched(gold, predicted, key).filter("in_gold <> in_pred")
    return pairs.select(*key, F.when(F.col("in_gold") == 1, "missing").otherwise("extra").alias("kind"))


def checked_probabilities(rows: DataFrame, labels: int, column: str = "p") -> DataFrame:
    """Rows whose probabilities are refused: wrong length, not finite, negative, or a sum that isn't 1 (to 1e-5)."""
    p = F.col(column)
    bad = p.isNull() | (F.size(p) != labels) | F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (F.abs(x) == float("inf"))) | (F.abs(total(p) - 1) > 2e-5)
    return rows.filter(F.coalesce(bad, F.lit(True)))


def predictions(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(label, p) → truth, predicted (labels), confidence, correct, and p that sums to 1. Bad probabilities stop the run."""
    if checked_probabilities(rows, len(labels)).limit(1).count():
        raise ValueError("probabilities must be finite, not negative, and sum to 1 for every row")
    names = F.array(*map(F.lit, labels))
    rows = rows.withColumn("_sum", total(F.col("p"))).withColumn("p", F.transform("p", lambda x: x / F.col("_sum"))).drop("_sum")
    rows = rows.withColumn("truth", (F.array_position(names, F.col("label")) - 1).cast("int")).withColumn("prediction", argmax(F.col("p")))
    return rows.withColumn("predicted", F.element_at(names, F.col("prediction") + 1)).withColumn("confidence", F.array_max("p")).withColumn("correct", F.col("truth") == F.col("prediction"))


def confusion(rows: DataFrame, truth: str = "truth", prediction: str = "prediction", *by: str) -> DataFrame:
    return rows.groupBy(*by, F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def class_report(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of each class (id, label) out of the cells of a confusion matrix: precision, recall, f1, support."""
    per = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("c"), F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0).alias("correct"), F.lit(0).cast("long").alias("predicted"), F.col("n").alias("gold")), F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("correct"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("gold")))).alias("x")).select("x.*")
    sums = per.groupBy("c").agg(*(F.sum(n).alias(n) for n in ("correct", "predicted", "gold")))
    rows = labels.join(sums, F.col("id") == F.col("c"), "left").na.fill(0, ["correct", "predicted", "gold"])
    return scored(rows, "id", "label")


def classification_summary(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """samples, accuracy, macro_f1 (over all classes), weighted_f1, unsupported classes."""
    report = class_report(cells, labels)
    n = F.sum("gold")
    return report.agg(n.alias("samples"), (F.sum("correct") / n).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("gold")) / n).alias("weighted_f1"), F.count_if(F.col("gold") == 0).alias("unsupported"))


def macro_f1(cells: DataFrame, classes: int, *by: str) -> DataFrame:
    """Macro F1 over ``classes`` classes for each group: classes with an empty row and column count 0."""
    ends = F.array(F.struct(F.col("truth").alias("c"), F.col("n").alias("m")), F.struct(F.col("prediction").alias("c"), F.col("n").alias("m")))
    sums = cells.select(*by, F.inline(ends), F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"))
    per = sums.groupBy(*by, "c").agg((F.sum("hit") / F.sum("m")).alias("f"))  # the diagonal is counted from both ends
    return per.groupBy(*by).agg((F.sum("f") / classes).alias("macro_f1"))


def mean_confusion(cells: DataFrame, runs: int) -> DataFrame:
    """Cells averaged over runs, and for each true class its largest wrong one."""
    mean = cells.groupBy("truth", "prediction").agg((F.sum("n") / runs).alias("mean_n"))
    worst = Window.partitionBy("truth").orderBy(F.desc("mean_n"), "prediction")
    wrong = mean.filter("truth <> prediction").withColumn("k", F.row_number().over(worst)).filter("k = 1").select(F.col("truth").alias("_t"), F.col("prediction").alias("main_confusion"))
    return mean.join(F.broadcast(wrong), F.col("truth") == F.col("_t"), "left").drop("_t")


def reliability(rows: DataFrame, bins: int = 15) -> DataFrame:
    """(confidence, correct) → for each bin that has rows: lower, upper, samples, accuracy, confidence. 1.0 falls into the last."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    sums = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("samples"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("confidence").alias("confidence"))
    return sums.select("bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"), "samples", "accuracy", "confidence")


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("samples") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("samples")).alias("ece"))


def brier_nll(rows: DataFrame) -> DataFrame:
    """(p, truth) → brier_score and nll, with probabilities of the truth clipped at 1e-15."""
    true_p = F.element_at("p", F.col("truth") + 1)
    squared = total(F.transform("p", lambda x, i: F.pow(x - F.when(i == F.col("truth"), 1.0).otherwise(0.0), 2)))
    return rows.agg(F.avg(squared).alias("brier_score"), F.avg(-F.log(F.least(F.greatest(true_p, F.lit(1e-15)), F.lit(1.0)))).alias("nll"))


def mean_std(rows: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """Mean and sample deviation (null for one value) of some columns."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.when(F.count(c) > 1, F.stddev_samp(c)).alias(f"{c}_std"))))


def micro_f1(rows: DataFrame, *by: str) -> DataFrame:
    sums = rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("correct", "predicted", "gold")))
    return sums.select(*by, f1(F.col("correct"), F.col("predicted"), F.col("gold")).alias("f1"))


