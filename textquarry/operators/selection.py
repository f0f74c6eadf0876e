"""Comparing runs, choosing by validation, release gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def comparable(runs: DataFrame) -> None:
    """Two completed runs at least, over one dataset with one label order, whose metrics are of its split."""
    facts = runs.agg(F.count("*").alias("n"), F.bool_and(F.col("status") == "completed").alias("done"), F.count_distinct("dataset_sha256").alias("d"), F.count_distinct("labels").alias("l"), F.bool_and(F.col("split_sha256") == F.col("metrics_sha256")).alias("same")).first()
    if facts.n < 2:
        raise ValueError("a comparison needs two runs")
    if not facts.done:
        raise ValueError("only completed runs can be compared")
    if facts.d != 1 or facts.l != 1:
        raise ValueError("runs must share dataset and labels")
    if not facts.same:
        raise ValueError("metrics are of another split")


def compare(runs: DataFrame) -> DataFrame:
    comparable(runs)
    return runs.orderBy(F.desc("macro_f1"), "run")


def choose(rows: DataFrame, variant: str = "variant", score: str = "validation") -> DataFrame:
    """The variant with the best mean validation score; the first by name of ties. Test scores don't take part."""
    means = rows.groupBy(variant).agg(F.avg(score).alias("mean"), F.count("*").alias("runs"))
    return means.orderBy(F.desc("mean"), variant).limit(1)


def release(rows: DataFrame, least_gain: float = 0.005) -> DataFrame:
    """(baseline_validation, candidate_validation, baseline_test, candidate_test) → the gates: validation decides, test may veto."""
    gain = F.col("candidate_validation") - F.col("baseline_validation") >= least_gain
    holds = F.col("candidate_test") >= F.col("baseline_test")
    return rows.withColumn("validation_gate_passed", gain).withColumn("holdout_audit_passed", holds).withColumn("enabled", gain & holds)


def extraction_counters(records: DataFrame, entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts over evidence records and entities with context of each document."""
    r = records.groupBy(key).agg(
        F.count("*").alias("records"), F.sum(F.size("binding_suggestions")).alias("bindings"),
        F.sum(F.size(F.filter("binding_suggestions", lambda b: b["arm"].isNotNull()))).alias("explicit_arms"),
        F.count_if(F.col("provenance.scope").isin("cited_study_cues", "mixed_cues")).alias("cited_or_mixed"),
        F.count_if((F.col("category") == "efficacy") & (F.size(F.col("qualifiers")["negation"]) > 0)).alias("negative_efficacy"),
    )
    e = entities.groupBy(key).agg(F.count("*").alias("entities"), F.count_if(F.size("context.modifiers") > 0).alias("modified"), F.count_if(F.size("context.blocked_modifiers") > 0).alias("blocked"))
    return r.join(e, key, "full_outer").na.fill(0)


def recomputed(stored: DataFrame, details: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Stored metrics (run, metric, value) beside those of the saved predictions (run, truth, prediction): run, metric,
    value, recomputed, agrees. Metrics are samples, errors and accuracy; one that either side lacks doesn't agree."""
    wrong = (~F.col("truth").eqNullSafe(F.col("prediction"))).cast("int")
    found = details.groupBy("run").agg(F.count("*").cast("double").alias("samples"), F.sum(wrong).cast("double").alias("errors"), (1 - F.avg(wrong)).alias("accuracy"))
    names = ("samples", "errors", "accuracy")
    found = found.select("run", F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("recomputed")) for n in names))))
    both = stored.join(found, ["run", "metric"], "full_outer")
    return both.select("run", "metric", "value", "recomputed", F.coalesce(F.abs(F.col("value") - F.col("recomputed")) <= tolerance, F.lit(False)).alias("agrees"))
