"""Losses over score tables, one row for each score: no document's scores are gathered.

The balanced multilabel loss of an example and a head is ln(1 + sum of exp(s) over negatives) + ln(1 + sum of exp(-s) over
positives). Sums of exponentials are kept apart by the multiple of ``STEP`` below their exponents, so no sum overflows,
partial sums combine before the shuffle, and an example of any size ends as a few numbers that are added up last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 64.0
#: What masked scores count as; scores are cut there, so that an example has a bounded number of sums.
MASKED = 10000.0


def log1p_sum_exp(rows: DataFrame, by: list[str], x: Column) -> DataFrame:
    """(by..., value): ln(1 + sum of exp(x)) over the rows of a group where x isn't null; 0 where all are."""
    cut = F.when(x.isNotNull(), F.greatest(F.lit(-MASKED), F.least(F.lit(MASKED), x.cast("double"))))
    rows = rows.select(*by, cut.alias("_x")).withColumn("_b", F.floor(F.col("_x") / STEP).cast("double"))
    sums = rows.groupBy(*by, "_b").agg(F.sum(F.exp(F.col("_x") - F.col("_b") * STEP)).alias("_s"))
    parts = F.filter(F.collect_list(F.struct("_b", "_s")), lambda p: p["_b"].isNotNull())  # 2 * MASKED / STEP at most
    top = F.greatest(F.lit(0.0), F.array_max(F.transform("_p", lambda p: p["_b"] * STEP)))
    held = sums.groupBy(*by).agg(parts.alias("_p")).withColumn("_m", top)
    return held.select(*by, (F.col("_m") + F.log(F.exp(-F.col("_m")) + F.aggregate("_p", F.lit(0.0), lambda a, p: a + F.exp(p["_b"] * STEP - F.col("_m")) * p["_s"]))).alias("value"))


def pointer_losses(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by..., loss) of scores (by..., score, target boolean); by: the example and the head. Null scores take no part, null targets are negatives."""
    target = F.coalesce(F.col("target"), F.lit(False))
    sides = scores.select(*by, target.alias("_t"), F.when(target, -F.col("score")).otherwise(F.col("score")).alias("_x"))
    return log1p_sum_exp(sides, [*by, "_t"], F.col("_x")).groupBy(*by).agg(F.sum("value").alias("loss"))


def pointer_loss(scores: DataFrame, example: str = "doc_id", head: str = "head", part: str = "part") -> DataFrame:
    """(part, mean_loss, heads, sum_loss): the mean over examples and heads of a part, and the form summed over heads."""
    losses = pointer_losses(scores, [part, example, head])
    return losses.groupBy(part).agg(F.avg("loss").alias("mean_loss"), F.count_distinct(head).alias("heads")).withColumn("sum_loss", F.col("mean_loss") * F.col("heads"))


def joint_loss(parts: DataFrame, form: str = "mean", use_tail: bool = True) -> DataFrame:
    """One row: the sum of the parts' losses (pointer_loss), of the mean or the sum form; without ``tail`` if so asked."""
    if form not in ("mean", "sum"):
        raise ValueError("forms are mean and sum")
    kept = parts if use_tail else parts.filter("part <> 'tail'")
    return kept.agg(F.sum(f"{form}_loss").alias("loss"))


def softplus(x: Column) -> Column:
    """ln(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def pair_loss(scores: DataFrame, positive: float = 3.0) -> DataFrame:
    """One row: mean cross-entropy of pair scores (score, target, kept), positives weighted; 0 if no row is kept."""
    x, y = F.col("score").cast("double"), F.coalesce(F.col("target"), F.lit(False))
    each = F.when(y, positive * softplus(-x)).otherwise(softplus(x))
    kept = scores.select(each.alias("_l"), F.coalesce(F.col("kept"), F.lit(False)).alias("_k")).filter("_k AND _l IS NOT NULL")
    return kept.agg((F.coalesce(F.sum("_l"), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))).alias("loss"))


def pipeline_loss(entity: DataFrame, pair: DataFrame) -> DataFrame:
    """One row: the entity part's mean loss (pointer_loss) and twice the pairs' loss (pair_loss)."""
    return entity.agg(F.sum("mean_loss").alias("e")).crossJoin(pair.select(F.col("loss").alias("p"))).select((F.col("e") + 2 * F.col("p")).alias("loss"))  # single rows
