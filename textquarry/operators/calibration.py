"""Temperature scaling and selective prediction."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.stats import argmax, log_softmax, softmax

LOW, HIGH = 0.1, 100.0
#: Bins of a pass over the values whose rank is looked for.
BINS = 4096


def nll_by_temperature(rows: DataFrame, temperatures: list[float]) -> DataFrame:
    """(scores, truth) → (temperature, nll) for a short list of temperatures, in one pass over the rows."""
    each = F.explode(F.array(*map(F.lit, temperatures))).alias("temperature")
    losses = rows.select("scores", "truth", each).select("temperature", (-F.element_at(log_softmax(F.col("scores"), F.col("temperature")), F.col("truth") + 1)).alias("loss"))
    return losses.groupBy("temperature").agg(F.avg("loss").alias("nll"))


def best_temperature(grid: DataFrame) -> DataFrame:
    """The temperature of the least loss, the smallest of ties."""
    return grid.agg(F.min_by("temperature", F.struct("nll", "temperature")).alias("temperature"), F.min("nll").alias("nll"))


def fit_temperature(rows: DataFrame, tolerance: float = 1e-5, points: int = 9) -> float:
    """The temperature between 0.1 and 100 with the least mean loss.

    The loss is unimodal in the logarithm: each pass scores a grid of ``points`` and keeps the part around its best.
    """
    lo, hi = math.log(LOW), math.log(HIGH)
    while hi - lo > tolerance:
        grid = [lo + (hi - lo) * k / (points - 1) for k in range(points)]
        found = {r.temperature: r.nll for r in nll_by_temperature(rows, [math.exp(x) for x in grid]).collect()}  # ``points`` rows
        if len(found) < points or not all(v is not None and math.isfinite(v) for v in found.values()):
            raise ValueError("the scores can't be calibrated")
        k = min(range(points), key=lambda i: found[math.exp(grid[i])])
        lo, hi = grid[max(0, k - 1)], grid[min(points - 1, k + 1)]
    return math.exp((lo + hi) / 2)


def scaled(rows: DataFrame, temperature: float) -> DataFrame:
    """(scores, truth) → p, prediction, confidence, correct at a temperature."""
    rows = rows.withColumn("p", softmax(F.col("scores"), float(temperature)))
    rows = rows.withColumn("prediction", argmax(F.col("p"))).withColumn("confidence", F.array_max("p"))
    return rows.withColumn("correct", F.col("prediction") == F.col("truth"))


def _finite(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).cast("double").alias("v")).filter(F.abs("v") < F.lit(math.inf))


def value_at(rows: DataFrame, column: str, rank: int) -> float | None:
    """The value of a rank (from 0; nulls, NaN and infinities left out), by counting: no task and no driver gathers the values.

    Each pass counts the values in ``BINS`` equal bins of the range at hand and goes on in the bin that holds the rank, from
    its least to its greatest value, until these are one: a few passes, each with a combined aggregation of ``BINS`` rows.
    """
    rows = _finite(rows, column)
    n, lo, hi = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not 0 <= rank < n:
        return None
    while lo < hi:
        width = hi / BINS - lo / BINS
        at = F.col("v") if width == 0 else F.least(F.floor((F.col("v") - lo) / F.lit(width)), F.lit(BINS - 1))  # without a width there are few values
        counts = rows.filter(F.col("v").between(lo, hi)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for r in sorted(counts.collect(), key=lambda r: r.b):
            if rank < r.n:
                lo, hi = r.lo, r.hi
                break
            rank -= r.n
    return lo


def quantile(rows: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile with linear interpolation between ranks, null without values."""
    n = _finite(rows, column).count()
    if not n:
        return None
    at = share * (n - 1)
    low, high = math.floor(at), math.ceil(at)
    a = value_at(rows, column, low)
    return a if low == high else (high - at) * a + (at - low) * value_at(rows, column, high)


def selective(validation: DataFrame, test: DataFrame, share: float = 0.2) -> DataFrame:
    """The confidence below which ``share`` of validation lies; test's coverage and accuracy from there on."""
    threshold = F.lit(quantile(validation, "confidence", share)).cast("double")
    kept = F.col("confidence") >= threshold
    accuracy = F.avg(F.when(kept, F.col("correct").cast("double")))
    return test.agg(F.max(threshold).alias("threshold"), F.avg(kept.cast("double")).alias("coverage"), F.count_if(kept).alias("accepted"), accuracy.alias("accuracy"))
