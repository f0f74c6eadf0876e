"""Scalar statistics over columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def precision(correct: Column, predicted: Column) -> Column:
    return F.when(predicted > 0, correct / predicted).otherwise(F.lit(0.0))


def recall(correct: Column, gold: Column) -> Column:
    return F.when(gold > 0, correct / gold).otherwise(F.lit(0.0))


def f1(correct: Column, predicted: Column, gold: Column) -> Column:
    return F.when(predicted + gold > 0, 2 * correct / (predicted + gold)).otherwise(F.lit(0.0))


def prf(correct: Column, predicted: Column, gold: Column) -> list[Column]:
    """precision, recall, f1, correct, predicted, gold: 0 where a denominator is."""
    return [precision(correct, predicted).alias("precision"), recall(correct, gold).alias("recall"), f1(correct, predicted, gold).alias("f1"), correct.alias("correct"), predicted.alias("predicted"), gold.alias("gold")]


def sigmoid(x: Column, bound: float = 50.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-bound), F.least(F.lit(bound), x))))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of an expression that is evaluated once, even where it is used inside a function over an array's elements."""
    return F.element_at(F.transform(F.array(x), use), 1)


def log_softmax(scores: Column, temperature: Column | float = 1.0) -> Column:
    t = F.lit(temperature) if isinstance(temperature, float) else temperature

    def of(logits: Column) -> Column:
        shifted = lambda top: once(F.log(total(F.transform(logits, lambda r: F.exp(r - top)))), lambda norm: F.transform(logits, lambda s: s - top - norm))
        return once(F.array_max(logits), shifted)

    return once(F.transform(scores, lambda s: s.cast("double") / t), of)


def softmax(scores: Column, temperature: Column | float = 1.0) -> Column:
    return F.transform(log_softmax(scores, temperature), F.exp)


def log_quotients(scores: Column) -> Column:
    """Logarithms of the softmax's quotients: -inf where one underflows to 0, unlike ``log_softmax``; absent scores stay absent and take no part."""
    log = lambda p: F.when(p == 0, F.lit(float("-inf"))).otherwise(F.log(p))

    def of(top: Column) -> Column:
        powers = F.transform(scores, lambda s: F.exp(s - top))
        return once(total(F.filter(powers, lambda e: e.isNotNull())), lambda norm: F.transform(powers, lambda e: log(e / norm)))

    return once(F.array_max(scores), of)


def argmax(scores: Column) -> Column:
    """Place of the first largest value, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def one_of(values: list) -> Column:
    return reduce(lambda a, b: a | b, values)


def symmetric_kl(p: Column, q: Column) -> Column:
    """Half the sum of both directions' divergence of two arrays of log probabilities, over the places that both hold; null if there are none."""
    terms = F.filter(F.zip_with(p, q, lambda a, b: (F.exp(a) - F.exp(b)) * (a - b)), lambda t: t.isNotNull())
    return once(terms, lambda t: F.when(F.size(t) > 0, 0.5 * total(t)))


def distance_bucket(distance: Column, edges: list[int]) -> Column:
    """How many edges lie below a distance."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < distance))
