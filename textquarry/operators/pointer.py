"""Span scores from token vectors: rotary positions, a bilinear form, a start and an end bias for each type; pooled pairs.

Tokens are rows (key, position, vector) of windows that a model has read, so a window holds ``WIDEST`` tokens at most and
a window with more stops the run: what a task gathers is one window. Weights are numpy arrays of a model's size, which
is checked before they are sent along. Positions of a window must be 0, 1, 2, ...; tokens whose vector is null are no
content: no span begins or ends there. Only spans that score above a threshold leave a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDEST = 1024
#: Bytes of weights that may be sent with each task.
MOST_WEIGHTS = 64 << 20


def rotary(x: np.ndarray) -> np.ndarray:
    """Neighbouring components of row p turned by the angle p / 10000^(2 k / size), k the number of the pair."""
    n, size = x.shape
    angle = np.arange(n)[:, None] * np.exp(-math.log(10000) * np.arange(0, size, 2) / size)
    turned = (x[:, 0::2] + 1j * x[:, 1::2]) * np.exp(1j * angle)
    return np.stack([turned.real, turned.imag], -1).reshape(n, size)


@dataclass
class Pointer:
    """Weights: ``projection`` (2 size, hidden) and ``bias`` (2 types, hidden) with their offsets; starts come before ends."""

    projection: np.ndarray
    projection_offset: np.ndarray
    bias: np.ndarray
    bias_offset: np.ndarray
    turned: bool = True
    ordered: bool = True

    def __post_init__(self):
        if len(self.projection) % 4 or len(self.bias) % 2 or self.projection.shape[1] != self.bias.shape[1]:
            raise ValueError("the weights don't fit together")
        if sum(a.nbytes for a in (self.projection, self.bias)) > MOST_WEIGHTS:
            raise ValueError("the weights are too large to be sent along")

    @property
    def types(self) -> int:
        return len(self.bias) // 2

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """(types, starts, ends) of one window; pairs out of order get -10000."""
        q, k = np.split(vectors @ self.projection.T + self.projection_offset, 2, axis=1)
        if self.turned:
            q, k = rotary(q), rotary(k)
        first, last = np.split((vectors @ self.bias.T + self.bias_offset).T, 2)
        out = (q @ k.T / math.sqrt(q.shape[1]))[None] + first[:, :, None] + last[:, None, :]
        return np.where(np.triu(np.ones(out.shape[1:], bool)), out, -10000.0) if self.ordered else out


def _window(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, vectors (zeros where there is none) and which are content, by position."""
    table = table.sort_by("position")
    at, vectors = table["position"].to_numpy(), table["vector"].combine_chunks()
    if len(at) > WIDEST or (at != np.arange(len(at))).any():
        raise ValueError(f"a window needs positions 0, 1, 2, ... and at most {WIDEST} tokens")
    content = vectors.is_valid().to_numpy(zero_copy_only=False)
    flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(at), len(flat) // max(1, int(content.sum()))))
    if content.any():
        out[content] = flat.reshape(int(content.sum()), -1)
    return at, out, content


def _checked(tokens: DataFrame, key: str) -> DataFrame:
    return tokens.select(F.col(key).cast("string").alias("key"), F.col("position").cast("int").alias("position"), F.col("vector").cast("array<double>").alias("vector"))


def spans(tokens: DataFrame, pointer: Pointer, threshold: float = 0.0, key: str = "doc_id") -> DataFrame:
    """(key, first, last, type_id, logit): spans that score above ``threshold``, as ``relations.candidate_entities`` takes them.

    With ``ordered=False`` first and last are the tokens of a link, in either order.
    """

    def run(table: pa.Table) -> pa.Table:
        _, vectors, content = _window(table)
        name = table["key"][0]
        if content.any():
            scores = pointer.scores(vectors)
            type_, start, end = np.nonzero((scores > threshold) & content[None, :, None] & content[None, None, :])
            values = scores[type_, start, end]
        else:
            type_ = start = end = np.zeros(0, int)
            values = np.zeros(0)
        return pa.table({"key": pa.array([name.as_py()] * len(values), pa.string()), "first": pa.array(start, pa.int32()), "last": pa.array(end, pa.int32()), "type_id": pa.array(type_, pa.int32()), "logit": pa.array(values, pa.float64())})

    found = _checked(tokens, key).groupBy("key").applyInArrow(run, "key string, first int, last int, type_id int, logit double")
    return found.withColumn("key", F.col("key").cast(tokens.schema[key].dataType)).withColumnRenamed("key", key)


def pooled(tokens: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``found`` (key, start, end) with the mean of its tokens' vectors, by differences of prefix sums; null vectors count as zeros.

    A span that leaves its window, or is empty, gets null, and so do spans of windows without a vector.
    """
    typed = found.select(F.col(key).cast("string").alias("key"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at, vectors, content = _window(left)
        a, b = (right[c].to_pandas().fillna(-1).to_numpy().astype(int) for c in ("start", "end"))
        prefix = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors, axis=0)])
        good = (0 <= a) & (a < b) & (b <= len(at)) & content.any()
        means = [(prefix[j] - prefix[i]) / (j - i) if ok else None for i, j, ok in zip(a.tolist(), b.tolist(), good.tolist())]
        return pa.table({"key": right["key"], "start": right["start"], "end": right["end"], "mean": pa.array(means, pa.list_(pa.float64()))})

    means = _checked(tokens, key).groupBy("key").cogroup(typed.groupBy("key")).applyInArrow(run, "key string, start int, end int, mean array<double>")
    return means.withColumn("key", F.col("key").cast(found.schema[key].dataType)).withColumnRenamed("key", key)


def pair_scores(pairs: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], columns: tuple[str, ...] = ("subject", "object", "context")) -> DataFrame:
    """``pairs`` with ``scores``: two linear layers with a rectifier between, over the columns' vectors one after another."""
    (w1, b1), (w2, b2) = layers
    if w1.nbytes + w2.nbytes > MOST_WEIGHTS:
        raise ValueError("the weights are too large to be sent along")

    @F.pandas_udf("array<double>")
    def scored(x):
        rows = np.array(x.tolist(), float).reshape(len(x), w1.shape[1])
        return type(x)(list(np.maximum(rows @ w1.T + b1, 0) @ w2.T + b2))

    return pairs.withColumn("scores", scored(F.concat(*(F.col(c) for c in columns))))
