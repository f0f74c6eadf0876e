"""Span scores, pooled spans and losses against plain loops; the split bootstrap against its law."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_intervals import stages
from textquarry.operators import bootstrap, losses, pointer, relations

rng = np.random.default_rng(3)
SIZE, HIDDEN, TYPES = 4, 6, 2
MODEL = pointer.Pointer(rng.normal(size=(2 * SIZE, HIDDEN)), rng.normal(size=2 * SIZE), rng.normal(size=(2 * TYPES, HIDDEN)), rng.normal(size=2 * TYPES))


def turn(v, p):
    out = list(v)
    for k in range(0, len(v), 2):
        a = p * 10000 ** (-k / len(v))
        out[k], out[k + 1] = v[k] * math.cos(a) - v[k + 1] * math.sin(a), v[k + 1] * math.cos(a) + v[k] * math.sin(a)
    return np.array(out)


def test_spans(spark):
    data = {w: [None if (w, p) == ("b", 1) else rng.normal(size=HIDDEN) for p in range(n)] for w, n in (("a", 7), ("b", 3), ("c", 1))}
    tokens = spark.createDataFrame([(w, p, None if v is None else v.tolist(), "x") for w, vs in data.items() for p, v in enumerate(vs)], "doc_id string, position int, vector array<double>, key string").repartition(3)
    want = {}
    for w, vs in data.items():
        for i, x in enumerate(vs):
            for j, y in enumerate(vs):
                if i <= j and x is not None and y is not None:
                    q, k = (MODEL.projection @ x + MODEL.projection_offset)[:SIZE], (MODEL.projection @ y + MODEL.projection_offset)[SIZE:]
                    for t in range(TYPES):
                        s = turn(q, i) @ turn(k, j) / 2 + MODEL.bias[t] @ x + MODEL.bias_offset[t] + MODEL.bias[TYPES + t] @ y + MODEL.bias_offset[TYPES + t]
                        if s > 0:
                            want[w, i, j, t] = s
    found = pointer.spans(tokens, MODEL)
    got = {tuple(r)[:4]: r.logit for r in found.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    offsets = tokens.select("doc_id", F.col("position").alias("token"), (F.col("position") * 2).alias("start"), (F.col("position") * 2 + 1).alias("end"))
    assert relations.candidate_entities(found, offsets).count() == len(want)
    asked = spark.createDataFrame([("a", 0, 3), ("a", 6, 7), ("b", 0, 2), ("a", 2, 2), ("a", 5, 9), ("z", 0, 1), ("a", None, 1)], "doc_id string, start int, end int")
    means = {tuple(r)[:3]: r["mean"] for r in pointer.pooled(tokens, asked).collect()}
    assert np.allclose(means["a", 0, 3], np.mean(data["a"][:3], axis=0)) and np.allclose(means["b", 0, 2], data["b"][0] / 2) and len(means) == 7
    assert all(means[k] is None for k in (("a", 2, 2), ("a", 5, 9), ("z", 0, 1), ("a", None, 1)))
    assert pointer.spans(tokens.limit(0), MODEL).collect() == []
    with pytest.raises(Exception, match="positions"):
        pointer.spans(tokens.filter("position > 0"), MODEL).collect()
    with pytest.raises(ValueError):
        pointer.Pointer(MODEL.projection, MODEL.projection_offset, MODEL.bias[:3], MODEL.bias_offset[:3])


def test_pair_scores(spark):
    layers = [(rng.normal(size=(5, 6)), rng.normal(size=5)), (rng.normal(size=(3, 5)), rng.normal(size=3))]
    x = rng.normal(size=(4, 6))
    rows = spark.createDataFrame([(i, *(v[k : k + 2].tolist() for k in (0, 2, 4))) for i, v in enumerate(x)], "i int, subject array<double>, object array<double>, context array<double>")
    got = np.array([r.scores for r in pointer.pair_scores(rows, layers).orderBy("i").collect()])
    assert np.allclose(got, np.maximum(x @ layers[0][0].T + layers[0][1], 0) @ layers[1][0].T + layers[1][1])


def test_losses(spark):
    rows = [(p, d, h, float(s), bool(t)) for p in ("entity", "tail") for d in range(3) for h in range(2) for s, t in zip(rng.normal(scale=300, size=9), rng.random(9) < 0.4)]
    rows += [("entity", 9, 0, None, True), ("entity", 9, 1, 5.0, None), ("entity", 9, 1, -1e9, False), ("entity", 9, 1, -1e9, True)]
    df = spark.createDataFrame(rows, "part string, doc_id int, head int, score double, target boolean").repartition(3)
    lse = lambda x: float(np.logaddexp.reduce([0.0, *np.clip(x, -10000, 10000)]))
    want = {}
    for p, d, h, *_ in rows:
        own = [r[3:] for r in rows if r[:3] == (p, d, h) and r[3] is not None]
        want[p, d, h] = lse([s for s, t in own if not t]) + lse([-s for s, t in own if t])
    got = {tuple(r)[:3]: r.loss for r in losses.pointer_losses(df, ["part", "doc_id", "head"]).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-12) for k in want)
    parts = losses.pointer_loss(df)
    mean = {p: np.mean([v for k, v in want.items() if k[0] == p]) for p in ("entity", "tail")}
    assert math.isclose(losses.joint_loss(parts).first().loss, sum(mean.values())) and math.isclose(losses.joint_loss(parts, "sum", False).first().loss, 2 * mean["entity"])
    pairs = spark.createDataFrame([(800.0, True, True), (-800.0, True, True), (1.0, False, True), (9.0, True, False), (None, True, True)], "score double, target boolean, kept boolean")
    pair = losses.pair_loss(pairs)
    assert math.isclose(pair.first().loss, (2400 + math.log(1 + math.e)) / 3) and losses.pair_loss(pairs.limit(0)).first().loss == 0
    assert math.isclose(losses.pipeline_loss(parts.filter("part = 'entity'"), pair).first().loss, mean["entity"] + 2 * pair.first().loss)
    assert losses.pointer_losses(df.limit(0), ["doc_id"]).collect() == []


def test_split_times():
    n, replicates = 700, 400
    numbers = np.arange(n)
    times = bootstrap.split_times(numbers, n, replicates, (5, 1))
    assert (times.sum(axis=0) == n).all() and (times >= 0).all()
    for own in (numbers[::3], numbers[650:], numbers[:1]):  # any part of the rows sees the same draws
        assert (bootstrap.split_times(own, n, replicates, (5, 1)) == times[own]).all()
    assert abs(times.var(axis=1).mean() - (1 - 1 / n)) < 0.02 and abs(times.mean(axis=1) - 1).max() < 0.3
    halves = times[: n // 2].sum(axis=0)
    assert abs(halves.mean() - n / 2) < 3 and 0.75 < halves.var() / (n / 4) < 1.3
    assert (bootstrap.split_times(numbers, n, replicates, (6, 1)) != times).any() and bootstrap.split_times(numbers[:0], 0, 3, (1,)).shape == (0, 3)


def test_split_bootstrap(spark):
    counts = spark.createDataFrame([(i, i % 3, 4, 4, (i + 1) % 4, 4, 4) for i in range(500)] + [(None, 1, 1, 1, 1, 1, 1)], "doc_id int, correct_r int, predicted_r int, gold_r int, correct_c int, predicted_c int, gold_c int")
    one, two = (bootstrap.paired_documents(counts, 300, method=m).first() for m in ("split", "slots"))
    assert one.observed == two.observed and abs(one.lower - two.lower) < 0.01 and abs(one.upper - two.upper) < 0.01
    assert bootstrap.paired_documents(counts.repartition(7), 300).first() == one
    with pytest.raises(ValueError):
        bootstrap.paired_documents(counts, 5, method="other")
    assert bootstrap.split_sums(counts.limit(0), "doc_id", F.array(F.lit("x")), F.array(F.lit(1)), 5, 1).collect() == []


def test_slot_sums(spark, monkeypatch):
    """Draws that reach their rows packed, in many blocks and steps of one to four bytes, against hashes in a loop."""
    rows = spark.range(700).select(F.col("id").alias("number"), (F.col("id") % 7).alias("x"), (F.col("id") * 3 - 50).alias("y"))
    expected = {}
    for r in range(6):
        drawn = [int(hashlib.sha256(f"9:{r}:{s}".encode()).hexdigest()[:12], 16) % 700 for s in range(700)]
        expected[r] = (sum(d % 7 for d in drawn), sum(d * 3 - 50 for d in drawn))
    for block, slots, task in ((1 << 22, 1 << 16, 1 << 24), (300, 64, 500)):
        monkeypatch.setattr(bootstrap, "BLOCK", block)
        monkeypatch.setattr(bootstrap, "SLOTS", slots)
        monkeypatch.setattr(bootstrap, "TASK", task)
        got = bootstrap.slot_sums(rows.repartition(3), ["x", "y"], 700, 6, 9).collect()
        assert {r.replicate: (r.x, r.y) for r in got} == expected
    assert bootstrap.slot_sums(rows.limit(0), ["x", "y"], 0, 6, 9).collect() == []
    apart = bootstrap._steps(10**9, 10**9)([pa.RecordBatch.from_arrays([pa.array([0] * 4, pa.int32()), pa.array([5, 5, 400, 10**8])], ["r", "d"])])
    assert [(b["bytes"], np.cumsum(np.frombuffer(b["steps"], "u4")).tolist()) for x in apart for b in x.to_pylist()] == [(4, [5, 5, 400, 10**8])]


def test_slots_shuffle_little(spark):
    """Draws were rows of a shuffle twice, some 25 bytes for each; as packed steps they are one to three."""
    counts = spark.range(20_000).select(F.col("id").alias("doc_id"), *(((F.col("id") * k) % 5).alias(f"{c}_{s}") for k, (s, c) in enumerate(((s, c) for s in "rc" for c in ("correct", "predicted", "gold")), 1)))
    before = sum(s.shuffleWriteBytes() for s in stages(spark))
    assert bootstrap.paired_documents(counts, 50, method="slots").first().replicates == 50
    assert sum(s.shuffleWriteBytes() for s in stages(spark)) - before < 6_000_000
