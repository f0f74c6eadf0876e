"""Exact top-k against brute force, with ties, odd vectors and repeated rows."""

import math
import random
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from textquarry.llm import topk
from textquarry.llm._shared import pick
from textquarry.llm.topk import query, top_k

SCHEMA = "VEC_ID string, vec_id long, embedding array<float>, rank string, score string"


def brute(data, queries, k):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in ok:
        if q in queries:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out[q] = [(n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return out


def test_topk(spark):
    rnd = random.Random(3)
    data = [(i, [round(rnd.uniform(-1, 1), 1) * 0.5 for _ in range(6)]) for i in range(300)]
    data += [(1000 + i, data[7][1]) for i in range(40)]
    data += [(2000, None), (2050, []), (2100, [1.0] * 5 + [None]), (2150, [math.nan] * 6), (2200, [math.inf] * 6), (None, [0.5] * 6), (2250, [0.5] * 3), (2300, [0.25] * 3), (2301, [-3e4] * 3)]
    df = spark.createDataFrame([("z", i, v, "x", "y") for i, v in data], SCHEMA).repartition(3)
    f32 = [(r[1], r[2]) for r in df.collect()]
    queries = {i for i, _ in data if i is not None and i % 50 == 0}
    got = {}
    for r in query(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = {q: v for q, v in brute(f32, queries, 5).items() if v}
    assert {q: sorted(v) for q, v in got.items()} == want
    assert top_k(df.limit(0), df).collect() == [] and top_k(df, df.limit(0)).collect() == []
    assert len(top_k(df, pick(df, "vec_id", "embedding").filter("vec_id = 2250"), k=9).collect()) == 2


def test_thresholds_save_totals():
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.normal(0, 0.2, (4096, 64))).astype(np.int64)
    ids, k = np.arange(len(x)), 5
    q = topk.Queries([SimpleNamespace(vec_id=i, vec=x[i].tobytes()) for i in range(0, 640, 10)])
    whole = slice(0, len(q.ids))
    a, b, s, n = topk.tile(q, whole, ids[:512], x[:512], k, False)
    assert n < 0.4 * len(q.ids) * 512  # of the share that gives the cutoffs
    q.cut({int(q.ids[i]): (int(s[a == i][k - 1]), int(b[a == i][k - 1])) for i in range(len(q.ids))})
    a, b, s, n = topk.tile(q, whole, ids, x, k, True)
    assert n < 0.45 * len(q.ids) * len(x)  # of all rows, even of random ones: most totals are never added up
    total = q.x @ x.T
    total[np.arange(len(q.ids)), q.ids] = -(1 << 40)
    for i in range(len(q.ids)):
        want = sorted((-int(t), j) for j, t in enumerate(total[i]))[:k]
        assert [(-int(t), int(j)) for t, j in zip(s[a == i], b[a == i])] == want


def test_blocks_shares_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 600)
    monkeypatch.setattr(topk, "LEAST", 20)
    monkeypatch.setattr(topk, "ROWS", 16)
    monkeypatch.setattr(topk, "STEP", 3)
    rnd = random.Random(9)
    data = [(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    df = spark.createDataFrame([("z", i, v, "x", "y") for i, v in data], SCHEMA).repartition(3)
    f32 = [(r[1], r[2]) for r in df.collect()]
    got = {}
    for r in query(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == brute(f32, {i for i, _ in data if i % 50 == 0}, 5)
    # one vec_id with two vectors: one list, of both, and neither is a candidate of the other
    two = pick(df, "vec_id", "embedding").filter("vec_id IN (50, 51)").withColumn("vec_id", F.lit(50).cast("long"))
    rest = pick(df, "vec_id", "embedding").filter("vec_id NOT IN (50, 51)")
    got = [(r.vec_id, r.score) for r in top_k(rest.unionAll(two), two).orderBy("rank").collect()]
    vectors = dict(f32)
    score = lambda p, q: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(vectors[p], vectors[q]))
    want = sorted((-score(p, i), i) for p in (50, 51) for i in vectors if i not in (50, 51))[:5]
    assert got == [(i, -s) for s, i in want]
