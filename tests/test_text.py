"""Functions over long texts and vectors, which must not take the square of their length."""

import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from textquarry.functions import spans, stats, text
from textquarry.plans import storage, templates


def test_long_texts(spark):
    long = "ab😀 é\n" * 100_000
    rows = spark.createDataFrame([("",), ("abcdef",), ("abcdefg",), ("a\nb😀éfgh",), (None,), (long,)], "t string").coalesce(1)
    began = time.time()
    got = [r[0] for r in rows.select(text.punctuated(F.col("t"))).collect()]
    assert got == [None if t is None else "，".join(t[i : i + 6] for i in range(0, len(t), 6)) for (t,) in rows.collect()]
    counted = [r[0] for r in rows.select(F.size(spans.character_tokens(F.coalesce("t", F.lit(""))))).collect()]
    assert counted == [sum(not c.isspace() for c in t or "") for (t,) in rows.collect()]
    assert time.time() - began < 30


def test_long_vectors(spark):
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: i / 1000.0).alias("x"))
    began = time.time()
    assert abs(rows.select(stats.total(stats.softmax(F.col("x")))).first()[0] - 1) < 1e-9
    assert time.time() - began < 20


def test_score_functions_on_long_vectors(spark, tmp_path):
    vectors = np.random.default_rng(18).normal(size=(4, 1000)).astype("float32")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    began = time.time()
    made = storage.score_functions(spark, str(tmp_path))
    got = {r.vec_id: r for r in made.collect()}
    assert time.time() - began < 30 and len(got) == 4
    for i, v in enumerate(vectors.astype("float64")):
        p = np.exp(v - v.max()) / np.exp(v - v.max()).sum()
        kl = 0.5 * ((p - p[::-1]) * np.log(p / p[::-1])).sum()
        assert got[i].largest == v.argmax() and abs(got[i].divergence - kl) < 2e-6
    assert made.rdd.getNumPartitions() > 1


def test_score_functions_on_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [None], [None, None], [1.0, None, 2.0], [None, 1.0, 2.0, 4.0], [1.0, 2.0, None], [nan, 1.0], [inf, 1.0], [-inf, 1.0], [-inf, None, 1.0], [None, 0.0, 800.0]]
    vectors += [[0.0, 800.0], [0.0, 800.0, 0.0], [0.0, 745.0], [1e38, -1e38], [5.0], [-0.0, 0.0], [1.0, 3.0, 3.0, 2.0]]
    rows = [*enumerate(vectors), *((i, [1.0, 2.0]) for i in (None, -1, -80, -81, -161, -500, 160, -(2**63), 2**63 - 1))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    run, sql = storage.QUERIES["score_functions"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    made = run(spark, str(tmp_path))
    found = con.execute(sql)
    assert [d[0] for d in found.description] == made.columns
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, found.fetchall()))


def test_reports_are_dealt_out(spark):
    made = templates.reports(spark, "/root/testdata/sf0.001", templates.ENDPOINTS)
    assert "RoundRobin" in made._jdf.queryExecution().executedPlan().toString() or "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()
